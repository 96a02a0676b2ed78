"""The target panel in plain arrays, one (origin, horizon, method) at a time: what the relations are held against."""

import numpy as np
import pandas as pd

from gausstide.functions import linalg as la
from gausstide.operators import autoregression as ar
from gausstide.operators import charts, references
from gausstide.operators.evaluation import PANEL_COLUMNS, RIDGES, WINDOWS

def _rmse(a, b):
    return float(np.sqrt(((a - b) ** 2).mean()))


def _w2(m, c, tm, tc):
    return float(((m - tm) ** 2).sum() + la.bures(c[None], tc[None])[0])


class Series:
    """The states of one series as arrays; t must run from 0 without a gap."""

    def __init__(self, g: pd.DataFrame):
        g = g.sort_values("t")
        self.means = np.stack(g["mean"].map(np.asarray))
        self.d = self.means.shape[1]
        self.covs = np.stack(g["cov"].map(np.asarray)).reshape(-1, self.d, self.d)

    def reference(self, fit_end: int, first: int = 250):
        return self.means[:fit_end].mean(0), references.barycenter(self.covs[: min(fit_end, first)])


def select_ridge(loss_of, ridges, ties: str = "first") -> float:
    """The ridge of least loss; equal losses: the first or the last."""
    losses = [loss_of(r) for r in ridges]
    finite = [x if np.isfinite(x) else np.inf for x in losses]
    best = min(finite)
    at = [i for i, x in enumerate(finite) if x == best]
    return ridges[at[0] if ties == "first" else at[-1]]


def fixed_forecasts(s: Series, method: str, split, horizon: int, sources: range, diagonal: bool, ridges=RIDGES):
    """(ridge, means, covs) of a chart method: ridge by validation RMSE of the means, smallest on ties, refit before val_end."""
    _, fit_end, val_end, _ = split
    ref = s.reference(fit_end)
    z = charts.encode_arrays(method, s.means, s.covs, *ref)
    fit = ar.fit_diag_arrays if diagonal else ar.fit_full
    val = np.arange(max(fit_end - horizon, 0), val_end - horizon)

    def loss(r):
        m, _ = charts.decode_arrays(method, ar.predict(fit(z[:fit_end], r), z[val], horizon), s.d, *ref)
        return np.mean(np.sqrt(((m - s.means[val + horizon]) ** 2).mean(1)))

    ridge = select_ridge(loss, ridges)
    return ridge, *charts.decode_arrays(method, ar.predict(fit(z[:val_end], ridge), z[np.array(sources)], horizon), s.d, *ref)


def local_forecasts(s: Series, split, horizon: int, sources: range, windows=WINDOWS, ridges=RIDGES):
    """(window, ridge, rows): chart and fit on the trailing window of each source; window and ridge by validation RMSE, then the smaller window and the larger ridge."""
    _, fit_end, val_end, _ = split
    cache: dict = {}

    def coordinates(t, length):
        if (t, length) not in cache:
            m, c = s.means[t - length + 1 : t + 1], s.covs[t - length + 1 : t + 1]
            ref = m.mean(0), references.exact_barycenter(c)
            cache[t, length] = (*ref, charts.encode_arrays("transport_local", m, c, *ref))
        return cache[t, length]

    def forecast(t, length, ridge):
        rm, rc, z = coordinates(t, length)
        return charts.decode_arrays("transport_local", ar.predict(ar.fit_dual(z, ridge), z[-1], horizon), s.d, rm, rc)

    val = range(max(fit_end - horizon, max(windows) - 1), val_end - horizon)
    grid = [(np.mean([_rmse(forecast(t, w, r)[0], s.means[t + horizon]) for t in val]) if len(val) else 0.0, w, -r) for w in windows for r in ridges]
    _, w, r = min(grid)
    return w, -r, [(*forecast(t, w, -r), references.residual(la.prepared(s.covs[t - w + 1 : t + 1])[1], coordinates(t, w)[1])) for t in sources]


def raw_forecasts(s: Series, x: np.ndarray, window: int, step: int, split, horizon: int, sources: range, ridges=RIDGES):
    """(ridge, means, covs): vector autoregression of the raw rows; the state of the predicted window rows. Ties: the largest ridge."""
    _, fit_end, val_end, _ = split

    def state(t, weights):
        rows = ar.predict_raw_window(x, weights, t * step + window, (t + horizon) * step, window)
        c = np.atleast_2d(np.cov(rows, rowvar=False)) + 1e-8 * np.eye(s.d)
        return rows.mean(0), la.floored(c, la.STATE_FLOOR)

    raw_end = lambda end: (end - 1) * step + window
    val = range(max(fit_end - horizon, 0), val_end - horizon)

    def loss(r):
        w = ar.fit_raw(x[: raw_end(fit_end)], r)
        return np.mean([_rmse(state(t, w)[0], s.means[t + horizon]) for t in val])

    ridge = select_ridge(loss, ridges, ties="last")
    weights = ar.fit_raw(x[: raw_end(val_end)], ridge)
    found = [state(t, weights) for t in sources]
    return ridge, np.array([m for m, _ in found]), np.array([c for _, c in found])


def panel(states: pd.DataFrame, splits, horizons, methods, x=None, window=0, step=0, diagonal=False) -> pd.DataFrame:
    s, rows = Series(states), []
    for split in splits:
        for h in horizons:
            for method in methods:
                sources = range(split[2] - h, split[3] - h)
                length, ridge, residual = None, None, [None] * len(sources)
                if method == "persistence":
                    means, covs = s.means[np.array(sources)], s.covs[np.array(sources)]
                elif method == "transport_local":
                    length, ridge, found = local_forecasts(s, split, h, sources)
                    means, covs, residual = (list(c) for c in zip(*found, strict=True))
                elif method == "raw_var":
                    ridge, means, covs = raw_forecasts(s, x, window, step, split, h, sources)
                else:
                    ridge, means, covs = fixed_forecasts(s, method, split, h, sources, diagonal)
                local = method == "transport_local"
                for t, m, c, r in zip(sources, means, covs, residual, strict=True):
                    rows.append((*split, h, t, t + h, method, length, ridge, _rmse(m, s.means[t + h]), _w2(m, c, s.means[t + h], s.covs[t + h]), float(la.smallest_eigenvalue(c)), r, True if local else None, False if local else None))
    return pd.DataFrame(rows, columns=PANEL_COLUMNS)
