"""Charts: Gaussian states to linear coordinates and back.

Coordinates are the mean part, then the d(d+1)/2 covariance part. The registry maps a chart's name to its covariance
encoder and decoder on stacks of matrices; ``register`` adds one.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gausstide.functions import linalg as la


class Chart(NamedTuple):
    encode: Callable[[np.ndarray, np.ndarray], np.ndarray]  # (covariances, reference) -> coordinates
    decode: Callable[[np.ndarray, np.ndarray], np.ndarray]
    centred: bool = False  # whether the mean part is relative to the reference mean


def half(a: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(a.shape[-1])
    return a[..., i, j]


def unhalf(z: np.ndarray) -> np.ndarray:
    d = int((np.sqrt(8 * z.shape[-1] + 1) - 1) / 2)
    out = np.zeros((*z.shape[:-1], d, d))
    i, j = np.triu_indices(d)
    out[..., i, j] = out[..., j, i] = z
    return out


def _cholesky(c, _):
    low = np.linalg.cholesky(la.floored(c, la.STATE_FLOOR))
    at = np.arange(c.shape[-1])
    low[..., at, at] = np.log(np.maximum(low[..., at, at], la.LOG_FLOOR))
    i, j = np.tril_indices(c.shape[-1])
    return low[..., i, j]


def _from_cholesky(z, _):
    d = int((np.sqrt(8 * z.shape[-1] + 1) - 1) / 2)
    low = np.zeros((*z.shape[:-1], d, d))
    i, j = np.tril_indices(d)
    low[..., i, j] = z
    at = np.arange(d)
    low[..., at, at] = np.exp(np.clip(low[..., at, at], -30, 30))
    return la.floored(low @ la.mt(low), la.STATE_FLOOR)


def _transport(c, ref):
    return half(la.transport(np.broadcast_to(ref, c.shape), c) - np.eye(c.shape[-1]))


def _local(c, ref):
    return half(la.strict_transport(np.broadcast_to(ref, c.shape), c) - np.eye(c.shape[-1]))


def _from_transport(margin: float):
    def decode(z, ref):
        a = la.safe_map(unhalf(z), margin)
        return la.floored(a @ ref @ a, la.STATE_FLOOR)

    return decode


def _from_local(z, ref):
    return la.local_state(unhalf(z), ref)


def _strict_log(c, _):
    """Without a floor: a covariance that is not definite is an error."""
    if (la.smallest_eigenvalue(la.strict_matrices(c)) <= 0).any():
        raise la.NumericalError("a logarithm needs positive eigenvalues")
    return half(la.spectral(c, np.log))


CHARTS: dict[str, Chart] = {
    "euclidean": Chart(lambda c, _: half(c), lambda z, _: la.floored(unhalf(z), la.STATE_FLOOR)),
    "cholesky": Chart(_cholesky, _from_cholesky),
    "log_euclidean": Chart(lambda c, _: half(la.logm(c)), lambda z, _: la.floored(la.expm(unhalf(z)), la.STATE_FLOOR)),
    "log_strict": Chart(_strict_log, lambda z, _: la.floored(la.expm(unhalf(z)), la.STATE_FLOOR)),
    "transport_fixed": Chart(_transport, _from_transport(0.05), True),
    "transport_study": Chart(_transport, _from_transport(0.08), True),
    "transport_local": Chart(_local, _from_local, True),
}


def register(name: str, chart: Chart) -> None:
    CHARTS[name] = chart


def encode_arrays(method: str, means: np.ndarray, covs: np.ndarray, ref_mean: np.ndarray, ref_cov: np.ndarray) -> np.ndarray:
    chart = CHARTS[method]
    return np.concatenate([means - ref_mean if chart.centred else means, chart.encode(covs, ref_cov)], -1)


def decode_arrays(method: str, z: np.ndarray, d: int, ref_mean: np.ndarray, ref_cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chart = CHARTS[method]
    return z[..., :d] + (ref_mean if chart.centred else 0.0), chart.decode(z[..., d:], ref_cov)


def _encoded(method: str, *arrays: np.ndarray) -> tuple[list, list]:
    """(coordinates, errors) of a stack; if it fails, of each of its states alone."""
    try:
        z = encode_arrays(method, *arrays)
        if np.isfinite(z).all():
            return list(z), [None] * len(z)
        if len(z) == 1:
            raise la.NumericalError("coordinates are not finite")
    except (ArithmeticError, ValueError, np.linalg.LinAlgError) as e:
        if len(arrays[0]) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
    each = [_encoded(method, *(a[i : i + 1] for a in arrays)) for i in range(len(arrays[0]))]
    return [z for zs, _ in each for z in zs], [e for _, es in each for e in es]


def encode(states: DataFrame, references: DataFrame, methods: list[str], by: list[str] | None = None, errors: bool = False) -> DataFrame:
    """(by, t, method, z): every state in every chart. ``references``: one row (by, ref_mean, ref_cov) per series, broadcast.

    ``errors`` adds the column error: a state that a chart fails on, or gives no finite coordinates, has no z and the
    reason, and costs its own row only; without it such a failure ends the job.
    """
    by = by or []
    joined = states.join(references, by) if by else states.crossJoin(F.broadcast(references))
    rows = joined.withColumn("method", F.explode(F.array(*map(F.lit, methods))))

    def run(batches):
        for b in batches:
            out = []
            for (method, d), g in b.groupby(["method", b["mean"].map(len)]):
                stack = lambda c, shape: np.stack(g[c].map(np.asarray)).reshape(shape)  # noqa: B023, E731
                arrays = stack("mean", (-1, d)), stack("cov", (-1, d, d)), stack("ref_mean", (-1, d)), stack("ref_cov", (-1, d, d))
                z, why = _encoded(method, *arrays) if errors else (list(encode_arrays(method, *arrays)), None)
                made = g[[*by, "t", "method"]].assign(z=z)
                out.append(made.assign(error=why) if errors else made)
            if out:
                yield pd.concat(out)

    kinds = "".join(f"`{c}` {states.schema[c].dataType.simpleString()}, " for c in by)
    return rows.select(*by, "t", "method", "mean", "cov", "ref_mean", "ref_cov").mapInPandas(run, f"{kinds}t int, method string, z array<double>" + ", error string" * errors)


def decode(coordinates: DataFrame, references: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, t, method, mean, cov, repaired, low): states back from coordinates, a stack of matrices at a time. ``low`` is the smallest eigenvalue of the raw map I + H (of the decoded covariance in charts without one), ``repaired`` tells that the map had to be made positive."""
    by = by or []
    rows = coordinates.join(references, by) if by else coordinates.crossJoin(F.broadcast(references))

    def run(batches):
        for b in batches:
            out = []
            for (method, d), g in b.groupby(["method", b["ref_mean"].map(len)]):
                chart, stack = CHARTS[method], lambda c, g=g: np.stack(g[c].map(np.asarray))
                z, ref_mean, ref_cov = stack("z"), stack("ref_mean"), stack("ref_cov").reshape(-1, d, d)
                m, c = z[:, :d] + (ref_mean if chart.centred else 0.0), chart.decode(z[:, d:], ref_cov)
                low = la.smallest_eigenvalue(np.eye(d) + unhalf(z[:, d:])) if chart.centred else la.smallest_eigenvalue(c)
                out.append(g[[*by, "t", "method"]].assign(mean=list(m), cov=list(c.reshape(len(g), -1)), repaired=low <= 0, low=low))
            if out:
                yield pd.concat(out)

    kinds = "".join(f"`{c}` {coordinates.schema[c].dataType.simpleString()}, " for c in by)
    return rows.mapInPandas(run, f"{kinds}t int, method string, mean array<double>, cov array<double>, repaired boolean, low double")
