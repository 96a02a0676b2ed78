"""References: Bures barycenters as aggregates over covariance columns, and rolling references."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gausstide.functions import linalg as la
from gausstide.session import checkpointed

STEPS, TOLERANCE, HISTORY = 35, 1e-9, 5


def _size(a: np.ndarray) -> float:
    return float(np.sqrt((a * a).sum()))


def _gap(a: np.ndarray, b: np.ndarray) -> float:
    return _size(a - b) / max(_size(b), 1e-12)


def fixed_point(covs: np.ndarray, s: np.ndarray) -> np.ndarray:
    """One step of the barycenter map: S^-1/2 (mean of (S^1/2 C S^1/2)^1/2)^2 S^-1/2."""
    r, inverse = la.power(s, 0.5), la.power(s, -0.5)
    m = la.power(r @ covs @ r, 0.5).mean(0)
    return la.floored(inverse @ m @ m @ inverse)


def barycenter(covs: np.ndarray) -> np.ndarray:
    """Plain iteration from the arithmetic mean; after STEPS steps the last iterate counts."""
    s = la.floored(covs.mean(0))
    for _ in range(STEPS):
        new = fixed_point(covs, s)
        s, gap = new, _gap(new, s)
        if gap < TOLERANCE:
            break
    return s


class NotConverged(ArithmeticError):
    pass


def factor_step(roots: np.ndarray, s: np.ndarray) -> np.ndarray:
    """One step of the barycenter map from the roots of the covariances, by singular values of the products of roots; nothing inside is floored, only the result at STATE_FLOOR."""
    root, inverse = la.strict_power(s, 0.5), la.strict_power(s, -0.5)
    return stepped(la.product_root(root, roots).mean(0), inverse)


def stepped(mean_root: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """The new covariance from the mean of (S^1/2 C S^1/2)^1/2 and S^-1/2."""
    f = mean_root @ inverse
    return la.strict_floored(la.strict_matrices(la.sym(f.T @ f)))


class Solution:
    """The state of a safeguarded Anderson iteration for the fixed point of a step that is computed elsewhere: in a task for ``exact_barycenter``, by an aggregate over all rows for ``grouped_barycenters``.

    ``candidates`` are to be stepped; ``accept`` takes the steps. An accelerated candidate combines the last HISTORY
    differences; it is taken only if its residual is no worse than that of the ordinary one, up to 64 units of rounding.
    """

    def __init__(self, start: np.ndarray):
        self.candidates = [start]
        self.steps: list[np.ndarray] = []
        self.gaps: list[np.ndarray] = []
        self.residual = np.inf

    def accept(self, after: list[np.ndarray]) -> bool:
        """Whether the last step is the answer."""
        s, step = self.candidates[0], after[0]
        if len(after) > 1:
            worst = _gap(step, s)
            if np.isfinite(after[1]).all() and _gap(after[1], self.candidates[1]) <= worst + 64 * np.finfo(float).eps * max(1.0, worst):
                s, step = self.candidates[1], after[1]
        self.steps, self.gaps = [*self.steps[-HISTORY:], step], [*self.gaps[-HISTORY:], step - s]
        self.residual = _size(step - s) / max(_size(s), 1e-12)
        if self.residual <= TOLERANCE:
            return True
        self.candidates = [step]
        n = min(HISTORY, len(self.gaps) - 1)
        if n:
            difference = lambda a: np.stack([(a[-k] - a[-k - 1]).ravel() for k in range(1, n + 1)], 1)
            weights = np.linalg.lstsq(difference(self.gaps), self.gaps[-1].ravel(), rcond=None)[0]
            self.candidates.append(la.floored(step - (difference(self.steps) @ weights).reshape(step.shape), la.STATE_FLOOR))
        return False


def exact_barycenter(covs: np.ndarray) -> np.ndarray:
    """Accelerated iteration from the arithmetic mean on roots that are taken once; raises NotConverged. The barycenter of equal covariances is that covariance, whatever its condition."""
    covs, roots = la.prepared(covs)
    solution = Solution(la.floored(covs.mean(0), la.STATE_FLOOR))
    for _ in range(STEPS + 1):
        if solution.accept([factor_step(roots, c) for c in solution.candidates]):
            return solution.steps[-1]
    raise NotConverged(f"barycenter after {STEPS} steps")


def residual(roots: np.ndarray, s: np.ndarray) -> float:
    """How far a step moves ``s``, relative to its size."""
    return _gap(factor_step(roots, s), s)


def _stack(series: pd.Series) -> np.ndarray:
    a = np.stack(series.map(np.asarray))
    d = int(round(np.sqrt(a.shape[1])))
    return a.reshape(-1, d, d)


#: States of a group above which its barycenter is solved by aggregates over all tasks instead of in one.
LARGE = 20_000
#: Groups whose sums a task of ``grouped_barycenters`` holds before it passes them on.
HELD = 500


def _kinds(states: DataFrame, by: list[str]) -> str:
    return "".join(f"`{c}` {states.schema[c].dataType.simpleString()}, " for c in by)


def group_references(states: DataFrame, by: list[str], exact: bool = False, first: int | None = None, large: int = LARGE) -> DataFrame:
    """(by, ref_mean, ref_cov) per group: mean of the means, barycenter of the covariances (of the ``first`` states by t where given).

    Groups of up to ``large`` states are solved in a task each, larger ones by ``grouped_barycenters``.
    """
    states = states.select(*by, "t", "mean", "cov")
    means = F.posexplode("mean").alias("p", "v")
    cells = states.select(*by, means).groupBy(*by, "p").agg(F.avg("v").alias("v"))
    ref_mean = cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda r: r["v"]).alias("ref_mean"))
    if first is not None:  # before any group meets in a task
        at = F.row_number().over(W.partitionBy(*by).orderBy("t"))
        states = states.withColumn("_at", at).filter(F.col("_at") <= first).drop("_at")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        s = (exact_barycenter if exact else barycenter)(_stack(g.sort_values("t")["cov"]))
        return pd.DataFrame([[*g[by].iloc[0], s.reshape(-1)]], columns=[*by, "ref_cov"])

    def solved(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by).applyInPandas(run, f"{_kinds(states, by)}ref_cov array<double>")

    if first is not None and first <= large:
        return ref_mean.join(solved(states), by)
    sizes = checkpointed(states.groupBy(*by).agg((F.count("*") > large).alias("_many")))
    if not sizes.filter("_many").take(1):
        return ref_mean.join(solved(states), by)
    few, many = (states.join(sizes.filter(c).select(*by), by, "left_semi") for c in ("not _many", "_many"))
    apart = grouped_barycenters(many, by, exact)
    failed = F.raise_error(F.concat(F.lit("barycenter: "), F.col("error"))).cast("array<double>")
    return ref_mean.join(solved(few).unionByName(apart.select(*by, F.when(F.col("error").isNull(), F.col("ref_cov")).otherwise(failed).alias("ref_cov"))), by)


def grouped_barycenters(states: DataFrame, by: list[str], exact: bool = True) -> DataFrame:
    """(by, ref_cov, residual, rounds, error) of any number of groups of any size, all at once.

    Roots of the covariances are taken once and staged. Each round joins them to the candidates of the groups that have
    not converged, adds up the roots of the products in each task and exchanges d x d cells per group and task; a row
    per group then takes the step. Rounds are staged, so that a lost executor costs a round. A group that fails or does
    not converge has the reason in ``error``.
    """
    keep = _kinds(states, by)
    states = states.select(*by, "cov")
    rows = checkpointed(states.select(*by, la.call("strict_floored", "cov").alias("cov")).select(*by, "cov", la.call("strict_root", "cov").alias("root")))
    cells = rows.select(*by, F.posexplode("cov").alias("p", "v")).groupBy(*by, "p").agg(F.avg("v").alias("v"))
    start = cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda r: r["v"]).alias("s"))
    none = F.array().cast("array<array<double>>")
    active = checkpointed(start.select(*by, F.array("s").alias("candidates"), none.alias("steps"), none.alias("gaps")))

    def partial(batches):
        sums: dict[tuple, list] = {}
        for b in batches:
            for key, g in b.groupby(by, dropna=False):
                roots, covs = _stack(g["root"]), _stack(g["cov"])
                for j, c in enumerate(g["candidates"].iloc[0]):
                    s = la.floored(np.asarray(c).reshape(roots.shape[1:]), la.STATE_FLOOR if exact else la.FLOOR)
                    try:
                        r = la.strict_power(s, 0.5) if exact else la.power(s, 0.5)
                        total = (la.product_root(r, roots) if exact else la.power(r @ covs @ r, 0.5)).sum(0)
                    except (ArithmeticError, ValueError, np.linalg.LinAlgError):
                        total = np.full(roots.shape[1:], np.nan)  # the step reports it
                    held = sums.setdefault((*key, j), [0.0, 0])
                    held[0], held[1] = held[0] + total, held[1] + len(g)
            if len(sums) > HELD:
                yield made(sums)
                sums = {}
        if sums:
            yield made(sums)

    def made(sums: dict) -> pd.DataFrame:
        return pd.DataFrame([[*k, v.reshape(-1), n] for k, (v, n) in sums.items()], columns=[*by, "j", "v", "n"])

    def step(batches):
        for b in batches:
            out = []
            for _, row in b.iterrows():
                d = int(round(np.sqrt(len(row["candidates"][0]))))
                square = lambda a, d=d: [np.asarray(x).reshape(d, d) for x in a]
                solution = Solution(None)
                solution.candidates, solution.steps, solution.gaps = (square(row[c]) for c in ("candidates", "steps", "gaps"))
                error, done = None, False
                try:
                    means = square(row["means"])
                    if exact:
                        done = solution.accept([stepped(m, la.strict_power(s, -0.5)) for m, s in zip(means, solution.candidates, strict=True)])
                    else:
                        s, inverse = solution.candidates[0], la.power(solution.candidates[0], -0.5)
                        solution.candidates = [la.floored(inverse @ means[0] @ means[0] @ inverse)]
                        solution.steps, solution.residual = solution.candidates, _gap(solution.candidates[0], s)
                        done = solution.residual < TOLERANCE
                except (ArithmeticError, ValueError, np.linalg.LinAlgError) as e:
                    error = f"{type(e).__name__}: {e}"
                flat = lambda a: [x.reshape(-1) for x in a]
                out.append([*row[by], flat(solution.candidates), flat(solution.steps), flat(solution.gaps), float(solution.residual), done, error])
            yield pd.DataFrame(out, columns=[*by, "candidates", "steps", "gaps", "residual", "done", "error"])

    finished = []
    for rounds in range(1, STEPS + 2):
        sums = rows.join(active.select(*by, "candidates"), by).mapInPandas(partial, f"{keep}j int, v array<double>, n long")
        cells = sums.select(*by, "j", "n", F.posexplode("v").alias("p", "v")).groupBy(*by, "j", "p").agg((F.sum("v") / F.sum("n")).alias("v"))
        listed = lambda c, k: F.transform(F.array_sort(F.collect_list(F.struct(k, c))), lambda r: r[c])
        means = cells.groupBy(*by, "j").agg(listed("v", "p").alias("m")).groupBy(*by).agg(listed("m", "j").alias("means"))
        after = active.join(means, by).mapInPandas(step, f"{keep}candidates array<array<double>>, steps array<array<double>>, gaps array<array<double>>, residual double, done boolean, error string")
        after = checkpointed(after)
        last = rounds > STEPS if exact else rounds == STEPS
        over = F.lit(True) if last else F.col("done") | F.col("error").isNotNull()
        late = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("done") & F.lit(exact), F.lit(f"barycenter after {STEPS} steps"))
        cov = F.when(late.isNull(), F.element_at("steps", -1))
        finished.append(after.filter(over).select(*by, cov.alias("ref_cov"), "residual", F.lit(rounds).alias("rounds"), late.alias("error")))
        active = after.filter(~over).select(*by, "candidates", "steps", "gaps")
        if last or not active.take(1):
            break
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


#: Names of the candidate references in their order, which decides ties.
LIBRARY = ["pooled", "log_mean", "diagonal", "identity", "barycenter", *(f"sample_{j}" for j in range(4)), *(f"to_{x}_{a}" for a in (0.25, 0.5, 0.75) for x in ("diagonal", "identity"))]


def library(states: DataFrame, by: list[str], fit_end: int | None = None) -> DataFrame:
    """(by, name, ref_mean, ref_cov): candidate references of the fit states (t < ``fit_end`` where given): pooled, log-Euclidean mean, diagonal, scaled identity, barycenter (first 250), up to four sample states with their own means, and points on geodesics from the pooled one to the diagonal and the identity.

    All sums are grouped; t runs from 0 without gaps in each group.
    """
    rows = states.select(*by, "t", "mean", "cov")
    rows = checkpointed((rows if fit_end is None else rows.filter(F.col("t") < fit_end)).withColumn("cov", la.state_floor("cov")))

    def average(column: str, name: str, source: DataFrame) -> DataFrame:
        cells = source.select(*by, F.posexplode(column).alias("p", "v")).groupBy(*by, "p").agg(F.avg("v").alias("v"))
        return cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda r: r["v"]).alias(name))

    d = F.sqrt(F.size("m").cast("double")).cast("int")
    on_diagonal = lambda p: p % (d + 1) == 0
    pooled = average("cov", "m", rows).select(*by, la.state_floor("m").alias("m"))
    share = F.aggregate(F.sequence(F.lit(0), d - 1), F.lit(0.0), lambda s, i: s + F.get("m", i * (d + 1))) / d
    made = pooled.withColumns({"diagonal": F.transform("m", lambda v, p: F.when(on_diagonal(p), v).otherwise(0.0)), "identity": F.transform("m", lambda v, p: F.when(on_diagonal(p), share).otherwise(0.0))})
    made = made.withColumns({"diagonal": la.state_floor("diagonal"), "identity": la.state_floor("identity")})
    logs = average("log", "log_mean", rows.select(*by, la.call("logm", "cov").alias("log"))).select(*by, la.call("expm", "log_mean").alias("log_mean"))
    centre = group_references(rows, by, first=250).select(*by, F.col("ref_cov").alias("barycenter"))
    wide = made.withColumnRenamed("m", "pooled").join(logs, by).join(centre, by).join(average("mean", "ref_mean", rows), by)
    names = ["pooled", "log_mean", "diagonal", "identity", "barycenter"]
    for a in (0.25, 0.5, 0.75):
        for x in ("diagonal", "identity"):
            wide = wide.withColumn(f"to_{x}_{a}", la.geodesic_column("pooled", x, a))
            names.append(f"to_{x}_{a}")
    each = wide.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col("ref_mean"), F.col(f"`{n}`").alias("ref_cov")) for n in names))).alias("r")).select(*by, "r.*")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    most = F.least(F.col("n"), F.lit(4))
    places = sizes.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), most - 1))).withColumn("t", F.when(most == 1, 0).otherwise(F.expr("j * (n - 1) div greatest(least(n, 4) - 1, 1)")).cast("int"))
    samples = rows.join(places, [*by, "t"]).select(*by, F.concat(F.lit("sample_"), F.col("j").cast("string")).alias("name"), F.col("mean").alias("ref_mean"), F.col("cov").alias("ref_cov"))
    return each.unionByName(samples)


class RollingReference:
    """The reference of a trailing window, origin by origin.

    At an origin that is a multiple of ``refresh`` (and at the first) the barycenter is solved; at others ``warm``
    ordinary steps start from the previous reference and are kept if the residual stays within ``threshold``. Origins
    must follow each other, and the states that two windows share must be the same in both; the mean is updated by the
    entering and the leaving state.
    """

    def __init__(self, length: int, refresh: int = 1, warm: int = 3, threshold: float = 1e-4):
        self.length, self.refresh, self.warm, self.threshold = length, refresh, warm, threshold
        self.origin, self.mean, self.cov, self.seen = None, None, None, None

    def at(self, origin: int, means: np.ndarray, covs: np.ndarray) -> dict:
        """``means``, ``covs``: the ``length`` states up to and with ``origin``."""
        first = self.origin is None
        if not first and origin != self.origin + 1:
            raise ValueError("origins must follow each other")
        if len(means) != self.length or len(covs) != self.length:
            raise ValueError(f"a window has {self.length} states")
        if not first and not (np.array_equal(means[:-1], self.seen[0][1:]) and np.array_equal(covs[:-1], self.seen[1][1:])):
            raise ValueError("states of the window before have changed")
        mean = means.mean(0) if first else self.mean + (means[-1] - self.seen[0][0]) / self.length
        projected, roots = la.prepared(covs)
        refreshed, fallback = first or origin % self.refresh == 0, False
        if not refreshed:
            try:
                s = self.cov
                for _ in range(self.warm):
                    s = factor_step(roots, s)
                left = residual(roots, s)
                fallback = not left <= self.threshold
            except la.NumericalError:
                fallback = True
        if refreshed or fallback:
            s = exact_barycenter(projected)
            left = residual(roots, s)
        self.origin, self.mean, self.cov, self.seen = origin, mean, s, (np.array(means), np.array(covs))
        return {"t": origin, "ref_mean": mean.copy(), "ref_cov": s.reshape(-1), "residual": left, "refreshed": bool(refreshed), "fallback": bool(fallback)}


ROLLING = "t int, ref_mean array<double>, ref_cov array<double>, residual double, refreshed boolean, fallback boolean"


def segments(states: DataFrame, length: int, refresh: int) -> DataFrame:
    """``states`` with ``segment``: the origins between two refreshes need nothing but the states since the first one and the length - 1 before it, so a series falls into segments, each with those states once more (its halo). Segments span as many refreshes as make them no shorter than their halo."""
    span = refresh * -(-length // refresh)
    last = F.floor((F.col("t") + length - 1) / span)
    return states.withColumn("segment", F.explode(F.sequence(F.floor(F.col("t") / span), last)))


def rolling_references(states: DataFrame, by: list[str], length: int, refresh: int = 1, warm: int = 3, threshold: float = 1e-4) -> DataFrame:
    """(by, t, reference ...) for every origin with ``length`` states up to it; t runs without gaps. A task per segment of a series, see ``segments``."""
    span = refresh * -(-length // refresh)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        means, covs, t = np.stack(g["mean"].map(np.asarray)), _stack(g["cov"]), g["t"].to_numpy()
        if (np.diff(t) != 1).any():
            raise ValueError("states must be numbered without gaps")
        rolling, rows = RollingReference(length, refresh, warm, threshold), []
        for i in range(length - 1, len(g)):
            if t[i] // span == g["segment"].iloc[0]:
                rows.append(rolling.at(int(t[i]), means[i - length + 1 : i + 1], covs[i - length + 1 : i + 1]))
        out = pd.DataFrame(rows, columns=["t", "ref_mean", "ref_cov", "residual", "refreshed", "fallback"])
        for c in reversed(by):
            out.insert(0, c, g[c].iloc[0])
        return out

    rows = segments(states.select(*by, "t", "mean", "cov"), length, refresh)
    return rows.groupBy(*by, "segment").applyInPandas(run, _kinds(states, by) + ROLLING)
