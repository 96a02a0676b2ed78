"""Windowed Gaussian states from grids: moments of hopping windows and of tumbling blocks.

A state row is (t, n, mean array<double>, cov array<double> row-major). Sums of values and of products are grouped
natively: first per pane (the greatest length that divides window and step), then panes are added up into the windows
that cover them, so a step's products are formed and shuffled once however many windows overlap.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gausstide.functions.linalg import state_floor


def vectors(grid: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, i, x): the values of a step in key order."""
    return grid.groupBy(*(by or []), "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda r: r["c"]).alias("x"))


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _d, _p, _v, n): the sums of the vector and of its outer product, by cell, from rows (keys, x)."""
    outer = F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: a * b)))
    parts = rows.select(*keys, F.size("x").alias("_d"), F.posexplode(F.concat("x", outer)).alias("_p", "_v"))
    return parts.groupBy(*keys, "_d", "_p").agg(F.sum("_v").alias("_v"), F.count("*").alias("n"))


def _gathered(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.groupBy(*keys, "_d").agg(F.max("n").cast("int").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda r: r["_v"]).alias("_s"))


def moments(rows: DataFrame, keys: list[str], ridge: float = 0.0, shrinkage: float = 0.0) -> DataFrame:
    """(keys, n, mean, cov) of the vectors x of each key; covariance with ddof 1, shrunk towards a multiple of the identity with the same trace, plus ``ridge`` on the diagonal."""
    return _states(_gathered(_sums(rows, keys), keys), keys, ridge, shrinkage)


def _states(moments: DataFrame, keys: list[str], ridge: float, shrinkage: float = 0.0) -> DataFrame:
    row = lambda p: F.floor(p / F.col("_d")).cast("int")
    col = lambda p: p % F.col("_d")
    s = lambda p: F.get("_s", p)
    cell = lambda p: (s(F.col("_d") + p) - s(row(p)) * s(col(p)) / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    cov = F.transform(F.sequence(F.lit(0), F.col("_d") * F.col("_d") - 1), cell)
    columns = {"mean": F.transform(F.slice("_s", 1, F.col("_d")), lambda v: v / F.col("n")), "cov": cov}
    if shrinkage:  # the trace comes from the sums, so that no cell is computed again for each diagonal cell
        share = F.aggregate(F.sequence(F.lit(0), F.col("_d") - 1), F.lit(0.0), lambda a, i: a + cell(i * (F.col("_d") + 1))) / F.col("_d")
        columns["cov"] = F.transform(cov, lambda v, p: (1 - shrinkage) * v + F.when(row(p) == col(p), shrinkage * share).otherwise(0.0))
    out = moments.select(*keys, "n", "_d", *(c.alias(name) for name, c in columns.items()))
    if ridge:
        out = out.withColumn("cov", F.transform("cov", lambda v, p: v + F.when(row(p) == col(p), ridge).otherwise(0.0)))
    return out.select(*keys, "n", "mean", "cov")


def thinned(n: int, most: int) -> list[int]:
    """The window numbers kept of ``n`` when at most ``most`` may stay: evenly spaced, ends included."""
    return list(range(n)) if n <= most else [int(i * (n - 1) / (most - 1)) if most > 1 else 0 for i in range(most)]


def hopping_states(grid: DataFrame, window: int, step: int, steps: int, ridge: float = 1e-5, floor: bool = False, most: int = 900, by: list[str] | None = None) -> DataFrame:
    """(by, t, n, mean, cov): states of the full windows that start at 0, step, 2 step, ...; covariance with ddof 1, plus ``ridge`` on the diagonal.

    ``by`` names the columns of a series: all series of a grid go through one plan. ``floor`` clips eigenvalues at 1e-8
    (an Arrow UDF); without it the plan has no Python. Too few steps: no rows.
    """
    keys = [*(by or []), "t"]
    n = max(0, (steps - window) // step + 1)
    size = math.gcd(window, step)
    panes = _sums(vectors(grid, by).select(*keys[:-1], F.floor(F.col("i") / size).cast("int").alias("t"), "x"), keys)
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - window // size + 1) / (step // size))).cast("int")
    last = F.least(F.lit(n - 1), F.floor(F.col("t") / (step // size))).cast("int")
    cells = panes.withColumns({"_a": first, "_b": last}).filter("_a <= _b").withColumn("t", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    if n > most:
        keep = grid.sparkSession.createDataFrame([(t, j) for j, t in enumerate(thinned(n, most))], "t int, _j int")
        cells = cells.join(F.broadcast(keep), "t").withColumn("t", F.col("_j")).drop("_j")  # at most ``most`` rows
    sums = cells.groupBy(*keys, "_d", "_p").agg(F.sum("_v").alias("_v"), F.sum("n").alias("n"))
    out = _states(_gathered(sums, keys).filter(F.col("n") == window), keys, ridge)
    return out.withColumn("cov", state_floor("cov")) if floor else out


def contiguous_blocks(rows: DataFrame, size: int, seconds: int) -> DataFrame:
    """(block, start, end) of the blocks of ``size`` rows (i, ts) whose gaps all equal ``seconds``."""
    gaps = rows.withColumn("block", F.floor(F.col("i") / size).cast("int"))
    gaps = gaps.withColumn("gap", F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(W.partitionBy("block").orderBy("i"))))
    whole = gaps.groupBy("block").agg(F.count("*").alias("n"), F.min("gap").alias("a"), F.max("gap").alias("b"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return whole.filter((F.col("n") == size) & (F.col("a") == seconds) & (F.col("b") == seconds)).select("block", "start", "end")


def block_states(grid: DataFrame, size: int, steps: int, shrinkage: float = 0.0, ridge: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """(by, t, n, mean, cov): states of complete tumbling blocks, shrunk towards a multiple of the identity with the same trace."""
    last, keys = steps // size, [*(by or []), "t"]
    rows = vectors(grid, by).select(*keys[:-1], F.floor(F.col("i") / size).cast("int").alias("t"), "x").filter(F.col("t") < last)
    return _states(_gathered(_sums(rows, keys), keys).filter(F.col("n") == size), keys, ridge, shrinkage)


def tidy(states: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Long means (by, t, i, value) and the covariances' upper triangle (by, t, i, j, value)."""
    keys = [*(by or []), "t"]
    means = states.select(*keys, F.posexplode("mean").alias("i", "value"))
    cells = states.select(*keys, F.size("mean").alias("d"), F.posexplode("cov").alias("p", "value"))
    cells = cells.select(*keys, F.floor(F.col("p") / F.col("d")).cast("int").alias("i"), (F.col("p") % F.col("d")).cast("int").alias("j"), "value")
    return means, cells.filter("i <= j")


def from_tidy(means: DataFrame, cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, t, mean, cov) back from the long tables, the upper triangle mirrored."""
    keys = [*(by or []), "t"]
    mean = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda r: r["value"]).alias("mean"))
    both = cells.unionByName(cells.filter("i < j").select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    cov = both.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "value"))), lambda r: r["value"]).alias("cov"))
    return mean.join(cov, keys)


def windows_of(grid: DataFrame, window: int, step: int, steps: int) -> DataFrame:
    """(t, offset, k, value): the full windows of a grid, a row per step of each."""
    n = max(0, (steps - window) // step + 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - window + 1) / step)).cast("int")
    last = F.least(F.lit(n - 1), F.floor(F.col("i") / step)).cast("int")
    rows = grid.withColumns({"a": first, "b": last}).filter("a <= b").withColumn("t", F.explode(F.sequence("a", "b")))
    return rows.select("t", (F.col("i") - F.col("t") * step).alias("offset"), "k", F.col("c").alias("value"))


def overlap_average(windows: DataFrame, step: int, steps: int) -> DataFrame:
    """(i, k, c): a series rebuilt from windows (t, offset, k, value), window t starting at t step, by averaging the values that cover a step; uncovered steps carry the last value, 0 at the start."""
    mean = windows.groupBy((F.col("t") * step + F.col("offset")).cast("int").alias("i"), "k").agg(F.avg("value").alias("m"))
    w = W.partitionBy("k").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    frame = windows.select("k").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return frame.join(mean, ["i", "k"], "left").select("i", "k", F.coalesce(F.last("m", True).over(w), F.lit(0.0)).alias("c"))


def adjacent(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each state with the one before it in its series as before_mean, before_cov: an equi-join on t, so no task sees all states. States are numbered without gaps."""
    before = states.select(*(by or []), (F.col("t") + 1).alias("t"), F.col("mean").alias("before_mean"), F.col("cov").alias("before_cov"))
    return states.join(before, [*(by or []), "t"])
