"""Records to regular grids, cleaning, and key selection. All column expressions.

A grid is long: (i, k, c), the step number from 0, the key, and a double; every step has every key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gausstide.session import checkpointed

SECONDS = {"hour": 3600, "day": 86400}


def clean_records(records: DataFrame, ts: str, key: str) -> DataFrame:
    """(ts, k): unparsable or null times and null keys are dropped, keys become strings."""
    return records.select(F.col(ts).try_cast("timestamp").alias("ts"), F.col(key).cast("string").alias("k")).dropna()


def counts(records: DataFrame, ts: str, key: str, unit: str = "hour") -> DataFrame:
    """(ts, k, n): records per unit of time and key."""
    return clean_records(records, ts, key).groupBy(F.date_trunc(unit, "ts").alias("ts"), "k").agg(F.count("*").alias("n"))


def filled_grid(counted: DataFrame, start: str, steps: int, unit: str = "hour") -> DataFrame:
    """(i, k, c) with 0 where nothing was counted; the keys are those that occur."""
    i = F.expr(f"(unix_timestamp(ts) - unix_timestamp(timestamp'{start}')) div {SECONDS[unit]}").cast("int")
    seen = counted.select(i.alias("i"), "k", "n")
    frame = counted.sparkSession.range(steps).select(F.col("id").cast("int").alias("i")).crossJoin(seen.select("k").distinct())
    return frame.join(seen, ["i", "k"], "left").select("i", "k", F.coalesce("n", F.lit(0)).cast("double").alias("c"))


def clipped(grid: DataFrame) -> DataFrame:
    return grid.withColumn("c", F.greatest("c", F.lit(0.0)))


def varying_keys(grid: DataFrame, least: float = 1e-10) -> DataFrame:
    """The rows of keys that are not nearly constant."""
    keys = grid.groupBy("k").agg(F.stddev_pop("c").alias("s")).filter(F.col("s") > least).select("k")
    return grid.join(keys, "k", "left_semi")


def interpolated(grid: DataFrame) -> DataFrame:
    """Nulls become linear in i between neighbours, and the nearest value at the edges; steps that still lack a key are dropped."""
    w = W.partitionBy("k").orderBy("i")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col("c").isNotNull(), F.struct("i", "c"))
    grid = grid.withColumns({"p": F.last(known, True).over(back), "q": F.first(known, True).over(ahead)})
    line = F.col("p.c") + (F.col("q.c") - F.col("p.c")) * (F.col("i") - F.col("p.i")) / F.greatest(F.col("q.i") - F.col("p.i"), F.lit(1))
    grid = grid.select("i", "k", F.coalesce("c", line, "p.c", "q.c").alias("c"))
    whole = grid.groupBy("i").agg(F.count("c").alias("a"), F.count("*").alias("b")).filter("a = b").select("i")
    return grid.join(whole, "i", "left_semi")


def fit_profile(grid: DataFrame, fit_end: int, ddof: int = 0) -> DataFrame:
    """(k, center, scale) from steps before ``fit_end``; a scale that is null or below 1e-8 becomes 1."""
    spread = F.stddev_pop("c") if ddof == 0 else F.stddev_samp("c")
    profile = grid.filter(F.col("i") < fit_end).groupBy("k").agg(F.avg("c").alias("center"), spread.alias("scale"))
    return profile.withColumn("scale", F.when(F.col("scale") >= 1e-8, F.col("scale")).otherwise(1.0))


def standardised(grid: DataFrame, profile: DataFrame) -> DataFrame:
    return grid.join(profile, "k").select("i", "k", ((F.col("c") - F.col("center")) / F.col("scale")).alias("c"))


def destandardised(grid: DataFrame, profile: DataFrame) -> DataFrame:
    return grid.join(profile, "k").select("i", "k", (F.col("c") * F.col("scale") + F.col("center")).alias("c"))


def median_imputed(grid: DataFrame, fit_end: int) -> DataFrame:
    """Sensor cleaning: values that are null or not above 0 become the key's median of valid values before ``fit_end``; then centre and scale (ddof 1) of the filled fit steps. A scale of 0 is an error."""
    valid = F.when((F.col("c") > 0) & ~F.isnan("c"), F.col("c"))
    medians = grid.filter(F.col("i") < fit_end).groupBy("k").agg(F.median(valid).alias("m"))
    full = grid.withColumn("c", valid).join(medians, "k").select("i", "k", F.coalesce("c", "m").alias("c"))
    profile = full.filter(F.col("i") < fit_end).groupBy("k").agg(F.avg("c").alias("center"), F.stddev_samp("c").alias("scale"))
    scale = F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.raise_error(F.lit("a key has no spread in the fitting steps")).cast("double"))
    return full.join(profile, "k").select("i", "k", ((F.col("c") - F.col("center")) / scale).alias("c"))


def key_scores(grid: DataFrame, early_end: int) -> DataFrame:
    """(k, nonzero, spread, score, rank): share of steps above 0 times standard deviation before ``early_end``; ties by key, the larger first."""
    early = grid.filter(F.col("i") < early_end)
    scores = early.groupBy("k").agg(F.avg((F.col("c") > 0).cast("double")).alias("nonzero"), F.stddev_pop("c").alias("spread"))
    scores = scores.withColumn("score", F.col("nonzero") * F.col("spread"))
    return scores.withColumn("rank", F.row_number().over(W.orderBy(F.round("score", 9).desc_nulls_last(), F.col("k").desc())))


def top_keys(grid: DataFrame, early_end: int, n: int) -> DataFrame:
    """The grid of the ``n`` best keys; fewer keys than that is an error."""
    best = key_scores(grid, early_end).filter(F.col("rank") <= n).select("k", "rank")
    if best.count() < n:
        raise ValueError(f"fewer than {n} keys")
    return grid.join(best, "k")


def coverage(grid: DataFrame) -> DataFrame:
    return grid.groupBy("k").agg(F.avg((F.col("c") > 0).cast("double")).alias("coverage"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def added(*counted: DataFrame) -> DataFrame:
    """Sum of count tables by (ts, k), missing as 0."""
    return union_all(list(counted)).groupBy("ts", "k").agg(F.sum("n").alias("n"))


def wide(grid: DataFrame, keys: list[str]) -> DataFrame:
    return grid.groupBy("i").pivot("k", keys).agg(F.first("c")).na.fill(0.0)


def missing_steps(grid: DataFrame, steps: int) -> Column:
    return F.lit(steps) - grid.select("i").distinct().count()


def numbered(rows: DataFrame, order: list[str], name: str = "i", first: int = 0) -> DataFrame:
    """``rows`` with dense numbers in ascending ``order`` (nulls first), as int64 from ``first`` on, without a task that sees all rows: a range partition, a count per range, and running sums of the counts, which are as many as partitions. Ties are numbered in any order, so ``order`` should tell rows apart."""
    ranged = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order))  # numbers below depend on the partitions, so they are fixed first
    placed = ranged.withColumn("_at", F.monotonically_increasing_id())  # partition << 33 | place
    part = F.shiftright("_at", 33)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect())
    starts, before = [], first
    for p, n in sizes:
        starts.append((p, before))
        before += n
    table = rows.sparkSession.createDataFrame(starts or [(0, first)], "_part long, _before long")
    joined = placed.withColumn("_part", part).join(F.broadcast(table), "_part")  # a row per partition
    return joined.select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def eligible_keys(grid: DataFrame, fit_end: int, coverage: float = 0.995, spread: float = 1.0) -> DataFrame:
    """(k, coverage, spread): keys whose values before ``fit_end`` are valid (finite and above 0) in a share of at least ``coverage`` of the steps, with a standard deviation (ddof 0) of the valid ones above ``spread``."""
    valid = F.when((F.col("c") > 0) & (F.col("c") < float("inf")), F.col("c"))
    stats = grid.filter(F.col("i") < fit_end).groupBy("k").agg((F.count(valid) / F.count("*")).alias("coverage"), F.stddev_pop(valid).alias("spread"))
    return stats.filter((F.col("coverage") >= coverage) & (F.col("spread") > spread))


def whole_counts(grid: DataFrame, keys: list[str]) -> DataFrame:
    """``wide`` with whole numbers as int64; a value that is not whole to 1e-12 is an error."""
    bad = F.raise_error(F.lit("a count is not whole")).cast("long")
    cast = {k: F.when(F.abs(F.col(f"`{k}`") - F.rint(F.col(f"`{k}`"))) <= 1e-12, F.rint(F.col(f"`{k}`")).cast("long")).otherwise(bad) for k in keys}
    return wide(grid, keys).select("i", *(c.alias(k) for k, c in cast.items()))


def standardised_stream(grid: DataFrame, fit_end: int, metric: str, label: str, kind: str = "count") -> tuple[DataFrame, DataFrame]:
    """(grid, profile): keys that vary, gaps filled by interpolation, then values standardised by the steps before ``fit_end``; the profile (k, metric, label, kind, center, scale, fit_raw_end) tells how to go back."""
    clean = checkpointed(interpolated(varying_keys(grid)))
    profile = fit_profile(clean, fit_end)
    described = profile.select("k", F.lit(metric).alias("metric"), F.lit(label).alias("label"), F.lit(kind).alias("kind"), "center", "scale", F.lit(fit_end).alias("fit_raw_end"))
    return standardised(clean, profile), described


def destandardised_states(states: DataFrame, profile: DataFrame) -> DataFrame:
    """``states`` (mean, cov, ...) of standardised values in the units of the data: mean times scale plus center, D cov D with D the scales. ``profile``: (k, center, scale), a row per coordinate in the order of k."""
    row = profile.agg(F.array_sort(F.collect_list(F.struct("k", "center", "scale"))).alias("_p"))  # as many as coordinates
    both = states.crossJoin(F.broadcast(row))
    d = F.size("_p")
    scale = lambda i: F.get("_p", i)["scale"]
    mean = F.transform("mean", lambda v, i: v * scale(i) + F.get("_p", i)["center"])
    cov = F.transform("cov", lambda v, p: v * scale(F.floor(p / d).cast("int")) * scale(p % d))
    return both.withColumns({"mean": mean, "cov": cov}).drop("_p")
