"""Block bootstraps, paired tests and multiplicity adjustment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def holm(rows: DataFrame, p: str, family: list[str]) -> DataFrame:
    """``rows`` with ``adjusted``: Holm's step-down p-values inside each family."""
    w = W.partitionBy(*family)
    ranked = rows.withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(p))})
    scaled = F.least(F.lit(1.0), (F.col("_n") - F.col("_r") + 1) * F.col(p))
    return ranked.withColumn("adjusted", F.max(scaled).over(w.orderBy("_r").rowsBetween(W.unboundedPreceding, 0))).drop("_n", "_r")


def block_means(by_origin: list[np.ndarray], block: int, draws: int, seed: int) -> np.ndarray:
    """Bootstrap of the pooled mean: each origin is refilled with blocks of its own, starts drawn one by one, cut to its length."""
    rng = np.random.default_rng(seed)
    total = sum(map(len, by_origin))
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in by_origin]
    sizes = [min(block, len(v)) for v in by_origin]
    blocks = [-(-len(v) // size) for v, size in zip(by_origin, sizes, strict=True)]
    # one array has the same stream as single draws in order of draw, origin, block
    ends = np.concatenate([np.full(b, len(v) - size + 1) for v, size, b in zip(by_origin, sizes, blocks, strict=True)])
    starts = iter(rng.integers(0, np.broadcast_to(ends, (draws, len(ends)))).T)
    out = np.zeros(draws)
    for v, c, size, b in zip(by_origin, sums, sizes, blocks, strict=True):
        for j in range(b):
            at = next(starts)
            out += c[at + min(size, len(v) - j * size)] - c[at]
    return out / total


def circular_means(v: np.ndarray, block: int, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Bootstrap of the mean by blocks that wrap around."""
    n = -(-len(v) // block)
    starts = rng.integers(0, len(v), size=(draws, n))
    at = (starts[..., None] + np.arange(block)) % len(v)
    return v[at.reshape(draws, -1)[:, : len(v)]].mean(1)


def _origins(g: pd.DataFrame, value: str) -> list[np.ndarray]:
    g = g.sort_values(["origin", "target_index"])
    return [x[value].to_numpy(float) for _, x in g.groupby("origin", sort=True)]


def bootstrap_means(rows: DataFrame, by: list[str], value: str, block: int = 3, draws: int = 10_000, seed: int = 20260714) -> DataFrame:
    """(by, mean, low, high, n): 95% intervals per group of rows (by, origin, target_index, value); a group is a task and its draws are one stream, seeded by its place in the order of the groups."""
    place = F.dense_rank().over(W.orderBy(*by)) - 1

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = _origins(g, value)
        m = block_means(v, block, draws, seed + 1009 * int(g["_k"].iloc[0]))
        low, high = np.quantile(m, [0.025, 0.975])
        return pd.DataFrame([[*g[by].iloc[0], float(np.concatenate(v).mean()), low, high, sum(map(len, v))]], columns=[*by, "mean", "low", "high", "n"])

    groups = rows.select(*by).distinct().withColumn("_k", place)
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    return rows.join(groups, by).groupBy(*by).applyInPandas(run, f"{kinds}mean double, low double, high double, n long")


def paired_inference(differences: DataFrame, by: list[str], family: list[str], block: int = 3, other_block: int = 6, draws: int = 10_000, seed: int = 20260714) -> DataFrame:
    """Per comparison (by) of rows (by, origin, target_index, difference): mean difference, percentile interval, interval with the other block length, one-sided p-value of the centred null, and Holm's adjustment inside each family."""
    place = F.dense_rank().over(W.orderBy(*by)) - 1

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = _origins(g, "difference")
        own = seed + 1009 * int(g["_k"].iloc[0])
        mean = float(np.concatenate(v).mean())
        a = np.quantile(block_means(v, block, draws, own), [0.025, 0.975])
        b = np.quantile(block_means(v, other_block, draws, own + 503), [0.025, 0.975])
        null = block_means([x - mean for x in v], block, draws, own + 997)
        p = (1 + int((null <= mean).sum())) / (draws + 1)
        return pd.DataFrame([[*g[by].iloc[0], mean, *a, *b, p, sum(map(len, v))]], columns=[*by, "mean", "low", "high", "other_low", "other_high", "p", "n"])

    groups = differences.select(*by).distinct().withColumn("_k", place)
    kinds = "".join(f"`{c}` {differences.schema[c].dataType.simpleString()}, " for c in by)
    out = differences.join(groups, by).groupBy(*by).applyInPandas(run, f"{kinds}mean double, low double, high double, other_low double, other_high double, p double, n long")
    return holm(out, "p", family)


def circular_intervals(rows: DataFrame, by: list[str], value: str, order: str, block: int = 7, draws: int = 2_000, seed: int = 20260731) -> DataFrame:
    """(by, mean, se, low, high, n) by circular blocks; each group has a stream of its own, seeded by its place."""
    place = F.dense_rank().over(W.orderBy(*by)) - 1

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values(order)[value].to_numpy(float)
        m = circular_means(v, block, draws, np.random.default_rng([seed, int(g["_k"].iloc[0])]))
        return pd.DataFrame([[*g[by].iloc[0], float(v.mean()), float(m.std(ddof=1)), *np.quantile(m, [0.025, 0.975]), len(v)]], columns=[*by, "mean", "se", "low", "high", "n"])

    groups = rows.select(*by).distinct().withColumn("_k", place)
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    return rows.join(groups, by).groupBy(*by).applyInPandas(run, f"{kinds}mean double, se double, low double, high double, n long")


def _draw(seed: int, by: list[str], *place: str):
    """A number from 0 to 2**32 - 1 for each replicate and block, from the MD5 of seed, group, replicate and block: the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in [*by, *place]))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _spread(means: DataFrame, by: list[str]) -> DataFrame:
    return means.groupBy(*by).agg(F.stddev_samp("m").alias("se"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def circular_intervals_at_scale(rows: DataFrame, by: list[str], value: str, order: str, block: int = 7, draws: int = 2_000, seed: int = 20260731) -> DataFrame:
    """The same by replicates instead of groups: block sums are windows, and every replicate is a hash-seeded draw of blocks joined to them, so replicates run in parallel and do not depend on the order of groups."""
    w = W.partitionBy(*by)
    numbered = rows.select(*by, F.col(value).alias("v"), (F.row_number().over(w.orderBy(order)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    shifted = numbered.select(*by, "n", "v", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("j"), "i").withColumn("start", F.pmod(F.col("i") - F.col("j"), F.col("n")))
    last = (F.col("n") - 1) % block + 1
    sums = shifted.groupBy(*by, "n", "start").agg(F.sum("v").alias("whole"), F.sum(F.when(F.col("j") < last, F.col("v"))).alias("cut"))
    blocks = F.ceil(F.col("n") / block)
    plan = numbered.select(*by, "n").distinct().withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("b", F.explode(F.sequence(F.lit(1), blocks)))
    plan = plan.withColumn("start", F.pmod(_draw(seed, by, "r", "b"), F.col("n"))).withColumn("final", F.col("b") == blocks)
    means = plan.join(sums, [*by, "n", "start"]).groupBy(*by, "n", "r").agg((F.sum(F.when(F.col("final"), F.col("cut")).otherwise(F.col("whole"))) / F.first("n")).alias("m"))
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).join(_spread(means, by), by)


def block_intervals_at_scale(rows: DataFrame, by: list[str], value: str, block: int = 3, draws: int = 10_000, seed: int = 20260714) -> DataFrame:
    """(by, mean, se, low, high, n): the pooled mean of rows (by, origin, target_index, value) by blocks that stay inside their origin and do not wrap; every origin is refilled to its own length. Replicates are hash-seeded and run in parallel."""
    w = W.partitionBy(*by, "origin")
    numbered = rows.select(*by, "origin", F.col(value).alias("v"), (F.row_number().over(w.orderBy("target_index")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    numbered = numbered.withColumn("size", F.least(F.col("n"), F.lit(block)))
    last = (F.col("n") - 1) % F.col("size") + 1
    shifted = numbered.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1))).withColumn("start", F.col("i") - F.col("j")).filter("start >= 0 and start <= n - size")
    sums = shifted.groupBy(*by, "origin", "start").agg(F.sum("v").alias("whole"), F.sum(F.when(F.col("j") < last, F.col("v"))).alias("cut"))
    blocks = F.ceil(F.col("n") / F.col("size"))
    plan = numbered.select(*by, "origin", "n", "size").distinct().withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("b", F.explode(F.sequence(F.lit(1), blocks)))
    plan = plan.withColumn("start", F.pmod(_draw(seed, by, "origin", "r", "b"), F.col("n") - F.col("size") + 1)).withColumn("final", F.col("b") == blocks)
    drawn = plan.join(sums, [*by, "origin", "start"]).groupBy(*by, "r").agg(F.sum(F.when(F.col("final"), F.col("cut")).otherwise(F.col("whole"))).alias("total"))
    totals = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    means = drawn.join(totals.select(*by, "n"), by).select(*by, (F.col("total") / F.col("n")).alias("m"))
    return totals.join(_spread(means, by), by)
