"""Chronological splits and evaluation sources; every bound is exclusive at its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rolling_origins(n: int, most: int = 6) -> list[tuple[int, int, int, int]]:
    """(origin, fit_end, val_end, test_end): fit 35% (60 at least), validation 15% (24), test blocks of 12% (24) that follow each other."""
    fit, val, block = max(60, int(0.35 * n)), max(24, int(0.15 * n)), max(24, int(0.12 * n))
    out = []
    while fit + val + 2 < n and len(out) < most:
        end = min(fit + val + block, n)
        if end - fit - val >= 2:
            out.append((len(out), fit, fit + val, end))
        fit += block
    return out


def three_way(n: int) -> tuple[int, int, int]:
    """45 / 20 / 35 percent, with room for each part."""
    fit = max(20, int(0.45 * n))
    return fit, min(n - 2, max(fit + 5, int(0.65 * n))), n


def floor_split(n: int, fit: float = 0.6, val: float = 0.2) -> tuple[int, int, int]:
    return int(fit * n), int((fit + val) * n + 1e-9), n


def split_table(spark: SparkSession, splits: list[tuple[int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame(splits, "origin int, fit_end int, val_end int, test_end int")


def _sources(splits: DataFrame, horizons: list[int], low, high) -> DataFrame:
    rows = splits.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    rows = rows.withColumns({"low": low, "high": high}).filter("low < high")
    return rows.select("origin", "horizon", F.explode(F.sequence("low", F.col("high") - 1)).alias("source")).withColumn("target", F.col("source") + F.col("horizon"))


def test_sources(splits: DataFrame, horizons: list[int]) -> DataFrame:
    """(origin, horizon, source, target): every target of the test block once, looked back by the horizon."""
    return _sources(splits, horizons, F.col("val_end") - F.col("horizon"), F.col("test_end") - F.col("horizon"))


def validation_sources(splits: DataFrame, horizons: list[int], longest: int) -> DataFrame:
    """Sources whose targets are validation states and whose trailing window of ``longest`` states exists."""
    return _sources(splits, horizons, F.greatest(F.col("fit_end") - F.col("horizon"), F.lit(longest - 1)), F.col("val_end") - F.col("horizon"))


def block_sources(splits: DataFrame, horizons: list[int]) -> DataFrame:
    """Sources inside the test block, without looking back: [val_end, test_end - h)."""
    return _sources(splits, horizons, F.col("val_end"), F.col("test_end") - F.col("horizon"))


def common_sources(splits: DataFrame, horizons: list[int], length: int) -> DataFrame:
    """As many sources for every horizon: [max(length - 1, val_end), test_end - longest horizon)."""
    return _sources(splits, horizons, F.greatest(F.lit(length - 1), F.col("val_end")), F.col("test_end") - max(horizons))


def month_splits(windows: DataFrame, months: list[str]) -> DataFrame:
    """(month, fit_end, val_end, test_end) from windows (t, start, end): states that end by two months before, that end by, and that start before the end of each month."""
    spark = windows.sparkSession
    m = spark.createDataFrame([(x,) for x in months], "month string").withColumn("first", F.to_date(F.concat("month", F.lit("-01"))).cast("timestamp"))
    upto = lambda at: F.sum((F.col("end") <= at).cast("int"))
    both = windows.crossJoin(F.broadcast(m))
    return both.groupBy("month").agg(upto(F.add_months("first", -2).cast("timestamp")).cast("long").alias("fit_end"), upto(F.col("first")).cast("long").alias("val_end"), F.sum((F.col("start") < F.add_months("first", 1).cast("timestamp")).cast("int")).cast("long").alias("test_end"))


def paired(states: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources with the state at the source and at the target, by two equi-joins on t."""
    a = states.select(F.col("t").alias("source"), F.col("mean").alias("source_mean"), F.col("cov").alias("source_cov"))
    b = states.select(F.col("t").alias("target"), F.col("mean").alias("target_mean"), F.col("cov").alias("target_cov"))
    return sources.join(a, "source").join(b, "target")
