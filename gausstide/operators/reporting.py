"""Summary tables, processed tables and their checks. Relations in, relations out; writers are in ``sources.files``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gausstide.operators.evaluation import standard_error


def positive_integer(value, name: str) -> int:
    """``value`` if it is an int above 0; booleans, floats and text are refused."""
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be a positive integer")
    return value


def exactly_one(rows: DataFrame, **wanted) -> DataFrame:
    """The one row with these values; none or several are an error."""
    found = rows
    for c, v in wanted.items():
        found = found.filter(F.col(c).eqNullSafe(F.lit(v)))
    n = found.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if n == 0 else 'more than one'} row with {wanted}")
    return found


# ---- group tables


def group_summary(rows: DataFrame, by: list[str], values: list[str], replication: str, flagged: str | None = None) -> DataFrame:
    """Per group the number of replications, and of each value mean, standard error and mean -+ 1.96 errors; ``flagged``: share of rows above 0."""
    stats = [e for v in values for e in (F.avg(v).alias(f"{v}_mean"), standard_error(F.col(v)).alias(f"{v}_se"))]
    rate = [F.avg((F.col(flagged) > 0).cast("double")).alias("repair_rate")] if flagged else []
    out = rows.groupBy(*by).agg(F.count_distinct(replication).alias("n_replications"), *stats, *rate)
    bounds = {f"{v}_ci_{side}": F.col(f"{v}_mean") + sign * 1.96 * F.col(f"{v}_se") for v in values for side, sign in (("low", -1), ("high", 1))}
    return out.withColumns(bounds)


def group_labels(rows: DataFrame, by: list[str], label: str, order: str) -> DataFrame:
    """(by, label): the label of the first row by ``order``, nulls passed over."""
    return rows.filter(F.col(label).isNotNull()).groupBy(*by).agg(F.min_by(label, order).alias(label))


def available_methods(rows: DataFrame, methods: list[str], loss: str) -> DataFrame:
    """(method, place): the methods with a loss, in the order given."""
    place = F.array_position(F.array(*map(F.lit, methods)), F.col("method")).cast("int")
    return rows.filter(F.col("method").isin(methods)).groupBy("method").agg(F.count(loss).alias("n")).filter("n > 0").select("method", place.alias("place"))


def normalised_methods(rows: DataFrame, references: DataFrame, prefix: str, selected: str, reference: str, name: str, label: str) -> DataFrame:
    """Rows of other methods as they are, and those of ``selected`` with the selected reference ``reference`` renamed to ``name``; without any such row those of the table of references; all with ``dataset_label``."""
    others = rows.filter(~F.col("method").startswith(prefix))
    own = rows.filter((F.col("method") == selected) & (F.col("selected_reference") == reference)).withColumn("method", F.lit(name))
    spare = references.filter(F.col("reference") == reference).withColumns({"method": F.lit(name), "selected_reference": F.col("reference")}).drop("reference")
    none = own.agg((F.count("*") == 0).alias("none"))
    spare = spare.crossJoin(F.broadcast(none)).filter("none").drop("none")
    return others.unionByName(own).unionByName(spare, allowMissingColumns=True).withColumn("dataset_label", F.lit(label))


def run_metadata(rows: DataFrame, d: int, n_states: int, horizon: int) -> DataFrame:
    return rows.withColumns({"dimension": F.lit(d), "dimension_arg": F.lit(d), "n_matrices": F.lit(n_states), "h0": F.lit(horizon), "q_dimension": F.lit(d + d * (d + 1) // 2)})


def mean_cells(summary: DataFrame, by: list[str], mean: str, se: str, digits: int = 3) -> DataFrame:
    """``summary`` with ``cell``, "mean (error)" to so many digits, and ``best``: whether the mean is its group's least, but for rounding (relative 1e-9)."""
    least = F.min(mean).over(W.partitionBy(*by))
    cell = F.format_string(f"%.{digits}f (%.{digits}f)", F.round(mean, digits), F.round(se, digits))
    return summary.withColumns({"cell": F.when(F.col(se).isNotNull(), cell).otherwise(F.format_string(f"%.{digits}f", F.round(mean, digits))), "best": F.abs(F.col(mean) - least) <= 1e-9 * F.abs(least) + 1e-12})


def method_table(cells: DataFrame, by: list[str], methods: list[str]) -> DataFrame:
    """A row per group, a column per method; the best cells between asterisks."""
    shown = cells.withColumn("cell", F.when(F.col("best"), F.concat(F.lit("*"), F.col("cell"), F.lit("*"))).otherwise(F.col("cell")))
    return shown.groupBy(*by).pivot("method", methods).agg(F.first("cell"))


# ---- processed tables


def split_boundaries(splits: DataFrame, starts: DataFrame) -> DataFrame:
    """``splits`` with the start times of the last fitted, first validation, first test and last test state; ``starts``: (t, start)."""
    out = splits
    for name, at in (("fit_last", F.col("fit_end") - 1), ("val_first", F.col("fit_end")), ("test_first", F.col("val_end")), ("test_last", F.col("test_end") - 1)):
        named = starts.select(F.col("t").alias("_t"), F.col("start").alias(name))
        out = out.withColumn("_at", at).join(named, F.col("_at") == F.col("_t"), "left").drop("_at", "_t")
    return out


def source_times(sources: DataFrame, starts: DataFrame) -> DataFrame:
    """``sources`` with source_start and target_start."""
    a = starts.select(F.col("t").alias("source"), F.col("start").alias("source_start"))
    b = starts.select(F.col("t").alias("target"), F.col("start").alias("target_start"))
    return sources.join(a, "source", "left").join(b, "target", "left")


def partition_rows(n: int, fit_end: int, val_end: int, spark) -> DataFrame:
    """(part, first, last, n) of the three parts."""
    return spark.createDataFrame([("fit", 0, fit_end - 1, fit_end), ("validation", fit_end, val_end - 1, val_end - fit_end), ("test", val_end, n - 1, n - val_end)], "part string, first int, last int, n int")


def sensor_profile(grid: DataFrame, panels: DataFrame, fit_end: int) -> DataFrame:
    """(panel, rank, k, valid_share, median, center, scale, raw_scale) of the sensors of each panel over the steps before ``fit_end``: share and median of valid values (above 0), centre and scale (ddof 1) after the others became the median, and the scale of the valid ones."""
    valid = F.when((F.col("c") > 0) & ~F.isnan("c"), F.col("c"))
    fit = grid.filter(F.col("i") < fit_end).withColumn("v", valid)
    known = fit.groupBy("k").agg(F.avg(F.col("v").isNotNull().cast("double")).alias("valid_share"), F.median("v").alias("median"), F.stddev_samp("v").alias("raw_scale"))
    filled = fit.join(known, "k").groupBy("k").agg(F.avg(F.coalesce("v", "median")).alias("center"), F.stddev_samp(F.coalesce("v", "median")).alias("scale"))
    return panels.join(known, "k").join(filled, "k").select("panel", "rank", "k", "valid_share", "median", "center", "scale", "raw_scale")


def block_standardised(grid: DataFrame, window: int) -> DataFrame:
    """Each key centred and scaled (ddof 0) by its first max(window, 45%) steps; the count of steps comes from the grid itself."""
    steps = grid.agg((F.max("i") + 1).alias("n")).select(F.greatest(F.lit(window), F.floor(F.col("n") * 0.45)).alias("fit"))
    fit = grid.join(F.broadcast(steps), F.col("i") < F.col("fit")).groupBy("k").agg(F.avg("c").alias("center"), F.stddev_pop("c").alias("scale"))
    return grid.join(fit, "k").select("i", "k", ((F.col("c") - F.col("center")) / F.when(F.col("scale") >= 1e-8, F.col("scale")).otherwise(1.0)).alias("c"))


def forecast_snapshot(forecasts: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(method, rank, k, mean) in the keys' own units, and (method, row, col, correlation); ``profile``: (k, center, scale), keys in the order of the states' coordinates."""
    keys = profile.agg(F.array_sort(F.collect_list(F.struct("k", "center", "scale"))).alias("p"))
    both = forecasts.crossJoin(F.broadcast(keys))
    means = both.select("method", F.posexplode(F.zip_with("mean", "p", lambda m, p: F.struct(p["k"].alias("k"), (m * p["scale"] + p["center"]).alias("mean")))).alias("rank", "x"))
    d = F.size("mean")
    cells = both.select("method", "mean", "cov", F.posexplode("cov").alias("at", "c")).withColumns({"row": F.floor(F.col("at") / d).cast("int"), "col": (F.col("at") % d).cast("int")})
    spread = lambda i: F.greatest(F.get("cov", i * (d + 1)), F.lit(1e-12))
    rho = F.when(F.col("row") == F.col("col"), 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c") / F.sqrt(spread(F.col("row")) * spread(F.col("col"))))))
    return means.select("method", (F.col("rank") + 1).alias("rank"), "x.k", "x.mean"), cells.select("method", "row", "col", rho.alias("correlation"))


# ---- checks


def table_differences(own: DataFrame, other: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-10) -> DataFrame:
    """(problem, n): keys on one side only, and values further apart than ``tolerance`` (relative to 1 or the other's size); no rows if the tables agree."""
    a = own.select(*keys, F.struct(*values).alias("_a"))
    b = other.select(*keys, F.struct(*values).alias("_b"))
    both = a.join(b, keys, "full")
    numbers = {v for v, kind in own.select(*values).dtypes if kind in ("double", "float", "int", "bigint")}

    def far(v: str) -> Column:
        x, y = F.col(f"_a.{v}"), F.col(f"_b.{v}")
        apart = F.abs(x - y) > tolerance * F.greatest(F.lit(1.0), F.abs(y)) if v in numbers else ~x.eqNullSafe(y)
        return F.coalesce(apart, x.isNull() != y.isNull())

    here = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    found = both.agg(F.count_if(F.col("_b").isNull()).alias("only here"), F.count_if(F.col("_a").isNull()).alias("only there"), *(F.count_if(here & far(v)).alias(f"differs: {v}") for v in values))
    return found.unpivot([], found.columns, "problem", "n").filter("n > 0")


def displayed_differences(computed: DataFrame, displayed: DataFrame, keys: list[str], value: str, tolerance: float = 1.1e-3) -> DataFrame:
    """Rows (keys, computed, displayed, gap) whose displayed value is missing or further than ``tolerance`` from the computed one."""
    both = computed.select(*keys, F.col(value).alias("computed")).join(displayed.select(*keys, F.col(value).alias("displayed")), keys, "full")
    gap = F.abs(F.col("computed") - F.col("displayed"))
    return both.withColumn("gap", gap).filter(F.coalesce(gap > tolerance, F.lit(True)))


def protocol(settings: dict, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, value): settings as text, and of each table its rows and columns."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([(k, str(v)) for k, v in sorted(settings.items())], "name string, value string")
    for name, df in sorted(tables.items()):
        counted = df.agg(F.count("*").cast("string").alias("value")).select(F.lit(f"{name}.rows").alias("name"), "value")
        out = out.unionByName(counted).unionByName(spark.createDataFrame([(f"{name}.columns", ",".join(df.columns))], "name string, value string"))
    return out


def replicated_ratios(rows: DataFrame, by: list[str], replicate: list[str], value: str, method: str = "persistence") -> DataFrame:
    """(by, method, n_rep, ratio_mean, ratio_se): the value of each method over that of ``method`` in the same replicate, averaged over replicates; ``rows``: (by, replicate, method, value)."""
    base = rows.filter(F.col("method") == method).select(*by, *replicate, F.greatest(F.col(value), F.lit(1e-12)).alias("_base"))
    ratio = rows.join(base, [*by, *replicate]).withColumn("_ratio", F.col(value) / F.col("_base"))
    return ratio.groupBy(*by, "method").agg(F.count_distinct(*replicate).alias("n_rep"), F.avg("_ratio").alias("ratio_mean"), standard_error("_ratio").alias("ratio_se"))


def paired_decision(rows: DataFrame, by: list[str], replicate: list[str], value: str, target: str, comparator: str) -> DataFrame:
    """(by, mean_change, se, low, high, win_rate, n): percent change of the target method against the comparator in each replicate, with a normal 95 % interval and the share of replicates in which it is lower."""
    of = lambda m, name: rows.filter(F.col("method") == m).select(*by, *replicate, F.col(value).alias(name))
    change = of(target, "_a").join(of(comparator, "_b"), [*by, *replicate]).withColumn("_c", 100 * (F.col("_a") / F.greatest(F.col("_b"), F.lit(1e-14)) - 1))
    out = change.groupBy(*by).agg(F.avg("_c").alias("mean_change"), standard_error("_c").alias("se"), F.avg((F.col("_c") < 0).cast("double")).alias("win_rate"), F.count("*").alias("n"))
    return out.withColumns({"low": F.col("mean_change") - 1.96 * F.col("se"), "high": F.col("mean_change") + 1.96 * F.col("se")})
