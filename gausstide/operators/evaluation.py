"""Losses, evaluation panels and the tables around them, as relations and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gausstide.functions import linalg as la
from gausstide.operators import local_chart, raw_model, scoring
from gausstide.operators.splits import split_table, test_sources

RIDGES = [1e-6, 1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0]
WINDOWS = [24, 48, 72]
METHODS = ["persistence", "raw_var", "euclidean", "cholesky", "log_euclidean", "transport_fixed", "transport_local"]
PANEL = "origin int, fit_end int, val_end int, test_end int, horizon int, source_index int, target_index int, method string, window_length double, ridge double, raw_rmse double, w2 double, min_pred_eig double, reference_residual double, reference_refreshed boolean, reference_fallback boolean"
PANEL_COLUMNS = [c.split()[0] for c in PANEL.split(", ")]
KEY = ["origin", "horizon", "target_index", "method"]


# ---- losses as columns


def mean_rmse(pred: str, true: str) -> Column:
    return F.sqrt(la.squared_distance(pred, true) / F.size(true))


def gaussian_w2(pred_mean: str, pred_cov: str, true_mean: str, true_cov: str) -> Column:
    """Struct of total, mean and covariance parts of the squared Wasserstein distance."""
    mean, cov = la.squared_distance(pred_mean, true_mean), la.call("bures", pred_cov, true_cov)
    return F.struct((mean + cov).alias("total"), mean.alias("mean_part"), cov.alias("cov_part"))


def loss_summary(losses: DataFrame, by: list[str], value: str = "loss") -> DataFrame:
    """mean, median, q90 (exact, linear), count and standard error; NaN counts as missing."""
    v = F.when(~F.isnan(value), F.col(value))
    return losses.groupBy(*by).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.percentile(v, F.lit(0.9)).alias("q90"), F.count(v).alias("n"), standard_error(v).alias("se"))


def standard_error(v) -> Column:
    return F.when(F.count(v) > 1, F.stddev_samp(v) / F.sqrt(F.count(v)))


def persistence(pairs: DataFrame) -> DataFrame:
    """Losses of predicting the source state: raw_rmse and the mean part, native."""
    return pairs.select("origin", "horizon", "source", "target", mean_rmse("source_mean", "target_mean").alias("raw_rmse"), la.squared_distance("source_mean", "target_mean").alias("mean_w2"))


# ---- the panel


def target_panel(states: DataFrame, splits: list[tuple], horizons: list[int], methods: list[str], raw: DataFrame | None = None, window: int = 0, step: int = 0, diagonal: bool = False, d: int = 2, errors: bool = False) -> DataFrame:
    """The fact table: a row per (origin, horizon, target, method), all of it relations.

    Persistence and the fixed charts come from ``scoring.fixed_panel``, the local chart from ``local_chart``, the raw
    rows ``raw`` (i, x) from ``raw_model``. ``states``: (t, mean, cov) numbered without gaps. The local reference is
    solved anew at every source, so reference_refreshed is true and reference_fallback false on its rows, null on others.
    A forecast of the local chart or the raw rows that fails has no losses; ``errors`` adds the column that tells why.
    """
    spark = states.sparkSession
    table = split_table(spark, [s for s in splits if s[3] > s[2]])
    states = states.select("t", "mean", "cov")
    parts = []
    fixed = [m for m in methods if m not in ("transport_local", "raw_var")]
    none = {"window_length": "double", "ridge": "double", "reference_residual": "double", "reference_refreshed": "boolean", "reference_fallback": "boolean", "error": "string"}

    def shaped(rows: DataFrame, **more) -> DataFrame:
        names = {"source": "source_index", "target": "target_index", "low": "min_pred_eig"}
        rows = rows.withColumnsRenamed({k: v for k, v in names.items() if k in rows.columns}).withColumns(more)
        rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in none.items() if c not in rows.columns})
        return rows.select(*(F.col(c).cast("double") if c == "window_length" else c for c in PANEL_COLUMNS), "error")

    if fixed:
        parts.append(shaped(scoring.fixed_panel(states, table, horizons, fixed, d, RIDGES, diagonal)))
    if "transport_local" in methods:
        scored = local_chart.scored_forecasts(states, table, horizons, d, WINDOWS, RIDGES)
        rows = local_chart.local_panel(scored, table, horizons, max(WINDOWS))
        parts.append(shaped(rows, method=F.lit("transport_local"), reference_refreshed=F.lit(True), reference_fallback=F.lit(False)))
    if "raw_var" in methods:
        parts.append(shaped(raw_model.raw_panel(raw, states, table, horizons, RIDGES, d, window, step), method=F.lit("raw_var")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out if errors else out.drop("error")


def local_tuning(states: DataFrame, splits: list[tuple], horizons: list[int], d: int = 2) -> DataFrame:
    """The tuning table of the local chart, see ``local_chart.tuning_table``."""
    table = split_table(states.sparkSession, splits)
    return local_chart.tuning_table(local_chart.scored_forecasts(states.select("t", "mean", "cov"), table, horizons, d, WINDOWS, RIDGES), table, horizons, max(WINDOWS))


def panel_problems(panel: DataFrame, methods: list[str]) -> DataFrame:
    """(problem, n): what breaks a complete paired panel; no rows if it is complete."""
    count = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    wanted = panel.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    targets = panel.select("horizon", "target_index").distinct()
    parts = [
        count(panel.groupBy(*KEY).count().filter("count > 1"), "duplicate key"),
        count(panel.groupBy("horizon", "target_index", "method").agg(F.count_distinct("origin").alias("c")).filter("c > 1"), "target in two origins"),
        count(panel.select("method").distinct().join(wanted, "method", "left_anti"), "unknown method"),
        count(wanted.crossJoin(targets).join(panel.select("method", "horizon", "target_index").distinct(), ["method", "horizon", "target_index"], "left_anti"), "missing target"),
        count(panel.filter("raw_rmse is null or isnan(raw_rmse) or w2 is null or isnan(w2) or abs(w2) = double('inf')"), "loss not finite"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("n > 0")


def state_problems(states: DataFrame, d: int) -> DataFrame:
    """(problem, n): states whose mean or covariance has another size than ``d`` wants, a value that is not finite, or a covariance that is not symmetric (to 1e-10 of its cells, 1e-12 at least) or not positive definite; no rows if all are sound. Each state counts once, under the first that applies."""
    finite = lambda c: F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    at = F.sequence(F.lit(0), F.lit(d * d - 1))
    mirror = lambda p: F.get("cov", (p % d) * d + F.floor(p / d).cast("int"))
    even = F.forall(at, lambda p: F.abs(F.get("cov", p) - mirror(p)) <= F.lit(1e-12) + 1e-10 * F.abs(mirror(p)))
    sized = F.coalesce((F.size("mean") == d) & (F.size("cov") == d * d), F.lit(False))
    low = F.when(sized & finite("mean") & finite("cov"), scoring.geometry(d).smallest("cov"))
    problem = F.when(~sized, "size").when(~(finite("mean") & finite("cov")), "not finite").when(~even, "not symmetric").when(low <= 0, "not definite")
    return states.select(problem.alias("problem")).filter("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))


# ---- tables around the panel


def differences(panel: DataFrame, value: str, target: str, comparator: str) -> DataFrame:
    """(origin, horizon, target_index, difference): target method minus comparator on the same targets."""
    wide = panel.filter(F.col("method").isin(target, comparator)).groupBy("origin", "horizon", "target_index").pivot("method", [target, comparator]).agg(F.first(value))
    return wide.select("origin", "horizon", "target_index", (F.col(f"`{target}`") - F.col(f"`{comparator}`")).alias("difference"))


def all_differences(panel: DataFrame, values: list[str], pairs: list[tuple[str, str, str]]) -> DataFrame:
    """``differences`` of each value (metric) for each (family, target, comparator) of ``pairs``; the panel is read once."""
    methods = sorted({m for _, *both in pairs for m in both})
    of_metric = F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).alias("value")) for v in values))).alias("m")
    wide = panel.select("origin", "horizon", "target_index", "method", of_metric).groupBy("origin", "horizon", "target_index", "m.metric").pivot("method", methods).agg(F.first("m.value"))
    each = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(t).alias("target"), F.lit(c).alias("comparator"), (F.col(f"`{t}`") - F.col(f"`{c}`")).alias("difference")) for f, t, c in pairs))
    return wide.select("origin", "horizon", "target_index", "metric", F.inline(each))


def best_baseline(summary: DataFrame, by: list[str], baselines: list[str], value: str = "mean") -> DataFrame:
    """(by, best_method, best): the baseline of least loss, ties in the order given."""
    order = F.array_position(F.array(*map(F.lit, baselines)), F.col("method"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(value, order))
    return summary.filter(F.col("method").isin(baselines)).withColumn("r", rank).filter("r = 1").select(*by, F.col("method").alias("best_method"), F.col(value).alias("best"))


def margins(summary: DataFrame, by: list[str], target: str, baselines: list[str]) -> DataFrame:
    """(by, best_method, best, target_mean, margin, margin_fraction)."""
    own = summary.filter(F.col("method") == target).select(*by, F.col("mean").alias("target_mean"))
    out = own.join(best_baseline(summary, by, baselines), by, "left").withColumn("margin", F.col("best") - F.col("target_mean"))
    return out.withColumn("margin_fraction", F.col("margin") / F.greatest(F.abs("best"), F.lit(1e-12)))


def ratio_to(losses: DataFrame, by: list[str], method: str = "persistence", floor: float = 1e-12) -> DataFrame:
    base = losses.filter(F.col("method") == method).select(*by, F.col("loss").alias("base"))
    return losses.join(base, by).withColumn("ratio", F.col("loss") / F.greatest("base", F.lit(floor)))


def one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that fails where a key repeats on either side."""
    for side in (left, right):
        if side.groupBy(*on).count().filter("count > 1").take(1):
            raise ValueError("keys repeat")
    return left.join(right, on, "left")


def shrinkage_choice(conditions: DataFrame, cap: float = 100.0) -> DataFrame:
    """(shrinkage): the least value whose worst 90% quantile of condition numbers over panels is within ``cap``, else the least bad; rows (shrinkage, panel, condition)."""
    worst = conditions.groupBy("shrinkage", "panel").agg(F.percentile("condition", F.lit(0.9)).alias("q")).groupBy("shrinkage").agg(F.max("q").alias("worst"))
    return worst.agg(F.coalesce(F.min(F.when(F.col("worst") <= cap, F.col("shrinkage"))), F.min_by("shrinkage", F.struct("worst", "shrinkage"))).alias("shrinkage"))


def nearest_members(points: DataFrame, centres: DataFrame, n: int) -> DataFrame:
    """(cluster, id, rank): of the members of each cluster, points (id, cluster, x), the ``n`` nearest to its centre (cluster, x), ties by id. A cluster with fewer members is an error, so panels are disjoint and full."""
    both = points.join(F.broadcast(centres.withColumnRenamed("x", "centre")), "cluster")  # a row per cluster
    w = W.partitionBy("cluster")
    rank = F.row_number().over(w.orderBy(F.round(la.squared_distance("x", "centre"), 9), "id"))
    few = F.raise_error(F.concat(F.lit("cluster "), F.col("cluster").cast("string"), F.lit(f" has fewer than {n} members"))).cast("int")
    ranked = both.withColumns({"rank": rank, "_n": F.count("*").over(w)}).filter(F.col("rank") <= n)
    return ranked.select("cluster", "id", F.when(F.col("_n") >= n, F.col("rank")).otherwise(few).alias("rank"))


def spatial_panels(points: DataFrame, k: int, n: int, seed: int, eligible: DataFrame | None = None) -> DataFrame:
    """``k`` panels of ``n`` points each: k-means (MLlib, so clusters differ from other seedings) of points (id, x array), then of each cluster the members nearest to its centre. ``eligible`` (id) keeps only those points; fewer than k n of them are an error, and so is a cluster of fewer than ``n``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = points if eligible is None else points.join(eligible.select("id"), "id", "left_semi")
    if points.limit(k * n).count() < k * n:
        raise ValueError(f"fewer than {k * n} usable points")
    rows = points.select("id", "x", array_to_vector("x").alias("features"))
    model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(rows)
    centres = points.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, x array<double>")
    return nearest_members(model.transform(rows).select("id", "x", "cluster"), centres, n)


def evaluation_origins(splits: DataFrame, horizons: list[int]) -> DataFrame:
    return test_sources(splits, horizons)
