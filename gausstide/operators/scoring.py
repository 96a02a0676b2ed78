"""Forecast evaluation as relations.

States are encoded once per chart, their coordinates are rows, diagonal models are grouped sums over all (panel, method,
ridge) at once, forecasts are joins, losses are columns, and the choice of a ridge is a ranked window. Nothing is
collected, so panels, methods, ridges and horizons are axes of one plan. The geometry of d = 2 is closed-form
expressions; other dimensions go through Arrow UDFs.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gausstide.functions import closed_forms as cf
from gausstide.functions import linalg as la
from gausstide.operators import autoregression as ar
from gausstide.operators import charts, references
from gausstide.operators.states import moments
from gausstide.session import checkpointed

RIDGES = [1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0]


class Geometry(NamedTuple):
    bures: object
    log_score: object
    smallest: object


def geometry(d: int) -> Geometry:
    if d == 2:
        return Geometry(cf.bures, cf.log_score, cf.smallest_eigenvalue)
    udf = lambda name: lambda *c: la.call(name, *c)
    return Geometry(udf("bures"), udf("log_score"), udf("smallest_eigenvalue"))


def coordinates(states: DataFrame, references: DataFrame, methods: list[str], by: list[str]) -> DataFrame:
    """(by, method, t, k, z): each state once in each chart, a row per coordinate."""
    return charts.encode(states, references, methods, by).select(*by, "method", "t", F.posexplode("z").alias("k", "z"))


def _decoded(forecast: DataFrame, references: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """States (by, keys, source, mean, cov) from coordinate rows (by, keys, t, k, z); ``keys`` holds method."""
    whole = forecast.groupBy(*by, *keys, "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "z"))), lambda r: r["z"]).alias("z"))
    rest = [c for c in keys if c != "method"]
    return charts.decode(whole, references, [*by, *rest]).withColumnRenamed("t", "source").drop("repaired", "low")


def chart_forecasts(coords: DataFrame, model: DataFrame, references: DataFrame, sources: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """(by, keys, source, mean, cov): forecasts from each source (by, horizon, source) under the models (by, keys, k, mu, slope); keys hold method and horizon."""
    start = coords.withColumnRenamed("t", "source").join(sources.select(*by, "horizon", "source"), [*by, "source"])
    on = [*by, *(c for c in keys if c in ("method", "horizon")), "k"]
    z = start.join(model, on if "horizon" in model.columns else [c for c in on if c != "horizon"])
    z = z.select(*by, *keys, F.col("source").alias("t"), "k", (F.col("mu") + F.pow("slope", F.col("horizon").cast("double")) * (F.col("z") - F.col("mu"))).alias("z"))
    with_keys = references.join(z.select(*by, *(c for c in keys if c != "method")).distinct(), by)
    return _decoded(z, with_keys, by, keys)


def persistence_forecasts(states: DataFrame, sources: DataFrame, by: list[str]) -> DataFrame:
    """(by, method, horizon, source, mean, cov): the source state itself."""
    return sources.select(*by, "horizon", "source").join(states.select(*by, F.col("t").alias("source"), "mean", "cov"), [*by, "source"]).withColumn("method", F.lit("persistence"))


def losses(forecasts: DataFrame, states: DataFrame, by: list[str], d: int) -> DataFrame:
    """``forecasts`` with the losses at source + horizon: mean_part, cov_part, w2, raw_rmse, log_score, low (the smallest predicted eigenvalue). Sources whose target lies past the end have no row."""
    g = geometry(d)
    truth = states.select(*by, F.col("t").alias("target"), F.col("mean").alias("true_mean"), F.col("cov").alias("true_cov"))
    both = forecasts.withColumn("target", F.col("source") + F.col("horizon")).join(truth, [*by, "target"])
    parts = both.withColumns({"mean_part": la.squared_distance("mean", "true_mean"), "cov_part": g.bures("cov", "true_cov"), "log_score": g.log_score("mean", "cov", "true_mean", "true_cov"), "low": g.smallest("cov")})
    return parts.withColumns({"w2": F.col("mean_part") + F.col("cov_part"), "raw_rmse": F.sqrt(F.col("mean_part") / d)}).drop("true_mean", "true_cov")


def ranges(splits: DataFrame, horizons: list[int], low: Column, high: Column) -> DataFrame:
    """(columns of splits, horizon, source) with sources in [low, high), which may name the horizon."""
    rows = splits.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumns({"_low": low, "_high": high}).filter("_low < _high")
    return rows.withColumn("source", F.explode(F.sequence("_low", F.col("_high") - 1))).drop("_low", "_high")


def score_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median and 90% quantile of the three losses, the number of pairs, and the smallest predicted eigenvalue."""
    stats = [f(F.col(c)).alias(f"{c}_{name}") for c in ("w2", "log_score", "raw_rmse") for name, f in (("mean", F.avg), ("median", F.median), ("q90", lambda c: F.percentile(c, F.lit(0.9))))]
    return rows.groupBy(*by).agg(*stats, F.count("*").alias("n_pairs"), F.min("low").alias("min_pred_eig"))


def best(rows: DataFrame, by: list[str], loss: str, order: list, digits: int | None = 9) -> DataFrame:
    """The row of least ``loss`` (rounded to ``digits``, or as it is) in each group, the first by ``order`` of equal ones. Rows without a finite loss cannot win."""
    finite = F.when(F.abs(loss) < float("inf"), F.col(loss) if digits is None else F.round(loss, digits))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(finite.asc_nulls_last(), *order))
    return rows.withColumn("_r", rank).filter((F.col("_r") == 1) & finite.isNotNull()).drop("_r")


def panel_choice(states: DataFrame, coords: DataFrame, references: DataFrame, by: list[str], d: int, fit_end: int, val_end: int, horizons: list[int], ridges: list[float] = RIDGES) -> DataFrame:
    """(by, method, horizon, ridge, loss): for each panel, chart and horizon the ridge of least mean W2 over validation targets, models fitted before ``fit_end``; equal losses: the smallest ridge."""
    gridded = coords.withColumn("ridge", F.explode(F.array(*map(F.lit, ridges))))
    model = ar.fit_diagonal(gridded, fit_end, F.col("ridge"), [*by, "method", "ridge", "k"])
    sources = ranges(coords.select(*by).distinct(), horizons, F.lit(fit_end), F.lit(val_end) - F.col("horizon"))
    made = chart_forecasts(coords, model, references, sources, by, ["method", "horizon", "ridge"])
    scores = losses(made, states, by, d).groupBy(*by, "method", "horizon", "ridge").agg(F.avg("w2").alias("loss"))
    return best(scores, [*by, "method", "horizon"], "loss", ["ridge"])


def panel_forecasts(states: DataFrame, coords: DataFrame, references: DataFrame, choice: DataFrame, by: list[str], val_end: int, stop: int, horizons: list[int]) -> DataFrame:
    """(by, method, horizon, source, mean, cov) on the test sources [val_end, stop - horizon): each chart with its chosen ridge, fitted before ``val_end``, and persistence."""
    gridded = coords.join(choice.select(*by, "method", "horizon", "ridge"), [*by, "method"])
    model = ar.fit_diagonal(gridded, val_end, F.col("ridge"), [*by, "method", "horizon", "ridge", "k"])
    sources = ranges(coords.select(*by).distinct(), horizons, F.lit(val_end), F.lit(stop) - F.col("horizon"))
    made = chart_forecasts(coords, model, references, sources, by, ["method", "horizon"])
    return made.unionByName(persistence_forecasts(states, sources, by).select(*made.columns))


def block_likelihood(forecasts: DataFrame, raw: DataFrame, by: list[str], window: int, step: int, d: int = 2) -> DataFrame:
    """``forecasts`` with raw_nll: the mean negative log likelihood of the raw vectors (by, i, x) of the target's window, [target step, target step + window), under the predicted state with a floor of 1e-7.

    The vectors of a block enter by their number, mean and scatter, formed once for each target: the mean of the
    likelihood is that of one Gaussian under another, so rows never meet forecasts.
    """
    target = F.col("source") + F.col("horizon")
    wanted = forecasts.select(*by, target.alias("target")).distinct()
    rows = wanted.withColumn("i", F.explode(F.sequence(F.col("target") * step, F.col("target") * step + window - 1))).join(raw, [*by, "i"])
    block = moments(rows.select(*by, "target", "x"), [*by, "target"])
    scatter = F.transform("cov", lambda c: F.coalesce(c * (F.col("n") - 1) / F.col("n"), F.lit(0.0)))  # of one row: none
    block = block.select(*by, "target", F.col("mean").alias("block_mean"), scatter.alias("block_cov"))
    floored = cf.floored("cov", la.FLOOR) if d == 2 else la.state_floor("cov", la.FLOOR)
    both = forecasts.withColumns({"target": target, "floored": floored}).join(block, [*by, "target"])
    score = cf.log_score if d == 2 else lambda *c: la.call("gaussian_nll", *c)
    return both.withColumn("raw_nll", score("mean", "floored", "block_mean", "block_cov")).select(*forecasts.columns, "raw_nll")


# ---- the fixed-chart part of the target panel


def fixed_panel(states: DataFrame, splits: DataFrame, horizons: list[int], methods: list[str], d: int, ridges: list[float], diagonal: bool = False, first: int = 250) -> DataFrame:
    """(origin, fit_end, val_end, test_end, horizon, method, ridge, source, the losses): forecasts of each test target of each origin by a full (or diagonal) autoregression in each fixed chart, and by persistence.

    The reference is the mean and the barycenter of the states before fit_end (of the ``first`` ones at most, as the
    method has it). The ridge is the one of least mean RMSE on the validation targets under models fitted before fit_end,
    the smallest of equal ones; forecasts come from models fitted before val_end.
    """
    by, charts_ = ["origin", "method"], [m for m in methods if m != "persistence"]
    states = states.select("t", "mean", "cov")
    every = checkpointed(states.crossJoin(F.broadcast(splits)))  # a row of splits per origin
    sources = ranges(splits, horizons, F.col("val_end") - F.col("horizon"), F.col("test_end") - F.col("horizon"))
    plain = every.select("origin", "t", "mean", "cov")
    parts = []
    if charts_:
        refs = checkpointed(references.group_references(every.filter(F.col("t") < F.col("fit_end")), ["origin"], first=first))
        z = checkpointed(charts.encode(plain, refs, charts_, ["origin"]))
        ends = splits.select("origin", "fit_end", "val_end")

        def powers(end: str, ridge: DataFrame) -> DataFrame:
            fit = z.join(F.broadcast(ends), "origin").filter(F.col("t") < F.col(end)).select(*by, "t", "z")
            sums = ar.gram(fit, by)
            if diagonal:
                q = F.size("mu")
                kept = F.transform("g", lambda v, p: F.when(F.pmod(p % (2 * q), q) == F.floor(p / (2 * q)), v).otherwise(0.0))
                sums = sums.withColumn("g", kept)
            both = sums.join(ridge, [c for c in ridge.columns if c in by])
            return both.select(*by, "horizon", "ridge", "mu", ar.propagator("g", (F.col("n") - 1) * F.col("ridge"), "horizon").alias("power"))

        def forecast(at: DataFrame, models: DataFrame) -> DataFrame:
            start = z.withColumnRenamed("t", "source").join(at.select("origin", "horizon", "source"), ["origin", "source"])
            return start.join(models, [*by, "horizon"]).select(*by, "horizon", "ridge", "source", ar.propagated("z", "mu", "power").alias("z"))

        grid = splits.select("origin").withColumns({"horizon": F.explode(F.array(*map(F.lit, horizons)))}).withColumn("ridge", F.explode(F.array(*map(F.lit, ridges))))
        val = ranges(splits, horizons, F.greatest(F.col("fit_end") - F.col("horizon"), F.lit(0)), F.col("val_end") - F.col("horizon"))
        tried = forecast(val, powers("fit_end", grid)).join(refs.select("origin", "ref_mean"), "origin")
        centred = F.col("method").isin([m for m in charts_ if charts.CHARTS[m].centred])
        mean = F.when(centred, F.zip_with(F.slice("z", 1, d), "ref_mean", lambda a, b: a + b)).otherwise(F.slice("z", 1, d))
        truth = states.select(F.col("t").alias("target"), F.col("mean").alias("true_mean"))
        tried = tried.withColumns({"made": mean, "target": F.col("source") + F.col("horizon")}).join(truth, "target")
        scores = tried.groupBy(*by, "horizon", "ridge").agg(F.avg(F.sqrt(la.squared_distance("made", "true_mean") / d)).alias("loss"))
        choice = checkpointed(best(scores, [*by, "horizon"], "loss", ["ridge"]).drop("loss"))
        made = forecast(sources, powers("val_end", choice))
        keys = ["origin", "horizon", "ridge"]
        # decode has one row a state: the source takes the place of t
        parts.append(charts.decode(made.withColumnRenamed("source", "t"), refs.join(made.select(*keys).distinct(), "origin"), keys).select(*by, "horizon", "ridge", F.col("t").alias("source"), "mean", "cov"))
    if "persistence" in methods:
        still = persistence_forecasts(plain, sources, ["origin"]).withColumn("ridge", F.lit(None).cast("double"))
        parts.append(still.select("origin", "method", "horizon", "ridge", "source", "mean", "cov"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return losses(out, plain, ["origin"], d).join(splits, "origin")


# ---- raw rows


def raw_window_forecasts(grid: DataFrame, model: DataFrame, sources: DataFrame, window: int, step: int) -> DataFrame:
    """(origin, horizon, source, mean, cov): states of the target windows, whose rows before the source's end are known and whose other rows follow from the last known one under the models (origin, k, intercept, slope).

    Windows of fewer than two rows have no state. 1e-8 is added to the diagonal (d = 2: and eigenvalues are floored there).
    """
    rows = sources.withColumns({"end": F.col("source") * step + window, "i": F.explode(F.sequence((F.col("source") + F.col("horizon")) * step, (F.col("source") + F.col("horizon")) * step + window - 1))})
    lead = F.greatest(F.col("i") - F.col("end") + 1, F.lit(0))
    rows = rows.withColumns({"lead": lead, "known": F.least("i", F.col("end") - 1)}).join(grid.select(F.col("i").alias("known"), "k", "c"), "known").join(model, ["origin", "k"])
    power = F.pow("slope", F.col("lead").cast("double"))
    steps = F.when(F.abs(1 - F.col("slope")) < 1e-12, F.col("lead").cast("double")).otherwise((1 - power) / (1 - F.col("slope")))
    rows = rows.withColumn("c", F.when(F.col("lead") > 0, power * F.col("c") + F.col("intercept") * steps).otherwise(F.col("c")))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda r: r["c"])
    vectors = rows.groupBy("origin", "horizon", "source", "i").agg(vector.alias("x"))
    d = F.size("x")
    cells = vectors.select("origin", "horizon", "source", F.posexplode("x").alias("p", "a"), "x").select("origin", "horizon", "source", "p", "a", F.posexplode("x").alias("q", "b"))
    moments = cells.groupBy("origin", "horizon", "source", "p", "q").agg(F.avg("a").alias("m"), (F.covar_samp("a", "b") + F.when(F.col("p") == F.col("q"), 1e-8).otherwise(0.0)).alias("c"), F.count("*").alias("n")).filter("n > 1")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("p", "q", c))), lambda r: r[c])
    out = moments.groupBy("origin", "horizon", "source").agg(listed("m").alias("means"), listed("c").alias("cov"))
    d = F.sqrt(F.size("cov").cast("double")).cast("int")
    return out.select("origin", "horizon", "source", F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.get("means", i * d)).alias("mean"), cf.floored("cov", la.STATE_FLOOR).alias("cov"))


# ---- runs over origins, methods that may fail, comparisons


def chart_errors(coordinates: DataFrame, splits: DataFrame, by: list[str]) -> DataFrame:
    """(by, error): the first reason (by t) for which a chart failed on a state before the origin's test_end; ``coordinates`` of ``charts.encode`` with errors, ``by`` holds origin."""
    bad = coordinates.filter("error is not null").join(F.broadcast(splits.select("origin", "test_end")), "origin").filter("t < test_end")
    return bad.groupBy(*by).agg(F.min_by("error", "t").alias("error"))


def rolling_run(splits: DataFrame, horizons: list[int], methods: list[str], summaries: DataFrame, least_fit: dict[str, int] | None = None, failures: DataFrame | None = None) -> DataFrame:
    """(origin, horizon, method, the columns of ``summaries``, error): a row for every task, with the reason where a method gave no finite score.

    Origins whose test block ends within a horizon of the validation block have no tasks. ``least_fit``: states that a
    method needs before fit_end. ``failures`` (origin, method, error), as ``chart_errors`` gives them: charts that failed
    on a state; such a method costs its own rows only, the others are scored.
    """
    spark = splits.sparkSession
    needs = spark.createDataFrame([(m, i, (least_fit or {}).get(m, 0)) for i, m in enumerate(methods)], "method string, place int, least int")
    tasks = splits.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).filter(F.col("test_end") > F.col("val_end") + F.col("horizon")).crossJoin(F.broadcast(needs))
    values = [c for c in summaries.columns if c not in ("origin", "horizon", "method")]
    out = tasks.join(summaries, ["origin", "horizon", "method"], "left")
    if failures is not None:
        out = out.join(failures.select("origin", "method", F.col("error").alias("_why")), ["origin", "method"], "left")
    else:
        out = out.withColumn("_why", F.lit(None).cast("string"))
    few = F.col("fit_end") < F.col("least")
    bad = F.col("w2_mean").isNull() | F.isnan("w2_mean") | (F.abs("w2_mean") == float("inf"))
    error = F.when(few, F.concat(F.lit("needs "), F.col("least").cast("string"), F.lit(" states to fit"))).when(F.col("_why").isNotNull(), F.col("_why")).when(bad, F.lit("no finite score"))
    return out.select("origin", "horizon", "method", *(F.when(error.isNull(), F.col(c)).alias(c) for c in values), error.alias("error"))


METRICS = ["w2", "log_score", "raw_rmse"]


def reference_run(states: DataFrame, splits: DataFrame, horizons: list[int], candidates: DataFrame, d: int, ridges: list[float] = RIDGES, metric: str = "w2", chart: str = "transport_fixed") -> DataFrame:
    """(origin, horizon, reference, place, ridge, val_* and test_* means, n_test_pairs, error, selected): every candidate reference of every origin fitted, tuned on validation and tested, all in one plan; ``selected`` marks the one of least validation ``metric``, the first in ``place`` of equal ones.

    ``candidates``: (origin, reference, place, ref_mean, ref_cov). Diagonal autoregressions fitted before fit_end are
    scored on the validation targets, the ridge of least ``metric`` is fitted before val_end and scored on the test
    targets. A candidate whose chart fails on a state, or that has no finite validation score, keeps its row with the
    reason and is not selected.
    """
    by = ["origin", "reference"]
    refs = checkpointed(candidates.select(*by, "place", "ref_mean", "ref_cov"))
    states = states.select("t", "mean", "cov")
    ends = F.broadcast(splits.select("origin", "fit_end", "val_end", "test_end"))
    every = states.crossJoin(F.broadcast(refs.select(*by))).join(ends, "origin").filter("t < test_end")  # candidates are few
    coded = checkpointed(charts.encode(every.select(*by, "t", "mean", "cov"), refs.select(*by, "ref_mean", "ref_cov"), [chart], by, errors=True))
    failed = checkpointed(chart_errors(coded, splits, by))
    coords = coded.join(F.broadcast(failed), by, "left_anti").select(*by, "method", "t", F.posexplode("z").alias("k", "z"))
    within = lambda end: coords.join(ends, "origin").filter(F.col("t") < F.col(end)).select(*coords.columns)
    never = 2**31 - 1  # the rows are within their ends already
    both = refs.select(*by, "ref_mean", "ref_cov")

    def scores(model: DataFrame, low: Column, high: Column, keys: list[str]) -> DataFrame:
        sources = ranges(splits, horizons, low, high).select("origin", "horizon", "source").join(refs.select(*by), "origin")
        made = chart_forecasts(coords, model, both, sources, by, ["method", "horizon", *keys])
        return losses(made, states, [], d).groupBy(*by, "horizon", *keys)

    gridded = within("fit_end").withColumn("ridge", F.explode(F.array(*map(F.lit, ridges))))
    tried = scores(ar.fit_diagonal(gridded, never, F.col("ridge"), [*by, "method", "ridge", "k"]), F.greatest(F.col("fit_end") - F.col("horizon"), F.lit(0)), F.col("val_end") - F.col("horizon"), ["ridge"])
    tried = tried.agg(*(F.avg(m).alias(f"val_{m}_mean") for m in METRICS))
    choice = checkpointed(best(tried, [*by, "horizon"], f"val_{metric}_mean", ["ridge"]))
    fitted = within("val_end").join(choice.select(*by, "horizon", "ridge"), by)
    tested = scores(ar.fit_diagonal(fitted, never, F.col("ridge"), [*by, "method", "horizon", "ridge", "k"]), F.greatest(F.col("val_end") - F.col("horizon"), F.lit(0)), F.col("test_end") - F.col("horizon"), ["ridge"])
    tested = tested.agg(*(F.avg(m).alias(f"test_{m}_mean") for m in METRICS), F.count("*").alias("n_test_pairs")).drop("ridge")
    grid = refs.select(*by, "place").join(ends, "origin").withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).filter(F.col("test_end") > F.col("val_end") + F.col("horizon"))
    out = grid.drop("fit_end", "val_end", "test_end").join(choice, [*by, "horizon"], "left").join(tested, [*by, "horizon"], "left").join(failed, by, "left")
    out = out.withColumn("error", F.coalesce("error", F.when(F.col("ridge").isNull(), F.lit("no finite validation score"))))
    first = best(out, ["origin", "horizon"], f"val_{metric}_mean", ["place"]).select("origin", "horizon", "reference", F.lit(True).alias("selected"))
    return out.join(first, ["origin", "horizon", "reference"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def rolling_comparison(run: DataFrame, by: list[str], target: str, value: str) -> DataFrame:
    """(by, best_other, best_other_loss, target_loss, reduction, gain, as_good): the target method against the best other method of each group; rows with an error take no part."""
    scored = run.filter(F.col(value).isNotNull())
    other = best(scored.filter(F.col("method") != target), by, value, ["method"]).select(*by, F.col("method").alias("best_other"), F.col(value).alias("best_other_loss"))
    own = scored.filter(F.col("method") == target).select(*by, F.col(value).alias("target_loss"))
    both = own.join(other, by, "left").withColumn("reduction", F.col("best_other_loss") - F.col("target_loss"))
    return both.withColumns({"gain": F.col("reduction") / F.greatest(F.abs("best_other_loss"), F.lit(1e-12)), "as_good": F.col("target_loss") <= F.col("best_other_loss")})


def comparison_summary(comparison: DataFrame, by: list[str]) -> DataFrame:
    """Means and medians of gain and reduction, the share of positive gains, the share as good as the best other, and the number of jobs."""
    share = lambda c: F.avg(c.cast("double"))
    return comparison.groupBy(*by).agg(F.avg("gain").alias("mean_gain"), F.median("gain").alias("median_gain"), F.avg("reduction").alias("mean_reduction"), F.median("reduction").alias("median_reduction"), share(F.col("gain") > 0).alias("positive_rate"), share(F.col("as_good")).alias("best_rate"), F.count("*").alias("n_jobs"))


def panel_contrasts(records: DataFrame, target: str, metrics: list[str]) -> DataFrame:
    """(horizon, metric, comparator, source, difference): target minus each other method on the same panel and source, averaged over panels."""
    value = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("m")
    long = records.select("panel", "horizon", "source", "method", value).select("panel", "horizon", "source", "method", "m.*")
    own = long.filter(F.col("method") == target).select("panel", "horizon", "source", "metric", F.col("value").alias("own"))
    both = long.filter(F.col("method") != target).join(own, ["panel", "horizon", "source", "metric"])
    return both.groupBy("horizon", "metric", F.col("method").alias("comparator"), "source").agg(F.avg(F.col("own") - F.col("value")).alias("difference"))


def panel_means(records: DataFrame, metrics: list[str]) -> DataFrame:
    """(method, horizon, metric, source, value): averages over panels."""
    value = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("m")
    return records.select("horizon", "source", "method", value).groupBy("method", "horizon", "m.metric", "source").agg(F.avg("m.value").alias("value"))


def with_intervals(records: DataFrame, intervals: DataFrame, metrics: list[str]) -> DataFrame:
    """(method, horizon) with mean, median and size of each metric, and the intervals (method, horizon, metric, se, low, high) as columns beside them."""
    stats = [e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), F.median(m).alias(f"{m}_median"))]
    summary = records.groupBy("method", "horizon").agg(*stats, F.count("*").alias("n"))
    wide = intervals.groupBy("method", "horizon").pivot("metric", metrics).agg(F.first("se").alias("se"), F.first("low").alias("low"), F.first("high").alias("high"))
    return summary.join(wide, ["method", "horizon"])


# ---- diagnostics of a series


def adjacent_decomposition(pairs: DataFrame, d: int) -> DataFrame:
    """(median_w2, covariance_share) of adjacent states (mean, cov, before_mean, before_cov)."""
    parts = pairs.select(la.squared_distance("before_mean", "mean").alias("m"), geometry(d).bures("before_cov", "cov").alias("c"))
    return parts.agg(F.median(F.col("m") + F.col("c")).alias("median_w2"), (F.sum("c") / F.greatest(F.sum(F.col("m") + F.col("c")), F.lit(1e-12))).alias("covariance_share"))


def component_lag_one(states: DataFrame, d: int) -> DataFrame:
    """(lag_one): correlation of adjacent scores on the first principal component of the covariances' upper triangles. The component comes from summed products; only those reach the driver."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = states.select("t", array_to_vector(la.upper("cov", d)).alias("x"))
    scores = PCA(k=1, inputCol="x", outputCol="y").fit(rows).transform(rows).select("t", vector_to_array("y")[0].alias("y"))
    before = scores.select((F.col("t") + 1).alias("t"), F.col("y").alias("b"))
    return scores.join(before, "t").agg(F.corr("y", "b").alias("lag_one"))
