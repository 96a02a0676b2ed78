"""The local chart as relations: a reference, coordinates and a model of its own for every source and window length.

A (length, source) pair is a group of ``length`` states, so work is spread over pairs and no task sees a series. Each
step is a relation: members of the windows, references, coordinates, forecasts for all ridges and horizons, losses, the
tuning table and its least row. Pairs are shared by all origins and horizons that use them. Python is one small solve per
pair; what fails carries its reason along (``error``) and costs its own rows only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gausstide.functions import linalg as la
from gausstide.operators import references, scoring
from gausstide.session import checkpointed

RIDGES = [1e-6, 1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0]
LENGTHS = [24, 48, 72]
FAILURES = (ArithmeticError, ValueError, np.linalg.LinAlgError)


@F.pandas_udf(T.StructType([T.StructField("value", la.DOUBLES), T.StructField("residual", T.DoubleType()), T.StructField("error", T.StringType())]))
def solved_reference(covs: pd.Series) -> pd.DataFrame:
    """The barycenter of a window's covariances, how far a step still moves it, or why there is none."""

    def one(stack):
        try:
            a = np.stack(list(map(np.asarray, stack)))
            d = int(round(np.sqrt(a.shape[1])))
            projected, roots = la.prepared(a.reshape(-1, d, d))
            s = references.exact_barycenter(projected)
            return s.reshape(-1), references.residual(roots, s), None
        except FAILURES as e:
            return None, None, f"{type(e).__name__}: {e}"

    return pd.DataFrame([one(c) for c in covs], columns=["value", "residual", "error"])


def window_forecasts(z: np.ndarray, ridges: list[float], horizons: list[int]) -> list[tuple]:
    """(ridge, horizon, z) of a ridge autoregression of order one on the rows of a window, from its last row, solved in the space of rows: one eigendecomposition serves all ridges, and no q x q matrix is formed."""
    mu = z.mean(0)
    x, y, last = z[:-1] - mu, z[1:] - mu, z[-1] - mu
    w, u = np.linalg.eigh(x @ x.T)
    out = []
    for r in ridges:
        now, at = last, {}
        for h in range(1, max(horizons) + 1):
            now = at[h] = ((u @ ((u.T @ (x @ now)) / (np.maximum(w, 0.0) + (len(z) - 1) * r))) @ y)
        out += [(float(r), h, mu + at[h]) for h in horizons]
    return out


def forecasts_of(ridges: list[float], horizons: list[int]):
    """An Arrow UDF of ``window_forecasts`` on a column of windows (arrays of rows): a struct (forecasts, error)."""

    @F.pandas_udf("forecasts array<struct<ridge:double,horizon:int,z:array<double>>>, error string")
    def fitted(rows: pd.Series) -> pd.DataFrame:
        def one(zs):
            if zs is None:
                return None, None
            try:
                z = np.stack(list(map(np.asarray, zs)))
                if len(z) < 3 or not np.isfinite(z).all():
                    raise ValueError("a fit needs three finite rows")
                return [{"ridge": r, "horizon": h, "z": v} for r, h, v in window_forecasts(z, ridges, horizons)], None
            except FAILURES as e:
                return None, f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(r) for r in rows], columns=["forecasts", "error"])

    return fitted


def window_members(states: DataFrame, sources: DataFrame, lengths: list[int]) -> DataFrame:
    """(length, source, t, mean, cov): the states of every trailing window that has all of them; ``sources``: (source)."""
    pairs = sources.select("source").distinct().withColumn("length", F.explode(F.array(*map(F.lit, lengths)))).filter("source >= length - 1")
    rows = pairs.withColumn("t", F.explode(F.sequence(F.col("source") - F.col("length") + 1, F.col("source"))))
    return rows.join(states.select("t", "mean", "cov"), "t")


def local_references(members: DataFrame) -> DataFrame:
    """(length, source, ref_mean, ref_cov, residual, error) of each window."""
    listed = F.array_sort(F.collect_list(F.struct("t", "mean", "cov")))  # a window's length bounds the list
    whole = members.groupBy("length", "source").agg(listed.alias("rows"))
    n = F.size("rows")
    total = F.aggregate("rows", F.transform(F.get("rows", F.lit(0))["mean"], lambda v: v * 0.0), lambda s, r: F.zip_with(s, r["mean"], lambda a, b: a + b))
    out = whole.select("length", "source", F.transform(total, lambda v: v / n).alias("ref_mean"), solved_reference(F.transform("rows", lambda r: r["cov"])).alias("r"))
    return out.select("length", "source", "ref_mean", F.col("r.value").alias("ref_cov"), "r.residual", "r.error")


def local_coordinates(members: DataFrame, refs: DataFrame, d: int) -> DataFrame:
    """(length, source, t, z, error): the mean's difference from the reference's, then the upper triangle of the transport map less the identity."""
    both = members.join(refs.select("length", "source", "ref_mean", "ref_cov"), ["length", "source"])
    mapped = both.withColumn("m", la.tried("strict_transport", "ref_cov", "cov"))
    mean = F.zip_with("mean", "ref_mean", lambda a, b: a - b)
    identity = [1.0 if i == j else 0.0 for i in range(d) for j in range(i, d)]
    upper = F.zip_with(la.upper("m.value", d), F.array(*map(F.lit, identity)), lambda a, b: a - b)
    return mapped.select("length", "source", "t", F.when(F.col("m.value").isNotNull(), F.concat(mean, upper)).alias("z"), F.col("m.error").alias("error"))


def local_forecasts(states: DataFrame, sources: DataFrame, horizons: list[int], d: int, lengths: list[int] | None = None, ridges: list[float] | None = None) -> DataFrame:
    """(length, ridge, horizon, source, mean, cov, residual, error): the state forecast from every source under every window length, ridge and horizon; mean and cov are null where ``error`` tells why."""
    lengths, ridges = lengths or LENGTHS, ridges or RIDGES
    members = checkpointed(window_members(states, sources, lengths))
    refs = checkpointed(local_references(members))
    coords = local_coordinates(members, refs, d)
    whole = coords.groupBy("length", "source").agg(F.array_sort(F.collect_list(F.struct("t", "z"))).alias("rows"), F.min("error").alias("unmapped"))

    usable = F.when(F.forall("rows", lambda r: r["z"].isNotNull()), F.transform("rows", lambda r: r["z"]))
    fits = whole.select("length", "source", "unmapped", forecasts_of(ridges, horizons)(usable).alias("f")).join(refs, ["length", "source"])
    fits = fits.withColumn("why", F.coalesce("error", "unmapped", "f.error")).drop("error", "unmapped")
    grid = F.array(*(F.struct(F.lit(float(r)).alias("ridge"), F.lit(h).alias("horizon"), F.lit(None).cast("array<double>").alias("z")) for r in ridges for h in horizons))
    each = fits.select("length", "source", "ref_mean", "ref_cov", "residual", "why", F.explode(F.coalesce("f.forecasts", grid)).alias("g")).select("*", "g.*").drop("g")
    back = each.withColumn("h", F.when(F.col("z").isNotNull(), la.from_upper("z", d, d)))
    back = back.withColumn("c", la.tried("local_state", "h", "ref_cov"))
    mean = F.when(F.col("c.value").isNotNull(), F.zip_with(F.slice("z", 1, d), "ref_mean", lambda a, b: a + b))
    return back.select("length", "ridge", "horizon", "source", mean.alias("mean"), F.col("c.value").alias("cov"), "residual", F.coalesce("why", "c.error").alias("error"))


def tuning_table(scored: DataFrame, splits: DataFrame, horizons: list[int], longest: int) -> DataFrame:
    """(origin, horizon, window_length, ridge, validation_raw_rmse, validation_w2, n_validation_targets, validation_target_start, validation_target_stop, error) over the validation targets whose longest window exists; a candidate that fails at any of them has no losses and the reason."""
    low, high = F.greatest(F.col("fit_end") - F.col("horizon"), F.lit(longest - 1)), F.col("val_end") - F.col("horizon")
    wanted = scoring.ranges(splits, horizons, low, high).select("origin", "horizon", "source")
    rows = wanted.join(scored, ["horizon", "source"])
    whole = F.count("raw_rmse") == F.count("*")
    loss = lambda c: F.when(whole, F.avg(c))
    target = F.col("source") + F.col("horizon")
    return rows.groupBy("origin", "horizon", F.col("length").alias("window_length"), "ridge").agg(
        loss("raw_rmse").alias("validation_raw_rmse"), loss("w2").alias("validation_w2"), F.count("*").alias("n_validation_targets"),
        F.min(target).alias("validation_target_start"), (F.max(target) + 1).alias("validation_target_stop"), F.min("error").alias("error"),
    )


def chosen(tuning: DataFrame) -> DataFrame:
    """The row of least validation_raw_rmse of each origin and horizon; of equal ones the smallest window, then the largest ridge."""
    return scoring.best(tuning, ["origin", "horizon"], "validation_raw_rmse", ["window_length", F.desc("ridge")], None)


def scored_forecasts(states: DataFrame, splits: DataFrame, horizons: list[int], d: int, lengths: list[int] | None = None, ridges: list[float] | None = None) -> DataFrame:
    """``local_forecasts`` with their losses, for all sources that validation and test of ``splits`` need: staged, since tuning and panel both read it."""
    lengths = lengths or LENGTHS
    low = F.least(F.greatest(F.col("fit_end") - F.col("horizon"), F.lit(max(lengths) - 1)), F.col("val_end") - F.col("horizon"))
    sources = scoring.ranges(splits, horizons, low, F.col("test_end") - F.col("horizon")).filter("source >= 0").select("source").distinct()
    made = local_forecasts(states, sources, horizons, d, lengths, ridges)
    scored = scoring.losses(made, states, [], d)
    finite = F.abs("w2") < float("inf")
    why = F.coalesce("error", F.when(~F.coalesce(finite, F.lit(False)), F.lit("no finite loss")))
    return checkpointed(scored.withColumns({"error": why, **{c: F.when(why.isNull(), F.col(c)) for c in ("raw_rmse", "w2", "low")}}))


def local_panel(scored: DataFrame, splits: DataFrame, horizons: list[int], longest: int) -> DataFrame:
    """(the columns of splits, horizon, source, target, window_length, ridge, losses, reference_residual, error): every test target of every origin under the choice of its validation. A row without losses has the reason; where no candidate could be chosen the reason is that of validation."""
    choice = chosen(tuning_table(scored, splits, horizons, longest))
    tests = scoring.ranges(splits, horizons, F.col("val_end") - F.col("horizon"), F.col("test_end") - F.col("horizon"))
    wanted = tests.join(choice.select("origin", "horizon", "window_length", "ridge"), ["origin", "horizon"], "left")
    rows = scored.select("horizon", "source", F.col("length").alias("window_length"), "ridge", "raw_rmse", "w2", "low", "residual", "error")
    both = wanted.join(rows, ["horizon", "source", "window_length", "ridge"], "left").withColumn("target", F.col("source") + F.col("horizon"))
    reason = F.when(F.col("window_length").isNull(), F.lit("no candidate passed validation")).otherwise(F.coalesce("error", F.when(F.col("raw_rmse").isNull(), F.lit("its window does not exist"))))
    return both.withColumn("error", reason).withColumnRenamed("residual", "reference_residual")
