"""Vector autoregression of the raw rows as relations, any dimension.

Normal equations are sums over pairs of neighbouring rows, added up once for each stretch between two ends of fitting
and then over stretches, so many origins cost one pass. The model with its intercept is one affine matrix [1, b; 0, W];
its powers, a small table per (end, ridge), are joined to the rows that a target window still lacks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gausstide.functions import linalg as la
from gausstide.operators import scoring, states
from gausstide.session import checkpointed


def raw_end(end: Column | str, window: int, step: int) -> Column:
    """The raw rows that the states before ``end`` are made of."""
    return (F.col(end) if isinstance(end, str) else end) * step + (window - step)


def normal_sums(raw: DataFrame, ends: list[int]) -> DataFrame:
    """(end, q, g): for each end the cells of A'A and then A'Y, row by row of A' = [1, x], over pairs (x, y) of neighbouring rows with y before ``end``. ``raw``: (i, x), numbered without gaps; ``ends``: a list as short as that of origins."""
    before = raw.select((F.col("i") + 1).alias("i"), F.col("x").alias("b"))
    pairs = raw.join(before, "i").select("i", F.concat(F.array(F.lit(1.0)), "b").alias("a"), F.concat(F.array(F.lit(1.0)), "b", "x").alias("ay"), F.size("x").alias("q"))
    stretch = F.lit(0)
    for e in sorted(set(ends)):
        stretch = stretch + (F.col("i") >= e).cast("int")
    cells = F.flatten(F.transform("a", lambda u: F.transform("ay", lambda v: u * v)))
    parts = pairs.withColumn("stretch", stretch).filter(F.col("stretch") < len(set(ends))).select("stretch", "q", F.posexplode(cells).alias("p", "v"))
    sums = parts.groupBy("stretch", "q", "p").agg(F.sum("v").alias("v"))
    upto = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(e).alias("end")) for j, e in enumerate(sorted(set(ends)))))).alias("e")
    whole = sums.select("*", upto).filter(F.col("stretch") <= F.col("e.j")).groupBy(F.col("e.end").alias("end"), "q", "p").agg(F.sum("v").alias("v"))
    return whole.groupBy("end", "q").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda r: r["v"]).alias("g"))


@F.pandas_udf(T.StructType([T.StructField("powers", T.ArrayType(la.DOUBLES)), T.StructField("error", T.StringType())]))
def affine_powers(g: pd.Series, q: pd.Series, ridge: pd.Series, most: pd.Series) -> pd.DataFrame:
    """The first ``most`` powers of the affine matrix of each system; the intercept is not penalised."""

    def one(cells, q, r, n):
        try:
            both = np.asarray(cells).reshape(q + 1, 2 * q + 1)
            w = np.linalg.solve(both[:, : q + 1] + np.diag([0.0] + [r] * q), both[:, q + 1 :])
            a = np.hstack([np.eye(q + 1)[:, :1], w])
            out = [a]
            while len(out) < n:
                out.append(out[-1] @ a)
            if not np.isfinite(out[-1]).all():
                raise ArithmeticError("a forecast is not finite")
            return [p.reshape(-1) for p in out], None
        except (ArithmeticError, ValueError, np.linalg.LinAlgError) as e:
            return None, f"{type(e).__name__}: {e}"

    return pd.DataFrame([one(*r) for r in zip(g, q, ridge, most, strict=True)], columns=["powers", "error"])


def power_table(sums: DataFrame, ridges: DataFrame, most: int) -> DataFrame:
    """(end, ridge, lead, power, error) for leads 1 to ``most``; ``ridges``: (end, ridge). A model that cannot be solved has one row per lead without a power."""
    rows = sums.join(ridges, "end").withColumn("m", affine_powers("g", "q", F.col("ridge").cast("double"), F.lit(most)))
    filled = F.coalesce("m.powers", F.array_repeat(F.lit(None).cast("array<double>"), most))
    return rows.select("end", "ridge", F.posexplode(filled).alias("lead", "power"), F.col("m.error").alias("error")).withColumn("lead", F.col("lead") + 1)


def window_rows(raw: DataFrame, wanted: DataFrame, powers: DataFrame, window: int, step: int) -> DataFrame:
    """(columns of ``wanted``, i, x, error): the rows of each target window; those that end with the source's are known, the others follow from the last known one. ``wanted``: (end, ridge, horizon, source, ...)."""
    keys = wanted.columns
    start, known = (F.col("source") + F.col("horizon")) * step, F.col("source") * step + window
    rows = wanted.withColumn("i", F.explode(F.sequence(start, start + window - 1))).withColumns({"lead": F.greatest(F.col("i") - known + 1, F.lit(0)), "from": F.least(F.col("i"), known - 1)})
    rows = rows.join(raw.select(F.col("i").alias("from"), "x"), "from").join(powers, ["end", "ridge", "lead"], "left")
    q = F.size("x")
    cell = lambda j: F.get("power", j) + F.aggregate(F.sequence(F.lit(1), q), F.lit(0.0), lambda s, k: s + F.get("x", k - 1) * F.get("power", k * (q + 1) + j))
    moved = F.when(F.col("lead") == 0, F.col("x")).when(F.col("power").isNotNull(), F.transform(F.sequence(F.lit(1), q), cell))
    return rows.select(*keys, "i", moved.alias("x"), F.when(F.col("lead") > 0, F.col("error")).alias("error"))


def raw_forecasts(raw: DataFrame, wanted: DataFrame, powers: DataFrame, window: int, step: int) -> DataFrame:
    """(columns of ``wanted``, mean, cov, error): mean and covariance (ddof 1, 1e-8 on the diagonal, floored) of the target windows' rows."""
    keys = wanted.columns
    rows = window_rows(raw, wanted, powers, window, step)
    why = rows.groupBy(*keys).agg(F.min("error").alias("error"))
    good = rows.filter("x is not null")
    made = states.moments(good, keys, 1e-8).filter(F.col("n") == window)
    out = why.join(made.select(*keys, "mean", la.state_floor("cov").alias("cov")), keys, "left")
    return out.select(*keys, "mean", "cov", F.coalesce("error", F.when(F.col("cov").isNull(), F.lit("rows are missing"))).alias("error"))


def raw_tuning(raw: DataFrame, states_: DataFrame, splits: DataFrame, horizons: list[int], ridges: list[float], window: int, step: int, sums: DataFrame) -> DataFrame:
    """(origin, horizon, ridge, loss): mean RMSE of the windows' means over the validation targets, models fitted before fit_end."""
    val = scoring.ranges(splits, horizons, F.greatest(F.col("fit_end") - F.col("horizon"), F.lit(0)), F.col("val_end") - F.col("horizon"))
    val = val.select("origin", raw_end("fit_end", window, step).cast("int").alias("end"), "horizon", "source")
    grid = val.select("end").distinct().withColumn("ridge", F.explode(F.array(*(F.lit(float(r)) for r in ridges))))
    powers = power_table(sums, grid, max(horizons) * step)
    rows = window_rows(raw, val.join(grid, "end"), powers, window, step)
    keys = ["origin", "horizon", "ridge", "source"]
    means = rows.select(*keys, F.posexplode("x").alias("k", "v")).groupBy(*keys, "k").agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    truth = states_.select(F.col("t").alias("target"), F.posexplode("mean").alias("k", "m"))
    both = means.withColumn("target", F.col("source") + F.col("horizon")).join(truth, ["target", "k"])
    each = both.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col("v") - F.col("m"), 2.0))).alias("rmse"), F.min("n").alias("n"))
    whole = F.min("n") == window
    return each.groupBy("origin", "horizon", "ridge").agg(F.when(whole, F.avg("rmse")).alias("loss"))


def raw_panel(raw: DataFrame, states_: DataFrame, splits: DataFrame, horizons: list[int], ridges: list[float], d: int, window: int, step: int) -> DataFrame:
    """(the columns of splits, horizon, source, target, ridge, losses, error): forecasts of the test targets by the raw model, its ridge chosen on validation (the largest of equal ones), fitted before val_end."""
    raw = checkpointed(raw)
    bounds = splits.select(raw_end("fit_end", window, step).cast("int").alias("a"), raw_end("val_end", window, step).cast("int").alias("b")).collect()  # two numbers an origin
    sums = checkpointed(normal_sums(raw, [e for r in bounds for e in r]))
    tuning = raw_tuning(raw, states_, splits, horizons, ridges, window, step, sums)
    choice = checkpointed(scoring.best(tuning, ["origin", "horizon"], "loss", [F.desc("ridge")], None).select("origin", "horizon", "ridge"))
    tests = scoring.ranges(splits, horizons, F.col("val_end") - F.col("horizon"), F.col("test_end") - F.col("horizon"))
    wanted = tests.select("origin", raw_end("val_end", window, step).cast("int").alias("end"), "horizon", "source").join(choice, ["origin", "horizon"])
    powers = power_table(sums, wanted.select("end", "ridge").distinct(), max(horizons) * step)
    made = raw_forecasts(raw, wanted, powers, window, step).drop("end")
    scored = scoring.losses(made, states_, [], d)
    return tests.join(scored.select("origin", "horizon", "source", "target", "ridge", "raw_rmse", "w2", "low", "error"), ["origin", "horizon", "source"], "left")
