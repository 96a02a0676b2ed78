"""Ridge autoregression of order one: diagonal models natively, full ones by grouped products and a small solve."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def fit_diagonal(series: DataFrame, end: int, ridge: float | Column, by: list[str]) -> DataFrame:
    """(by, mu, slope) per coordinate from rows (by, t, z) with t < end: slope = sum xy / (sum x^2 + (n - 1) ridge), centred by the mean of all n rows."""
    fit = series.filter(F.col("t") < end)
    w = W.partitionBy(*by)
    centred = fit.withColumns({"mu": F.avg("z").over(w), "n": F.count("*").over(w), "before": F.lag("z").over(w.orderBy("t"))})
    x, y = F.col("before") - F.col("mu"), F.col("z") - F.col("mu")
    sums = centred.groupBy(*by).agg(F.max("mu").alias("mu"), F.max("n").alias("n"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"))
    penalty = (F.col("n") - 1) * (F.lit(ridge) if not isinstance(ridge, Column) else ridge)
    return sums.select(*by, "mu", (F.col("xy") / (F.col("xx") + penalty)).alias("slope"))


def forecast_diagonal(series: DataFrame, model: DataFrame, horizon: int, by: list[str]) -> DataFrame:
    """(by, t, z): the forecast of step t + horizon from step t: mu + slope^h (z - mu)."""
    return series.join(model, by).select(*by, "t", (F.col("mu") + F.pow("slope", F.lit(float(horizon))) * (F.col("z") - F.col("mu"))).alias("z"))


def fit_raw_diagonal(grid: DataFrame, end: int, ridge: float) -> DataFrame:
    """(k, intercept, slope) of each raw series, intercept free, penalty not scaled by n."""
    lagged = grid.filter(F.col("i") < end).withColumn("x", F.lag("c").over(W.partitionBy("k").orderBy("i"))).filter("x is not null")
    s = lagged.groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("c").alias("sy"), F.sum(F.col("x") * F.col("c")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    det = F.col("n") * (F.col("sxx") + ridge) - F.col("sx") * F.col("sx")
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det
    return s.select("k", ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("intercept"), slope.alias("slope"))


# ---- full models: sums of products by grouping, only the solve of one small system is a helper


def gram(coordinates: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mu, g): rows, mean, and for each coordinate i the sums of x_i x_j and then of x_i y_j, where x is a row of ``coordinates`` (by, t, z) and y the next one, both centred by the mean of all rows."""
    cells = coordinates.select(*by, "t", F.posexplode("z").alias("k", "v"))
    listed = lambda c, k: F.transform(F.array_sort(F.collect_list(F.struct(*k, c))), lambda r: r[c])
    mean = cells.groupBy(*by, "k").agg(F.avg("v").alias("m"), F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("n"), listed("m", ["k"]).alias("mu"))
    centred = coordinates.join(mean, by).select(*by, "t", F.zip_with("z", "mu", lambda a, b: a - b).alias("y"))
    before = centred.select(*by, (F.col("t") + 1).alias("t"), F.col("y").alias("x"))
    pairs = centred.join(before, [*by, "t"]).select(*by, "x", F.concat("x", "y").alias("xy"))
    products = pairs.select(*by, F.posexplode("x").alias("i", "a"), "xy").select(*by, "i", "a", F.posexplode("xy").alias("j", "b"))
    sums = products.groupBy(*by, "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    return sums.groupBy(*by).agg(listed("s", ["i", "j"]).alias("g")).join(mean, by)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def propagator(g: pd.Series, penalty: pd.Series, horizon: pd.Series) -> pd.Series:
    """The coefficient matrix of each system of ``gram``, ridge ``penalty`` on its diagonal, to the power of the horizon; row-major."""

    def one(cells, p, h):
        q = int(round(np.sqrt(len(cells) / 2)))
        both = np.asarray(cells).reshape(q, 2 * q)
        return np.linalg.matrix_power(np.linalg.solve(both[:, :q] + p * np.eye(q), both[:, q:]), int(h)).reshape(-1)

    return pd.Series([one(*r) for r in zip(g, penalty, horizon, strict=True)])


def propagated(z: str, mu: str, power: str) -> Column:
    """mu + (z - mu) P, natively."""
    q = F.size(mu)
    cell = lambda j: F.get(mu, j) + F.aggregate(F.sequence(F.lit(0), q - 1), F.lit(0.0), lambda s, i: s + (F.get(z, i) - F.get(mu, i)) * F.get(power, i * q + j))
    return F.transform(F.sequence(F.lit(0), q - 1), cell)


# ---- full models, on arrays inside a task


def fit_full(z: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """(mu, A) with x' = mu + (x - mu) A. Solved in the smaller of the two spaces, which give the same A."""
    if len(z) < 3 or not np.isfinite(z).all() or ridge <= 0:
        raise ValueError("a fit needs three finite rows and a ridge above 0")
    mu = z.mean(0)
    x, y, penalty = z[:-1] - mu, z[1:] - mu, (len(z) - 1) * ridge
    if x.shape[1] <= len(x):
        return mu, np.linalg.solve(x.T @ x + penalty * np.eye(x.shape[1]), x.T @ y)
    return mu, x.T @ np.linalg.solve(x @ x.T + penalty * np.eye(len(x)), y)


def fit_dual(z: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    mu = z.mean(0)
    x, y = z[:-1] - mu, z[1:] - mu
    return mu, x.T @ np.linalg.solve(x @ x.T + (len(z) - 1) * ridge * np.eye(len(x)), y)


def fit_diag_arrays(z: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    mu = z.mean(0)
    x, y = z[:-1] - mu, z[1:] - mu
    return mu, np.diag((x * y).sum(0) / ((x * x).sum(0) + (len(z) - 1) * ridge))


def predict(model: tuple[np.ndarray, np.ndarray], z: np.ndarray, horizon: int) -> np.ndarray:
    mu, a = model
    return mu + (z - mu) @ np.linalg.matrix_power(a, horizon)


def fit_raw(x: np.ndarray, ridge: float, diagonal: bool = False) -> np.ndarray:
    """(q + 1, q): intercept row first, not penalised; penalty not scaled."""
    q = x.shape[1]
    a = np.hstack([np.ones((len(x) - 1, 1)), x[:-1]])
    if diagonal:
        out = np.zeros((q + 1, q))
        for k in range(q):
            own = a[:, [0, k + 1]]
            out[[0, k + 1], k] = np.linalg.solve(own.T @ own + np.diag([0.0, ridge]), own.T @ x[1:, k])
        return out
    return np.linalg.solve(a.T @ a + np.diag([0.0] + [ridge] * q), a.T @ x[1:])


def predict_raw_window(x: np.ndarray, weights: np.ndarray, known: int, start: int, window: int) -> np.ndarray:
    """Rows start .. start + window - 1: known ones (before ``known``) as they are, the rest by recursion from row known - 1."""
    rows = list(x[start:known])
    z = x[known - 1]
    for i in range(known, start + window):
        z = weights[0] + z @ weights[1:]
        if i >= start:
            rows.append(z)
    return np.array(rows[-window:] if len(rows) > window else rows)
