"""2 x 2 covariance geometry as plain column expressions (packed a, b, c, d row-major; symmetric)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gausstide.functions.linalg import squared_distance


def _at(m: str, i: int) -> Column:
    return F.get(F.col(m), F.lit(i))


def det(m: str) -> Column:
    return _at(m, 0) * _at(m, 3) - _at(m, 1) * _at(m, 2)


def trace(m: str) -> Column:
    return _at(m, 0) + _at(m, 3)


def bures(a: str, b: str) -> Column:
    cross = _at(a, 0) * _at(b, 0) + 2 * _at(a, 1) * _at(b, 1) + _at(a, 3) * _at(b, 3)
    return F.greatest(trace(a) + trace(b) - 2 * F.sqrt(cross + 2 * F.sqrt(det(a) * det(b))), F.lit(0.0))


def w2(mean_a: str, cov_a: str, mean_b: str, cov_b: str) -> Column:
    """Squared Wasserstein distance of two Gaussians."""
    return squared_distance(mean_a, mean_b) + bures(cov_a, cov_b)


def eigenvalues(m: str) -> tuple[Column, Column]:
    """The smaller and the larger one."""
    half = trace(m) / 2
    gap = F.sqrt(F.pow((_at(m, 0) - _at(m, 3)) / 2, F.lit(2.0)) + _at(m, 1) * _at(m, 1))
    return half - gap, half + gap


def condition(m: str) -> Column:
    low, high = eigenvalues(m)
    return high / low


def smallest_eigenvalue(m: str) -> Column:
    return eigenvalues(m)[0]


def floored(m: str, eps: float) -> Column:
    """The matrix with its eigenvalues raised to ``eps`` where they are below."""
    low, high = eigenvalues(m)
    lift = (F.lit(eps) - low) / (high - low)  # times high - m, the projector of the smaller eigenvalue
    cells = [_at(m, i) + lift * ((high if i in (0, 3) else F.lit(0.0)) - _at(m, i)) for i in range(4)]
    whole = F.array(*(F.lit(eps if i in (0, 3) else 0.0) for i in range(4)))
    return F.when(low >= eps, F.col(m)).when(high <= eps, whole).otherwise(F.array(*cells))


def spectral(m: str, f: Callable[[Column], Column]) -> Column:
    """``f`` of the matrix, p + q m through both eigenvalues. IEEE throughout: where ``f`` overflows, or the eigenvalues are equal, cells are infinite or NaN."""
    low, high = eigenvalues(m)
    q = F.when(high > low, (f(high) - f(low)) / (high - low)).otherwise(F.lit(float("nan")))
    p = f(low) - q * low
    return F.array(*((p + q * _at(m, i)) if i in (0, 3) else q * _at(m, i) for i in range(4)))


def _quadratic(m: str, x: Column, y: Column) -> Column:
    """(x, y) under the inverse of ``m``."""
    return (_at(m, 3) * x * x - 2 * _at(m, 1) * x * y + _at(m, 0) * y * y) / det(m)


def log_score(mean: str, cov: str, true_mean: str, true_cov: str) -> Column:
    """Mean negative log likelihood of a Gaussian with the true moments under the predicted one; ``cov`` must be definite."""
    mixed = (_at(cov, 3) * _at(true_cov, 0) - 2 * _at(cov, 1) * _at(true_cov, 1) + _at(cov, 0) * _at(true_cov, 3)) / det(cov)
    delta = [_at(true_mean, i) - _at(mean, i) for i in range(2)]
    return 0.5 * (2 * math.log(2 * math.pi) + F.log(det(cov)) + mixed + _quadratic(cov, *delta))


def negative_log_likelihood(mean: str, cov: str, x: str) -> Column:
    """That of one vector ``x``."""
    delta = [_at(x, i) - _at(mean, i) for i in range(2)]
    return 0.5 * (2 * math.log(2 * math.pi) + F.log(det(cov)) + _quadratic(cov, *delta))


def correlation(m: str) -> Column:
    return _at(m, 1) / F.sqrt(_at(m, 0) * _at(m, 3))
