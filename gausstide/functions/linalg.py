"""Matrix functions on columns.

A symmetric matrix travels as a row-major ``array<double>`` of d*d entries, a vector as ``array<double>``. The functions
below are Arrow UDFs that work on a whole batch at once; batches may mix dimensions. For d = 2 the same functions exist
as plain column expressions in ``closed_forms``.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())
#: Eigenvalue floors by use: default, powers, decoded states, logarithms; bound of exponents.
FLOOR, POWER_FLOOR, STATE_FLOOR, LOG_FLOOR, EXP_BOUND = 1e-7, 1e-9, 1e-8, 1e-12, 40.0


def mt(a: np.ndarray) -> np.ndarray:
    return np.swapaxes(a, -1, -2)


def sym(a: np.ndarray) -> np.ndarray:
    return 0.5 * (a + mt(a))


def spectral(a: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """f applied to the eigenvalues of the symmetric part, for a stack of matrices."""
    w, v = np.linalg.eigh(sym(a))
    return sym((v * f(w)[..., None, :]) @ mt(v))


def floored(a: np.ndarray, eps: float = FLOOR) -> np.ndarray:
    return spectral(a, lambda w: np.maximum(w, eps))


def power(a: np.ndarray, p: float, eps: float = POWER_FLOOR) -> np.ndarray:
    return spectral(floored(a), lambda w: np.maximum(w, eps) ** p)


def logm(a: np.ndarray) -> np.ndarray:
    return spectral(floored(a), lambda w: np.log(np.maximum(w, LOG_FLOOR)))


def expm(a: np.ndarray) -> np.ndarray:
    return spectral(a, lambda w: np.exp(np.clip(w, -EXP_BOUND, EXP_BOUND)))


def trace(a: np.ndarray) -> np.ndarray:
    return np.trace(a, axis1=-2, axis2=-1)


def bures(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Bures distance of covariances."""
    a, b = floored(a), floored(b)
    r = power(a, 0.5)
    return np.maximum(trace(a) + trace(b) - 2 * trace(power(r @ b @ r, 0.5)), 0.0)


def transport(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The symmetric map T with T a T = b."""
    a, b = floored(a), floored(b)
    r, inverse = power(a, 0.5), power(a, -0.5)
    return sym(inverse @ power(r @ b @ r, 0.5) @ inverse)


def geodesic(a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    m = (1 - alpha) * np.eye(a.shape[-1]) + alpha * transport(a, b)
    return floored(m @ a @ m, STATE_FLOOR)


def safe_map(h: np.ndarray, margin: float) -> np.ndarray:
    """I + H, with H scaled back where I + H would have an eigenvalue below ``margin``."""
    low = np.linalg.eigvalsh(sym(h))[..., 0]
    scale = np.where((1 + low < margin) & (low < 0), (1 - margin) / np.maximum(np.abs(low), 1e-300), 1.0)
    return floored(np.eye(h.shape[-1]) + scale[..., None, None] * sym(h), STATE_FLOOR)


def shell(a: np.ndarray, low: float, high: float) -> np.ndarray:
    return spectral(a, lambda w: np.clip(w, low, high))


def spectral_normalised(a: np.ndarray) -> np.ndarray:
    top = np.abs(np.linalg.eigvalsh(sym(a))).max(-1)
    return sym(a) / np.maximum(top, 1e-12)[..., None, None]


def correlation(a: np.ndarray) -> np.ndarray:
    s = np.sqrt(np.maximum(np.diagonal(a, axis1=-2, axis2=-1), 1e-12))
    out = np.clip(a / (s[..., None] * s[..., None, :]), -1, 1)
    out[..., np.arange(a.shape[-1]), np.arange(a.shape[-1])] = 1.0
    return out


def commutator(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norm = lambda x: np.sqrt((x * x).sum((-1, -2)))
    return norm(a @ b - b @ a) / np.maximum(norm(a) * norm(b), 1e-300)


def condition(a: np.ndarray) -> np.ndarray:
    w = np.abs(np.linalg.eigvalsh(sym(a)))
    return w.max(-1) / w.min(-1)


def smallest_eigenvalue(a: np.ndarray) -> np.ndarray:
    return np.linalg.eigvalsh(sym(a))[..., 0]


def is_spd(a: np.ndarray) -> np.ndarray:
    finite = np.isfinite(a).all((-1, -2))
    clean = np.where(finite[..., None, None], a, 0.0)
    even = np.isclose(clean, mt(clean), rtol=1e-10, atol=1e-12).all((-1, -2))
    return finite & even & (smallest_eigenvalue(clean) > 0)


def log_score(m_pred, c_pred, m_true, c_true) -> np.ndarray:
    """Mean negative log likelihood of a Gaussian with the true moments under the predicted one."""
    p, t = floored(c_pred, STATE_FLOOR), floored(c_true, STATE_FLOOR)
    diff = m_true - m_pred
    solved = np.linalg.solve(p, np.concatenate([t, diff[..., None]], -1))
    return 0.5 * (p.shape[-1] * np.log(2 * np.pi) + np.linalg.slogdet(p)[1] + trace(solved[..., :-1]) + (diff * solved[..., -1]).sum(-1))


def gaussian_nll(m_pred, c_pred, m_true, c_true) -> np.ndarray:
    """As ``log_score`` of covariances as they are; one that is not definite is lifted by 1e-6 and tried again."""
    try:
        np.linalg.cholesky(c_pred)
    except np.linalg.LinAlgError:
        c_pred = c_pred + 1e-6 * np.eye(c_pred.shape[-1])
        np.linalg.cholesky(c_pred)
    diff = m_true - m_pred
    solved = np.linalg.solve(c_pred, np.concatenate([c_true, diff[..., None]], -1))
    return 0.5 * (c_pred.shape[-1] * np.log(2 * np.pi) + np.linalg.slogdet(c_pred)[1] + trace(solved[..., :-1]) + (diff * solved[..., -1]).sum(-1))


# ---- the strict layer: errors instead of NaN

#: Multiples of machine precision that an eigenvalue must stand above, and the largest relative residual of a map.
RESOLUTION, CONGRUENCE = 64.0, 1e-7


class NumericalError(ValueError):
    """A matrix that must be finite and positive definite is not."""


def strict_matrices(a) -> np.ndarray:
    """A stack of square real matrices as floats; complex, boolean, text, empty and non-finite input is refused."""
    a = np.asarray(a)
    if a.dtype.kind not in "iuf":
        raise TypeError("matrices must be real numbers")
    if a.ndim < 2 or a.shape[-1] != a.shape[-2] or not a.shape[-1]:
        raise ValueError("matrices must be square and not empty")
    a = a.astype(float)
    if not np.isfinite(a).all():
        raise NumericalError("matrices must be finite")
    return a


def _definite(a: np.ndarray, what: str) -> np.ndarray:
    if not is_spd(a).all():
        raise NumericalError(f"{what} is not positive definite")
    return a


def strict_floored(a: np.ndarray) -> np.ndarray:
    """Eigenvalues floored at STATE_FLOOR, as all of the strict layer has it."""
    return _definite(floored(strict_matrices(a), STATE_FLOOR), "a projected covariance")


def strict_power(a: np.ndarray, p: float) -> np.ndarray:
    """The power of a definite matrix; eigenvalues at or below 0 are an error."""
    a = strict_matrices(a)
    w = np.linalg.eigvalsh(sym(a))
    if not np.isfinite(w).all() or w.min() <= 0:
        raise NumericalError("a power needs positive eigenvalues")
    out = spectral(a, lambda w: np.maximum(w, STATE_FLOOR) ** p)
    if not np.isfinite(out).all():
        raise NumericalError("a power overflows")
    return out


def prepared(covs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Projected covariances and their square roots, computed once for all windows that share them."""
    projected = strict_floored(covs)
    return projected, strict_power(projected, 0.5)


def singular(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors (as rows) of a stack. Where the divide-and-conquer driver fails, each matrix is reduced to its triangular factor first and tried again."""
    try:
        return np.linalg.svd(a)[1:]
    except np.linalg.LinAlgError:
        pass
    values, vectors = np.empty(a.shape[:-1]), np.empty(a.shape)
    for i in np.ndindex(a.shape[:-2]):
        try:
            _, values[i], vectors[i] = np.linalg.svd(np.linalg.qr(a[i])[1])
        except np.linalg.LinAlgError as e:
            raise NumericalError("singular values were not found") from e
    return values, vectors


def product_root(root_a: np.ndarray, root_b: np.ndarray) -> np.ndarray:
    """(A^1/2 B A^1/2)^1/2 from the roots of A and B, without forming and flooring the product: with B^1/2 A^1/2 = U S V' it is V S V', so small eigenvalues keep their relative accuracy."""
    s, v = singular(root_b @ root_a)
    if not np.isfinite(s).all() or s.min() <= 0:
        raise NumericalError("a product of roots needs positive singular values")
    return sym((mt(v) * s[..., None, :]) @ v)


def strict_transport(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The map T with T a T = b by ``product_root``. The result must be definite and carry a to b within CONGRUENCE."""
    a, b = strict_floored(a), strict_floored(b)
    inverse = strict_power(a, -0.5)
    out = _definite(sym(inverse @ product_root(strict_power(a, 0.5), strict_power(b, 0.5)) @ inverse), "a transport map")
    norm = lambda x: np.sqrt((x * x).sum((-1, -2)))
    residual = norm(out @ a @ out - b) / np.maximum(norm(b), 1e-12)
    if not (residual <= CONGRUENCE).all():
        raise NumericalError(f"a transport map misses its target by {residual.max():.3e}")
    return out


def resolved(a: np.ndarray) -> np.ndarray:
    """Decoded covariances floored, then lifted along the diagonal until the smallest eigenvalue can be told from 0 at the matrix's scale."""
    a = floored(strict_matrices(a), STATE_FLOOR)
    w = np.linalg.eigvalsh(a)
    least = STATE_FLOOR + 8 * RESOLUTION * np.finfo(float).eps * a.shape[-1] * np.maximum(np.abs(w).max(-1), 1.0)
    lift = np.maximum(least - w[..., 0], 0.0)
    return _definite(sym(a + lift[..., None, None] * np.eye(a.shape[-1])), "a decoded covariance")


def local_state(h: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """The covariance that the map I + H makes of the reference; only a map that is not positive is repaired, by flooring its eigenvalues."""
    a = np.eye(ref.shape[-1]) + sym(strict_matrices(h))
    bad = smallest_eigenvalue(a) <= 0
    a = np.where(bad[..., None, None], floored(a, STATE_FLOOR), a)
    return resolved(a @ strict_floored(ref) @ a)


def misaligned(vectors: np.ndarray, values: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """V diag(order) V' for the order of ``values`` whose commutator with ``direction`` is largest; the first of equal ones. All orders are tried, so d is small."""
    orders = np.array(list(permutations(values)))
    stack = (vectors * orders[:, None, :]) @ vectors.T
    c = stack @ direction - direction @ stack
    return stack[int(np.argmax(np.sqrt((c * c).sum((-1, -2)))))]


def _batched(fn, shapes: str, out, *columns: pd.Series) -> pd.Series:
    """Calls ``fn`` once per dimension in the batch. ``shapes``: m for a matrix column, v for a vector column. Null in, null out."""
    n = len(columns[0])
    result = np.full(n, None, dtype=object)
    ok = np.logical_and.reduce([c.notna().to_numpy() for c in columns])
    size = np.array([len(x) if good else -1 for x, good in zip(columns[0], ok, strict=True)])
    for s in np.unique(size[ok]):
        at = np.flatnonzero(size == s)
        d = int(round(np.sqrt(s))) if shapes[0] == "m" else int(s)
        arrays = [np.stack([np.asarray(c.iat[i], float) for i in at]).reshape((-1, d, d) if k == "m" else (-1, d)) for c, k in zip(columns, shapes, strict=True)]
        value = fn(*arrays)
        for i, v in zip(at, value, strict=True):
            result[i] = v.reshape(-1) if isinstance(v, np.ndarray) else v.item() if hasattr(v, "item") else v
    return pd.Series(result, dtype=object if isinstance(out, (T.ArrayType, T.BooleanType)) else float)


def column_function(fn, shapes: str, out: T.DataType = DOUBLES):
    """An Arrow UDF of a function on stacks of matrices (m) and vectors (v)."""

    def arity(n):
        if n == 1:
            return lambda a: _batched(fn, shapes, out, a)
        if n == 2:
            return lambda a, b: _batched(fn, shapes, out, a, b)
        return lambda a, b, c, d: _batched(fn, shapes, out, a, b, c, d)

    f = arity(len(shapes))
    f.__annotations__ = dict.fromkeys(["a", "b", "c", "d"][: len(shapes)], pd.Series) | {"return": pd.Series}
    return F.pandas_udf(f, out)


def _tried(fn, shapes: str, *columns: pd.Series) -> pd.DataFrame:
    """(value, error) per row: a stack that fails is tried again matrix by matrix, so that a row which fails costs itself only."""
    n = len(columns[0])
    value, error = np.full(n, None, dtype=object), np.full(n, None, dtype=object)
    ok = np.logical_and.reduce([c.notna().to_numpy() for c in columns])
    size = np.array([len(x) if good else -1 for x, good in zip(columns[0], ok, strict=True)])

    def at_once(at: np.ndarray) -> None:
        d = int(round(np.sqrt(size[at[0]]))) if shapes[0] == "m" else int(size[at[0]])
        arrays = [np.stack([np.asarray(c.iat[i], float) for i in at]).reshape((-1, d, d) if k == "m" else (-1, d)) for c, k in zip(columns, shapes, strict=True)]
        made = np.asarray(fn(*arrays))
        if not np.isfinite(made).all():
            raise NumericalError("a result is not finite")
        for i, v in zip(at, made, strict=True):
            value[i] = v.reshape(-1) if made.ndim > 1 else float(v)

    for s in np.unique(size[ok]):
        at = np.flatnonzero(size == s)
        try:
            at_once(at)
        except (ArithmeticError, ValueError, np.linalg.LinAlgError):
            for i in at:
                try:
                    at_once(np.array([i]))
                except (ArithmeticError, ValueError, np.linalg.LinAlgError) as e:
                    value[i], error[i] = None, f"{type(e).__name__}: {e}"
    return pd.DataFrame({"value": value, "error": error})


_FUNCTIONS = {
    "floored": (floored, "m", DOUBLES),
    "sqrtm": (lambda a: power(a, 0.5), "m", DOUBLES),
    "logm": (logm, "m", DOUBLES),
    "expm": (expm, "m", DOUBLES),
    "bures": (bures, "mm", T.DoubleType()),
    "transport": (transport, "mm", DOUBLES),
    "strict_transport": (strict_transport, "mm", DOUBLES),
    "strict_floored": (strict_floored, "m", DOUBLES),
    "strict_root": (lambda a: strict_power(strict_floored(a), 0.5), "m", DOUBLES),
    "local_state": (local_state, "mm", DOUBLES),
    "resolved": (resolved, "m", DOUBLES),
    "correlation": (correlation, "m", DOUBLES),
    "commutator": (commutator, "mm", T.DoubleType()),
    "condition": (condition, "m", T.DoubleType()),
    "smallest_eigenvalue": (smallest_eigenvalue, "m", T.DoubleType()),
    "spectral_normalised": (spectral_normalised, "m", DOUBLES),
    "is_spd": (is_spd, "m", T.BooleanType()),
    "gaussian_nll": (gaussian_nll, "vmvm", T.DoubleType()),
    "log_score": (log_score, "vmvm", T.DoubleType()),
}


def call(name: str, *columns) -> Column:
    """A matrix function by name on columns, e.g. ``call("bures", "cov", "other")``."""
    fn, shapes, out = _FUNCTIONS[name]
    return column_function(fn, shapes, out)(*columns)


def tried(name: str, *columns) -> Column:
    """As ``call``, but a struct (value, error): a row that fails has no value and the reason, and the job goes on. Null in: neither."""
    fn, shapes, out = _FUNCTIONS[name]
    kind = T.StructType([T.StructField("value", out), T.StructField("error", T.StringType())])
    if len(shapes) == 1:
        f = lambda a: _tried(fn, shapes, a)
    elif len(shapes) == 2:
        f = lambda a, b: _tried(fn, shapes, a, b)
    else:
        f = lambda a, b, c, d: _tried(fn, shapes, a, b, c, d)
    f.__annotations__ = dict.fromkeys(["a", "b", "c", "d"][: len(shapes)], pd.Series) | {"return": pd.DataFrame}
    return F.pandas_udf(f, kind)(*columns)


def state_floor(cov: str, eps: float = STATE_FLOOR) -> Column:
    return column_function(lambda a: floored(a, eps), "m")(cov)


def geodesic_column(a: str, b: str, alpha: float) -> Column:
    return column_function(lambda x, y: geodesic(x, y, alpha), "mm")(a, b)


# ---- native helpers on packed arrays


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def correlation_cell(a: str, d: int, i: int, j: int) -> Column:
    """One cell of the correlation matrix of a d x d covariance, natively."""
    at = lambda p, q: F.get(a, F.lit(p * d + q))
    if i == j:
        return F.lit(1.0)
    spread = F.sqrt(F.greatest(at(i, i), F.lit(1e-12)) * F.greatest(at(j, j), F.lit(1e-12)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), at(i, j) / spread))


def product(a: str, b: str, d: Column) -> Column:
    """The product of two packed square matrices, natively."""
    row = lambda p: F.floor(p / d).cast("int")
    cell = lambda p: F.aggregate(F.sequence(F.lit(0), d - 1), F.lit(0.0), lambda s, k: s + F.get(a, row(p) * d + k) * F.get(b, k * d + p % d))
    return F.transform(F.sequence(F.lit(0), d * d - 1), cell)


def commutator_size(a: str, b: str) -> Column:
    """Norm of AB - BA over the product of the norms, for symmetric matrices of any dimension, natively: BA is (AB) transposed."""
    d = F.sqrt(F.size(a).cast("double")).cast("int")
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    at = F.sequence(F.lit(0), d * d - 1)
    ab = F.array(product(a, b, d))  # named once by the transform below
    gaps = F.transform(ab, lambda m: F.transform(at, lambda p: F.get(m, p) - F.get(m, (p % d) * d + F.floor(p / d).cast("int"))))
    return norm(F.get(gaps, F.lit(0))) / F.greatest(norm(a) * norm(b), F.lit(1e-300))


def upper(a: str, d: int) -> Column:
    """The upper triangle, row by row, diagonal included."""
    return F.array(*(F.get(a, F.lit(i * d + j)) for i in range(d) for j in range(i, d)))


def from_upper(z: str, d: int, offset: int = 0) -> Column:
    at = {}
    for i in range(d):
        for j in range(i, d):
            at[i, j] = at[j, i] = len(set(at.values()))
    return F.array(*(F.get(z, F.lit(offset + at[i, j])) for i in range(d) for j in range(d)))
