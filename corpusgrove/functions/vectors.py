"""Vector column expressions.

All functions build JVM-side Column expressions over ``array<double>`` using
higher-order functions, so they stay inside whole-stage codegen and need no
Python worker. Float arrays are cast to double first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLE_ARRAY = T.ArrayType(T.DoubleType())


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c) -> Column:
    return _c(c).cast(DOUBLE_ARRAY)


def _zip_sum(a, b, f) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), f), F.lit(0.0), lambda acc, v: acc + v)


def squared_euclidean(a, b) -> Column:
    return _zip_sum(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a, b) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a, b) -> Column:
    return _zip_sum(a, b, lambda x, y: F.abs(x - y))


def chebyshev(a, b) -> Column:
    return F.array_max(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))


def minkowski(a, b, p: float = 2.0) -> Column:
    return F.pow(_zip_sum(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(1.0 / p))


def canberra(a, b) -> Column:
    def term(x, y):
        den = F.abs(x) + F.abs(y)
        return F.when(den == 0, F.lit(0.0)).otherwise(F.abs(x - y) / den)
    return _zip_sum(a, b, term)


def braycurtis(a, b) -> Column:
    num = _zip_sum(a, b, lambda x, y: F.abs(x - y))
    den = _zip_sum(a, b, lambda x, y: F.abs(x + y))
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def haversine(a, b) -> Column:
    """Great-circle distance on the unit sphere for [lat, lon] in radians."""
    a, b = as_double(a), as_double(b)
    dlat = (b[0] - a[0]) / 2
    dlon = (b[1] - a[1]) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(a[0]) * F.cos(b[0]) * F.pow(F.sin(dlon), 2)
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def norm(a) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda acc, v: acc + v * v))


def dot(a, b) -> Column:
    return _zip_sum(a, b, lambda x, y: x * y)


def cosine(a, b) -> Column:
    """1 - cos; a zero vector is at distance 1, two zero vectors at 0."""
    na, nb = norm(a), norm(b)
    return (F.when((na == 0) & (nb == 0), F.lit(0.0))
            .when((na == 0) | (nb == 0), F.lit(1.0))
            .otherwise(1.0 - dot(a, b) / (na * nb)))


def center(a) -> Column:
    a = as_double(a)
    mean = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)
    return F.transform(a, lambda v: v - mean)


def correlation(a, b) -> Column:
    return cosine(center(a), center(b))


def scale(a, weights) -> Column:
    """Multiply elementwise by a fixed weight vector (wminkowski, seuclidean)."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.zip_with(as_double(a), w, lambda x, y: x * y)


def nan_to_num(a, big: float = 1.7976931348623157e308) -> Column:
    """NaN -> 0, +inf -> largest finite, -inf -> most negative finite."""
    def fix(v):
        return (F.when(F.isnan(v), F.lit(0.0))
                .when(v == float("inf"), F.lit(big))
                .when(v == float("-inf"), F.lit(-big))
                .otherwise(v))
    return F.transform(as_double(a), fix)


METRICS = {
    "euclidean": euclidean,
    "sqeuclidean": squared_euclidean,
    "manhattan": manhattan,
    "l1": manhattan,
    "chebyshev": chebyshev,
    "minkowski": minkowski,
    "canberra": canberra,
    "braycurtis": braycurtis,
    "haversine": haversine,
    "cosine": cosine,
    "correlation": correlation,
}


def distance(a, b, metric: str = "euclidean", **kw) -> Column:
    """Distance by metric name.

    ``wminkowski`` takes ``w`` and ``p``; ``seuclidean`` takes ``V`` (variances);
    ``mahalanobis`` takes ``VI`` (inverse covariance, d x d). Fitted parameters
    come from :func:`fit_variances` / :func:`fit_inverse_covariance`.
    """
    if metric == "minkowski":
        return minkowski(a, b, kw.get("p", 2.0))
    if metric == "wminkowski":
        w = kw["w"]
        return minkowski(scale(a, w), scale(b, w), kw.get("p", 2.0))
    if metric == "seuclidean":
        inv_sd = [1.0 / (v ** 0.5) if v > 0 else 0.0 for v in kw["V"]]
        return euclidean(scale(a, inv_sd), scale(b, inv_sd))
    if metric == "mahalanobis":
        return euclidean(whiten(a, kw["VI"]), whiten(b, kw["VI"]))
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return METRICS[metric](a, b)


def whiten(a, inv_cov) -> Column:
    """Map x to L^T x where L L^T = VI, so ||L^T(x-y)|| is the Mahalanobis distance."""
    import numpy as np
    L = np.linalg.cholesky(np.asarray(inv_cov, dtype=float))
    rows = L.T
    a = as_double(a)
    return F.array(*[
        F.aggregate(F.zip_with(a, F.array(*[F.lit(float(v)) for v in r]), lambda x, y: x * y),
                    F.lit(0.0), lambda acc, v: acc + v)
        for r in rows
    ])


def fit_variances(df, col: str, dim: int) -> list[float]:
    """Per-dimension variance, one distributed aggregate (for seuclidean)."""
    v = as_double(col)
    row = df.agg(*[F.var_samp(v[i]).alias(f"v{i}") for i in range(dim)]).first()
    return [float(row[i] or 0.0) for i in range(dim)]


def fit_inverse_covariance(df, col: str, dim: int):
    """Inverse covariance from the d x d Gram aggregate (for mahalanobis)."""
    import numpy as np
    from .linalg import covariance
    cov = covariance(df, col, dim)
    return np.linalg.pinv(cov)


def element(c, i: int) -> Column:
    return as_double(c)[i]


def vector_dim(df, col: str) -> int:
    """Length of the first non-null vector (reads one row)."""
    row = df.select(F.size(col).alias("d")).where(F.col(col).isNotNull()).first()
    if row is None:
        raise ValueError(f"column {col!r} has no vectors")
    return int(row["d"])


def mean_vector(col: str, dim: int) -> Column:
    """Elementwise mean as one array, built from ``dim`` plain ``avg``
    aggregates so it is a partial (map-side) hash aggregate."""
    v = as_double(col)
    return F.array(*[F.avg(v[i]) for i in range(dim)])
