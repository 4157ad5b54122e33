"""Distance expressions against NumPy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgrove.functions import vectors as V


def _val(spark, col):
    df = spark.createDataFrame([([1.0, -2.0, 3.0], [0.5, 2.0, -1.0])], "a array<double>, b array<double>")
    return df.select(col.alias("v")).first()["v"]


def test_metrics(spark):
    a, b = np.array([1.0, -2.0, 3.0]), np.array([0.5, 2.0, -1.0])
    want = {
        "euclidean": np.linalg.norm(a - b),
        "manhattan": np.abs(a - b).sum(),
        "chebyshev": np.abs(a - b).max(),
        "canberra": (np.abs(a - b) / (np.abs(a) + np.abs(b))).sum(),
        "braycurtis": np.abs(a - b).sum() / np.abs(a + b).sum(),
        "cosine": 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b)),
    }
    ac, bc = a - a.mean(), b - b.mean()
    want["correlation"] = 1 - ac @ bc / (np.linalg.norm(ac) * np.linalg.norm(bc))
    for m, w in want.items():
        assert _val(spark, V.distance("a", "b", m)) == pytest.approx(w), m
    assert _val(spark, V.distance("a", "b", "minkowski", p=3)) == pytest.approx((np.abs(a - b) ** 3).sum() ** (1 / 3))
    var = [1.0, 4.0, 9.0]
    assert _val(spark, V.distance("a", "b", "seuclidean", V=var)) == pytest.approx(
        np.sqrt((((a - b) ** 2) / np.array(var)).sum()))
    vi = np.linalg.inv(np.array([[2.0, 0.3, 0.0], [0.3, 1.0, 0.1], [0.0, 0.1, 1.5]]))
    assert _val(spark, V.distance("a", "b", "mahalanobis", VI=vi)) == pytest.approx(
        np.sqrt((a - b) @ vi @ (a - b)))


def test_nan_to_num(spark):
    df = spark.createDataFrame([([float("nan"), float("inf"), float("-inf"), 1.0],)], "a array<double>")
    v = df.select(V.nan_to_num("a").alias("v")).first()["v"]
    assert v[0] == 0.0 and v[1] > 1e300 and v[2] < -1e300 and v[3] == 1.0


def test_zero_vector_cosine(spark):
    df = spark.createDataFrame([([0.0, 0.0], [0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>, c array<double>")
    r = df.select(V.cosine("a", "b").alias("ab"), V.cosine("a", "c").alias("ac")).first()
    assert r["ab"] == 0.0 and r["ac"] == 1.0


def test_between_class_scatter(spark):
    from corpusgrove.functions.linalg import weighted_scatter
    from corpusgrove.operators import reduce
    rng = np.random.default_rng(3)
    X = rng.normal(size=(60, 3)) + np.repeat(np.eye(3) * 4, 20, axis=0)
    y = [None if i % 10 == 0 else (-1 if i % 10 == 1 else i // 20) for i in range(60)]
    df = spark.createDataFrame([(X[i].tolist(), y[i]) for i in range(60)], "v array<double>, y int").repartition(5)
    mu = X.mean(axis=0)
    want = np.zeros((3, 3))
    for c in range(3):
        rows = X[[i for i in range(60) if y[i] == c]]
        d = rows.mean(axis=0) - mu
        want += len(rows) * np.outer(d, d)
    scatter = 0.5 * np.cov(X.T) + 0.5 * want / 60
    vals, vecs = np.linalg.eigh(scatter)
    got = reduce.fit_supervised(df, "v", "y", 2).components
    for axis, ref in zip(got, vecs.T[::-1]):
        assert abs(abs(axis @ ref) - 1) < 1e-8
    empty = spark.createDataFrame([], "m array<double>, n long")
    assert not weighted_scatter(empty, "m", "n", mu).any()
