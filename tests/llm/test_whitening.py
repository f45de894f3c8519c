"""Whitening against numpy's eigendecomposition of the exact covariance."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import common, queries, whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string, v int"


def exact(x):
    """Covariance from integers, rounded once."""
    n, s = len(x), x.sum(0)
    y = (n * x - s).astype(object)
    return np.array([[float(Fraction(int((y[:, i] * y[:, j]).sum()), n**3)) for j in range(x.shape[1])] for i in range(x.shape[1])]), y


@pytest.mark.parametrize("dim, n", [(1, 9), (2, 40), (7, 200), (33, 20)])
def test_rank_one_updates(dim, n):
    x = np.floor(64 * np.random.default_rng(dim).normal(size=(n, dim)) * np.linspace(0.1, 3, dim)).astype(np.int64) + whitening.SHIFT
    both = whitening.Spectrum.empty(dim)
    parts = []
    for k in range(3):
        s = whitening.Spectrum.empty(dim)
        for at in range(k, n, 3):
            s.add(x[at : at + 1])
        parts.append(s)
        both.combine(s)
    y = x - x.mean(0)
    want = y.T @ y
    assert np.allclose(both.vectors * both.values @ both.vectors.T, want, rtol=0, atol=1e-12 * np.abs(want).max())
    assert np.abs(both.vectors.T @ both.vectors - np.eye(dim)).max() < 1e-12
    assert both.n == n and (both.sums == x.sum(0)).all()


def test_deflation_of_equal_values_and_untouched_pairs():
    values, vectors = whitening.rank_one(np.ones(4), np.eye(4), np.array([1.0, 2, 0, 3]), 2.0)
    assert np.allclose(values, [1, 1, 1, 29])
    assert np.allclose(vectors * values @ vectors.T, np.eye(4) + 2 * np.outer([1, 2, 0, 3], [1, 2, 0, 3]))


@pytest.mark.parametrize("parts", [1, 40])
def test_whole_table(spark, data, parts):
    table = common.table(spark, data, "embeddings")
    found = whitening.whiten(table.repartition(parts), components=32).toPandas()
    rows = table.toPandas().sort_values("vec_id")
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in rows["embedding"]])
    cov, y = exact(x)
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    assert len(found) == 32 * len(rows) and (found["n"] == len(rows)).all()
    by_id = found.drop_duplicates("vec_id").sort_values("vec_id")
    assert by_id["deviation"].tolist() == [int((r * r).sum()) for r in y]
    white = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (y.astype(float) / len(x)) @ q[:, :32] / np.sqrt(e[:32])
    sign = np.sign((white * want).sum(0))
    assert np.abs(white - want * sign).max() < 1e-8
    share = found.groupby("component")["explained"].first().to_numpy()
    assert np.abs(share / (e[:32] / np.trace(cov)) - 1).max() < 1e-10
    z = white - white.mean(0)
    assert abs(found["identity_error"].iloc[0] - np.abs(z.T @ z / len(z) - np.eye(32)).max()) < 1e-12
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-9


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(k, [float(np.float32(c)) for c in rng.normal(size=3)], "clash", "clash", 1) for k in range(6)]
    odd = [(None, good[0][1], None, None, None), good[1], (7, None, "x", "y", 2), (8, [], "", "", 3), (9, [1.0, None, 2.0], "", "", 3), (10, [float("nan"), 1.0, 1.0], "", "", 0),
           (11, [float("inf"), 0.0, 0.0], "", "", 0), (12, [1.0, 2.0], "", "", 0), (13, [0.0, 0.0, 1e30], "", "", 0)]
    df = spark.createDataFrame(good + odd, SCHEMA).repartition(4)
    found = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["component"]) for r in found) == sorted((i, c) for i in (-1, 0, 1, 1, 2, 3, 4, 5) for c in (1, 2, 3))
    assert {r["n"] for r in found} == {8} and max(r["identity_error"] for r in found) < 1e-9
    assert abs(sum({r["component"]: r["explained"] for r in found}.values()) - 1) < 1e-12


def test_no_variance_and_no_rows(spark):
    flat = spark.createDataFrame([(k, [0.5, 0.25], "", "", 0) for k in range(4)], SCHEMA)
    found = whitening.whiten(flat).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in found] == [(0, None, 0.0, None)] * 8
    line = spark.createDataFrame([(k, [0.5 * k, 0.25], "", "", 0) for k in range(4)], SCHEMA)
    found = whitening.whiten(line).collect()
    assert {(r["component"], r["whitened"] is None) for r in found} == {(1, False), (2, True)}
    empty = whitening.whiten(flat.where("false"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_64_bits_is_null(spark):
    df = spark.createDataFrame([(k, [1e9 * (k - 1), 1.0], "", "", 0) for k in range(3)], SCHEMA)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df).collect()}
    assert got == {0: None, 1: 0, 2: None}


def test_query_columns(spark):
    df = queries.QUERIES["op11_embedding_whitening"](spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert df.agg(F.max("component")).first()[0] == 32
