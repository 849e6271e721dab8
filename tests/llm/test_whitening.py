"""Embedding whitening against plain numpy in double precision and exact integers."""

import math
import random

import numpy as np
import pytest

from outagelens.llm import whitening as W


def plain(rows, most=32):
    """(vec_id, deviation) rows, eigenvalues and covariance of clean vectors, by whole arrays and Python integers."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    c = np.array([[(n * r[j] - s[j]) / n for j in range(d)] for r in x])
    return dev, c, c.T @ c / n


def test_whitening_equals_plain_numpy(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12))).astype(np.float32).tolist()
    rows = [(i, r, "x") for i, r in enumerate(v)] + [(7, v[7], "again")]
    bad = [(1000, None, ""), (1001, [None] + v[0][1:], ""), (1002, [float("nan")] + v[0][1:], ""), (1003, [float("inf")] + v[0][1:], ""),
           (1004, v[0][:5], ""), (1005, [], "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, whitened string").repartition(5)
    got = W.whiten(df, "vec_id", "embedding", 8).collect()
    dev, c, cov = plain([(i, r) for i, r, _ in rows])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == len(rows) * 8 and {r["n"] for r in got} == {401}
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert set(by) == set(range(400)) and len(by[7]) == 16
    signs = {}
    for i in range(400):
        for r in by[i]:
            k = r["component"] - 1
            assert r["deviation"] == dev[i]
            assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-10)
            want = c[i] @ vectors[:, k] / math.sqrt(values[k])
            signs.setdefault(k, 1 if want * r["whitened"] > 0 else -1) if abs(want) > 1e-3 else None
            assert r["whitened"] == pytest.approx(signs.get(k, 1) * want, abs=1e-8)
    assert got[0]["identity_error"] < 1e-10


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0.5], [9, 9, 9, 1, 1, 0.1], [4, 4 - 1e-9, 4 - 2e-9, 1, 1 - 1e-12, 1e-6], [1] * 6,
                                    [1e6, 1, 1e-3, 1e-5, 1e-5, 1e-5]])
def test_refined_eigenvectors_have_double_precision(values):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal in extended precision
        q = q + q @ (np.eye(6) - q.T @ q) / 2
    a = ((q * np.array(values)) @ q.T).astype(np.float64)
    a = (a + a.T) / 2
    got, x = W.eigen(a)
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-14
    assert np.abs(a @ x - x * got).max() < 1e-14 * max(values)
    assert got == pytest.approx(np.array(values, float), abs=4e-15 * max(values))


def test_close_eigenvalues_are_told_apart():
    """Eigenvalues that float32 can't tell apart: their vectors come out by the sub-solve, as exact ones do."""
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    a = (q * (1 + 1e-6 * np.arange(8, 0, -1))) @ q.T
    _, x = W.eigen((a + a.T) / 2)
    assert np.abs(np.abs(q.T @ x) - np.eye(8)).max() < 1e-8


def test_dependent_and_constant_dimensions_have_no_component(spark):
    rng = random.Random(4)
    rows = [(i, [a := rng.gauss(0, 1) // 0.125 * 0.125, 2 * a, 3.0, rng.gauss(0, 1)]) for i in range(50)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e").collect()
    assert {r["component"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-9


def test_tables_without_variance_give_no_rows(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None), (None, [float("nan")])], [(1, [])]):
        assert W.whiten(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e").collect() == []


def test_null_id_stays_and_huge_entries_raise(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.0, 0.5])], "vec_id long, e array<double>")
    assert {r["vec_id"] for r in W.whiten(df, "vec_id", "e").collect()} == {None, 1, 2}
    with pytest.raises(Exception, match="exact range"):
        W.whiten(spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, e array<double>"), "vec_id", "e").collect()


def test_query_covers_the_whole_table(spark):
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.001"
    e = np.array(pq.read_table(f"{d}/embeddings.parquet").column("embedding").to_pylist())
    got = W.op11_whitening(spark, d).toPandas()
    assert len(got) == 32 * len(e) and got["identity_error"].max() < 1e-9
    x = np.floor(64 * e)
    w = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    first = got[got["vec_id"] == got["vec_id"].iloc[0]].sort_values("component")
    assert first["explained"].to_numpy() == pytest.approx(w[:32] / w.sum(), rel=1e-9)
