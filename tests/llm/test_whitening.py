"""Embedding whitening against dense numpy and exact fractions."""

from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadence.llm import queries as Q
from cadence.llm import whitening as W
from tests.llm.util import SMALL

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"


def twin(vectors, components=32):
    """(n, components, eigenvalues, trace, whitened, deviations) from a dense eigendecomposition."""
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    k = min(components, x.shape[1])
    values, vecs = values[::-1], vecs[:, ::-1]
    return n, vecs[:, :k], values, centred @ vecs[:, :k] / np.sqrt(np.maximum(values[:k], 1e-300)), ((n * x - total) ** 2).sum(axis=1)


def compare(rows, vectors, ids, k):
    n, _, values, z, away = twin(vectors, k)
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["component"]):
        by[r["vec_id"]].append(r)
    assert len(rows) == len(ids) * k and set(by) == set(ids)
    got = np.array([[r["whitened"] for r in by[i]] for i in ids])
    sign = np.sign((got * z).sum(axis=0))
    assert np.abs(got * sign - z).max() < 1e-8
    assert np.allclose([r["explained"] for r in by[ids[0]]], values[:k] / values.sum(), rtol=1e-10)
    for i, d in zip(ids, away):
        assert {(r["n"], int(r["deviation"])) for r in by[i]} == {(n, int(d))}
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-8


def test_query_equals_dense_eigenvectors(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    got = Q.op11_embedding_whitening(spark, SMALL)
    assert dict(got.dtypes)["deviation"] == "bigint"
    compare(got.collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows], 32)


def test_unusable_rows_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(v) for v in np.float32(row)] for row in rng.normal(size=(40, 5))]
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    odd = [(100, None, 1), (101, [1.0, None, 0.0, 0.0, 0.0], 1), (102, [NAN] * 5, 1), (103, [INF, 0.0, 0.0, 0.0, 0.0], 1),
           (104, [1.0, 2.0], 1), (105, [], 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "'x' AS n", "1 AS component", "2 AS whitened").repartition(7)
    table = W.blocks(df)
    compare(W.whiten(table, W.fit(table)).collect(), vectors, list(range(40)), 5)
    twice = W.blocks(df.unionByName(df).withColumn("vec_id", df["vec_id"] * 0))  # one id for all rows
    out = W.whiten(twice, W.fit(twice)).collect()
    assert len(out) == 80 * 5 and {r["vec_id"] for r in out} == {0} and {r["n"] for r in out} == {80}
    nameless = W.blocks(df.selectExpr("CAST(null AS string) AS vec_id", "embedding"))
    assert {r["vec_id"] for r in W.whiten(nameless, W.fit(nameless)).collect()} == {None}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, None, 0), (2, [], 0)]])
def test_nothing_varies(spark, rows):
    table = W.blocks(spark.createDataFrame(rows, SCHEMA))
    assert W.fit(table) is None
    assert W.whiten(table, None).count() == 0


def test_dependent_columns_are_left_out(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(a), 7.0, float(a), float(b)], 0) for i, (a, b) in enumerate(rng.integers(-40, 40, (60, 2)))]
    table = W.blocks(spark.createDataFrame(rows, SCHEMA))
    model = W.fit(table)
    assert model.components.shape == (4, 2) and model.identity_error < 1e-10
    assert W.whiten(table, model).count() == 120


def test_more_tasks_than_the_driver_adds_up(spark, monkeypatch):
    monkeypatch.setattr(W, "GATHERED", 1)
    monkeypatch.setattr(W, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(8)
    vectors = [[float(v) for v in np.float32(row)] for row in rng.normal(size=(30, 4))]
    table = W.blocks(spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA).repartition(5))
    assert table.agg({"size": "max"}).first()[0] <= 3
    compare(W.whiten(table, W.fit(table)).collect(), vectors, list(range(30)), 4)


def dense_product(x):
    def product(v, beta, last, w_of_u):
        w = x @ v - beta * (x @ last)
        return x.T @ w, (x @ w_of_u).T @ w, float(w @ w)
    return product


@given(st.integers(1, 9), st.integers(1, 7), st.integers(0, 2 ** 32 - 1), st.sampled_from(["full", "equal", "rank", "steep"]))
@settings(max_examples=150, deadline=None)
def test_bidiagonal_has_the_singular_values(n, d, seed, kind):
    rng = np.random.default_rng(seed)
    left, right = np.linalg.qr(rng.normal(size=(n, n)))[0], np.linalg.qr(rng.normal(size=(d, d)))[0]
    s = np.zeros((n, d))
    m = min(n, d)
    s[range(m), range(m)] = {"full": rng.uniform(1, 2, m), "equal": np.full(m, 3.0), "rank": [1.0] * (m - m // 2) + [0.0] * (m // 2),
                             "steep": 10.0 ** -np.arange(m)}[kind]
    x = left @ s @ right
    V, alphas, betas = W.bidiagonalise(dense_product(x), d, m, m)
    assert np.abs(V.T @ V - np.eye(V.shape[1])).max() < 1e-12
    got = np.linalg.svd(W._bidiagonal(alphas, betas))[1]
    if d <= n:  # V spans everything, so no value is missing
        assert np.allclose(got, np.linalg.svd(x)[1][:m], atol=1e-10)


def test_tolerance_ends_early_with_the_same_leading_values():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 60)) * 0.8 ** np.arange(60)
    V, alphas, betas = W.bidiagonalise(dense_product(x), 60, 60, 4, tolerance=1e-12)
    assert len(alphas) < 40
    assert np.allclose(np.linalg.svd(W._bidiagonal(alphas, betas))[1][:4], np.linalg.svd(x)[1][:4], rtol=1e-11)


@given(st.lists(st.lists(st.integers(-(1 << 53), 1 << 53), min_size=3, max_size=3), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_deviations_are_exact(rows):
    x = np.array(rows, dtype=np.int64)
    n, total = len(x), [sum(int(r[j]) for r in rows) for j in range(3)]
    model = W.Whitening(n, total, np.zeros((3, 0)), np.zeros(0), 0.0, 0.0)
    assert model.deviations(x) == [sum((n * int(r[j]) - total[j]) ** 2 for j in range(3)) for r in rows]
    exact = [[float(Fraction(int(r[j])) - Fraction(total[j], n)) for j in range(3)] for r in rows]
    assert np.allclose(model.centred(x), exact, rtol=1e-12, atol=2.0)
