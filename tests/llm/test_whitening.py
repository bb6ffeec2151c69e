from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from stallwise.llm import whitening
from stallwise.llm.registry import QUERIES
from stallwise.llm.whitening import eigen, jacobi_columns, pivoted_cholesky, whiten


def brute(rows, components=4):
    """{row number: (n, deviation, [whitened up to sign], [explained])} by numpy's own eigenvectors."""
    sound = [(i, v) for i, v in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max((len(v) for _, v in sound), default=0)
    x = {i: tuple(math.floor(256 * c) for c in v) + (0,) * (size - len(v)) for i, v in sound}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    y = np.array([[a - s / n for a, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = np.linalg.matrix_rank(y) if len(y) else 0
    out = {}
    for i, v in x.items():
        centred = np.array([a - s / n for a, s in zip(v, sums)])
        k = min(components, rank)
        out[i] = n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), centred @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()
    return out


def check(found, expected, components=4):
    by_row = {}
    for r in found:
        by_row.setdefault(r.vec_id, []).append(r)
    assert by_row.keys() == {i for i, e in expected.items() if len(e[2])}
    signs = None
    for i, rows in by_row.items():
        rows.sort(key=lambda r: r.component)
        n, deviation, whitened, explained = expected[i]
        assert [r.component for r in rows] == list(range(1, len(whitened) + 1))
        assert {(r.n, r.deviation) for r in rows} == {(n, deviation)}
        mine = np.array([r.whitened for r in rows])
        if signs is None and (np.abs(whitened) > 0.1).all():
            signs = np.sign(mine * whitened)
        assert np.allclose(np.abs(mine), np.abs(whitened), atol=1e-8)
        assert signs is None or np.allclose(mine * signs, whitened, atol=1e-8)
        assert np.allclose([r.explained for r in rows], explained, rtol=1e-9)
    assert all(r.identity_error <= 1e-9 for r in found) and len({r.identity_error for r in found}) <= 1


def table(spark, rows, **extra):
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<float>")
    return df.withColumns({name: F.lit(value) for name, value in extra.items()}) if extra else df


def flat(df):
    return df.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()


def vectors(count, size, seed=0):
    r = np.random.default_rng(seed)
    mixed = r.normal(size=(count, size)) @ np.diag(np.geomspace(1, 0.05, size)) @ r.normal(size=(size, size))
    return [[float(np.float32(c)) for c in row] for row in mixed]


def test_equals_numpy_with_faulty_repeated_and_short_vectors(spark):
    rows = vectors(60, 7)
    rows += [rows[3]] * 40 + [None, [None] * 7, [float("nan")] + [0.0] * 6, [float("-inf")] * 7, [], [0.5, -0.25], [0.5, -0.25, 0.0, 0.0], [-0.0] * 7]
    check(flat(whiten(table(spark, rows).repartition(5))), brute(rows))


@pytest.mark.parametrize("rows", [[], [None], [[]], [[], []], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_nothing_to_whiten(spark, rows):
    assert flat(whiten(table(spark, rows))) == []


def test_fewer_components_than_asked_for(spark):
    line = [[float(k), 2.0 * k, 0.0] for k in range(9)]
    check(flat(whiten(table(spark, line))), brute(line))
    plane = [[float(a), float(b), float(a + b), 1.0, float(a - b)] for a in range(5) for b in range(7)]
    check(flat(whiten(table(spark, plane))), brute(plane))
    single = [[0.5 * k] for k in range(4)]
    check(flat(whiten(table(spark, single))), brute(single))


def test_other_columns_repeated_rows_and_null_ids(spark):
    rows = vectors(30, 3)
    df = table(spark, rows, row="r", x=5, n="n", component=1.5)
    df = df.unionByName(df.limit(4)).withColumn("vec_id", F.when(F.col("vec_id") != 7, F.col("vec_id")))
    found = whiten(df, components=2).collect()
    assert len(found) == 2 * 34 and {(r.row.row, r.row.x, r.row.n, r.row.component) for r in found} == {("r", 5, "n", 1.5)}
    assert sum(r.row.vec_id is None for r in found) >= 2 and {r.n for r in found} == {30}


def test_query_equals_numpy_on_all_embeddings(spark):
    folder = str(TESTDATA / "sf0.001")
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    ids = sorted(rows)
    expected = brute([rows[i] for i in ids])
    check(QUERIES["op12_embedding_whitening"](spark, folder).collect(), {ids[i]: e for i, e in expected.items()})


def test_factor_and_rotations():
    r = np.random.default_rng(5)
    for size, rank in [(1, 1), (2, 2), (5, 3), (16, 16), (33, 20), (64, 64)]:
        a = r.normal(size=(size, rank)) @ np.diag(np.geomspace(1, 1e-4, rank))
        v = a @ a.T
        order, factor = pivoted_cholesky(v)
        assert np.allclose((factor @ factor.T), v[np.ix_(order, order)], atol=1e-12)
        assert (np.diff(factor.diagonal()[: factor.shape[1]]) <= 1e-15).all() and np.allclose(factor, np.tril(factor))
        g = jacobi_columns(factor)
        products = g.T @ g
        assert np.abs(products - np.diag(products.diagonal())).max() <= 1e-13 * products.max()
        values, axes = eigen(v)
        assert np.allclose(values[:rank], np.linalg.eigvalsh(v)[::-1][: len(values[:rank])], rtol=1e-6, atol=1e-14)
        assert np.allclose(axes @ axes.T, np.eye(len(axes)), atol=1e-6)


def test_small_eigenvalues_keep_their_digits():
    d = np.diag([1e6, 1.0, 1e-6])
    values, axes = eigen(d)
    assert np.allclose(values, [1e6, 1.0, 1e-6], rtol=1e-14) and np.allclose(axes, np.eye(3))


def test_deviations_beyond_64_bits():
    x = np.array([[5, -3], [2**20, 1]], np.int64)
    sums = np.array([7, 11], np.int64)
    for n in (3, 10**9, 10**14):
        exact = [sum((n * a - s) ** 2 for a, s in zip(row, [7, 11])) for row in x.tolist()]
        assert whitening._deviations(x, n, sums) == [e if e < 2**63 else None for e in exact]
