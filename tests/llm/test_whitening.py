"""Embedding whitening against numpy and whole-number arithmetic."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from causaria.llm import queries, whitening
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors):
    """x, n, S and V in exact fractions, rounded once."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    d = [[Fraction(c) - Fraction(t, n) for c, t in zip(r, s)] for r in x]
    v = [[float(sum(r[i] * r[j] for r in d) / n) for j in range(len(s))] for i in range(len(s))]
    return x, n, s, np.array(v)


def frame(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in ("n", "whitened", "component", "deviation", "Embedding")])


@pytest.mark.parametrize("n, dims", [(60, 5), (40, 12), (3, 9)])
def test_components_against_numpy(spark, n, dims):
    rng = np.random.default_rng(n)
    vectors = (rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) * 2.0 ** -np.arange(dims)).astype(np.float32)
    x, n, s, v = plain(vectors)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    d = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(vectors)], SCHEMA)
    got = whitening.components(d).collect()
    k = min(8, dims)
    assert len(got) == n * k
    live = int((e > 1e-9 * e[0]).sum())
    for r in got:
        c = r.component - 1
        assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(x[r.vec_id], s))
        assert r.explained == pytest.approx(max(e[c], 0) / np.trace(v), rel=1e-9, abs=1e-12)
        if c < live:
            want = sum((a - b / n) * w for a, b, w in zip(x[r.vec_id], s, u[:, c])) / np.sqrt(e[c])
            assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-6, abs=1e-6)
        else:
            assert r.whitened is None
        assert r.identity_error < 1e-9


def test_what_is_dropped_and_what_counts_twice(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [0.5, 0.25]), (9, [1e30, 0.0])]
    got = whitening.components(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in got) == [(False, 1)] * 4 + [(False, 2)] * 2 + [(True, None)] * 2
    assert {r.n for r in got} == {4}
    assert len({(r.component, r.whitened) for r in got if r.vec_id == 1}) == 2


def test_equal_rows_have_no_variance_and_no_rows_give_none(spark):
    got = whitening.components(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA)).collect()
    assert len(got) == 10 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error is None for r in got)
    empty = whitening.components(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0


def test_columns_that_clash(spark):
    rows = [(i, [float(i), float(i * i % 7)]) for i in range(6)]
    a = whitening.components(frame(spark, rows)).collect()
    b = whitening.components(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert sorted(a) == sorted(b)


def test_large_entries_stay_exact(spark):
    big = [float(2**40), float(-(2**41)), float(2**39), 1.0]
    df = spark.createDataFrame([(i, [v, 1.0 / (i + 1)], 0) for i, v in enumerate(big)], "vec_id long, embedding array<double>, label int")
    model = whitening.fit(df)
    x, n, s, v = plain([[b, 1.0 / (i + 1)] for i, b in enumerate(big)])
    assert model.sums == s
    assert model.values[0] == pytest.approx(np.linalg.eigvalsh(v)[-1])
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(df, model).collect()}
    assert got == {i: sum((n * a - b) ** 2 for a, b in zip(r, s)) for i, r in enumerate(x)}
    assert {r.deviation for r in whitening.components(df).collect()} == {d if d < 2**63 else None for d in got.values()}


def test_jacobi_keeps_small_eigenvalues_accurate():
    # A graded matrix whose eigenvalues are known to relative accuracy: D A D with A near the identity.
    d = 10.0 ** -np.arange(0, 12, 2)
    a = np.eye(6) + 0.1 * np.cos(np.arange(36).reshape(6, 6))
    a = (a + a.T) / 2
    values, vectors = whitening.jacobi(d[:, None] * a * d)
    # The determinant is a product of tiny values: lost if any is inaccurate.
    assert np.prod(values) == pytest.approx(np.prod(d) ** 2 * np.linalg.det(a), rel=1e-9)
    assert np.allclose(vectors @ vectors.T, np.eye(6), atol=1e-14)
    assert (np.diff(values) <= 0).all()


def test_partitions_do_not_matter(spark):
    df = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet")
    a, b = whitening.fit(df), whitening.fit(df.repartition(7))
    assert a.sums == b.sums and (a.values == b.values).all() and (a.vectors == b.vectors).all()


def test_query(spark):
    got = queries.op11_whitening(spark, f"{DATA}/sf0.001")
    assert got.count() == 8 * spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").count()
    assert got.agg(F.max("identity_error")).first()[0] < 1e-10
