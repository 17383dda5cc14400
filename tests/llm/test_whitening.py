"""Embedding whitening against numpy's eigenvectors, and its edge cases."""

import math

import numpy as np
import pytest

from rollcall.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component string, ids int"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)


def plain(vectors):
    """(integer rows, n, eigenvalues falling, eigenvectors) of float32 vectors."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], np.int64)
    centred = x - x.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / len(x))
    return x, e[::-1], v[:, ::-1]


def check(got, ids, vectors, k):
    x, e, v = plain(vectors)
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c, rows in by.items():
        rows.sort(key=lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation))
        place = sorted(range(n), key=lambda i: (ids[i] is None, ids[i] or 0, sum((n * int(a) - s) ** 2 for a, s in zip(x[i], sums))))
        assert [r.vec_id for r in rows] == [ids[i] for i in place]
        assert [r.deviation for r in rows] == [sum((n * int(a) - s) ** 2 for a, s in zip(x[i], sums)) for i in place]
        want = ((x - x.mean(axis=0)) @ v[:, c - 1] / math.sqrt(e[c - 1]))[place]
        have = np.array([r.whitened for r in rows])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-8
        assert all(r.n == n and abs(r.explained - e[c - 1] / e.sum()) < 1e-10 and r.identity_error < 1e-9 for r in rows)


def test_whitening_like_numpy(spark):
    rng = np.random.default_rng(3)
    basis = rng.standard_normal((12, 12)) * np.linspace(2, 0.2, 12)[:, None]
    vectors = [[float(np.float32(c)) for c in row] for row in rng.standard_normal((700, 12)) @ basis / 8]
    vectors += [vectors[0]] * 300                                               # a common vector
    ids = [None if i % 90 == 3 else i // 2 for i in range(1000)]                # null and repeated ids
    bad = [(5000, None), (5001, [None] * 12), (5002, [float("nan")] + [0.0] * 11), (5003, [float("inf")] * 12), (5004, []), (5005, [1.0] * 5)]
    df = make(spark, [*zip(ids, vectors), *bad]).repartition(7)
    got = whitening.whiten(spark, df, "vec_id", "embedding").withColumnRenamed("id", "vec_id").collect()
    check(got, ids, vectors, 8)


def test_registered_query_like_numpy(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = whitening.op11_embedding_whitening(spark, sf).collect()
    check(got, [r.vec_id for r in rows], [r.embedding for r in rows], 8)


def test_fewer_dimensions_and_equal_values(spark):
    # Rank 2, both eigenvalues alike: any orthonormal pair will do.
    square = [[1.0, 0.0, 5.0], [-1.0, 0.0, 5.0], [0.0, 1.0, 5.0], [0.0, -1.0, 5.0]]
    got = whitening.whiten(spark, make(spark, list(enumerate(square))), "vec_id", "embedding").collect()
    assert sorted({r.component for r in got}) == [1, 2] and len(got) == 8
    assert all(abs(r.explained - 0.5) < 1e-12 and r.identity_error < 1e-12 for r in got)
    y = np.array([[r.whitened for r in sorted(got, key=lambda r: r.id) if r.component == c] for c in (1, 2)])
    assert np.allclose(y @ y.T / 4, np.eye(2))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]])
def test_nothing_to_whiten(spark, rows):
    df = whitening.whiten(spark, make(spark, rows), "vec_id", "embedding")
    assert df.collect() == [] and df.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_deviations(spark):
    x = np.array([[1 << 40, 0], [0, 1 << 20]])
    assert whitening._deviations(x, 3, [1 << 40, 1 << 20]) == [None, None]
    assert whitening._deviations(x[1:], 1, [0, 0]) == [1 << 40]


def test_many_partial_sums(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_PARTS", 2)
    rng = np.random.default_rng(4)
    vectors = [[float(np.float32(c)) for c in row] for row in rng.standard_normal((60, 9))]
    df = make(spark, list(enumerate(vectors))).repartition(6)
    check(whitening.whiten(spark, df, "vec_id", "embedding").withColumnRenamed("id", "vec_id").collect(), list(range(60)), vectors, 8)
