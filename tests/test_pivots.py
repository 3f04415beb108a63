"""Pivot partitions: equal to the plain search, and most chunks left out."""

import numpy as np
import pytest

from quarry.operators import pivots as P
from quarry.operators import vectors as V
from quarry.session import scratch_path


def frame(spark, x, kind="long"):
    return spark.createDataFrame([(i if kind == "long" else f"v{i:05d}", [float(a) for a in r]) for i, r in enumerate(x)], f"id {kind}, embedding array<float>")


def asked(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "qid long, embedding array<float>")


def rows(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())


def clustered(rng, n, dim, centers):
    c = rng.normal(size=(centers, dim))
    return c[rng.integers(centers, size=n)] + rng.normal(scale=0.05, size=(n, dim))


def test_clustered_vectors_equal_and_pruned(spark):
    rng = np.random.default_rng(1)
    x = clustered(rng, 1500, 8, 30)
    q = clustered(rng, 40, 8, 5)
    index = P.build(frame(spark, x), scratch_path(spark, "pivots"), 8)
    got = P.search(index, asked(spark, q), 5)
    assert rows(got.hits) == rows(V.vector_search(frame(spark, x), asked(spark, q), 5, dim=8))
    chunks = index.chunks.count()
    held = got.pairs.count()
    assert chunks > 20 and held < 0.4 * chunks * 40
    assert got.pairs.distinct().count() == held


def test_queries_near_stored_vectors_see_few_chunks(spark):
    rng = np.random.default_rng(2)
    x = clustered(rng, 1500, 8, 40)
    index = P.build(frame(spark, x, "string"), scratch_path(spark, "pivots"), 8)
    got = P.search(index, asked(spark, x[:50]), 3)
    assert rows(got.hits) == rows(V.vector_search(frame(spark, x, "string"), asked(spark, x[:50]), 3, dim=8))
    assert got.pairs.count() < 0.2 * index.chunks.count() * 50


@pytest.mark.parametrize("k", [1, 7, 500])
def test_ties_copies_zeros_nulls_and_small_blocks(spark, monkeypatch, k):
    monkeypatch.setattr(P, "CHUNK_ROWS", 10)
    monkeypatch.setattr(P, "QUERY_ROWS", 4)
    rng = np.random.default_rng(3)
    x = np.concatenate([np.ones((60, 4)), np.zeros((5, 4)), rng.normal(size=(40, 4)), -np.ones((3, 4))])
    q = np.concatenate([np.ones((6, 4)), np.zeros((1, 4)), rng.normal(size=(6, 4))])
    v, a = frame(spark, x), asked(spark, q)
    none = spark.createDataFrame([(900, None)], "id long, embedding array<float>")
    index = P.build(v.unionByName(none), scratch_path(spark, "pivots"), 4)
    got = P.search(index, a.unionByName(none.withColumnRenamed("id", "qid")), k)
    assert rows(got.hits) == rows(V.vector_search(v, a, k, dim=4))


def test_empty_index_empty_queries_and_bad_input(spark):
    v = frame(spark, np.ones((3, 2)))
    empty = P.build(v.limit(0), scratch_path(spark, "pivots"), 2)
    assert P.search(empty, asked(spark, np.ones((2, 2))), 3).hits.count() == 0
    index = P.build(v, scratch_path(spark, "pivots"), 2)
    assert P.search(index, asked(spark, np.ones((2, 2))).limit(0), 3).hits.count() == 0
    with pytest.raises(ValueError, match="topk must be positive"):
        P.search(index, asked(spark, np.ones((2, 2))), 0)
    with pytest.raises(Exception, match="dimension mismatch"):
        P.search(index, asked(spark, np.ones((2, 3))), 1)
