"""Dual-tree search against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import cover_tree as C


def brute(rows, k=10, scale=1024):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[(i, tuple(math.floor(scale * float(x)) for x in v))] = True
    out = set()
    for i, q in good:
        if i % 100 == 0 and q:
            cut = 2**63 - 1
            best = sorted((-min(max(sum(a * b for a, b in zip(q, x)), -cut), cut), j) for j, x in good if j != i and len(x) == len(q))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def result(df):
    return {tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()}


@pytest.mark.parametrize("seed", range(12))
def test_kernel(seed):
    rng = np.random.default_rng(seed)
    n, d = int(rng.integers(1, 900)), int(rng.integers(1, 20))
    x = np.floor(rng.normal(size=(n, d)) * rng.choice([1, 5, 300]))
    x[:n // 3] = x[0]
    x[n // 2:] = x[n // 2] + np.floor(rng.normal(size=(n - n // 2, d)) * 2)
    ids = np.sort(rng.choice(10000, n, replace=False))
    qi = rng.choice(n, min(n, 60), replace=False)
    s = C.Search(x[qi], ids[qi], x, ids, 10)
    s.run()
    for r, i in enumerate(qi):
        best = sorted((-int(x[i] @ x[j]), int(ids[j])) for j in range(n) if j != i)[:10]
        assert [(-a, b) for a, b in zip(s.score[r].tolist(), s.found[r].tolist()) if b != np.iinfo(np.int64).max] == best


def test_tree_covers_and_separates():
    x = np.random.default_rng(1).normal(size=(700, 6))
    seen = []

    def walk(node):
        rows = C.Search(x, None, x, None, 1).rows_of(node)
        assert (np.linalg.norm(x[rows] - node.center, axis=1) <= node.radius + 1e-9).all()
        seen.extend(node.points.tolist())
        for a, p in enumerate(node.kids):
            for q in node.kids[a + 1:]:
                assert np.linalg.norm(p.center - q.center) > node.radius / 4
            walk(p)
    walk(C.build(x))
    assert sorted(seen) == list(range(700))


def test_given_vectors_small_blocks(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = C.top_k(df, F.col("vec_id") % 100 == 0, block_rows=64, query_rows=2)
    assert result(got) == brute(rows)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (None, [1.0, 1.0]), (100, [0.5]), (101, [0.25]), (200, []), (300, [-1.0, -0.0005]), (7, [3.0, 4.0]), (400, [1e17, 2.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, block int")
    assert result(C.top_k(df, F.col("vec_id") % 100 == 0)) == brute(rows)
    assert C.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
