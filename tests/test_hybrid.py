"""Fusion with thresholds against scores of all documents."""

import math
import random

import numpy as np
import pytest

from quarry.functions.vectors import NORM_EPS
from quarry.operators import bm25, hybrid

TRIALS = [(1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.5, 0.5, 0.9), (0.4, 0.0, 0.2)]


def data(spark, seed, n=60, dim=4):
    rng, rnd = np.random.default_rng(seed), random.Random(seed)
    docs = {f"d{i:03d}.txt": " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 12))) for i in range(n)}
    corpus = spark.createDataFrame(list(docs.items()), "path string, text string")
    x = {p: [float(np.float32(v)) for v in rng.integers(-3, 4, dim)] for p in docs}
    vectors = spark.createDataFrame([(p, v) for p, v in x.items()], "id string, embedding array<float>")
    q = {i: " ".join(rnd.choice("abcxyz") for _ in range(3)) for i in range(6)}
    qv = {i: [float(np.float32(v)) for v in rng.integers(-3, 4, dim)] for i in q}
    return (corpus, vectors, spark.createDataFrame(list(q.items()), "qid long, query string"),
            spark.createDataFrame(list(qv.items()), "qid long, embedding array<float>"), x, qv)


def brute(index, queries, x, qv, k, trials):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) + NORM_EPS)
    kw = {}
    for r in bm25.bm25_scores(index, queries).collect():
        if round(r["score"], 6) > 0:
            kw.setdefault(r["qid"], {})[r["path"]] = round(r["score"], 6)
    out = []
    for i in qv:
        most = max(kw.get(i, {0: 1.0}).values())
        for t, (w, ta, tb) in enumerate(trials):
            rows = []
            for p in x:
                a = kw.get(i, {}).get(p, 0.0) / most
                b = round(float(unit(x[p]) @ unit(qv[i])), 6)
                a, b = a if a > 0 and a >= ta else 0.0, b if b > 0 and b >= tb else 0.0
                score = math.floor((w * a + (1 - w) * b) * 1e6 + 0.001) / 1e6
                if score > 0:
                    rows.append((-score, p))
            out += [(t, i, p, -s, n + 1) for n, (s, p) in enumerate(sorted(rows)[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed,depth", [(1, None), (2, 1)])
def test_equal_to_scores_of_all_documents(spark, seed, depth):
    corpus, vectors, q, qv, x, qx = data(spark, seed)
    index = bm25.build_index(corpus).materialize()
    got = hybrid.fused_top_k(index, vectors, q, qv, 4, TRIALS, depth=depth)
    want = brute(index, q, x, qx, 4, TRIALS)
    rows = sorted((r["trial_id"], r["qid"], r["id"], r["score"], r["rank"]) for r in got.collect())
    assert [r[:3] + r[4:] for r in rows] == [r[:3] + r[4:] for r in want]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(rows, want))


def test_bad_input_and_no_queries(spark):
    corpus, vectors, q, qv, _, _ = data(spark, 3, n=5)
    index = bm25.build_index(corpus).materialize()
    with pytest.raises(ValueError, match="topk must be positive"):
        hybrid.fused_top_k(index, vectors, q, qv, 0, TRIALS)
    with pytest.raises(ValueError, match="weight"):
        hybrid.fused_top_k(index, vectors, q, qv, 1, [(2.0, 0, 0)])
    assert hybrid.fused_top_k(index, vectors, q.limit(0), qv.limit(0), 3, TRIALS).count() == 0
