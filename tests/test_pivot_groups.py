"""Queries travel once to a group of chunks, not to each chunk."""

from __future__ import annotations

import numpy as np

import quarry.session
from quarry.operators import pivots as P
from quarry.operators.vectors import vector_search


def test_vectors_without_clusters(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(5).normal(size=(1500, 12)).round(1)
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>").cache()
    index = P.build(vectors, str(tmp_path / "pivots"), 12)
    monkeypatch.setattr(P, "GROUPS", 4)
    monkeypatch.setattr(P, "CHUNK_ROWS", 10)
    written, cut = [], quarry.session.cut_lineage

    def counted(df):
        out = cut(df)
        if "embedding" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(quarry.session, "cut_lineage", counted)
    queries = vectors.withColumnRenamed("id", "qid")
    got = P.search(index, queries, 3)
    assert sum(written) <= 1500 * (2 + 5)      # before: a row per query and chunk
    assert got.pairs.count() > 10 * 1500
    rows = lambda df: sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in df.collect())
    assert rows(got.hits) == rows(vector_search(vectors, queries, 3))
