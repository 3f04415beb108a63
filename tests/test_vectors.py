import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import index as IX
from quarry.operators import vectors as V
from quarry.operators.semantic import HashingEmbedder, semantic_search
from conftest import corpus_df


def vec_df(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id string, embedding array<float>")


def q_df(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "qid long, embedding array<float>")


def test_search_and_round_trip(spark, tmp_path):
    idx = V.build_vectors(vec_df(spark, [("a", [.9, .1, 0, 0]), ("b", [0, .8, .2, 0]), ("c", [.1, .1, .7, .1])]), 4)
    q = q_df(spark, [(0, [1, 0, 0, 0])])
    before = V.vector_search(idx, q, 2, dim=4).orderBy("rank").collect()
    assert [r.id for r in before] == ["a", "c"]
    V.save_vectors(idx, str(tmp_path / "v"))
    after = V.vector_search(V.load_vectors(spark, str(tmp_path / "v")), q, 2, dim=4).orderBy("rank").collect()
    assert [r.id for r in after] == [r.id for r in before]
    assert all(abs(a.score - b.score) < 1e-6 for a, b in zip(before, after))
    # reference value: cosine of a with the unit query
    a = np.array([.9, .1, 0, 0], dtype=np.float32)
    assert abs(before[0].score - float(a[0] / (np.linalg.norm(a) + 1e-9))) < 1e-6


def test_append_and_duplicates(spark, tmp_path):
    base = V.build_vectors(vec_df(spark, [("base", [1, 0])]), 2)
    new = V.build_vectors(vec_df(spark, [("new", [0, 1])]), 2)
    idx = V.append_vectors(base, new)
    got = V.vector_search(idx, q_df(spark, [(0, [0, 1])]), 2, dim=2).orderBy("rank").collect()
    assert [r.id for r in got] == ["new", "base"]
    dup = V.append_vectors(idx, new)
    assert V.vector_search(dup, q_df(spark, [(0, [0, 1])]), 3, dim=2).count() == 3
    V.save_vectors(base, str(tmp_path / "v"))
    V.save_vectors(new, str(tmp_path / "v"), mode="append")
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2


def test_topk_must_be_positive(spark):
    idx = V.build_vectors(vec_df(spark, [("a", [1, 0])]), 2)
    with pytest.raises(ValueError, match="topk must be positive"):
        V.vector_search(idx, q_df(spark, [(0, [1, 0])]), 0, dim=2)


def test_zero_vector_scores_zero_and_ties_by_id(spark):
    idx = V.build_vectors(vec_df(spark, [("z", [0, 0]), ("b", [1, 0]), ("a", [1, 0])]), 2)
    got = V.vector_search(idx, q_df(spark, [(0, [1, 0])]), 3, dim=2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("a", 1.0), ("b", 1.0), ("z", 0.0)]


def test_wrong_dimension_fails(spark):
    idx = V.build_vectors(vec_df(spark, [("a", [1, 0, 0])]), 2)
    with pytest.raises(Exception, match="dimension"):
        idx.collect()


def test_many_partitions_match_numpy(spark):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(300, 8)).astype(np.float32)
    qs = rng.normal(size=(5, 8)).astype(np.float32)
    idx = vec_df(spark, [(f"v{i:03d}", v) for i, v in enumerate(vecs)]).repartition(7)
    got = V.vector_search(idx, q_df(spark, list(enumerate(qs))), 10, dim=8).collect()
    nv = vecs / (np.linalg.norm(vecs.astype(np.float64), axis=1, keepdims=True) + 1e-9)
    nq = qs / (np.linalg.norm(qs.astype(np.float64), axis=1, keepdims=True) + 1e-9)
    s = nq @ nv.T
    for qi in range(5):
        order = sorted(range(300), key=lambda j: (-round(float(s[qi, j]), 6), f"v{j:03d}"))[:10]
        mine = [r.id for r in sorted((r for r in got if r.qid == qi), key=lambda r: r["rank"])]
        assert mine == [f"v{j:03d}" for j in order]


class ToyEmbedder:
    name = "toy"
    dimension = 3

    def embed(self, texts):
        return np.array([[("sort" in t.lower()) * 1.0, ("config" in t.lower()) * 1.0,
                          ("database" in t.lower()) * 1.0] for t in texts], dtype=np.float32)


DOCS = {"sorting.py": "def sort_numbers(xs): return sorted(xs)",
        "config.py": "CONFIG = {'debug': True}",
        "database.py": "def connect_database(): pass"}


def test_semantic_search_toy_embedder(spark):
    q = spark.createDataFrame([(0, "How do we sort numbers?")], "qid long, query string")
    got = semantic_search(corpus_df(spark, DOCS), q, ToyEmbedder(), 2).orderBy("rank").collect()
    assert got[0].path == "sorting.py"
    assert semantic_search(corpus_df(spark, DOCS), q, ToyEmbedder(), 0).count() == 0


def test_hashing_embedder_is_deterministic():
    e = HashingEmbedder(16)
    assert (e.embed(["a b a"]) == e.embed(["a b a"])).all() and e.embed(["a b a"]).sum() == 3


def test_vector_index_build_then_reuse(spark, tmp_path):
    base = str(tmp_path / "vi")
    c = corpus_df(spark, DOCS)
    v1 = IX.ensure_vector_index(spark, base, c, ToyEmbedder())
    assert v1.count() == 3
    calls = []

    class Counting(ToyEmbedder):
        def embed(self, texts):
            calls.append(len(texts))
            return super().embed(texts)
    v2 = IX.ensure_vector_index(spark, base, c, Counting())   # same name/dim -> reuse, no embedding
    assert v2.count() == 3 and calls == []

    class Other(ToyEmbedder):
        name = "other"
    v3 = IX.ensure_vector_index(spark, base, c, Other())      # different embedder -> rebuild
    assert v3.count() == 3
    assert IX.vector_registry(spark, base)["embedder"] == "other"


def test_vector_index_refresh_embeds_only_changes(spark, tmp_path):
    base, log = str(tmp_path / "vi"), str(tmp_path / "log")
    os.makedirs(log)

    class Counting(ToyEmbedder):
        def embed(self, texts):
            for t in texts:
                with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                    f.write(t)
            return super().embed(texts)

    def corpus(docs):
        return spark.createDataFrame([(p, t, len(t), 1) for p, t in docs.items()], "path string, text string, size long, mtime_ns long")

    IX.ensure_vector_index(spark, base, corpus(DOCS), Counting())
    assert len(os.listdir(log)) == 3
    docs = {k: v for k, v in DOCS.items() if k != "config.py"} | {"sorting.py": "no longer", "zz.py": "sort more"}
    vecs = IX.ensure_vector_index(spark, base, corpus(docs), Counting())
    assert sorted(r.id for r in vecs.collect()) == ["database.py", "sorting.py", "zz.py"]
    seen = sorted(open(os.path.join(log, f)).read() for f in os.listdir(log))
    assert len(seen) == 5 and "no longer" in seen and "sort more" in seen
    q = spark.createDataFrame([("q", "sort")], "qid string, query string")
    got = semantic_search(None, q, ToyEmbedder(), 1, vectors=vecs).first()
    assert (got.qid, got.path) == ("q", "zz.py")


def test_query_blocks_string_ids_and_ties(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    monkeypatch.setattr(V, "ROW_BLOCK", 7)
    rows = [(f"v{i:02d}", [1.0, 0.0]) for i in range(40)] + [("best", [0.0, 1.0])]
    q = spark.createDataFrame([(f"q{i}", [1.0, 0.0]) for i in range(5)] + [("other", [0.0, 1.0])], "qid string, embedding array<float>")
    got = V.vector_search(vec_df(spark, rows).repartition(3), q, 3, dim=2).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.qid, []).append(r.id)
    assert by == {**{f"q{i}": ["v00", "v01", "v02"] for i in range(5)}, "other": ["best", "v00", "v01"]}


def test_replace_overwrites(spark, tmp_path):
    a = V.build_vectors(vec_df(spark, [("a", [1, 0])]), 2)
    b = V.build_vectors(vec_df(spark, [("b", [0, 1])]), 2)
    V.save_vectors(a, str(tmp_path / "v"))
    V.save_vectors(b, str(tmp_path / "v"), mode="overwrite")
    assert [r.id for r in V.load_vectors(spark, str(tmp_path / "v")).collect()] == ["b"]


def test_vector_search_limits_per_task_before_shuffle(spark):
    idx = V.build_vectors(vec_df(spark, [(f"v{i}", [float(i), 1.0]) for i in range(50)]), 2)
    plan = V.vector_search(idx, q_df(spark, [(0, [1, 0])]), 3, dim=2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "MapInArrow" in plan


def test_rows_without_a_vector_take_no_part(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "qid long, embedding array<float>")
    got = [(r["qid"], r["id"], r["rank"]) for r in V.vector_search(v, q, 5).collect()]
    assert sorted(got) == [(7, 1, 1), (7, 3, 2)]
    assert V.vector_search(v.where("id = 2"), q, 5).count() == 0


def test_store_is_loaded_changed_and_saved_in_place(spark):
    from quarry.operators.vectors import append_vectors, build_vectors, load_vectors, save_vectors
    from quarry.session import scratch_path
    path = scratch_path(spark, "vectors")
    one = build_vectors(spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>"), 2)
    save_vectors(one, path)
    two = build_vectors(spark.createDataFrame([(2, [0.0, 1.0])], "id long, embedding array<float>"), 2)
    save_vectors(append_vectors(load_vectors(spark, path), two), path)
    save_vectors(load_vectors(spark, path).where("id = 2"), path, mode="append")
    assert sorted(r["id"] for r in load_vectors(spark, path).collect()) == [1, 2, 2]
    save_vectors(load_vectors(spark, path).where("id = 1"), path)
    assert [r["id"] for r in load_vectors(spark, path).collect()] == [1]
