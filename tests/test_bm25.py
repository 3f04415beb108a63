import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import corpus_df
from quarry.operators import bm25


def tokens(t):
    return [m.lower() for m in re.findall(r"[A-Za-z0-9_]+", t)]


def model(docs, query, k, digits=6):
    """Brute-force ranking: every document scored, ties by path, idf floor."""
    toks = {p: tokens(t) for p, t in docs.items()}
    toks = {p: t for p, t in toks.items() if t}
    q = tokens(query)
    if not toks or not q or k <= 0:
        return []
    n = len(toks)
    avgdl = sum(len(t) for t in toks.values()) / n
    df = Counter(term for t in toks.values() for term in set(t))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: (0.25 * mean if v < 0 else v) for t, v in idf.items()}
    scores = {}
    for p, t in toks.items():
        tf = Counter(t)
        s = 0.0
        for term in q:
            f = tf.get(term, 0)
            s += idf.get(term, 0.0) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avgdl))
        scores[p] = round(s, digits)
    ranked = sorted(scores, key=lambda p: (-scores[p], p))[: min(k, n)]
    return [(p, scores[p]) for p in ranked]


def search(spark, docs, queries, k, materialize=False):
    idx = bm25.build_index(corpus_df(spark, docs))
    if materialize:
        idx = idx.materialize()
    q = spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
    rows = bm25.bm25_search(idx, q, k=k).collect()
    out = {i: [] for i in range(len(queries))}
    for r in sorted(rows, key=lambda r: (r.qid, r["rank"])):
        out[r.qid].append((r.path, r.score))
    return out


RANKING = {
    "alpha.txt": "Sorting numbers in ascending order.",
    "beta.txt": "Utility helpers for configuration loading.",
    "ranking.txt": "BM25 ranking algorithms score documents for keyword search. Ranking is repeated.",
}


def test_best_file_first(spark):
    got = search(spark, RANKING, ["ranking search algorithm"], 3)[0]
    assert got[0][0] == "ranking.txt" and got[0][1] > 0
    assert got == model(RANKING, "ranking search algorithm", 3)


def test_k_honoured_and_negative_scores_kept(spark):
    docs = {"first.txt": "alpha beta gamma", "second.txt": "alpha beta"}
    got = search(spark, docs, ["alpha"], 1)[0]
    assert len(got) == 1 and got[0][1] < 0
    assert got == model(docs, "alpha", 1)


def test_single_document(spark):
    docs = {"notes.txt": "Keyword driven search tooling."}
    got = search(spark, docs, ["keyword"], 5)[0]
    assert [p for p, _ in got] == ["notes.txt"] and isinstance(got[0][1], float)


def test_no_query_tokens_and_k_zero(spark):
    assert search(spark, RANKING, ["!!!"], 3)[0] == []
    q = spark.createDataFrame([(0, "ranking")], "qid long, query string")
    assert bm25.bm25_search(bm25.build_index(corpus_df(spark, RANKING)), q, k=0).count() == 0


def test_unknown_term_ranks_all_documents_by_path(spark):
    got = search(spark, RANKING, ["zzz"], 2)[0]
    assert got == [("alpha.txt", 0.0), ("beta.txt", 0.0)]


@pytest.mark.parametrize("seed", range(6))
def test_random_corpora_match_model(spark, seed):
    rnd = random.Random(seed)
    vocab = ["a", "b", "c", "d", "e", "f", "g"][: rnd.randint(2, 7)]
    docs = {f"d{i:02d}.txt": " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 8)))
            for i in range(rnd.randint(1, 9))}
    queries = [" ".join(rnd.choice(vocab + ["zz"]) for _ in range(rnd.randint(1, 4))) for _ in range(4)]
    k = rnd.randint(1, 10)
    got = search(spark, docs, queries, k, materialize=(seed % 2 == 0))
    for i, q in enumerate(queries):
        assert got[i] == model(docs, q, k), (docs, q, k)


def test_index_write_read_round_trip(spark, tmp_path):
    idx = bm25.build_index(corpus_df(spark, RANKING))
    stored = idx.write(str(tmp_path / "idx"))
    q = spark.createDataFrame([(0, "ranking search")], "qid long, query string")
    a = sorted(bm25.bm25_search(idx, q, k=3).collect())
    b = sorted(bm25.bm25_search(stored, q, k=3).collect())
    assert a == b


def test_path_ordinal_is_dense_and_sorted(spark):
    df = spark.createDataFrame([(f"p{i:03d}", i) for i in range(57)], "path string, dl int")
    rows = bm25.with_path_ordinal(df, partitions=5).orderBy("prank").collect()
    assert [r.prank for r in rows] == list(range(1, 58))
    assert [r.path for r in rows] == sorted(r.path for r in rows)


def test_indexable_filter(spark):
    docs = {".hidden/a.txt": "word", "b.txt": "word", "c.txt": "!!!", "d.txt": "has\x00nul", "e.txt": "x" * 20}
    c = corpus_df(spark, docs)
    kept = {r.path for r in bm25.indexable_documents(c, max_bytes=10).collect()}
    assert kept == {"b.txt"}
    sem = {r.path for r in bm25.indexable_documents(c, max_bytes=10, require_tokens=False).collect()}
    assert sem == {"b.txt", "c.txt"}


def test_plan_broadcasts_query_terms_and_limits_per_query(spark):
    idx = bm25.build_index(corpus_df(spark, RANKING)).materialize()
    q = spark.createDataFrame([(0, "ranking")], "qid long, query string")
    plan = bm25.bm25_search(idx, q, k=2)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert "WindowGroupLimit" in plan


def test_custom_tokenizer(spark):
    from pyspark.sql import functions as F
    words = lambda c: F.filter(F.split(F.lower(c), " "), lambda x: x != "")
    docs = {"a.txt": "Foo-bar baz", "b.txt": "foo bar", "c.txt": "qux", "d.txt": "foo"}
    q = spark.createDataFrame([(0, "foo-bar")], "qid long, query string")
    got = bm25.bm25_search(corpus_df(spark, docs), q, k=1, tokenizer=words).first()
    assert got.path == "a.txt" and got.score > 0


def test_fill_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(bm25, "FILL_CHUNK", 3)
    docs = {f"d{i:02d}.txt": ("rare" if i == 7 else "common words here") for i in range(12)}
    assert search(spark, docs, ["rare"], 5)[0] == model(docs, "rare", 5)
    assert search(spark, docs, ["rare"], 50)[0] == model(docs, "rare", 50)


def test_no_size_cap_unless_asked(spark):
    docs = {"big.txt": "word " * 150_000, "small.txt": "word"}
    assert bm25.build_index(corpus_df(spark, docs)).lengths.count() == 2
    assert [r.path for r in bm25.build_index(corpus_df(spark, docs), max_bytes=1000).lengths.collect()] == ["small.txt"]


def test_scores_need_no_exchange_after_the_index(spark):
    idx = bm25.build_index(corpus_df(spark, RANKING)).materialize()
    q = spark.createDataFrame([(0, "ranking search")], "qid long, query string")
    plan = bm25.bm25_scores(idx, q, query_rows=2)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path" not in plan, plan


def test_stored_search_prunes_the_postings_scan(spark, tmp_path):
    stored = bm25.build_index(corpus_df(spark, RANKING)).write(str(tmp_path / "idx"))
    q = spark.createDataFrame([(0, "ranking")], "qid long, query string")
    plan = bm25.bm25_scores(stored, q)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "FileScan" in x and "bucket#" in x)
    assert "PartitionFilters: [isnotnull(bucket" in scan and "EqualTo(term,ranking)" in scan


def test_duplicate_paths_fail_loudly(spark):
    df = spark.createDataFrame([("a.txt", "x y"), ("a.txt", "z"), ("b.txt", "w")], "path string, text string")
    with pytest.raises(ValueError, match="duplicate path in corpus: a.txt"):
        bm25.build_index(df, check_unique=True)
    assert bm25.build_index(corpus_df(spark, RANKING), check_unique=True).postings.count() > 0


def test_stored_index_pushes_prefix_bound_into_scan(spark, tmp_path):
    stored = bm25.build_index(corpus_df(spark, RANKING)).write(str(tmp_path / "idx"))
    plan = bm25.leading_paths(stored, 2)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(prank,2)" in plan
    assert [r.path for r in bm25.leading_paths(stored, 2).orderBy("prank").collect()] == ["alpha.txt", "beta.txt"]
