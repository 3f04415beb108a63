"""Scores of documents where their rows lie: blocks, repeated paths, short lists."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import bm25


def texts(n, seed=1):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(["The", "the", "cat", "a_1", "Zug", "über", "x", "KKq", f"w{rnd.randrange(40)}"]) for _ in range(rnd.randrange(1, 30)))
            for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    # Every fifth path comes twice, with other words.
    rows = [(f"d/{i // 6 * 5 + min(i % 6, 4)}.txt", t) for i, t in enumerate(texts(300))]
    return spark.createDataFrame(rows, "path string, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "the cat"), (2, "w1 w2 w3"), (2, "zug"), (None, "x k"), (4, "nowhere")], "qid long, query string")


def words(t):
    return [w.lower() for w in re.findall("[A-Za-z0-9_]+", t)]


def asked(queries):
    out = {}
    for r in queries.collect():
        out.setdefault(r["qid"], Counter()).update(words(r["query"]))
    return out


def test_term_counts_equal_a_dictionary(spark, corpus):
    got = Counter({(r["path"], r["term"], r["tf"], r["dl"]): r["count"] for r in bm25.build_index(corpus).postings.groupBy("path", "term", "tf", "dl").count().collect()})
    want = Counter()
    for r in corpus.collect():
        w = words(r["text"])
        want.update((r["path"], t, n, len(w)) for t, n in Counter(w).items())
    assert got == want


@pytest.mark.parametrize("block", [1, 50, 1 << 20])
def test_matched_documents_count_a_path_once(corpus, queries, monkeypatch, block):
    monkeypatch.setattr(bm25, "SCORE_BLOCK", block)
    got = {r["qid"]: r["matched"] for r in bm25.matched_documents(bm25.build_index(corpus), queries).collect()}
    rows = [(r["path"], set(words(r["text"]))) for r in corpus.collect()]
    want = {q: len({p for p, w in rows if w & set(t)}) for q, t in asked(queries).items()}
    assert got == {q: n for q, n in want.items() if n}


def test_lists_of_tasks_are_short_and_whole(spark, corpus, queries, monkeypatch):
    idx = bm25.build_index(corpus).materialize()
    n = bm25.query_terms(queries).count()
    lists = idx.best_scores(queries, 2, 6, n, bm25.tokenize)
    per_task = lists.withColumn("p", F.spark_partition_id()).groupBy("p", "qid").count().agg(F.max("count")).first()[0]
    assert per_task == 2       # before: every matching document of a query was a row
    near = lambda rows: sorted((str(r["qid"]), r["rank"], r["path"], r["score"]) for r in rows)
    with_blocks = near(bm25.bm25_search(idx, queries, k=7).collect()), near(bm25.overlap_search(idx, queries, 7).collect())
    monkeypatch.setattr(bm25, "RANKED_ROWS", 0)       # joined with the postings
    assert with_blocks == (near(bm25.bm25_search(idx, queries, k=7).collect()), near(bm25.overlap_search(idx, queries, 7).collect()))


def test_rounding_is_that_of_spark(spark):
    x = np.array([0.1234565, 2.5e-7, 5e-7, -1.0000005, 3.0000015, 1e5 + 0.4444445, 0.0, -0.2])
    want = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(F.round("v", 6)).collect()]
    assert bm25.rounded(x, 6).tolist() == want


def counted_rows(df, counter):
    def fn(batches):
        for b in batches:
            counter.add(b.num_rows)
            yield b
    return df.mapInArrow(fn, df.schema)


def test_a_written_index_reads_its_texts_once(spark, corpus, tmp_path):
    counter = spark.sparkContext.accumulator(0)
    bm25.build_index(counted_rows(corpus, counter)).write(str(tmp_path / "index"))
    assert counter.value == 300       # before: once per table
