"""Exact duplicates against brute force; the index's buckets and chains."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import exact_dedup as X, jobs

SF = "/root/testdata/sf0.001"


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, ids[0], len(ids), n == 0, sha) for n, i in enumerate(ids)]
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r[1:])))


def check(docs, **how):
    got = [tuple(r) for r in X.exact_duplicates(docs, **how).collect()]
    assert order(got) == order(brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))


def test_given_documents(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("capacity", [1, 4, 100])
def test_odd_documents_with_small_buckets(spark, odd_docs, capacity):
    check(odd_docs, capacity=capacity)


def test_clashing_columns_nulls_and_white_space(spark):
    rows = [(3, "a \t b"), (1, "a b"), (2, " a b"), (9, "a  b\n"), (5, None), (4, ""), (6, "  "), (None, "a b"), (None, "q"), (None, "q"), (7, "z"), (7, "z"), (7, "y"),
            (8, "a b"), (10, "a b"), (11, "A B")]
    check(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as key", "1 as digest", "2 as copies", "3 as bucket", "4 as times"))


def test_empty_table(no_docs):
    assert X.exact_duplicates(no_docs).count() == 0


def test_texts_of_one_key_are_chained(spark, odd_docs, monkeypatch):
    """With a key that tells nothing all texts collide: bytes still decide."""
    monkeypatch.setattr(X.F, "xxhash64", lambda c: F.length(c).cast("long") * 0 + 5)
    check(odd_docs)
    index, _ = X.build(odd_docs)
    chain = sorted(r["chain"] for r in index.entries.collect())
    assert chain == list(range(1, len(chain) + 1)) and len(chain) > 5


def test_hot_groups_and_rows_repeated_many_times(spark, monkeypatch):
    monkeypatch.setattr(X, "COPIES_LISTED", 7)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot  text").otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 7))).alias("text"))
    check(docs.unionByName(docs.where("doc_id = 5").crossJoin(spark.range(40)).select("doc_id", "text")))
    monkeypatch.setattr(X, "KEYS_SENT", 0)
    check(docs)


def test_directory_splits_overfull_buckets(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    index, _ = X.build(docs, capacity=100)
    held = {r["bucket"]: r["count"] for r in index.entries.groupBy("bucket").count().collect()}
    assert sum(held.values()) == 4000 and max(held.values()) <= 100 and len(held) > 40
    # A bucket exists only because its parent was overfull, and keys lie in its range.
    for b in held:
        depth = b.bit_length() - 1
        parent = sum(n for c, n in held.items() if c.bit_length() >= depth and c >> (c.bit_length() - depth) == b >> 1)
        assert parent > 100
    wrong = index.entries.where(F.expr("bucket <> shiftleft(1L, length(bin(bucket)) - 1) + case when bucket = 1 then 0 else shiftrightunsigned(key, 65 - length(bin(bucket))) end"))
    assert wrong.count() == 0


def test_lookup_finds_only_what_the_index_holds(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c")], "doc_id long, text string")
    index, _ = X.build(docs)
    asked = jobs.table(X._scan(spark.createDataFrame([(10, "a\tb"), (11, "c"), (12, "d")], "doc_id long, text string")))
    got = {r["doc_id"]: (r["keep_id"], r["copies"]) for r in X.lookup(index, asked).collect()}
    assert got == {10: (1, 2), 11: (3, 1), 12: (None, None)}


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = X.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD|MapPartitions", plan)
