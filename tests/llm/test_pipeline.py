"""The pipeline's stages, each held against brute force on its own input."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quarry.llm import jobs
from tests.llm import test_decontaminate as dec, test_minhash_dedup as near, test_substring_dedup as sub, test_tokens_packing_orc as pack

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in P.STAGES:
        out.append(jobs.table(f(spark, out[-1], SF)))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "minhash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    for s in stages[1:-1]:
        assert s.columns == stages[0].columns and s.dtypes == stages[0].dtypes


def test_quality_keeps_clean(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    gone = stages[0].join(stages[1], "doc_id", "left_anti").join(labels, "doc_id")
    clean = labels.where("quality = 1 and toxic = 0").count()
    assert gone.where("quality = 1 and toxic = 0").count() <= 0.03 * clean


def test_near_dedup(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    want = sorted(r[1] for r in near.brute(rows, 5, 80) if r[4])
    assert sorted(r["doc_id"] for r in stages[2].collect()) == want


def test_repeats(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    want = {i: k.decode("utf-8", "ignore") for (i, _), k in zip(before, sub.brute_words([t.encode() for _, t in before], 50))}
    after = stages[3].collect()
    assert {r["doc_id"]: r["text"] for r in after} == want and len(after) == len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_planted_passages_of_over_50_words_go(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(n))
    planted = [say(n) for n in range(51, 71)]
    rows = [(2 * i + j, f"{say(rng.randint(120, 400))} before{j}\n{p}\nafter{j} {say(rng.randint(120, 400))}") for i, p in enumerate(planted) for j in (0, 1)]
    clean = [(1000 + i, say(200)) for i in range(20)] + [(2000 + i, say(60) + " " + say(0)) for i in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + clean], stage_schema)
    out = {r["doc_id"]: r["text"] for r in P.repeats_stage(spark, docs, SF).collect()}
    for i, t in rows:
        assert planted[i // 2] not in out[i] and out[i] == t.replace(planted[i // 2], "")
    assert all(out[i] == t for i, t in clean)


stage_schema = "doc_id long, text string, lang string, source string, n_chars long"


def test_columns_named_like_a_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = docs.select("*", F.lit(1).alias("accepted"), F.lit(2).alias("perplexity"), F.lit(3).alias("limit"))
    out = P.quality_stage(spark, named, SF)
    assert out.columns == named.columns
    assert out.select(*docs.columns).exceptAll(P.quality_stage(spark, docs, SF)).count() == 0


def test_decontamination(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in stages[3].collect()]
    assert sorted(r["doc_id"] for r in stages[4].collect()) == sorted(r[0] for r in dec.brute(rows, items) if not r[4])


def test_packing(stages):
    bins = pack.check_packing(stages[5].collect(), stages[4].collect())
    assert bins


def test_odd_documents_pass_every_stage(spark, odd_docs):
    docs = odd_docs.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for name, f in P.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = jobs.table(out)
    assert docs.where("doc_id is null").count() >= 1
    last = P.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert zlib.crc32(b"") == 0
    empty = docs.limit(0)
    for _, f in P.STAGES:
        assert f(spark, empty, SF).count() == 0
