"""Kneser-Ney scores against a plain dictionary model; held-out behaviour."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import quality as Q

SF = "/root/testdata/sf0.01"


def codes(text):
    return [Q.symbol_classes()[min(ord(c), 0xFFFF)] for c in text or ""]


def brute_model(texts):
    """Interpolated modified Kneser-Ney by the textbook, over tuples."""
    top = Counter()
    for t in texts:
        s = [0] * 3 + codes(t)
        top.update(tuple(s[i - 3:i + 1]) for i in range(3, len(s)))
    tables = [top]
    for n in (3, 2, 1):
        tables.append(Counter(g[1:] for g in tables[-1]))
    tables = tables[::-1]
    parts = []
    for table in tables:
        d = Q.discounts(Counter(c for c in table.values() if c < 5))
        total, held = defaultdict(int), defaultdict(float)
        for g, c in table.items():
            total[g[:-1]] += c
            held[g[:-1]] += d[min(c, 3) - 1]
        parts.append((table, d, total, held))

    def p(g):
        prob = 1 / Q.SYMBOLS
        for n, (table, d, total, held) in enumerate(parts, 1):
            h = g[-n:]
            if h[:-1] in total:
                c = table.get(h, 0)
                prob = ((c - d[min(c, 3) - 1] if c else 0) + held[h[:-1]] * prob) / total[h[:-1]]
        return prob
    return p


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_scores_equal_the_textbook(spark, tables):
    docs, labels = tables
    docs = docs.where("doc_id < 150 and length(text) < 3000")
    train = {r["doc_id"] for r in Q.trusted_ids(labels).where(~Q.held_out()).collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    p = brute_model([t for i, t in rows.items() if i in train])
    scored = Q.fit(docs, labels).score(docs.select("doc_id", "text")).collect()
    for r in scored[:40]:
        s = [0] * 3 + codes(rows[r["doc_id"]])
        nll = -sum(math.log(p(tuple(s[i - 3:i + 1]))) for i in range(3, len(s)))
        assert r["__n"] == len(rows[r["doc_id"]]) and abs(r["__nll"] - nll) <= 1e-4 * max(1, nll)


def test_probabilities_sum_to_one():
    p = brute_model(["The cat sat on the mat.", "A dog sat."])
    g = tuple(codes("the"))
    assert abs(sum(p((*g, np.uint8(x))) for x in range(Q.SYMBOLS)) - 1) < 1e-9


def test_clean_documents_stay_and_junk_goes(tables):
    docs, labels = tables
    got = Q.judge(docs, labels).join(labels, "doc_id")
    counts = {(r["quality"], r["accepted"]): r["count"] for r in got.where("toxic = 0").groupBy("quality", "accepted").count().collect()}
    assert counts.get((1, False), 0) <= 0.01 * counts[(1, True)]
    assert counts[(0, False)] >= 0.9 * (counts[(0, False)] + counts.get((0, True), 0))


def test_odd_rows(spark, odd_docs, tables):
    labels = spark.createDataFrame([(0, 1, 0), (7, 1, None), (None, 1, 0), (15, 1, 0), (15, 1, 0), (16, 1, 0), (99, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    docs = odd_docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.col("lang")))
    out = Q.judge(docs, labels).collect()
    assert len(out) == odd_docs.count()
    assert all(r["accepted"] and r["perplexity"] is None for r in out if not r["text"])
    assert all(r["accepted"] for r in Q.judge(docs, labels.limit(0)).collect())
    assert Q.judge(docs.limit(0), labels).count() == 0


def test_one_odd_word_and_repeated_words_go(tables):
    """Toxic words in ordinary prose, and texts that say one word over and over."""
    docs, labels = tables
    got = Q.judge(docs, labels).join(labels, "doc_id")
    counts = {(r["toxic"], r["accepted"]): r["count"] for r in got.where("quality = 1").groupBy("toxic", "accepted").count().collect()}
    assert counts.get((1, False), 0) >= 0.25 * (counts.get((1, False), 0) + counts.get((1, True), 0))
    junk = docs.limit(1).select(F.explode(F.array(*[F.struct(F.lit(-1 - i).cast("long").alias("doc_id"), F.lit(t).alias("text"), F.lit(lang).alias("lang"))
                                                   for i, (t, lang) in enumerate([("Pf. " * 60, "de"), ("De " * 40, "es"), ("### $$$ %%%", "en"), ("x#q{" * 12, "en")])]))).select("col.*")
    out = Q.judge(docs.select("doc_id", "text", "lang").unionByName(junk), labels).where("doc_id < 0").collect()
    assert len(out) == 4 and not any(r["accepted"] for r in out)


def test_worst_span_and_repeats():
    texts = ["", "ab", "the cat sat on the mat", "x" * 300, "abcdefghijklmnopqrstuvwxyz" * 10]
    code, bounds = Q.grams(texts)
    cost = np.random.default_rng(3).random(len(code))
    total = np.concatenate([[0.0], np.cumsum(cost)])
    for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
        want = max((cost[j:j + Q.SPAN].sum() for j in range(lo, hi - Q.SPAN + 1)), default=cost[lo:hi].sum())
        assert abs(Q.worst_spans(total, bounds)[i] - want) < 1e-9
        windows = [code[j:min(j + Q.WINDOW, hi)] for j in [*range(lo, hi - Q.WINDOW + 1, Q.WINDOW), max(lo, hi - Q.WINDOW)]]
        assert Q.repeat_shares(code, bounds)[i] == max((len(w) - len(set(w.tolist()))) / (Q.WINDOW if hi - lo >= Q.WINDOW else max(hi - lo, Q.SPAN)) for w in windows)


def test_every_trusted_document_trains_the_model(spark, monkeypatch):
    docs = spark.range(160_000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    kept = {}
    whole = Q.log_probabilities
    monkeypatch.setattr(Q, "log_probabilities", lambda counts: kept.update(n=counts.agg(F.sum("trained")).first()[0]) or whole(counts))
    Q.fit(docs, labels)
    n = Q.trusted_ids(labels).where(~Q.held_out()).count()
    assert n > 100_000 and kept["n"] == 2 * n


def test_grams_are_of_true_characters(spark):
    """Letters, capitals, signs and digits that shared a class once are apart,
    in few characters and in many (over 161 a block), and none is cut to 16 bits."""
    few = [None, "", "aä aü AB AC", "x-y?z!{ 1 2", "\u4e00\u4e8c\U0001f600\U0001f601\u0416\u0417"]
    for texts in (few, [*few, "".join(chr(c) for c in range(0x4e00, 0x4f00)) * 2]):
        want = Counter()
        for t in texts:
            s = [0] * 3 + [ord(c) + 1 for c in t or ""]
            want.update((s[i - 3] << 42 | s[i - 2] << 21 | s[i - 1], s[i]) for i in range(3, len(s)))
        code, bounds = Q.grams(texts)
        assert bounds.tolist() == np.cumsum([0, *[len(t or "") for t in texts]]).tolist() and len(set(code.tolist())) == len(want)
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        got = Q.gram_counts(docs, docs.select("doc_id").distinct()).collect()
        assert {(r["head"], r["last"]): r["trained"] for r in got} == want


def test_unlike_characters_score_differently_and_any_character_has_a_score(spark):
    """A model that has met one of two characters finds it likelier than the
    other; characters that it hasn't met score by the prior, whatever they are."""
    rows = [(i, "caf\u00e9 \u4e2d\u6587 7-7.", "en") for i in range(40)]
    odd = [(100, "caf\u00e9 \u4e2d\u6587 7-7."), (101, "caf\u00e8 \u4e2d\u6587 7-7."), (102, "caf\u00e9 \u4e2d\u6588 7-7."), (103, "caf\u00e9 \u4e2d\u6587 7?7."),
           (104, "caf\u00e9 \u4e2d\u6587 8-7."), (105, "caf\u00e9 \u4e2d\U0001f600 7-7."), (None, "caf\u00e9 \u4e2d\u6587 7-7."), (106, None)]
    docs = spark.createDataFrame(rows + [(i, t, "en") for i, t in odd], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in Q.fit(docs, labels).score(docs.where("doc_id >= 100 or doc_id is null")).collect()}
    assert all(got[i]["__nll"] > got[100]["__nll"] + 1 and math.isfinite(got[i]["__nll"]) for i in range(101, 106))
    assert got[None]["__nll"] == got[100]["__nll"] and (got[106]["__n"], got[106]["__nll"]) == (0, 0.0)
    low = Q.CHARACTERS + 1 - (Q.SYMBOLS - 1)
    some = spark.createDataFrame([(66,), (0x1f601,)], "last int").select(Q.prior().alias("p")).collect()
    assert abs((Q.SYMBOLS - 1) * some[0]["p"] + low * some[1]["p"] - 1) < 1e-9


def test_no_text_is_shuffled_and_no_model_gathered(tables):
    docs, labels = tables
    scored = Q.fit(docs, labels).score(docs.select("doc_id", "text"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    assert not any("Exchange" in line and "text" in line for line in plan.splitlines())
    cogroup = plan[plan.index("FlatMapCoGroupsInArrow"):]
    assert cogroup.index("FileScan") < cogroup.index("Exchange"), plan
