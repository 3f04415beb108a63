"""Importance resampling against brute force with zlib and the plain pattern."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import importance as I

SF = "/root/testdata/sf0.001"
UPPER = {c: c + 32 for c in range(65, 91)}


def feature_buckets(text, orders=3, buckets=10_000):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return words, [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, percent=5, least=20, seed=42, buckets=10_000):
    each = [(i, *feature_buckets(t, buckets=buckets)) for i, t in rows]
    s = Counter(b for _, _, f in each for b in f)
    t = Counter(b for x in target for b in feature_buckets(x, buckets=buckets)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * float(big_s + buckets) / (float(s[b] + 1) * float(big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, words, f in each:
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, len(words), len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for r in out:
        r.append(None)
    for n, r in enumerate(may[:len(may) * percent // 100]):
        r[5] = n + 1
    return sorted(map(tuple, out), key=lambda r: tuple((x is None, x or 0) for x in r))


def result(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, x or 0) for x in r))


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_given_tables(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = I.resample(docs, bench)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert result(got) == brute(pairs(docs), [r["text"] for r in bench.collect()])


def test_odd_documents(spark, odd_docs):
    target = spark.createDataFrame([(None,), ("",), ("alpha1 beta2 gamma3",), ("délta4 x5",)], "text string")
    named = odd_docs.selectExpr("*", "1 as weight", "2 as score", "3 as rank")
    got = I.resample(named, target, percent=40, least_words=1)
    assert result(got) == brute(pairs(odd_docs), [r["text"] for r in target.collect()], percent=40, least=1)


def test_empty_tables(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "text string")
    assert I.resample(no_docs, none).count() == 0
    assert result(I.resample(odd_docs, none)) == brute(pairs(odd_docs), [])


@pytest.mark.parametrize("texts", [
    [], [""], ["", "a", ""], ["a b", "c d"], ["A\nb\x00c", "d\n", "\ne"], ["é ü 漢字 x", "Ünï-cödé", "7 8,9"],
    ["x" * 62 + " " + "y" * 63 + " " + "z" * 64 + " " + "w" * 200 + " a b", "q" * 64], ["one two three four five"] * 3])
def test_features_stay_inside_their_text(texts):
    bucket, owner, words = I.features([t.encode() for t in texts])
    for i, t in enumerate(texts):
        want_words, want = feature_buckets(t)
        assert sorted(bucket[owner == i].tolist()) == sorted(want) and words[i] == len(want_words)


def test_gain_of_counts_beyond_exact_products():
    t, s = np.array([10 ** 9, 0]), np.array([10 ** 12, 7])
    assert I.gains(t, s)[0] == math.floor(1000 * math.log((1e9 + 1) * float(10 ** 12 + 9) / ((1e12 + 1) * float(10 ** 9 + 2))))
