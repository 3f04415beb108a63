"""Suffix-sorted repeat removal against brute force over every window."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import blocks as B, substring_dedup as S


def brute(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], sum(s["hi"] - s["lo"] for s in r["spans"]), len(r["spans"]),
                   hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect())


def expected(docs, length=400):
    rows = docs.select("doc_id", "text").collect()
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, *x) for r, x in zip(rows, brute([(r["text"] or "").encode() for r in rows], length)))


def test_odd_documents(odd_docs):
    assert result(S.remove_repeats(odd_docs)) == expected(odd_docs)


def test_window_rows_for_hot_buckets(odd_docs, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_STRETCHES", 1)
    assert result(S.remove_repeats(odd_docs)) == expected(odd_docs)


@pytest.mark.parametrize("often", [1, 3])
def test_hot_buckets_and_digests(odd_docs, monkeypatch, often):
    monkeypatch.setattr(S, "HOT_COPIES", often)
    assert result(S.remove_repeats(odd_docs)) == expected(odd_docs)


def test_empty_table(no_docs):
    assert S.remove_repeats(no_docs).count() == 0
    assert S.remove_repeats(no_docs, words=50).count() == 0


def brute_words(texts, words):
    """What is left of each text without its repeated strings of words."""
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    grams = lambda t, sp: [tuple(t[a:b] for a, b in sp[i:i + words]) for i in range(len(sp) - words + 1)]
    seen = Counter(g for t, sp in zip(texts, spans) for g in grams(t, sp))
    out = []
    for t, sp in zip(texts, spans):
        hit = {j for i, g in enumerate(grams(t, sp)) if seen[g] > 1 for j in range(i, i + words)}
        gone = bytearray(len(t))
        for j in hit:   # a covered word, and the white space up to a covered next one
            a, b = sp[j][0], sp[j + 1][0] if j + 1 in hit else sp[j][1]
            gone[a:b] = b"\x01" * (b - a)
        out.append(bytes(x for x, y in zip(t, gone) if not y))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_words_of_odd_documents(odd_docs, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(S, "BUCKET_STRETCHES", 1)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in odd_docs.collect()]
    want = sorted((i is None, i or 0, k) for (i, _), k in zip(rows, brute_words([t for _, t in rows], 50)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["kept"])) for r in S.remove_repeats(odd_docs, words=50).collect()) == want


def test_columns_named_like_the_output(spark):
    docs = spark.createDataFrame([(1, "x" * 500, 7, 8), (2, "x" * 500, 7, 8)], "doc_id long, text string, kept int, spans int")
    assert [bytes(r["kept"]) for r in S.remove_repeats(docs).collect()] == [b"", b""]
    assert [(r["kept"], r["spans"], r["text"]) for r in S.remove_repeats(docs, replace=True).collect()] == [(7, 8, "")] * 2


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(S.remove_repeats(docs)) == expected(docs)


@pytest.mark.parametrize("seed", range(8))
def test_block_sort_equals_brute_force(seed):
    rng = random.Random(seed)
    base = [bytes(rng.choice(b"ab" if seed % 2 else b"abcdefgh ") for _ in range(rng.randint(0, 900))) for _ in range(4)] + [b"a" * 700]
    texts = []
    for _ in range(9):
        x, y = rng.choice(base), rng.choice(base)
        a, b = rng.randint(0, len(x)), rng.randint(0, len(y))
        texts.append(x[:a] + y[b:b + 600] + x[a:])
    length = 120
    texts = [t for t in texts if len(t) >= length]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    got = S.repeated_windows(texts, np.array([len(t) - length + 1 for t in texts]), length)
    assert [list(g) for g in got] == [[seen[t[i:i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_stretches_cover_each_window_once(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 900))) for _ in range(6)] + [b"a" * 700, b"ab" * 400]
    texts += [texts[0][100:600] + b"x" * 30, texts[-1]]
    for lo, hi, data, offs in B.utf8_blocks(pa.array(texts, pa.binary()), 1 << 13):
        row, first, count, bucket = S.stretches(data, offs)
        got = {}
        for f, c, b in zip(first, count, bucket):
            for i in range(f, f + c):
                assert i not in got
                got[i] = b
        want = [i for k in range(hi - lo) for i in range(offs[k], offs[k + 1] - S.LENGTH + 1)]
        assert sorted(got) == want
        raw, by_text = bytes(data), {}
        assert all(by_text.setdefault(raw[i:i + S.LENGTH], got[i]) == got[i] for i in want)


def test_words_are_coded_by_the_worker_that_scans_them(odd_docs, monkeypatch):
    plans, write = {}, S.jobs.table
    monkeypatch.setattr(S.jobs, "table", lambda df, name="t": (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    S.remove_repeats(odd_docs, words=50)
    assert [plans[name].count("MapInArrow") for name in ("stretches", "parts")] == [1, 1]


def test_a_task_gives_freed_memory_back():
    def held():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

    @B.lean
    def task(batches):
        for _ in batches:
            small = [bytes(2000) for _ in range(40_000)]
            last = bytes(2000)   # lies behind the others, which so can't go by themselves
            yield len(small), pa.array(small), last
            keep.append(last)

    keep = []
    before = held()
    sizes = [n for n, _, _ in task(range(2))]
    assert sizes == [40_000] * 2 and held() < before + 40


def test_planted_passages_and_clean_documents_by_removed_bytes(spark):
    """What op1 removes is told by n_removed; n_bytes is the whole text's length."""
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abdeilmnorstué") for _ in range(rng.randint(2, 9))) for _ in range(n))
    planted = [say(80) for _ in range(20)]
    rows = [(2 * i + j, f"{say(100)} before{j} {p} {j}after {say(100)}") for i, p in enumerate(planted) for j in (0, 1)]
    clean = [(1000 + i, say(150)) for i in range(20)]
    out = {r["doc_id"]: r for r in S.remove_repeats(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    assert all(len(p.encode()) >= 400 for p in planted) and all(out[i]["n_bytes"] == len(t.encode()) for i, t in rows + clean)
    assert all(bytes(out[i]["kept"]) == t.replace(f" {planted[i // 2]} ", "").encode() for i, t in rows)
    assert all(out[i]["spans"] == [] for i, _ in clean)
