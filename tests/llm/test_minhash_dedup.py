"""Near-duplicate components against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import blocks as B, minhash_dedup as M


def shingles(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return set()
    return {tuple(ws[i:i + words]) for i in range(max(1, len(ws) - words + 1))}


def brute(rows, words, percent):
    ids = {}
    for i, t in rows:
        if i is not None:
            ids.setdefault(i, shingles(t, words))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(ids)
    for k, a in enumerate(keys):
        for b in keys[k + 1:]:
            both = len(ids[a] & ids[b])
            if both and 100 * both >= percent * (len(ids[a]) + len(ids[b]) - both):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    out = []
    for i, t in rows:
        c = find(i) if i is not None else None
        out.append((i is None, i or 0, len(shingles(t, words)), c, i is None or c == i))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def test_odd_documents(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert result(M.near_duplicates(odd_docs, 3, 85)) == brute(rows, 3, 85)
    assert result(M.near_duplicates(odd_docs)) == brute(rows, 5, 80)


def test_empty_table(no_docs):
    assert M.near_duplicates(no_docs).count() == 0


def test_chains_and_near_misses(spark, monkeypatch):
    """Links that no star shows: a chain of edits, and many texts around the
    threshold, over small blocks."""
    monkeypatch.setattr(M, "CHUNK", 16)
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    rows, cur = [], list(base)
    for i in range(40):
        rows.append((100 - i if i < 20 else 200 + i, " ".join(cur)))
        cur = list(cur)
        cur[rng.randrange(150)] = f"n{i}"
    for i in range(60):
        other = list(base)
        for p in rng.sample(range(150), rng.randint(2, 7)):
            other[p] = f"x{rng.randint(0, 10**6)}"
        rows.append((1000 + i, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(M.near_duplicates(df, 3, 85)) == brute(rows, 3, 85)


@pytest.mark.parametrize("size", [3, 40, 400, 6000])
def test_sketch_bound_keeps_every_link(size):
    rng = np.random.default_rng(size)
    for _ in range(20):
        common = rng.integers(0, 2**63, size, dtype=np.uint64)
        d = int(size * 15 / 85)
        sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, d // 2, dtype=np.uint64) * np.uint64(2)])) for _ in range(2)]
        vals, bounds = np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        _, odd = M.signatures(vals, bounds, 4, M.SKETCH_BITS)
        assert np.bitwise_count(odd[0] ^ odd[1]).sum() <= M.most_bits(np.array([len(vals)]), 85, M.SKETCH_BITS)[0]


def test_word_rules():
    text = pa.array(["A b\tC\x0bd  É é \x1c x", "ONE", "a b"])
    _, _, data, offs = next(B.utf8_blocks(text))
    _, bounds = M.shingle_sets(data, offs, 3)
    assert np.diff(bounds).tolist() == [len(shingles(t, 3)) for t in text.to_pylist()]
