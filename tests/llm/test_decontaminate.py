"""Winnowing decontamination against brute-force window lookup."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quarry.llm import decontaminate as D


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    table = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            table.setdefault(tuple(w[p:p + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in range(1, window + 1):
            for p in range(len(w) - n + 1):
                got = table.get(tuple(w[p:p + n]))
                if got is not None:
                    hit.update(range(p, p + n))
                    found |= got
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["The", "of", "élan", "x1", "BAR-baz", "q"]) + rng.choice(["", "s", "2"]) for _ in range(n))
    items = [(i, say(rng.randint(10, 40))) for i in range(12)] + [(50, "just four words here"), (51, None), (52, "..."), (53, "uniqueword"),
                                                                  (None, say(15)), (7, say(12)), (60, say(10)), (61, None)]
    items.append((62, items[0][1]))
    docs = [(None, items[0][1]), (0, None), (1, ""), (2, "--- ..."), (3, "has uniqueword inside"), (3, "has uniqueword inside")]
    for i in range(60):
        t = items[rng.randrange(len(items))][1] or ""
        a = t.split()
        lo = rng.randint(0, len(a) // 2) if a else 0
        docs.append((10 + i, say(rng.randint(0, 30)) + "\n" + ", ".join(a[lo:lo + rng.randint(0, 30)]).upper() + " ! " + say(rng.randint(0, 30))))
    docs.append((200, say(5000)))
    return docs, items


def test_brute_force(spark, case):
    docs, items = case
    d = spark.createDataFrame([(*r, "x", 0) for r in docs], "doc_id long, text string, item_id string, n int").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert result(D.contamination(d, b)) == brute(docs, items)
    kept = sorted(((r["doc_id"], r["text"]) for r in D.clean(d, b).collect()), key=str)
    bad = {(i, t) for (i, t) in docs if brute([(i, t)], items)[0][4]}
    assert kept == sorted((r for r in docs if r not in bad), key=str)


def test_empty_tables(spark, case):
    d = spark.createDataFrame(case[0], "doc_id long, text string")
    b = spark.createDataFrame(case[1], "item_id long, text string")
    assert all(not r["contaminated"] for r in D.contamination(d, b.limit(0)).collect())
    assert D.contamination(d.limit(0), b).count() == 0


def test_every_shared_window_shares_its_fingerprint():
    rng = np.random.default_rng(3)
    span = rng.integers(0, 2**63, 10, dtype=np.uint64)
    for _ in range(50):
        a = np.concatenate([rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64), span, rng.integers(0, 2**63, 3, dtype=np.uint64)])
        at, fp = D._windows(a, np.zeros(len(a), np.int64), 10, 5)
        assert D._windows(span, np.zeros(10, np.int64), 10, 5)[1][0] in fp
