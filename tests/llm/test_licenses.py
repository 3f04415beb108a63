"""Licence scan against brute-force containment."""

from __future__ import annotations

import random
import re

import pytest

from quarry.llm import licenses as L


def shingles(text, k=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, templates, least=0.8):
    out = {}
    for i, text in docs:
        own = shingles(text)
        for name, t in templates:
            want = shingles(t)
            if name is not None and want and len(own & want) >= least * len(want):
                key = (i, name)
                out[key] = max(out.get(key, (0, 0, 0)), (len(own & want) / len(want), len(own & want), len(want)))
    return {(*k, *v[1:]) for k, v in out.items()}


def result(df):
    return {(r["doc_id"], r["license"], r["n_matched"], r["n_shingles"]) for r in df.collect()}


@pytest.fixture(scope="module")
def case():
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    long = say(400)
    templates = [("long", long), ("mid", say(37)), ("short", "Use, freely!"), ("none", ""), (None, "some words here and there too"), ("two", say(20)),
                 ("two", say(9)), *((k, v) for k, v in L.NOTICES.items())]
    words = long.split()
    docs = [(0, None), (1, ""), (2, "use freely"), (3, "please use freely"), (4, say(100) + " " + long + " " + say(50)),
            (5, say(30) + " " + " ".join(words[:380]) + " tail"), (6, " ".join(words[:200])), (None, templates[1][1]), (7, templates[6][1].upper())]
    near = list(words)
    for p in (50, 200, 350):
        near[p] = "changed"
    docs += [(8, " ".join(near)), (8, " ".join(near)), (9, say(3000) + " " + templates[5][1] + " " + say(7))]
    docs += [(20 + i, say(rng.randint(0, 60)) + ".\n" + t + " " + say(rng.randint(0, 60))) for i, t in enumerate(L.NOTICES.values())]
    return docs, templates


def test_brute_force(spark, case, monkeypatch):
    docs, templates = case
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, license string, h int")
    t = spark.createDataFrame(templates, "license string, text string")
    assert result(L.scan(d, t)) == brute(docs, templates)
    monkeypatch.setattr(L, "BATCH", 50)
    assert result(L.scan(d, t)) == brute(docs, templates)
    assert result(L.scan(d)) == brute(docs, list(L.NOTICES.items()))
    assert L.scan(d.limit(0), t).count() == 0
    assert L.scan(d, t.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, case):
    d = spark.createDataFrame(case[0], "doc_id long, text string")
    plan = L.scan(d)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("pythonexec", ""))
