"""Chat windows: exact round trip, budgets, masks."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import chat


def digest_of(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        aim = "".join(x for _, _, r, x in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(aim), hashlib.sha256(aim.encode()).hexdigest())
    return out


def result(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(df).collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    bits = ["\\", "#", "<", "###", "</turn>", "\n", ": ", "é", "😀", "ok ", "\\b", "\\### Assistant: </turn> ok", "$1", "word "]
    out = []
    for conv in [1, 2, 3, None]:
        for turn in range(rng.randint(1, 40)):
            role = "system" if turn == 0 and conv in (1, None) else rng.choice(["user", "assistant", "a: b#<\\c"])
            out.append((conv, turn, role, "".join(rng.choice(bits) for _ in range(rng.randint(0, 200)))))
    out += [(9, 0, "user", None), (9, 0, "user", None), (9, None, None, "x"), (9, 2, "assistant", ""), (9, 2, "assistant", "long " * 9000),
            (9, 3, "assistant", "again"), (9, 3, "assistant", "again"), (10, 5000, "assistant", "far"), (10, -5, "user", "early")]
    out += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], "conv_id long, turn long, role string, text string, pos int, part string")


def test_round_trip(spark, rows):
    assert result(chat.windows(frame(spark, rows))) == digest_of(rows)
    assert result(chat.windows(frame(spark, rows), budget=300, history=64)) == digest_of(rows)


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    assert result(chat.windows(df)) == digest_of(rows)


def test_budget_history_and_mask(spark):
    rows = [(1, 0, "system", "rules " * 10)] + [(1, i, "assistant" if i % 2 == 0 else "user", f"turn {i} " * 40) for i in range(1, 60)]
    out = chat.windows(frame(spark, rows), budget=600, history=200).orderBy("first").collect()
    assert len(out) > 5
    for w in out:
        assert len(w["formatted"].encode()) / 4 <= 600 * 1.2
        if w["first"]:
            assert w["formatted"].startswith("### system: rules")
            assert 2 <= w["n_repeated"] <= 4
    marked = [w["formatted"][m["start"]:m["end"]] for w in out for m in w["loss"]]
    assert marked == [r[3] for r in rows if r[2] == "assistant"]


def test_no_python_in_the_plan(spark, rows):
    plan = chat.digests(chat.windows(frame(spark, rows)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(spark):
    assert chat.digests(chat.windows(frame(spark, [])) if False else chat.windows(frame(spark, [(1, 0, "user", "x")]).where(F.lit(False)))).count() == 0
