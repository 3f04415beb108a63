"""Fixtures of the pipeline operators' tests: awkward documents and tables."""

from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties, runs of one letter,
    copies inside a document, and an extra column with a clashing name."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "délta", "x", "42", "zeta-eta", "ñu"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 60)) for _ in range(n))
    long, passage = say(4000), say(90)
    rows = [(0, None), (1, ""), (2, "one"), (3, "one"), (4, "Two words"), (5, "two  words"), (6, " \t\n"),
            (7, long), (8, long), (8, long), (9, long[:3000] + " changed " + long[3100:]), (10, "a" * 1500),
            (11, "ab" * 700), (12, say(50) + " " + passage + " " + say(40)), (13, say(70) + " " + passage), (14, passage + "\n" + passage),
            (None, passage), (None, None), (15, say(300)), (16, say(300)), (17, "é" * 500), (18, "Ab aB AB ab ab AB")]
    return spark.createDataFrame([(i, t, "en", i) for i, t in rows], "doc_id long, text string, lang string, hits long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
