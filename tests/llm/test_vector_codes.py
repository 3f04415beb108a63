"""Vector codes against a brute-force k-means with Python's integers."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from quarry.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    ok = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(Fraction(x) * scale) for x in v], lab) for i, v, lab in ok]
    seen, first = set(), []
    for i, v, _ in sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        if i not in seen and len(seen) < entries:
            seen.add(i)
            first.append(v)
    w = len(first[0]) // parts
    cut = lambda v, p: v[p * w:(p + 1) * w]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for v in first] for p in range(parts)]
    assign = lambda: [[min((dist(cut(v, p), e), j) for j, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in whole]
    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), g in zip(whole, got) if g[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    got = assign()
    most = (1 << 63) - 1
    error = [min(sum(d for d, _ in g), most) for g in got]
    by = {}
    for (_, _, lab), e in zip(whole, error):
        by[lab] = by.get(lab, 0) + e
    out = [(i, "".join(f"{j:02x}" for _, j in g), e, min(by[lab], most)) for (i, _, lab), g, e in zip(whole, got, error)]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


def result(codes):
    return [tuple(r) for r in codes.rows.collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r[1:])))


def check(spark, rows, schema=SCHEMA, **how):
    got = V.compress(spark.createDataFrame(rows, schema), **how)
    want, sha = brute(rows, **how)
    assert order(result(got)) == order(want) and got.sha256() == sha
    return got


def test_odd_vectors(spark):
    rng = random.Random(1)
    vec = lambda: [rng.gauss(0, 1) for _ in range(16)]
    f32 = lambda v: [float(np.float32(x)) for x in v]
    same = f32(vec())
    rows = [(i, f32(vec()), i % 3) for i in range(40)] + [(50 + i, same, None) for i in range(30)]
    rows += [(3, f32(vec()), 1), (5, rows[5][1], 5 % 3), (90, None, 1), (91, [None] + same[1:], 1), (92, [float("nan")] + same[1:], 1),
             (93, [float("inf")] + same[1:], 1), (None, f32(vec()), 2), (None, None, None)]
    got = check(spark, rows)
    n = sum(1 for r in result(got))
    assert 0 < got.evaluated.first()[0] < n * 8 * 16


def test_pivots_leave_out_most_entries_of_clustered_vectors(spark):
    rng = random.Random(2)
    centers = [[rng.uniform(-9, 9) for _ in range(16)] for _ in range(16)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.01))) for c in centers[i % 16]], 0) for i in range(400)]
    got = check(spark, rows)
    assert got.evaluated.first()[0] < 0.3 * 400 * 8 * 16


def test_fewer_vectors_than_entries_and_ties(spark):
    check(spark, [(7, [0.5] * 8, 1), (3, [0.25] * 8, 1), (9, [0.375] * 8, None)])
    check(spark, [(i, [1.0] * 8, 0) for i in range(20)])


def test_huge_components_are_exact(spark):
    rows = [(i, [float(np.float32((-1) ** (i + j) * 10.0 ** (4 * (i % 9)) * (j + 1))) for j in range(8)], i % 2) for i in range(30)]
    check(spark, rows, entries=4, rounds=3)
    wide = [(i, [(-1.0) ** i * 10.0 ** (300 + i % 8), 1e-300], 0) for i in range(12)]
    check(spark, wide, "vec_id long, embedding array<double>, label int", parts=2, entries=3, rounds=2)


def test_other_lengths_and_lengths_that_cannot_be_cut(spark):
    rows = [(1, [1.0] * 8, 0), (2, [2.0] * 8, 0), (3, [1.0] * 4, 0), (4, [], None)]
    assert order(result(V.compress(spark.createDataFrame(rows, SCHEMA)))) == [(1, "00" * 8, 0, 0), (2, "01" * 8, 0, 0), (3, None, None, 0), (4, None, None, None)]
    got = V.compress(spark.createDataFrame([(1, [1.0] * 9, 0)], SCHEMA))
    assert result(got) == [(1, None, None, None)]
    assert result(V.compress(spark.createDataFrame([(1, [], 0)], SCHEMA))) == [(1, "00" * 8, 0, 0)]


def test_empty_table_and_extra_columns(spark):
    assert result(V.compress(spark.createDataFrame([], SCHEMA))) == []
    named = spark.createDataFrame([(1, [1.0] * 8, 0, "x", 5, 6)], SCHEMA + ", code string, error int, far int")
    assert result(V.compress(named)) == [(1, "00" * 8, 0, 0)]


@pytest.mark.parametrize("seed", range(4))
def test_nearest_equals_a_plain_scan(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-20, 20, (500, 3))
    entries = rng.integers(-20, 20, (16, 3))
    entries[5] = entries[2]
    pivots = V.choose_pivots(rng.integers(-20, 20, (16, 3)), 3)
    far = V.roots(V.squares(x[:, None, :], pivots[None]))
    e, sq, done = V.Codebook(entries, pivots).nearest(x, far)
    full = V.squares(x[:, None, :], entries[None])
    assert (e == full.argmin(axis=1)).all() and (sq == full.min(axis=1)).all() and done < full.size
