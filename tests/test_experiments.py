import json
import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluate as EV
from quarry.operators import fusion as FU
from quarry.operators import sweep as SW
from quarry.sources.tables import read_dimensions

DIMS = [("alpha", 0.0, 1.0, 0.75, 0.7), ("beta", 0.0, 1.0, 0.25, 0.3)]


def dims_df(spark, rows=DIMS):
    return spark.createDataFrame(rows, "name string, low double, high double, target double, weight double")


def model_score(params, dims=DIMS, baseline=0.3):
    tw = sum(d[4] for d in dims)
    s = sum(max(0.0, 1 - min(abs(params[n] - t) / (h - lo), 1.0)) * w for n, lo, h, t, w in dims)
    return baseline + 0.05 + 0.95 * s / tw


def test_sweep_matches_formula_and_best_beats_baseline(spark):
    trials = SW.random_trials(spark, [{"name": n, "low": lo, "high": h} for n, lo, h, _, _ in DIMS], 8, seed=42)
    scores = SW.sweep(trials, dims_df(spark), 0.3)
    params = {}
    for r in trials.collect():
        params.setdefault(r.trial_id, {})[r.name] = r.value
    got = {r.trial_id: r.score for r in scores.collect()}
    assert len(got) == 8
    for t, s in got.items():
        assert abs(s - model_score(params[t])) < 1e-12
    best = SW.best_trial(scores, 0.3).first()
    assert best.beats_baseline and best.score == max(got.values())


def test_sweep_errors(spark):
    trials = spark.createDataFrame([(1, "alpha", 0.5)], "trial_id long, name string, value double")
    with pytest.raises(Exception, match="lacks a value"):
        SW.sweep(trials, dims_df(spark), 0.3).collect()
    bad = dims_df(spark, [("alpha", 1.0, 1.0, 0.5, 1.0)])
    with pytest.raises(Exception, match="invalid range"):
        SW.sweep(trials, bad, 0.3).collect()
    zero = dims_df(spark, [("alpha", 0.0, 1.0, 0.5, 0.0)])
    with pytest.raises(Exception, match="weights must sum"):
        SW.sweep(trials, zero, 0.3).collect()


def test_sweep_trials_that_set_too_little_or_too_much(spark):
    full = [(1, "alpha", 0.5), (1, "beta", 0.5)]
    schema = "trial_id long, name string, value double"
    for extra, message in [([(2, "gamma", 1.0)], "lacks a value"), ([(2, "alpha", 0.1), (2, "alpha", 0.2)], "lacks a value"),
                           ([(2, "alpha", 0.1), (2, "alpha", 0.2), (2, "beta", 0.3)], "twice"), ([(2, "alpha", 0.1), (2, "beta", None)], "lacks a value")]:
        with pytest.raises(Exception, match=message):
            SW.sweep(spark.createDataFrame(full + extra, schema), dims_df(spark), 0.3).collect()
    ignored = spark.createDataFrame(full + [(1, "gamma", 9.0)], schema)
    assert SW.sweep(ignored, dims_df(spark), 0.3).count() == 1
    flat = SW.sweep(ignored, dims_df(spark), 0.0, lambda value, low, high, target, weight: weight)
    assert abs(flat.first().score - 1.0) < 1e-12
    named = spark.createDataFrame([("b", 0.4), ("a", 0.4)], "trial_id string, score double")
    assert SW.best_trial(named, 0.3).first().trial_id == "a"


def test_read_dimensions(spark, tmp_path):
    p = tmp_path / "cases.json"
    p.write_text(json.dumps({"baseline_score": 0.25, "dimensions": [
        {"name": "alpha", "low": 0, "high": 1, "target": 0.7, "weight": 0.6},
        {"name": "beta", "low": 0, "high": 1, "target": 0.2}]}))
    base, dims = read_dimensions(spark, str(p))
    assert base.first().baseline_score == 0.25
    assert sorted((r.name, r.weight) for r in dims.collect()) == [("alpha", 0.6), ("beta", 1.0)]
    p2 = tmp_path / "empty.json"
    p2.write_text(json.dumps({"baseline_score": 0.25, "dimensions": []}))
    with pytest.raises(Exception, match="at least one dimension"):
        read_dimensions(spark, str(p2))[0].collect()


def test_evaluate_matches_hand_computation(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "qid long, id string, rank int")
    qrels = spark.createDataFrame([(1, "a", 2), (1, "c", 1), (1, "d", 1), (2, "y", 1)],
                                  "qid long, id string, rel int")
    got = {(r.qid, r.k): r for r in EV.evaluate(hits, qrels, [1, 3]).collect()}
    r = got[(1, 3)]
    dcg = 2 / math.log2(2) + 1 / math.log2(4)
    idcg = 2 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    assert r.hits == 2 and abs(r.precision - 2 / 3) < 1e-12 and abs(r.recall - 2 / 3) < 1e-12
    assert abs(r.ndcg - dcg / idcg) < 1e-12
    assert got[(2, 1)].hits == 0 and got[(2, 1)].ndcg == 0.0
    m = {r.k: r for r in EV.mean_metrics(EV.evaluate(hits, qrels, [1, 3])).collect()}
    assert m[1].queries == 2 and abs(m[1].precision - 0.5) < 1e-12


def test_evaluate_same_label_equals_explicit_qrels(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "qid long, id string, rank int")
    labels = spark.createDataFrame([("a", 0), ("b", 1), ("c", 0), ("d", 0)], "id string, label int")
    ql = spark.createDataFrame([(1, 0)], "qid long, label int")
    a = EV.evaluate_same_label(hits, ql, labels, [2, 3]).orderBy("k").collect()
    qrels = spark.createDataFrame([(1, i, 1) for i in ("a", "c", "d")], "qid long, id string, rel int")
    b = EV.evaluate(hits, qrels, [2, 3]).orderBy("k").collect()
    assert [tuple(x) for x in a] == [tuple(y) for y in b]


def test_fusion_minmax_and_rrf(spark):
    a = spark.createDataFrame([(1, "x", 3.0, 1), (1, "y", 1.0, 2)], "qid long, id string, score double, rank int")
    b = spark.createDataFrame([(1, "y", 5.0, 1), (1, "z", 5.0, 2)], "qid long, id string, score double, rank int")
    mm = {r.id: r.score for r in FU.fuse(a, b, 10, (0.7, 0.3), "minmax").collect()}
    assert mm == {"x": 0.7, "y": 0.3, "z": 0.3}
    rr = FU.fuse(a, b, 2, (0.5, 0.5), "rrf").orderBy("rank").collect()
    assert [r.id for r in rr] == ["y", "x"]
    with pytest.raises(ValueError):
        FU.fuse(a, b, 2, method="nope")


def test_containment_qrels_match_brute_force(spark):
    from conftest import corpus_df
    from quarry.operators import bm25
    docs = {"a.txt": "the quick brown fox jumps over", "b.txt": "a quickbrown fox jumps overall",
            "c.txt": "xthe quick brown fox jumps overt", "d.txt": "nothing here"}
    corpus = corpus_df(spark, docs)
    idx = bm25.build_index(corpus)
    passages = {1: "quick brown fox jumps", 2: "he quick brown fox jumps ove", 3: "fox", 4: "not in any document"}
    p = spark.createDataFrame(list(passages.items()), "qid long, text string")
    got = sorted((r.qid, r.path) for r in EV.containment_qrels(idx.postings, idx.term_stats, corpus, p).collect())
    want = sorted((q, path) for q, t in passages.items() for path, d in docs.items()
                  if t in d)
    assert got == want and (2, "c.txt") in got      # boundary tokens cut inside document tokens


def test_weight_grid_equals_single_fusions(spark):
    a = spark.createDataFrame([(1, "x", 3.0, 1), (1, "y", 1.0, 2), (2, "u", 2.0, 1)],
                              "qid long, id string, score double, rank int")
    b = spark.createDataFrame([(1, "y", 5.0, 1), (1, "z", 4.0, 2), (2, "u", 1.0, 1)],
                              "qid long, id string, score double, rank int")
    weights = [0.0, 0.3, 1.0]
    grid = FU.fuse_weight_grid(a, b, 2, weights).collect()
    for t, w in enumerate(weights):
        single = sorted((r.qid, r.id, r.score, r["rank"]) for r in FU.fuse(a, b, 2, (w, 1 - w)).collect())
        mine = sorted((r.qid, r.id, r.score, r["rank"]) for r in grid if r.trial_id == t)
        assert mine == single


def test_evaluate_by_group(spark):
    hits = spark.createDataFrame([(0, 1, "a", 1), (1, 1, "b", 1)], "t long, qid long, id string, rank int")
    qrels = spark.createDataFrame([(1, "a", 1)], "qid long, id string, rel int")
    got = {r.t: r.hits for r in EV.evaluate(hits, qrels, [1], by=["t"]).collect()}
    assert got == {0: 1, 1: 0}
