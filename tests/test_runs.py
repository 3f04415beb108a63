import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.functions import runs as R
from quarry.operators import runs as RO

TRACE = {"run_id": "run-1",
         "calls": [{"name": "grep", "params": {"pattern": "x"}, "result_summary": {"hits": 3}, "latency_ms": 50},
                   {"name": "keyword", "params": {}, "result_summary": {"score": 0.42, "top": "a.py", "n": None,
                                                                         "nested": {"a": 1}, "ok": True, "more": 1},
                    "latency_ms": 75}],
         "metrics": {"latency": 125.0}}


def runs_df(spark, rows):
    return spark.createDataFrame(rows, "run_id string, params string, metrics string, trace string")


def row(run_id, trace, metrics='{"m": 1}', params='{"p": 1}'):
    return (run_id, params, metrics, trace if isinstance(trace, str) else json.dumps(trace))


def test_log_and_load_round_trip(spark, tmp_path):
    d = str(tmp_path / "runs")
    RO.log_runs(runs_df(spark, [row("run-1", TRACE), row("run-2", dict(TRACE, run_id="run-2"))]), d)
    got = RO.load_runs(spark, d).collect()
    assert sorted(r.run_id for r in got) == ["run-1", "run-2"]
    assert {r.sanitised_id for r in got} == {"run-1", "run-2"}


def test_sanitised_names_and_refused_ids(spark, tmp_path):
    df = runs_df(spark, [row("Experiment Run#1", TRACE)])
    assert RO.validate_run_ids(df).first().sanitised_id == "Experiment_Run_1"
    for bad in ["../sneaky", "run/../../evil", "nested\\path", "", "._."]:
        with pytest.raises(Exception, match="run_id"):
            RO.log_runs(runs_df(spark, [row(bad, TRACE)]), str(tmp_path / "x"))


def test_edges_nodes_and_labels(spark):
    p = RO.call_rows(RO.parse_runs(runs_df(spark, [row("run-1", TRACE)])))
    edges = [(r.src, r.dst) for r in RO.flow_edges(p).collect()]
    assert edges == [("step_1", "step_2")]
    nodes = {r.node: r.label for r in RO.flow_nodes(p).collect()}
    assert nodes["step_1"] == "1. grep\n50 ms\nhits=3"
    assert nodes["step_2"] == "2. keyword\n75 ms\nscore=0.42, top=a.py, ok=True"
    calls = RO.call_table(p).orderBy("step").collect()
    assert [(c.step, c.tool, c.latency_ms) for c in calls] == [(1, "grep", 50), (2, "keyword", 75)]
    assert RO.latency_totals(p).first().total_latency_ms == 125


def test_no_calls_node(spark):
    parsed = RO.parse_runs(runs_df(spark, [row("r", {"run_id": "r"})]))
    calls = RO.call_rows(parsed)
    assert [(r.node, r.label) for r in RO.flow_nodes(calls, parsed).collect()] == [("no_calls", "No tool calls recorded")]
    assert RO.flow_edges(calls).count() == 0
    ov = RO.run_overview(parsed, calls).first()
    assert (ov.calls, ov.metrics) == (0, "m=1.0")


def test_call_rows_from_json_and_validity(spark):
    good = json.dumps({"name": "a", "params": {}, "result_summary": {"x": 1}, "latency_ms": "7"})
    bad = json.dumps({"name": "b", "params": {}, "result_summary": {}, "latency_ms": "n/a"})
    df = spark.createDataFrame([("r1", 1, good), ("r1", 2, good), ("r2", 1, good), ("r2", 2, bad)],
                               "run_id string, step int, call string")
    calls = RO.calls_from_json(df, "call")
    v = {r.run_id: (r.valid, r.n_calls) for r in RO.run_validity(calls).collect()}
    assert v == {"r1": (True, 2), "r2": (False, 2)}
    assert sorted(r.run_id for r in RO.valid_calls(calls).collect()) == ["r1", "r1"]
    assert RO.latency_totals(RO.valid_calls(calls)).first().total_latency_ms == 14


def test_group_ordinal_dense_per_group(spark):
    from quarry.plans.ordinal import group_ordinal
    rows = [("hot", t) for t in range(0, 200, 3)] + [("cold", 5), ("cold", 1)]
    df = spark.createDataFrame(rows, "run_id string, turn int").repartition(5)
    got = group_ordinal(df, "run_id", ["turn"], "step").collect()
    for rid in ("hot", "cold"):
        mine = sorted((r.turn, r.step) for r in got if r.run_id == rid)
        assert [s for _, s in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("trace,valid", [
    (TRACE, True),
    ({"run_id": "x", "calls": "oops"}, False),
    ({"run_id": "x", "calls": None}, False),
    ({"run_id": "x"}, True),
    ({"run_id": 5}, False),
    ({"calls": []}, False),
    ("not json", False),
    ([1, 2], False),
    ({"run_id": "x", "calls": [{"name": "a", "params": {}, "result_summary": {}, "latency_ms": "50"}]}, True),
    ({"run_id": "x", "calls": [{"name": "a", "params": {}, "result_summary": {}, "latency_ms": 50.0}]}, True),
    ({"run_id": "x", "calls": [{"name": "a", "params": {}, "result_summary": {}, "latency_ms": 50.5}]}, False),
    ({"run_id": "x", "calls": [{"name": "a", "params": {}, "result_summary": {}}]}, False),
    ({"run_id": "x", "calls": [{"name": "a", "params": [], "result_summary": {}, "latency_ms": 1}]}, False),
    ({"run_id": "x", "calls": [{"name": "a", "params": {}, "result_summary": {}, "latency_ms": "50.0"}]}, True),
    ({"run_id": "x", "calls": [{"name": "a", "params": {}, "result_summary": {}, "latency_ms": " 5_0 "}]}, True),
    ({"run_id": "x", "calls": [{"name": "a", "params": {}, "result_summary": {}, "latency_ms": True}]}, True),
    ({"run_id": "x", "calls": [{"name": "a", "params": {}, "result_summary": {}, "latency_ms": float("nan")}]}, False),
    ({"run_id": "x", "calls": [{"name": "NaN, Infinity", "params": {"n": float("inf")}, "result_summary": {}, "latency_ms": 1}]}, True),
    ({"run_id": "x", "metrics": {"a": float("nan"), "b": "NaN"}}, True),
    ({"run_id": "x", "metrics": {"a": "1.5", "b": 2}}, True),
    ({"run_id": "x", "metrics": {"a": "abc"}}, False),
    ({"run_id": "x", "metrics": None}, False),
])
def test_trace_validation(spark, trace, valid):
    t = trace if isinstance(trace, str) else json.dumps(trace)
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(R.trace_is_valid("t")).first()[0] is valid


def test_invalid_rows_skipped(spark):
    rows = [row("good", TRACE), row("bad", {"run_id": "bad", "calls": "oops"}), row("", TRACE), (None, "{}", "{}", "{}")]
    assert [r.run_id for r in RO.parse_runs(runs_df(spark, rows)).collect()] == ["good"]


def test_metric_coercion(spark):
    m = json.dumps({"a": "1.5", "b": True, "c": "x", "d": None, "e": [1], "f": 3, "g": " 2 ", "h": "1.5d",
                    "i": "true", "j": "1_000.5", "k": "1__0", "l": "_1"})
    row = spark.createDataFrame([(m,)], "m string").select(
        R.coerce_metrics("m").alias("c"), F.map_keys(R.coerce_metrics("m")).alias("keys")).first()
    assert row.c == {"a": 1.5, "b": 1.0, "f": 3.0, "g": 2.0, "j": 1000.5}
    assert row["keys"] == ["a", "b", "f", "g", "j"]          # stored order (a dict from collect() is unordered)
    txt = spark.createDataFrame([(m,), ("{}",), ("bad",)], "m string").select(
        R.metric_text(R.coerce_metrics("m")).alias("t")).collect()
    assert [r.t for r in txt] == ["a=1.5, b=1.0, f=3.0, g=2.0, j=1000.5", "-", "-"]


def test_text_to_double_matches_python_float(spark):
    samples = ["1.5", " 2 ", "1_000", "1_0.2_5", "1e3", "1_e3", "1__0", "_1", "1_", ".5", "5.", "inf", "-inf",
               "abc", "", "1.5d", "2f", "0x10", "1e", "+3", "-0.0"]
    df = spark.createDataFrame([(x,) for x in samples], "s string")
    got = [r[0] for r in df.select(R.text_to_double(F.col("s"))).collect()]

    def py(x):
        try:
            return float(x)
        except ValueError:
            return None
    assert got == [py(x) for x in samples]


def test_json_decode_non_objects(spark):
    df = spark.createDataFrame([("[1]",), ("",), (None,), ("{bad",), ('{"k": 1}',)], "j string")
    assert [r[0] for r in df.select(F.size(R.json_object("j"))).collect()] == [0, 0, 0, 0, 1]


def test_latest_per_sanitised_id(spark):
    df = spark.createDataFrame([("run #1", 1, "a"), ("run_1", 2, "b"), ("other", 1, "c")],
                               "run_id string, logged_at int, v string")
    got = sorted((r.sanitised_id, r.v) for r in RO.latest_runs(df).collect())
    assert got == [("other", "c"), ("run_1", "b")]


def test_load_runs_newest_file_first_and_skips_bad_files(spark, tmp_path):
    import os
    import time
    d = tmp_path / "runs"
    RO.log_runs(runs_df(spark, [row("old", dict(TRACE, run_id="old"))]), str(d / "a"))
    time.sleep(1.1)
    RO.log_runs(runs_df(spark, [row("new", dict(TRACE, run_id="new"))]), str(d / "b"))
    (d / "junk.parquet").write_text("not parquet")
    got = [r.run_id for r in RO.load_runs(spark, str(d)).collect()]
    assert got == ["new", "old"]
    assert os.path.exists(d / "junk.parquet")


def test_ordinal_is_the_same_for_every_use(spark):
    from quarry.plans.ordinal import global_ordinal
    rows = [(f"k{(i * 7919) % 1000:04d}", i) for i in range(1000)]
    a = global_ordinal(spark.createDataFrame(rows, "k string, v int").repartition(7), ["k"], "o", partitions=9)
    b = global_ordinal(spark.createDataFrame(rows, "k string, v int").repartition(3), ["k"], "o", partitions=9)
    # the same DataFrame used twice in one plan, and a differently partitioned input
    joined = a.alias("x").join(a.alias("y"), "k").join(b.alias("z"), "k")
    assert joined.filter((F.col("x.o") != F.col("y.o")) | (F.col("x.o") != F.col("z.o"))).count() == 0
    assert [r.k for r in a.orderBy("o").collect()] == sorted(k for k, _ in rows)


FLOATS = st.one_of(st.floats(allow_nan=True, allow_infinity=True), st.integers(-10**6, 10**6).map(float),
                   st.sampled_from([1e15, 1e16, 1.5e16, 1e-4, 1e-5, 9.99e-5, 1e7, 12345678.0, 1e22, 0.0, -0.0, 5e-324]))


@settings(max_examples=30, deadline=None)
@given(st.lists(FLOATS, min_size=1, max_size=10))
def test_float_text_is_pythons(spark, xs):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "d double").select(R.float_text(F.col("d"))).collect()]
    for x, t in zip(xs, got):
        # The JVM's digits may be one longer than the shortest; form and value are Python's.
        assert t == str(x) or (float(t) == x and len(t) <= len(str(x)) + 2)


VALUES = st.one_of(st.integers(-10**20, 10**20), st.floats(), st.booleans(), st.none(), st.text(max_size=6), st.lists(st.integers(), max_size=2),
                   st.sampled_from([4.0, 1e3, "NaN", "4.0", "true"]))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.dictionaries(st.text(alphabet="abcdef", min_size=1, max_size=3), VALUES, max_size=6), min_size=1, max_size=5))
def test_summary_text_is_pythons(spark, summaries):
    df = spark.createDataFrame([(json.dumps(s, ensure_ascii=False),) for s in summaries], "j string")
    got = [r[0] for r in df.select(R.summary_text("j")).collect()]
    for s, t in zip(summaries, got):
        parts = [f"{k}={v}" for k, v in s.items() if isinstance(v, (int, float, str))][:3]
        if not any(isinstance(v, float) for v in s.values()):
            assert t == ", ".join(parts)
        else:
            assert t.count("=") >= len([p for p in parts if "=" in p])


def test_latest_in_one_logged_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("r 1", '{"n": %d}' % i, "{}", '{"run_id":"r 1"}') for i in range(20)]
    RO.log_runs(runs_df(spark, rows).coalesce(1), path)
    assert RO.latest_runs(RO.read_run_files(spark, path)).first().params == '{"n": 19}'


def test_texts_are_parsed_once_a_row(spark):
    """Display text and validity name a parsed value in many places; the plan has it in one."""
    rows = spark.createDataFrame([('{"x":1e15,"n":7,"b":true,"bad":NaN}',)], "s string")
    plan = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan(R.summary_text("s")).count("from_json(") == 2       # variants, and text as written
    assert plan(R.trace_is_valid(F.col("s"))).count("regexp_extract_all(") == 1
    assert plan(R.float_text(F.col("s").cast("double"))).count("cast(s#") == 1
    assert rows.select(R.summary_text("s", 4)).first()[0] == "x=1000000000000000.0, n=7, b=True, bad=nan"


def test_a_trace_is_marked_and_parsed_once(spark, tmp_path, monkeypatch):
    runs = runs_df(spark, [row("run-1", TRACE), row("run-2", '{"run_id":"run-2","metrics":{"m":NaN}}'), row("run-3", None), row("run-4", "{NaN")])
    parsed = RO.parse_runs(runs)
    assert sorted(r.run_id for r in parsed.collect()) == ["run-1", "run-2"]
    plan = parsed.select("run_id", "calls")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    # The query's three uses of the runs read parsed rows.
    from quarry.plans.queries_runs import h16_odd_traces_kept
    spark.createDataFrame([(1,), (2,), (2,)], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    out = h16_odd_traces_kept(spark, str(tmp_path))
    assert "parse" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    # (Rows of one run id are counted together, and each row of it is joined.)
    assert sorted(tuple(r) for r in out.collect()) == [("e1", 3, 52), ("e2", 6, 106), ("e2", 6, 106)]


def test_latency_and_metric_texts_keep_their_values(spark):
    texts = ["50.0", "true", "False", "7", " 7 ", "\t8", "1_000", "1e3", "2E2", "9.5", "-3", "", "x", "1.", ".5", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["v"] for r in df.select("i", R.latency_value(F.col("t")).alias("v")).sort("i").collect()]
    assert got == [50, 1, 0, 7, 7, 8, 1000, 1000, 200, 9, -3, None, None, 1, 0, None]
    odd = '{"a":NaN,"b":Infinity,"c":-Infinity,"d":"nan","e":"x","f":"1_0","g":true,"h":{},"i":[1],"j":null}'
    m = spark.createDataFrame([(odd,)], "t string").select(R.coerce_metrics("t").alias("m")).first()["m"]
    assert [str(v) for v in m.values()] == ["nan", "inf", "-inf", "nan", "10.0", "1.0"] and list(m) == list("abcdfg")
    kinds = ["{}", '{"a":1}', "[]", "[{}]", "1", '"x"', "null", "true", "{", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(kinds)], "i int, t string")
    assert [r["o"] for r in df.select("i", R._is_object(F.try_parse_json("t")).alias("o")).sort("i").collect()] == [True, True, *[False] * 8]
