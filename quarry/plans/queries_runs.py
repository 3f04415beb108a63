"""Run-log queries: conversations and events turned into run records.

conversations -> one run per conversation: run_id ``conv-<id>``, one call per
turn as a JSON call object (name = role, latency = text length as a numeric
*string*, summary = chars/lines/role); turns of role ``system`` carry latency
``n/a``, which makes that call and so the run invalid, so it is skipped.
Calls stay normalised rows (run_id, step, ...): no run is gathered into one
row, whatever its size.
events -> one call-less run per event: run id from event type and user,
metrics = the event's ``props`` JSON.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import runs as R
from quarry.functions.text import split_lines
from quarry.operators import runs as RO
from quarry.plans.catalog import register
from quarry.plans.ordinal import group_ordinal
from quarry.plans.sizing import spread_small_input
from quarry.session import cut_lineage
from quarry.sources.tables import table


def conversation_calls(spark, sf_dir, steps=True):
    """Call rows (run_id, step, name, params, result_summary, latency_ms, valid):
    one JSON call object per turn, validated like a trace's calls. Steps are
    positions by turn, counted in two levels (runs of turn numbers, then turns),
    and only where a query shows them; no run is gathered into one row."""
    c = table(spark, sf_dir, "conversations")
    call = F.to_json(F.struct(
        F.col("role").alias("name"),
        F.struct(F.col("turn").alias("turn")).alias("params"),
        F.struct(F.length("text").alias("chars"), F.size(split_lines("text")).alias("lines"),
                 F.col("role").alias("role")).alias("result_summary"),
        F.when(F.col("role") == "system", F.lit("n/a"))
         .otherwise(F.length("text").cast("string")).alias("latency_ms")))
    rows = c.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("run_id"), "turn",
                    call.alias("call"))
    rows = group_ordinal(rows, "run_id", ["turn"], "step") if steps else rows.withColumn("step", F.lit(0))
    return RO.calls_from_json(rows, "call")


def conversation_runs(spark, sf_dir):
    """Run rows (run_id, params, metrics) from per-conversation aggregates."""
    c = table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"),
        F.min_by("role", "turn").alias("first_role"),
        F.max(F.col("role") == "system").alias("has_system"))
    return g.select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("run_id"),
        F.to_json(F.struct(F.col("conv_id"), F.lit("conversations").alias("source"))).alias("params"),
        F.to_json(F.struct("turns", "chars", "first_role", "has_system")).alias("metrics"))


def event_run_id():
    return (F.when(F.col("event_type") == "error", F.concat_ws("/", "event_type", F.col("user_id").cast("string")))
            .when(F.col("event_type") == "signup", F.concat(F.lit(".."), F.col("user_id").cast("string")))
            .otherwise(F.concat(F.col("event_type"), F.lit(" #"), F.col("user_id").cast("string"))))


SQL_EVENT_RUN_ID = """CASE WHEN event_type = 'error' THEN event_type || '/' || CAST(user_id AS VARCHAR)
     WHEN event_type = 'signup' THEN '..' || CAST(user_id AS VARCHAR)
     ELSE event_type || ' #' || CAST(user_id AS VARCHAR) END"""


def event_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rid = F.concat(F.col("event_type"), F.lit(" #"), F.col("user_id").cast("string"))
    return e.select("event_id", "ts", rid.alias("run_id"),
                    F.to_json(F.struct(F.col("event_id"))).alias("params"),
                    F.col("props").alias("metrics"),
                    F.to_json(F.struct(rid.alias("run_id"))).alias("trace"))


def _valid_calls(spark, sf_dir, steps=True):
    return RO.valid_calls(conversation_calls(spark, sf_dir, steps))


SQL_VALID_CONV = """valid AS (
  SELECT conv_id, 'conv-' || CAST(conv_id AS VARCHAR) AS run_id FROM conversations
  GROUP BY conv_id HAVING NOT bool_or(role = 'system')),
turns AS (
  SELECT 'conv-' || CAST(c.conv_id AS VARCHAR) AS run_id, c.role, c.text,
         CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS INTEGER) AS step,
         length(c.text) AS chars,
         len(CASE WHEN c.text = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(c.text, '\\n$', ''), chr(10)) END) AS lines
  FROM conversations c JOIN valid v USING (conv_id))"""


@register("k6_parsed_runs", f"""WITH {SQL_VALID_CONV}
SELECT run_id, CAST(count(*) AS INTEGER) AS n_calls, CAST(sum(chars) AS BIGINT) AS total_latency_ms
FROM turns GROUP BY run_id""")
def k6_parsed_runs(spark, sf_dir):
    calls = _valid_calls(spark, sf_dir, steps=False)
    counts = calls.groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("n_calls"))
    return RO.latency_totals(calls).join(counts, "run_id")


@register("h16_trace_validation", """
SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS run_id, NOT bool_or(role = 'system') AS valid
FROM conversations GROUP BY conv_id""")
def h16_trace_validation(spark, sf_dir):
    """A run is valid when every call validates (system turns carry latency "n/a")."""
    return RO.run_validity(conversation_calls(spark, sf_dir, steps=False)).select("run_id", "valid")


@register("b12_valid_run_rows", f"""WITH {SQL_VALID_CONV}
SELECT run_id FROM valid""")
def b12_valid_run_rows(spark, sf_dir):
    return RO.run_validity(conversation_calls(spark, sf_dir, steps=False)).filter("valid").select("run_id")


@register("d11_run_overview", f"""WITH {SQL_VALID_CONV}
SELECT run_id, CAST(count(*) AS INTEGER) AS calls,
       'turns=' || CAST(CAST(count(*) AS DOUBLE) AS VARCHAR) || ', chars=' || CAST(CAST(sum(chars) AS DOUBLE) AS VARCHAR)
       || ', has_system=0.0' AS metrics
FROM turns GROUP BY run_id""")
def d11_run_overview(spark, sf_dir):
    calls = _valid_calls(spark, sf_dir, steps=False)
    runs = (conversation_runs(spark, sf_dir).join(calls.select("run_id").distinct(), "run_id", "left_semi")
            .withColumn("metrics_map", R.coerce_metrics("metrics")))
    return RO.run_overview(runs, calls)


@register("e3_call_steps", f"""WITH {SQL_VALID_CONV}
SELECT run_id, step, role AS tool, CAST(chars AS BIGINT) AS latency_ms FROM turns""")
def e3_call_steps(spark, sf_dir):
    return RO.call_table(_valid_calls(spark, sf_dir)).select("run_id", "step", "tool", "latency_ms")


@register("f7_summary_text", f"""WITH {SQL_VALID_CONV}
SELECT run_id, step, 'chars=' || CAST(chars AS VARCHAR) || ', lines=' || CAST(lines AS VARCHAR) || ', role=' || role AS summary
FROM turns""")
def f7_summary_text(spark, sf_dir):
    return RO.call_table(_valid_calls(spark, sf_dir)).select("run_id", "step", "summary")


@register("h18_call_label", f"""WITH {SQL_VALID_CONV}
SELECT run_id, 'step_' || CAST(step AS VARCHAR) AS node,
       CAST(step AS VARCHAR) || '. ' || role || chr(10) || CAST(chars AS VARCHAR) || ' ms' || chr(10)
       || 'chars=' || CAST(chars AS VARCHAR) || ', lines=' || CAST(lines AS VARCHAR) || ', role=' || role AS label
FROM turns""")
def h18_call_label(spark, sf_dir):
    return RO.flow_nodes(_valid_calls(spark, sf_dir))


@register("e4_flow_edges", f"""WITH {SQL_VALID_CONV}
SELECT run_id, 'step_' || CAST(step - 1 AS VARCHAR) AS src, 'step_' || CAST(step AS VARCHAR) AS dst
FROM turns WHERE step > 1""")
def e4_flow_edges(spark, sf_dir):
    return RO.flow_edges(_valid_calls(spark, sf_dir))


@register("d12_latency_totals", f"""WITH {SQL_VALID_CONV}
SELECT run_id, CAST(sum(chars) AS BIGINT) AS total_latency_ms FROM turns GROUP BY run_id""")
def d12_latency_totals(spark, sf_dir):
    return RO.latency_totals(_valid_calls(spark, sf_dir, steps=False))


@register("e4_flow_nodes_no_calls", """
SELECT event_type || ' #' || CAST(user_id AS VARCHAR) AS run_id, 'no_calls' AS node,
       'No tool calls recorded' AS label, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY ALL""")
def e4_flow_nodes_no_calls(spark, sf_dir):
    """Event runs have no calls: each gets the single node ``no_calls``."""
    parsed = RO.parse_runs(event_runs(spark, sf_dir))
    nodes = RO.flow_nodes(RO.call_rows(parsed), parsed.select("run_id"))
    return nodes.groupBy("run_id", "node", "label").agg(F.count(F.lit(1)).alias("n"))


@register("h15_metric_coercion", """
SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, 'k=' || CAST(CAST(json_extract(props, '$.k') AS DOUBLE) AS VARCHAR) AS metrics
FROM events""")
def h15_metric_coercion(spark, sf_dir):
    e = event_runs(spark, sf_dir).select("event_id", R.coerce_metrics("metrics").alias("m"))
    return e.select("event_id", F.col("m")["k"].alias("k"), R.metric_text("m").alias("metrics"))


@register("h15_conversation_metrics", """
SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS run_id, CAST(count(*) AS DOUBLE) AS turns,
       CAST(sum(length(text)) AS DOUBLE) AS chars,
       CAST(CASE WHEN bool_or(role = 'system') THEN 1.0 ELSE 0.0 END AS DOUBLE) AS has_system,
       CAST(3 AS INTEGER) AS n_metrics
FROM conversations GROUP BY conv_id""")
def h15_conversation_metrics(spark, sf_dir):
    """String metric ``first_role`` is dropped; the boolean becomes 1.0/0.0."""
    m = conversation_runs(spark, sf_dir).select("run_id", R.coerce_metrics("metrics").alias("m"))
    return m.select("run_id", m["m"]["turns"].alias("turns"), m["m"]["chars"].alias("chars"),
                    m["m"]["has_system"].alias("has_system"), F.size("m").alias("n_metrics"))


@register("h14_json_decode", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       CAST(len(json_keys(props)) AS INTEGER) AS n_keys FROM events""")
def h14_json_decode(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", R.json_object("props").alias("m"))
    return e.select("event_id", F.try_variant_get(e["m"]["k"], "$", "bigint").alias("k"),
                    F.size("m").alias("n_keys"))


@register("h13_json_encode", """
SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS run_id, CAST(turn AS BIGINT) AS turn,
       CAST(to_json({'turn': turn, 'role': role, 'text': text}) AS VARCHAR) AS doc
FROM conversations""")
def h13_json_encode(spark, sf_dir):
    """JSON text of a record, non-ASCII kept as is."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("run_id"), "turn",
                    F.to_json(F.struct("turn", "role", "text")).alias("doc"))


@register("h11_run_id_check", f"""
SELECT event_id, CASE
  WHEN rid IS NULL OR rid = '' THEN 'run_id must be a non-empty string'
  WHEN contains(rid, '/') OR contains(rid, chr(92)) THEN 'run_id must not contain path separators'
  WHEN contains(rid, '..') THEN 'run_id must not contain ''..'''
  WHEN trim(regexp_replace(rid, '[^A-Za-z0-9_.-]+', '_', 'g'), '._') = '' THEN 'run_id contains no valid characters after sanitisation'
  END AS problem
FROM (SELECT event_id, {SQL_EVENT_RUN_ID} AS rid FROM events)""")
def h11_run_id_check(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", R.run_id_problem(event_run_id()).alias("problem"))


@register("h12_sanitise_run_id", f"""
SELECT event_id, trim(regexp_replace(rid, '[^A-Za-z0-9_.-]+', '_', 'g'), '._') AS sanitised_id
FROM (SELECT event_id, {SQL_EVENT_RUN_ID} AS rid FROM events)""")
def h12_sanitise_run_id(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", R.sanitise_run_id(event_run_id()).alias("sanitised_id"))


@register("e5_latest_run", """
SELECT sanitised_id, event_id FROM (
  SELECT event_type || '_' || CAST(user_id AS VARCHAR) AS sanitised_id, event_id,
         row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1""")
def e5_latest_run(spark, sf_dir):
    """Latest event run per sanitised id ("click #3" -> click_3)."""
    r = event_runs(spark, sf_dir)
    r = r.withColumn("logged_at", F.struct("ts", "event_id"))
    return RO.latest_runs(r).select("sanitised_id", "event_id")


@register("a12_run_log_round_trip", """
SELECT event_type || ' #' || CAST(user_id AS VARCHAR) AS run_id,
       event_type || '_' || CAST(user_id AS VARCHAR) AS sanitised_id,
       '{"event_id":' || CAST(event_id AS VARCHAR) || '}' AS params,
       'k=' || CAST(CAST(json_extract(props, '$.k') AS DOUBLE) AS VARCHAR) AS metrics,
       CAST(0 AS INTEGER) AS calls
FROM events""")
def a12_run_log_round_trip(spark, sf_dir):
    """Every event logged as a run (appended Parquet run log in the shared
    folder), loaded back from the files, parsed and shown as the overview."""
    from quarry.session import scratch_path
    path = scratch_path(spark, "runs")
    RO.log_runs(event_runs(spark, sf_dir).select("run_id", "params", "metrics", "trace"), path)
    parsed = RO.load_runs(spark, path)
    overview = RO.run_overview(parsed, RO.call_rows(parsed))
    # run ids repeat (one run per event), so rows are matched on the file's params
    return (parsed.select("run_id", "sanitised_id", "params", "metrics_map")
            .withColumn("metrics", R.metric_text("metrics_map"))
            .join(overview.select("run_id", "calls").distinct(), "run_id")
            .select("run_id", "sanitised_id", "params", "metrics", "calls"))


# Runs whose JSON holds what Python's writer and reader allow: bare NaN, latency
# as text with a zero fraction or as a boolean, floats of all magnitudes.
ODD_FLOATS = ["0.0001", "0.00001234", "1234567.0", "12345678.0", "1e15", "1.5e16", "4.0", "-0.5"]
SQL_PYTHON_FLOATS = ["0.0001", "1.234e-05", "1234567.0", "12345678.0", "1000000000000000.0", "1.5e+16", "4.0", "-0.5"]


def odd_runs(spark, sf_dir):
    """One run per event: its float by event id, a NaN metric, three calls with
    latencies "50.0", true and the event id as a float."""
    # (A few bytes of an event become JSON that takes long to parse.)
    e = spread_small_input(table(spark, sf_dir, "events").select("event_id"))
    value = F.element_at(F.array(*map(F.lit, ODD_FLOATS)), (F.col("event_id") % len(ODD_FLOATS) + 1).cast("int"))
    rid = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    call = lambda latency: F.concat(F.lit('{"name":"t","params":{},"result_summary":{"x":'), value,
                                    F.lit(',"n":7,"bad":NaN,"more":1},"latency_ms":'), latency, F.lit("}"))
    trace = F.concat(F.lit('{"run_id":"'), rid, F.lit('","calls":['), call(F.lit('"50.0"')), F.lit(","), call(F.lit("true")), F.lit(","),
                     call(F.concat(F.col("event_id").cast("string"), F.lit(".0"))), F.lit('],"metrics":{"m":NaN}}'))
    metrics = F.concat(F.lit('{"v":'), value, F.lit(',"nan":NaN,"inf":-Infinity,"text":"5_0"}'))
    return e.select(rid.alias("run_id"), F.lit("{}").alias("params"), metrics.alias("metrics"), trace.alias("trace"))


def _sql_float() -> str:
    return "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(SQL_PYTHON_FLOATS)) + " END"


@register("h16_odd_traces_kept", """
SELECT 'e' || CAST(event_id AS VARCHAR) AS run_id, CAST(3 AS INTEGER) AS calls, CAST(51 + event_id AS BIGINT) AS total_latency_ms FROM events""")
def h16_odd_traces_kept(spark, sf_dir):
    """No run with NaN metrics or latencies "50.0", true, 7.0 is lost."""
    # Runs and calls are joined and summed three times, and parsed once.
    parsed = cut_lineage(RO.parse_runs(odd_runs(spark, sf_dir)).select("run_id", "metrics_map", "calls"))
    calls = RO.call_rows(parsed)
    overview = RO.run_overview(parsed, calls).select("run_id", "calls")
    return overview.join(RO.latency_totals(calls), "run_id")


@register("h20_metric_text_python", f"""
SELECT 'e' || CAST(event_id AS VARCHAR) AS run_id, 'v=' || {_sql_float()} || ', nan=nan, inf=-inf, text=50.0' AS metrics FROM events""")
def h20_metric_text_python(spark, sf_dir):
    parsed = RO.parse_runs(odd_runs(spark, sf_dir))
    return RO.run_overview(parsed, RO.call_rows(parsed)).select("run_id", "metrics")


@register("h17_summary_text_python", f"""
SELECT 'e' || CAST(event_id AS VARCHAR) AS run_id, CAST(s AS INTEGER) AS step, 'x=' || {_sql_float()} || ', n=7, bad=nan' AS summary
FROM events, (SELECT unnest([1, 2, 3]) AS s)""")
def h17_summary_text_python(spark, sf_dir):
    return RO.call_table(RO.call_rows(RO.parse_runs(odd_runs(spark, sf_dir)))).select("run_id", "step", "summary")


@register("e5_latest_in_batch", """
SELECT event_type || '_' || CAST(user_id AS VARCHAR) AS sanitised_id, CAST(count(*) AS BIGINT) AS logged, CAST(1 AS BIGINT) AS latest
FROM events GROUP BY ALL""")
def e5_latest_in_batch(spark, sf_dir):
    """Runs of one id logged in one batch: all are kept, one is the latest."""
    from quarry.session import scratch_path
    path = scratch_path(spark, "runs")
    RO.log_runs(event_runs(spark, sf_dir).select("run_id", "params", "metrics", "trace"), path)
    log = RO.read_run_files(spark, path)
    latest = RO.latest_runs(log).groupBy("sanitised_id").agg(F.count("*").alias("latest"))
    return log.groupBy("sanitised_id").agg(F.count("*").alias("logged")).join(latest, "sanitised_id")


@register("f6_runs_newest_first", """
SELECT CAST(row_number() OVER (ORDER BY g DESC) AS INTEGER) AS place, 'run-' || g AS run_id
FROM (SELECT DISTINCT event_id % 3 AS g FROM events)""")
def f6_runs_newest_first(spark, sf_dir):
    """Three batches logged one after another, listed newest file first."""
    import time

    from quarry.session import scratch_path
    path = scratch_path(spark, "runs")
    for g in range(3):
        some = table(spark, sf_dir, "events").where(F.col("event_id") % 3 == g).agg(F.count("*").alias("n"))
        RO.log_runs(some.where("n > 0").select(F.lit(f"run-{g}").alias("run_id"), F.lit("{}").alias("params"),
                                               F.lit("{}").alias("metrics"), F.lit(f'{{"run_id":"run-{g}"}}').alias("trace")), f"{path}/{g}")
        time.sleep(1.1)     # file times have whole seconds on some file systems
    listed = RO.load_runs(spark, path)
    order = Window.orderBy(F.desc("file_time"), F.asc("file_path"))
    return listed.select(F.row_number().over(order).alias("place"), "run_id")
