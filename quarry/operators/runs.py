"""Run log: write and read experiment runs, and the run-browser tables.

A run row is ``(run_id, params, metrics, trace)`` with JSON text columns.
``log_runs`` appends whole batches of runs to one Parquet table (with the
sanitised id and a ``logged_at`` time); ``load_runs`` reads every Parquet
file under a folder, skipping unreadable files and invalid rows. The browser
tables (overview, calls, flow nodes and edges) are plain DataFrames derived
from the parsed runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import runs as R

TRACE_CALLS = "array<struct<name:string,params:string,result_summary:string,latency_ms:string>>"

# Fixed values of the flow graph: node names and the label of a run without calls.
STEP_PREFIX = "step_"
NO_CALLS_NODE = "no_calls"
NO_CALLS_LABEL = "No tool calls recorded"


def validate_run_ids(runs: DataFrame) -> DataFrame:
    """Adds ``sanitised_id``; fails the job on the first refused run id."""
    problem = R.run_id_problem("run_id")
    # The check is part of the output column, so column pruning cannot drop it.
    return runs.withColumn("sanitised_id", F.when(problem.isNull(), R.sanitise_run_id("run_id")).otherwise(
        F.raise_error(F.concat(problem, F.lit(": "), F.coalesce(F.col("run_id"), F.lit("null"))))))


def log_runs(runs: DataFrame, path: str) -> None:
    """Append a batch of runs (A11). Repeated ids are all kept; the latest
    per sanitised id is the ``latest_runs`` view."""
    (validate_run_ids(runs).select("run_id", "sanitised_id", "params", "metrics", "trace")
     .withColumn("logged_at", F.current_timestamp())
     .withColumn("log_seq", F.monotonically_increasing_id())   # order inside the batch
     .write.mode("append").parquet(path))


def read_run_files(spark, path: str) -> DataFrame:
    """Every ``*.parquet`` under ``path``; unreadable files are skipped (A12)."""
    return (spark.read.option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*.parquet")
            .option("recursiveFileLookup", "true").parquet(path)
            .select("*", F.col("_metadata.file_path").alias("file_path"),
                    F.col("_metadata.file_modification_time").alias("file_time")))


def parse_runs(runs: DataFrame) -> DataFrame:
    """Parsed run rows; rows with a null/empty run id or an invalid trace are dropped (B12)."""
    # (``explode`` of a one-element array keeps the text from being marked for each use.)
    t = F.col("_marked")
    parsed = runs.select("*", F.explode(F.array(R.mark_bare(F.col("trace")))).alias("_marked")).select(
        "*",
        R.marked_trace_is_valid(t).alias("_valid"),
        # from_json keeps nested objects as their raw text (stored key order),
        # which the first-three-items summary depends on; VARIANT sorts keys.
        F.from_json(t, f"struct<calls:{TRACE_CALLS}>")["calls"].alias("_calls"))
    calls = F.transform(F.coalesce("_calls", F.array().cast(TRACE_CALLS)), lambda c: F.struct(
        c["name"].alias("name"), c["params"].alias("params"), c["result_summary"].alias("result_summary"),
        R.latency_value(c["latency_ms"]).alias("latency_ms")))
    return (parsed.filter(F.col("run_id").isNotNull() & (F.col("run_id") != "") & F.col("_valid"))
            .withColumn("calls", calls)
            .withColumn("metrics_map", R.coerce_metrics("metrics"))
            .withColumn("trace_metrics", R.coerce_metrics(F.get_json_object(t, "$.metrics")))
            .drop("_valid", "_calls", "_marked"))


def load_runs(spark, path: str) -> DataFrame:
    """Parsed runs, newest file first, ties by file path (F6)."""
    return parse_runs(read_run_files(spark, path)).orderBy(F.desc("file_time"), F.asc("file_path"))


def latest_runs(runs: DataFrame, order_col: str = "logged_at") -> DataFrame:
    """Latest record per sanitised run id (E5): what a per-id file that is
    overwritten would hold, while the log itself keeps every row. Rows of one
    logged batch are ordered by their place in it."""
    if "sanitised_id" not in runs.columns:
        runs = runs.withColumn("sanitised_id", R.sanitise_run_id("run_id"))
    later = [F.desc("log_seq")] if "log_seq" in runs.columns and order_col == "logged_at" else []
    w = Window.partitionBy("sanitised_id").orderBy(F.desc(order_col), *later)
    return runs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


CALL_FIELDS = "struct<name:string,params:string,result_summary:string,latency_ms:string>"


def call_rows(parsed: DataFrame) -> DataFrame:
    """Normalised call rows of parsed runs: (run_id, step, name, params,
    result_summary, latency_ms). ``step`` counts from 1 in trace order (E3);
    each trace is one row already, so this is a per-row ``posexplode``."""
    return (parsed.select("run_id", F.posexplode("calls").alias("pos", "c"))
            .select("run_id", (F.col("pos") + 1).cast("int").alias("step"),
                    F.col("c.name").alias("name"), F.col("c.params").alias("params"),
                    F.col("c.result_summary").alias("result_summary"),
                    F.col("c.latency_ms").alias("latency_ms")))


def calls_from_json(df: DataFrame, call_col: str = "call") -> DataFrame:
    """Call rows from one JSON call object per row (run_id, step, call):
    adds the parsed fields and ``valid`` (the ToolCall rules of the trace)."""
    c = F.from_json(R.mark_bare(F.col(call_col)), CALL_FIELDS)
    return df.select("run_id", F.col("step").cast("int").alias("step"),
                     c["name"].alias("name"), c["params"].alias("params"),
                     c["result_summary"].alias("result_summary"),
                     R.latency_value(c["latency_ms"]).alias("latency_ms"),
                     R.call_is_valid(F.col(call_col)).alias("valid"))


def run_validity(calls: DataFrame) -> DataFrame:
    """(run_id, valid, n_calls): a run is valid when all its calls are; one
    partial aggregate, so a run holding a third of all calls is no hot task."""
    return calls.groupBy("run_id").agg(F.bool_and("valid").alias("valid"),
                                       F.count(F.lit(1)).cast("int").alias("n_calls"))


def valid_calls(calls: DataFrame) -> DataFrame:
    ok = run_validity(calls).filter("valid").select("run_id")
    return calls.join(ok, "run_id", "left_semi").drop("valid")


def run_overview(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """run_id, number of calls, metric text (D11). ``runs`` has run_id and
    ``metrics_map``; call counts come from a per-run aggregate."""
    counts = calls.groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("calls"))
    return (runs.select("run_id", "metrics_map").join(counts, "run_id", "left")
            .select("run_id", F.coalesce("calls", F.lit(0)).alias("calls"),
                    R.metric_text("metrics_map").alias("metrics")))


def call_table(calls: DataFrame) -> DataFrame:
    """One row per call: step, tool, latency, summary (first three scalar items)."""
    return calls.select("run_id", "step", F.col("name").alias("tool"), "latency_ms", "result_summary",
                        R.summary_text(F.col("result_summary")).alias("summary"))


def flow_nodes(calls: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Nodes ``step_i`` with labels; runs without calls get ``no_calls``."""
    nodes = calls.select(
        "run_id", F.concat(F.lit(STEP_PREFIX), F.col("step").cast("string")).alias("node"),
        R.call_label(F.col("step"), F.col("name"), F.col("latency_ms"),
                     R.summary_text(F.col("result_summary"))).alias("label"))
    if runs is not None:
        empty = runs.select("run_id").join(calls.select("run_id"), "run_id", "left_anti")
        nodes = nodes.unionByName(empty.select("run_id", F.lit(NO_CALLS_NODE).alias("node"),
                                               F.lit(NO_CALLS_LABEL).alias("label")))
    return nodes


def flow_edges(calls: DataFrame) -> DataFrame:
    """Edge from each call to the next (E4): steps are dense positions, so
    every call after the first has exactly one incoming edge — a per-row
    projection, no window and no self-join."""
    return (calls.filter(F.col("step") > 1)
            .select("run_id", F.concat(F.lit(STEP_PREFIX), (F.col("step") - 1).cast("string")).alias("src"),
                    F.concat(F.lit(STEP_PREFIX), F.col("step").cast("string")).alias("dst")))


def latency_totals(calls: DataFrame) -> DataFrame:
    """Total latency per run (D12): partial aggregate per run."""
    return calls.groupBy("run_id").agg(F.sum(F.coalesce("latency_ms", F.lit(0))).cast("long").alias("total_latency_ms"))
