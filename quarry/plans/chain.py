"""Restrict-and-search chains: find -> grep -> keyword over one corpus (K10).

Each step narrows the corpus to the paths the previous step returned
(``left_semi`` join on path, no pairs formed), the last step's hits are the
result, and every step leaves one trace row (tool, parameters, number of
results). The trace rows form a run record for the run log.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import bm25, grep as G, paths as P


def _step_hits(corpus: DataFrame, step: dict) -> DataFrame:
    tool = step["tool"]
    if tool == "find":
        ents = P.path_entries(corpus).filter(F.col("type") == "file")
        return P.find_paths(ents, step.get("pattern"), None, step.get("globs"), sort=False)
    if tool == "grep":
        return G.grep(corpus, step["pattern"])
    if tool == "keyword":
        q = corpus.sparkSession.createDataFrame([(0, step["query"])], "qid long, query string")
        return bm25.bm25_search(corpus, q, k=int(step.get("k", bm25.DEFAULT_K)))
    raise ValueError(f"unknown tool {tool}")


def run_steps(corpus: DataFrame, steps: list[dict], run_id: str = "chain") -> tuple[DataFrame, DataFrame]:
    """(hits of the last step, trace rows (run_id, step, tool, params, results))."""
    current = corpus
    traces = []
    hits = None
    for i, step in enumerate(steps, start=1):
        hits = _step_hits(current, step)
        traces.append(hits.agg(F.count(F.lit(1)).alias("results")).select(
            F.lit(run_id).alias("run_id"), F.lit(i).alias("step"), F.lit(step["tool"]).alias("tool"),
            F.lit(json.dumps({k: v for k, v in step.items() if k != "tool"}, sort_keys=True)).alias("params"),
            "results"))
        current = current.join(hits.select("path").distinct(), "path", "left_semi")
    trace = traces[0]
    for t in traces[1:]:
        trace = trace.unionByName(t)
    return hits, trace


def trace_to_run(trace: DataFrame) -> DataFrame:
    """One run-log row (run_id, params, metrics, trace JSON) from trace rows."""
    calls = F.sort_array(F.collect_list(F.struct(
        F.col("step"), F.col("tool").alias("name"), F.col("params"),
        F.to_json(F.struct(F.col("results"))).alias("result_summary"))))
    g = trace.groupBy("run_id").agg(calls.alias("c"), F.sum("results").alias("total"))
    call_json = F.transform("c", lambda c: F.struct(
        c["name"].alias("name"), F.from_json(c["params"], "map<string,string>").alias("params"),
        F.from_json(c["result_summary"], "map<string,long>").alias("result_summary"),
        F.lit(0).alias("latency_ms")))
    return g.select("run_id", F.lit("{}").alias("params"),
                    F.to_json(F.struct(F.col("total").cast("double").alias("results"))).alias("metrics"),
                    F.to_json(F.struct(F.col("run_id"), call_json.alias("calls"))).alias("trace"))
