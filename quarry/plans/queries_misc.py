"""Restrict-and-search chain and symbol-index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import runs as RO
from quarry.operators import symbols as S
from quarry.plans.catalog import register
from quarry.plans.chain import run_steps, trace_to_run
from quarry.plans.queries_keyword import _sql_topk, sql_index
from quarry.sources.tables import documents_corpus, table

CHAIN = [
    {"tool": "find", "pattern": "^en/"},
    {"tool": "grep", "pattern": "License"},
    {"tool": "keyword", "query": "license software", "k": 10},
]

SQL_CHAIN_INDEX = sql_index("AND regexp_matches(path, '^en/') AND regexp_matches(text, 'License')")


@register("k10_restrict_chain", _sql_topk("SELECT CAST(0 AS BIGINT) AS qid, 'license software' AS query",
                                          10, SQL_CHAIN_INDEX))
def k10_restrict_chain(spark, sf_dir):
    """find en/ files -> grep License -> BM25 over what is left (statistics of that subset)."""
    hits, _ = run_steps(documents_corpus(spark, sf_dir), CHAIN, run_id="chain-1")
    return hits


@register("k10_chain_trace", """
WITH f AS (SELECT lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text FROM documents
           WHERE regexp_matches(lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt', '^en/')),
g AS (SELECT path, unnest(CASE WHEN text = '' THEN []::VARCHAR[]
                              ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END) AS line FROM f),
gl AS (SELECT * FROM g WHERE regexp_matches(line, 'License')),
kw AS (SELECT count(DISTINCT path) AS n FROM gl)
SELECT 'chain-1' AS run_id, 1 AS step, 'find' AS tool, '{"pattern": "^en/"}' AS params, (SELECT count(*) FROM f) AS results
UNION ALL SELECT 'chain-1', 2, 'grep', '{"pattern": "License"}', (SELECT count(*) FROM gl)
UNION ALL SELECT 'chain-1', 3, 'keyword', '{"k": 10, "query": "license software"}', (SELECT least(n, 10) FROM kw)""")
def k10_chain_trace(spark, sf_dir):
    _, trace = run_steps(documents_corpus(spark, sf_dir), CHAIN, run_id="chain-1")
    return trace


SQL_CHAIN_COUNTS = """
WITH f AS (SELECT lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text FROM documents
           WHERE regexp_matches(lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt', '^en/')),
g AS (SELECT path, unnest(CASE WHEN text = '' THEN []::VARCHAR[]
                              ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END) AS line FROM f),
gl AS (SELECT * FROM g WHERE regexp_matches(line, 'License')),
kw AS (SELECT count(DISTINCT path) AS n FROM gl),
counts AS (
  SELECT 1 AS step, 'find' AS tool, (SELECT count(*) FROM f) AS results
  UNION ALL SELECT 2, 'grep', (SELECT count(*) FROM gl)
  UNION ALL SELECT 3, 'keyword', (SELECT least(n, 10) FROM kw))"""


@register("k6_chain_run_record", SQL_CHAIN_COUNTS + """
SELECT 'chain-1' AS run_id, CAST(step AS INTEGER) AS step, tool, CAST(0 AS BIGINT) AS latency_ms,
       'results=' || CAST(results AS VARCHAR) AS summary FROM counts""")
def k6_chain_run_record(spark, sf_dir):
    """The chain's trace as a run-log row (trace JSON), parsed back and shown
    as the call table: the JSON round trip of the run log."""
    _, trace = run_steps(documents_corpus(spark, sf_dir), CHAIN, run_id="chain-1")
    parsed = RO.parse_runs(trace_to_run(trace))
    return RO.call_table(RO.call_rows(parsed)).select("run_id", "step", "tool", "latency_ms", "summary")


# Python modules derived from ``part`` rows, one file per part:
#   line 1  def <name>_<partkey>():          -> def
#   line 5  class Part<partkey>:             -> def
#   line 9  brand_<n>(<partkey>)             -> ref (call of a name)
#   line 10 obj.method_<type>()              -> ref (call of an attribute)
def part_modules(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]+", "_"))
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1)
    key = F.col("p_partkey").cast("string")
    text = F.concat_ws("\n",
                       F.concat(F.lit("def "), name, F.lit("_"), key, F.lit("():")),
                       F.concat(F.lit("    return "), F.col("p_size").cast("string")),
                       F.lit(""), F.lit(""),
                       F.concat(F.lit("class Part"), key, F.lit(":")),
                       F.lit("    pass"), F.lit(""), F.lit(""),
                       F.concat(F.lit("brand_"), brand, F.lit("("), key, F.lit(")")),
                       F.concat(F.lit("obj.method_"), F.lower(F.regexp_replace("p_type", "[^A-Za-z0-9]+", "_")),
                                F.lit("()")),
                       F.lit(""))
    path = F.concat(F.lit("parts/brand"), brand, F.lit("/"), key, F.lit(".py"))
    return p.select(path.alias("path"), text.alias("text"))


SQL_PART_FINDINGS = """pf AS (
  SELECT *, regexp_extract(p_brand, '([0-9]+)', 1) AS brand,
         'parts/brand' || regexp_extract(p_brand, '([0-9]+)', 1) || '/' || CAST(p_partkey AS VARCHAR) || '.py' AS path
  FROM part),
part_findings AS (
  SELECT 'def' AS kind, path, 1 AS line, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g')) || '_' || CAST(p_partkey AS VARCHAR) AS text FROM pf
  UNION ALL SELECT 'def', path, 5, 'Part' || CAST(p_partkey AS VARCHAR) FROM pf
  UNION ALL SELECT 'ref', path, 9, 'brand_' || brand FROM pf
  UNION ALL SELECT 'ref', path, 10, 'method_' || lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g')) FROM pf)"""


@register("k5_symbol_index_parts", f"""WITH {SQL_PART_FINDINGS}
SELECT kind, path, CAST(line AS INTEGER) AS line, text FROM part_findings""")
def k5_symbol_index_parts(spark, sf_dir):
    """Definitions and references of the Python modules derived from ``part``."""
    findings, _ = S.symbol_index(part_modules(spark, sf_dir), ["python"])
    return findings


@register("b10_symbol_filter_scoped", f"""WITH {SQL_PART_FINDINGS}
SELECT kind, path, CAST(line AS INTEGER) AS line, text FROM part_findings
WHERE text = 'brand_1' AND path GLOB 'parts/brand1*/*'""")
def b10_symbol_filter_scoped(spark, sf_dir):
    """Exact symbol filter inside a scope glob."""
    findings, _ = S.symbol_index(part_modules(spark, sf_dir), ["python"], scope_globs=["parts/brand1*/*"],
                                 symbol="brand_1")
    return findings


@register("c7_symbol_summary", f"""WITH {SQL_PART_FINDINGS}
SELECT text, CAST(sum(CASE WHEN kind = 'def' THEN 1 ELSE 0 END) AS BIGINT) AS defs,
       CAST(sum(CASE WHEN kind = 'ref' THEN 1 ELSE 0 END) AS BIGINT) AS refs
FROM part_findings GROUP BY text""")
def c7_symbol_summary(spark, sf_dir):
    """Definitions and references per name (no def x ref pairs)."""
    findings, _ = S.symbol_index(part_modules(spark, sf_dir), ["python"], sort=False)
    return S.symbol_summary(findings)


@register("c7_symbol_lookup", f"""WITH {SQL_PART_FINDINGS}
SELECT kind, path, CAST(line AS INTEGER) AS line, text FROM part_findings WHERE text = 'brand_1'""")
def c7_symbol_lookup(spark, sf_dir):
    """Definitions and references of one name."""
    findings, _ = S.symbol_index(part_modules(spark, sf_dir), ["python"], sort=False)
    return S.symbol_lookup(findings, "brand_1")


@register("c7_unresolved_references", f"""WITH {SQL_PART_FINDINGS}
SELECT kind, path, CAST(line AS INTEGER) AS line, text FROM part_findings
WHERE kind = 'ref' AND text NOT IN (SELECT text FROM part_findings WHERE kind = 'def')""")
def c7_unresolved_references(spark, sf_dir):
    """References whose name is defined nowhere."""
    findings, _ = S.symbol_index(part_modules(spark, sf_dir), ["python"], sort=False)
    return S.unresolved_references(findings)


@register("g5_rule_overrides", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'default def' END AS def_rule, 'default ref' AS ref_rule FROM part""")
def g5_rule_overrides(spark, sf_dir):
    """Rule texts per kind with overrides winning: parts of even size override "def"."""
    p = table(spark, sf_dir, "part")
    base = F.create_map(F.lit("def"), F.lit("default def"), F.lit("ref"), F.lit("default ref"))
    own = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("def"), F.col("p_brand"))).otherwise(
        F.create_map().cast("map<string,string>"))
    merged = p.select("p_partkey", S.merge_rule_overrides(base, own).alias("m"))
    return merged.select("p_partkey", F.col("m")["def"].alias("def_rule"), F.col("m")["ref"].alias("ref_rule"))


@register("a13_tuning_space", """
SELECT 'q' || CAST(l_quantity AS INTEGER) AS name, CAST(min(l_extendedprice) AS DOUBLE) AS low, CAST(max(l_extendedprice) AS DOUBLE) AS high,
       CAST(1.0 AS DOUBLE) AS weight FROM lineitem GROUP BY l_quantity""")
def a13_tuning_space(spark, sf_dir):
    """A tuning-space document written as JSON (one dimension per quantity) and read back; weights default to 1."""
    from quarry.session import scratch_path
    from quarry.sources.tables import read_dimensions
    li = table(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(
        F.min(F.col("l_extendedprice").cast("double")).alias("low"), F.max(F.col("l_extendedprice").cast("double")).alias("high"))
    dim = F.struct(F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string")).alias("name"), "low", "high", F.col("low").alias("target"))
    doc = li.agg(F.collect_list(dim).alias("dimensions")).select(F.lit(0.25).alias("baseline_score"), "dimensions")
    path = scratch_path(spark, "space")
    doc.write.json(path)
    return read_dimensions(spark, path)[1].select("name", "low", "high", "weight")
