"""Pattern tables and the trigram index over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import regex_index
from quarry.plans.catalog import register
from quarry.plans.queries_text import sql_doc_lines
from quarry.session import scratch_path
from quarry.sources.tables import documents_corpus, table

#: A run of literals, an alternative, a class between literals, no literal at all.
PATTERNS = {"mail": r"mail[0-9]+\.example", "either": "(License|token|secret) ", "rare": "Copyright [0-9]{4}", "none": "^[0-9]+$"}

_FIRST = r"^([a-z]+) ([a-z]+)"
SQL_PATTERN_TABLE = f"""pats AS (
  SELECT item_id AS pid, regexp_extract(lower(text), '{_FIRST}', 1) || '[ ,]+' || regexp_extract(lower(text), '{_FIRST}', 2) AS pattern FROM benchmark
  WHERE regexp_matches(lower(text), '{_FIRST}'))"""


def _pattern_table(spark, sf_dir):
    """A pattern per benchmark passage: its first two words, spaces or commas between."""
    item = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("t")).where(F.col("t").rlike(_FIRST))
    word = lambda i: F.regexp_extract("t", _FIRST, i)
    return item.select(F.col("item_id").alias("pid"), F.concat(word(1), F.lit("[ ,]+"), word(2)).alias("pattern"))


@register("b6_pattern_automaton", f"""WITH {sql_doc_lines()}, {SQL_PATTERN_TABLE}
SELECT CAST(pid AS BIGINT) AS pid, path, CAST(line AS INTEGER) AS line, text FROM doc_lines, pats WHERE regexp_matches(text, pattern)""")
def b6_pattern_automaton(spark, sf_dir):
    """All patterns of a table in one scan of the documents' lines."""
    return regex_index.grep_table(documents_corpus(spark, sf_dir), _pattern_table(spark, sf_dir))


def _sql_search(pattern: str) -> str:
    return f"""SELECT path, CAST(line AS INTEGER) AS line, text FROM doc_lines WHERE regexp_matches(text, '{pattern}')"""


@register("b5_trigram_search", f"""WITH {sql_doc_lines()}
{' UNION ALL '.join(f"SELECT '{n}' AS name, * FROM ({_sql_search(p)})" for n, p in PATTERNS.items())}""")
def b5_trigram_search(spark, sf_dir):
    """Four searches of one stored trigram index."""
    index = regex_index.build(documents_corpus(spark, sf_dir), scratch_path(spark, "trigrams"))
    out = None
    for name, pattern in PATTERNS.items():
        hits = regex_index.search(index, pattern).select(F.lit(name).alias("name"), "path", "line", "text")
        out = hits if out is None else out.unionByName(hits)
    return out
