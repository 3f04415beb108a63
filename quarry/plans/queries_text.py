"""grep and find queries over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import decode_utf8_ignore, glob_match, relative_path, split_lines
from quarry.operators import grep as G
from quarry.operators import paths as P
from quarry.plans.catalog import SQL_DOC_PATH, register
from quarry.session import scratch_path
from quarry.sources.tables import documents_corpus, table

# SQL: lines of a text split at \n, one final \n stripped, empty text -> none.
SQL_LINES = ("CASE WHEN {t} IS NULL OR {t} = '' THEN []::VARCHAR[] "
             "ELSE string_split(regexp_replace({t}, '\\n$', ''), chr(10)) END")


def sql_lines(t: str) -> str:
    return SQL_LINES.format(t=t)


def sql_doc_lines() -> str:
    return f"""doc_lines AS (
  SELECT path, unnest(generate_series(1, len(ls))) AS line, unnest(ls) AS text
  FROM (SELECT {SQL_DOC_PATH} AS path, {sql_lines('text')} AS ls FROM documents))"""


def conversations_corpus(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"),
                    "text", "conv_id", "turn")


GREP_PATTERNS = {1: "License", 2: "token|secret", 3: r"mail[0-9]+\.example", 4: "qqqzzzxxx"}


@register("b5_grep_lines", f"""WITH {sql_doc_lines()}
SELECT CAST(0 AS BIGINT) AS pid, path, CAST(line AS INTEGER) AS line, text FROM doc_lines
WHERE regexp_matches(text, 'mail[0-9]+[.]example')""")
def b5_grep_lines(spark, sf_dir):
    return G.grep(documents_corpus(spark, sf_dir), r"mail[0-9]+\.example")


def _sql_multi():
    return " UNION ALL ".join(
        f"SELECT CAST({pid} AS BIGINT) AS pid, '{p}' AS pattern" for pid, p in GREP_PATTERNS.items())


@register("b6_multi_pattern_grep", f"""WITH {sql_doc_lines()}, pats AS ({_sql_multi()})
SELECT pid, path, CAST(line AS INTEGER) AS line, text FROM doc_lines, pats
WHERE regexp_matches(text, pattern)""")
def b6_multi_pattern_grep(spark, sf_dir):
    return G.grep(documents_corpus(spark, sf_dir), patterns=GREP_PATTERNS)


@register("d7_match_status", f"""WITH {sql_doc_lines()}, pats AS ({_sql_multi()}),
hits AS (SELECT pid, count(*) AS n FROM doc_lines, pats WHERE regexp_matches(text, pattern) GROUP BY pid)
SELECT pats.pid, pats.pattern, coalesce(n, 0) AS matches,
       CAST(CASE WHEN coalesce(n, 0) > 0 THEN 0 ELSE 1 END AS INTEGER) AS exit_code
FROM pats LEFT JOIN hits USING (pid)""")
def d7_match_status(spark, sf_dir):
    return G.grep_summary(documents_corpus(spark, sf_dir), patterns=GREP_PATTERNS)


UNIVERSAL_SQL = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"


@register("b5_universal_lines", f"""
SELECT CAST(0 AS BIGINT) AS pid, path, CAST(line AS INTEGER) AS line, text FROM (
  SELECT path, unnest(generate_series(1, len(ls))) AS line, unnest(ls) AS text
  FROM (SELECT path, string_split_regex(regexp_replace(t, '({UNIVERSAL_SQL})$', ''), '{UNIVERSAL_SQL}') AS ls
        FROM (SELECT {SQL_DOC_PATH} AS path, replace(text, '. ', '.' || chr(13)) AS t FROM documents) WHERE t <> ''))
WHERE regexp_matches(text, 'n[.]$')""")
def b5_universal_lines(spark, sf_dir):
    """Universal line ends (sentences cut by carriage returns) and a pattern
    anchored at the line's end."""
    c = documents_corpus(spark, sf_dir).withColumn("text", F.replace("text", F.lit(". "), F.lit(".\r")))
    return G.grep(c, r"n\.$", line_mode="universal")


BAD_PATTERNS = {1: "License", 2: "(", 3: r"\Qa\E", 4: r"\p{Lu}[a-z]+ under", 5: "[z-a]"}


@register("b4_invalid_pattern_status", f"""WITH {sql_doc_lines()},
pats AS (SELECT * FROM (VALUES (1::BIGINT, 'License', 'License'), (2, '(', NULL), (3, '\\Qa\\E', NULL),
         (4, '\\p{{Lu}}[a-z]+ under', '\\p{{Lu}}[a-z]+ under'), (5, '[z-a]', NULL)) v(pid, pattern, re)),
hits AS (SELECT pid, count(*) AS n FROM doc_lines, pats WHERE re IS NOT NULL AND regexp_matches(text, re) GROUP BY pid)
SELECT pats.pid, pats.pattern, coalesce(n, 0) AS matches,
       CAST(CASE WHEN re IS NULL THEN 2 WHEN coalesce(n, 0) > 0 THEN 0 ELSE 1 END AS INTEGER) AS exit_code
FROM pats LEFT JOIN hits USING (pid)""")
def b4_invalid_pattern_status(spark, sf_dir):
    """Invalid patterns get exit code 2, the others still run."""
    return G.grep_summary(documents_corpus(spark, sf_dir), patterns=BAD_PATTERNS)


@register("b6_pattern_table", f"""WITH {sql_doc_lines()}
SELECT CAST(n_nationkey AS BIGINT) AS pid, path, CAST(line AS INTEGER) AS line, text
FROM doc_lines, nation WHERE regexp_matches(text, lower(substr(n_name, 1, 2)) || '[.]$')""")
def b6_pattern_table(spark, sf_dir):
    """Patterns as a table: one per nation (its first two letters at a line's end)."""
    pats = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pid"), F.concat(
        F.lower(F.substring("n_name", 1, 2)), F.lit("[.]$")).alias("pattern"))
    return G.grep(documents_corpus(spark, sf_dir), patterns=pats)


@register("a5_utf8_decode", """
SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, sha1(text) AS sha FROM documents""")
def a5_utf8_decode(spark, sf_dir):
    """Bytes with stray invalid ones in front and behind decode to the text."""
    d = table(spark, sf_dir, "documents")
    raw = F.concat(F.lit(bytearray(b"\xff")), F.col("text").cast("binary"), F.lit(bytearray(b"\xe2\x82")))
    t = d.select("doc_id", F.explode(F.array(decode_utf8_ignore(raw))).alias("t"))
    return t.select("doc_id", F.length("t").alias("n_chars"), F.sha1("t").alias("sha"))


@register("b7_grep_conversations", f"""
SELECT CAST(0 AS BIGINT) AS pid, path, CAST(line AS INTEGER) AS line, text FROM (
  SELECT path, unnest(generate_series(1, len(ls))) AS line, unnest(ls) AS text
  FROM (SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS path, {sql_lines('text')} AS ls
        FROM conversations))
WHERE regexp_matches(text, '^(The|Les|Die) ')""")
def b7_grep_conversations(spark, sf_dir):
    return G.grep(conversations_corpus(spark, sf_dir), "^(The|Les|Die) ")


@register("e1_line_numbering", f"""
SELECT conv_id, turn, CAST(line AS INTEGER) AS line, text FROM (
  SELECT conv_id, turn, unnest(generate_series(1, len(ls))) AS line, unnest(ls) AS text
  FROM (SELECT conv_id, turn, {sql_lines('text')} AS ls FROM conversations))""")
def e1_line_numbering(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return (c.select("conv_id", "turn", F.posexplode(split_lines("text")).alias("pos", "text"))
            .select("conv_id", "turn", (F.col("pos") + 1).cast("int").alias("line"), "text"))


@register("h5_split_lines", f"""
SELECT {SQL_DOC_PATH} AS path, CAST(len(ls) AS INTEGER) AS n_lines,
       CAST(coalesce(list_max(list_transform(ls, lambda l: length(l))), 0) AS INTEGER) AS max_line_chars
FROM (SELECT *, {sql_lines('text')} AS ls FROM documents)""")
def h5_split_lines(spark, sf_dir):
    d = documents_corpus(spark, sf_dir).select("path", split_lines("text").alias("ls"))
    return d.select("path", F.size("ls").alias("n_lines"),
                    F.coalesce(F.array_max(F.transform("ls", F.length)), F.lit(0)).alias("max_line_chars"))


@register("h6_regex_search_pages", """
SELECT CAST(0 AS BIGINT) AS pid, path, CAST(line AS INTEGER) AS line, text FROM (
  SELECT path, unnest(generate_series(1, len(ls))) AS line, unnest(ls) AS text
  FROM (SELECT url AS path, CASE WHEN html = '' THEN []::VARCHAR[]
               ELSE string_split(regexp_replace(html, '\\n$', ''), chr(10)) END AS ls FROM pages))
WHERE regexp_matches(text, 'track[(][0-9]+[)]')""")
def h6_regex_search_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("text"))
    return G.grep(pages, r"track\([0-9]+\)")


# ---------------------------------------------------------------- find

SQL_ENTRIES = f"""files AS (SELECT {SQL_DOC_PATH} AS path FROM documents),
entries AS (
  SELECT path, 'file' AS type FROM files
  UNION ALL
  SELECT DISTINCT path, 'directory' AS type FROM (
    SELECT lang AS path FROM documents UNION ALL SELECT lang || '/' || source FROM documents))"""


def _entries(spark, sf_dir):
    return P.path_entries(documents_corpus(spark, sf_dir))


@register("b1_find_regex", f"""WITH {SQL_ENTRIES}
SELECT path FROM entries WHERE regexp_matches(path, '^fr/src1[0-9]?(/|$)')""")
def b1_find_regex(spark, sf_dir):
    return P.find_paths(_entries(spark, sf_dir), "^fr/src1[0-9]?(/|$)")


@register("b1_stored_prefix_range", f"""WITH {SQL_ENTRIES}
SELECT path FROM entries WHERE regexp_matches(path, '^fr/src1[0-9]?(/|$)')""")
def b1_stored_prefix_range(spark, sf_dir):
    """The same search of a listing stored in path order: its literal start is a
    range of the scan."""
    stored = P.write_listing(_entries(spark, sf_dir), scratch_path(spark, "listing"))
    return P.find_paths(stored, "^fr/src1[0-9]?(/|$)")


@register("b2_find_type_file", f"""WITH {SQL_ENTRIES}
SELECT path FROM entries WHERE type = 'file' AND regexp_matches(path, '0[.]txt$')""")
def b2_find_type_file(spark, sf_dir):
    return P.find_paths(_entries(spark, sf_dir), r"0\.txt$", type_filter="file")


@register("b3_find_directories", f"""WITH {SQL_ENTRIES}
SELECT path FROM entries WHERE type = 'directory'""")
def b3_find_directories(spark, sf_dir):
    return P.find_paths(_entries(spark, sf_dir), None, type_filter="directory")


@register("k1_find_all", f"""WITH {SQL_ENTRIES}
SELECT path FROM entries""")
def k1_find_all(spark, sf_dir):
    """Null pattern, no type: every file and directory, sorted."""
    return P.find_paths(_entries(spark, sf_dir), None)


@register("b9_scope_globs", f"""WITH {SQL_ENTRIES}
SELECT path FROM entries WHERE type = 'file' AND (path GLOB 'en/*/1*.txt' OR path GLOB 'de/src1?/*')""")
def b9_scope_globs(spark, sf_dir):
    return P.find_paths(_entries(spark, sf_dir), None, "file", globs=["en/*/1*.txt", "de/src1?/*"])


@register("h7_glob_match_urls", """
SELECT page_id, url GLOB 'https://*.example.com/*/[0-9]*' AS matched FROM pages""")
def h7_glob_match_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", glob_match("url", "https://*.example.com/*/[0-9]*").alias("matched"))


@register("b8_language_globs", f"""WITH {SQL_ENTRIES}
SELECT 'cobol' AS language, path FROM entries WHERE type = 'file'
UNION ALL
SELECT 'python' AS language, path FROM entries WHERE type = 'file' AND path GLOB '*.py'""")
def b8_language_globs(spark, sf_dir):
    """python selects *.py (none here); an unknown language selects every file."""
    return P.select_language_files(_entries(spark, sf_dir), ["python", "cobol"])


@register("g4_glob_union", f"""WITH {SQL_ENTRIES}
SELECT 'text' AS language, path FROM entries
WHERE type = 'file' AND (path GLOB '*.txt' OR path GLOB 'en/*' OR path GLOB '*/src3/*')""")
def g4_glob_union(spark, sf_dir):
    """Several globs of one language: each path once."""
    return P.select_language_files(_entries(spark, sf_dir), ["text"],
                                   {"text": ["*.txt", "en/*", "*/src3/*"]})


@register("g3_missing_languages", """
SELECT lang AS language FROM (SELECT DISTINCT lang FROM documents) WHERE lang NOT IN ('python', 'en')""")
def g3_missing_languages(spark, sf_dir):
    """Requested languages (every document language) minus available ones."""
    available = ["python", "en"]
    req = table(spark, sf_dir, "documents").select(F.col("lang").alias("language")).distinct()
    avail = spark.createDataFrame([(a,) for a in available], "language string")
    return req.exceptAll(F.broadcast(avail)).distinct()


@register("b13_relative_path", f"""
SELECT doc_id, CASE WHEN lang = 'en' THEN substr({SQL_DOC_PATH}, 4) ELSE {SQL_DOC_PATH} END AS rel_path FROM documents""")
def b13_relative_path(spark, sf_dir):
    """Paths below the root lose it, others stay as they are."""
    d = documents_corpus(spark, sf_dir)
    return d.select("doc_id", relative_path("path", "en").alias("rel_path"))
