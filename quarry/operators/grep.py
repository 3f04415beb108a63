"""grep: one row per matching line ``(pid, path, line, text)`` over a corpus.

Narrow plan, no shuffle: scan -> ``posexplode`` of lines -> ``rlike`` with
literal patterns (compiled once per task). Every line is tried by itself (a
pattern may match a line and not its document). Up to ``BLOCK_PATTERNS``
patterns are evaluated in one pass over the lines; larger pattern sets, also
given as a table (pid, pattern), go in blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import has_nul, is_hidden_path, java_regex, split_lines
from quarry.plans.sizing import spread_small_input

BLOCK_PATTERNS = 200

# Fixed value: the line ends of Python's str.splitlines (the fallback search's
# line mode).
UNIVERSAL_LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def normalise_patterns(pattern: str | None = None,
                       patterns: dict[int, str] | list[str] | DataFrame | None = None) -> dict[int, str]:
    """pid -> pattern. A table of patterns (pid, pattern) is read row by row. A pattern given as text with several
    lines means one alternative per line (as a pattern file does)."""
    if patterns is None:
        if pattern is None:
            raise ValueError("grep needs pattern or patterns")
        patterns = {0: pattern}
    if isinstance(patterns, DataFrame):
        rows = patterns.where("pid is not null and pattern is not null").select("pid", "pattern")
        patterns = {r["pid"]: r["pattern"] for r in rows.toLocalIterator()}
    if isinstance(patterns, list):
        patterns = dict(enumerate(patterns))
    out = {}
    for pid, p in patterns.items():
        parts = [x for x in p.split("\n")] if "\n" in p else [p]
        out[int(pid)] = parts[0] if len(parts) == 1 else "|".join(f"(?:{x})" for x in parts)
    return out


def lines(corpus: DataFrame, path_col: str = "path", text_col: str = "text",
          line_mode: str = "newline") -> DataFrame:
    """(path, line, text): 1-based line numbers in document order (no window)."""
    text = F.col(text_col)
    if line_mode == "universal":
        arr = F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(
            F.split(F.regexp_replace(text, f"(?:{UNIVERSAL_LINE_ENDS})\\z", ""), UNIVERSAL_LINE_ENDS))
    elif line_mode == "newline":
        arr = split_lines(text)
    else:
        raise ValueError(f"unknown line_mode {line_mode}")
    return (corpus.select(F.col(path_col).alias("path"), F.posexplode(arr).alias("pos", "text"))
            .select("path", (F.col("pos") + 1).cast("int").alias("line"), "text"))


def grep(corpus: DataFrame, pattern: str | None = None,
         patterns: dict[int, str] | list[str] | DataFrame | None = None,
         path_col: str = "path", text_col: str = "text", line_mode: str = "newline",
         include_hidden: bool = False, skip_binary: bool = True) -> DataFrame:
    """Matching lines ``(pid, path, line, text)``; unordered (grep promises no order).

    Defaults follow the usual line search program: hidden paths and binary
    (NUL-containing) files are skipped; ``include_hidden=True,
    skip_binary=False`` reads every file.
    """
    pats = normalise_patterns(pattern, patterns)
    java = [(pid, java_regex(p)) for pid, p in pats.items()]
    docs = corpus
    if not include_hidden:
        docs = docs.filter(~is_hidden_path(path_col))
    if skip_binary:
        docs = docs.filter(~has_nul(text_col))
    ls = lines(spread_small_input(docs), path_col, text_col, line_mode)

    def block(some: list[tuple[int, str]]) -> DataFrame:
        hits = F.filter(F.array(*[F.when(F.col("text").rlike(j), F.lit(pid).cast("long")) for pid, j in some]),
                        lambda x: x.isNotNull())
        return ls.select(F.explode(hits).alias("pid"), "path", "line", "text")

    if not java:
        return ls.select(F.lit(None).cast("long").alias("pid"), "path", "line", "text").limit(0)
    if len(java) == 1:
        (pid, j), = java
        return ls.filter(F.col("text").rlike(j)).select(F.lit(pid).cast("long").alias("pid"), "path", "line", "text")
    return reduce(DataFrame.unionByName, [block(java[i:i + BLOCK_PATTERNS]) for i in range(0, len(java), BLOCK_PATTERNS)])


def grep_summary(corpus: DataFrame, pattern: str | None = None,
                 patterns: dict[int, str] | list[str] | DataFrame | None = None, **kw) -> DataFrame:
    """Per pattern: matching lines and exit status — 0 = hits, 1 = none,
    2 = invalid pattern (that pattern only; the others still run).

    Zero-hit patterns are kept via a left join from the pattern list; the
    count is a partial (map-side) aggregate, so a pattern hitting a third of
    all lines is still one small row per task before the shuffle.
    """
    pats = normalise_patterns(pattern, patterns)
    valid, invalid = {}, {}
    for pid, p in pats.items():
        try:
            java_regex(p)
            valid[pid] = p
        except ValueError:
            invalid[pid] = p
    spark = corpus.sparkSession
    plist = spark.createDataFrame([(pid, p, pid in invalid) for pid, p in pats.items()],
                                  "pid long, pattern string, bad boolean")
    if valid:
        counts = grep(corpus, patterns=valid, **kw).groupBy("pid").agg(F.count(F.lit(1)).alias("matches"))
    else:
        counts = spark.createDataFrame([], "pid long, matches long")
    return (F.broadcast(plist).join(counts, "pid", "left")
            .select("pid", "pattern", F.coalesce("matches", F.lit(0)).alias("matches"), "bad")
            .withColumn("exit_code", F.when(F.col("bad"), 2).when(F.col("matches") > 0, 0).otherwise(1))
            .drop("bad"))
