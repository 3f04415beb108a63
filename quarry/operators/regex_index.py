"""Regular-expression search that leaves out what cannot match.

* :func:`grep_table`: any number of patterns from a table in one scan. Each
  pattern's required literals (``functions.literals``) go into one Aho-Corasick
  automaton; a line meets only the patterns one of whose literals it holds, and
  the expression itself is checked on those (line, pattern) rows alone.
* :class:`TrigramIndex`: a stored corpus with postings of the byte trigrams of
  every document. A pattern's clauses become a boolean query over trigrams;
  only documents that satisfy it are read and searched line by line.

Patterns that require no literal (or none of three bytes) are tried on every
line, as ``grep`` does. Rows equal those of ``grep`` with the same options.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.literals import required
from quarry.functions.text import has_nul, is_hidden_path, java_regex
from quarry.operators.grep import grep, lines
from quarry.plans.sizing import bounded_broadcast, spread_small_input

#: Literals of one automaton; larger pattern tables go in parts, a scan each.
LITERALS_SENT = 200_000
#: Trigrams of a literal that the query asks for (the rarest ones).
GRAMS_ASKED = 4
#: Documents that are named in the scan's filter; more are joined.
PUSHED_DOCS = 1000
GRAM_BUCKETS = 64


def _whole(pattern: str) -> str:
    """A pattern of several lines as one of alternatives."""
    return "|".join(f"(?:{x})" for x in pattern.split("\n")) if "\n" in pattern else pattern


# -------------------------------------------------------------- pattern tables

def compiled(patterns: DataFrame) -> DataFrame:
    """(pid, pattern, java, literals): the Java form of each pattern (null where
    it is invalid) and its most selective clause (empty: it requires nothing).
    A pattern of several lines means one alternative per line."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            java, literals = [], []
            for p in batch.column(1).to_pylist():
                whole = _whole(p)
                try:
                    java.append(java_regex(whole))
                    clauses = required(whole)
                    literals.append(clauses[0] if clauses else [])
                except ValueError:
                    java.append(None)
                    literals.append([])
            yield pa.record_batch([*batch.columns, pa.array(java, pa.string()), pa.array(literals, pa.list_(pa.string()))],
                                  names=["pid", "pattern", "java", "literals"])

    rows = patterns.where("pid is not null and pattern is not null").select(F.col("pid").cast("long").alias("pid"), "pattern")
    return rows.mapInArrow(work, "pid long, pattern string, java string, literals array<string>")


def _automaton(words: list[str]):
    import ahocorasick
    made = ahocorasick.Automaton()
    for i, w in enumerate(words):
        made.add_word(w, i)
    made.make_automaton()
    return made


def _searchable(corpus: DataFrame, include_hidden: bool, skip_binary: bool) -> DataFrame:
    docs = corpus if include_hidden else corpus.filter(~is_hidden_path("path"))
    return docs.filter(~has_nul("text")) if skip_binary else docs


def grep_table(corpus: DataFrame, patterns: DataFrame, line_mode: str = "newline",
               include_hidden: bool = False, skip_binary: bool = True) -> DataFrame:
    """(pid, path, line, text) of the matching lines for a table (pid, pattern);
    invalid patterns match nothing (:func:`compiled` tells them)."""
    from quarry.session import cut_lineage, ship_package
    spark = corpus.sparkSession
    ship_package(spark)
    table = cut_lineage(compiled(patterns))
    keyed = cut_lineage(table.where("java is not null and size(literals) > 0").select("pid", "java", F.explode("literals").alias("literal")))
    several = _several(keyed)
    ls = lines(spread_small_input(_searchable(corpus, include_hidden, skip_binary).select("path", "text")), line_mode=line_mode)
    out = ls.select(F.lit(None).cast("long").alias("pid"), "path", "line", "text").limit(0)
    parts = -(-keyed.count() // LITERALS_SENT)
    for part in range(parts):
        # (By pattern, so that a line meets a pattern in one part only.)
        mine = keyed.where(F.pmod(F.xxhash64("pid"), F.lit(parts)) == part)
        chosen = mine.select("literal").distinct().toArrow()["literal"].to_pylist()      # LITERALS_SENT or so

        def meet(batches: Iterator[pa.RecordBatch], chosen=chosen) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(chosen) if chosen else None
            for batch in batches:
                rows, found = [], []
                for i, text in enumerate(batch.column(2).to_pylist() if automaton else []):
                    for w in {w for _, w in automaton.iter(text)}:
                        rows.append(i)
                        found.append(chosen[w])
                yield pa.record_batch([*[c.take(pa.array(rows, pa.int64())) for c in batch.columns], pa.array(found, pa.string())],
                                      names=["path", "line", "text", "literal"])

        held = ls.mapInArrow(meet, "path string, line int, text string, literal string")
        hits = held.join(bounded_broadcast(mine), "literal").where(F.expr("rlike(text, java)")).select("pid", "path", "line", "text")
        out = out.unionByName(hits.dropDuplicates(["pid", "path", "line"]) if several else hits)
    plain = {r["pid"]: r["pattern"] for r in table.where("java is not null and size(literals) = 0").select("pid", "pattern").toLocalIterator()}
    if plain:
        out = out.unionByName(grep(corpus.select("path", "text"), patterns=plain, line_mode=line_mode, include_hidden=include_hidden, skip_binary=skip_binary))
    return out


def _several(keyed: DataFrame) -> bool:
    """Whether a pattern has several literals, so that it can meet a line twice."""
    return keyed.groupBy("pid").count().where("count > 1").limit(1).count() > 0


# -------------------------------------------------------------- trigram index

@dataclass
class TrigramIndex:
    """``docs`` (doc, path, text), sorted by doc; ``postings`` (gram, doc) by
    bucket, sorted by gram; ``grams`` (gram, df)."""
    docs: DataFrame
    postings: DataFrame
    grams: DataFrame


def trigrams(data: bytes) -> np.ndarray:
    """The different byte trigrams of a text as numbers below 2**24."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.int32)
    return np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if len(b) > 2 else np.zeros(0, np.int32)


def build(corpus: DataFrame, base: str) -> TrigramIndex:
    """Store (path, text) under ``base`` with its trigram postings."""
    from quarry.session import ship_package
    spark = corpus.sparkSession
    ship_package(spark)
    folder = f"{base}/t-{uuid.uuid4().hex}"
    # (Numbered as written: a task's rows are neighbours, in its order.)
    spread_small_input(corpus.select("path", F.coalesce("text", F.lit("")).alias("text"))).select(
        F.monotonically_increasing_id().alias("doc"), "path", "text").write.parquet(f"{folder}/docs")
    docs = spark.read.schema("doc long, path string, text string").parquet(f"{folder}/docs")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                g = trigrams(text.as_py().encode())
                yield pa.record_batch([pa.array(g), pa.array(np.full(len(g), batch.column(0)[i].as_py(), np.int64))], names=["gram", "doc"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    bucket = F.pmod(F.xxhash64("gram"), F.lit(GRAM_BUCKETS)).cast("int")
    # A trigram of most documents is spread over many tasks by its documents.
    (docs.select("doc", "text").mapInArrow(explode, "gram int, doc long").withColumn("bucket", bucket)
     .repartition(parts, "bucket", F.pmod(F.col("doc"), F.lit(max(1, parts // GRAM_BUCKETS))))
     .sortWithinPartitions("bucket", "gram", "doc").write.partitionBy("bucket").parquet(f"{folder}/postings"))
    spark.read.schema("gram int, doc long, bucket int").parquet(f"{folder}/postings").groupBy("gram").agg(
        F.count("*").alias("df")).sort("gram").write.parquet(f"{folder}/grams")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> TrigramIndex:
    return TrigramIndex(spark.read.schema("doc long, path string, text string").parquet(f"{folder}/docs"),
                        spark.read.schema("gram int, doc long, bucket int").parquet(f"{folder}/postings"),
                        spark.read.schema("gram int, df long").parquet(f"{folder}/grams"))


def boolean_query(pattern: str) -> list[list[list[int]]]:
    """Clauses of alternatives of trigrams: a matching text has, for each
    clause, all trigrams of one of its alternatives."""
    out = []
    for clause in required(_whole(pattern)):
        if all(len(x.encode("utf-8", "surrogatepass")) >= 3 for x in clause):
            out.append([trigrams(x.encode("utf-8", "surrogatepass")).tolist() for x in clause])
    return out


def candidates(index: TrigramIndex, pattern: str) -> DataFrame | None:
    """(doc) that may match, by one scan of the asked trigrams' postings; None
    if the pattern asks for no trigram."""
    query = boolean_query(pattern)
    if not query:
        return None
    every = sorted({g for clause in query for grams in clause for g in grams})
    df = {r["gram"]: r["df"] for r in index.grams.where(F.col("gram").isin(every)).collect()}   # the pattern's trigrams
    query = [[sorted(grams, key=lambda g: df.get(g, 0))[:GRAMS_ASKED] for grams in clause] for clause in query]
    query = sorted(query, key=lambda c: sum(min(df.get(g, 0) for g in grams) for grams in c))[:GRAMS_ASKED]
    asked = sorted({g for clause in query for grams in clause for g in grams})
    spark = index.docs.sparkSession
    buckets = [r[0] for r in spark.range(1).select(F.explode(F.array(*[F.lit(g) for g in asked])).alias("gram"))
               .select(F.pmod(F.xxhash64("gram"), F.lit(GRAM_BUCKETS)).cast("int")).distinct().collect()]
    has = (index.postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(asked)).groupBy("doc")
           .agg(F.collect_set("gram").alias("has")))   # as many as are asked at most

    def one(grams: list[int]) -> Column:
        return F.size(F.array_except(F.array(*[F.lit(g) for g in grams]), F.col("has"))) == 0

    cond = F.lit(True)
    for clause in query:
        any_of = F.lit(False)
        for grams in clause:
            any_of = any_of | one(grams)
        cond = cond & any_of
    return has.where(cond).select("doc")


def matching_documents(index: TrigramIndex, pattern: str) -> DataFrame:
    """The documents that a search for ``pattern`` reads (path, text)."""
    found = candidates(index, pattern)
    if found is None:
        return index.docs.select("path", "text")
    from quarry.session import cut_lineage
    found = cut_lineage(found)
    few = [r["doc"] for r in found.limit(PUSHED_DOCS + 1).collect()]
    if len(few) <= PUSHED_DOCS:
        return (index.docs.where(F.col("doc").isin(few)) if few else index.docs.limit(0)).select("path", "text")
    return index.docs.join(found, "doc", "left_semi").select("path", "text")


def search(index: TrigramIndex, pattern: str, **options) -> DataFrame:
    """(pid, path, line, text) of the matching lines of the stored corpus."""
    java_regex(pattern)   # an invalid pattern is an error, as in grep
    return grep(matching_documents(index, pattern), pattern, **options)
