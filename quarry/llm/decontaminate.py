"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item (an item of fewer
words is one shorter window). Each window is represented by the minimum of
its k-gram hashes; every shared span of ``window`` words therefore shares a
fingerprint. Documents stream through one scan: a window whose fingerprint is
in the benchmark's fixed-size bitmap is extended to its full window hash, and
only windows whose hash may occur in the benchmark leave the scan. An equi-join
on the 128-bit window hash settles each hit and names its items.

Defined cases: null or wordless texts have no words and are never hit; null
item ids still contaminate but are not listed; repeated documents are judged
one by one; an empty benchmark hits nothing; items with equal words are all
listed. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm import blocks as B, jobs

WINDOW = 10
GRAM = 5


def _windows(words: np.ndarray, rows: np.ndarray, window: int, gram: int):
    """Start of every full window inside one text, with its fingerprint."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = B.gram_hash(words, gram)
    low = grams[:n].copy()
    for j in range(1, window - gram + 1):
        np.minimum(low, grams[j:j + n], out=low)
    at = np.flatnonzero(rows[:n] == rows[window - 1:])
    return at, low[at]


def _words(data: np.ndarray, offs: np.ndarray):
    starts, ends, rows = B.word_spans(data, offs, B.alnum_words())
    out = []
    for salt in (7, 8):
        out.append(B.range_hash(B.prefix_hash(data, B.letter_values(True, salt)), starts, ends))
    return out[0], out[1], rows


def _pair(h1: np.ndarray, h2: np.ndarray, at: np.ndarray, n: int):
    """128-bit hashes of the windows of ``n`` words at the given positions."""
    m1, m2 = B.seeds(n, 21), B.seeds(n, 22)
    a, b = np.full(len(at), np.uint64(n)), np.full(len(at), np.uint64(n))
    for j in range(n):
        a += h1[at + j] * m1[j]
        b += h2[at + j] * m2[j]
    return B.mix64(a), B.mix64(b)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(item_id, n, h1, h2, fp): every window of every item; fp is null for
    an item of fewer than ``window`` words."""

    @B.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offs in B.utf8_blocks(batch.column(1)):
                h1, h2, rows = _words(data, offs)
                at, fp = _windows(h1, rows, window, gram)
                a, b = _pair(h1, h2, at, window)
                yield pa.record_batch([ids.take(pa.array(rows[at] + lo)), pa.array(np.full(len(at), window, np.int32)),
                                       pa.array(B.as_long(a)), pa.array(B.as_long(b)), pa.array(B.as_long(fp))],
                                      names=["item_id", "n", "h1", "h2", "fp"])
                bounds = B.row_bounds(rows, hi - lo)
                size = np.diff(bounds)
                for n in range(1, window):
                    short = np.flatnonzero(size == n)
                    if len(short):
                        a, b = _pair(h1, h2, bounds[short], n)
                        yield pa.record_batch([ids.take(pa.array(short + lo)), pa.array(np.full(len(short), n, np.int32)),
                                               pa.array(B.as_long(a)), pa.array(B.as_long(b)),
                                               pa.nulls(len(short), pa.int64())], names=["item_id", "n", "h1", "h2", "fp"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(scan, f"item_id {kind}, n int, h1 long, h2 long, fp long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document row: doc_id, text_hash (xxhash64), n_words, n_hit (words inside any hit
    window), n_items, items (their ids as sorted strings), spans (hit runs of
    words as (start, end)), contaminated."""
    spark = docs.sparkSession
    jobs.prepare(spark)
    wins = jobs.table(benchmark_windows(benchmark, window, gram), "windows")
    share = spark.sparkContext.broadcast({
        "fp": jobs.bitmap(wins.where("fp is not null"), "fp"),
        "win": jobs.bitmap(wins, "h1"),
        "short": sorted(r["n"] for r in wins.where(F.col("n") < window).select("n").distinct().collect()),
    })

    @B.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = share.value
        for batch in batches:
            for lo, hi, data, offs in B.utf8_blocks(batch.column(1)):
                h1, h2, rows = _words(data, offs)
                bounds = B.row_bounds(rows, hi - lo)
                at, fp = _windows(h1, rows, window, gram)
                at = at[jobs.in_bitmap(known["fp"], fp)]
                found = [(at, window, *_pair(h1, h2, at, window))]
                for n in known["short"]:
                    last = len(h1) - n + 1
                    at = np.flatnonzero(rows[:last] == rows[n - 1:]) if last > 0 else np.zeros(0, np.int64)
                    found.append((at, n, *_pair(h1, h2, at, n)))
                pos, size, a, b = [], [], [], []
                for at, n, x, y in found:
                    keep = jobs.in_bitmap(known["win"], x)
                    pos.append(at[keep]), size.append(np.full(int(keep.sum()), n, np.int32)), a.append(x[keep]), b.append(y[keep])
                pos, size, a, b = map(np.concatenate, (pos, size, a, b))
                order = np.argsort(pos, kind="stable")
                pos, size, a, b = pos[order], size[order], a[order], b[order]
                ends = np.searchsorted(pos, bounds).astype(np.int32)
                hits = pa.StructArray.from_arrays(
                    [pa.array((pos - bounds[rows[pos]]).astype(np.int64)), pa.array(size), pa.array(B.as_long(a)), pa.array(B.as_long(b))],
                    names=["pos", "n", "h1", "h2"])
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(bounds)),
                                       pa.ListArray.from_arrays(pa.array(ends), hits)], names=["doc_id", "text_hash", "n_words", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        scan, f"doc_id {kind}, text_hash long, n_words long, hits array<struct<pos:long,n:int,h1:long,h2:long>>")
    base = jobs.table(scanned.withColumn("rid", F.monotonically_increasing_id()), "scan")
    hits = base.where(F.size("hits") > 0).select("rid", F.explode("hits").alias("h")).select("rid", "h.*")
    found = hits.join(wins.select("n", "h1", "h2", "item_id").distinct(), ["n", "h1", "h2"])
    spans = F.aggregate(
        F.array_sort(F.collect_set(F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("end")))),
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1),
                                       F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"),
                                                        F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))))
    per_doc = found.groupBy("rid").agg(spans.alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return (base.join(per_doc, "rid", "left")
            .select("doc_id", "text_hash", "n_words",
                    F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"]), F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.coalesce("spans", none).alias("spans"),
                    F.col("spans").isNotNull().alias("contaminated")))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents that no benchmark window hits, with all their columns."""
    bad = contamination(docs, benchmark, window, gram).where("contaminated").select("doc_id", "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["text_hash"])
    return docs.join(bad, same, "left_anti")
