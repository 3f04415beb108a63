"""Importance resampling towards a target distribution over hashed n-grams.

A document's features are all runs of 1 to ``orders`` consecutive words, hashed
into ``buckets`` buckets. The gain of a bucket is the scaled log ratio of its
smoothed share in the target texts and in all documents; a document's weight is
the sum of its features' gains, and documents are drawn without replacement by
the highest weight + Gumbel noise, where the noise is a hash of the document's
id (so a rerun or a retried task draws the same).

Words are found a batch at a time: the texts of a block are joined with
separator sentinels, one regular-expression pass over the whole finds all words,
``searchsorted`` on the document offsets tells each word's document, n-grams
whose first and last word lie in different documents are masked, and one
``bincount`` of what is left counts buckets (or sums gains). The CRC-32 of an
n-gram is put together from those of its words (:class:`Crc`), in numpy.

The counts cover all documents and all target texts: a task emits a row per
bucket it met, one aggregate adds them, and the driver gets ``buckets`` rows.
Ranks of drawn documents come from range-sorted rows numbered range by range.

Defined cases: null, empty and wordless texts have no feature and weight 0;
documents of fewer than ``least_words`` words get a score but are not drawn;
repeated rows count as rows of their own, and a null id is hashed as the text
"null" and comes last among ties; a share of documents that rounds to none
draws none; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm import blocks as B, jobs
from quarry.plans.ordinal import global_ordinal

ORDERS, BUCKETS, PERCENT, LEAST_WORDS, SEED = 3, 10_000, 5, 20, 42
SENTINEL = b"\n"
#: Words (runs of ASCII letters, digits and non-ASCII bytes).
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of up to so many bytes have their shift tables prepared.
LONG_WORD = 63
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Crc:
    """CRC-32 of joined words. The remainder register of a text followed by m
    bytes is the register shifted by m zero bytes, XOR what those bytes give
    alone; a shift is linear in the register, so four table lookups (one per
    register byte) do it."""

    POLYNOMIAL = 0xEDB88320   # Fixed value: CRC-32, reflected.

    def __init__(self):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(self.POLYNOMIAL), step >> 1).astype(np.uint32)
        self.step = step
        # shift[m, b, v]: register with byte b = v, others 0, after m zero bytes.
        shift = np.zeros((LONG_WORD + 2, 4, 256), dtype=np.uint32)
        for b in range(4):
            shift[0, b] = np.arange(256, dtype=np.uint32) << np.uint32(8 * b)
        for m in range(1, LONG_WORD + 2):
            shift[m] = self.advance(shift[m - 1], 0)
        self.shift = shift

    def advance(self, register: np.ndarray, byte) -> np.ndarray:
        return self.step[(register ^ byte) & 0xFF] ^ (register >> np.uint32(8))

    def of_words(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Register, from 0, of each word (column by column, the longest words
        that are still going on)."""
        out = np.zeros(len(starts), dtype=np.uint32)
        order = np.argsort(-sizes, kind="stable")
        left = sizes[order]
        at, register = starts[order], np.zeros(len(starts), dtype=np.uint32)
        going = len(order)
        for i in range(min(int(left[0]), LONG_WORD) if len(left) else 0):
            going = int(np.searchsorted(-left[:going], -i, side="left"))
            register[:going] = self.advance(register[:going], data[at[:going] + i])
        out[order] = register
        return out

    def shifted(self, register: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Registers after ``by`` zero bytes (LONG_WORD + 1 at most)."""
        out = self.shift[by, 0, register & 0xFF]
        for b in (1, 2, 3):
            out ^= self.shift[by, b, (register >> np.uint32(8 * b)) & 0xFF]
        return out


@functools.cache
def crc() -> Crc:
    return Crc()


def words_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined with sentinels and lower-cased, and (start, end, text)
    of every word, by one regular-expression pass and a search of the offsets."""
    joined = SENTINEL.join(texts).translate(_LOWER)
    offsets = np.cumsum([0] + [len(t) + len(SENTINEL) for t in texts[:-1]])
    spans = np.fromiter((edge for m in WORD.finditer(joined) for edge in m.span()), dtype=np.int64).reshape(-1, 2)
    return joined, spans[:, 0], spans[:, 1], np.searchsorted(offsets, spans[:, 0], side="right") - 1


def features(texts: list[bytes], orders: int = ORDERS, buckets: int = BUCKETS):
    """Bucket and text of every feature of the texts (laid end to end by order),
    and each text's number of words."""
    joined, start, end, owner = words_of(texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    table = crc()
    size = end - start
    alone = table.of_words(data, start, size)
    # A word after a space: the space's register, moved on by the word.
    fit = np.minimum(size, LONG_WORD)
    space = table.advance(np.zeros(1, np.uint32), 32)[0]
    after = table.shifted(np.full(len(size), space, np.uint32), fit) ^ alone
    register = table.shifted(np.full(len(size), 0xFFFFFFFF, np.uint32), fit) ^ alone
    long = size > LONG_WORD
    found, owners = [], []
    spread = long.copy()
    for n in range(1, orders + 1):
        count = len(start) - n + 1
        if count <= 0:
            break
        if n > 1:
            register = table.shifted(register[:count], fit[n - 1:] + 1) ^ after[n - 1:]
            spread = spread[:count] | long[n - 1:]
        mine = owner[:count] == owner[n - 1:]
        value = ~register
        for i in np.flatnonzero(spread & mine):
            value[i] = zlib.crc32(b" ".join(joined[start[j]:end[j]] for j in range(i, i + n)))
        found.append(value[mine] % np.uint32(buckets))
        owners.append(owner[:count][mine])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found).astype(np.int64) if found else none, np.concatenate(owners) if owners else none,
            np.bincount(owner, minlength=len(texts)))


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    for lo, hi, data, offs in B.utf8_blocks(column):
        raw = data.tobytes()
        yield lo, hi, [raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]


def bucket_counts(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket. A task emits a row
    per bucket at most, and so does the aggregate."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, block in _blocks(batch.column(0)):
                total += np.bincount(features(block, orders, buckets)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met), pa.array(total[met])], names=["bucket", "total"])

    rows = (texts.select("text").mapInArrow(count, "bucket long, total long")
            .groupBy("bucket").agg(F.sum("total").alias("total")).toArrow())
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["total"].to_numpy()
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares) of each bucket."""
    n = len(raw)
    t_all, s_all = float(int(target.sum()) + n), float(int(raw.sum()) + n)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for t, s in zip(target.tolist(), raw.tolist())],
                    dtype=np.int64)


def noise(key: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) from the first 32 bits of sha256("seed:key")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, orders: int = ORDERS, buckets: int = BUCKETS,
             least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document of
    (doc_id, text); rank counts the drawn ``percent`` from the highest score and
    is null for the others. ``target`` is a table with a text column."""
    spark = docs.sparkSession
    jobs.prepare(spark)
    gain = gains(bucket_counts(target, orders, buckets), bucket_counts(docs, orders, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, block in _blocks(batch.column(1)):
                bucket, owner, words = features(block, orders, buckets)
                n = np.bincount(owner, minlength=hi - lo)
                order = np.argsort(owner, kind="stable")
                sums = np.zeros(hi - lo + 1, np.int64)
                sums[1:] = np.cumsum(n)
                run = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)),
                                       pa.array(run[sums[1:]] - run[sums[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    scored = jobs.table(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    may = F.col("n_words") >= least_words
    draw = scored.where(may).count() * percent // 100
    # Rows that can be drawn are sorted by ranges; only those up to the bound are numbered.
    placed = (scored.where(may).withColumn("__order", -F.col("score")).withColumn("__last", F.col("doc_id").isNull()))
    ranked = global_ordinal(placed, ["__order", "__last", "doc_id"], "rank").withColumn(
        "rank", F.when(F.col("rank") <= draw, F.col("rank")).cast("long"))
    return (ranked.select(*scored.columns, "rank")
            .unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long"))))
