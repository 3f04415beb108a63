"""Best-fit packing of token sequences under several capacities.

Every document's ids are cut into pieces of at most ``capacity`` tokens (only
longer documents are cut; the first piece takes the remainder). Packing works
on the histogram of piece lengths, which has ``capacity`` entries whatever the
corpus: lengths go down from the longest, and each takes, among the kinds of
open bins that fit it in every dimension (residual tokens, documents, attention
cost), the kind with the smallest residual norm (or the largest weighted dot
product with the item's needs). Bins of one kind are filled together, so the
plan is a table of (length, range of items of that length) -> (sequence range,
offset), bounded by the number of lengths and kinds, never by the corpus.

Pieces then find their place by their number within their length, counted in
two levels (a salted group and its offset), so no length is numbered in one
task. Defined cases: a null text is empty and has the end id only; null and
repeated doc_ids are pieces like any other; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from quarry.llm import blocks as B, jobs, tokens

SEQUENCE = 2048


@dataclass(frozen=True)
class Capacity:
    """Per-sequence limits. The attention cost of a piece is length**2."""
    tokens: int = SEQUENCE
    documents: int = SEQUENCE
    attention: int = SEQUENCE * SEQUENCE
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)
    rule: str = "norm"  # or "dot"


def plan(histogram: dict[int, int], cap: Capacity = Capacity()) -> dict[str, np.ndarray]:
    """Where the items of each length go: arrays (length, first, count, base,
    offset); item ``first + i`` of that length lies in sequence ``base + i`` at
    ``offset``.

    A kind of open bins is (residual tokens, documents, attention) with a list
    of id ranges. Items of one length fill a chosen kind until either runs out.
    """
    scale = np.array([cap.tokens, cap.documents, cap.attention], dtype=float)
    kinds: dict[tuple[int, int, int], list[list[int]]] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    next_id = 0

    def put(key, base, count):
        if key[0] > 0 and key[1] > 0 and key[2] > 0:
            kinds.setdefault(key, []).append([base, count])

    for length in sorted(histogram, reverse=True):
        left, first = int(histogram[length]), 0
        need = (length, 1, length * length)
        if length > cap.tokens or need[2] > cap.attention or cap.documents < 1:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fit = [k for k in kinds if k[0] >= need[0] and k[1] >= need[1] and k[2] >= need[2]]
            if fit:
                res = np.array(fit, dtype=float)
                w = np.array(cap.weights)
                if cap.rule == "dot":
                    score = -((res / scale) * (np.array(need) / scale) * w).sum(axis=1)
                else:
                    score = ((((res - need) / scale) ** 2) * w).sum(axis=1)
                key = fit[int(np.lexsort((res[:, 2], res[:, 1], res[:, 0], score))[0])]
                base, count = kinds[key].pop()
                if not kinds[key]:
                    del kinds[key]
                used = min(left, count)
                rows.append((length, first, used, base, cap.tokens - key[0]))
                put((key[0] - need[0], key[1] - need[1], key[2] - need[2]), base, used)
                if used < count:
                    put(key, base + used, count - used)
            else:
                # New bins: as many items of this length each as fit.
                each = min(cap.tokens // need[0], cap.documents, cap.attention // need[2])
                bins, over = divmod(left, each)
                if bins:
                    for j in range(each):
                        rows.append((length, first + j * bins, bins, next_id, j * length))
                    put((cap.tokens - each * need[0], cap.documents - each, cap.attention - each * need[2]), next_id, bins)
                    next_id, used = next_id + bins, bins * each
                else:
                    for j in range(over):
                        rows.append((length, first + j, 1, next_id, j * length))
                    put((cap.tokens - over * need[0], cap.documents - over, cap.attention - over * need[2]), next_id, 1)
                    next_id, used = next_id + 1, over
            left, first = left - used, first + used
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5)
    cols = cols[np.lexsort((cols[:, 1], cols[:, 0]))]
    return dict(zip(("length", "first", "count", "base", "offset"), np.ascontiguousarray(cols.T)))


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids."""
    head = total % capacity or min(total, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, total, capacity)] if total else []


def _encoded(enc, texts: pa.Array) -> Iterator[bytes]:
    for lo in range(0, len(texts), 500):
        yield from enc.encode_all(texts.slice(lo, 500).to_pylist())


def document_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = SEQUENCE,
                    with_ids: bool = False, cache_pieces: int = tokens.CACHE_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]) of every piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    @B.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokens.public_path(tokenizer), cache_pieces)
        for batch in batches:
            row, piece, start, size, crc, ids = [], [], [], [], [], []
            for i, raw in enumerate(_encoded(enc, batch.column(1))):
                raw += end
                for k, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                    part = raw[4 * s:4 * (s + n)]
                    row.append(i), piece.append(k), start.append(s), size.append(n), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.record_batch(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(pieces: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """``pieces`` (any table with a length column) with sequence_id and offset."""
    spark = pieces.sparkSession
    jobs.prepare(spark)
    salt = F.spark_partition_id()
    pieces = jobs.table(pieces.withColumn("__salt", salt).withColumn("__row", F.monotonically_increasing_id()), "pieces")
    counts = jobs.table(pieces.groupBy("length", "__salt").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    share = spark.sparkContext.broadcast(plan(histogram, cap))
    ahead = counts.withColumn("__ahead", F.sum("n").over(
        W.partitionBy("length").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1))).drop("n")
    within = F.row_number().over(W.partitionBy("length", "__salt").orderBy("__row")) - 1
    numbered = (pieces.withColumn("__nth", within).join(ahead, ["length", "__salt"])
                .withColumn("__nth", F.col("__nth") + F.coalesce("__ahead", F.lit(0))))
    keep = [f for f in pieces.schema if not f.name.startswith("__")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = share.value
        span = int(p["first"].max(initial=0) + p["count"].max(initial=0) + 1)
        keys = p["length"] * span + p["first"]
        for batch in batches:
            size, nth = batch.column(len(keep) - 1).to_numpy(), batch.column(len(keep)).to_numpy()
            at = np.searchsorted(keys, size * span + nth, side="right") - 1
            yield pa.record_batch([*batch.columns[:len(keep)], pa.array(p["base"][at] + nth - p["first"][at]), pa.array(p["offset"][at])],
                                  names=[*[f.name for f in keep], "sequence_id", "offset"])

    keep = [f for f in keep if f.name != "length"] + [pieces.schema["length"]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return numbered.select(*[f"`{f.name}`" for f in keep], F.col("__nth").cast("long")).mapInArrow(
        place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0,
                   cap: Capacity = Capacity(), with_ids: bool = False,
                   cache_pieces: int = tokens.CACHE_PIECES) -> DataFrame:
    """Tokenise, cut and pack whole documents: one row per piece. ``cache_pieces``
    bounds what a worker keeps of encoded words (the ids are the same)."""
    out = pack(document_pieces(docs, tokenizer, end_id, cap.tokens, with_ids, cache_pieces), cap)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
