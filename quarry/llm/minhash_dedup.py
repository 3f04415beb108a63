"""Near-duplicate documents: MinHash bands find candidates, odd sketches
estimate their similarity, full shingle sets confirm it.

Documents with the same shingle set form one class. A class gets ``HASHES``
MinHash values, whose ``BANDS`` bands are join keys: a pair shares none with
probability (1 - 0.85**4)**32 < 1e-10 at similarity 0.85, < 1e-7 at 0.8. Its
one-permutation MinHash samples (the minimum of each of ``BINS`` hash ranges)
are folded into an odd sketch, a parity bitmap: the XOR population count of two
sketches tells how many samples differ, and is never above that number, so a
bound on it (:func:`most_bits`) precedes the check of the full sets.

Candidates are never expanded to all pairs of a bucket. First every class is
checked against the smallest class of each of its buckets (a star), and the
confirmed links are joined into components. Only buckets that still hold
several components are looked at again, in square blocks of bounded size, and
only pairs of different components whose sketches allow the threshold go on.

A doc_id names one document: rows that repeat it are taken to repeat its text.
Defined cases: null, empty or wordless texts have an empty set and stay alone;
rows with a null doc_id are returned with a null component and kept; repeated
rows are one class; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm import blocks as B, jobs

HASHES, BANDS, SKETCH_BITS = 128, 32, 4096
BINS = 1 << 14
CHUNK = 2048


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, laid end to end, and their
    bounds. A text of fewer words than a shingle is one shingle of all."""
    starts, ends, rows = B.word_spans(data, offs, B.space_words())
    h = B.range_hash(B.prefix_hash(data, B.letter_values(True)), starts, ends)
    n = len(offs) - 1
    bounds = B.row_bounds(rows, n)
    full = B.gram_hash(h, words)
    at = np.flatnonzero(rows[:len(full)] == rows[words - 1:]) if len(full) else np.zeros(0, np.int64)
    vals, owner = [full[at]], [rows[at]]
    size = np.diff(bounds)
    for k in range(1, words):
        short = np.flatnonzero(size == k)
        if len(short):
            vals.append(B.gram_hash(h, k)[bounds[short]])
            owner.append(short)
    vals, owner = np.concatenate(vals), np.concatenate(owner)
    order = np.lexsort((vals, owner))
    vals, owner = vals[order], owner[order]
    if len(vals):
        new = np.ones(len(vals), dtype=bool)
        new[1:] = (vals[1:] != vals[:-1]) | (owner[1:] != owner[:-1])
        vals, owner = vals[new], owner[new]
    return vals, B.row_bounds(owner, n)


def signatures(vals: np.ndarray, bounds: np.ndarray, hashes: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts x hashes) MinHash values and the odd sketches of texts with a
    non-empty set (rows in the order of those texts)."""
    full = np.flatnonzero(np.diff(bounds))
    first = bounds[full]
    sig = np.empty((len(full), hashes), dtype=np.uint64)
    if len(full):
        for j, m in enumerate(B.seeds(hashes, 99)):
            sig[:, j] = np.minimum.reduceat(vals * m, first)
    # Values are sorted within a text, so each range's minimum is its first.
    owner = np.repeat(np.arange(len(full)), np.diff(bounds)[full])
    bin_of = vals >> np.uint64(64 - BINS.bit_length() + 1)
    lead = np.ones(len(vals), dtype=bool)
    lead[1:] = (bin_of[1:] != bin_of[:-1]) | (owner[1:] != owner[:-1])
    where = (B.mix64(vals[lead]) % np.uint64(bits)).astype(np.int64)
    at = owner[lead] * bits + where
    odd = np.zeros(len(full) * bits // 8, dtype=np.uint8)
    np.bitwise_xor.at(odd, at >> 3, (128 >> (at & 7)).astype(np.uint8))
    return sig, odd.reshape(len(full), bits // 8)


def most_bits(total: np.ndarray, percent: int, bits: int) -> np.ndarray:
    """Most differing sketch bits that a pair at the threshold may show, by the
    sum of its set sizes. At most d = total * (100 - percent) / (100 + percent)
    shingles are in one set only. One that is alone in its range makes one
    sample differ; one that shares its range makes two or none differ, one at
    most on average (six standard deviations are allowed for those). Samples
    meeting in one bit only lower the count."""
    d = total * ((100 - percent) / (100 + percent))
    samples = d + 6 * np.sqrt(d * np.minimum(1.0, total / BINS))
    likely = bits / 2 * (1 - np.exp(-2 * samples / bits)) + 3 * bits ** 0.5
    return np.ceil(np.minimum(samples, likely))


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold. The text
    of each side is joined to the pair; sets are rebuilt per Arrow batch."""
    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))

    @B.lean
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            keep, at = [], 0
            heads = batch.column(0).to_pylist()
            for lo, hi, data, offs in B.utf8_blocks(batch.column(3)):
                vals, bounds = shingle_sets(data, offs, words)
                for i in range(lo, hi):
                    if heads[i] != last:
                        one = batch.column(2).slice(i, 1)
                        _, _, d, o = next(B.utf8_blocks(one))
                        kept, last = shingle_sets(d, o, words)[0], heads[i]
                    if _linked(kept, vals[bounds[i - lo]:bounds[i - lo + 1]], percent):
                        keep.append(i)
            yield pa.record_batch([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, hashes: int = HASHES,
                    bands: int = BANDS, bits: int = SKETCH_BITS) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (smallest
    doc_id reachable over links), kept (doc_id = component_id). Two documents
    are linked if 100 * intersection >= percent * union of their sets of
    ``words``-word shingles."""
    spark = docs.sparkSession
    jobs.prepare(spark)
    per = hashes // bands

    @B.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in B.utf8_blocks(batch.column(1)):
                vals, bounds = shingle_sets(data, offs, words)
                sig, odd = signatures(vals, bounds, hashes, bits)
                full = np.flatnonzero(np.diff(bounds))
                raw = vals.tobytes()
                keys = [None] * (hi - lo)
                for i in full:
                    keys[i] = hashlib.blake2b(raw[8 * bounds[i]:8 * bounds[i + 1]], digest_size=16).digest()
                m1 = B.seeds(per, 31)
                band = sig.reshape(len(full), bands, per)
                key = np.zeros((len(full), bands), dtype=np.uint64)
                for j in range(per):
                    key += B.mix64(band[:, :, j] + m1[j]) * m1[j]
                key = B.mix64(key + B.seeds(bands, 32)[None, :])
                ends = np.zeros(hi - lo + 1, np.int32)
                ends[1:] = np.cumsum(np.diff(bounds) > 0) * bands
                cuts = np.zeros(hi - lo + 1, np.int64)
                cuts[1:] = np.cumsum(np.diff(bounds) > 0) * (bits // 8)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(keys, pa.binary()),
                                       pa.ListArray.from_arrays(pa.array(ends), pa.array(B.as_long(key.ravel()))),
                                       B.binary_column(odd.ravel(), cuts)], names=["doc_id", "n_shingles", "set_key", "bands", "odd"])

    base = jobs.table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        scan, "doc_id long, n_shingles long, set_key binary, bands array<long>, odd binary"), "sig")
    # One class per shingle set; its id is the smallest doc_id that has it.
    named = base.where("set_key is not null and doc_id is not null")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("cid"))
    owners = jobs.table(named.select("doc_id", "n_shingles", "set_key", "bands", "odd").join(classes, "set_key")
                        .where("doc_id = cid").select("cid", "n_shingles", "bands", "odd").dropDuplicates(["cid"]), "classes")
    spread = owners.select("cid", F.explode("bands").alias("band"))
    heads = spread.groupBy("band").agg(F.min("cid").alias("head"), F.count("*").alias("size")).where("size > 1")
    buckets = jobs.table(spread.join(heads, "band"), "buckets")

    stars = jobs.table(buckets.where("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct(), "stars")
    wanted = buckets.select("cid").distinct()
    texts = jobs.table(docs.select(F.col("doc_id").cast("long").alias("cid"), "text").where("cid is not null")
                       .join(wanted, "cid").dropDuplicates(["cid"]), "texts")
    links = jobs.table(_confirm(stars, texts, words, percent), "links")
    comp = jobs.components(links)

    # Buckets that still hold several components: square blocks of members.
    member = (buckets.join(comp.withColumnRenamed("node", "cid"), "cid", "left")
              .withColumn("root", F.coalesce("root", "cid")))
    mixed = member.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("cid"), chunks).cast("int")
    split = (member.join(mixed, "band").join(owners.select("cid", "n_shingles", "odd"), "cid")
             .withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
             .select("band", F.least("mine", "other").alias("ca"), F.greatest("mine", "other").alias("cb"), "mine", "cid", "root", "n_shingles", "odd"))

    def block(tab: pa.Table) -> pa.Table:
        B.give_back()
        cid, root = tab["cid"].to_numpy(), tab["root"].to_numpy()
        mine = tab["mine"].to_numpy()
        odd = np.frombuffer(b"".join(tab["odd"].to_pylist()), dtype=np.uint64).reshape(len(cid), -1)
        ca, cb = tab["ca"][0].as_py(), tab["cb"][0].as_py()
        n = tab["n_shingles"].to_numpy()
        out_a, out_b = [], []
        for i in np.flatnonzero(mine == ca):
            may = (root != root[i]) & ((cid > cid[i]) if ca == cb else (mine == cb))
            may &= (100 * n >= percent * n[i]) & (100 * n[i] >= percent * n)
            j = np.flatnonzero(may)
            diff = np.bitwise_count(odd[j] ^ odd[i]).sum(axis=1, dtype=np.int64)
            j = j[diff <= most_bits(n[j] + n[i], percent, bits)]
            out_b.append(cid[j])
            out_a.append(np.full(len(j), cid[i]))
        a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
        b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    rest = (split.groupBy("band", "ca", "cb").applyInArrow(block, "a long, b long").distinct()
            .join(stars, ["a", "b"], "left_anti"))
    more = jobs.table(_confirm(rest, texts, words, percent), "links")
    if more.limit(1).count():
        comp = jobs.components(links.unionByName(more))
    return (base.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
            .join(comp.withColumnRenamed("node", "cid"), "cid", "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNull(), F.lit(None).cast("long"))
                        .otherwise(F.coalesce("root", "cid", "doc_id")))
            .select("doc_id", "n_shingles", "component_id",
                    (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept")))
