"""Repeated byte spans across and inside documents, by blockwise suffix
sorting with a difference cover.

Every ``length``-byte window of the corpus is the prefix of one suffix. The
suffixes are split into buckets by content: a window's bucket is the smallest
hash among its ``GRAM``-byte substrings, so equal windows always share a
bucket, and consecutive windows of one bucket form a *stretch* of text.

1. One scan cuts each document into stretches and writes their bucket and the
   128-bit digest of their text (about 0.6 % of the text positions).
2. Buckets met once hold no repeat and go. A digest met twice means that every
   window of those stretches is repeated: exact copies end here, however many.
   Hot buckets and digests (``HOT_COPIES``), of which there can't be more than
   ``HOT_KEYS``, are told to the tasks; the others are joined.
3. Of the other stretches one text per digest is fetched and whole buckets are
   sorted a block at a time (:func:`repeated_windows`): sample suffixes at
   difference-cover positions are ranked first, the block's suffixes are sorted
   by a short prefix, and ties - however long - compare two sample ranks.
   Neighbours that share ``length`` bytes are repeats.
4. A bucket of more than ``BUCKET_STRETCHES`` different stretches (one common
   passage in very many contexts) is not gathered: its windows become rows and
   an aggregate on their 128-bit hashes finds the repeats.

Texts are read as symbols of a fixed width: bytes (:data:`BYTES`), or words
(:data:`WORDS`, a 64-bit hash each, so that a window is ``length`` consecutive
words whatever white space is between them).

Memory per task is bounded by a block; no bucket, document set or digest list
reaches the driver. Defined cases: null text counts as empty, texts shorter
than ``length`` have no windows, repeated rows repeat each other, null doc_ids
are matched null-safely, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm import blocks as B, jobs

LENGTH = 400
GRAM = 64
BUCKET_STRETCHES = 2000
SORT_BYTES = 1 << 19
#: A bucket or text met this often is hot, and at least so often that no more
#: than HOT_KEYS of them can be.
HOT_COPIES, HOT_KEYS = 1000, 100_000



@dataclass(frozen=True)
class Symbols:
    """What texts are made of: symbols of ``width`` bytes. ``modulus`` and
    ``cover`` are a perfect difference set (every residue is a difference of two
    members); the 64-bit keys at the ``lead`` offsets span the modulus, and one
    key spans ``step`` symbols."""
    width: int
    modulus: int
    cover: tuple[int, ...]
    lead: tuple[int, ...]
    step: int

    def array(self, raw) -> np.ndarray:
        return np.frombuffer(raw, dtype=np.uint8 if self.width == 1 else np.uint64)

    def values(self, text: np.ndarray, salt: int = 7) -> np.ndarray:
        """A 64-bit value of each symbol, to be hashed."""
        return B.letter_values(False, salt)[text] if self.width == 1 else B.mix64(text + np.uint64(salt))

    def keys(self, text: np.ndarray) -> np.ndarray:
        """The ``step`` symbols from each position as one number."""
        if self.width > 1:
            return text
        out = np.zeros(len(text) - 8, dtype=np.uint64)
        for i in range(8):
            out = (out << np.uint64(8)) | text[i:len(text) - 8 + i]
        return out

    def shifts(self) -> np.ndarray:
        """For each difference r a member d of the cover with d + r also in it."""
        out = np.full(self.modulus, -1)
        for d in self.cover:
            for e in self.cover:
                out[(e - d) % self.modulus] = d
        assert (out >= 0).all()
        return out


# Perfect difference sets modulo 31 and modulo 7.
BYTES = Symbols(1, 31, (1, 5, 11, 24, 25, 27), (0, 8, 16, 24), 8)
WORDS = Symbols(8, 7, (1, 2, 4), (0, 1, 2, 3, 4, 5, 6), 1)

_KEY = "doc_id", "__th"


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values (length - w + 1 results)."""
    n = len(x)
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def stretches(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM, kind: Symbols = BYTES):
    """(row, first window, number of windows, bucket) of every stretch of a
    block of symbols; window positions count from the start of the block."""
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    prefix = B.prefix_sums(kind.values(data))
    _, inv = B.powers(len(prefix))
    m = len(data) - gram + 1
    h = B.mix64((prefix[gram:] - prefix[:-gram]) * inv[:m])
    w = length - gram + 1
    low = _sliding_min(h, w)
    # A position can be a bucket's anchor if it is the minimum of some window.
    flip = ~low
    high = ~_sliding_min(np.concatenate([np.full(w - 1, np.iinfo(np.uint64).max, np.uint64), flip,
                                         np.full(w - 1, np.iinfo(np.uint64).max, np.uint64)]), w)
    anchors = np.flatnonzero(h == high[:m])
    vals, gid = np.unique(h[anchors], return_inverse=True)
    order = np.lexsort((anchors, gid))
    span = np.int64(len(data) + 1)
    keys = gid[order].astype(np.int64) * span + anchors[order]
    # Runs of windows of one text with one minimum.
    row = np.searchsorted(offs, np.arange(n), side="right") - 1
    valid = np.arange(n) + length <= offs[row + 1]
    new = np.ones(n, dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    ok = valid[first]
    first, last = first[ok], last[ok]
    g = np.searchsorted(vals, low[first]).astype(np.int64) * span
    a, b = np.searchsorted(keys, g + first), np.searchsorted(keys, g + last + w)
    count = b - a
    run = np.repeat(np.arange(len(first)), count)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    at = keys[a[run] + nth] - g[run]
    before = np.where(nth > 0, np.concatenate([[-1], at[:-1]]) if len(at) else at, -1)
    lo, hi = np.maximum(first[run], before + 1), np.minimum(last[run], at)
    keep = lo <= hi
    lo, hi, run = lo[keep], hi[keep], run[keep]
    return row[lo], lo, hi - lo + 1, low[lo]


def _group_ids(words: np.ndarray, at: np.ndarray, kind: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Order of the positions by their leading keys, and which of the ordered
    start a new string of them."""
    cols = [words[at + i] for i in kind.lead]
    order = np.lexsort(cols[::-1])
    new = np.zeros(len(at), dtype=bool)
    new[:1] = True
    for c in cols:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def sample_ranks(words: np.ndarray, size: int, depth: int, kind: Symbols = BYTES) -> np.ndarray:
    """Ranks of the difference-cover suffixes of a text of ``size`` symbols by
    their first ``depth`` symbols at least, at their positions (0 elsewhere).
    Ranks double their depth each round: two suffixes a multiple of the modulus
    apart are both in the sample."""
    at = np.concatenate([np.arange(d, size, kind.modulus) for d in kind.cover])
    order, new = _group_ids(words, at, kind)
    rank = np.zeros(size + depth + 2 * kind.modulus, dtype=np.int64)
    rank[at[order]] = np.cumsum(new)
    step, top = kind.modulus, int(new.sum())
    while step < depth and top < len(at):
        key = rank[at] * np.int64(len(at) + 1) + np.where(at + step < size, rank[np.minimum(at + step, size)], 0)
        vals, inverse = np.unique(key, return_inverse=True)
        rank[at] = inverse + 1
        step, top = 2 * step, len(vals)
    return rank


def _settle_ties(at: np.ndarray, first: np.ndarray, size: np.ndarray, rank: np.ndarray, kind: Symbols) -> np.ndarray:
    """Sort each tie group (laid end to end; ``first`` and ``size`` per entry)
    by suffix order with Batcher's merge exchange, all groups at once: a
    comparison of two suffixes is one of two sample ranks."""
    table = kind.shifts()
    x = np.arange(len(at)) - first
    most = int(size.max(initial=0))
    p = 1
    while p < most:
        k = p
        while k >= 1:
            lead = k % p
            left = np.flatnonzero((x >= lead) & ((x - lead) % (2 * k) < k) & (x + k < size) & (x // (2 * p) == (x + k) // (2 * p)))
            a, b = at[left], at[left + k]
            shift = (table[(b - a) % kind.modulus] - a) % kind.modulus
            swap = rank[a + shift] > rank[b + shift]
            at[left[swap]], at[left[swap] + k] = b[swap], a[swap]
            k //= 2
        p *= 2
    return at


def repeated_windows(texts: list[bytes], counts: np.ndarray, length: int = LENGTH, kind: Symbols = BYTES) -> list[np.ndarray]:
    """For each text, which of its first ``counts`` windows of ``length``
    symbols equal another window of the block."""
    sizes = [len(t) // kind.width for t in texts]
    size = sum(sizes)
    text = kind.array(b"".join(texts) + bytes((length + 64) * kind.width))
    starts = np.cumsum([0] + sizes[:-1])
    ends = np.cumsum(counts)
    at = np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)
    words = kind.keys(text)
    order, new = _group_ids(words, at, kind)
    sorted_at = at[order]
    group_first = np.flatnonzero(new)
    group_size = np.diff(np.append(group_first, len(at)))
    tied = np.repeat(group_size > 1, group_size)
    hit = np.zeros(size + 1, dtype=bool)
    if tied.any():
        sub = sorted_at[tied]
        gs = group_size[group_size > 1]
        gf = np.cumsum(gs) - gs
        rank = sample_ranks(words, size, length + kind.modulus, kind)
        sub = _settle_ties(sub.copy(), np.repeat(gf, gs), np.repeat(gs, gs), rank, kind)
        pair = np.ones(len(sub), dtype=bool)
        pair[gf] = False
        i = np.flatnonzero(pair)
        for off in range(0, length, kind.step):
            off = min(off, length - kind.step)
            i = i[words[sub[i] + off] == words[sub[i - 1] + off]]
        hit[sub[i]] = True
        hit[sub[i - 1]] = True
    return [hit[s:s + c] for s, c in zip(starts, counts)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__th", F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))


def repeated_spans(docs: DataFrame, length: int = LENGTH, symbols: Symbols = BYTES, gram: int = GRAM) -> DataFrame:
    """(doc_id, __th, lo, hi): symbol ranges of documents covered by a repeated
    string of ``length`` symbols; __th is xxhash64 of the text. With
    :data:`WORDS`, tasks turn texts into word hashes (:func:`word_codes`) as they
    read them: a second Python worker beside each task's would do nothing else."""
    spark = docs.sparkSession
    jobs.prepare(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = symbols.width
    src = docs.select(*_KEY, "text") if "__th" in docs.columns else _keyed(docs.select("doc_id", "text"))
    src = src.select("doc_id", "text", "__th")
    coded = iter if width == 1 else word_codes

    @B.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in coded(batches):
            for lo, hi, data, offs in B.utf8_blocks(batch.column(1)):
                raw = memoryview(data)
                data, offs = symbols.array(raw), offs // width
                row, first, count, bucket = stretches(data, offs, length, gram, symbols)
                digest = b"".join(hashlib.blake2b(raw[s * width:(s + c + length - 1) * width], digest_size=16).digest()
                                  for s, c in zip(first.tolist(), count.tolist()))
                d = np.frombuffer(digest, dtype=np.int64).reshape(-1, 2)
                take = pa.array(row + lo)
                yield pa.record_batch([batch.column(0).take(take), batch.column(2).take(take), pa.array(B.as_long(bucket)),
                                       pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])),
                                       pa.array(first - offs[row]), pa.array(count)],
                                      names=["doc_id", "__th", "bucket", "d1", "d2", "first", "count"])

    cols = f"doc_id {kind}, __th long, bucket long, d1 long, d2 long, first long, count long"
    every = jobs.table(src.select("doc_id", "text", "__th").mapInArrow(scan, cols), "stretches")
    # (Written before the join: with a plain table on either side, a hot bucket's
    # partition can be split.)
    met = jobs.table(every.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "met")
    total = met.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).collect()[0]["n"]
    # What is met this often or more is HOT_KEYS keys at most. Such keys are told
    # to the tasks, so that the rows of one key never go to one task.
    often = max(2, HOT_COPIES, -(-total // HOT_KEYS))
    hot = F.broadcast(met.where(F.col("c") >= often).select("bucket"))
    shared = jobs.table(every.join(hot, "bucket").unionByName(
        every.join(hot, "bucket", "left_anti").join(met.where(F.col("c") < often).select("bucket"), "bucket")), "shared")
    # One row per stretch text; copies are settled by their number alone.
    texts = shared.groupBy("bucket", "d1", "d2").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "__th", "first", "count")).alias("at"))
    texts = jobs.table(texts, "texts")
    most = texts.where(F.col("copies") >= often).select("d1", "d2").toArrow()
    known = np.unique(np.stack([most["d1"].to_numpy(), most["d2"].to_numpy()], axis=1), axis=0)

    pairs = set(map(tuple, known.tolist()))

    def is_hot(d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        flag = np.isin(d1, known[:, 0])
        at = np.flatnonzero(flag)   # (the other half of the digest, for the few whose first half is known)
        flag[at] = [p in pairs for p in zip(d1[at].tolist(), d2[at].tolist())]
        return flag

    def hot_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hot stretches as ranges: a document's stretches lie in order in the
        scan's table, so neighbours are merged here."""
        for batch in batches:
            at = np.flatnonzero(is_hot(batch.column(3).to_numpy(), batch.column(4).to_numpy()))
            if not len(at):
                continue
            some = batch.take(pa.array(at))
            ids = some.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
            th, lo = some.column(1).to_numpy(), some.column(5).to_numpy()
            hi = lo + some.column(6).to_numpy() - 1 + length
            new = np.ones(len(at), dtype=bool)
            new[1:] = (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]) | (lo[1:] > hi[:-1]) | (lo[1:] < lo[:-1])
            start = np.flatnonzero(new)
            last = np.append(start[1:], len(at)) - 1
            yield pa.record_batch([some.column(0).take(pa.array(start)), some.column(1).take(pa.array(start)), pa.array(lo[start]), pa.array(hi[last])],
                                  names=["doc_id", "__th", "lo", "hi"])

    def not_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~is_hot(batch.column(3).to_numpy(), batch.column(4).to_numpy())))

    spans_type = f"doc_id {kind}, __th long, lo long, hi long"
    order = ["doc_id", "__th", "bucket", "d1", "d2", "first", "count"]
    others = shared.select(*order)
    if len(known):
        others = others.mapInArrow(not_hot, cols)
    rare = others.join(texts.where((F.col("copies") > 1) & (F.col("copies") < often)), ["bucket", "d1", "d2"], "left_semi")
    copied = rare.select(*_KEY, F.col("first").alias("lo"), (F.col("first") + F.col("count") - 1 + length).alias("hi"))
    if len(known):
        copied = copied.unionByName(every.select(*order).mapInArrow(hot_spans, spans_type))
    sizes = jobs.table(texts.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1"), "sizes")
    todo = texts.join(sizes, "bucket").select("at.*", "bucket", "k", "copies")
    listed = todo.groupBy(*_KEY).agg(F.collect_list(F.struct("first", "count", "bucket", "k", "copies")).alias("want"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in coded(batches):
            ids, ths = batch.column(0), batch.column(2)
            wants = batch.column(3).to_pylist()
            raw = batch.column(1).cast(pa.binary())
            for i, want in enumerate(wants):
                text = raw[i].as_py() or b""
                take = pa.array(np.full(len(want), i))
                yield pa.record_batch(
                    [ids.take(take), ths.take(take)] + [pa.array([w[c] for w in want], pa.int64()) for c in ("first", "count", "bucket", "k", "copies")]
                    + [pa.array([text[w["first"] * width:(w["first"] + w["count"] + length - 1) * width] for w in want], pa.binary())],
                    names=["doc_id", "__th", "first", "count", "bucket", "k", "copies", "part"])

    def bundle(rows):
        """Arrow batches of a reasonable number of rows."""
        pending, n = [], 0
        for b in rows:
            pending.append(b)
            n += b.num_rows
            if n >= 4096:
                yield from pa.Table.from_batches(pending).combine_chunks().to_batches()
                pending, n = [], 0
        if pending:
            yield from pa.Table.from_batches(pending).combine_chunks().to_batches()

    parts = jobs.table(src.join(listed, jobs.same(src, listed, *_KEY))
                       .select(src["doc_id"], src["text"], src["__th"], "want")
                       .mapInArrow(B.lean(lambda b: bundle(fetch(b))),
                                   f"doc_id {kind}, __th long, first long, count long, bucket long, k long, copies long, part binary"), "parts")

    def found(ids, ths, first, i, flags):
        a, b = _runs(flags)
        take = pa.array(np.full(len(a), i))
        return pa.record_batch([ids.take(take), ths.take(take), pa.array(first + a), pa.array(first + b - 1 + length)],
                               names=["doc_id", "__th", "lo", "hi"])

    def sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        held, last = 0, None

        def flush():
            tab = pa.Table.from_batches(pending).combine_chunks()
            if not tab.num_rows:
                return
            first, count, copies = (tab[c].to_numpy() for c in ("first", "count", "copies"))
            flags = repeated_windows(tab["part"].to_pylist(), count, length, symbols)
            ids, ths = tab["doc_id"].combine_chunks(), tab["__th"].combine_chunks()
            for i, f in enumerate(flags):
                if copies[i] == 1 and f.any():
                    yield found(ids, ths, int(first[i]), i, f)

        for batch in batches:
            bucket = batch.column(4).to_numpy()
            size = np.diff(np.frombuffer(batch.column(7).buffers()[1], np.int32)[batch.column(7).offset:][:batch.num_rows + 1])
            cut = np.flatnonzero(np.diff(bucket)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                if bucket[lo] != last and held >= SORT_BYTES:
                    yield from flush()
                    pending, held = [], 0
                last = bucket[lo]
                pending.append(batch.slice(lo, hi - lo))
                held += int(size[lo:hi].sum())
        if pending:
            yield from flush()

    near = (parts.where(F.col("k") <= BUCKET_STRETCHES).repartition(jobs.partitions(spark), "bucket").sortWithinPartitions("bucket")
            .mapInArrow(B.lean(lambda b: bundle(sort_blocks(b))), spans_type))

    @B.lean
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in B.utf8_blocks(batch.column(7), 1 << 18):
                data, offs = symbols.array(memoryview(data)), offs // width
                count = batch.column(3).to_numpy()[lo:hi]
                at = np.arange(count.sum()) + np.repeat(offs[:-1] - (np.cumsum(count) - count), count)
                row = np.repeat(np.arange(lo, hi), count)
                hashes = [B.as_long(B.range_hash(B.prefix_sums(symbols.values(data, s)), at, at + length)) for s in (7, 8)]
                take = pa.array(row)
                yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take),
                                       pa.array(batch.column(2).to_numpy()[row] + at - offs[row - lo]),
                                       batch.column(6).take(take), *map(pa.array, hashes)],
                                      names=["doc_id", "__th", "lo", "copies", "w1", "w2"])

    wins = parts.where(F.col("k") > BUCKET_STRETCHES).mapInArrow(
        explode, f"doc_id {kind}, __th long, lo long, copies long, w1 long, w2 long")
    twice = wins.groupBy("w1", "w2").agg(F.sum("copies").alias("c")).where("c > 1").select("w1", "w2")
    wide = wins.where("copies = 1").join(twice, ["w1", "w2"]).select(*_KEY, "lo", (F.col("lo") + length).alias("hi"))
    return copied.unionByName(near).unionByName(wide)


def merge_spans(pairs: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of a list of byte ranges."""
    out: list[list[int]] = []
    for lo, hi in sorted((p["lo"], p["hi"]) for p in pairs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def word_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with the text in column 1 as the 64-bit hashes of its words
    (runs of bytes other than 0x20 and 0x09-0x0D), laid end to end."""
    for batch in batches:
        for lo, hi, data, offs in B.utf8_blocks(batch.column(1)):
            starts, ends, rows = B.word_spans(data, offs, B.space_words())
            h = B.range_hash(B.prefix_hash(data, B.letter_values(False)), starts, ends)
            some = batch.slice(lo, hi - lo).columns
            yield pa.record_batch([some[0], B.binary_column(h, 8 * B.row_bounds(rows, hi - lo)), *some[2:]], names=batch.schema.names)


def _byte_runs(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as the bytes from the first word's start to the last one's end."""
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends, _ = B.word_spans(data, np.array([0, len(data)]), B.space_words())
    return [(int(starts[a]), int(ends[b - 1])) for a, b in runs]


def remove_repeats(docs: DataFrame, length: int = LENGTH, replace: bool = False, words: int | None = None) -> DataFrame:
    """The documents' columns plus kept (binary: the text's bytes that no
    repeated string covers), spans (the removed byte runs) and n_bytes; input
    columns of these names give way to them. With ``replace``, only the
    documents' columns: text becomes the kept bytes, without the pieces of a
    character that a cut left (null stays null). With ``words``, strings are that
    many consecutive words in place of ``length`` bytes, and the white space
    between two covered words goes with them."""
    if not replace:
        docs = docs.drop("kept", "spans", "n_bytes")
    src = _keyed(docs)
    if words:
        found = repeated_spans(docs, words, WORDS, max(1, words // 6))
    else:
        found = repeated_spans(docs, length)
    spans = jobs.table(found, "spans")
    per = spans.groupBy(*_KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("__cut"))
    joined = src.join(per, jobs.same(src, per, *_KEY), "left").select(*[src[c] for c in docs.columns], "__cut")
    names = [f.name for f in docs.schema]
    text_at = names.index("text")

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, list[tuple[int, int]]]]:
        """(text, kept bytes, removed byte runs) of each row."""
        raw = batch.column(text_at).cast(pa.binary())
        for text, pairs in zip(raw.to_pylist(), batch.column(len(names)).to_pylist()):
            text = text or b""
            runs = merge_spans(pairs or [])
            if runs and words:
                runs = _byte_runs(text, runs)
            edges = [0, *[e for r in runs for e in r], len(text)]
            yield text, b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else text, runs

    @B.lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for batch in batches:
            rows = list(pieces(batch))
            yield pa.record_batch([*batch.columns[:len(names)], pa.array([kept for _, kept, _ in rows], pa.binary()),
                                   pa.array([[{"lo": a, "hi": b} for a, b in runs] for _, _, runs in rows], kind),
                                   pa.array([len(text) for text, _, _ in rows], pa.int64())],
                                  names=[*names, "kept", "spans", "n_bytes"])

    @B.lean
    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(text_at).is_valid().to_pylist()
            text = pa.array([kept.decode("utf-8", "ignore") if k else None for (_, kept, _), k in zip(pieces(batch), known)], pa.string())
            yield pa.record_batch([*batch.columns[:text_at], text, *batch.columns[text_at + 1:len(names)]], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    if replace:
        return joined.mapInArrow(swap, schema)
    return joined.mapInArrow(cut, schema + ", kept binary, spans array<struct<lo:long,hi:long>>, n_bytes long")
