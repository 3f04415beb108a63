"""Quality classifier: an interpolated modified Kneser-Ney model of trusted
text gives each document a perplexity, thresholded by quantiles per language.

The model's symbols are the characters themselves (:func:`symbol_classes` gives
each code point a number of its own), its order is 4. A gram is its three
leading symbols (``head``, 21 bits each) and its ``last`` one, so the tables of
counts grow with the trusted text. Counts of all orders, discounts, continuation
counts and back-off weights are Spark aggregates. Scoring goes by blocks of
documents: the different grams of each block are rows, joins sharded by gram
bring their probabilities to them (:func:`look_up`), and a block's documents meet
its own grams in a cogroup. A task holds a block and its grams, never the model.

Below the unigrams lies a fixed prior over all of Unicode (:func:`prior`).

A second model of the same kind, of the texts' shapes (:func:`shapes` folds the
symbols into 64), adds two scores: to the characters' model any number or code
in good prose is as odd as an odd word, to that of shapes it is not.

Trusted text: documents labelled quality 1 and not toxic. A third of them (by
id hash) is held out; all the others train the models. Five scores of a text are
held against *all* held-out documents of its language: the mean per symbol and
the mean of its worst span of ``SPAN`` symbols (one odd word in long prose), by
characters and by shapes, and how much of a window of ``WINDOW`` symbols repeats
the window's own grams (one word over and over, which the model finds likely). The limit of each is the quantile
of the held-out scores at which the five together reject ``1 - quantile`` of
trusted text. A language with too few held-out documents for that takes the
pooled quantile of scores normalised by each language's mean and deviation; one
with fewer than ``LEAST``, the highest limit there is; without held-out
documents nothing is rejected. Texts shorter than a span are filled up to one
at the trusted mean.

Defined cases: null or empty texts have no perplexity and are kept; a null
language is a language of its own; repeated rows and labels count as often as
they occur (a label with any null flag isn't trusted); extra columns pass.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quarry.llm import blocks as B, jobs
from quarry.plans import sizing

ORDER = 4
CHARACTERS, BITS = 0x110000, 21  # code points, and bits of a symbol
SYMBOLS = 256  # of the prior: the lowest symbols, and one for all the others
SHAPES = 64
LAST = (1 << BITS) - 1
BLOCK_BYTES = 16 << 20  # of the texts that are scored together
QUANTILE = 0.995
HELD_OUT, LEAST = 3, 20
SPAN, WINDOW = 12, 128
SCORES = ("mean", "span", "repeats", "shape_mean", "shape_span")
BINS = 1000  # per nat, share or deviation, of the quantiles


@functools.cache
def symbol_classes() -> np.ndarray:
    """Symbol of each code point: every character is a class of its own, its
    code point plus one. 0 is the start of a text."""
    return np.arange(1, CHARACTERS + 1, dtype=np.uint32)


@functools.cache
def shapes() -> np.ndarray:
    """Shape of each symbol: 0 is the start of a text, 1-26 a-z, 27 capitals,
    28-39 other letters, 40 digits, 41 space, 42 line feed, 43 other, 44-63
    ASCII punctuation."""
    out = np.full(CHARACTERS + 1, 43, dtype=np.uint8)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        if kind in ("Lu", "Lt"):
            out[c + 1] = 27
        elif kind[0] == "L" or kind[0] == "M":
            out[c + 1] = c - 96 if 97 <= c <= 122 else 28 + c % 12
        elif kind[0] == "N":
            out[c + 1] = 40
        elif 33 <= c < 127:
            out[c + 1] = 44 if chr(c) == "." else 45 if chr(c) == "," else 46 + c % 18
    out[0], out[33], out[11] = 0, 41, 42
    return out


def shaped(rows: DataFrame) -> DataFrame:
    """The grams' columns plus the gram of their shapes (shape_head, shape_last)."""
    at = rows.columns.index("head"), rows.columns.index("last")

    @B.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = shapes().astype(np.int64)
        for batch in batches:
            head, last = (batch.column(i).to_numpy() for i in at)
            folded = sum(fold[head >> shift & LAST] << shift for shift in range(0, BITS * (ORDER - 1), BITS))
            yield pa.record_batch([*batch.columns, pa.array(folded), pa.array(fold[last].astype(np.int32))], names=names)

    names = [*rows.columns, "shape_head", "shape_last"]
    return rows.mapInArrow(scan, T.StructType([*rows.schema.fields, T.StructField("shape_head", T.LongType()), T.StructField("shape_last", T.IntegerType())]))


def prior() -> Column:
    """The probability of the symbol ``last`` without any counts: the lowest
    ``SYMBOLS - 1`` share alike with all other characters together."""
    return F.when(F.col("last") < SYMBOLS - 1, 1.0 / SYMBOLS).otherwise(1.0 / SYMBOLS / (CHARACTERS + 1 - (SYMBOLS - 1)))


def split_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different heads of the texts' order-4 grams (ascending), the grams,
    one per character (the number of its head, then its last symbol), and the
    bounds of the texts."""
    sizes = np.array([len(t or "") for t in texts], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sym = symbol_classes()[points]
    flags = np.zeros(CHARACTERS + 1, dtype=bool)
    flags[sym] = flags[0] = True
    alphabet = np.flatnonzero(flags)
    size = len(alphabet)
    # Few characters: heads are numbered by a table, of the symbols' ranks.
    # Many: by sorting the symbols themselves.
    dense = size ** (ORDER - 1) <= 1 << 22
    step = size if dense else 1 << BITS
    ranks = np.zeros(CHARACTERS + 1, dtype=np.int32)
    ranks[alphabet] = np.arange(size)
    used = ranks[sym] if dense else sym
    head = np.zeros(len(sym), dtype=np.int64)
    at = np.arange(len(sym)) - np.repeat(bounds[:-1], sizes)
    for back in range(1, ORDER):
        prev = np.zeros(len(sym), dtype=np.int64)
        prev[back:] = used[:len(sym) - back]
        prev[at < back] = 0
        head += prev * step ** (back - 1)
    if dense:
        met = np.zeros(size ** (ORDER - 1), dtype=bool)
        met[head] = True
        heads = np.flatnonzero(met)
        numbers = np.zeros(len(met), dtype=np.int32)
        numbers[heads] = np.arange(len(heads))
        number = numbers[head]
        heads = sum(alphabet[heads // size ** back % size] << BITS * back for back in range(ORDER - 1))
    else:
        heads, number = np.unique(head, return_inverse=True)
    return heads, number.astype(np.int64) << BITS | sym, bounds


def different_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different grams of all the texts (head, last) and how often each
    occurs, put together from blocks of 1 MB."""
    parts = []
    for _, _, some in _text_blocks(texts):
        heads, code, _ = split_grams(some)
        code, n = np.unique(code, return_counts=True)
        parts.append((heads[code >> BITS], code & LAST, n))
    head, last, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts) if parts else ((), (), ())))
    heads, number = np.unique(head, return_inverse=True)
    code, where = np.unique(number.astype(np.int64) << BITS | last, return_inverse=True)
    return heads[code >> BITS], (code & LAST).astype(np.int32), np.bincount(where, weights=n, minlength=len(code)).astype(np.int64)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The order-4 grams of the texts, one per character, as numbers that hold
    for these texts only, and the bounds of the texts."""
    return split_grams(texts)[1:]


def _text_blocks(texts: pa.Array, limit: int = 1 << 20):
    """Lists of texts of about ``limit`` bytes; no more of them are Python
    objects at a time."""
    for lo, hi, _, _ in B.utf8_blocks(texts, limit):
        yield lo, hi, texts.slice(lo, hi - lo).to_pylist()


def gram_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(head, last, trained): every gram of the trusted documents (a table of
    different ids) and how often it occurs there, summed per block first."""
    @B.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in B.utf8_blocks(batch.column(0), BLOCK_BYTES):
                yield pa.record_batch([pa.array(x) for x in different_grams(batch.column(0).slice(lo, hi - lo))], names=["head", "last", "trained"])

    ids = sizing.bounded_broadcast(trusted.select(F.col("doc_id").alias("__id")))
    good = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("__id"))
    return good.select("text").mapInArrow(scan, "head long, last int, trained long").groupBy("head", "last").agg(F.sum("trained").alias("trained"))


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the
    counts of counts 1 to 4; a fixed 1/2, 1, 3/2 where those are missing."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in range(1, 5))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


def suffix(order: int) -> Column:
    """The head of a gram's last ``order`` symbols."""
    return F.col("head").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1).cast("long"))


def log_probabilities(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """The model: for each order, lowest first, its contexts (head, total, held)
    and its grams (head, last, own), which :func:`look_up` interpolates."""
    tables: list[DataFrame] = [counts.where("trained > 0").select("head", "last", F.col("trained").alias("c"))]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: different symbols before
        tables.append(jobs.table(tables[-1].groupBy(suffix(order).alias("head"), "last").agg(F.count("*").alias("c")), "grams"))
    model = []
    for grams_of in reversed(tables):
        few = grams_of.groupBy(F.least("c", F.lit(5)).alias("c")).agg(F.count("*").alias("n")).where("c < 5").collect()
        d1, d2, d3 = discounts({r["c"]: r["n"] for r in few})
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        model.append((grams_of.groupBy("head").agg(F.sum("c").alias("total"), F.sum(off).alias("held")),
                      grams_of.select("head", "last", (F.col("c") - off).alias("own"))))
    return model


def look_up(model: list[tuple[DataFrame, DataFrame]], wanted: DataFrame, prob: Column) -> DataFrame:
    """The wanted grams' columns (head, last and others) plus logp, by joins with
    the contexts and grams of each order; ``prob`` is the prior. Tables of one row
    per symbol at most are broadcast: their keys are few, so a shuffle by them
    would be lopsided."""
    out, names = wanted, wanted.columns
    for order, (context, seen) in enumerate(model, 1):
        context, seen = context.withColumnRenamed("head", "key"), seen.withColumnRenamed("head", "key")
        out = (out.withColumn("key", suffix(order)).withColumn("before", prob)
               .join(F.broadcast(context) if order <= 2 else context, "key", "left")
               .join(F.broadcast(seen) if order == 1 else seen, ["key", "last"], "left")
               .select(*names, F.when(F.col("total").isNull(), F.col("before")).otherwise(
                   (F.coalesce("own", F.lit(0.0)) + F.col("held") * F.col("before")) / F.col("total")).alias("p")))
        prob = F.col("p")
    return out.select(*names, F.log("p").cast("float").alias("logp"))


def worst_spans(total: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The highest sum over ``SPAN`` symbols of each text (of the whole text if
    it is shorter), from the running total of a block of texts."""
    sums = total[SPAN:] - total[:-SPAN] if len(total) > SPAN else total[:0]
    return np.array([sums[lo:hi - SPAN + 1].max() if hi - lo >= SPAN else total[hi] - total[lo]
                     for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())], dtype=np.float64)


def repeat_shares(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The highest share of a window's grams that repeat others of the window,
    over each text's windows of ``WINDOW`` symbols (side by side, and the last
    one). A shorter text is one window, of ``SPAN`` symbols at least."""
    out = np.zeros(len(bounds) - 1)
    rows, owners = [], []
    for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if hi - lo < WINDOW:
            out[i] = (hi - lo - len(np.unique(code[lo:hi]))) / max(hi - lo, SPAN)
            continue
        k = (hi - lo) // WINDOW
        rows += [code[lo:lo + k * WINDOW].reshape(k, WINDOW), code[hi - WINDOW:hi].reshape(1, WINDOW)]
        owners += [(i, k + 1)]
    if rows:
        ranked = np.sort(np.concatenate(rows), axis=1)
        same = (ranked[:, 1:] == ranked[:, :-1]).sum(axis=1)
        who, sizes = np.array(owners).T
        out[who] = np.maximum.reduceat(same, np.concatenate([[0], np.cumsum(sizes)[:-1]])) / WINDOW
    return out


def blocks_of(docs: DataFrame) -> DataFrame:
    """The documents' columns plus __block, a number shared by rows of about
    ``BLOCK_BYTES`` of text; the first row of a block names its different grams
    (__grams), the others have null there."""
    at = docs.columns.index("text")
    names = [*docs.columns, "__block", "__grams"]
    kind = pa.list_(pa.struct([("head", pa.int64()), ("last", pa.int32())]))

    @B.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, _, _ in B.utf8_blocks(batch.column(at), BLOCK_BYTES):
                pairs = pa.StructArray.from_arrays([pa.array(x) for x in different_grams(batch.column(at).slice(lo, hi - lo))[:2]], fields=list(kind.value_type))
                first = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs, type=kind)
                ids = pa.array(np.full(hi - lo, number, dtype=np.int64))
                yield pa.record_batch([*batch.slice(lo, 1).columns, ids.slice(0, 1), first], names=names)
                if hi - lo > 1:
                    yield pa.record_batch([*batch.slice(lo + 1, hi - lo - 1).columns, ids.slice(1), pa.nulls(hi - lo - 1, kind)], names=names)
                number += 1

    schema = T.StructType([*docs.schema.fields, T.StructField("__block", T.LongType()), T.StructField("__grams", T.ArrayType(
        T.StructType([T.StructField("head", T.LongType()), T.StructField("last", T.IntegerType())])))])
    return docs.mapInArrow(scan, schema)


class Scorer:
    """Adds the negative log-probability of each text and of its worst span, by
    characters and by shapes, and the share of repeats, to its row."""

    def __init__(self, model: list[tuple[DataFrame, DataFrame]], shape_model: list[tuple[DataFrame, DataFrame]]):
        self.model, self.shape_model = model, shape_model

    def look_up(self, wanted: DataFrame) -> DataFrame:
        """(head, last, logp, shape_logp) of different grams."""
        both = jobs.table(shaped(wanted), "wanted")
        folded = both.select(F.col("shape_head").alias("head"), F.col("shape_last").alias("last")).distinct()
        by_shape = look_up(self.shape_model, folded, F.lit(1.0 / SHAPES)).toDF("shape_head", "shape_last", "shape_logp")
        return look_up(self.model, both, prior()).join(by_shape, ["shape_head", "shape_last"]).select("head", "last", "logp", "shape_logp")

    def score(self, docs: DataFrame) -> DataFrame:
        """The documents' columns plus __n (symbols), __same (the share of
        repeats), __nll and __shape_nll (the sums), __span and __shape_span (the
        sums over the worst span)."""
        at = docs.columns.index("text")
        added = ["__nll", "__span", "__shape_nll", "__shape_span", "__same"]
        names = [*docs.columns, "__n", *added]
        blocks = jobs.bucketed(blocks_of(docs), "__block", "blocks")  # so that no text is shuffled
        asked = blocks.where("__grams is not null").select(F.col("__block").alias("__of"), F.inline("__grams"))
        known = jobs.table(self.look_up(asked.select("head", "last").distinct()), "logp")

        def scan(rows: pa.Table, found: pa.Table) -> pa.Table:
            B.give_back()
            head, last, *logps = (found[c].to_numpy() for c in ("head", "last", "logp", "shape_logp"))
            heads, number = np.unique(head, return_inverse=True)
            keys = number.astype(np.int64) << BITS | last
            order = np.argsort(keys)
            keys, logps = keys[order], [x[order] for x in logps]
            n, out = [np.zeros(0, np.int64)], [[np.zeros(0)] for _ in added]
            for _, _, texts in _text_blocks(rows.column(at).combine_chunks()):
                mine, code, bounds = split_grams(texts)
                where = np.searchsorted(keys, (np.searchsorted(heads, mine) << BITS)[code >> BITS] | code & LAST)
                n.append(np.diff(bounds))
                for i, logp in enumerate(logps):
                    total = np.concatenate([[0.0], np.cumsum(-logp[where], dtype=np.float64)])
                    out[2 * i].append(total[bounds[1:]] - total[bounds[:-1]])
                    out[2 * i + 1].append(worst_spans(total, bounds))
                out[-1].append(repeat_shares(code, bounds))
            return pa.Table.from_arrays([*rows.columns[:len(names) - 1 - len(added)], *[pa.array(np.concatenate(x)) for x in (n, *out)]], names=names)

        schema = T.StructType([*[blocks.schema[c] for c in docs.columns], T.StructField("__n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in added]])
        sent = blocks.select(*[blocks[c] for c in docs.columns], "__block")
        return sent.groupBy("__block").cogroup(asked.join(known, ["head", "last"]).groupBy("__of")).applyInArrow(scan, schema)


def fit(docs: DataFrame, labels: DataFrame, train_docs: int | None = None) -> Scorer:
    """Train on all trusted documents that aren't held out (or on ``train_docs``
    of them, if a caller asks for that)."""
    jobs.prepare(docs.sparkSession)
    ids = trusted_ids(labels).where(~held_out())
    if train_docs is not None:
        ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    counts = jobs.table(gram_counts(docs, jobs.table(ids, "trained")), "counts")
    by_shape = shaped(counts).groupBy("shape_head", "shape_last").agg(F.sum("trained")).toDF("head", "last", "trained")
    return Scorer(log_probabilities(counts), log_probabilities(jobs.table(by_shape, "counts")))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def held_out() -> Column:
    return F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(HELD_OUT)) == 0


def thresholds(scored: DataFrame, labels: DataFrame, quantile: float) -> tuple[DataFrame, tuple[float, float], dict[str, float | None]]:
    """(lang, a limit per score) of every language with enough held-out
    documents, the trusted means per symbol (by characters, by shapes), and the
    limits of the others."""
    ids = trusted_ids(labels).where(held_out()).withColumnRenamed("doc_id", "__id")
    small = jobs.table(scored.where("__n > 0").select(F.col("doc_id").cast("long").alias("__id"), "lang", "__n", "__nll", "__span", "__shape_nll", "__shape_span", "__same")
                       .join(ids, "__id"), "trusted")
    total = small.agg(F.sum("__nll").alias("s"), F.sum("__shape_nll").alias("t"), F.sum("__n").alias("n")).collect()[0]
    if not total["n"]:
        return small.select("lang", *[F.lit(None).cast("double").alias(f"__{k}_limit") for k in SCORES]).limit(0), (0.0, 0.0), dict.fromkeys(SCORES)
    means = total["s"] / total["n"], total["t"] / total["n"]
    tail = (1 - quantile) / len(SCORES)  # the share that each score may reject
    each = jobs.table(small.select("lang", F.explode(F.array(*[F.struct(F.lit(k).alias("score"), v.alias("v")) for k, v in values(means).items()])))
                      .select("lang", "col.*"), "scores")

    def at_quantile(column: str) -> Column:
        return F.expr(f"percentile_disc({1 - tail!r}) WITHIN GROUP (ORDER BY ceil({column} * {BINS}))") / BINS

    own = jobs.table(each.groupBy("lang", "score").agg(at_quantile("v").alias("own"), F.count("*").alias("n"), F.mean("v").alias("m"),
                                                       F.stddev_pop("v").alias("sd")), "own")
    known = F.broadcast(own.select(F.col("lang").alias("__lang"), F.col("score").alias("__score"), "m", "sd"))
    usual = each.join(known, each["lang"].eqNullSafe(F.col("__lang")) & (each["score"] == F.col("__score"))).select(
        "score", F.when(F.col("sd") > 0, (F.col("v") - F.col("m")) / F.col("sd")).otherwise(0.0).alias("z"))
    pooled = usual.groupBy("score").agg(at_quantile("z").alias("z"))
    every = own.join(F.broadcast(pooled), "score").select(
        "lang", "score", "n", F.when(F.col("n") * tail >= 1, F.col("own")).otherwise(F.greatest("own", F.col("m") + F.col("z") * F.col("sd"))).alias("at"))
    every = jobs.table(every.groupBy("lang").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("score") == k, F.col("at"))).alias(f"__{k}_limit") for k in SCORES]), "limits")
    highest = every.agg(*[F.max(f"__{k}_limit").alias(k) for k in SCORES]).collect()[0].asDict()
    return every.where(F.col("n") >= LEAST).drop("n"), means, highest


def values(means: tuple[float, float]) -> dict[str, Column]:
    """The scores of a text, the higher the worse; texts shorter than a span
    are filled up to one at the trusted means."""
    n, span = F.col("__n"), F.lit(SPAN)
    out = {"repeats": F.col("__same")}
    for of, mean in zip(("", "shape_"), means):
        fill = F.lit(mean) * F.greatest(span - n, F.lit(0))
        out |= {f"{of}mean": (F.col(f"__{of}nll") + fill) / F.greatest(n, span), f"{of}span": (F.col(f"__{of}span") + fill) / span}
    return out


def judge(docs: DataFrame, labels: DataFrame, train_docs: int | None = None, quantile: float = QUANTILE, text: bool = True) -> DataFrame:
    """The documents' columns (without ``text``, all but that) plus perplexity,
    its limit (both per symbol) and accepted."""
    scorer = fit(docs, labels, train_docs)
    scored = scorer.score(docs)
    rows = jobs.table(scored if text else scored.drop("text"), "scored")
    limits, means, highest = thresholds(rows, labels, quantile)
    lim = limits.withColumnRenamed("lang", "__lang")
    joined = rows.join(F.broadcast(lim) if limits.count() <= 10_000 else lim, rows["lang"].eqNullSafe(lim["__lang"]), "left")
    limit = {k: F.coalesce(f"__{k}_limit", F.lit(highest[k]).cast("double")) for k in SCORES}
    within = F.lit(True)
    for k, v in values(means).items():
        within = within & F.coalesce(v <= limit[k], F.lit(True))
    return joined.select(*[rows[c] for c in docs.columns if text or c != "text"],
                         F.when(F.col("__n") > 0, F.exp(F.col("__nll") / F.col("__n"))).alias("perplexity"),
                         F.exp(limit["mean"]).alias("limit"),
                         ((F.col("__n") == 0) | within).alias("accepted"))
