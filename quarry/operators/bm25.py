"""BM25 keyword ranking over a corpus DataFrame, many queries at once.

Index tables (all plain DataFrames, storable as Parquet):

* ``forward(path, dl, terms)`` - one row per document with its term counts,
  counted inside the row, so building needs no shuffle.
* ``postings(term, path, tf, dl)`` - the forward table exploded, or the stored
  table partitioned by a hash bucket of the term.
* ``doc_stats(path, dl, prank)`` - documents with at least one token and
  their 1-based position in path order (used by the zero-score fill).
* ``term_stats(term, df, idf)`` - document frequency and floored idf.
* N, the mean document length and the mean raw idf, stored as one row.

A materialised index keeps the forward rows hash-partitioned and sorted by path
(a reliable checkpoint keeps that). Documents are scored where their rows lie, a
block of documents against all query terms at a time: pairs of queries and
documents are neither rows nor groups, and only the best k of each query and
task travel. More queries than ``RANKED_ROWS`` allows are joined with postings.

Scoring follows the Okapi BM25 variant with an idf floor: ``idf =
ln(N - df + 0.5) - ln(df + 0.5)``; negative values are replaced by
``0.25 * mean(idf over the whole vocabulary)``; a repeated query token counts
once per repetition; documents matching no query term score 0 and stay in
the ranking; ties are broken by path ascending.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import TOKEN_PATTERN, has_nul, is_hidden_path, tokenize
from quarry.plans.ordinal import global_ordinal
from quarry.plans.sizing import bounded_broadcast, spread_small_input

# Fixed values of the ranking function.
K1 = 1.5
B = 0.75
EPSILON = 0.25
DEFAULT_K = 50

# Hash buckets of a stored postings table, and how many query terms a stored
# search pushes into its scan by name (more are pruned by bucket alone).
TERM_BUCKETS = 64
PUSHED_TERMS = 1000

# Most rows (queries x k) of a task's ranked lists, and how many (posting, query)
# and (document, query) numbers a task holds at a time.
RANKED_ROWS = 1_000_000
SCORE_BLOCK = 1 << 20


@dataclass
class Bm25Index:
    postings: DataFrame
    doc_stats: DataFrame | None   # path, dl, prank (1-based ordinal in path order); None = derive on use
    term_stats: DataFrame
    doc_lengths: DataFrame | None = None   # path, dl without the ordinal (cheaper for N, avgdl)
    forward: DataFrame | None = None       # path, dl, terms (build output)
    stored: bool = False                   # postings carry their bucket, doc_stats their ordinal
    n_docs: int | None = None              # N and avgdl as literals once known
    avgdl: float | None = None
    clustered: bool = False                # forward rows lie sorted by path, a path in one partition

    def stats(self) -> tuple[Column, Column]:
        """(N, avgdl): literals where known, scalar subqueries otherwise."""
        if self.n_docs is not None:
            return F.lit(self.n_docs), F.lit(self.avgdl)
        return corpus_stats(self.lengths)

    @property
    def lengths(self) -> DataFrame:
        return self.doc_lengths if self.doc_lengths is not None else self.doc_stats.select("path", "dl")

    def ordinal(self) -> DataFrame:
        """doc_stats with ``prank``; derived from the lengths on first use,
        stored indexes carry it."""
        if self.doc_stats is None:
            self.doc_stats = with_path_ordinal(self.lengths)
        return self.doc_stats

    def leading(self, n: int) -> DataFrame:
        """(path, prank) of the first ``n`` documents in path order."""
        return self.ordinal().select("path", "prank").filter(F.col("prank") <= F.lit(n))

    def best_scores(self, queries: DataFrame, k: int, digits: int, n_terms: int, tokenizer) -> DataFrame:
        """(qid, path, score) that hold every query's ``k`` best among others."""
        if self.avgdl is not None:
            terms = _asked_terms(query_terms(queries, tokenizer=tokenizer), n_terms, k)
            if self.forward is not None and terms is not None:
                weighted = terms.join(self.term_stats.select("term", "idf"), "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
                return _ranked(self, weighted, k, digits, self.avgdl)
        return bm25_scores(self, queries, query_rows=n_terms, tokenizer=tokenizer)

    def by_path(self) -> DataFrame:
        """The forward rows sorted by path, all rows of a path in one partition."""
        return self.forward if self.clustered else self.forward.repartition("path").sortWithinPartitions("path")

    def of_paths(self, paths: DataFrame) -> "Bm25Index":
        """Postings of some documents; the statistics stay those of all."""
        if self.forward is None:
            return replace(self, postings=self.postings.join(paths, "path", "left_semi"))
        some = Bm25Index.from_forward(self.forward.join(paths, "path", "left_semi"))
        return replace(self, postings=some.postings, forward=None)

    @classmethod
    def from_forward(cls, forward: DataFrame) -> "Bm25Index":
        """Postings, lengths and term statistics of a forward table."""
        postings = forward.select("path", "dl", F.explode("terms").alias("t")).select(
            "t.term", "path", "dl", "t.tf")
        lengths = forward.select("path", "dl")
        return cls(postings, None, term_stats_of(postings, lengths), lengths, forward)

    def materialize(self) -> "Bm25Index":
        """Reliable checkpoint of the index (cuts lineage, survives executor
        loss, unlike a local checkpoint). Forward rows are hashed by path once."""
        from quarry.session import cut_lineage, ensure_checkpoint_dir
        spark = self.postings.sparkSession
        if self.forward is None:
            postings, lengths = cut_lineage(self.postings), cut_lineage(self.lengths)
            forward = None
        else:
            ensure_checkpoint_dir(spark)
            parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
            forward = _checkpoint_partitioned(self.forward.repartition(parts, "path").sortWithinPartitions("path"))
            base = Bm25Index.from_forward(forward)
            postings, lengths = base.postings, base.doc_lengths
        n_docs, avgdl = _known_stats(lengths)
        term_stats = cut_lineage(term_stats_of(postings, lengths, n_docs=n_docs))
        return Bm25Index(postings, None, term_stats, lengths, forward, n_docs=n_docs, avgdl=avgdl, clustered=forward is not None)

    def write(self, base: str, mode: str = "overwrite") -> "Bm25Index":
        """Persist the tables. Postings are partitioned by a hash bucket of the
        term and sorted by term inside each file, so a search reads the query's
        buckets and, by row-group statistics, little else; a term of a large
        share of all documents is spread over many tasks and files by path."""
        from quarry.session import cut_lineage
        spark = self.postings.sparkSession
        if self.forward is not None and not self.clustered:
            # Texts are tokenised once: postings, lengths and counts read the written rows.
            base_rows = Bm25Index.from_forward(cut_lineage(self.forward))
            return replace(base_rows, doc_stats=self.doc_stats, forward=None, n_docs=self.n_docs, avgdl=self.avgdl).write(base, mode)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        (self.postings.select("term", "path", "tf", "dl", term_bucket("term").alias("bucket"))
         .repartition(parts, "bucket", F.pmod(F.xxhash64("path"), F.lit(max(1, parts // TERM_BUCKETS))))
         .sortWithinPartitions("bucket", "term", "path").write.mode(mode).partitionBy("bucket").parquet(f"{base}/postings"))
        self.ordinal().sortWithinPartitions("prank").write.mode(mode).parquet(f"{base}/doc_stats")
        lengths = spark.read.parquet(f"{base}/doc_stats")
        n_docs, avgdl = (self.n_docs, self.avgdl) if self.n_docs is not None else _known_stats(lengths)
        term_stats_of(self.postings, lengths, n_docs=n_docs).sort("term").write.mode(mode).parquet(f"{base}/term_stats")
        (spark.range(1).select(F.lit(n_docs).cast("long").alias("n_docs"), F.lit(avgdl).cast("double").alias("avgdl"))
         .write.mode(mode).parquet(f"{base}/stats"))
        return read_index(spark, base)


def _checkpoint_partitioned(df: DataFrame) -> DataFrame:
    """A reliable checkpoint that still knows the hash partitioning of ``df``. An
    adaptive plan tells none, so this one plan (a scan and one exchange) is made
    without adaptive execution."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return df.checkpoint()
    finally:
        conf.set(name, before)


def term_bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def _known_stats(lengths: DataFrame) -> tuple[int, float | None]:
    st = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    return int(st["n"]), (float(st["avgdl"]) if st["avgdl"] is not None else None)


def read_index(spark, base: str) -> Bm25Index:
    st = spark.read.parquet(f"{base}/stats").first()
    postings = spark.read.schema("term string, path string, tf int, dl int, bucket int").parquet(f"{base}/postings")
    return Bm25Index(postings, spark.read.parquet(f"{base}/doc_stats"), spark.read.parquet(f"{base}/term_stats"),
                     stored=True, n_docs=st["n_docs"], avgdl=st["avgdl"])


def indexable_documents(corpus: DataFrame, path_col: str = "path", text_col: str = "text",
                        max_bytes: int | None = None, include_hidden: bool = False,
                        require_tokens: bool = True, token_pattern: str = TOKEN_PATTERN) -> DataFrame:
    """Keyword filter (A3): not hidden, size within the cap (none by default),
    no NUL byte and, when ``require_tokens``, at least one token. The semantic
    filter (A4) is the same with ``require_tokens=False`` (empty documents kept)."""
    return corpus.filter(is_indexable(corpus, path_col, text_col, max_bytes, include_hidden, require_tokens, token_pattern))


def is_indexable(corpus: DataFrame, path_col: str = "path", text_col: str = "text", max_bytes: int | None = None,
                 include_hidden: bool = False, require_tokens: bool = True, token_pattern: str = TOKEN_PATTERN) -> Column:
    """The condition of :func:`indexable_documents`."""
    text = F.col(text_col)
    cond = ~has_nul(text)
    if max_bytes is not None:
        size = F.col("size") if "size" in corpus.columns else F.octet_length(text)
        cond = (size <= F.lit(max_bytes)) & cond
    if not include_hidden:
        cond = cond & ~is_hidden_path(path_col)
    if require_tokens:
        cond = cond & text.rlike(token_pattern)
    return cond


def doc_tokens(corpus: DataFrame, path_col: str = "path", text_col: str = "text",
               tokenizer=tokenize, max_bytes: int | None = None, token_pattern: str = TOKEN_PATTERN) -> DataFrame:
    """(path, tokens, dl) for indexable documents; narrow, no shuffle.

    ``tokenizer`` is a Column -> ARRAY<STRING> function (J3); the default is
    the built-in ``[A-Za-z0-9_]+`` + lower-case rule. A custom tokenizer should
    come with its own ``token_pattern`` in the index config so stored indexes
    built with another tokenizer are invalidated."""
    docs = spread_small_input(indexable_documents(corpus, path_col, text_col, max_bytes, token_pattern=token_pattern))
    # (An alias of the same name would hide the path's partitioning later.)
    path = F.col("path") if path_col == "path" else F.col(path_col).alias("path")
    return (docs.select(path, F.explode(F.array(tokenizer(F.col(text_col)))).alias("tokens"))
            .where(F.size("tokens") > 0).withColumn("dl", F.size("tokens")))


FORWARD = "path string, dl int, terms array<struct<term:string,tf:int>>"
COUNT_BYTES = 1 << 20
_TOKEN = re.compile(TOKEN_PATTERN.encode())


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term counts of (path, text as UTF-8 bytes), about ``COUNT_BYTES`` of text
    at a time. Tokens are ASCII, and so is lower-casing bytes."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + COUNT_BYTES, side="right")))
            tokens = [_TOKEN.findall(t.lower()) if t else [] for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
            counts = [Counter(t) for t in tokens]
            terms = pa.StructArray.from_arrays([pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string()),
                                                pa.array([n for c in counts for n in c.values()], pa.int32())], names=["term", "tf"])
            rows = pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in tokens], pa.int32()),
                                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, counts)]), pa.int32()), terms)], names=["path", "dl", "terms"])
            yield rows.filter(pc.greater(rows.column(1), 0))
            lo = hi


def build_index(corpus: DataFrame, path_col: str = "path", text_col: str = "text",
                tokenizer=tokenize, check_unique: bool = False, max_bytes: int | None = None,
                token_pattern: str = TOKEN_PATTERN) -> Bm25Index:
    """Lazy index over a corpus; call ``materialize()`` (or ``write``) before
    running several queries on it.

    Tokenising and counting are one narrow pass: over Arrow batches for the
    built-in tokens, else a document's tokens are sorted in its row and counted
    by their run ends. (``explode`` of a one-element array keeps a value from
    being worked out again for each use.)
    """
    if check_unique:   # paths are the document key: two rows of one path would merge
        from quarry.sources.tables import require_unique_paths
        require_unique_paths(corpus, path_col)
    if tokenizer is tokenize and token_pattern == TOKEN_PATTERN:
        docs = spread_small_input(indexable_documents(corpus, path_col, text_col, max_bytes))
        path = F.col(path_col).alias("path")
        return Bm25Index.from_forward(docs.select(path, F.col(text_col).cast("binary").alias("text")).mapInArrow(_count_terms, FORWARD))
    toks = doc_tokens(corpus, path_col, text_col, tokenizer, max_bytes, token_pattern)
    rows = toks.select("path", "dl", F.explode(F.array(F.sort_array("tokens"))).alias("s"))
    new = F.filter(F.sequence(F.lit(0), F.col("dl") - 1),
                   lambda i: (i == 0) | (F.get("s", i) != F.get("s", F.greatest(i - 1, F.lit(0)))))
    rows = rows.select("path", "dl", "s", F.explode(F.array(new)).alias("at"))
    terms = F.transform("at", lambda p, j: F.struct(F.get("s", p).alias("term"),
                                                    (F.coalesce(F.get("at", j + 1), F.col("dl")) - p).alias("tf")))
    return Bm25Index.from_forward(rows.select("path", "dl", terms.alias("terms")))


def with_path_ordinal(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add ``prank``, the 1-based position of each path in path order."""
    return global_ordinal(docs, ["path"], "prank", partitions)


def corpus_stats(doc_stats: DataFrame) -> tuple[Column, Column]:
    """(N, avgdl) as scalar subqueries: one small aggregation job, no join."""
    n = doc_stats.select(F.count(F.lit(1))).scalar()
    avgdl = doc_stats.select(F.avg("dl")).scalar()
    return n, avgdl


def term_stats_of(postings: DataFrame, doc_stats: DataFrame, n_docs: int | None = None) -> DataFrame:
    n = F.lit(n_docs) if n_docs is not None else corpus_stats(doc_stats)[0]
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.withColumn("raw_idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean_idf = raw.select(F.avg("raw_idf")).scalar()
    return raw.select("term", "df", F.when(F.col("raw_idf") < 0, F.lit(EPSILON) * mean_idf)
                      .otherwise(F.col("raw_idf")).alias("idf"))


def query_terms(queries: DataFrame, qid_col: str = "qid", query_col: str = "query",
                tokenizer=tokenize) -> DataFrame:
    """(qid, term, qtf): a query token repeated n times counts n times."""
    return (queries.select(F.col(qid_col).alias("qid"), F.explode(tokenizer(F.col(query_col))).alias("term"))
            .groupBy("qid", "term").agg(F.count(F.lit(1)).cast("int").alias("qtf")))


def bm25_scores(index: Bm25Index, queries: DataFrame, qid_col: str = "qid",
                query_col: str = "query", query_rows: int | None = None, tokenizer=tokenize,
                with_overlap: bool = False) -> DataFrame:
    """(qid, path, score) for every document matching at least one query term;
    ``with_overlap`` adds ``matched``, the number of distinct query terms the
    document holds (same join, same aggregate)."""
    _, avgdl = index.stats()
    qterms = query_terms(queries, qid_col, query_col, tokenizer)
    # The query side is bounded by the query table (counted on the queries
    # alone unless the caller passes the count). It is broadcast so postings
    # stream once without a shuffle on term, and a hot term held by a third of
    # all documents makes no skewed partition.
    n_qterms = query_rows if query_rows is not None else qterms.count()
    # Both joins stream the large side: the counted query terms are the build
    # side against the vocabulary, and the result against the postings.
    stats, postings = index.term_stats.select("term", "idf"), index.postings
    if index.stored:
        buckets, names = _pushed(qterms, n_qterms)
        postings = postings.where(F.col("bucket").isin(buckets)) if buckets else postings.limit(0)
        if names is not None:
            postings, stats = postings.where(F.col("term").isin(names)), stats.where(F.col("term").isin(names))
    qt = bounded_broadcast(bounded_broadcast(qterms, known_rows=n_qterms).join(stats, "term"), known_rows=n_qterms)
    tf = F.col("tf")
    contrib = (F.col("qtf") * F.col("idf") * tf * F.lit(K1 + 1)
               / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / avgdl)))
    aggs = [F.sum(contrib).alias("score")]
    if with_overlap:
        aggs.append(F.count(F.lit(1)).cast("double").alias("matched"))
    return postings.join(qt, "term").groupBy("path", "qid").agg(*aggs)


def _pushed(qterms: DataFrame, n_terms: int) -> tuple[list[int], list[str] | None]:
    """The buckets of the query terms (``TERM_BUCKETS`` at most) and, where they
    are few, the terms themselves, as literals for a stored index's scan."""
    if n_terms <= PUSHED_TERMS:
        rows = qterms.select("term", term_bucket("term").alias("b")).distinct().collect()
        return sorted({r["b"] for r in rows}), sorted(r["term"] for r in rows)
    return sorted(r[0] for r in qterms.select(term_bucket("term")).distinct().collect()), None


def _asked_terms(qterms: DataFrame, n_terms: int, k: int) -> DataFrame | None:
    """The (qid, term, qtf) rows if they and ``k`` rows a query fit a task."""
    if n_terms > RANKED_ROWS or qterms.select("qid").distinct().count() * k > RANKED_ROWS:
        return None
    return bounded_broadcast(qterms, known_rows=n_terms)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """``F.round``: halves of the shortest decimal form go away from zero."""
    scale = 10.0 ** digits
    low = np.floor(x * scale)
    over = x * scale - low
    out = (low + (over > 0.5)) / scale
    for i in zip(*np.nonzero(np.abs(over - 0.5) < 1e-4)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _query_sums(asked: pa.Table, gain: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """A function of forward batches sorted by path that yields (paths, sums):
    per document and query of ``asked`` (q, term, weight) the sum of ``gain(tf,
    dl) * weight`` over the terms they share. Rows of one path are one document."""
    words = asked["term"].combine_chunks().dictionary_encode()
    order = np.argsort(words.indices.to_numpy(), kind="stable")
    q, weight = asked["q"].to_numpy()[order], asked["weight"].to_numpy()[order]
    vocabulary = words.dictionary
    first = np.searchsorted(words.indices.to_numpy()[order], np.arange(len(vocabulary) + 1))
    width = int(q.max()) + 1 if len(q) else 0

    def documents(paths: pa.Array, dl: np.ndarray, terms: pa.Array) -> Iterator[tuple[list, np.ndarray]]:
        starts = np.asarray(terms.offsets) - terms.offsets[0].as_py()
        entries = terms.flatten()
        at = pc.index_in(entries.field("term"), value_set=vocabulary)
        hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        word = at.take(pa.array(hit)).to_numpy()
        doc = np.searchsorted(starts, hit, side="right") - 1
        tf = entries.field("tf").take(pa.array(hit)).to_numpy()
        times = first[word + 1] - first[word]
        part = gain(tf, dl[doc])
        per_doc = np.bincount(doc, weights=times, minlength=len(paths)) + width
        bounds = np.concatenate([[0], np.cumsum(per_doc)])
        lo = 0
        while lo < len(paths):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SCORE_BLOCK, side="right")) - 1)
            a, b = np.searchsorted(doc, [lo, hi])
            n = times[a:b]
            slot = np.repeat(first[word[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows = np.repeat(doc[a:b] - lo, n)
            sums = np.bincount(rows * width + q[slot], weights=np.repeat(part[a:b], n) * weight[slot], minlength=(hi - lo) * width)
            yield paths[lo:hi].to_pylist(), sums.reshape(hi - lo, width)
            lo = hi

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray]]:
        last, held = None, None        # the document at the end, whose rows may go on
        for batch in batches:
            for paths, sums in documents(batch.column(0), batch.column(1).to_numpy(), batch.column(2)):
                new = np.array([p != o for p, o in zip(paths, [last, *paths[:-1]])])
                if last is not None:
                    paths, sums, new = [last, *paths], np.concatenate([held, sums]), np.concatenate([[True], new])
                begins = np.flatnonzero(new)
                if len(begins) < len(paths):
                    sums = np.add.reduceat(sums, begins, axis=0)
                    paths = [paths[i] for i in begins]
                last, held = paths[-1], sums[-1:].copy()
                if len(paths) > 1:
                    yield paths[:-1], sums[:-1]
        if last is not None:
            yield [last], held

    return scan


def _numbered(asked: DataFrame) -> tuple[pa.Table, pa.Array]:
    """The (qid, term, weight) rows with queries numbered, and the queries' ids."""
    rows = asked.toArrow()      # (as many as a broadcast of them would hold)
    ids = rows["qid"].combine_chunks()
    coded = ids.dictionary_encode(null_encoding="encode")
    return pa.table({"q": coded.indices, "term": rows["term"], "weight": rows["weight"].cast(pa.float64())}), coded.dictionary


def _ranked(index: Bm25Index, asked: DataFrame, k: int, digits: int, avgdl: float | None) -> DataFrame:
    """(qid, path, score): each task's ``k`` best documents of every query with a
    score other than 0, ties by path. Without ``avgdl`` a document's score is
    the sum of the weights alone."""
    rows, ids = _numbered(asked)
    qid = asked.schema["qid"].dataType.simpleString()

    def gain(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return np.ones(len(tf)) if avgdl is None else tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * dl / avgdl))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        score = names = None            # (at most k, queries), the best first
        for paths, sums in _query_sums(rows, gain)(batches):
            new = rounded(sums, digits)
            new[new == 0] = -np.inf
            label = np.broadcast_to(np.array(paths, dtype=object)[:, None], new.shape)
            if score is not None:
                new, label = np.concatenate([score, new]), np.concatenate([names, label])
            # (Paths rise from row to row, so a stable order ranks ties by path.)
            top = np.argsort(-new, axis=0, kind="stable")[:k]
            score, names = np.take_along_axis(new, top, axis=0), np.take_along_axis(label, top, axis=0)
        if score is not None:
            at, q = np.nonzero(score > -np.inf)
            yield pa.record_batch([ids.take(pa.array(q)), pa.array(names[at, q], pa.string()), pa.array(score[at, q])], names=["qid", "path", "score"])

    return index.by_path().select("path", "dl", "terms").mapInArrow(best, f"qid {qid}, path string, score double")


def matched_documents(index: Bm25Index, queries: DataFrame, qid_col: str = "qid", query_col: str = "query") -> DataFrame:
    """(qid, matched): how many documents hold a term of the query; queries that
    match none have no row. Paths that several rows have count once."""
    asked = query_terms(queries, qid_col, query_col)
    if index.forward is None or asked.count() > RANKED_ROWS:
        return (index.postings.select("term", "path").join(asked.select("qid", "term"), "term")
                .select("qid", "path").distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("matched")))
    rows, ids = _numbered(asked.select("qid", "term", F.lit(1.0).alias("weight")))
    qid = asked.schema["qid"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            n = np.zeros(len(ids), dtype=np.int64)
            for _, sums in _query_sums(rows, lambda tf, dl: np.ones(len(tf)))(batches):
                n += (sums > 0).sum(axis=0)
            yield pa.record_batch([ids.filter(pa.array(n > 0)), pa.array(n[n > 0])], names=["qid", "matched"])

    return (index.by_path().select("path", "dl", "terms").mapInArrow(count, f"qid {qid}, matched long")
            .groupBy("qid").agg(F.sum("matched").alias("matched")))


FILL_CHUNK = 4096


def leading_paths(index: Bm25Index, n: int) -> DataFrame:
    """(path, prank) of the first ``n`` documents in path order. A literal
    bound: on a stored index (sorted by prank) the filter is pushed into the
    scan and skips all but the first row groups."""
    return index.leading(n)


def _nonzero(scored: DataFrame, digits: int) -> DataFrame:
    return scored.withColumn("score", F.round("score", digits)).filter(F.col("score") != 0)


def bm25_search(corpus_or_index: DataFrame | Bm25Index, queries: DataFrame, k: int = DEFAULT_K,
                qid_col: str = "qid", query_col: str = "query", path_col: str = "path",
                text_col: str = "text", digits: int = 6, tokenizer=tokenize,
                max_bytes: int | None = None) -> DataFrame:
    """Ranked hits ``(qid, path, score, rank)``; at most ``k`` per query,
    over *all* documents (unmatched ones score 0, ties by path).

    1. Score every query, keep the best k non-zero scores per query
       (row_number with a partial limit before the shuffle) and checkpoint
       that list: at most k rows per query.
    2. A query is under-filled when fewer than k of those are positive (zero
       and negative scores rank below all positive ones). Only those queries
       are scored again to get their full non-zero set, which is small unless
       the corpus has negative idf floors.
    3. Their fill is the first ``k - n_pos`` documents by path without a
       non-zero score; those lie among the first ``(k - n_pos) + n_nonzero``
       documents of the path order (``prank``), so an under-filled query reads
       a bounded prefix of the path order instead of pairing with every
       document.

    Scores are rounded to ``digits`` decimals before ranking so that exact
    ties (frequent: equal tf and dl) are ranked by path whatever the order of
    floating-point summation across partitions.
    """
    from quarry.session import cut_lineage
    index = (corpus_or_index if isinstance(corpus_or_index, Bm25Index)
             else build_index(corpus_or_index, path_col, text_col, tokenizer, max_bytes=max_bytes).materialize())
    spark = index.postings.sparkSession
    if k <= 0:  # the reference clamps k to max(0, min(k, N))
        return spark.createDataFrame([], "qid long, path string, score double, rank int")
    q = queries.select(F.col(qid_col).alias("qid"), F.col(query_col).alias("query"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("path"))
    # One count bounds every query-side broadcast below.
    n_terms = query_terms(q, tokenizer=tokenizer).count()
    all_scores = index.best_scores(q, k, digits, n_terms, tokenizer)
    top = cut_lineage(_nonzero(all_scores.select("qid", "path", "score"), digits)
                      .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                      .select("qid", "path", "score"))
    qids = query_terms(q, tokenizer=tokenizer).select("qid").distinct()
    pos = top.groupBy("qid").agg(F.sum(F.when(F.col("score") > 0, 1).otherwise(0)).alias("n_pos"))
    under = (qids.join(pos, "qid", "left").select("qid", F.coalesce("n_pos", F.lit(0)).alias("n_pos"))
             .filter(F.col("n_pos") < k))
    if not under.limit(1).count():
        return (top.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                .select("qid", "path", "score", F.col("rank").cast("int").alias("rank")))
    under_scores = bm25_scores(index, q.join(under.select("qid"), "qid", "left_semi"),
                               query_rows=n_terms, tokenizer=tokenizer)
    taken = _nonzero(under_scores.select("qid", "path", "score"), digits).select("qid", "path")
    n_nonzero = taken.groupBy("qid").agg(F.count(F.lit(1)).alias("n_nonzero"))
    reach = (under.join(n_nonzero, "qid", "left")
             .select("qid", (F.lit(k) - F.col("n_pos")).alias("need"),
                     (F.lit(k) - F.col("n_pos") + F.coalesce("n_nonzero", F.lit(0))).alias("reach")))
    # One small action: the deepest prefix any under-filled query needs.
    max_reach = reach.agg(F.max("reach")).first()[0]
    if not max_reach:
        return (top.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                .select("qid", "path", "score", F.col("rank").cast("int").alias("rank")))
    leading = leading_paths(index, int(max_reach))
    # (qid, prank) slots: at most k per under-filled query plus its own matches.
    # Listed in two steps, so no row holds more than FILL_CHUNK of them.
    slots = (reach.select("qid", "need", "reach", F.explode(F.sequence(F.lit(0), F.floor((F.col("reach") - 1) / FILL_CHUNK))).alias("c"))
             .select("qid", "need", F.explode(F.sequence(F.col("c") * FILL_CHUNK + 1, F.least(F.col("reach"), (F.col("c") + 1) * FILL_CHUNK))).alias("prank")))
    fill = (slots.join(leading, "prank")
            .join(taken, ["qid", "path"], "left_anti")
            .withColumn("fr", F.row_number().over(Window.partitionBy("qid").orderBy("path")))
            .filter(F.col("fr") <= F.col("need"))
            .select("qid", "path", F.lit(0.0).alias("score")))
    return (top.unionByName(fill).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("qid", "path", "score", F.col("rank").cast("int").alias("rank")))


def overlap_search(index: Bm25Index, queries: DataFrame, k: int, qid_col: str = "qid",
                   query_col: str = "query") -> DataFrame:
    """Second, simpler ranking: number of distinct query terms a document
    holds (matched documents only), ties by path; ``(qid, path, score, rank)``."""
    qterms = query_terms(queries, qid_col, query_col)
    n_terms = qterms.count()
    if index.forward is not None and _asked_terms(qterms, n_terms, k) is not None:
        s = _ranked(index, qterms.select("qid", "term", F.lit(1.0).alias("weight")), k, 0, None)
    else:
        s = (index.postings.select("term", "path").join(bounded_broadcast(qterms.select("qid", "term"), known_rows=n_terms), "term")
             .groupBy("path", "qid").agg(F.count(F.lit(1)).cast("double").alias("score")))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("path"))
    return (s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("qid", "path", "score", F.col("rank").cast("int").alias("rank")))
