"""Relevance evaluation of ranked hits: hits@k, precision@k, recall@k, nDCG@k.

Gain is the relevance grade (linear), discount ``1 / log2(rank + 1)``; the
ideal DCG uses the best ``k`` grades of the query. Metrics are computed per
(qid, k) and averaged per k over all judged queries (queries without hits
count as zeros).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _discount(rank):
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def metrics_from_judged(judged: DataFrame, per_query: DataFrame, ks: list[int],
                        by: list[str] | None = None) -> DataFrame:
    """judged(by..., qid, rank, rel) hits with grades; per_query(by..., qid,
    n_rel, ideal: array<double>) where ``ideal`` holds the query's best grades
    in descending order (at least max(ks)).

    Each hit is repeated once per cut-off k it falls within (explode of the
    literal k list), so no join with a k table is needed."""
    keys = [*(by or []), "qid"]
    klist = F.array(*[F.lit(int(k)) for k in sorted(set(ks))])
    dcg = (judged.select(*keys, "rank", "rel", F.explode(F.filter(klist, lambda k: F.col("rank") <= k)).alias("k"))
           .groupBy(*keys, "k")
           .agg(F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).alias("hits"),
                F.sum(F.col("rel") * _discount(F.col("rank"))).alias("dcg")))
    ideal = (per_query.select(*keys, "n_rel", "ideal", F.explode(klist).alias("k"))
             .select(*keys, "k", "n_rel", F.aggregate(
                 F.transform(F.slice("ideal", 1, F.col("k")), lambda x, i: x * _discount(i + 1)),
                 F.lit(0.0), lambda acc, x: acc + x).alias("idcg")))
    hits = F.coalesce("hits", F.lit(0))
    return ideal.join(dcg, [*keys, "k"], "left").select(
        *keys, "k",
        hits.cast("long").alias("hits"),
        (hits / F.col("k")).alias("precision"),
        F.when(F.col("n_rel") > 0, hits / F.col("n_rel")).otherwise(F.lit(0.0)).alias("recall"),
        F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg"))


def evaluate(hits: DataFrame, qrels: DataFrame, ks: list[int], id_col: str = "id",
             by: list[str] | None = None) -> DataFrame:
    """hits(by..., qid, id, rank) and qrels(qid, id, rel) -> (by..., qid, k,
    hits, precision, recall, ndcg). ``by`` evaluates several rankings of the
    same queries at once (e.g. one per sweep trial).

    The ideal ranking needs only each query's best max(ks) grades: a
    row_number limit per query (partial limit before the shuffle), so a query
    with a huge judged set never lands whole in one task.
    """
    by = by or []
    kmax = max(ks)
    rel = qrels.select("qid", F.col(id_col).alias("_id"), F.col("rel").cast("double").alias("rel"))
    judged = (hits.select(*by, "qid", F.col(id_col).alias("_id"), "rank")
              .join(rel, ["qid", "_id"], "left")
              .select(*by, "qid", "rank", F.coalesce("rel", F.lit(0.0)).alias("rel")))
    w = Window.partitionBy("qid").orderBy(F.desc("rel"))
    top = (rel.filter(F.col("rel") > 0).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= kmax))
    n_rel = rel.filter(F.col("rel") > 0).groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"))
    ideal = top.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(F.col("_r"), F.col("rel")))).alias("_t"))
    per_query = (n_rel.join(ideal, "qid")
                 .select("qid", "n_rel", F.transform("_t", lambda s: s["rel"]).alias("ideal")))
    qids = hits.select(*by, "qid").distinct().join(per_query, "qid", "left").select(
        *by, "qid", F.coalesce("n_rel", F.lit(0)).alias("n_rel"),
        F.coalesce("ideal", F.array().cast("array<double>")).alias("ideal"))
    return metrics_from_judged(judged, qids, ks, by)


def evaluate_same_label(hits: DataFrame, query_labels: DataFrame, item_labels: DataFrame,
                        ks: list[int]) -> DataFrame:
    """Binary relevance "same label as the query" without materialising the
    (query, relevant item) pairs: grades of hits by a join on the item id,
    relevant counts from a per-label count, ideal DCG from that count."""
    kmax = max(ks)
    judged = (hits.join(item_labels.select(F.col("id"), F.col("label").alias("_il")), "id")
              .join(query_labels.select("qid", F.col("label").alias("_ql")), "qid")
              .select("qid", "rank", F.when(F.col("_il") == F.col("_ql"), 1.0).otherwise(0.0).alias("rel")))
    counts = item_labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_rel"))
    per_query = (query_labels.join(counts, "label", "left")
                 .select("qid", F.coalesce("n_rel", F.lit(0)).alias("n_rel"))
                 .withColumn("ideal", F.array_repeat(F.lit(1.0), F.least(F.col("n_rel"), F.lit(kmax)).cast("int"))))
    return metrics_from_judged(judged, per_query, ks)


def mean_metrics(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Average per k (and ``by`` columns) over queries."""
    return per_query.groupBy(*(by or []), "k").agg(F.count(F.lit(1)).alias("queries"),
                                      F.avg("precision").alias("precision"),
                                      F.avg("recall").alias("recall"),
                                      F.avg("ndcg").alias("ndcg"))


def containment_qrels(postings: DataFrame, term_stats: DataFrame, corpus: DataFrame,
                      passages: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(qid, path, rel=1) for every document whose text contains the passage.

    Exact without pairing every passage with every document: an interior
    token of a passage (neither first nor last, so not cut by the passage
    boundary) is a token of any document containing the passage. Each
    passage's rarest interior token (lowest df) is equi-joined with the
    postings to get candidates, which are then verified with ``instr``.
    Passages of fewer than three tokens have no interior token (their boundary
    tokens may be cut inside a document's token): they are searched in every
    indexable text, ``SHORT_BLOCK`` passages per scan. Empty passages judge
    nothing."""
    from quarry.functions.text import tokenize
    from quarry.plans.sizing import bounded_broadcast
    from quarry.operators.bm25 import indexable_documents
    passages = passages.filter("qid is not null and text <> ''")
    counted = passages.select("qid", "text", tokenize("text").alias("t"))
    toks = counted.filter(F.size("t") >= 3)
    plain = corpus.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    short = _short_qrels(indexable_documents(plain), counted.filter(F.size("t") < 3).select("qid", "text"))
    interior = F.slice("t", 2, F.size("t") - 2)
    # Texts are counted in bytes and travel once, by qid.
    held = passages.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0)).alias("b")).first()
    n_passages = held["n"]
    # Interior tokens of the passages (counted), broadcast against the
    # vocabulary-sized term_stats when within the bound.
    interior_terms = toks.select("qid", F.explode(F.array_distinct(interior)).alias("term"))
    cand_terms = bounded_broadcast(interior_terms).join(term_stats.select("term", "df"), "term")
    w = Window.partitionBy("qid").orderBy(F.asc("df"), F.asc("term"))
    key = (cand_terms.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
           .select("qid", "term", "df"))
    # Candidate pairs = sum of the key terms' document frequencies (exact, read
    # from the small key table, no postings scan to count them).
    n_cands = key.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    # One key row per passage: bounded by the (counted) passage table.
    cands = postings.select("term", "path").join(bounded_broadcast(key.drop("df"), known_rows=n_passages), "term")
    # Candidates (a few per passage: the df of its rarest interior token) go
    # to the corpus scan by broadcast when their counted size allows, so the
    # corpus text is never shuffled; above the bound a shuffle join is used.
    docs = corpus.select(F.col(path_col).alias("path"), F.col(text_col).alias("doc"))
    whole = bounded_broadcast(toks.select("qid", F.col("text").alias("passage")), known_rows=n_passages, known_bytes=int(held["b"]))
    found = (docs.join(bounded_broadcast(cands.select("qid", "path"), known_rows=int(n_cands)), "path").join(whole, "qid")
             .filter(F.instr(F.col("doc"), F.col("passage")) > 0)
             .select("qid", "path", F.lit(1).alias("rel")))
    for part in short:
        found = found.unionByName(part)
    return found


SHORT_BLOCK = 10_000
SHORT_BYTES = 1 << 20


def _short_qrels(docs: DataFrame, short: DataFrame) -> list[DataFrame]:
    """One scan of the texts per block of short passages; a scan looks for all of
    them at once in about ``SHORT_BYTES`` of text, and only matches become rows."""
    out, block = [], []
    qid = short.schema["qid"].dataType.simpleString()
    texts = docs.select("path", F.col("text").cast("binary").alias("text"))

    def scan(rows):
        ids = short.sparkSession.createDataFrame([(q,) for q, _ in rows], f"qid {qid}").toArrow()["qid"].combine_chunks()
        find = _finder([bytes(t) for _, t in rows])

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc, passage = find(batch.column(1))
                yield pa.record_batch([ids.take(pa.array(passage)), batch.column(0).take(pa.array(doc)), pa.array(np.ones(len(doc), np.int32))],
                                      names=["qid", "path", "rel"])

        return texts.mapInArrow(hits, f"qid {qid}, path string, rel int")

    for r in short.select("qid", F.col("text").cast("binary").alias("text")).toLocalIterator():
        block.append((r["qid"], r["text"]))
        if len(block) == SHORT_BLOCK:
            out.append(scan(block))
            block = []
    return out + ([scan(block)] if block else [])


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` (1, 2, 4 or 8) bytes at each place as a number."""
    out, have = data.astype(np.uint64), 1
    while have < size:
        out = out[:-have] | out[have:] << np.uint64(8 * have)
        have *= 2
    return out


def _finder(passages: list[bytes]):
    """A function of a binary column that gives (row, passage) of every passage
    that occurs in a row's bytes. Passages are found by their first 1, 2, 4 or 8
    bytes, then compared as a whole."""
    by_size: dict[int, dict[int, list[int]]] = {}
    for i, p in enumerate(passages):
        size = 1 << min(3, len(p).bit_length() - 1)
        by_size.setdefault(size, {}).setdefault(int.from_bytes(p[:size], "little"), []).append(i)
    spread = np.uint64(0x9E3779B97F4A7C15)
    tables = []
    for size, keys in by_size.items():
        known = np.array(sorted(keys), dtype=np.uint64)
        maybe = np.zeros(1 << 16, dtype=bool)
        maybe[known * spread >> np.uint64(48)] = True
        tables.append((size, known, maybe, [keys[int(k)] for k in known]))

    def find(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, b"")
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        rows, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        lo = 0
        while lo < len(texts):
            start = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, start + SHORT_BYTES, side="right")))
            data = np.frombuffer(b"".join(texts.slice(lo, hi - lo).to_pylist()), dtype=np.uint8)
            stop = ends[lo:hi] - start
            for size, known, maybe, owners in tables:
                if len(data) < size:
                    continue
                grams = _grams(data, size)
                at = np.flatnonzero(maybe[grams * spread >> np.uint64(48)])
                key = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
                same = known[key] == grams[at]
                at, key = at[same], key[same]
                order = np.argsort(key, kind="stable")
                at, bounds = at[order], np.searchsorted(key[order], np.arange(len(known) + 1))
                for k in np.flatnonzero(np.diff(bounds)):
                    places = at[bounds[k]:bounds[k + 1]]
                    row = np.searchsorted(stop, places, side="right")
                    for i in owners[k]:
                        p = passages[i]
                        fits = places + len(p) <= stop[row]
                        left, of = places[fits], row[fits]
                        for j in range(size, len(p)):
                            if not len(left):
                                break
                            equal = data[left + j] == p[j]
                            left, of = left[equal], of[equal]
                        found = np.unique(of) + lo
                        rows.append(found)
                        which.append(np.full(len(found), i))
            lo = hi
        return np.concatenate(rows), np.concatenate(which)

    return find
