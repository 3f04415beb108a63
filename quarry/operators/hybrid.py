"""Keyword and vector rankings fused exactly, with score thresholds.

An item's fused score is ``w * a + (1 - w) * b``: ``a`` is its BM25 score over
the query's highest, ``b`` its cosine. A side below its threshold counts as 0,
and an item counts if its fused score is positive. Fused scores are cut (not
rounded: products of a weight and a rounded score often end in a half) to
``digits`` decimals; ties are ranked by id.

Neither ranking is cut at a fixed depth. Both lists are read to a depth; items
seen in one list get their score of the other by their key; an item seen in
neither can't exceed the fused score of the two lists' ends. A query is done
when its k-th item is above that bound for every trial; the others are read
deeper, ``GROWTH`` times as deep each round, until they are done or both lists
end. So the fused k best are those of all documents, while most queries read a
short prefix of either list. Trials (weight and thresholds) share the rounds:
the seen items are repeated per trial, the lists are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import bm25
from quarry.operators.vectors import ROUND_DIGITS, vector_search
from quarry.plans.sizing import bounded_broadcast

GROWTH = 4


def _trials(trials: list[tuple[float, float, float]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("trial_id"), F.lit(float(w)).alias("w"), F.lit(float(ta)).alias("ta"),
                                        F.lit(float(tb)).alias("tb")) for i, (w, ta, tb) in enumerate(trials)]))


def cut_digits(score: Column, digits: int) -> Column:
    return F.floor(score * F.lit(10.0 ** digits) + F.lit(0.001)) / F.lit(10.0 ** digits)


def _side(score: Column, least: Column) -> Column:
    return F.when(score >= least, score).otherwise(F.lit(0.0))


def fused_top_k(index: bm25.Bm25Index, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int,
                trials: list[tuple[float, float, float]], depth: int | None = None, digits: int = 6) -> DataFrame:
    """(trial_id, qid, id, score, rank) for every trial (weight of the keyword
    side, its threshold, the vector side's threshold).

    ``index`` and ``vectors`` (id, embedding) hold the same documents by path;
    ``queries`` (qid, query) and ``query_vectors`` (qid, embedding) the same
    queries. A side that is not positive counts as 0."""
    from quarry.session import cut_lineage
    spark = vectors.sparkSession
    if k <= 0:
        raise ValueError(f"topk must be positive, received {k}")
    depth = depth or 2 * k
    if any(not 0 <= w <= 1 for w, _, _ in trials):
        raise ValueError("the weight of the keyword side must lie in 0..1")
    qv = cut_lineage(query_vectors.where("embedding is not null").select("qid", "embedding"))
    names = spark.createDataFrame([], "qid long").unionByName(queries.select("qid")).distinct()
    open_ids = cut_lineage(names)
    left = open_ids.count()
    total = vectors.count()
    out: DataFrame | None = None
    while left:
        asked = queries.join(open_ids, "qid", "left_semi")
        reached = cut_lineage(_keyword_list(index, asked, depth))
        near = cut_lineage(vector_search(vectors, qv.join(open_ids, "qid", "left_semi"), depth).select("qid", "id", F.col("score").alias("b"), "rank"))
        ends = _ends(open_ids, reached, near, depth, total)
        seen = cut_lineage(_both_sides(index, vectors, asked, qv, reached, near))
        top = seen.groupBy("qid").agg(F.max("a").alias("most"))
        # (The highest keyword score is the first of the list, so it is seen.)
        each = (seen.join(top, "qid").select("qid", "id", F.when(F.col("a") > 0, F.col("a") / F.col("most")).otherwise(0.0).alias("a"), "b", _trials(trials).alias("t"))
                .select("qid", "id", F.col("t.trial_id").alias("trial_id"), "t.w", _side(F.col("a"), F.greatest(F.col("t.ta"), F.lit(1e-12))).alias("a"),
                        _side(F.col("b"), F.greatest(F.col("t.tb"), F.lit(1e-12))).alias("b")).where("a > 0 or b > 0"))
        score = cut_digits(F.col("w") * F.col("a") + (F.lit(1.0) - F.col("w")) * F.col("b"), digits)
        rank = F.row_number().over(Window.partitionBy("trial_id", "qid").orderBy(F.desc("score"), F.asc("id")))
        best = cut_lineage(each.select("trial_id", "qid", "id", score.alias("score")).where("score > 0").withColumn("rank", rank.cast("int")).where(F.col("rank") <= k))
        # What an unseen item could reach in each trial, beside the k-th score.
        bound = (ends.join(top, "qid", "left").select("qid", F.when(F.col("a_end") > 0, F.col("a_end") / F.col("most")).otherwise(0.0).alias("a"),
                                                      "b_end", "ended", _trials(trials).alias("t")))
        may = (F.col("t.w") * _side(F.col("a"), F.col("t.ta")) + (F.lit(1.0) - F.col("t.w")) * _side(F.greatest("b_end", F.lit(0.0)), F.col("t.tb")))
        kth = best.where(F.col("rank") == k).select("trial_id", "qid", F.col("score").alias("kth"))
        state = (bound.select("qid", F.col("t.trial_id").alias("trial_id"), may.alias("may"), "ended").join(kth, ["trial_id", "qid"], "left"))
        more = ~F.col("ended") & (F.col("may") > 0) & (F.col("kth").isNull() | (F.col("may") + F.lit(10.0 ** -digits) >= F.col("kth")))
        undone = cut_lineage(state.where(more).select("qid").distinct())
        done = best.join(undone, "qid", "left_anti")
        out = done if out is None else out.unionByName(done)
        open_ids, left = undone, undone.count()
        depth *= GROWTH
    if out is None:
        return spark.createDataFrame([], "trial_id long, qid long, id string, score double, rank int")
    return out.select("trial_id", "qid", "id", "score", "rank")


def _keyword_list(index: bm25.Bm25Index, queries: DataFrame, depth: int) -> DataFrame:
    """(qid, id, a, rank): the ``depth`` best documents with a positive score."""
    hits = bm25.bm25_search(index, queries, k=depth)
    return hits.where("score > 0").select("qid", F.col("path").alias("id"), F.col("score").alias("a"), "rank")


def _ends(qids: DataFrame, keyword: DataFrame, near: DataFrame, depth: int, total: int) -> DataFrame:
    """(qid, a_end, b_end, ended): the last score of each list, 0 where the
    keyword list ended; ended: no document is unseen."""
    a = keyword.groupBy("qid").agg(F.count("*").alias("na"), F.min("a").alias("a_low"))
    b = near.groupBy("qid").agg(F.count("*").alias("nb"), F.min("b").alias("b_low"))
    rows = qids.join(a, "qid", "left").join(b, "qid", "left")
    return rows.select("qid", F.when(F.col("na") >= depth, F.col("a_low")).otherwise(0.0).alias("a_end"),
                       F.when(F.col("nb") >= depth, F.col("b_low")).otherwise(0.0).alias("b_end"),
                       (F.coalesce("nb", F.lit(0)) >= total).alias("ended"))


def _both_sides(index: bm25.Bm25Index, vectors: DataFrame, queries: DataFrame, qv: DataFrame, keyword: DataFrame, near: DataFrame) -> DataFrame:
    """(qid, id, a, b) of every item of either list: the score it lacks is
    worked out for its key alone."""
    both = keyword.select("qid", "id", "a").join(near.select("qid", "id", "b"), ["qid", "id"], "full_outer")
    lack_a = both.where("a is null").select("qid", F.col("id").alias("path"))
    # (Seen items: at most two lists of the round's depth a query.)
    asked = bounded_broadcast(lack_a)
    scores = bm25.bm25_scores(index.of_paths(asked.select("path")), queries).join(asked, ["qid", "path"], "left_semi")
    found_a = scores.select("qid", F.col("path").alias("id"), F.round("score", 6).alias("fa"))
    lack_b = both.where("b is null").select("qid", "id")
    pairs = bounded_broadcast(lack_b).join(vectors.select("id", F.col("embedding").alias("v")), "id").join(qv.withColumnRenamed("embedding", "q"), "qid")
    found_b = pairs.select("qid", "id", F.round(V.cosine("q", "v"), ROUND_DIGITS).alias("fb"))
    return (both.join(found_a, ["qid", "id"], "left").join(found_b, ["qid", "id"], "left")
            .select("qid", "id", F.greatest(F.coalesce("a", "fa", F.lit(0.0)), F.lit(0.0)).alias("a"), F.coalesce("b", "fb", F.lit(0.0)).alias("b")))
