"""Weighted fusion of two rankings per query.

``minmax``: each ranking's scores are scaled to [0, 1] per query
(``(s - min) / (max - min)``, 1.0 when all scores of the query are equal),
then ``w_a * a + w_b * b`` with 0 for a side that does not hold the item.
``rrf``: reciprocal rank fusion ``w_a / (c + rank_a) + w_b / (c + rank_b)``.
Ties are ranked by id; the result is cut at k per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_C = 60


def _minmax(r: DataFrame, name: str) -> DataFrame:
    # Per-query min/max is a partial aggregate (one row per query per task),
    # then joined back on qid; a query with a huge ranking is no hot task.
    mm = r.groupBy("qid").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    return (r.join(mm, "qid")
            .select("qid", "id", F.when(F.col("_hi") > F.col("_lo"),
                                        (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
                    .otherwise(F.lit(1.0)).alias(name)))


def fuse(a: DataFrame, b: DataFrame, k: int, weights: tuple[float, float] = (0.5, 0.5),
         method: str = "minmax", rrf_c: int = RRF_C, digits: int = 6) -> DataFrame:
    """a, b: (qid, id, score, rank) -> (qid, id, score, rank)."""
    wa, wb = float(weights[0]), float(weights[1])
    if method == "minmax":
        na, nb = _minmax(a, "_a"), _minmax(b, "_b")
    elif method == "rrf":
        na = a.select("qid", "id", (F.lit(1.0) / (F.lit(rrf_c) + F.col("rank"))).alias("_a"))
        nb = b.select("qid", "id", (F.lit(1.0) / (F.lit(rrf_c) + F.col("rank"))).alias("_b"))
    else:
        raise ValueError(f"unknown fusion method {method}")
    both = na.join(nb, ["qid", "id"], "full_outer")
    score = F.round(F.lit(wa) * F.coalesce("_a", F.lit(0.0)) + F.lit(wb) * F.coalesce("_b", F.lit(0.0)), digits)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    return (both.select("qid", "id", score.alias("score"))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("qid", "id", "score", F.col("rank").cast("int").alias("rank")))


def fuse_weight_grid(a: DataFrame, b: DataFrame, k: int, weights: list[float],
                     method: str = "minmax", rrf_c: int = RRF_C, digits: int = 6) -> DataFrame:
    """All fusion trials in one plan: (trial_id, w_a, qid, id, score, rank)
    for every weight ``w_a`` in ``weights`` (``w_b = 1 - w_a``). The two
    rankings are normalised and joined once; each joined row is repeated per
    trial by exploding the literal weight list (no join with a trial table)."""
    if method == "minmax":
        na, nb = _minmax(a, "_a"), _minmax(b, "_b")
    elif method == "rrf":
        na = a.select("qid", "id", (F.lit(1.0) / (F.lit(rrf_c) + F.col("rank"))).alias("_a"))
        nb = b.select("qid", "id", (F.lit(1.0) / (F.lit(rrf_c) + F.col("rank"))).alias("_b"))
    else:
        raise ValueError(f"unknown fusion method {method}")
    trials = F.array(*[F.struct(F.lit(i).cast("long").alias("trial_id"), F.lit(float(w)).alias("w_a"))
                       for i, w in enumerate(weights)])
    both = na.join(nb, ["qid", "id"], "full_outer").select(
        "qid", "id", F.coalesce("_a", F.lit(0.0)).alias("_a"), F.coalesce("_b", F.lit(0.0)).alias("_b"),
        F.explode(trials).alias("t"))
    score = F.round(F.col("t.w_a") * F.col("_a") + (F.lit(1.0) - F.col("t.w_a")) * F.col("_b"), digits)
    w = Window.partitionBy("trial_id", "qid").orderBy(F.desc("score"), F.asc("id"))
    return (both.select(F.col("t.trial_id").alias("trial_id"), F.col("t.w_a").alias("w_a"), "qid", "id",
                        score.alias("score"))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("trial_id", "w_a", "qid", "id", "score", F.col("rank").cast("int").alias("rank")))
