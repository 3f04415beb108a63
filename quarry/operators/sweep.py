"""Parameter sweep: score a whole table of candidate trials in one plan.

trials(trial_id, name, value) x dimensions(name, low, high, target, weight)
-> per trial ``baseline + 0.05 + 0.95 * sum(weight * closeness) / sum(weight)``,
where closeness = ``max(0, 1 - min(|value - target| / (high - low), 1))``.
Every trial must set every dimension, each once; a trial that misses or repeats
one, a range with high <= low or a non-positive weight sum is an error; other
names are ignored. ``objective`` replaces the closeness of one dimension by any
Column of value, low, high, target, weight. The best trial must beat the baseline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.sizing import bounded_broadcast

# Fixed value of the objective.
BASE_BONUS = 0.05


def closeness(value: Column, low: Column, high: Column, target: Column, weight: Column) -> Column:
    span = high - low
    checked = F.when(span <= 0, F.raise_error(F.lit("invalid range for dimension"))).otherwise(span)
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.abs(value - target) / checked, F.lit(1.0))) * weight


def sweep(trials: DataFrame, dimensions: DataFrame, baseline: float | Column, objective=closeness) -> DataFrame:
    """(trial_id, score) for every trial. ``objective(value, low, high, target,
    weight)`` is the weighted share a dimension adds."""
    dims = bounded_broadcast(dimensions.select("name", "low", "high", "target", "weight"), max_rows=100_000)
    n_dims = dimensions.select(F.count(F.lit(1))).scalar()
    total_w = dimensions.select(F.sum("weight")).scalar()
    total_w = F.when(total_w <= 0, F.raise_error(F.lit("dimension weights must sum to a positive value"))
                     ).otherwise(total_w)
    base = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
    # A left join keeps the trials without any known parameter for the check.
    known = F.col("weight").isNotNull() & F.col("value").isNotNull()
    share = F.when(known, objective(F.col("value"), F.col("low"), F.col("high"), F.col("target"), F.col("weight")))
    scored = (trials.join(dims, "name", "left")
              .groupBy("trial_id")
              .agg(F.sum(share).alias("weighted"), F.count_if(known).alias("_n"),
                   F.count_distinct(F.when(known, F.col("name"))).alias("_names")))
    return scored.select(
        "trial_id",
        F.when(F.col("_names") != n_dims, F.raise_error(F.lit("trial lacks a value for a dimension")))
         .when(F.col("_n") != n_dims, F.raise_error(F.lit("trial sets a dimension twice")))
         .otherwise(base + F.lit(BASE_BONUS) + F.lit(1 - BASE_BONUS) * F.col("weighted") / total_w)
         .alias("score"))


def best_trial(scores: DataFrame, baseline: float | Column) -> DataFrame:
    """One row: the best trial (highest score; first trial id on ties) and
    whether it beats the baseline. Partial aggregation: one row per task."""
    base = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
    best = scores.agg(F.min(F.struct((-F.col("score")).alias("down"), "trial_id")).alias("b"))
    return best.select(F.col("b.trial_id").alias("trial_id"), (-F.col("b.down")).alias("score"),
                       (-F.col("b.down") > base).alias("beats_baseline"))


def random_trials(spark, dims: list[dict], n_trials: int, seed: int = 42) -> DataFrame:
    """Seeded uniform candidates, generated in parallel: (trial_id, name, value)."""
    base = spark.range(n_trials).withColumnRenamed("id", "trial_id")
    cols = [F.struct(F.lit(d["name"]).alias("name"),
                     (F.lit(float(d["low"])) + F.rand(seed + i) * F.lit(float(d["high"]) - float(d["low"]))).alias("value"))
            for i, d in enumerate(dims)]
    return base.select("trial_id", F.explode(F.array(*cols)).alias("p")).select("trial_id", "p.name", "p.value")
