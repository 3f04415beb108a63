"""Row positions without single-partition windows.

``repartitionByRange`` sorts the rows into ranges; the ranges are written once
(Spark samples range bounds anew per evaluation, so they must not be evaluated
twice), rows are numbered inside their range and every range adds the sizes of
the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_ordinal(df: DataFrame, order_cols: list[str], name: str,
                   partitions: int | None = None) -> DataFrame:
    """Add ``name``: the 1-based position of each row in ``order_cols`` order
    (ties keep an arbitrary but fixed order only when the keys are unique)."""
    from quarry.session import cut_lineage
    spark = df.sparkSession
    ranges = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = cut_lineage(df.repartitionByRange(ranges, *order_cols).withColumn("_range", F.spark_partition_id()))
    local = placed.withColumn("_local", F.row_number().over(Window.partitionBy("_range").orderBy(*order_cols)))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # One row per range: a proven bound for the broadcast.
    return (local.join(F.broadcast(before), "_range")
            .select(*df.columns, (F.col("_local") + F.col("_before")).alias(name)))


def group_ordinal(df: DataFrame, group_col: str, order_cols: list[str], name: str,
                  chunk: Column | None = None) -> DataFrame:
    """1-based position within each group by ``order_cols``. ``chunk`` splits a
    large group: an expression of the first order column that never falls as it
    rises (rows are numbered per (group, chunk); chunks add the sizes before)."""
    if chunk is None:
        chunk = F.floor(F.col(order_cols[0]) / 4096)
    df2 = df.withColumn("_chunk", F.coalesce(chunk.cast("long"), F.lit(-(1 << 60))))
    sizes = df2.groupBy(F.col(group_col).alias("_g"), F.col("_chunk").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_g", "_c", F.coalesce(F.sum("_n").over(
        Window.partitionBy("_g").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = df2.withColumn("_local", F.row_number().over(Window.partitionBy(group_col, "_chunk").orderBy(*order_cols)))
    return (local.join(before, F.col(group_col).eqNullSafe(F.col("_g")) & (F.col("_chunk") == F.col("_c")))
            .select(*df.columns, (F.col("_local") + F.col("_before")).alias(name)))
