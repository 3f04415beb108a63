"""Spark helpers of the training-data operators: shared tables between steps,
fixed-size membership bitmaps, and connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.session import ensure_checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and name the checkpoint folder."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-tables/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, which
    cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, name: str = "t") -> DataFrame:
    """The same, in buckets of ``column``: grouping by it needs no shuffle."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    known_as = f"quarry_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(partitions(spark), column).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(known_as)
    return spark.table(known_as)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(left: DataFrame, right: DataFrame, *cols: str) -> Column:
    """Null-safe equality of the named columns of two frames."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


BITMAP_BITS = 23


def bitmap(hashes: DataFrame, col: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of 2**bits bits (1 MB by default, whatever the input) with the
    low bits of every value of a long column set. The distinct bit numbers,
    2**bits at most, are what reaches the driver."""
    rows = hashes.select(F.col(col).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("b")).distinct()
    flags = np.zeros(1 << bits, dtype=bool)
    got = rows.toArrow()["b"].to_numpy()
    flags[got] = True
    return np.packbits(flags)


def in_bitmap(packed: np.ndarray, hashes: np.ndarray, bits: int = BITMAP_BITS) -> np.ndarray:
    """Which hashes may be among those of the bitmap."""
    low = (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (packed[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table (a, b: long).

    Returns (node, root): every node of an edge with the smallest node it
    reaches. Alternates the large-star and small-star steps: in each, a node's
    neighbours are hooked to its smallest neighbour by aggregates and joins, so
    no node list is gathered, and every round's edges are a written table. Ends
    when a round changes nothing.
    """
    cur = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    for _ in range(max_rounds):
        both = cur.select("a", "b").unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = table(large, "cc")
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low2, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(joined.select("a", F.col("m").alias("b")))
        nxt = table(small.where("a <> b").distinct(), "cc")
        left = cur.exceptAll(nxt).limit(1).count() or nxt.exceptAll(cur).limit(1).count()
        cur = nxt
        if not left:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
