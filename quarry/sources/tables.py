"""Corpora and other inputs taken from existing Parquet tables.

A corpus is any DataFrame with ``path`` and ``text`` (or ``content``); a
directory tree (``quarry.sources.files``) is only one way to get one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document_path() -> F.Column:
    """Synthetic relative path of a ``documents`` row: ``lang/source/doc_id.txt``."""
    return F.concat_ws("/", F.col("lang"), F.col("source"),
                       F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a corpus (path, text, size, mtime_ns, doc_id)."""
    return table(spark, sf_dir, "documents").select(
        document_path().alias("path"), "text",
        F.octet_length("text").cast("long").alias("size"),
        F.col("doc_id").cast("long").alias("mtime_ns"),
        "doc_id")


def duplicate_paths(corpus: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, n) for paths that occur more than once (paths are the document
    key); empty for a valid corpus. One aggregate, partial per task."""
    return (corpus.groupBy(F.col(path_col).alias("path")).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def require_unique_paths(corpus: DataFrame, path_col: str = "path") -> None:
    """Fail loudly when a path occurs twice (one small job, nothing collected
    but the first offending path)."""
    dup = duplicate_paths(corpus, path_col).first()
    if dup is not None:
        raise ValueError(f"duplicate path in corpus: {dup['path']} ({dup['n']} rows)")


def read_dimensions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tuning-space document → (baseline one-row frame, dimensions table).

    Missing keys or an empty dimension list fail the job; ``weight`` defaults
    to 1.0.
    """
    doc = spark.read.schema(schemas.TUNING_DOC).option("multiLine", True).json(path)
    ok = F.col("baseline_score").isNotNull() & F.col("dimensions").isNotNull() & (F.size("dimensions") > 0)
    fail = F.raise_error(F.lit("dataset must define baseline_score and at least one dimension"))
    checked = doc.select(F.when(ok, F.col("baseline_score")).otherwise(fail).alias("baseline_score"),
                         F.when(ok, F.col("dimensions")).otherwise(fail).alias("dimensions"))
    baseline = checked.select(F.col("baseline_score").cast("double").alias("baseline_score"))
    dims = checked.select(F.explode("dimensions").alias("d")).select(
        F.col("d.name").alias("name"), F.col("d.low").cast("double").alias("low"),
        F.col("d.high").cast("double").alias("high"), F.col("d.target").cast("double").alias("target"),
        F.coalesce(F.col("d.weight").cast("double"), F.lit(1.0)).alias("weight"))
    return baseline, dims
