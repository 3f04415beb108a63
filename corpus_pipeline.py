"""The corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller
writes it as Parquet and reads it back as the next stage's documents. All but
the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import decontaminate, jobs, minhash_dedup, packing, quality, substring_dedup

#: Words of the shortest passage that counts as a repeat.
REPEAT_WORDS = 50


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the perplexity thresholds reject."""
    own = [c for c in docs.columns if c not in ("doc_id", "lang", "text")]
    held = docs.select("doc_id", "lang", "text", *([F.struct(*own).alias("__own")] if own else []))
    judged = quality.judge(held, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("accepted")
    return judged.select(*[F.col(f"__own.`{c}`").alias(c) if c in own else c for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five-word shingles,
    similarity 0.8) and one of repeated rows; rows without an id stay."""
    kept = minhash_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    first = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every passage of ``REPEAT_WORDS`` or more consecutive words that also
    starts anywhere else out of the texts. Null, empty and shorter texts stay as
    they are, repeated rows repeat each other, no row goes."""
    out = substring_dedup.remove_repeats(docs, replace=True, words=REPEAT_WORDS)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that share ten consecutive words with a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' token ids into sequences of at most 2048. (Workers keep
    fewer encoded words than op6's: executors still hold what earlier stages took.)"""
    return packing.pack_documents(docs, cache_pieces=150_000)


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: The language model has no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    jobs.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = jobs.table(docs, "stage")
    return docs
