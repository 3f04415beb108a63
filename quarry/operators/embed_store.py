"""Embeddings stored by the content they were computed from.

Vectors belong to a content hash and an embedder, not to a path: a text that
occurs many times is embedded once, a renamed or restored document never again.
A refresh appends one delta of new vectors and writes the list of documents
(path, stamp, hash); the vectors of earlier refreshes stay as they are. Texts
are hashed only where the modification time or size changed (where the corpus
has them), and read again only for hashes that the store lacks.

A version is one JSON row (embedder, deltas) named by an appended pointer row,
so an interrupted refresh leaves nothing but files that no version names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import content_hash
from quarry.operators import bm25
from quarry.operators import index as IX

FORMAT = 1
LISTED = "path string, stamp string, hash string"


def _meta(spark: SparkSession, base: str) -> dict | None:
    folder = IX.current_version(spark, base)
    meta = IX.or_none(lambda: json.loads(spark.read.schema("meta string").parquet(folder).first()[0])) if folder else None
    return meta if meta is not None and meta.get("format") == FORMAT else None


def _deltas(spark: SparkSession, base: str, meta: dict) -> DataFrame:
    kind = "hash string, embedding array<float>, delta string"
    if not meta["deltas"]:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(f"{base}/vectors").where(F.col("delta").isin(meta["deltas"]))


def stored_vectors(spark: SparkSession, base: str) -> DataFrame:
    """(id, embedding) of the documents of the version saved last."""
    meta = _meta(spark, base)
    if meta is None:
        raise FileNotFoundError(f"no embedding store in {base}")
    listed = spark.read.schema(LISTED).parquet(f"{base}/listed/{meta['version']}")
    return listed.select(F.col("path").alias("id"), "hash").join(_deltas(spark, base, meta).select("hash", "embedding"), "hash").select("id", "embedding")


def refresh(spark: SparkSession, base: str, corpus: DataFrame, embedder, max_bytes: int | None = None) -> DataFrame:
    """(id, embedding) of the corpus (path, text, with mtime_ns and size where it
    has them), after embedding the texts that the store lacks. Another embedder
    or dimension starts anew."""
    from quarry.operators.semantic import embed_texts
    from quarry.session import cut_lineage
    name = f"{embedder.name}/{int(embedder.dimension)}"
    meta = _meta(spark, base)
    if meta is None or meta["embedder"] != name:
        meta = {"format": FORMAT, "embedder": name, "deltas": [], "version": None}
    docs = bm25.indexable_documents(corpus, max_bytes=max_bytes, require_tokens=False)
    dated = {"mtime_ns", "size"} <= set(corpus.columns)
    stamp = F.concat_ws("/", F.col("mtime_ns").cast("string"), F.col("size").cast("string")) if dated else F.lit(None).cast("string")
    before = (spark.read.schema(LISTED).parquet(f"{base}/listed/{meta['version']}") if meta["version"]
              else spark.createDataFrame([], LISTED)).where("stamp is not null")
    now = docs.select("path", stamp.alias("stamp"))
    same = now.join(before, ["path", "stamp"]).select("path", "stamp", "hash")
    # (The other documents are read: their hash is worked out.)
    read = docs.withColumn("stamp", stamp).join(same.select("path"), "path", "left_anti").select("path", "stamp", content_hash("text").alias("hash"))
    version = f"v-{uuid.uuid4().hex}"
    same.unionByName(read).write.parquet(f"{base}/listed/{version}")
    listed = spark.read.schema(LISTED).parquet(f"{base}/listed/{version}")
    lack = cut_lineage(listed.select("hash").distinct().join(_deltas(spark, base, meta).select("hash"), "hash", "left_anti"))
    deltas = list(meta["deltas"])
    if lack.limit(1).count():
        # One document for each hash stands for its text.
        chosen = listed.join(lack, "hash", "left_semi").groupBy("hash").agg(F.min("path").alias("path"))
        texts = docs.select("path", "text").join(chosen, "path").select("hash", "text")
        delta = f"d-{uuid.uuid4().hex}"
        (embed_texts(texts, embedder, "hash", "text").withColumnRenamed("id", "hash").write.parquet(f"{base}/vectors/delta={delta}"))
        deltas.append(delta)
    meta |= {"deltas": deltas, "version": version}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.parquet(f"{base}/{version}")
    IX.publish(spark, base, version)
    return stored_vectors(spark, base)
