"""Semantic search: embed a corpus with a pluggable embedder, then exact vector search.

An embedder is any object with ``name``, ``dimension`` and
``embed(texts: list[str]) -> array (n, dimension)``. It runs on executors,
about ``EMBED_BYTES`` of text at a time (``mapInArrow``), so the memory of a
worker is that of a block whatever a batch holds; the engine checks every
vector's dimension. ``HashingEmbedder`` is a deterministic, dependency-free embedder
for tests and offline use.
"""

from __future__ import annotations

import hashlib
import re
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.bm25 import indexable_documents
from quarry.operators.vectors import vector_search
from quarry.plans.sizing import spread_small_input

EMBED_BYTES = 1 << 20
_TOKEN = re.compile(r"[A-Za-z0-9_]+")


class Embedder(Protocol):
    name: str
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Token-count features: token -> bucket ``int(sha1(token)[:8], 16) % dimension``."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension
        self.name = f"hashing-sha1-{dimension}"

    def embed(self, texts: list[str]) -> np.ndarray:
        # One hash per different token of the batch, one count per (text, bucket).
        words = [[t.lower() for t in _TOKEN.findall(text or "")] for text in texts]
        bucket = {t: int(hashlib.sha1(t.encode()).hexdigest()[:8], 16) % self.dimension for t in set().union(*words)} if words else {}
        flat = np.array([bucket[t] for w in words for t in w], dtype=np.int64)
        row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        counts = np.bincount(row * self.dimension + flat, minlength=len(texts) * self.dimension)
        return counts.reshape(len(texts), self.dimension).astype(np.float32)


def embed_texts(df: DataFrame, embedder: Embedder, id_col: str, text_col: str) -> DataFrame:
    """(id, embedding ARRAY<FLOAT>) computed on executors, batch by batch."""
    dim = embedder.dimension
    id_field = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_field),
                           T.StructField("embedding", T.ArrayType(T.FloatType(), False))])

    def fn(batches):
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + EMBED_BYTES, side="right")))
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                vecs = np.asarray(embedder.embed(texts), dtype=np.float32)
                if vecs.ndim != 2 or vecs.shape != (len(texts), dim):
                    raise ValueError(f"vector dimension mismatch: expected {dim}, received {vecs.shape}")
                emb = pa.FixedSizeListArray.from_arrays(pa.array(vecs.reshape(-1)), dim).cast(
                    pa.list_(pa.field("item", pa.float32(), nullable=False)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), emb], names=["id", "embedding"])
                lo = hi

    return spread_small_input(df.select(F.col(id_col), F.col(text_col))).mapInArrow(fn, schema)


def semantic_search(corpus: DataFrame | None, queries: DataFrame, embedder: Embedder, k: int,
                    path_col: str = "path", text_col: str = "text",
                    qid_col: str = "qid", query_col: str = "query",
                    vectors: DataFrame | None = None, max_bytes: int | None = None) -> DataFrame:
    """(qid, path, score, rank) over indexable documents (empty ones kept).
    ``vectors`` (id, embedding), for example of ``index.ensure_vector_index``,
    are searched in place of embedding ``corpus`` (which may then be None)."""
    spark = queries.sparkSession
    if k <= 0:   # the tool returns no hits for k <= 0 (the index itself refuses it)
        return spark.createDataFrame([], "qid long, path string, score double, rank int")
    if vectors is None:
        docs = indexable_documents(corpus, path_col, text_col, max_bytes, require_tokens=False)
        vectors = embed_texts(docs.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")),
                              embedder, "path", "text")
    qv = embed_texts(queries.select(F.col(qid_col).alias("qid"), F.col(query_col).alias("query")), embedder, "qid", "query")
    qv = qv.withColumnRenamed("id", "qid")
    hits = vector_search(vectors, qv, k, dim=embedder.dimension)
    return hits.withColumnRenamed("id", "path")
