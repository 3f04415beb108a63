"""Exact vector search: vectors(id, embedding) x queries(qid, embedding) -> top-k.

Queries stream through in blocks of ``QUERY_BLOCK`` vectors, any number of
them; a block is broadcast (its size is fixed), each task multiplies its rows
with it and keeps the k best rows per query, ties by id, and Spark takes the
global top-k per query from those lists (partial + final window limit). With
several blocks the vectors are written once first, so they are never embedded
or computed again, and a block's lists are written before the next is taken.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.vectors import NORM_EPS, checked_vector, l2_norm
from quarry.plans.sizing import spread_small_input

QUERY_BLOCK = 1024
ROW_BLOCK = 2048
ROUND_DIGITS = 6


def build_vectors(df: DataFrame, dim: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, embedding, norm) with every vector checked to have ``dim`` entries."""
    return (df.select(F.col(id_col).alias("id"), checked_vector(vec_col, dim).alias("embedding"))
            .select("id", "embedding", l2_norm("embedding").alias("norm")))


def append_vectors(index: DataFrame, new: DataFrame) -> DataFrame:
    """Append (duplicate ids allowed, as in the reference)."""
    return index.unionByName(new)


def _stored_version(spark, path: str) -> str | None:
    """Folder of the contents saved last; the pointer rows lie in a folder that
    readers of ``path`` itself pass over."""
    from quarry.operators.index import current_version
    named = current_version(spark, f"{path}/_store")
    return f"{path}/version={named.rsplit('/', 1)[1]}" if named else None


def save_vectors(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``overwrite`` replaces the index content, ``append`` adds to it. Each
    content is a version folder named by a pointer row, so an index can be
    loaded, changed and saved to the folder it came from."""
    from quarry.operators.index import publish
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown mode {mode}")
    spark = index.sparkSession
    folder = _stored_version(spark, path) if mode == "append" else None
    if folder:
        index.write.mode("append").parquet(folder)
        return
    version = f"v-{uuid.uuid4().hex}"
    index.write.parquet(f"{path}/version={version}")
    publish(spark, f"{path}/_store", version)


def load_vectors(spark, path: str) -> DataFrame:
    df = spark.read.parquet(_stored_version(spark, path) or path)
    # The id/vector count check of a positional store becomes "no null id or vector".
    return df.withColumn("id", F.when(F.col("id").isNotNull() & F.col("embedding").isNotNull(), F.col("id"))
                         .otherwise(F.raise_error(F.lit("a stored row lacks its id or its vector"))))


def _normalise(mat: np.ndarray) -> np.ndarray:
    return mat / (np.linalg.norm(mat, axis=1, keepdims=True) + NORM_EPS)


def _query_blocks(queries: DataFrame, dim: int) -> Iterator[tuple[list, np.ndarray]]:
    """Blocks of query ids and normalised vectors, one in memory at a time."""
    ids, rows = [], []
    for r in queries.select("qid", "embedding").where("embedding is not null").toLocalIterator():
        if len(r[1]) != dim:
            raise ValueError(f"vector dimension mismatch: expected {dim}")
        ids.append(r[0])
        rows.append(np.asarray(r[1], dtype=np.float64))
        if len(ids) == QUERY_BLOCK:
            yield ids, _normalise(np.array(rows))
            ids, rows = [], []
    if ids:
        yield ids, _normalise(np.array(rows))


class _Local:
    """Stand-in for a broadcast variable on sessions without a SparkContext."""

    def __init__(self, value):
        self.value = value


def _partial_topk_fn(qids, qmat_bc, k: int, dim: int, qid_type, id_type):
    scale = 10 ** ROUND_DIGITS

    def fn(batches):
        qmat = qmat_bc.value
        best_s = best_id = None            # (queries, at most k): rounded scores as integers, ids
        for batch in batches:
            for lo in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(lo, ROW_BLOCK)
                emb = part.column(1)
                offsets = np.asarray(emb.offsets)
                if not np.all(np.diff(offsets) == dim):
                    raise ValueError(f"vector dimension mismatch: expected {dim}")
                flat = np.asarray(emb.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                vec = _normalise(flat[offsets[0]:offsets[-1]].reshape(-1, dim))
                ids = np.array(part.column(0).to_pylist())
                order = np.argsort(ids, kind="stable")
                ids, n = ids[order], len(order)
                score = np.rint((vec[order] @ qmat.T) * scale).astype(np.int64)      # (n, Q) in one BLAS call
                # Rows are in id order: the key ranks by score, then by id.
                key = score * n - np.arange(n)[:, None]
                top = np.argpartition(-key, min(k, n) - 1, axis=0)[:min(k, n)].T
                s, i = np.take_along_axis(score.T, top, axis=1), ids[top]
                if best_s is not None:
                    s, i = np.concatenate([best_s, s], axis=1), np.concatenate([best_id, i], axis=1)
                rank = np.lexsort((i, -s), axis=-1)[:, :k]
                best_s, best_id = np.take_along_axis(s, rank, axis=1), np.take_along_axis(i, rank, axis=1)
        if best_s is not None:
            width = best_s.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([q for q in qids for _ in range(width)], qid_type), pa.array(best_id.ravel().tolist(), id_type),
                 pa.array(best_s.ravel() / scale, pa.float64())], names=["qid", "id", "score"])
    return fn


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, dim: int | None = None,
                  id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(qid, id, score, rank): cosine of normalised vectors, score descending,
    ties by id; at most k per query (fewer when the index is smaller). Rows and
    queries without a vector take no part; one of another length is an error."""
    if k <= 0:
        raise ValueError(f"topk must be positive, received {k}")
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding")).where("embedding is not null")
    if dim is None:
        first = v.select(F.size("embedding")).first()
        if first is None:
            return spark.createDataFrame([], "qid long, id string, score double, rank int")
        dim = int(first[0])
    id_field = v.schema["id"].dataType
    id_arrow = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}.get(
        id_field, pa.string())
    if id_arrow == pa.string() and id_field != T.StringType():
        v = v.withColumn("id", F.col("id").cast("string"))
        id_field = T.StringType()
    from pyspark.sql.pandas.types import to_arrow_type
    from quarry.session import _context, cut_lineage
    qid_field = queries.schema["qid"].dataType
    out_schema = T.StructType([T.StructField("qid", qid_field), T.StructField("id", id_field),
                               T.StructField("score", T.DoubleType())])
    sc = _context(spark)
    source, parts = None, []
    blocks = _query_blocks(queries, dim)
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        several = following is not None or parts
        if source is None:
            source = cut_lineage(v) if several else spread_small_input(v)
        bc = sc.broadcast(block[1]) if sc is not None else _Local(block[1])
        part = source.mapInArrow(_partial_topk_fn(block[0], bc, k, dim, to_arrow_type(qid_field), id_arrow), out_schema)
        if several:
            part = cut_lineage(part)
            if sc is not None:
                bc.destroy()
        parts.append(part)
        block = following
    if not parts:
        return spark.createDataFrame([], out_schema.add("rank", T.IntegerType()))
    partial = parts[0]
    for p in parts[1:]:
        partial = partial.unionByName(p)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    return (partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("qid", "id", "score", F.col("rank").cast("int").alias("rank")))
