"""Exact vector search over stored pivot partitions, many queries in one plan.

Vectors are stored by the nearest of a bounded number of pivots (a *cell*),
large cells in several chunks, with each chunk's smallest and largest distance
to its pivot. For a query at distance t of a pivot every vector of a chunk is at
least max(t - largest, smallest - t) away, which bounds its score: of vectors no
longer than w, <q, u> <= (|q|^2 + w^2 - distance^2) / 2.

1. Each query is sent to its nearest chunks that hold k vectors together; its
   k-th best score there is its threshold.
2. It is held against every other chunk whose bound reaches the threshold, and
   against no other: those chunks cannot hold one of its k best. Near chunks lie
   together in groups of up to ``CHUNK_BYTES``; a query travels once to a group
   that has chunks for it, which the group's task tells from the bounds again.

Queries are rows: they meet the chunks in a cogroup, in blocks of
``QUERY_ROWS`` (groups: ``GROUP_ROWS``), and only the k best of a query and
chunk or group leave it. So what travels grows with the pairs of a group and a
block, not with those of a query and a chunk. Nothing but
the pivots (``MAX_PIVOTS`` at most) and chunk bounds passes through the driver.
Pivots are fitted on a bounded sample (``SAMPLE`` rows a pivot, by hash of the
id); every vector is indexed, and results are exact whatever the pivots.

Rows and queries without a vector take no part; vectors of another length are
an error. Results equal those of ``vectors.vector_search``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import NORM_EPS, checked_vector

MAX_PIVOTS, SAMPLE, STEPS = 1024, 16, 4
CHUNK_BYTES, CHUNK_ROWS = 16 << 20, 8192
QUERY_ROWS = 4096
#: Most rows of a group of chunks and of a block of its queries, and how many groups a small index has.
GROUP_ROWS, GROUPS = 32768, 16
#: Chunk bounds that are sent to the tasks; more are joined.
CHUNKS_SENT = 200_000
DIGITS = 6


def normalised(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    x = flat.reshape(len(col), -1)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + NORM_EPS)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(sq, 0.0))


def fit_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """``count`` means of the sample: farthest rows first, then a few rounds of
    moving each to the mean of its rows."""
    at = [0]
    near = distances(x, x[:1])[:, 0]
    while len(at) < min(count, len(x)) and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[at[-1:]])[:, 0])
    pivots = x[at].copy()
    for _ in range(STEPS):
        cell = distances(x, pivots).argmin(axis=1)
        size = np.bincount(cell, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, cell, x)
        pivots[size > 0] = sums[size > 0] / size[size > 0, None]
    return pivots


@dataclass
class PivotIndex:
    """``rows`` (cell, chunk, id, embedding) and ``chunks`` (cell, chunk, n,
    low, high, wide): the range of distances to the pivot and the largest norm."""
    rows: DataFrame
    chunks: DataFrame
    pivots: np.ndarray
    dim: int


def build(vectors: DataFrame, path: str, dim: int, id_col: str = "id", vec_col: str = "embedding",
          cells: int | None = None) -> PivotIndex:
    """Write the index of (id, embedding) under ``path``."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), checked_vector(vec_col, dim).alias("embedding"))
    n = rows.count()
    count = max(1, min(MAX_PIVOTS, cells or round(n ** 0.5)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(count * SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    pivots = fit_pivots(normalised(sample), count) if len(sample) else np.zeros((0, dim))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(normalised(batch.column(1)), pivots)
                cell = d.argmin(axis=1)
                norm = np.linalg.norm(normalised(batch.column(1)), axis=1)
                yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell]), pa.array(norm)],
                                      names=["id", "embedding", "cell", "away", "norm"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cell int, away double, norm double"
    folder = f"{path}/v-{uuid.uuid4().hex}"
    rows.mapInArrow(place, schema).write.parquet(f"{folder}/placed")
    placed = spark.read.schema(schema).parquet(f"{folder}/placed")
    most = max(1, min(CHUNK_ROWS, CHUNK_BYTES // (8 * max(dim, 1))))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("pieces"))   # MAX_PIVOTS rows at most
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    chunk = F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("pieces")).cast("int")
    (placed.join(F.broadcast(sizes), "cell").withColumn("chunk", chunk).drop("pieces")
     .repartition(parts, "cell", "chunk").sortWithinPartitions("cell", "chunk").write.parquet(f"{folder}/rows"))
    stored = spark.read.parquet(f"{folder}/rows")
    (stored.groupBy("cell", "chunk").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high"), F.max("norm").alias("wide"))
     .write.parquet(f"{folder}/chunks"))
    return PivotIndex(stored.select("cell", "chunk", "id", "embedding"), spark.read.parquet(f"{folder}/chunks"), pivots, dim)


class PivotSearch:
    """``hits`` (qid, id, score, rank) of a search, and ``pairs`` (qid, cell,
    chunk): which chunks each query was held against."""

    def __init__(self, hits: DataFrame, pairs: DataFrame):
        self.hits, self.pairs = hits, pairs


def search(index: PivotIndex, queries: DataFrame, k: int) -> PivotSearch:
    """The k highest cosines of every query (qid, embedding)."""
    from quarry.session import cut_lineage
    if k <= 0:
        raise ValueError(f"topk must be positive, received {k}")
    spark: SparkSession = queries.sparkSession
    asked = queries.where("embedding is not null").select("qid", checked_vector("embedding", index.dim).alias("embedding"))
    qid = asked.schema["qid"].dataType.simpleString()
    pivots = index.pivots
    table = index.chunks.orderBy("cell", "chunk").toArrow()   # a row per chunk of up to 16 MB of vectors
    cell, chunk, n = (table[c].to_numpy() for c in ("cell", "chunk", "n"))
    low, high, wide = (table[c].to_numpy() for c in ("low", "high", "wide"))
    order, group = _groups(pivots, cell, n, index.dim)
    cell, chunk, n, low, high, wide = (a[order] for a in (cell, chunk, n, low, high, wide))
    firsts = np.flatnonzero(np.diff(group, prepend=-1))
    scale = 10 ** DIGITS

    def parts(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows if len(cell) else 0, 256):
                part = batch.slice(lo, 256)
                x = normalised(part.column(1))
                yield part, x, distances(x, pivots)[:, cell]

    def send(batches, choose):
        for part, x, t in parts(batches):
            row, col = np.nonzero(choose(part, x, t))
            yield pa.record_batch([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                                   pa.array(cell[col].astype(np.int32)), pa.array(chunk[col].astype(np.int32))],
                                  names=["qid", "embedding", "cell", "chunk"])

    def nearest(t: np.ndarray) -> np.ndarray:
        """Which chunks, the nearest pivots' first, hold k vectors together."""
        order = np.argsort(t, axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros(t.shape, dtype=bool)
        np.put_along_axis(first, order, before < k, axis=1)
        return first

    def start(batches):
        return send(batches, lambda part, x, t: nearest(t))

    def others(part, x, t):
        apart = np.maximum(0.0, np.maximum(t - high, low - t))
        reach = ((x * x).sum(axis=1)[:, None] + wide * wide - apart * apart) / 2 * scale + 1
        least = part.column(2).fill_null(np.iinfo(np.int64).min).to_numpy()
        return ~nearest(t) & (reach >= least[:, None])

    def to_groups(batches):
        for part, x, t in parts(batches):
            row, col = np.nonzero(np.logical_or.reduceat(others(part, x, t), firsts, axis=1))
            yield pa.record_batch([*(part.column(c).take(pa.array(row)) for c in range(3)), pa.array(col.astype(np.int32))],
                                  names=["qid", "embedding", "least", "grp"])

    def wanted(part, grp):
        """Which rows of a group's queries are held against which of its chunks."""
        x = normalised(part.column(1))
        mine = group == grp
        return others(part, x, distances(x, pivots)[:, cell])[:, mine], x

    kind = f"qid {qid}, embedding {asked.schema['embedding'].dataType.simpleString()}"
    first = cut_lineage(asked.mapInArrow(start, kind + ", cell int, chunk int"))
    found = cut_lineage(_meet(index, first, k))
    by = Window.partitionBy("qid").orderBy(F.desc("score"))
    least = (found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") == k)
             .select("qid", F.round(F.col("score") * scale).cast("long").alias("least")))
    bounded = asked.join(least, "qid", "left").select("qid", "embedding", "least")
    rest = cut_lineage(bounded.mapInArrow(to_groups, kind + ", least long, grp int"))
    places = spark.createDataFrame([(int(c), int(h), int(g), i) for i, (c, h, g) in enumerate(zip(cell, chunk, group))], "cell int, chunk int, grp int, place int")
    every = found.unionByName(_meet_groups(index, rest, places, wanted, k))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    hits = (every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("qid", "id", "score", F.col("rank").cast("int").alias("rank")))
    pairs = bounded.mapInArrow(lambda b: send(b, others), kind + ", cell int, chunk int")
    return PivotSearch(hits, first.select("qid", "cell", "chunk").unionByName(pairs.select("qid", "cell", "chunk")))


def _groups(pivots: np.ndarray, cell: np.ndarray, n: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the chunks, near cells side by side, and their group in that
    order: stretches of about as many rows as a group may have."""
    if not len(cell):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = distances(pivots, pivots[:2 * GROUPS]).argmin(axis=1)
    order = np.lexsort((cell, near[cell]))
    most = max(1, min(GROUP_ROWS, CHUNK_BYTES // (8 * max(dim, 1)), max(CHUNK_ROWS // 4, int(n.sum()) // GROUPS)))
    return order, np.unique((np.cumsum(n[order]) - n[order]) // most, return_inverse=True)[1]


def _meet_groups(index: PivotIndex, sent: DataFrame, places: DataFrame, wanted, k: int) -> DataFrame:
    """(qid, id, score): the k best of each query among the chunks of the group
    it was sent to that may hold some. ``places`` (cell, chunk, grp, place) lists
    the chunks in the order of ``wanted``'s columns."""
    blocks = sent.groupBy("grp").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("blocks"))
    few = places.join(F.broadcast(blocks), "grp")
    few = F.broadcast(few) if index.chunks.count() <= CHUNKS_SENT else few
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    data = index.rows.join(few, ["cell", "chunk"]).select("grp", "place", "id", "embedding", block)
    asks = (sent.join(F.broadcast(blocks), "grp").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
            .select("grp", "block", "qid", "embedding", "least"))
    qid, vid = sent.schema["qid"].dataType.simpleString(), index.rows.schema["id"].dataType.simpleString()
    scale = 10 ** DIGITS

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, qids = left["id"].combine_chunks(), right["qid"].combine_chunks()
        picked = [(np.zeros(0, np.int64),) * 3]
        if left.num_rows and right.num_rows:
            # By chunk, then by id, which is the order of ties.
            rank = np.empty(len(ids), dtype=np.int64)
            rank[np.argsort(np.array(ids.to_pylist()), kind="stable")] = np.arange(len(ids))
            place = left["place"].to_numpy()
            order = np.lexsort((rank, place))
            rank, bounds = rank[order], np.flatnonzero(np.diff(place[order], prepend=-1, append=-1))
            u = normalised(left["embedding"].combine_chunks())[order]
            asked = right.select(["qid", "embedding", "least"]).combine_chunks().to_batches()[0]
            for lo in range(0, len(qids), 1024):
                part = asked.slice(lo, 1024)
                need, q = wanted(part, right["grp"][0].as_py())
                least = part.column(2).fill_null(np.iinfo(np.int64).min).to_numpy()
                got = [(np.zeros(0, np.int64),) * 3]
                for at, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    rows = np.flatnonzero(need[:, at])
                    if not len(rows):
                        continue
                    s = (q[rows] @ u[a:b].T) * scale
                    row, col = np.nonzero(s >= least[rows, None] - 1)
                    if len(row) > 2 * k * len(rows):
                        whole = np.rint(s).astype(np.int64)
                        best = np.argpartition(-(whole * (b - a) - np.arange(b - a)), min(k, b - a) - 1, axis=1)[:, :k]
                        row, col = np.repeat(np.arange(len(rows)), best.shape[1]), best.ravel()
                    got.append((rows[row], a + col, np.rint(s[row, col]).astype(np.int64)))
                row, col, score = (np.concatenate(x) for x in zip(*got))
                by = np.lexsort((rank[col], -score, row))
                row, col, score = row[by], col[by], score[by]
                head = np.arange(len(row)) - np.searchsorted(row, row) < k
                picked.append((row[head] + lo, order[col[head]], score[head]))
        row, at, score = (np.concatenate(x) for x in zip(*picked))
        return pa.table({"qid": qids.take(pa.array(row)), "id": ids.take(pa.array(at)), "score": pa.array(score / scale, pa.float64())})

    return data.groupBy("grp", "block").cogroup(asks.groupBy("grp", "block")).applyInArrow(pair, f"qid {qid}, id {vid}, score double")


def _meet(index: PivotIndex, sent: DataFrame, k: int) -> DataFrame:
    """(qid, id, score): the k best of each query and the chunk it was sent to."""
    blocks = sent.groupBy("cell", "chunk").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    few = F.broadcast(blocks) if index.chunks.count() <= CHUNKS_SENT else blocks
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    # (Chunks that no query was sent to are left out here.)
    data = index.rows.join(few, ["cell", "chunk"]).select("cell", "chunk", "id", "embedding", block)
    asks = sent.join(few, ["cell", "chunk"]).withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")).drop("blocks")
    qid, vid = sent.schema["qid"].dataType.simpleString(), index.rows.schema["id"].dataType.simpleString()
    scale = 10 ** DIGITS

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"qid": right["qid"].slice(0, 0), "id": left["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        ids = left["id"].combine_chunks()
        order = np.argsort(np.array(ids.to_pylist()), kind="stable")
        u = normalised(left["embedding"].combine_chunks())[order]
        q = normalised(right["embedding"].combine_chunks())
        top = min(k, len(u))
        rows, cols, scores = [], [], []
        for lo in range(0, len(q), 512):
            s = np.rint((q[lo:lo + 512] @ u.T) * scale).astype(np.int64)
            key = s * len(u) - np.arange(len(u))[None, :]     # rows are in id order
            best = np.argpartition(-key, top - 1, axis=1)[:, :top]
            rows.append(np.repeat(np.arange(lo, lo + len(s)), top))
            cols.append(best.ravel())
            scores.append(np.take_along_axis(s, best, axis=1).ravel())
        at = pa.array(order[np.concatenate(cols)])
        return pa.table({"qid": right["qid"].combine_chunks().take(pa.array(np.concatenate(rows))), "id": ids.take(at),
                         "score": pa.array(np.concatenate(scores) / scale)})

    keys = "cell", "chunk", "block"
    return data.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(pair, f"qid {qid}, id {vid}, score double")
