"""Exact top-k inner-product search with a cover tree on each side.

Rows are dealt into blocks by id hash, queries into query blocks; every pair
of blocks is one group. A group builds a cover tree over its data rows and one
over its queries and walks both together: a pair of nodes is left as soon as
no inner product between their members can reach the worst k-th score of the
query group, by the covering radii:
<q, p> <= <cq, cp> + Rq |cp| + Rp |cq| + Rq Rp. The k best of each block meet
in one ranked list per query, of which Spark keeps k per task.

Scores are integer inner products of floor(scale * x). Defined cases: rows
with a null id, a null vector, or a null or non-finite component take no part;
vectors of another length than the query's are no candidates; a row repeated
with the same vector counts once; a query's own id is never a candidate; fewer
candidates than k give fewer rows; an empty table gives none. Scores beyond 64
bits are cut to the range of a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.llm import jobs

BLOCK_ROWS, QUERY_ROWS, LEAF = 8192, 2048, 48
_LEAST = -np.iinfo(np.int64).max


class Node:
    """A cover-tree node: every descendant lies within ``radius`` of the
    center; ``points`` are the rows held here, ``kids`` the nodes below."""
    __slots__ = ("center", "norm", "radius", "points", "kids")

    def __init__(self, center, radius, points, kids):
        self.center, self.radius, self.points, self.kids = center, radius, points, kids
        self.norm = float(np.sqrt(center @ center))


def build(x: np.ndarray, leaf: int = LEAF) -> Node:
    """Cover tree of the rows of ``x``. A node of scale s has its rows within s
    of its center; its children are centers more than s / 2 apart that cover
    them at s / 2, the center itself first. Children of one row are kept in the
    node itself."""
    return _node(x, np.arange(len(x)), 0, leaf)


def _distance(x: np.ndarray, rows: np.ndarray, center: int) -> np.ndarray:
    diff = x[rows] - x[center]
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def _node(x: np.ndarray, rows: np.ndarray, center: int, leaf: int) -> Node:
    dist = _distance(x, rows, center)
    radius = float(dist.max(initial=0.0))
    if len(rows) <= leaf or radius == 0.0:
        return Node(x[center], radius, rows, [])
    half = 2.0 ** (np.ceil(np.log2(radius)) - 1)
    alone, kids = [], []
    left, near = rows, dist <= half
    at = center
    while True:
        mine = left[near]
        if len(mine) == 1:
            alone.append(mine)
        else:
            kids.append(_node(x, mine, at, leaf))
        left = left[~near]
        if not len(left):
            break
        at = int(left[0])
        near = _distance(x, left, at) <= half
    return Node(x[center], radius, np.concatenate(alone) if alone else rows[:0], kids)


class Search:
    """The k best (score, smaller id first) of each query row."""

    def __init__(self, queries, query_ids, data, data_ids, k):
        self.q, self.qid, self.x, self.ids, self.k = queries, query_ids, data, data_ids, k
        self.score = np.full((len(queries), k), _LEAST, dtype=np.int64)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max, dtype=np.int64)
        self.slack = 1e-9 * (1 + float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1])

    def run(self) -> None:
        if len(self.q) and len(self.x):
            self.visit(build(self.q), build(self.x))

    def rows_of(self, node: Node) -> np.ndarray:
        return np.concatenate([node.points, *[self.rows_of(kid) for kid in node.kids]])

    def reach(self, a: Node, b: Node) -> float:
        return float(a.center @ b.center) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius + self.slack

    def visit(self, a: Node, b: Node) -> None:
        rows = self.rows_of(a)
        if self.reach(a, b) < self.score[rows, -1].min():
            return
        if a.kids and (a.radius > b.radius or not b.kids):
            if len(a.points):
                self.visit(Node(a.center, a.radius, a.points, []), b)
            for kid in a.kids:
                self.visit(kid, b)
            return
        if len(b.points):
            self.offer(rows, b.points)
        for kid in sorted(b.kids, key=lambda kid: -self.reach(a, kid)):
            self.visit(a, kid)

    def offer(self, rows: np.ndarray, points: np.ndarray) -> None:
        """Take the points' scores into the lists of the query rows."""
        scores = (self.q[rows] @ self.x[points].T).astype(np.int64)
        ids = self.ids[points]
        for r, s in zip(rows, scores):
            ok = np.flatnonzero((s >= self.score[r, -1]) & (ids != self.qid[r]))
            if len(ok) > 4 * self.k:
                ok = ok[s[ok] >= np.partition(s[ok], -self.k)[-self.k]]
            if len(ok):
                all_s, all_i = np.concatenate([self.score[r], s[ok]]), np.concatenate([self.found[r], ids[ok]])
                order = np.lexsort((all_i, -all_s))[:self.k]
                self.score[r], self.found[r] = all_s[order], all_i[order]


def _plain(queries, query_ids, data, data_ids, k) -> tuple[list, list, list]:
    """The same with Python's integers, where scores pass 2**53."""
    out_q, out_i, out_s = [], [], []
    for q, qid in zip(queries, query_ids):
        sums = ((sum(int(a) * int(b) for a, b in zip(q, x)), int(i)) for x, i in zip(data, data_ids) if i != qid)
        for s, i in sorted((-min(max(s, _LEAST), -_LEAST), i) for s, i in sums)[:k]:
            out_q.append(int(qid)), out_i.append(i), out_s.append(-s)
    return out_q, out_i, out_s


def _matrix(tab: pa.Table, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (id, vector) rows as ids and floor(scale * x)."""
    ids = tab["vec_id"].to_numpy()
    flat = tab["vector"].combine_chunks().flatten().to_numpy().astype(np.float64)
    x = np.floor(flat.reshape(len(ids), -1) * scale)
    order = np.lexsort((*x.T[:1], ids))
    ids, x = ids[order], x[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)
    return ids[new], x[new]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0,
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of
    every query row with all other rows. ``vectors``: (vec_id, embedding)."""
    jobs.prepare(vectors.sparkSession)
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"),
        F.size("embedding").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    size = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()[0]
    blocks, query_blocks = -(-size["n"] // block_rows) or 1, -(-size["q"] // query_rows) or 1

    def dealt(n: int, salt: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast("int")

    data = rows.withColumn("block", dealt(blocks, "data")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asks = (rows.where("asks").withColumn("ask", dealt(query_blocks, "query"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows or left["dim"][0].as_py() == 0:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        ids, x = _matrix(left, scale)
        qid, q = _matrix(right, scale)
        if float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] >= 2.0 ** 53:
            return pa.table(dict(zip(names, map(lambda v: pa.array(v, pa.int64()), _plain(q, qid, x, ids, k)))))
        search = Search(q, qid, x, ids, k)
        search.run()
        r, c = np.nonzero(search.found != np.iinfo(np.int64).max)
        return pa.table({"query_id": qid[r], "vec_id": search.found[r, c], "score": search.score[r, c]})

    keys = "block", "ask", "dim"
    part = data.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(pair, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
