"""Vectors as product-quantiser codes: integer k-means per part position, with
LAESA pivots in place of plain scans of the codebooks.

A vector's components become integers floor(scale * x); it is cut into equal
consecutive parts, and each part position has its own codebook. A few entries
of the first codebook, far from each other, are the fixed *pivots* of a
position. One pass writes every part's distances to its pivots next to the
vector. In each round the distances from the pivots to the current entries are
worked out once, and |d(part, pivot) - d(pivot, entry)| is a lower bound of
d(part, entry): the entries of a part are tried in the order of their bounds,
each by its exact integer distance, until the bounds say that no later entry
can be as near (:class:`Codebook`).

A round is one pass over the stored table; what a task emits of it are counts
and component sums of the entries (by 30-bit limbs, so any finite component is
summed exactly), of which one aggregate leaves a bounded number for the driver:
entries x components x limbs, whatever the number of rows. The codebook goes
back to the tasks in the next job's closure.

Defined cases: rows whose vector is null or holds null or non-finite components
are dropped; repeated ids count as rows of their own, but give one first entry
(the smallest of their vectors); null ids come after all others; fewer ids than
entries give smaller codebooks; a vector of another length than the first
entry's, or a length that the parts do not divide, gives no code and no error
(null) and moves no entry; errors and label sums beyond 64 bits are cut to the
range of a long; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm import jobs

PARTS, ENTRIES, ROUNDS, PIVOTS, SCALE = 8, 16, 6, 3, 4096.0
BLOCK = 4096
LIMB = 30
#: Integers up to this size keep squares and sums of a block within 64 bits.
SMALL = 1 << 26
#: Relative error allowed for in a bound of float64 distances.
SLACK = 1e-9
LABELS_SENT = 200_000
_MOST = (1 << 63) - 1


def integers(flat: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or Python's where those could
    overflow later."""
    with np.errstate(over="ignore"):
        x = np.floor(flat.astype(np.float64) * scale)
    if not len(x) or float(np.abs(x).max()) <= SMALL:
        return x.astype(np.int64)
    exact = np.empty(len(x), dtype=object)
    for i, (v, s) in enumerate(zip(flat.astype(np.float64).tolist(), x.tolist())):
        # (A double times the scale may pass the largest double.)
        exact[i] = int(s) if np.isfinite(s) else _floor_product(v, scale)
    return exact


def _floor_product(v: float, scale: float) -> int:
    a, b = v.as_integer_ratio()
    c, d = float(scale).as_integer_ratio()
    return a * c // (b * d)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    diff = x - y
    return (diff * diff).sum(axis=-1)


def roots(sq: np.ndarray) -> np.ndarray:
    """Distances as float64 (infinite beyond its range: such a bound is never used)."""
    if sq.dtype != object:
        return np.sqrt(sq.astype(np.float64))
    return np.array([_root(int(v)) for v in sq.ravel()], dtype=np.float64).reshape(sq.shape)


def _root(v: int) -> float:
    try:
        return float(v) ** 0.5
    except OverflowError:
        return float("inf")


def choose_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows, each the farthest from those before it (the first row first)."""
    rows = [0]
    near = squares(entries, entries[0])
    while len(rows) < min(count, len(entries)):
        rows.append(int(np.argmax(near)))
        near = np.minimum(near, squares(entries, entries[rows[-1]]))
    return entries[rows]


class Codebook:
    """The current entries of one part position and their distances to its pivots."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries, self.pivots = entries, pivots
        self.to_pivots = roots(squares(entries[:, None, :], pivots[None, :, :]))

    def nearest(self, x: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, exact squared distance) of each part, and how many exact
        distances were worked out. ``dist``: the parts' distances to the pivots."""
        n, k = len(x), len(self.entries)
        low = np.zeros((n, k))
        with np.errstate(invalid="ignore"):
            for p in range(len(self.pivots)):
                a, b = dist[:, p, None], self.to_pivots[None, :, p]
                low = np.fmax(low, np.abs(a - b) - SLACK * (a + b))
        low[~np.isfinite(low)] = 0.0
        order = np.argsort(low, axis=1, kind="stable")
        bound = np.take_along_axis(low, order, axis=1)
        entry = order[:, 0].copy()
        best = squares(x, self.entries[entry])
        reach = roots(best) * (1 + SLACK)
        done, rows = n, np.arange(n)
        for j in range(1, k):
            rows = rows[bound[rows, j] <= reach[rows]]
            if not len(rows):
                break
            e = order[rows, j]
            sq = squares(x[rows], self.entries[e])
            done += len(rows)
            better = (sq < best[rows]) | ((sq == best[rows]) & (e < entry[rows]))
            at = rows[better]
            best[at], entry[at] = sq[better], e[better]
            reach[at] = roots(sq[better]) * (1 + SLACK)
        return entry, best, done


def _vectors(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False)


def _limbs(sums: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The signed integers as (power, digits): sum of digits * 2**(LIMB * power),
    every digit but the last within 0..2**LIMB."""
    left, power = sums, 0
    while True:
        if all(-(1 << 62) < int(v) < 1 << 62 for v in left):
            yield power, left.astype(np.int64)
            return
        yield power, (left & ((1 << LIMB) - 1)).astype(np.int64)
        left, power = left >> LIMB, power + 1


class Codes:
    """The result of :func:`compress`: ``rows`` (vec_id, code, error,
    label_error) and the final ``codebooks`` (part, entry, component)."""

    def __init__(self, rows: DataFrame, codebooks: list[np.ndarray], evaluated: DataFrame):
        self.rows, self.codebooks, self.evaluated = rows, codebooks, evaluated

    def sha256(self) -> str:
        text = ",".join(str(int(v)) for book in self.codebooks for v in book.ravel())
        return hashlib.sha256(text.encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: float = SCALE, pivots: int = PIVOTS) -> Codes:
    """Codes of the vectors of (vec_id, embedding, label); see the module."""
    spark = vectors.sparkSession
    jobs.prepare(spark)
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    rows = vectors.where(F.col("embedding").isNotNull() & sound).select("vec_id", "label", "embedding")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label", "embedding"))

    # The first entries: the smallest ids, one vector each.
    ids = rows.select(F.col("vec_id").alias("__id")).distinct().orderBy(F.asc_nulls_last("__id")).limit(entries)
    first = (rows.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("__id"))).groupBy("vec_id")
             .agg(F.min("embedding").alias("embedding")).orderBy(F.asc_nulls_last("vec_id")).collect())
    dim = len(first[0]["embedding"]) if first else 0
    fits = dim % parts == 0
    wide = dim // parts
    start = [v["embedding"] for v in first if len(v["embedding"]) == dim] if fits else []
    grid = (integers(np.array(start, dtype=np.float64).ravel(), scale).reshape(len(start), parts, wide) if start
            else np.zeros((0, parts, wide), np.int64))
    books = [grid[:, p, :] for p in range(parts)]
    fixed = [choose_pivots(b, pivots) for b in books] if start else []
    spots = len(fixed[0]) if fixed else 0

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Blocks of rows with a code, and their integers (row, part, component)."""
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                yield piece, integers(_vectors(piece.column(2)), scale).reshape(piece.num_rows, parts, wide)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in blocks(batches):
            d = np.stack([roots(squares(x[:, p, None, :], fixed[p][None, :, :])) for p in range(parts)], axis=1)
            cells = pa.array(np.ascontiguousarray(d).ravel())
            ends = pa.array(np.arange(piece.num_rows + 1, dtype=np.int32) * (parts * spots))
            yield pa.record_batch([*piece.columns, pa.ListArray.from_arrays(ends, cells)],
                                  names=["vec_id", "label", "embedding", "far"])

    coded = (F.size("embedding") == F.lit(dim)) & F.lit(bool(start))
    kept = jobs.table(rows.where(coded).mapInArrow(measure, kinds + ", far array<double>"), "pivots") if start else None

    def assigned(batches, books):
        """(block, its integers, entries, squared distances, exact evaluations)."""
        current = [Codebook(b, f) for b, f in zip(books, fixed)]
        for piece, x in blocks(batches):
            far = _vectors(piece.column(3)).reshape(piece.num_rows, parts, spots)
            got = [current[p].nearest(x[:, p, :], far[:, p, :]) for p in range(parts)]
            yield piece, x, [g[0] for g in got], [g[1] for g in got], sum(g[2] for g in got)

    def totals(books: list[np.ndarray]):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = len(books[0])
            count = np.zeros((parts, size), np.int64)
            sums = np.zeros((parts, size, wide), dtype=object)
            for _, x, entry, _, _ in assigned(batches, books):
                for p in range(parts):
                    count[p] += np.bincount(entry[p], minlength=size)
                    part = np.zeros((size, wide), dtype=x.dtype)
                    np.add.at(part, entry[p], x[:, p, :])
                    sums[p] += part
            p, e = np.nonzero(count)
            n = len(p)
            yield pa.record_batch([pa.array(p), pa.array(e), pa.array(np.full(n, -1)), pa.array(np.zeros(n, np.int64)), pa.array(count[p, e])],
                                  names=["part", "entry", "at", "power", "total"])
            if n and wide:
                for power, digits in _limbs(sums[p, e].ravel()):
                    yield pa.record_batch([pa.array(np.repeat(p, wide)), pa.array(np.repeat(e, wide)), pa.array(np.tile(np.arange(wide), n)),
                                           pa.array(np.full(n * wide, power)), pa.array(digits)], names=["part", "entry", "at", "power", "total"])
        return add

    for _ in range(rounds if start else 0):
        # (Digits are below 2**62; a decimal holds any number of tasks' sums.)
        found = (kept.mapInArrow(totals(books), "part long, entry long, at long, power long, total long")
                 .groupBy("part", "entry", "at", "power").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))).collect()
        count: dict = {}
        sums: dict = {}
        for r in found:
            if r["at"] < 0:
                count[r["part"], r["entry"]] = int(r["total"])
            else:
                key = r["part"], r["entry"], r["at"]
                sums[key] = sums.get(key, 0) + (int(r["total"]) << (LIMB * r["power"]))
        moved = []
        for p in range(parts):
            book = books[p].astype(object)
            for e in range(len(book)):
                if (p, e) in count:
                    for i in range(wide):
                        book[e, i] = sums.get((p, e, i), 0) // count[p, e]
            small = all(abs(int(v)) <= SMALL for v in book.ravel())
            moved.append(book.astype(np.int64) if small else book)
        books = moved

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _, entry, sq, done in assigned(batches, books):
            total = sum(s.astype(object) for s in sq)
            code = np.stack(entry, axis=1)
            yield pa.record_batch([piece.column(0), piece.column(1), pa.array(["".join(f"{v:02x}" for v in row) for row in code.tolist()]),
                                   pa.array([min(int(t), _MOST) for t in total], pa.int64()),
                                   pa.array([done] + [0] * (piece.num_rows - 1), pa.int64())],
                                  names=["vec_id", "label", "code", "error", "evaluated"])

    head = kinds.rsplit(", ", 1)[0]
    none = rows.where(~coded).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"),
                                     F.lit(0).cast("long").alias("evaluated"))
    out = none if kept is None else kept.mapInArrow(finish, head + ", code string, error long, evaluated long").unionByName(none)
    out = jobs.table(out, "codes")
    # Label sums are aggregated before they meet the rows again; a label of a
    # third of all rows is one row here, and the plain table beside it can be
    # split where they are too many to send.
    by_label = jobs.table(out.groupBy(F.col("label").alias("__label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("__sum")), "labels")
    sent = F.broadcast(by_label) if by_label.count() <= LABELS_SENT else by_label
    joined = out.join(sent, F.col("label").eqNullSafe(F.col("__label")))
    cut = F.when(F.col("__sum") < F.lit(_MOST), F.col("__sum")).when(F.col("__sum").isNotNull(), F.lit(_MOST)).cast("long")
    return Codes(joined.select("vec_id", "code", "error", cut.alias("label_error")), books, out.agg(F.sum("evaluated").alias("n")))
