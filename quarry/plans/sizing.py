"""Plan-shaping helpers: broadcast only behind a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side this library ever hints as broadcast: in rows, for sides of a few
# short columns (ids, terms, numbers), and in bytes, for sides that hold texts.
# Above it the join is left to the planner (sort-merge, AQE may still switch at
# runtime).
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 128 << 20


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      known_rows: int | None = None, known_bytes: int | None = None) -> DataFrame:
    """``broadcast(df)`` if it has at most ``max_rows`` rows (and, where the
    caller says how many bytes it holds, ``BROADCAST_MAX_BYTES``), else ``df``
    unchanged.

    ``known_rows`` skips the count when the caller already knows the size
    (for example a literal list built on the driver). Otherwise the side is
    counted once; callers pass small, cheap-to-count inputs (query or pattern
    tables), never a corpus-sized side.
    """
    if known_bytes is not None and known_bytes > BROADCAST_MAX_BYTES:
        return df
    n = known_rows if known_rows is not None else df.count()
    return F.broadcast(df) if n <= max_rows else df


# Inputs whose estimated size is at most this many bytes are spread over all
# cores before heavy per-row work (tokenising, regex, embedding, parsing).
# Small tables often come as one Parquet row group, i.e. one scan task; a
# round-robin shuffle of at most this size buys the missing parallelism. Large
# inputs keep the scan's own partitioning (one task per file split) and are
# never shuffled here.
SPREAD_MAX_BYTES = 512 << 20


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate of ``df`` (None when unavailable)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - no estimate: treat as large
        return None


def spread_small_input(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Round-robin ``df`` over the cluster's cores if it is small, else unchanged."""
    spark = df.sparkSession
    limit = max_bytes if max_bytes is not None else int(
        spark.conf.get("quarry.spread.maxBytes", str(SPREAD_MAX_BYTES)))
    size = estimated_bytes(df)
    if size is None or size > limit:
        return df
    # Planning only: no partition count is asked of ``df`` (with AQE that
    # would run the shuffle stages of its plan).
    from quarry.session import _context
    sc = _context(spark)
    cores = sc.defaultParallelism if sc is not None else int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(cores)
