"""Directory trees listed by Spark jobs, folder by folder.

Each round lists the folders found in the round before (the frontier), one
task per share of them, and writes what it found as a table; the rounds end
when a round found no folder. So neither the listing nor the list of folders
passes through the driver, and a folder of very many entries is streamed by
its task in batches. Local paths are read with the operating system (symbolic
links are dropped and never followed, so nothing outside the root is reached);
any other URI through its own file system, so object stores work as well.

The rows are those of ``files.read_tree``: (path, type, size, mtime_ns,
content), path relative to the root in POSIX form. Contents are read by tasks
that hold about the same number of bytes, after the size cap. What vanished or
cannot be read is skipped; a missing root is an error, ``root-missing``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.files import SCHEMA, TARGET_PARTITION_BYTES

FOLDERS_PER_TASK = 64
BATCH = 8192
_KIND = "path string, type string, size long, mtime_ns long"


def _local(root: str) -> str | None:
    """The root as a path of this machine's file tree; None for other schemes."""
    if root.startswith("file:"):
        return "/" + root[len("file:"):].lstrip("/")
    return root if "://" not in root else None


def _other(root: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(root)


def is_folder(root: str) -> bool:
    local = _local(root)
    if local is not None:
        return os.path.isdir(local)
    from pyarrow import fs
    system, base = _other(root)
    return system.get_file_info(base).type == fs.FileType.Directory


def _entries(root: str, folder: str) -> Iterator[tuple[str, str, int | None, int | None]]:
    """One folder's entries, in the order in which the file system gives them."""
    local = _local(root)
    if local is not None:
        try:
            with os.scandir(os.path.join(local, folder) if folder else local) as found:
                for e in found:
                    try:
                        rel = f"{folder}/{e.name}" if folder else e.name
                        if e.is_symlink():
                            continue
                        if e.is_dir(follow_symlinks=False):
                            yield rel, "directory", None, None
                        elif e.is_file(follow_symlinks=False):
                            st = e.stat(follow_symlinks=False)
                            yield rel, "file", st.st_size, st.st_mtime_ns
                    except OSError:
                        continue
        except OSError:
            return
        return
    from pyarrow import fs
    system, base = _other(root)
    base = base.rstrip("/")
    for e in system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=True)):
        rel = e.path[len(base):].strip("/")
        if e.type == fs.FileType.Directory:
            yield rel, "directory", None, None
        elif e.type == fs.FileType.File:
            yield rel, "file", e.size, e.mtime_ns


def list_folders(spark: SparkSession, root: str) -> DataFrame:
    """(path, type, size, mtime_ns) of everything below ``root``."""
    from quarry.session import cut_lineage, ship_package
    if not is_folder(root):
        raise FileNotFoundError(f"root-missing: {root}")
    ship_package(spark)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for row in _entries(root, folder):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield _batch(rows)
                        rows = []
        yield _batch(rows)

    found = None
    frontier, folders = spark.range(1).select(F.lit("").alias("path")), 1
    while folders:
        tasks = min(-(-folders // FOLDERS_PER_TASK), max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
        here = cut_lineage(frontier.repartition(tasks).mapInArrow(look, _KIND))
        found = here if found is None else found.unionByName(here)
        frontier = here.where("type = 'directory'").select("path")
        folders = frontier.count()
    return found


def _batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))],
                           names=["path", "type", "size", "mtime_ns"])


def read_folders(spark: SparkSession, root: str, content: bool = True, max_bytes: int | None = None) -> DataFrame:
    """The tree below ``root`` as a corpus, folders included."""
    entries = list_folders(spark, root)
    if max_bytes is not None:
        entries = entries.where((F.col("type") != "file") | (F.col("size") <= max_bytes))
    if not content:
        return entries.withColumn("content", F.lit(None).cast("binary"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = _local(root)
        system = base = None
        if local is None:
            system, base = _other(root)
        for batch in batches:
            for i, (path, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                data = None
                if kind == "file":
                    try:
                        if local is not None:
                            with open(os.path.join(local, path), "rb") as fh:
                                data = fh.read()
                        else:
                            with system.open_input_stream(f"{base.rstrip('/')}/{path}") as fh:
                                data = fh.read()
                    except OSError:
                        continue
                yield pa.record_batch([*batch.slice(i, 1).columns, pa.array([data], pa.binary())],
                                      names=["path", "type", "size", "mtime_ns", "content"])

    total = entries.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    tasks = max(1, -(-total["b"] // TARGET_PARTITION_BYTES), -(-total["n"] // 20_000))
    return entries.repartition(tasks).mapInArrow(load, SCHEMA)
