"""Directory trees as corpora: a Python Data Source (``format("quarry_files")``).

Rows: ``(path, type, size, mtime_ns, content)`` with ``path`` relative to the
root in POSIX form and ``type`` ``file`` or ``directory``. Every entry under
the root is listed (hidden ones and ``__init__.py`` included); symbolic links
and anything resolving outside the root are dropped; entries that cannot be
read are skipped.

The driver lists metadata only and cuts the listing into partitions of
balanced byte size; executors read the bytes. ``size``/``type`` filters are
pushed into the scan (when the session enables Python filter pushdown), so a
size cap keeps large files from being read at all; the ``max_bytes`` option
does the same without relying on pushdown.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from quarry.functions.text import decode_utf8_ignore

FORMAT = "quarry_files"
SCHEMA = "path string, type string, size long, mtime_ns long, content binary"
TARGET_PARTITION_BYTES = 64 << 20
MAX_ENTRIES_PER_PARTITION = 20_000


def _inside(root_real: str, candidate: str) -> str | None:
    """Resolved path if ``candidate`` is no symlink and stays inside the root."""
    try:
        if os.path.islink(candidate):
            return None
        real = os.path.realpath(candidate)
    except OSError:
        return None
    if real != root_real and not real.startswith(root_real.rstrip(os.sep) + os.sep):
        return None
    return real


def list_tree(root: str) -> list[tuple[str, str, int | None, int | None]]:
    """(relative POSIX path, type, size, mtime_ns) for every entry under ``root``."""
    root_real = os.path.realpath(root)
    out = []
    for dirpath, dirnames, filenames in os.walk(root, followlinks=False, onerror=lambda e: None):
        keep_dirs = []
        for name in sorted(dirnames):
            full = os.path.join(dirpath, name)
            real = _inside(root_real, full)
            if real is None:
                continue
            keep_dirs.append(name)
            rel = os.path.relpath(real, root_real).replace(os.sep, "/")
            out.append((rel, "directory", None, None))
        dirnames[:] = keep_dirs
        for name in sorted(filenames):
            full = os.path.join(dirpath, name)
            real = _inside(root_real, full)
            if real is None:
                continue
            try:
                st = os.stat(real)
            except OSError:
                continue
            rel = os.path.relpath(real, root_real).replace(os.sep, "/")
            out.append((rel, "file", st.st_size, st.st_mtime_ns))
    return out


@dataclass
class _Chunk(InputPartition):
    entries: list


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path") or options.get("root")
        if not self.root or not os.path.isdir(self.root):
            raise FileNotFoundError(f"root-missing: {self.root}")
        self.read_content = str(options.get("content", "true")).lower() == "true"
        cap = options.get("max_bytes")
        self.max_bytes = int(cap) if cap is not None else None
        self.types = None     # types the pushed filters leave (None: all)

    def partitions(self):
        entries = []
        for rel, typ, size, mtime in list_tree(self.root):
            if self.types is not None and typ not in self.types:
                continue
            if self.max_bytes is not None and typ == "file" and size > self.max_bytes:
                continue
            entries.append((rel, typ, size, mtime))
        chunks, cur, cur_bytes = [], [], 0
        for e in entries:
            cur.append(e)
            cur_bytes += e[2] or 0
            if cur_bytes >= TARGET_PARTITION_BYTES or len(cur) >= MAX_ENTRIES_PER_PARTITION:
                chunks.append(_Chunk(cur))
                cur, cur_bytes = [], 0
        if cur or not chunks:
            chunks.append(_Chunk(cur))
        return chunks

    def read(self, partition):
        root = self.root
        for rel, typ, size, mtime in partition.entries:
            content = None
            if typ == "file" and self.read_content:
                try:
                    with open(os.path.join(root, rel), "rb") as fh:
                        content = fh.read()
                except OSError:
                    continue      # vanished or unreadable: skipped
            yield (rel, typ, size, mtime, content)


class _PushdownReader(_Reader):
    """Same reader, also taking ``size`` bounds and ``type`` equality from the plan."""

    def _only(self, typ):
        self.types = {typ} if self.types is None else self.types & {typ}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (LessThanOrEqual, LessThan)) and f.attribute == ("size",):
                bound = int(f.value) - (1 if isinstance(f, LessThan) else 0)
                self.max_bytes = bound if self.max_bytes is None else min(self.max_bytes, bound)
                # Directories have a null size; Spark would drop them too.
                self._only("file")
            elif isinstance(f, EqualTo) and f.attribute == ("type",):
                self._only(f.value)
            else:
                yield f


class CorpusFiles(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        if str(self.options.get("pushdown", "false")).lower() == "true":
            return _PushdownReader(self.options)
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CorpusFiles)


def read_tree(spark: SparkSession, root: str, content: bool = True,
              max_bytes: int | None = None) -> DataFrame:
    """Corpus of a directory tree; raises ``FileNotFoundError('root-missing')``."""
    if not os.path.isdir(root):
        raise FileNotFoundError(f"root-missing: {root}")
    register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    r = (spark.read.format(FORMAT).option("path", root).option("content", str(content).lower())
         .option("pushdown", pushdown))
    if max_bytes is not None:
        r = r.option("max_bytes", str(max_bytes))
    return r.load()


def root_id(root: str) -> str:
    """Index location key of a root: hex sha1 of its resolved path (A10)."""
    import hashlib
    return hashlib.sha1(os.path.realpath(root).encode()).hexdigest()


def with_text(corpus: DataFrame) -> DataFrame:
    """Adds ``text``: UTF-8 decoded content with invalid bytes dropped (A5)."""
    return corpus.withColumn("text", decode_utf8_ignore("content"))


def root_status(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Per root: ok flag and ``root-missing`` error (batch form of A2)."""
    from quarry.sources.listing import is_folder
    rows = [(r, is_folder(r)) for r in roots]
    return spark.createDataFrame(rows, "root string, ok boolean").withColumn(
        "error", F.when(~F.col("ok"), F.lit("root-missing")))
