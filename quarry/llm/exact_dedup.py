"""Exact duplicates through an extendible-hash index on shared files.

The index has an entry per distinct text: its 64-bit key (xxhash64), its place
in the key's chain, the smallest doc_id that has it, its number of copies and
its digest. Keys are cut into buckets by their leading bits. The directory
starts with one bucket; whenever a bucket holds more than ``capacity`` keys it
is split by its next bit, and the directory doubles when a bucket as deep as
the directory itself is split. Which buckets that leaves depends on the counts
of the 2**``MAX_DEPTH`` finest cells alone, so :func:`directory` works it out
from one aggregate of those: a bucket is the shortest prefix with no more than
``capacity`` keys (or ``MAX_DEPTH`` bits).

1. One scan writes (doc_id, key, digest) of every row; rows that repeat all
   three become one with their number.
2. Keys met once are entries as they are. Texts of keys met more often are
   compared byte by byte: grouped by (key, whole text), where every task first
   collapses its own copies, so a text shared by a third of all rows is one row
   per task when it is sent. Texts that share a key without being equal are
   chained behind one another.
3. Each bucket is a range of keys with one owner task, which chains its entries
   and writes the bucket's file, sorted by key.
4. Rows find their entry by bucket, key and digest. Entries of very many copies
   (``HOT_ROWS`` or a 100,000th of all rows, so 100,000 entries at most) are sent
   to the rows; the others meet them at the bucket's owner.

Only DataFrame functions run; keys, entries and members stay in Spark. Defined
cases: null counts as an empty text; white space at the ends counts (as one
space); rows with a null doc_id are grouped like others, and stay only where no
row of the group has an id; of rows that repeat both doc_id and text one stays;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from quarry.llm import jobs

CAPACITY, MAX_DEPTH = 16_384, 16
HOT_ROWS = 1024
#: Keys met more than once that are sent to the tasks (beyond it the texts are
#: shuffled by key).
KEYS_SENT = 500_000
COPIES_LISTED = 10_000


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def cell(key: Column, depth: int = MAX_DEPTH) -> Column:
    """The leading ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth)


def directory(cells: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(cell, bucket, depth) of every used cell, from (cell, n): its bucket and
    the bucket's number of leading bits. Buckets are numbered as in a binary
    heap: 1 is the whole key space, 2b and 2b + 1 are the halves of b."""
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth"))
    bucket = F.expr(f"shiftleft(1L, depth) + shiftrightunsigned(cell, {MAX_DEPTH} - depth)")
    levels = levels.withColumn("bucket", bucket)
    held = levels.groupBy("bucket", "depth").agg(F.sum("n").alias("held"))
    fits = held.where((F.col("held") <= capacity) | (F.col("depth") == MAX_DEPTH)).select("bucket")
    # (2**MAX_DEPTH cells at most, MAX_DEPTH + 1 levels of them.)
    at = levels.join(F.broadcast(fits), "bucket").groupBy("cell").agg(F.min(F.struct("depth", "bucket")).alias("at"))
    return at.select("cell", "at.bucket", "at.depth")


@dataclass
class Index:
    """A stored index: ``entries`` (bucket, key, chain, digest, keep_id, copies)
    in one folder per bucket, and its ``directory``, a row per used cell."""
    path: str
    entries: DataFrame
    directory: DataFrame
    rows: int


def _scan(docs: DataFrame) -> DataFrame:
    text = docs.select("doc_id", normalised(F.col("text")).alias("__text"))
    return text.select("doc_id", F.xxhash64("__text").alias("key"), F.unhex(F.sha2("__text", 256)).alias("digest"))


def _routed(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Rows with a key, with their bucket, null for a cell that no key was in (a
    directory has 65,536 rows at most)."""
    return rows.withColumn("cell", cell(F.col("key"))).join(F.broadcast(slots.select("cell", "bucket")), "cell", "left").drop("cell")


def build(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> tuple[Index, DataFrame]:
    """The index of the texts of (doc_id, text), and (doc_id, key, digest,
    times): the rows it was made from, repeated ones once."""
    spark = docs.sparkSession
    jobs.prepare(spark)
    path = path or jobs.fresh_path(spark, "exact-index")
    rows = jobs.table(_scan(docs).groupBy("doc_id", "key", "digest").agg(F.count("*").alias("times")), "rows")
    keys = jobs.table(rows.groupBy("key").agg(F.sum("times").alias("n"), F.count("*").alias("ids"), F.min("doc_id").alias("doc_id"),
                                              F.min("digest").alias("digest")), "keys")
    slots = jobs.table(directory(keys.groupBy(cell(F.col("key")).alias("cell")).agg(F.count("*").alias("n")), capacity), "slots")

    met = keys.where("n > 1").select("key")
    text = docs.select("doc_id", normalised(F.col("text")).alias("text")).withColumn("key", F.xxhash64("text"))
    some = text.join(F.broadcast(met) if met.count() <= KEYS_SENT else met, "key", "left_semi")
    compared = some.groupBy("key", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies"))
    entries = (compared.select("key", F.unhex(F.sha2("text", 256)).alias("digest"), "keep_id", "copies")
               .unionByName(keys.where("n = 1").select("key", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("copies"))))
    owned = _routed(entries, slots).repartition(jobs.partitions(spark), "bucket")
    chain = F.row_number().over(W.partitionBy("bucket", "key").orderBy("keep_id", "digest"))
    (owned.withColumn("chain", chain).sortWithinPartitions("bucket", "key", "chain")
     .write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/entries"))
    slots.write.parquet(f"{path}/directory")
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]
    return Index(path, _entries(spark, path), spark.read.schema(slots.schema).parquet(f"{path}/directory"), total), rows


def _entries(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema("key long, digest binary, keep_id long, copies long, chain int, bucket long")
            .parquet(f"{path}/entries"))


def lookup(index: Index, rows: DataFrame) -> DataFrame:
    """``rows`` (key, digest and any others) with keep_id and copies of the
    entry of their text; both null where the index lacks the text."""
    several = index.entries.where("copies > 1 or chain > 1").select("bucket", "key", "digest", "keep_id", "copies")
    bound = max(HOT_ROWS, -(-index.rows // 100_000))
    hot = several.where(F.col("copies") >= bound).drop("bucket")
    on = ["key", "digest"]
    warm = rows.join(F.broadcast(hot), on)
    rest = _routed(rows.join(F.broadcast(hot.select(*on)), on, "left_anti"), index.directory)
    parts = jobs.partitions(rows.sparkSession)
    cold = (rest.repartition(parts, "bucket")
            .join(index.entries.where(F.col("copies") < bound).select("bucket", *on, "keep_id", "copies").repartition(parts, "bucket"),
                  ["bucket", *on], "left"))
    names = [*rows.columns, "keep_id", "copies"]
    return warm.select(*names).unionByName(cold.select(*names))


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per document row: doc_id, keep_id (the smallest doc_id with an
    equal text), group_size, kept, text_sha256 (of the normalised text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index, rows = build(docs, capacity)
    found = lookup(index, rows)
    # Repeated rows are listed again, in two steps so that no row holds more
    # than COPIES_LISTED numbers; the first is the one that may stay.
    each = (found.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / COPIES_LISTED))))
            .withColumn("__nth", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(COPIES_LISTED), F.col("times") - F.col("__part") * COPIES_LISTED) - 1))))
    first = (F.col("__part") == 0) & (F.col("__nth") == 0)
    return each.select("doc_id", "keep_id", F.col("copies").alias("group_size"),
                       (first & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"))
