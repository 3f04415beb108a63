"""Incremental refresh of the keyword index and of the vector index.

State = manifest(path, mtime_ns, size, hash, indexed) + index tables + config.
A refresh compares the previous manifest with the current listing (full outer
join on path) by metadata alone:

* ``added``    - only in the current listing,
* ``removed``  - only in the previous manifest,
* ``unchanged`` - same ``mtime_ns`` and ``size`` (or same hash with
  ``compare="hash"``) and its postings are all there (or it has none to have),
* ``repaired`` - unchanged on disk but some of its postings are missing: the
  counts that the postings table holds don't add up to the document's length,
* ``changed``  - anything else.

Texts are read of added, changed and repaired documents only (few of them are
pushed into the scan by path); postings of the others are kept, document
frequencies are updated from the deltas, and a config change (token pattern,
size cap, root) invalidates the whole previous state. The result equals a
rebuild from scratch.

A state is saved as a new version folder, then named by one appended pointer
row: saving to the folder it was read from is safe, and a reader never sees
half a state.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions.text import TOKEN_PATTERN, content_hash, is_hidden_path, tokenize
from quarry.operators import bm25
from quarry.plans.sizing import bounded_broadcast

INDEX_VERSION = 2
TOUCHED = ("added", "changed", "repaired")
PUSHED_PATHS = 1000   # so many touched paths at most are named in the scan's filter
PATH_BYTES = 128      # what a broadcast path takes, about


def default_config(root: str = "", max_file_bytes: int | None = None, token_pattern: str = TOKEN_PATTERN) -> dict:
    return {"version": INDEX_VERSION, "token_pattern": token_pattern, "max_file_bytes": max_file_bytes, "root": root}


@dataclass
class KeywordIndexState:
    manifest: DataFrame
    index: bm25.Bm25Index
    config: dict = field(default_factory=default_config)


def empty_state(spark: SparkSession, config: dict | None = None) -> KeywordIndexState:
    e = bm25.Bm25Index(
        spark.createDataFrame([], "term string, path string, dl int, tf int"),
        spark.createDataFrame([], "path string, dl int, prank long"),
        spark.createDataFrame([], "term string, df long, idf double"),
        spark.createDataFrame([], "path string, dl int"))
    return KeywordIndexState(spark.createDataFrame([], schemas.MANIFEST), e, config or default_config())


def listing(corpus: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Current documents with their stat columns: not hidden, within the cap.
    The text is read only where the corpus has no size column."""
    return listed(corpus, max_bytes).select("path", F.col("mtime_ns").cast("long").alias("mtime_ns"), size_of(corpus).alias("size"))


def size_of(corpus: DataFrame) -> Column:
    return (F.col("size") if "size" in corpus.columns else F.octet_length("text")).cast("long")


def listed(corpus: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """The corpus rows that :func:`listing` lists."""
    docs = corpus.filter(~is_hidden_path("path"))
    return docs if max_bytes is None else docs.filter(size_of(corpus) <= F.lit(max_bytes))


def diff(prev_manifest: DataFrame, current: DataFrame, have_tokens: DataFrame,
         compare: str = "stat") -> DataFrame:
    """(path, status) for the union of both listings."""
    p = prev_manifest.select("path", F.col("mtime_ns").alias("p_mtime"), F.col("size").alias("p_size"),
                             F.col("hash").alias("p_hash"), F.coalesce("indexed", F.lit(True)).alias("p_indexed"),
                             F.lit(True).alias("_p"))
    c = current.select("path", F.col("mtime_ns").alias("c_mtime"), F.col("size").alias("c_size"),
                       *([F.col("hash").alias("c_hash")] if compare == "hash" else []), F.lit(True).alias("_c"))
    t = have_tokens.select("path", F.lit(True).alias("_t"))
    j = p.join(c, "path", "full_outer").join(t, "path", "left")
    if compare == "hash":
        same = F.col("p_hash") == F.col("c_hash")
    elif compare == "stat":
        same = (F.col("p_mtime") == F.col("c_mtime")) & (F.col("p_size") == F.col("c_size"))
    else:
        raise ValueError(f"unknown compare mode {compare}")
    status = (F.when(F.col("_c").isNull(), "removed")
              .when(F.col("_p").isNull(), "added")
              .when(same & (F.col("_t").isNotNull() | ~F.col("p_indexed")), "unchanged")
              .when(same, "repaired")
              .otherwise("changed"))
    return j.select("path", status.alias("status"))


def intact(index: bm25.Bm25Index) -> DataFrame:
    """(path) of the documents whose postings are all there: their counts add
    up to the document's length."""
    held = index.postings.groupBy("path").agg(F.sum("tf").alias("_held"))
    return index.lengths.join(held, "path").where("dl = _held").select("path")


def _term_stats_from_df(df: DataFrame, lengths: DataFrame) -> DataFrame:
    n, _ = bm25.corpus_stats(lengths)
    raw = df.withColumn("raw_idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean_idf = raw.select(F.avg("raw_idf")).scalar()
    return raw.select("term", "df", F.when(F.col("raw_idf") < 0, F.lit(bm25.EPSILON) * mean_idf)
                      .otherwise(F.col("raw_idf")).alias("idf"))


def touched_rows(corpus: DataFrame, changes: DataFrame) -> DataFrame | None:
    """The corpus rows to read again; None if there are none. Few paths become
    a filter of the scan, many a semi-join."""
    touched = changes.filter(F.col("status").isin(*TOUCHED)).select("path")
    first = touched.limit(PUSHED_PATHS + 1).collect()
    if not first:
        return None
    if len(first) <= PUSHED_PATHS:
        return corpus.filter(F.col("path").isin([r["path"] for r in first]))
    # Texts aren't sorted for it and, where the paths may be broadcast, not dealt anew.
    n = touched.count()
    return corpus.join(bounded_broadcast(touched.hint("shuffle_hash"), known_rows=n, known_bytes=n * PATH_BYTES), "path", "left_semi")


def refresh(prev: KeywordIndexState, corpus: DataFrame, config: dict | None = None,
            compare: str = "stat", tokenizer=None) -> tuple[KeywordIndexState, DataFrame]:
    """New state and the change table (path, status) from a full current
    listing. ``config`` holds the size cap and the token pattern that apply;
    ``tokenizer`` (a Column function) replaces the pattern's."""
    from quarry.session import cut_lineage
    spark = corpus.sparkSession
    config = config or default_config()
    if prev.config != config:            # I2: full invalidation
        prev = empty_state(spark, config)
    pattern = config["token_pattern"]
    cur = listing(corpus, config["max_file_bytes"])
    if compare == "hash":
        cur = cur.join(corpus.select("path", content_hash("text").alias("hash")), "path")
    # The change table feeds the fresh build, the dropped postings, the df
    # deltas and the manifest: computed once (one row per path).
    changes = cut_lineage(diff(prev.manifest, cur, intact(prev.index), compare))
    new_docs = touched_rows(corpus, changes)
    fresh = read = None
    if new_docs is not None:
        # One pass tokenises the touched documents, one hashes them.
        built = bm25.build_index(new_docs, tokenizer=tokenizer or (lambda c: tokenize(c, pattern)), token_pattern=pattern)
        fresh = bm25.Bm25Index.from_forward(cut_lineage(built.forward))
        read = cut_lineage(new_docs.select("path", content_hash("text").alias("_hash"))
                           .join(fresh.lengths.select("path", F.lit(True).alias("_t")), "path", "left"))
    return KeywordIndexState(_manifest(prev, cur, changes, read), _apply(prev, changes, fresh), config), changes


def _apply(prev: KeywordIndexState, changes: DataFrame, fresh: bm25.Bm25Index | None) -> bm25.Bm25Index:
    """Index after dropping every non-unchanged path and adding the fresh ones."""
    gone = changes.filter(F.col("status") != "unchanged").select("path")
    if fresh is None and not gone.limit(1).count():
        return prev.index
    old = prev.index.postings.select("term", "path", "dl", "tf")
    postings = old.join(gone, "path", "left_anti").select("term", "path", "dl", "tf")
    lengths = prev.index.lengths.join(gone, "path", "left_anti")
    if changes.filter("status = 'repaired'").limit(1).count():
        # What lost postings had counted can't be told from those left: count anew.
        postings = postings.unionByName(fresh.postings)
        lengths = lengths.unionByName(fresh.lengths)
        return bm25.Bm25Index(postings, None, bm25.term_stats_of(postings, lengths), lengths)
    # Document frequency: previous df - postings dropped + postings added.
    minus = old.join(gone, "path", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("_minus"))
    df = prev.index.term_stats.select("term", "df").join(minus, "term", "full_outer")
    plus = F.lit(0)
    if fresh is not None:
        postings = postings.unionByName(fresh.postings)
        lengths = lengths.unionByName(fresh.lengths)
        df = df.join(fresh.postings.groupBy("term").agg(F.count(F.lit(1)).alias("_plus")), "term", "full_outer")
        plus = F.coalesce("_plus", F.lit(0))
    df = (df.select("term", (F.coalesce("df", F.lit(0)) - F.coalesce("_minus", F.lit(0)) + plus).alias("df"))
          .filter(F.col("df") > 0))
    return bm25.Bm25Index(postings, None, _term_stats_from_df(df, lengths), lengths)


def _manifest(prev: KeywordIndexState, cur: DataFrame, changes: DataFrame, read: DataFrame | None) -> DataFrame:
    names = ("path", "mtime_ns", "size", "hash", "indexed")
    kept = changes.filter("status = 'unchanged'").select("path")
    old = prev.manifest.select("path", "hash", "indexed").join(kept, "path", "left_semi")
    out = cur.select("path", "mtime_ns", "size").join(old, "path").select(*names)
    if read is None:
        return out
    new = cur.select("path", "mtime_ns", "size").join(read, "path")
    return out.unionByName(new.select("path", "mtime_ns", "size", F.col("_hash").alias("hash"), F.col("_t").isNotNull().alias("indexed")))


def changed_flag(changes: DataFrame) -> DataFrame:
    """One row: ``changed`` = any status other than unchanged, plus counts per
    status (``changed_docs`` counts the status ``changed``)."""
    names = {"added": "added", "changed": "changed_docs", "unchanged": "unchanged",
             "removed": "removed", "repaired": "repaired"}
    return changes.agg(
        F.coalesce(F.max(F.col("status") != "unchanged"), F.lit(False)).alias("changed"),
        *[F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(n) for s, n in names.items()])


# ------------------------------------------------------------ stored versions

# What Spark says of files that are missing or are no Parquet files.
_UNREADABLE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER",
               "is not a Parquet file", "CANNOT_MERGE_SCHEMAS")


def or_none(read):
    """The result of ``read``; None where the files are missing or corrupt. Any
    other failure (network, memory, code) is raised."""
    try:
        return read()
    except json.JSONDecodeError:
        return None
    except Exception as exc:  # noqa: BLE001 - sorted by Spark's error condition
        if any(word in str(exc) for word in _UNREADABLE):
            return None
        raise


def current_version(spark: SparkSession, base: str) -> str | None:
    """Folder of the version saved last."""
    row = or_none(lambda: spark.read.schema("version string, at long").parquet(f"{base}/current")
                   .orderBy(F.desc("at"), "version").first())
    return f"{base}/{row['version']}" if row is not None else None


def publish(spark: SparkSession, base: str, version: str) -> None:
    (spark.createDataFrame([(version, time.time_ns())], "version string, at long").coalesce(1)
     .write.mode("append").parquet(f"{base}/current"))


def write_state(state: KeywordIndexState, base: str) -> KeywordIndexState:
    """Persist manifest, index tables and config as a new version (A6, A7)."""
    spark = state.manifest.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    folder = f"{base}/{version}"
    state.manifest.write.parquet(f"{folder}/manifest")
    idx = state.index.write(f"{folder}/index", mode="errorifexists")
    (spark.createDataFrame([(json.dumps(state.config, sort_keys=True),)], "config string")
     .write.parquet(f"{folder}/config"))
    publish(spark, base, version)
    return KeywordIndexState(spark.read.schema(schemas.MANIFEST).parquet(f"{folder}/manifest"), idx, state.config)


def read_state(spark: SparkSession, base: str) -> KeywordIndexState:
    """State saved last; a missing or corrupt one (or another format version) is
    the empty state."""
    folder = current_version(spark, base)

    def read():
        cfg = json.loads(spark.read.schema("config string").parquet(f"{folder}/config").first()[0])
        if cfg.get("version") != INDEX_VERSION:
            return None
        manifest = spark.read.schema(schemas.MANIFEST).parquet(f"{folder}/manifest")
        return KeywordIndexState(manifest, bm25.read_index(spark, f"{folder}/index"), cfg)

    state = or_none(read) if folder else None
    return state if state is not None else empty_state(spark)


def drop_old_versions(spark: SparkSession, base: str) -> int:
    """Delete the versions saved before the current one (call it when nothing
    reads them any more); returns their number."""
    from quarry.session import delete_path
    rows = spark.read.schema("version string, at long").parquet(f"{base}/current").orderBy(F.desc("at"), "version").collect()
    return sum(delete_path(spark, f"{base}/{r['version']}") for r in rows[1:])


# ------------------------------------------------------------- vector index

def vector_registry(spark: SparkSession, base: str) -> dict | None:
    """embedder, dimension and version of the stored vector index."""
    folder = current_version(spark, base)
    row = or_none(lambda: spark.read.parquet(f"{folder}/registry").first()) if folder else None
    return row.asDict() if row is not None else None


def ensure_vector_index(spark: SparkSession, base: str, corpus: DataFrame, embedder,
                        path_col: str = "path", text_col: str = "text", max_bytes: int | None = None) -> DataFrame:
    """Build, refresh or reuse (I3, A9): (id, embedding) of the corpus.

    With the same embedder, dimension and format the stored manifest is compared
    with the corpus (mtime and size where it has them, else the content hash);
    only added and changed documents are embedded, removed ones go, and without
    any change the stored vectors are returned as they are. Otherwise, or when
    the stored index is missing or corrupt, everything is embedded."""
    from quarry.operators.semantic import embed_texts
    from quarry.session import cut_lineage
    want = (embedder.name, int(embedder.dimension), INDEX_VERSION)
    docs = bm25.indexable_documents(corpus, path_col, text_col, max_bytes, require_tokens=False)
    by_stat = {"mtime_ns", "size"} <= set(corpus.columns)
    stamp = ((F.col("mtime_ns").cast("string"), F.col("size").cast("string")) if by_stat
             else (content_hash(text_col), F.lit("")))
    now = docs.select(F.col(path_col).alias("path"), F.concat_ws("/", *stamp).alias("stamp"))
    folder = current_version(spark, base)
    reg = vector_registry(spark, base) if folder else None
    kept = stored = None
    if reg is not None and (reg["embedder"], reg["dimension"], reg["version"]) == want:
        stored = or_none(lambda: spark.read.parquet(f"{folder}/vectors"))
    if stored is not None:
        before = spark.read.schema("path string, stamp string").parquet(f"{folder}/manifest")
        change = cut_lineage(before.withColumnRenamed("stamp", "old").join(now, "path", "full_outer")
                             .select("path", F.when(F.col("stamp").isNull(), "removed").when(F.col("old").isNull(), "added")
                                     .when(F.col("old") != F.col("stamp"), "changed").otherwise("unchanged").alias("status"))
                             .filter("status <> 'unchanged'"))
        if not change.limit(1).count():
            return stored
        kept = stored.join(change.select(F.col("path").alias("id")), "id", "left_anti")
        todo = change.filter("status <> 'removed'").select("path")
        docs = docs.join(todo.withColumnRenamed("path", path_col), path_col, "left_semi")
    vecs = embed_texts(docs.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")), embedder, "path", "text")
    version = f"v-{uuid.uuid4().hex}"
    (vecs if kept is None else kept.unionByName(vecs)).write.parquet(f"{base}/{version}/vectors")
    now.write.parquet(f"{base}/{version}/manifest")
    (spark.createDataFrame([want], "embedder string, dimension int, version int")
     .write.parquet(f"{base}/{version}/registry"))
    publish(spark, base, version)
    return spark.read.parquet(f"{base}/{version}/vectors")
