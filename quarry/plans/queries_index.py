"""Incremental index refresh queries over two snapshots of ``documents``.

Snapshot 1 (previous): every document except source ``src0``.
Snapshot 2 (current): every document except source ``src1``; documents of
language ``de`` were edited (text gets a suffix, mtime moves by one).
So src0 documents are added, src1 removed, de documents changed, the rest
unchanged.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import bm25
from quarry.operators import index as IX
from quarry.plans.catalog import SQL_DOC_PATH, register, sql_tokens
from quarry.session import scratch_path
from quarry.sources.tables import document_path, documents_corpus, table

EDIT_SUFFIX = " revised edition"


def snapshot_prev(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("source") != "src0")
    return d.select(document_path().alias("path"), "text",
                    F.col("doc_id").cast("long").alias("mtime_ns"),
                    F.octet_length("text").cast("long").alias("size"), "lang")


def snapshot_cur(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("source") != "src1")
    edited = F.col("lang") == "de"
    text = F.when(edited, F.concat("text", F.lit(EDIT_SUFFIX))).otherwise(F.col("text"))
    return d.select(document_path().alias("path"), text.alias("text"),
                    (F.col("doc_id") + F.when(edited, 1).otherwise(0)).cast("long").alias("mtime_ns"),
                    F.octet_length(text).cast("long").alias("size"), "lang")


def _refreshed(spark, sf_dir, drop_lang=None):
    """Previous state built from snapshot 1, then refreshed with snapshot 2.

    ``drop_lang`` simulates lost token entries for one language (the
    manifest still lists those documents) to exercise self-repair.
    """
    prev_corpus = snapshot_prev(spark, sf_dir)
    prev = IX.refresh(IX.empty_state(spark), prev_corpus)[0]
    if drop_lang:
        lost = prev_corpus.filter(F.col("lang") == drop_lang).select("path")
        idx = prev.index
        prev = IX.KeywordIndexState(prev.manifest, bm25.Bm25Index(
            idx.postings.join(lost, "path", "left_anti"), None,
            idx.term_stats, idx.lengths.join(lost, "path", "left_anti")), prev.config)
    return IX.refresh(prev, snapshot_cur(spark, sf_dir))


SQL_SNAP = f"""prev AS (SELECT {SQL_DOC_PATH} AS path, CAST(doc_id AS BIGINT) AS mtime_ns,
                    CAST(strlen(text) AS BIGINT) AS size, text, lang FROM documents WHERE source <> 'src0'),
cur AS (SELECT path, mtime_ns, CAST(strlen(text) AS BIGINT) AS size, text, lang FROM (
          SELECT {SQL_DOC_PATH} AS path,
                 CAST(doc_id + CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS BIGINT) AS mtime_ns,
                 CASE WHEN lang = 'de' THEN text || '{EDIT_SUFFIX}' ELSE text END AS text, lang
          FROM documents WHERE source <> 'src1')),
changes AS (
  SELECT coalesce(p.path, c.path) AS path,
         CASE WHEN c.path IS NULL THEN 'removed' WHEN p.path IS NULL THEN 'added'
              WHEN p.mtime_ns = c.mtime_ns AND p.size = c.size THEN 'unchanged' ELSE 'changed' END AS status
  FROM prev p FULL OUTER JOIN cur c ON p.path = c.path)"""


@register("c1_manifest_diff", f"""WITH {SQL_SNAP}
SELECT path, status FROM changes""")
def c1_manifest_diff(spark, sf_dir):
    return _refreshed(spark, sf_dir)[1]


@register("c2_removed_documents", f"""WITH {SQL_SNAP}
SELECT p.path FROM prev p ANTI JOIN cur c ON p.path = c.path""")
def c2_removed_documents(spark, sf_dir):
    prev, cur = snapshot_prev(spark, sf_dir), snapshot_cur(spark, sf_dir)
    return prev.select("path").join(cur.select("path"), "path", "left_anti")


@register("i1_refresh_summary", f"""WITH {SQL_SNAP}
SELECT bool_or(status <> 'unchanged') AS changed,
       CAST(sum(CASE WHEN status = 'added' THEN 1 ELSE 0 END) AS BIGINT) AS added,
       CAST(sum(CASE WHEN status = 'changed' THEN 1 ELSE 0 END) AS BIGINT) AS changed_docs,
       CAST(sum(CASE WHEN status = 'unchanged' THEN 1 ELSE 0 END) AS BIGINT) AS unchanged,
       CAST(sum(CASE WHEN status = 'removed' THEN 1 ELSE 0 END) AS BIGINT) AS removed,
       CAST(0 AS BIGINT) AS repaired
FROM changes""")
def i1_refresh_summary(spark, sf_dir):
    f = IX.changed_flag(_refreshed(spark, sf_dir)[1])
    return f.select("changed", *[F.col(c).cast("long").alias(c) for c in
                                 ("added", "changed_docs", "unchanged", "removed", "repaired")])


SQL_CUR_INDEX = f"""{SQL_SNAP},
toks AS (SELECT path, {sql_tokens('text')} AS tokens FROM cur WHERE regexp_matches(text, '[A-Za-z0-9_]')),
post AS (SELECT term, path, CAST(count(*) AS INTEGER) AS tf
         FROM (SELECT path, unnest(tokens) AS term FROM toks) GROUP BY term, path),
dls AS (SELECT path, len(tokens) AS dl FROM toks),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
tdf AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw_idf FROM tdf, stats),
idf AS (SELECT term, df, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM raw) ELSE raw_idf END AS idf FROM raw)"""


@register("i1_refreshed_postings", f"""WITH {SQL_CUR_INDEX}
SELECT term, path, tf FROM post""")
def i1_refreshed_postings(spark, sf_dir):
    """Postings after the refresh equal postings built from snapshot 2."""
    return _refreshed(spark, sf_dir)[0].index.postings.select("term", "path", "tf")


@register("i1_refreshed_term_stats", f"""WITH {SQL_CUR_INDEX}
SELECT term, df, round(idf, 6) AS idf FROM idf""")
def i1_refreshed_term_stats(spark, sf_dir):
    """df updated from deltas; idf recomputed with the new N."""
    ts = _refreshed(spark, sf_dir)[0].index.term_stats
    return ts.select("term", F.col("df").cast("long").alias("df"), F.round("idf", 6).alias("idf"))


SQL_REFRESHED_BM25 = f"""WITH {SQL_CUR_INDEX},
q AS (SELECT CAST(1 AS BIGINT) AS qid, 'the license of the software' AS query),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({sql_tokens('query')}) AS term FROM q) GROUP BY ALL),
scores AS (SELECT qt.qid, post.path,
                  sum(qtf * idf.idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dls.dl / stats.avgdl))) AS score
           FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dls USING (path), stats GROUP BY ALL),
full_rank AS (SELECT 1::BIGINT AS qid, d.path, round(coalesce(s.score, 0), 6) AS score
              FROM dls d LEFT JOIN scores s ON s.path = d.path)
SELECT qid, path, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS INTEGER) AS rank FROM full_rank)
WHERE rank <= 20"""


@register("i1_refreshed_bm25", SQL_REFRESHED_BM25)
def i1_refreshed_bm25(spark, sf_dir):
    """Searching the refreshed index gives the answers of a fresh build."""
    # A refresh is materialised (checkpointed into the shared checkpoint
    # folder) before it is searched, as a stored index would be.
    idx = _refreshed(spark, sf_dir)[0].index.materialize()
    q = spark.createDataFrame([(1, "the license of the software")], "qid long, query string")
    return bm25.bm25_search(idx, q, k=20)


@register("i1_refresh_in_place", SQL_REFRESHED_BM25)
def i1_refresh_in_place(spark, sf_dir):
    """A stored state read, refreshed, saved to the folder it came from, read
    again and searched."""
    base = scratch_path(spark, "state")
    IX.write_state(IX.refresh(IX.empty_state(spark), snapshot_prev(spark, sf_dir))[0], base)
    IX.write_state(IX.refresh(IX.read_state(spark, base), snapshot_cur(spark, sf_dir))[0], base)
    q = spark.createDataFrame([(1, "the license of the software")], "qid long, query string")
    return bm25.bm25_search(IX.read_state(spark, base).index, q, k=20)


@register("a6_token_store", f"""WITH {SQL_CUR_INDEX}
SELECT term, path, tf FROM post""")
def a6_token_store(spark, sf_dir):
    """Postings written to the store and read back."""
    base = scratch_path(spark, "store")
    return bm25.build_index(snapshot_cur(spark, sf_dir)).write(base).postings.select("term", "path", "tf")


@register("a7_manifest_store", f"""WITH {SQL_SNAP}
SELECT path, mtime_ns, size, sha1(text) AS hash FROM prev""")
def a7_manifest_store(spark, sf_dir):
    """The manifest of a saved state, read back."""
    base = scratch_path(spark, "state")
    IX.write_state(IX.refresh(IX.empty_state(spark), snapshot_prev(spark, sf_dir))[0], base)
    return IX.read_state(spark, base).manifest.select("path", "mtime_ns", "size", "hash")


@register("j3_custom_tokenizer", f"""
SELECT path, term, CAST(count(*) AS INTEGER) AS tf
FROM (SELECT {SQL_DOC_PATH} AS path, unnest(list_filter(string_split(lower(text), ' '), lambda t: t <> '')) AS term FROM documents
      WHERE regexp_matches(text, '[A-Za-z0-9_]')) GROUP BY ALL""")
def j3_custom_tokenizer(spark, sf_dir):
    """Postings of another tokenizer (lower-case, cut at spaces)."""
    by_space = lambda c: F.filter(F.split(F.lower(c), " "), lambda x: x != "")
    return bm25.build_index(documents_corpus(spark, sf_dir), tokenizer=by_space).postings.select("path", "term", "tf")


@register("i1_refreshed_manifest", f"""WITH {SQL_SNAP}
SELECT path, mtime_ns, size, sha1(text) AS hash FROM cur WHERE regexp_matches(text, '[A-Za-z0-9_]')""")
def i1_refreshed_manifest(spark, sf_dir):
    return _refreshed(spark, sf_dir)[0].manifest.select("path", "mtime_ns", "size", "hash")


@register("i4_self_repair", f"""WITH {SQL_SNAP}
SELECT path, CASE WHEN lang = 'de' THEN 'changed' ELSE 'repaired' END AS status
FROM cur WHERE lang IN ('fr', 'de') AND path IN (SELECT path FROM prev)""")
def i4_self_repair(spark, sf_dir):
    """Token entries of French documents lost: they are re-tokenised ("repaired")."""
    changes = _refreshed(spark, sf_dir, drop_lang="fr")[1]
    return changes.filter(F.col("status").isin("repaired", "changed"))


@register("i2_config_invalidation", f"""WITH {SQL_SNAP}
SELECT 'added' AS status, count(*) AS n FROM cur WHERE size <= 2000""")
def i2_config_invalidation(spark, sf_dir):
    """A different size cap invalidates the previous state: every current
    document within the cap is tokenised again (all "added")."""
    prev = IX.refresh(IX.empty_state(spark), snapshot_prev(spark, sf_dir))[0]
    cfg = IX.default_config(max_file_bytes=2000)
    _, changes = IX.refresh(prev, snapshot_cur(spark, sf_dir), config=cfg)
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
