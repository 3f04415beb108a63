"""Keyword (BM25) queries over ``documents`` with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import content_hash, is_hidden_path, tokenize
from quarry.operators import bm25
from quarry.plans.catalog import SQL_DOC_PATH, register, sql_tokens
from quarry.sources.tables import documents_corpus, duplicate_paths, table

# Query set used by the literal-query entries: a common-word query, a
# two-rare-term query (fewer than k matches, so zero-score documents fill the
# ranking) and one with a repeated token.
KEYWORD_QUERIES = [
    (1, "the license of the software"),
    (2, "achber achkeiten"),
    (3, "token secret key token"),
]


def _queries_df(spark):
    return spark.createDataFrame(KEYWORD_QUERIES, "qid long, query string")


def _sql_values() -> str:
    rows = ", ".join(f"({q}, '{t}')" for q, t in KEYWORD_QUERIES)
    return f"SELECT CAST(qid AS BIGINT) AS qid, query FROM (VALUES {rows}) v(qid, query)"


# DuckDB CTEs computing the same index by brute force.
def sql_index(extra_where: str = "") -> str:
    return f"""
docs AS (
  SELECT * FROM (SELECT {SQL_DOC_PATH} AS path, text FROM documents)
  WHERE NOT contains(text, chr(0))
    AND NOT regexp_matches(path, '(^|/)[.]')
    AND regexp_matches(text, '[A-Za-z0-9_]') {extra_where}),
toks AS (SELECT path, {sql_tokens('text')} AS tokens FROM docs),
dls AS (SELECT path, len(tokens) AS dl FROM toks),
post AS (SELECT term, path, CAST(count(*) AS INTEGER) AS tf
         FROM (SELECT path, unnest(tokens) AS term FROM toks) GROUP BY term, path),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
tdf AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw_idf FROM tdf, stats),
idf AS (SELECT term, df, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM raw)
                          ELSE raw_idf END AS idf FROM raw)"""


SQL_INDEX = sql_index()


def _sql_scores(queries_sql: str) -> str:
    return f"""
q AS ({queries_sql}),
qt AS (SELECT qid, term, count(*) AS qtf
       FROM (SELECT qid, unnest({sql_tokens('query')}) AS term FROM q) GROUP BY qid, term),
scores AS (
  SELECT qt.qid, post.path,
         sum(qtf * idf.idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dls.dl / stats.avgdl))) AS score
  FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dls USING (path), stats
  GROUP BY qt.qid, post.path)"""


def _sql_topk(queries_sql: str, k: int, index_sql: str | None = None) -> str:
    # Brute force: every query against every document, unmatched = 0.
    return f"""WITH {index_sql or SQL_INDEX}, {_sql_scores(queries_sql)},
allq AS (SELECT DISTINCT qid FROM qt),
full_rank AS (
  SELECT a.qid, d.path, round(coalesce(s.score, 0), 6) AS score
  FROM allq a CROSS JOIN dls d LEFT JOIN scores s ON s.qid = a.qid AND s.path = d.path)
SELECT qid, path, score, rank FROM (
  SELECT qid, path, score,
         CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS INTEGER) AS rank
  FROM full_rank) WHERE rank <= {k}"""


def _topk(spark, sf_dir, k, queries=None):
    corpus = documents_corpus(spark, sf_dir)
    return bm25.bm25_search(corpus, queries if queries is not None else _queries_df(spark), k=k)


@register("k3_bm25_topk", _sql_topk(_sql_values(), 10))
def k3_bm25_topk(spark, sf_dir):
    """Flagship: three keyword queries, k=10, over all documents."""
    return _topk(spark, sf_dir, 10)


@register("f3_bm25_topk_ties", _sql_topk(_sql_values(), 50))
def f3_bm25_topk_ties(spark, sf_dir):
    """Default k=50: deep enough that tied scores are ranked by path."""
    return _topk(spark, sf_dir, 50)


@register("c4_zero_score_fill", _sql_topk(_sql_values(), 120))
def c4_zero_score_fill(spark, sf_dir):
    """k above the match count of the rare-term query: zero-score documents fill by path."""
    return _topk(spark, sf_dir, 120)


@register("f5_k_clamp", _sql_topk(_sql_values(), 100000))
def f5_k_clamp(spark, sf_dir):
    """k beyond the corpus size: every document is ranked once per query."""
    return _topk(spark, sf_dir, 100000)


BENCH_QUERIES_SQL = "SELECT item_id AS qid, text AS query FROM benchmark"


@register("e2_bm25_batch_rank", _sql_topk(BENCH_QUERIES_SQL, 5))
def e2_bm25_batch_rank(spark, sf_dir):
    """Every ``benchmark`` passage as a query, top 5 each (rank within query)."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return _topk(spark, sf_dir, 5, q)


@register("d1_term_frequency", f"""WITH {SQL_INDEX}
SELECT post.term, post.path, post.tf, CAST(dls.dl AS INTEGER) AS dl FROM post JOIN dls USING (path)""")
def d1_term_frequency(spark, sf_dir):
    idx = bm25.build_index(documents_corpus(spark, sf_dir))
    return idx.postings.select("term", "path", "tf", F.col("dl").cast("int").alias("dl"))


@register("d2_document_frequency", f"""WITH {SQL_INDEX}
SELECT term, df FROM tdf""")
def d2_document_frequency(spark, sf_dir):
    idx = bm25.build_index(documents_corpus(spark, sf_dir))
    return idx.term_stats.select("term", "df")


@register("d3_corpus_stats", f"""WITH {SQL_INDEX}
SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM tdf) AS n_terms FROM stats""")
def d3_corpus_stats(spark, sf_dir):
    idx = bm25.build_index(documents_corpus(spark, sf_dir))
    n, avgdl = bm25.corpus_stats(idx.lengths)
    n_terms = idx.term_stats.select(F.count(F.lit(1))).scalar()
    return spark.range(1).select(n.alias("n_docs"), F.round(avgdl, 6).alias("avgdl"),
                                 n_terms.alias("n_terms"))


@register("d4_idf_floor", f"""WITH {SQL_INDEX}
SELECT term, round(idf, 6) AS idf FROM idf""")
def d4_idf_floor(spark, sf_dir):
    idx = bm25.build_index(documents_corpus(spark, sf_dir))
    return idx.term_stats.select("term", F.round("idf", 6).alias("idf"))


@register("d5_bm25_scores", f"""WITH {SQL_INDEX}, {_sql_scores(_sql_values())}
SELECT qid, path, round(score, 6) AS score FROM scores""")
def d5_bm25_scores(spark, sf_dir):
    idx = bm25.build_index(documents_corpus(spark, sf_dir))
    return (bm25.bm25_scores(idx, _queries_df(spark))
            .select("qid", "path", F.round("score", 6).alias("score")))


@register("c3_query_terms_postings", f"""WITH {SQL_INDEX},
q AS ({_sql_values()}),
qt AS (SELECT qid, term, count(*) AS qtf
       FROM (SELECT qid, unnest({sql_tokens('query')}) AS term FROM q) GROUP BY qid, term)
SELECT qt.qid, qt.term, CAST(qt.qtf AS INTEGER) AS qtf, post.path, post.tf
FROM qt JOIN post USING (term)""")
def c3_query_terms_postings(spark, sf_dir):
    idx = bm25.build_index(documents_corpus(spark, sf_dir))
    qt = bm25.query_terms(_queries_df(spark))
    return (idx.postings.join(F.broadcast(qt), "term")
            .select("qid", "term", "qtf", "path", "tf"))


@register("h1_tokenize", f"""
SELECT {SQL_DOC_PATH} AS path, CAST(len({sql_tokens('text')}) AS INTEGER) AS n_tokens,
       sha1(array_to_string({sql_tokens('text')}, ' ')) AS tokens_sha1
FROM documents""")
def h1_tokenize(spark, sf_dir):
    c = documents_corpus(spark, sf_dir).select("path", tokenize("text").alias("t"))
    return c.select("path", F.size("t").alias("n_tokens"), F.sha1(F.array_join("t", " ")).alias("tokens_sha1"))


@register("a3_indexable_documents", f"""
SELECT {SQL_DOC_PATH} AS path FROM documents
WHERE NOT contains(text, chr(0))
  AND NOT regexp_matches({SQL_DOC_PATH}, '(^|/)[.]') AND len({sql_tokens('text')}) > 0""")
def a3_indexable_documents(spark, sf_dir):
    return bm25.indexable_documents(documents_corpus(spark, sf_dir)).select("path")


@register("a3_max_bytes_option", f"""
SELECT {SQL_DOC_PATH} AS path FROM documents
WHERE strlen(text) <= 2000 AND NOT contains(text, chr(0))
  AND NOT regexp_matches({SQL_DOC_PATH}, '(^|/)[.]') AND len({sql_tokens('text')}) > 0""")
def a3_max_bytes_option(spark, sf_dir):
    """The size cap as an option of the index: paths of a capped index."""
    return bm25.build_index(documents_corpus(spark, sf_dir), max_bytes=2000).lengths.select("path")


@register("a4_semantic_documents", f"""
SELECT {SQL_DOC_PATH} AS path, CAST(strlen(text) AS BIGINT) AS size FROM documents
WHERE NOT contains(text, chr(0))
  AND NOT regexp_matches({SQL_DOC_PATH}, '(^|/)[.]')""")
def a4_semantic_documents(spark, sf_dir):
    return (bm25.indexable_documents(documents_corpus(spark, sf_dir), require_tokens=False)
            .select("path", "size"))


@register("h2_content_hash", f"""
SELECT {SQL_DOC_PATH} AS path, sha1(text) AS hash FROM documents""")
def h2_content_hash(spark, sf_dir):
    return documents_corpus(spark, sf_dir).select("path", content_hash("text").alias("hash"))


@register("h3_hidden_path", """
SELECT page_id, regexp_matches(regexp_replace(url, '^[a-z]+://', ''), '(^|/)[.]') AS hidden
FROM pages""")
def h3_hidden_path(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    rel = F.regexp_replace("url", "^[a-z]+://", "")
    return p.select("page_id", is_hidden_path(rel).alias("hidden"))


@register("d6_result_counts", f"""WITH {SQL_INDEX},
q AS ({BENCH_QUERIES_SQL}),
qt AS (SELECT qid, unnest({sql_tokens('query')}) AS term FROM q),
nq AS (SELECT qid, count(*) AS query_tokens FROM qt GROUP BY qid),
m AS (SELECT qid, count(DISTINCT post.path) AS matched FROM qt JOIN post USING (term) GROUP BY qid)
SELECT nq.qid, (SELECT count(*) FROM dls) AS documents, nq.query_tokens, coalesce(m.matched, 0) AS matched_documents
FROM nq LEFT JOIN m USING (qid)""")
def d6_result_counts(spark, sf_dir):
    """Result metadata per query: indexed documents, query tokens, documents matched."""
    idx = bm25.build_index(documents_corpus(spark, sf_dir))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    n_docs, _ = bm25.corpus_stats(idx.lengths)
    qt = q.select("qid", F.explode(tokenize("query")).alias("term"))
    nq = qt.groupBy("qid").agg(F.count(F.lit(1)).alias("query_tokens"))
    matched = bm25.matched_documents(idx, q)
    return nq.join(matched, "qid", "left").select(
        "qid", n_docs.alias("documents"), "query_tokens",
        F.coalesce("matched", F.lit(0)).alias("matched_documents"))


@register("a10_root_id", """
SELECT page_id, sha1(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS root_id FROM pages""")
def a10_root_id(spark, sf_dir):
    """Index key per root: sha1 of the root (here the page's host)."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.sha1(F.expr("parse_url(url, 'HOST')")).alias("root_id"))


@register("a1_duplicate_paths", f"""
SELECT path, count(*) AS n FROM (SELECT {SQL_DOC_PATH} AS path FROM documents) GROUP BY path HAVING count(*) > 1""")
def a1_duplicate_paths(spark, sf_dir):
    """The corpus key check: paths occurring more than once (none expected)."""
    return duplicate_paths(documents_corpus(spark, sf_dir))
