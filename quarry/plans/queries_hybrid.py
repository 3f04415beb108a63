"""Keyword and vector rankings of ``documents`` fused with thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import bm25, hybrid
from quarry.operators.semantic import HashingEmbedder, embed_texts
from quarry.plans.catalog import register
from quarry.plans.queries_keyword import BENCH_QUERIES_SQL, SQL_INDEX, _sql_scores
from quarry.plans.queries_vectors import SQL_SEMANTIC
from quarry.session import cut_lineage
from quarry.sources.tables import documents_corpus, table

DIM = 64
#: (weight of the keyword side, its threshold, the vector side's threshold)
TRIALS = [(1.0, 0.0, 0.0), (0.5, 0.0, 0.0), (0.7, 0.3, 0.6), (0.3, 0.9, 0.8), (0.0, 0.0, 0.5)]


def _fused(spark, sf_dir, k, trials):
    corpus = documents_corpus(spark, sf_dir)
    index = bm25.build_index(corpus).materialize()
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    docs = bm25.indexable_documents(corpus, require_tokens=False)
    embedder = HashingEmbedder(DIM)
    vectors = cut_lineage(embed_texts(docs.select("path", "text"), embedder, "path", "text"))
    asked = embed_texts(q, embedder, "qid", "query").withColumnRenamed("id", "qid")
    return hybrid.fused_top_k(index, vectors, q, asked, k, trials)


def _sql(k: int, trials) -> str:
    rows = ", ".join(f"({i}, {w}, {ta}, {tb})" for i, (w, ta, tb) in enumerate(trials))
    vector = SQL_SEMANTIC.strip().removeprefix("WITH docs AS").rsplit("SELECT qid, path, score, rank FROM", 1)[0].strip()
    vector = "vdocs AS" + vector.replace("FROM docs", "FROM vdocs").replace("scored AS", "vscored AS")
    vector = vector.replace("qt AS", "vqt AS").replace("FROM qt", "FROM vqt")
    return f"""WITH {SQL_INDEX}, {_sql_scores(BENCH_QUERIES_SQL)},
{vector},
kw AS (SELECT qid, path, a / max(a) OVER (PARTITION BY qid) AS a FROM (SELECT qid, path, round(score, 6) AS a FROM scores) WHERE a > 0),
t AS (SELECT CAST(i AS BIGINT) AS trial_id, CAST(w AS DOUBLE) AS w, ta, tb FROM (VALUES {rows}) v(i, w, ta, tb)),
sides AS (SELECT trial_id, v.qid, v.path, w, CASE WHEN kw.a >= ta THEN kw.a ELSE 0.0 END AS a,
                 CASE WHEN v.score >= tb AND v.score > 0 THEN v.score ELSE 0.0 END AS b
          FROM vscored v LEFT JOIN kw ON kw.qid = v.qid AND kw.path = v.path CROSS JOIN t),
fused AS (SELECT trial_id, qid, path AS id, floor((w * a + (CAST(1 AS DOUBLE) - w) * b) * 1000000.0 + 0.001) / CAST(1000000 AS DOUBLE) AS score FROM sides)
SELECT trial_id, qid, id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY trial_id, qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM fused WHERE score > 0) WHERE rank <= {k}"""


@register("k12_keyword_vector_fusion", _sql(10, TRIALS[2:3]))
def k12_keyword_vector_fusion(spark, sf_dir):
    """BM25 (0.7, at least 0.3 of the highest) and cosine (0.3, at least 0.6),
    top 10 over all documents."""
    return _fused(spark, sf_dir, 10, TRIALS[2:3])


@register("k12_fusion_threshold_sweep", _sql(5, TRIALS))
def k12_fusion_threshold_sweep(spark, sf_dir):
    """Five trials of weight and thresholds in the same rounds, top 5 each."""
    return _fused(spark, sf_dir, 5, TRIALS)
