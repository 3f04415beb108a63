"""Sweep, relevance evaluation and fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import bm25
from quarry.operators import evaluate as EV
from quarry.operators import fusion as FU
from quarry.operators import sweep as SW
from quarry.plans.catalog import register
from quarry.plans.catalog import sql_tokens
from quarry.plans.queries_keyword import BENCH_QUERIES_SQL, SQL_INDEX, _sql_scores
from quarry.plans.queries_keyword import _sql_topk as _sql_kw_topk
from quarry.plans.queries_vectors import _search, _sql_topk as _sql_vec_topk, label_queries
from quarry.session import cut_lineage
from quarry.sources.tables import documents_corpus, table

# The sample tuning space (baseline and two dimensions).
BASELINE = 0.25
DIMENSIONS = [
    {"name": "alpha", "low": 0.0, "high": 1.0, "target": 0.7, "weight": 0.6},
    {"name": "beta", "low": 0.0, "high": 1.0, "target": 0.2, "weight": 0.4},
]


def _dims(spark):
    return spark.createDataFrame([(d["name"], d["low"], d["high"], d["target"], d["weight"]) for d in DIMENSIONS],
                                 "name string, low double, high double, target double, weight double")


def part_trials(spark, sf_dir):
    """One candidate per part: alpha = p_size / 50, beta = p_retailprice / 2000."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("trial_id"), F.explode(F.array(
        F.struct(F.lit("alpha").alias("name"), (F.col("p_size") / 50.0).alias("value")),
        F.struct(F.lit("beta").alias("name"), (F.col("p_retailprice") / 2000.0).alias("value")))).alias("p")
    ).select("trial_id", "p.name", "p.value")


SQL_DIMS = " UNION ALL ".join(
    f"SELECT '{d['name']}' AS name, CAST({d['low']} AS DOUBLE) AS low, CAST({d['high']} AS DOUBLE) AS high, "
    f"CAST({d['target']} AS DOUBLE) AS target, CAST({d['weight']} AS DOUBLE) AS weight" for d in DIMENSIONS)
SQL_TRIALS = """trials AS (
  SELECT p_partkey AS trial_id, 'alpha' AS name, p_size / 50.0 AS value FROM part
  UNION ALL SELECT p_partkey, 'beta', p_retailprice / 2000.0 FROM part)"""
SQL_SCORED = f"""dims AS ({SQL_DIMS}), {SQL_TRIALS},
close AS (SELECT trial_id, name, value, target,
                 greatest(0.0, 1.0 - least(abs(value - target) / (high - low), 1.0)) * weight AS c
          FROM trials JOIN dims USING (name)),
scored AS (SELECT trial_id, {BASELINE} + 0.05 + 0.95 * sum(c) / (SELECT sum(weight) FROM dims) AS score
           FROM close GROUP BY trial_id)"""


@register("k8_sweep_scores", f"""WITH {SQL_SCORED}
SELECT trial_id, round(score, 6) AS score FROM scored""")
def k8_sweep_scores(spark, sf_dir):
    s = SW.sweep(part_trials(spark, sf_dir), _dims(spark), BASELINE)
    return s.select("trial_id", F.round("score", 6).alias("score"))


@register("k8_custom_objective", f"""WITH dims AS ({SQL_DIMS}), {SQL_TRIALS}
SELECT trial_id, round({BASELINE} + 0.05 + 0.95 * sum(weight * CASE WHEN value >= target THEN 1.0 ELSE 0.0 END) / (SELECT sum(weight) FROM dims), 6) AS score
FROM trials JOIN dims USING (name) GROUP BY trial_id""")
def k8_custom_objective(spark, sf_dir):
    """The sweep with another objective: a dimension counts when its target is reached."""
    reached = lambda value, low, high, target, weight: F.when(value >= target, weight).otherwise(F.lit(0.0))
    s = SW.sweep(part_trials(spark, sf_dir), _dims(spark), BASELINE, reached)
    return s.select("trial_id", F.round("score", 6).alias("score"))


@register("h19_closeness", f"""WITH {SQL_SCORED}
SELECT trial_id, name, round(c, 6) AS closeness FROM close""")
def h19_closeness(spark, sf_dir):
    t = part_trials(spark, sf_dir).join(F.broadcast(_dims(spark)), "name")
    return t.select("trial_id", "name", F.round(SW.closeness(F.col("value"), F.col("low"), F.col("high"),
                                                             F.col("target"), F.col("weight")), 6).alias("closeness"))


@register("c6_trial_dimension_join", f"""WITH {SQL_SCORED}
SELECT trial_id, name, round(value, 6) AS value, target FROM close""")
def c6_trial_dimension_join(spark, sf_dir):
    t = part_trials(spark, sf_dir).join(F.broadcast(_dims(spark)), "name")
    return t.select("trial_id", "name", F.round("value", 6).alias("value"), "target")


@register("d10_best_trial", f"""WITH {SQL_SCORED}
SELECT trial_id, round(score, 6) AS score, score > {BASELINE} AS beats_baseline
FROM scored ORDER BY score DESC, trial_id LIMIT 1""")
def d10_best_trial(spark, sf_dir):
    s = SW.sweep(part_trials(spark, sf_dir), _dims(spark), BASELINE)
    b = SW.best_trial(s, BASELINE)
    return b.select("trial_id", F.round("score", 6).alias("score"), "beats_baseline")


# ----------------------------------------------------------------- evaluation

KS = [1, 5, 10]


def _vector_eval(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    hits = _search(spark, sf_dir, 10)
    ql = label_queries(emb).select("qid", "label")
    il = emb.select(F.col("vec_id").alias("id"), "label")
    return EV.evaluate_same_label(hits, ql, il, KS)


SQL_VEC_EVAL = f"""WITH hits AS ({_sql_vec_topk(10)}),
ql AS (SELECT label, min(vec_id) AS qid FROM embeddings GROUP BY label),
nrel AS (SELECT label, count(*) AS n_rel FROM embeddings GROUP BY label),
ks AS (SELECT unnest([1, 5, 10]) AS k),
judged AS (SELECT h.qid, h.rank, CASE WHEN e.label = ql.label THEN 1.0 ELSE 0.0 END AS rel
           FROM hits h JOIN embeddings e ON e.vec_id = h.id JOIN ql ON ql.qid = h.qid),
dcg AS (SELECT qid, k, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS hits, sum(rel / log2(rank + 1)) AS dcg
        FROM judged JOIN ks ON rank <= k GROUP BY qid, k),
ideal AS (SELECT ql.qid, k, n_rel,
                 (SELECT coalesce(sum(1.0 / log2(i + 1)), 0) FROM range(1, least(k, n_rel) + 1) t(i)) AS idcg
          FROM ql JOIN nrel USING (label) CROSS JOIN ks),
per_q AS (
  SELECT i.qid, CAST(i.k AS INTEGER) AS k, CAST(coalesce(d.hits, 0) AS BIGINT) AS hits,
         coalesce(d.hits, 0) / i.k AS precision,
         CASE WHEN n_rel > 0 THEN coalesce(d.hits, 0) / n_rel ELSE 0.0 END AS recall,
         CASE WHEN idcg > 0 THEN coalesce(d.dcg, 0.0) / idcg ELSE 0.0 END AS ndcg
  FROM ideal i LEFT JOIN dcg d ON d.qid = i.qid AND d.k = i.k)"""


@register("d13_vector_relevance", SQL_VEC_EVAL + """
SELECT qid, k, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM per_q""")
def d13_vector_relevance(spark, sf_dir):
    """Per query and k: hits, precision, recall, nDCG; relevant = same label."""
    m = _vector_eval(spark, sf_dir)
    return m.select("qid", "k", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg")])


@register("k11_mean_relevance", SQL_VEC_EVAL + """
SELECT k, count(*) AS queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(ndcg), 6) AS ndcg FROM per_q GROUP BY k""")
def k11_mean_relevance(spark, sf_dir):
    m = EV.mean_metrics(_vector_eval(spark, sf_dir))
    return m.select("k", "queries", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg")])


# ----------------------------------------------------------------- fusion

def _bench_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _rankings(spark, sf_dir, depth=20):
    """Both rankings over one materialised index; each keeps its best rows per
    task before anything is shuffled, so no score table is written."""
    idx = bm25.build_index(documents_corpus(spark, sf_dir)).materialize()
    q = _bench_queries(spark, sf_dir)
    a = bm25.bm25_search(idx, q, k=depth).withColumnRenamed("path", "id")
    # (Fusion reads the list twice: k rows a query, written once.)
    b = cut_lineage(bm25.overlap_search(idx, q, depth).withColumnRenamed("path", "id"))
    return a, b


SQL_RANKINGS = f"""WITH {SQL_INDEX}, {_sql_scores(BENCH_QUERIES_SQL)},
allq AS (SELECT DISTINCT qid FROM qt),
full_rank AS (
  SELECT a.qid, d.path, round(coalesce(s.score, 0), 6) AS score
  FROM allq a CROSS JOIN dls d LEFT JOIN scores s ON s.qid = a.qid AND s.path = d.path),
ra AS (SELECT qid, path AS id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM full_rank) WHERE rank <= 20),
ov AS (SELECT qt.qid, post.path, CAST(count(*) AS DOUBLE) AS score FROM qt JOIN post USING (term) GROUP BY ALL),
rb AS (SELECT qid, path AS id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM ov) WHERE rank <= 20)"""


def _sql_fused(expr_a: str, expr_b: str) -> str:
    return f"""{SQL_RANKINGS},
both_r AS (SELECT coalesce(na.qid, nb.qid) AS qid, coalesce(na.id, nb.id) AS id,
                  round(0.7 * coalesce(na.s, 0.0) + 0.3 * coalesce(nb.s, 0.0), 6) AS score
           FROM (SELECT qid, id, {expr_a} AS s FROM ra) na
           FULL OUTER JOIN (SELECT qid, id, {expr_b} AS s FROM rb) nb ON na.qid = nb.qid AND na.id = nb.id)
SELECT qid, id, score, rank FROM (
  SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank
  FROM both_r) WHERE rank <= 10"""


MINMAX = ("CASE WHEN max(score) OVER (PARTITION BY qid) > min(score) OVER (PARTITION BY qid) "
          "THEN (score - min(score) OVER (PARTITION BY qid)) / (max(score) OVER (PARTITION BY qid) - min(score) OVER (PARTITION BY qid)) "
          "ELSE 1.0 END")


@register("k12_fusion_minmax", _sql_fused(MINMAX, MINMAX))
def k12_fusion_minmax(spark, sf_dir):
    """BM25 and term-overlap rankings (top 20 each), min-max scaled, 0.7/0.3, top 10."""
    a, b = _rankings(spark, sf_dir)
    return FU.fuse(a, b, 10, (0.7, 0.3), "minmax")


@register("k12_fusion_rrf", _sql_fused("1.0 / (60 + rank)", "1.0 / (60 + rank)"))
def k12_fusion_rrf(spark, sf_dir):
    a, b = _rankings(spark, sf_dir)
    return FU.fuse(a, b, 10, (0.7, 0.3), "rrf")


@register("k12_overlap_ranking", f"""{SQL_RANKINGS}
SELECT qid, id AS path, score, CAST(rank AS INTEGER) AS rank FROM rb""")
def k12_overlap_ranking(spark, sf_dir):
    idx = bm25.build_index(documents_corpus(spark, sf_dir))
    return bm25.overlap_search(idx, _bench_queries(spark, sf_dir), k=20)


# ------------------------------------------ retrieval evaluation over benchmark

SWEEP_WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]


def _passage_qrels(spark, sf_dir, corpus, idx):
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return EV.containment_qrels(idx.postings, idx.term_stats, corpus, passages)


SQL_QRELS = f"""{SQL_INDEX},
psg AS (SELECT item_id AS qid, text FROM benchmark WHERE text <> ''),
qrels AS (SELECT psg.qid, docs.path, 1 AS rel FROM psg JOIN docs ON contains(docs.text, psg.text))"""


@register("d13_containment_qrels", f"""WITH {SQL_QRELS}
SELECT qid, path, CAST(rel AS INTEGER) AS rel FROM qrels""")
def d13_containment_qrels(spark, sf_dir):
    """Relevance labels: documents that contain a benchmark passage verbatim."""
    corpus = documents_corpus(spark, sf_dir)
    idx = bm25.build_index(corpus).materialize()
    return _passage_qrels(spark, sf_dir, corpus, idx)


SHORT_PASSAGE = r"^\S+ \S+"


@register("d13_short_passage_qrels", f"""WITH {SQL_INDEX},
psg AS (SELECT item_id AS qid, regexp_extract(text, '{SHORT_PASSAGE}') AS text FROM benchmark)
SELECT psg.qid, docs.path, CAST(1 AS INTEGER) AS rel FROM psg JOIN docs ON contains(docs.text, psg.text) WHERE psg.text <> ''""")
def d13_short_passage_qrels(spark, sf_dir):
    """Passages of two words (the first two of each benchmark passage)."""
    corpus = documents_corpus(spark, sf_dir)
    idx = bm25.build_index(corpus).materialize()
    passages = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.regexp_extract("text", SHORT_PASSAGE, 0).alias("text"))
    return EV.containment_qrels(idx.postings, idx.term_stats, corpus, passages)


def _sql_metrics(hits_cte: str, ks: list[int], by: str = "") -> str:
    """per_q CTE: metrics per (by, qid, k) for hits(by, qid, path, rank) against qrels."""
    b = f"{by}, " if by else ""
    on_by = f"AND d.{by} = i.{by}" if by else ""
    return f"""hits AS ({hits_cte}),
ks AS (SELECT unnest({list(ks)}) AS k),
judged AS (SELECT {', '.join('h.' + c for c in ([by] if by else []) + ['qid', 'rank'])},
                  CASE WHEN q.path IS NOT NULL THEN 1.0 ELSE 0.0 END AS rel
           FROM hits h LEFT JOIN qrels q ON q.qid = h.qid AND q.path = h.path),
nrel AS (SELECT qid, count(*) AS n_rel FROM qrels GROUP BY qid),
evalq AS (SELECT DISTINCT {b}qid FROM hits),
dcg AS (SELECT {b}qid, k, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS hits, sum(rel / log2(rank + 1)) AS dcg
        FROM judged JOIN ks ON rank <= k GROUP BY ALL),
ideal AS (SELECT a.*, k, coalesce(n_rel, 0) AS n_rel,
                 (SELECT coalesce(sum(1.0 / log2(i + 1)), 0) FROM range(1, least(k, coalesce(n_rel, 0)) + 1) t(i)) AS idcg
          FROM evalq a LEFT JOIN nrel USING (qid) CROSS JOIN ks),
per_q AS (
  SELECT {', '.join('i.' + c for c in ([by] if by else []))}{', ' if by else ''}i.qid, CAST(i.k AS INTEGER) AS k,
         CAST(coalesce(d.hits, 0) AS BIGINT) AS hits,
         coalesce(d.hits, 0) / i.k AS precision,
         CASE WHEN i.n_rel > 0 THEN coalesce(d.hits, 0) / i.n_rel ELSE 0.0 END AS recall,
         CASE WHEN i.idcg > 0 THEN coalesce(d.dcg, 0.0) / i.idcg ELSE 0.0 END AS ndcg
  FROM ideal i LEFT JOIN dcg d ON d.qid = i.qid AND d.k = i.k {on_by})"""


@register("k11_bm25_relevance", f"""WITH {SQL_QRELS},
{_sql_metrics("SELECT qid, path, rank FROM (" + _sql_kw_topk(BENCH_QUERIES_SQL, 10) + ")", [1, 5, 10])}
SELECT k, count(*) AS queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(ndcg), 6) AS ndcg FROM per_q GROUP BY k""")
def k11_bm25_relevance(spark, sf_dir):
    """BM25 top-10 for every benchmark passage, judged against containment
    qrels: mean precision/recall/nDCG at 1, 5, 10."""
    corpus = documents_corpus(spark, sf_dir)
    idx = bm25.build_index(corpus).materialize()
    hits = bm25.bm25_search(idx, _bench_queries(spark, sf_dir), k=10).withColumnRenamed("path", "id")
    qrels = _passage_qrels(spark, sf_dir, corpus, idx).withColumnRenamed("path", "id")
    m = EV.mean_metrics(EV.evaluate(hits, qrels, [1, 5, 10]))
    return m.select("k", "queries", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg")])


def _sql_sweep() -> str:
    trials = ", ".join(f"({i}, {w})" for i, w in enumerate(SWEEP_WEIGHTS))
    grid = f"""SELECT trial_id, qid, path, rank FROM (
  SELECT trial_id, qid, path,
         row_number() OVER (PARTITION BY trial_id, qid ORDER BY score DESC, path) AS rank
  FROM (SELECT t.trial_id, f.qid, f.id AS path,
               round(t.w * f.a + (1.0 - t.w) * f.b, 6) AS score
        FROM (SELECT coalesce(na.qid, nb.qid) AS qid, coalesce(na.id, nb.id) AS id,
                     coalesce(na.s, 0.0) AS a, coalesce(nb.s, 0.0) AS b
              FROM (SELECT qid, id, {MINMAX} AS s FROM ra) na
              FULL OUTER JOIN (SELECT qid, id, {MINMAX} AS s FROM rb) nb ON na.qid = nb.qid AND na.id = nb.id) f
        CROSS JOIN (SELECT CAST(trial_id AS BIGINT) AS trial_id, CAST(w AS DOUBLE) AS w
                    FROM (VALUES {trials}) v(trial_id, w)) t))
WHERE rank <= 10"""
    return f"""{SQL_RANKINGS},
psg AS (SELECT item_id AS qid, text FROM benchmark WHERE text <> ''),
qrels AS (SELECT psg.qid, docs.path, 1 AS rel FROM psg JOIN docs ON contains(docs.text, psg.text)),
{_sql_metrics(grid, [10], by="trial_id")}
SELECT p.trial_id, CAST(v.w AS DOUBLE) AS w_bm25, count(*) AS queries, round(avg(ndcg), 6) AS ndcg
FROM per_q p JOIN (VALUES {trials}) v(trial_id, w) ON v.trial_id = p.trial_id
GROUP BY p.trial_id, v.w"""


@register("k8_fusion_weight_sweep", _sql_sweep())
def k8_fusion_weight_sweep(spark, sf_dir):
    """Sweep of the BM25/overlap fusion weight, every trial in one plan,
    scored by mean nDCG@10 against containment qrels."""
    corpus = documents_corpus(spark, sf_dir)
    idx = bm25.build_index(corpus).materialize()
    q = _bench_queries(spark, sf_dir)
    a = bm25.bm25_search(idx, q, k=20).withColumnRenamed("path", "id")
    b = cut_lineage(bm25.overlap_search(idx, q, 20).withColumnRenamed("path", "id"))
    grid = FU.fuse_weight_grid(a, b, 10, SWEEP_WEIGHTS, "minmax")
    qrels = _passage_qrels(spark, sf_dir, corpus, idx).withColumnRenamed("path", "id")
    per = EV.evaluate(grid.select("trial_id", "qid", "id", "rank"), qrels, [10], by=["trial_id"])
    weights = grid.select("trial_id", F.col("w_a").alias("w_bm25")).distinct()
    m = EV.mean_metrics(per, by=["trial_id"]).join(weights, "trial_id")
    return m.select("trial_id", "w_bm25", "queries", F.round("ndcg", 6).alias("ndcg"))
