"""Vector queries over ``embeddings`` (and semantic search over ``documents``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import embed_store, pivots
from quarry.operators.index import ensure_vector_index, vector_registry
from quarry.operators.semantic import HashingEmbedder, semantic_search
from quarry.operators.vectors import append_vectors, build_vectors, load_vectors, save_vectors, vector_search
from quarry.plans.catalog import SQL_DOC_PATH, register
from quarry.plans.queries_index import SQL_SNAP, snapshot_cur, snapshot_prev
from quarry.plans.sizing import bounded_broadcast
from quarry.session import scratch_path
from quarry.sources.tables import documents_corpus, table

DIM = 64


def label_queries(emb):
    """One query per label: the vector with the smallest vec_id of that label."""
    first = emb.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return emb.join(first, ["label", "vec_id"]).select(F.col("vec_id").alias("qid"), "label", "embedding")


SQL_NORMED = """
normed AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x / (nrm + 1e-9)) AS v
  FROM (SELECT vec_id, label, embedding,
               sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS nrm
        FROM embeddings)),
q AS (SELECT n.vec_id AS qid, n.label, n.v FROM normed n
      JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) f USING (label, vec_id))"""


def _sql_topk(k: int) -> str:
    return f"""WITH {SQL_NORMED},
scored AS (SELECT q.qid, n.vec_id AS id, round(list_sum(list_transform(list_zip(q.v, n.v), lambda p: p[1] * p[2])), 6) AS score
           FROM q CROSS JOIN normed n)
SELECT qid, id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored)
WHERE rank <= {k}"""


def _search(spark, sf_dir, k, vectors=None):
    emb = table(spark, sf_dir, "embeddings")
    idx = vectors if vectors is not None else build_vectors(emb, DIM, id_col="vec_id")
    q = label_queries(emb)
    return vector_search(idx, q, k, dim=DIM)


@register("k4_vector_topk", _sql_topk(10))
def k4_vector_topk(spark, sf_dir):
    return _search(spark, sf_dir, 10)


@register("f4_vector_topk_k50", _sql_topk(50))
def f4_vector_topk_k50(spark, sf_dir):
    return _search(spark, sf_dir, 50)


@register("g1_vector_append", _sql_topk(10))
def g1_vector_append(spark, sf_dir):
    """Index built from labels < 5, then the rest appended: same answers as one build."""
    emb = table(spark, sf_dir, "embeddings")
    a = build_vectors(emb.filter(F.col("label") < 5), DIM, id_col="vec_id")
    b = build_vectors(emb.filter(F.col("label") >= 5), DIM, id_col="vec_id")
    return _search(spark, sf_dir, 10, append_vectors(a, b))


@register("h8_l2_normalize", """
SELECT vec_id, round(nrm, 6) AS norm, round(embedding[1] / (nrm + 1e-9), 6) AS first_unit,
       round(list_sum(list_transform(embedding, lambda x: (x / (nrm + 1e-9)) * (x / (nrm + 1e-9)))), 6) AS unit_sq
FROM (SELECT vec_id, embedding,
             sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS nrm
      FROM embeddings)""")
def h8_l2_normalize(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding",
                                                      V.l2_normalize("embedding").alias("u"))
    return emb.select("vec_id", F.round(V.l2_norm("embedding"), 6).alias("norm"),
                      F.round(F.element_at("u", 1), 6).alias("first_unit"),
                      F.round(V.dot("u", "u"), 6).alias("unit_sq"))


@register("h9_cosine_to_label_query", f"""WITH {SQL_NORMED}
SELECT n.vec_id, n.label, round(list_sum(list_transform(list_zip(q.v, n.v), lambda p: p[1] * p[2])), 6) AS score
FROM normed n JOIN q USING (label)""")
def h9_cosine_to_label_query(spark, sf_dir):
    """Cosine of every vector with its label's query vector (equi-join on label)."""
    emb = table(spark, sf_dir, "embeddings")
    q = label_queries(emb).select("label", F.col("embedding").alias("qv"))
    q = bounded_broadcast(q, max_rows=100_000)
    return (emb.join(q, "label")
            .select("vec_id", "label", F.round(V.cosine("embedding", "qv"), 6).alias("score")))


@register("h10_dimension_check", """
SELECT count(*) AS n_vectors, CAST(min(len(embedding)) AS INTEGER) AS dim FROM embeddings""")
def h10_dimension_check(spark, sf_dir):
    """Every vector checked to have 64 entries inside the plan (fails otherwise)."""
    v = build_vectors(table(spark, sf_dir, "embeddings"), DIM, id_col="vec_id")
    return v.agg(F.count(F.lit(1)).alias("n_vectors"), F.min(F.size("embedding")).alias("dim"))


# Semantic search with the hashing embedder: token-count vectors, cosine.
SQL_SEMANTIC = f"""
WITH docs AS (SELECT {SQL_DOC_PATH} AS path, text FROM documents
              WHERE NOT contains(text, chr(0))),
dt AS (SELECT path, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda t: lower(t))) AS tok FROM docs),
db AS (SELECT path, ('0x' || substr(sha1(tok), 1, 8))::UBIGINT % 64 AS b, count(*) AS c FROM dt GROUP BY ALL),
dn AS (SELECT path, sqrt(sum(c * c)) AS nrm FROM db GROUP BY path),
alld AS (SELECT path, coalesce(nrm, 0) AS nrm FROM docs LEFT JOIN dn USING (path)),
qt AS (SELECT item_id AS qid, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda t: lower(t))) AS tok FROM benchmark),
qb AS (SELECT qid, ('0x' || substr(sha1(tok), 1, 8))::UBIGINT % 64 AS b, count(*) AS c FROM qt GROUP BY ALL),
qn AS (SELECT qid, sqrt(sum(c * c)) AS nrm FROM qb GROUP BY qid),
allq AS (SELECT item_id AS qid, coalesce(nrm, 0) AS nrm FROM benchmark LEFT JOIN qn ON qn.qid = item_id),
dots AS (SELECT qb.qid, db.path, sum(qb.c * db.c) AS d FROM qb JOIN db USING (b) GROUP BY ALL),
scored AS (
  SELECT allq.qid, alld.path,
         round(coalesce(d, 0) / ((allq.nrm + 1e-9) * (alld.nrm + 1e-9)), 6) AS score
  FROM allq CROSS JOIN alld LEFT JOIN dots ON dots.qid = allq.qid AND dots.path = alld.path)
SELECT qid, path, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS INTEGER) AS rank FROM scored)
WHERE rank <= 5"""


@register("k4_semantic_search", SQL_SEMANTIC)
def k4_semantic_search(spark, sf_dir):
    """Every benchmark passage against every document, hashing embedder, top 5."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return semantic_search(documents_corpus(spark, sf_dir), q, HashingEmbedder(64), 5)


@register("k4_stored_semantic_search", SQL_SEMANTIC)
def k4_stored_semantic_search(spark, sf_dir):
    """The same search over a stored vector index: built, found again, searched."""
    base = scratch_path(spark, "vector-index")
    corpus = documents_corpus(spark, sf_dir)
    ensure_vector_index(spark, base, corpus, HashingEmbedder(64))
    stored = ensure_vector_index(spark, base, corpus, HashingEmbedder(64))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return semantic_search(None, q, HashingEmbedder(64), 5, vectors=stored)


@register("i3_vector_refresh", f"""WITH {SQL_SNAP}
SELECT path, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS BIGINT) AS n_tokens FROM cur""")
def i3_vector_refresh(spark, sf_dir):
    """A vector index of snapshot 1 refreshed with snapshot 2: removed documents
    gone, added and edited ones embedded (the hashing embedder counts tokens)."""
    base = scratch_path(spark, "vector-index")
    ensure_vector_index(spark, base, snapshot_prev(spark, sf_dir), HashingEmbedder(64))
    vecs = ensure_vector_index(spark, base, snapshot_cur(spark, sf_dir), HashingEmbedder(64))
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    return vecs.select(F.col("id").alias("path"), total.cast("long").alias("n_tokens"))


@register("i3_embedding_store", f"""WITH {SQL_SNAP}
SELECT path, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS BIGINT) AS n_tokens FROM cur""")
def i3_embedding_store(spark, sf_dir):
    """Vectors by content hash: snapshot 1, then snapshot 2 (contents that were
    seen before are not embedded again)."""
    base = scratch_path(spark, "embeddings")
    embed_store.refresh(spark, base, snapshot_prev(spark, sf_dir), HashingEmbedder(64))
    vecs = embed_store.refresh(spark, base, snapshot_cur(spark, sf_dir), HashingEmbedder(64))
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    return vecs.select(F.col("id").alias("path"), total.cast("long").alias("n_tokens"))


@register("a9_vector_registry", """
SELECT 'hashing-sha1-64' AS embedder, CAST(64 AS INTEGER) AS dimension, count(*) AS n_vectors FROM documents""")
def a9_vector_registry(spark, sf_dir):
    """The registry of a stored vector index beside its number of vectors."""
    base = scratch_path(spark, "vector-index")
    vecs = ensure_vector_index(spark, base, documents_corpus(spark, sf_dir), HashingEmbedder(64))
    reg = vector_registry(spark, base)
    return vecs.agg(F.count("*").alias("n_vectors")).select(
        F.lit(reg["embedder"]).alias("embedder"), F.lit(reg["dimension"]).alias("dimension"), "n_vectors")


@register("a8_vector_store_round_trip", _sql_topk(10))
def a8_vector_store_round_trip(spark, sf_dir):
    """Store round trip: save an index of labels < 5, replace it with the full
    index (overwrite), load it back and search: same answers as in memory."""
    emb = table(spark, sf_dir, "embeddings")
    path = scratch_path(spark, "vectors")
    save_vectors(build_vectors(emb.filter(F.col("label") < 5), DIM, id_col="vec_id"), path)
    save_vectors(build_vectors(emb, DIM, id_col="vec_id"), path, mode="overwrite")
    return _search(spark, sf_dir, 10, load_vectors(spark, path))


@register("a8_vector_store_in_place", _sql_topk(10))
def a8_vector_store_in_place(spark, sf_dir):
    """An index loaded, added to and saved to the folder it came from."""
    emb = build_vectors(table(spark, sf_dir, "embeddings"), DIM, id_col="vec_id")
    path = scratch_path(spark, "vectors")
    save_vectors(emb.where("id % 3 = 0"), path)
    save_vectors(append_vectors(load_vectors(spark, path), emb.where("id % 3 = 1")), path)
    save_vectors(emb.where("id % 3 = 2"), path, mode="append")
    return _search(spark, sf_dir, 10, load_vectors(spark, path))


def _pivot_search(spark, sf_dir, queries, k):
    emb = table(spark, sf_dir, "embeddings")
    index = pivots.build(emb, scratch_path(spark, "pivots"), DIM, id_col="vec_id")
    return pivots.search(index, queries(emb), k).hits


@register("k4_pivot_topk", _sql_topk(10))
def k4_pivot_topk(spark, sf_dir):
    """The label queries over stored pivot partitions."""
    return _pivot_search(spark, sf_dir, label_queries, 10)


@register("c5_every_vector_topk", f"""WITH {SQL_NORMED},
scored AS (SELECT a.vec_id AS qid, n.vec_id AS id, round(list_sum(list_transform(list_zip(a.v, n.v), lambda p: p[1] * p[2])), 6) AS score
           FROM normed a CROSS JOIN normed n)
SELECT qid, id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored)
WHERE rank <= 5""")
def c5_every_vector_topk(spark, sf_dir):
    """Every vector as a query, all in one plan: its five nearest by cosine."""
    return _pivot_search(spark, sf_dir, lambda emb: emb.select(F.col("vec_id").alias("qid"), "embedding"), 5)
