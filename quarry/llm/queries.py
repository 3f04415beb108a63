"""The operators' registered queries: each applies one operator to its whole
table and derives the digest columns from the operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import (chat, cover_tree, decontaminate, exact_dedup, importance, jobs, licenses, minhash_dedup, orc_tokens, packing, quality,
                        substring_dedup, vector_codes, wrappers)
from quarry.llm.registry import read, register

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def _sql_words(column: str, pattern: str) -> str:
    return f"regexp_extract_all({_LOWER.format(x=column)}, '{pattern}')"


@register("op1_suffix_array_dedup")
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register("op2_minhash_near_dedup", sql=f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, {_sql_words("coalesce(text, '')", _SPACED)} AS ws FROM documents),
    g AS (
      SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
               ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END) AS s
      FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
          WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
    e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
    FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""")
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)


@register("op3_orc_token_output")
def op3_orc_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = jobs.fresh_path(spark, "orc")
    orc_tokens.write_tokens(read(spark, sf_dir, "documents"), path)
    return orc_tokens.digests(orc_tokens.read_tokens(spark, path))


@register("op4_winnowing_decontamination", sql=f"""
    WITH d AS (SELECT doc_id, {_sql_words("coalesce(text, '')", _ALNUM)} AS ws FROM documents),
    b AS (SELECT item_id, {_sql_words("coalesce(text, '')", _ALNUM)} AS ws FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n,
                  unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + least(len(ws), 10) - 1], ' '))) AS s
           FROM b WHERE len(ws) > 0),
    ns AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i,
                  unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS s
           FROM d, ns WHERE len(ws) >= n),
    h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op4_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _sql_list(values) -> str:
    return ", ".join("('" + "', '".join(v) + "')" for v in values)


@register("op5_license_scan", sql=f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_ALNUM}') AS ws FROM documents),
    t AS (SELECT license, regexp_extract_all(lower(text), '{_ALNUM}') AS ws FROM (VALUES {_sql_list(licenses.NOTICES.items())}) n(license, text)),
    g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM w WHERE len(ws) > 0),
    u AS (SELECT DISTINCT license, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM t),
    n AS (SELECT license, count(*) AS n_shingles FROM u GROUP BY license)
    SELECT doc_id, license, count(*) AS n_matched, any_value(n_shingles) AS n_shingles
    FROM g JOIN u USING (s) JOIN n USING (license) GROUP BY doc_id, license HAVING count(*) >= 0.8 * any_value(n_shingles)""")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


@register("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


_PROBE = r"\### Assistant: </turn> ok"
_STEP = f"greatest({chat.LEAST_STEP}, floor(({chat.BUDGET - chat.HISTORY} - coalesce(stok, 0)) / 2))"


def _sql_escaped(column: str, marks: str) -> str:
    return f"length({column}) + length({column}) - length(regexp_replace({column}, '[{marks}]', '', 'g'))"


@register("op7_chat_windows", sql=f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '{_PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{_PROBE}'),
    t AS (SELECT *, greatest(1, CAST(ceil(strlen(text) / 4.0) AS BIGINT)) AS tokens,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM c),
    b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM t),
    s AS (SELECT conv_id, min(pos) AS spos, arg_min(tokens, pos) AS stok FROM b WHERE role = 'system' GROUP BY conv_id),
    l AS (SELECT b.*, spos, {_STEP} AS step, CASE WHEN tokens > {_STEP} THEN 1 ELSE 0 END AS long,
                 {len(chat.OPEN + chat.AFTER_ROLE + chat.CLOSE)} + {_sql_escaped("role", chr(92) * 2 + "#<:")} + {_sql_escaped("text", chr(92) * 2 + "#<")} AS chars
          FROM b LEFT JOIN s USING (conv_id)),
    p AS (SELECT *, 2 * coalesce(sum(long) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + long AS part,
                 CASE WHEN long = 1 THEN 0 ELSE floor(bef / step) END AS slot FROM l),
    w AS (SELECT conv_id, part, slot, min(pos) AS first, min(bef) AS start, any_value(spos) AS spos FROM p GROUP BY ALL),
    r AS (SELECT conv_id, sum(chars) AS chars FROM (
            SELECT conv_id, chars FROM p
            UNION ALL SELECT w.conv_id, p.chars FROM w JOIN p ON p.conv_id = w.conv_id AND p.pos = w.spos WHERE w.spos < first
            UNION ALL SELECT w.conv_id, p.chars FROM w JOIN p ON p.conv_id = w.conv_id AND p.bef >= start - {chat.HISTORY}
                             AND p.bef + p.tokens <= start AND p.pos IS DISTINCT FROM w.spos WHERE first > 0) GROUP BY conv_id),
    d AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS said,
                 coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS aim FROM b GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(aim) AS loss_chars, sha256(aim) AS loss_sha256,
           CAST(chars AS BIGINT) AS formatted_chars FROM d JOIN r USING (conv_id)""")
def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(_PROBE).alias("text"))
    return chat.digests(chat.windows(turns.unionByName(probe)))


@register("op8_dual_tree_top_k", sql="""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""")
def op8_dual_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@register("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), read(spark, sf_dir, "labels"), text=False)
    return out.select("doc_id", "lang", F.round("perplexity", 4).alias("perplexity"), F.round("limit", 4).alias("limit"),
                      F.col("accepted").alias("kept"))


@register("op10_wrapper_main_text")
def op10_wrapper_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wrappers.main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op11_exact_dedup", sql=r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM n""")
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def _crc_steps() -> list[int]:
    """CRC-32 of each single byte, from the polynomial."""
    return importance.crc().step.tolist()


@register("op12_importance_resampling", sql=f"""
    WITH w AS (SELECT row_number() OVER () AS row, doc_id, {_sql_words("coalesce(text, '')", _ALNUM)} AS ws FROM documents),
    i AS (SELECT {_sql_words("coalesce(text, '')", _ALNUM)} AS ws FROM benchmark),
    g AS (SELECT row, array_to_string(ws[a:a + n - 1], ' ') AS f, count(*) AS c FROM w, range(1, 4) o(n), unnest(range(1, len(ws) - n + 2)) u(a) GROUP BY ALL),
    j AS (SELECT array_to_string(ws[a:a + n - 1], ' ') AS f, count(*) AS c FROM i, range(1, 4) o(n), unnest(range(1, len(ws) - n + 2)) u(a) GROUP BY ALL),
    d AS (SELECT f, hex(f) AS h FROM (SELECT f FROM g UNION SELECT f FROM j)),
    k AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda p: CAST('0x' || substr(h, 2 * p + 1, 2) AS BIGINT))),
              lambda r, b: xor(r >> 8, {_crc_steps()}[(xor(r, b) & 255) + 1])), 4294967295) % 10000 AS b FROM d),
    s AS (SELECT b, sum(c) AS s FROM g JOIN k USING (f) GROUP BY b),
    t AS (SELECT b, sum(c) AS t FROM j JOIN k USING (f) GROUP BY b),
    z AS (SELECT (SELECT sum(s) FROM s)::DOUBLE + 10000 AS s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000 AS t),
    v AS (SELECT s.b, floor(1000 * ln((coalesce(t.t, 0)::DOUBLE + 1) * z.s / ((s.s::DOUBLE + 1) * z.t))) AS gain FROM s LEFT JOIN t USING (b), z),
    q AS (SELECT row, sum(c * gain) AS weight, sum(c) AS n FROM g JOIN k USING (f) JOIN v USING (b) GROUP BY row),
    e AS (SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                 CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN q USING (row)),
    r AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS score FROM e),
    l AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM r)
    SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
           CASE WHEN n_words >= 20 AND rank <= 5 * n // 100 THEN rank END AS rank FROM l""")
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def _sql_codes(parts: int, entries: int, rounds: int) -> str:
    """The same rounds as plain SQL: every part against every entry."""
    steps = [f"""v AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    x AS MATERIALIZED (SELECT row, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM v, range({parts}) t(p)),
    b0 AS MATERIALIZED (SELECT p, e, x AS c FROM x JOIN (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < {entries}) USING (row))"""]
    nearest = """SELECT row, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
          SELECT row, x.p, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x JOIN b{r} b ON x.p = b.p) GROUP BY row, p"""
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED ({nearest.format(r=r)}),
    b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m, c) AS c FROM b{r} b LEFT JOIN (
          SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
            SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM x JOIN a{r} USING (row, p), range(1, 2000) t(i) WHERE i <= len(x) GROUP BY p, e, i) GROUP BY p, e) u USING (p, e))""")
    steps.append(f"a{rounds} AS MATERIALIZED ({nearest.format(r=rounds)})")
    steps.append(f"""o AS (SELECT row, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY row),
    h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS sha FROM b{rounds})""")
    return "WITH " + ",\n    ".join(steps) + """
    SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM v JOIN o USING (row), h"""


@register("op13_pivot_vector_codes", sql=_sql_codes(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS))
def op13_pivot_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    return codes.rows.withColumn("codebooks_sha256", F.lit(codes.sha256()))


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
