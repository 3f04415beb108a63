"""Licence scan in DataFrame functions only: MinHash bands over overlapping
windows of a text retrieve licence templates, exact shingle containment
verifies them.

A template's five-word shingles are cut into parts of at most ``PART``. A part
of t shingles, c the power of two with c / 2 < t <= c, is looked for in windows
of 2 c shingles that start every c shingles, so some window holds it whole and
their Jaccard similarity is over 1/4 (over 1/5 at containment 0.8). With
``BANDS`` bands of one MinHash value a part is missed with probability below
(4/5)**64 < 1e-6.

A window can share a band with a part only if it holds the part's minimum
shingle, so band minima are worked out only for windows around such shingles:
the outcome is that of all windows. Template shingles reach the scan as one
literal list; larger template sets go in batches of ``BATCH`` shingles. There
is no shuffle of texts: documents are scanned, and small result rows made
distinct. Defined cases: null, empty and short texts match nothing; templates
of fewer than five words are one shingle of all their words and match texts of
just those words; repeated rows give one result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm import jobs

SHINGLE, PART, BANDS, BATCH, LEAST = 5, 16, 64, 2000, 0.8

# Short notices of common licences.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
}


def notices(spark: SparkSession) -> DataFrame:
    """The default templates: (license, text)."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, NOTICES)), F.array(*map(F.lit, NOTICES.values())))
    return spark.range(1).select(F.explode(pairs).alias("license", "text"))


def words_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def once(value: Column) -> Column:
    """A generator of one row: what follows reads ``value`` and doesn't work it
    out again for every use."""
    return F.explode(F.array(value))


def shingle_hashes(words: Column, k: int = SHINGLE) -> Column:
    """Hash of every run of ``k`` words of an array column (one of all its words
    if it has fewer, none without words)."""
    def runs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))),
                           lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(F.array().cast("array<bigint>"))), 0)


def _band(x: Column, j: Column) -> Column:
    return F.xxhash64(x, j)


def _template_tables(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(license, shingles) and (key, bands: license, c, band of every part whose
    minimum in that band is the shingle ``key``)."""
    t = templates.where("license is not null").select("license", once(shingle_hashes(words_of(F.col("text")))).alias("run")).where("size(run) > 0")
    whole = t.select("license", F.array_distinct("run").alias("shingles"), "run")
    # Licences given more than once: each text is a template, the best counts.
    parts = whole.select("license", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("run"), F.lit(PART)), lambda i: F.array_distinct(F.slice("run", i, PART)))).alias("part"))
    wide = F.pow(F.lit(2), F.ceil(F.log2(F.size("part").cast("double")))).cast("int")
    bands = parts.select("license", wide.alias("c"), "part", F.explode(F.sequence(F.lit(1), F.lit(BANDS))).alias("band"))
    least = F.array_min(F.transform("part", lambda x: F.struct(_band(x, F.col("band")).alias("v"), x.alias("x"))))["x"]
    keys = bands.select(least.alias("key"), F.struct("license", "c", "band").alias("b")).groupBy("key").agg(F.collect_set("b").alias("bands"))
    return whole.select("license", "shingles").distinct(), keys


def scan(docs: DataFrame, templates: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, license, n_matched, n_shingles): licences of whose template a
    share of ``least`` or more of the shingles occurs in the document (the best
    template where a licence has several)."""
    spark = docs.sparkSession
    jobs.prepare(spark)
    whole, keys = _template_tables(templates if templates is not None else notices(spark))
    whole, keys = jobs.table(whole, "templates"), jobs.table(keys, "keys")
    listed = sorted(r["key"] for r in keys.select("key").toLocalIterator())
    hashed = docs.select("doc_id", once(shingle_hashes(words_of(docs["text"]))).alias("h"))
    found = [_scan(hashed, whole, keys.where(F.col("key").isin(batch)) if len(listed) > BATCH else keys, batch, least)
             for batch in (listed[i:i + BATCH] for i in range(0, max(len(listed), 1), BATCH))]
    best = reduce(DataFrame.unionByName, found).distinct()
    return best.groupBy("doc_id", "license").agg(F.max(F.struct((F.col("n_matched") / F.col("n_shingles")).alias("s"), "n_matched", "n_shingles")).alias("b")).select(
        "doc_id", "license", "b.n_matched", "b.n_shingles")


def _scan(hashed: DataFrame, whole: DataFrame, keys: DataFrame, batch: list[int], least: float) -> DataFrame:
    known = F.array(*[F.lit(x).cast("long") for x in batch]).cast("array<bigint>")
    some = hashed.where(F.arrays_overlap("h", known)).select("doc_id", "h", once(F.array_intersect("h", known)).alias("own"))
    spots = some.select("doc_id", "h", F.explode(F.filter(
        F.transform("h", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.array_contains("own", s["x"]))).alias("s"))
    spots = spots.join(F.broadcast(keys), F.col("s.x") == F.col("key"))

    def collides(b: Column) -> Column:
        def at(k: Column) -> Column:
            window = F.slice("h", k * b["c"] + 1, 2 * b["c"])
            return (k >= 0) & (F.array_min(F.transform(window, lambda y: _band(y, b["band"]))) == _band(F.col("key"), b["band"]))
        first = F.floor(F.col("s.i") / b["c"]).cast("int")
        return F.when(at(first), True).otherwise(F.when(first > 0, at(F.greatest(first - 1, F.lit(0)))).otherwise(False))

    hits = spots.select("doc_id", "h", F.explode(F.array_distinct(F.transform(F.filter("bands", collides), lambda b: b["license"]))).alias("license"))
    matched = F.size(F.array_intersect("h", "shingles")).cast("long")
    return (hits.join(F.broadcast(whole), "license")
            .select("doc_id", "license", matched.alias("n_matched"), F.size("shingles").cast("long").alias("n_shingles"))
            .where(F.col("n_matched") >= least * F.col("n_shingles")))
