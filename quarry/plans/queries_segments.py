"""Segmented keyword index: refreshes, merges, repair and path order over two
snapshots of ``documents`` (those of :mod:`queries_index`)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import bm25, segments
from quarry.plans.catalog import register
from quarry.plans.queries_index import SQL_CUR_INDEX, SQL_REFRESHED_BM25, snapshot_cur, snapshot_prev
from quarry.session import delete_path, scratch_path

QUERY = "the license of the software"


def _refreshed(spark, base, *corpora):
    """An index that was refreshed with each corpus in turn; opened again each time."""
    changes = None
    for corpus in corpora:
        _, changes = segments.refresh(segments.open_index(spark, base), corpus)
    return segments.open_index(spark, base), changes


def _two(spark, sf_dir):
    return _refreshed(spark, scratch_path(spark, "segments"), snapshot_prev(spark, sf_dir), snapshot_cur(spark, sf_dir))[0]


def _search(spark, index):
    q = spark.createDataFrame([(1, QUERY)], "qid long, query string")
    return bm25.bm25_search(index.bm25(), q, k=20)


@register("i1_segmented_bm25", SQL_REFRESHED_BM25)
def i1_segmented_bm25(spark, sf_dir):
    """Four refreshes to and fro, then a merge of all segments, then a search."""
    prev, cur = snapshot_prev(spark, sf_dir), snapshot_cur(spark, sf_dir)
    index, _ = _refreshed(spark, scratch_path(spark, "segments"), prev, cur, prev, cur)
    return _search(spark, segments.merge_all(index))


@register("i1_segmented_search", SQL_REFRESHED_BM25)
def i1_segmented_search(spark, sf_dir):
    """A search over two segments and a deletion set."""
    return _search(spark, _two(spark, sf_dir))


@register("i1_segmented_postings", f"""WITH {SQL_CUR_INDEX}
SELECT term, path, tf, CAST(dl AS INTEGER) AS dl FROM post JOIN dls USING (path)""")
def i1_segmented_postings(spark, sf_dir):
    return _two(spark, sf_dir).postings().select("term", "path", "tf", "dl")


@register("d4_segmented_term_stats", f"""WITH {SQL_CUR_INDEX}
SELECT term, df, round(idf, 6) AS idf FROM idf""")
def d4_segmented_term_stats(spark, sf_dir):
    """Frequencies by segment less the deletion sets', idf floored by the histogram's mean."""
    return _two(spark, sf_dir).bm25().term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


@register("d2_frequency_histogram", f"""WITH {SQL_CUR_INDEX}
SELECT df, count(*) AS n FROM tdf GROUP BY df""")
def d2_frequency_histogram(spark, sf_dir):
    """The histogram of document frequencies after an update from the deltas."""
    return _two(spark, sf_dir).hist()


@register("f3_segmented_path_order", f"""WITH {SQL_CUR_INDEX}
SELECT path, row_number() OVER (ORDER BY path) AS prank FROM dls""")
def f3_segmented_path_order(spark, sf_dir):
    """Positions in path order, from the counts of the path ranges."""
    index = _two(spark, sf_dir)
    return index.leading(index.meta["n_docs"])


def _damaged(spark, sf_dir):
    """The index after the bucket of a common term was lost in every segment and
    a refresh with the same corpus; with the refresh's changes."""
    base, cur = scratch_path(spark, "segments"), snapshot_cur(spark, sf_dir)
    index, _ = _refreshed(spark, base, snapshot_prev(spark, sf_dir), cur)
    bucket = spark.range(1).select(bm25.term_bucket(F.lit("the"))).first()[0]
    for s in index.meta["segments"]:
        delete_path(spark, f"{base}/postings/sid={s['sid']}/bucket={bucket}")
    return segments.refresh(segments.open_index(spark, base), cur)


@register("i4_postings_repair", f"""WITH {SQL_CUR_INDEX}
SELECT path, 'repaired' AS status FROM post WHERE term = 'the'""")
def i4_postings_repair(spark, sf_dir):
    """Documents that hold a term of the lost bucket are found from the postings
    and repaired."""
    index, changes = _damaged(spark, sf_dir)
    return changes.join(index.postings().where("term = 'the'").select("path"), "path")


@register("i4_repaired_bm25", SQL_REFRESHED_BM25)
def i4_repaired_bm25(spark, sf_dir):
    """A search after the repair has the results of a rebuild."""
    return _search(spark, _damaged(spark, sf_dir)[0])
