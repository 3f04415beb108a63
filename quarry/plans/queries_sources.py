"""Directory trees as corpora: ``documents`` written as text files by language
and source, then listed and read by Spark jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.catalog import register
from quarry.session import scratch_path
from quarry.sources import files, listing
from quarry.sources.tables import table


def _tree(spark, sf_dir) -> str:
    root = scratch_path(spark, "tree")
    docs = table(spark, sf_dir, "documents")
    docs.select(F.coalesce("text", F.lit("")).alias("value"), "lang", "source").write.partitionBy("lang", "source").text(root)
    return root


@register("a1_tree_folders", """
SELECT DISTINCT 'lang=' || lang AS path, 'directory' AS type FROM documents
UNION SELECT DISTINCT 'lang=' || lang || '/source=' || source, 'directory' FROM documents""")
def a1_tree_folders(spark, sf_dir):
    """The folders of the tree, listed folder by folder."""
    return listing.list_folders(spark, _tree(spark, sf_dir)).where("type = 'directory'").select("path", "type")


@register("a1_tree_contents", """
SELECT 'lang=' || lang || '/source=' || source AS folder, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS n_bytes,
       CAST(sum(1 + length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS n_lines
FROM documents GROUP BY ALL""")
def a1_tree_contents(spark, sf_dir):
    """Bytes and lines of each folder's files, read by the tasks that hold them."""
    tree = files.with_text(listing.read_folders(spark, _tree(spark, sf_dir)).where("type = 'file' and path like '%.txt'"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    lines = F.length("text") - F.length(F.translate("text", "\n", ""))
    return tree.groupBy(folder.alias("folder")).agg(F.sum("size").alias("n_bytes"), F.sum(lines).cast("long").alias("n_lines"))


@register("a2_root_status", """
SELECT DISTINCT 'lang=' || lang AS name, true AS ok, CAST(NULL AS VARCHAR) AS error FROM documents
UNION ALL SELECT 'missing', false, 'root-missing'""")
def a2_root_status(spark, sf_dir):
    """Language folders of the tree, and one that isn't there, as roots."""
    root = _tree(spark, sf_dir)
    langs = [r[0] for r in table(spark, sf_dir, "documents").select("lang").distinct().collect()]
    status = files.root_status(spark, [f"{root}/lang={x}" for x in langs] + [f"{root}/missing"])
    return status.select(F.regexp_extract("root", "([^/]*)$", 1).alias("name"), "ok", "error")
