"""find: path search over corpus entries (files and directories)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.literals import glob_leading, leading
from quarry.functions.text import any_glob_match, java_regex

# The entry types find accepts, and the default file globs per
# language (any other language selects every file).
SUPPORTED_TYPES = ("file", "directory")
DEFAULT_LANGUAGE_GLOBS = {"python": ["*.py"]}


def path_entries(corpus: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, type) for every file and every directory above it.

    A corpus read from a directory tree already lists both kinds; for a table
    corpus the directories are the path prefixes, de-duplicated with a
    map-side partial aggregate first (a directory holding a third of all files
    is combined before the shuffle).
    """
    if "type" in corpus.columns:
        return corpus.select(F.col(path_col).alias("path"), "type")
    files = corpus.select(F.col(path_col).alias("path"), F.lit("file").alias("type"))
    parts = F.split(F.col(path_col), "/")
    dirs = (corpus.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, i), "/")))).alias("path"))
        .filter(F.col("path").isNotNull()).distinct()
        .select("path", F.lit("directory").alias("type")))
    return files.unionByName(dirs)


def find_paths(entries: DataFrame, pattern: str | None = None, type_filter: str | None = None,
               globs: list[str] | None = None, sort: bool = True) -> DataFrame:
    """Paths whose relative POSIX path contains a match of ``pattern``.

    Null or empty pattern = all; ``type_filter`` is file, directory or None;
    any other value is an error, as is an invalid pattern. The cheap type test
    is applied before the regex, and so is what an anchored pattern or the globs
    begin with: on a listing stored in path order (:func:`write_listing`) these
    reach the scan and skip the row groups of other paths.
    """
    if type_filter is not None and type_filter not in SUPPORTED_TYPES:
        raise ValueError(f"invalid-type: {type_filter}")
    out = entries
    if type_filter is not None:
        out = out.filter(F.col("type") == type_filter)
    if pattern:
        java, start = java_regex(pattern), leading(pattern)
        if start:
            out = out.filter(F.col("path").startswith(start))
        out = out.filter(F.col("path").rlike(java))
    if globs:
        starts = {glob_leading(g) for g in globs}
        if all(starts):
            out = out.filter(reduce(or_, [F.col("path").startswith(s) for s in sorted(starts)]))
        out = out.filter(any_glob_match("path", globs))
    out = out.select("path")
    return out.orderBy("path") if sort else out


def write_listing(entries: DataFrame, folder: str, row_group_bytes: int = 8 << 20) -> DataFrame:
    """Store (path, type) in path order, in row groups of a bounded size."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    (entries.select("path", "type").repartitionByRange(parts, "path").sortWithinPartitions("path")
     .write.option("parquet.block.size", str(row_group_bytes)).parquet(folder))
    return entries.sparkSession.read.schema("path string, type string").parquet(folder)


def select_language_files(entries: DataFrame, languages: list[str],
                          language_globs: dict[str, list[str]] | None = None) -> DataFrame:
    """(language, path): files of each requested language, each path once per language.

    Globs are literal per language, evaluated in one pass (no join with a
    glob table); several globs of one language are one alternation.
    """
    table = dict(DEFAULT_LANGUAGE_GLOBS)
    table.update(language_globs or {})
    files = entries.filter(F.col("type") == "file") if "type" in entries.columns else entries
    per_lang = F.array(*[F.when(any_glob_match("path", table.get(lang, ["*"])), F.lit(lang))
                         for lang in languages])
    return (files.select("path", F.explode(F.filter(per_lang, lambda x: x.isNotNull())).alias("language"))
            .select("language", "path"))
