"""Registry of named queries over the driver tables, each with its SQL oracle.

Every query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole tables. The oracle is plain SQL for DuckDB over the same Parquet
files (brute force where that is simplest); both sides alias every column to
the same name and round doubles to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; ``sql=None`` marks it as not SQL-expressible (rows-only check)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from quarry.session import ensure_checkpoint_dir, ship_package
            ship_package(spark)
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every catalogue module so their queries register."""
    from quarry.plans import (  # noqa: F401
        queries_keyword,
        queries_text,
        queries_vectors,
        queries_runs,
        queries_experiments,
        queries_index,
        queries_segments,
        queries_hybrid,
        queries_sources,
        queries_regex,
        queries_misc,
    )


# SQL fragments shared by oracle statements (DuckDB dialect).
SQL_DOC_PATH = "lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt'"
SQL_TOKENS = "list_transform(regexp_extract_all({x}, '[A-Za-z0-9_]+'), lambda t: lower(t))"


def sql_tokens(expr: str) -> str:
    return SQL_TOKENS.format(x=expr)
