"""The operators' queries against their DuckDB SQL, and their plans."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from quarry.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cur = duck.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((str(dict(sorted(zip(cols, r)))) for r in cur.fetchall()))
    assert sorted(str(dict(sorted(r.asDict().items()))) for r in df.collect()) == want


def test_one_query_for_each_operator_and_the_pipeline():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted([f"op{i}" for i in range(1, 14)] + ["pipeline"])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_in_the_last_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["op5_license_scan", "op7_chat_windows", "op11_exact_dedup"])
def test_native_operators_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "MapInArrow", "Pandas", "FlatMapGroups"))
