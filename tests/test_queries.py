import pytest
import sqlcheck

import __spark_entry__ as entry
from docmill import queries, queries_dml, queries_more

QUERIES = {**queries.QUERIES, **queries_dml.QUERIES, **queries_more.QUERIES}
SQL = {**queries.SQL, **queries_dml.SQL, **queries_more.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, sqlcheck.SF).toPandas()
    want = sqlcheck.connect().sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert sqlcheck.rows(got) == sqlcheck.rows(want)


def test_entry_and_contract(spark):
    assert entry.entry(spark).columns == ["segment", "total", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.SQL) == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_driver_side_queries(spark, name):
    assert QUERIES[name](spark, sqlcheck.SF).count() > 1


def test_plans_push_filters_and_prune_columns(spark):
    plan = QUERIES["where_gt"](spark, sqlcheck.SF)._jdf.queryExecution().toString()
    assert "GreaterThan(c_acctbal,5000.0)" in plan and "c_mktsegment" not in plan.split("== Physical Plan ==")[1]
    assert "EqualTo(o_orderstatus,F)" in QUERIES["where_eq"](spark, sqlcheck.SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in QUERIES["limit_topk"](spark, sqlcheck.SF)._jdf.queryExecution().toString()
    assert "LeftOuter" not in QUERIES["join_then_filter_inner"](spark, sqlcheck.SF)._jdf.queryExecution().optimizedPlan().toString()
