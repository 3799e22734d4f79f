"""Every query with SQL against DuckDB on the smallest tables; plans of those that must not funnel."""

import os

import oracle
import pytest

from tessera import catalog

SF = os.environ.get("SQL_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, name):
    assert not oracle.differences(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", ["first_wins", "best_per_title", "evidence_urls", "case_evidence", "status_days"])
def test_against_sql_where_ids_repeat(spark, name):
    """Evidence ids and titles repeat from this size on; SQL_SF runs all other queries at another size."""
    assert not oracle.differences(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["monthly_counters", "publish_diff", "carry_forward", "evidence_match", "related_top5", "first_wins", "status_asof"])
def test_no_cartesian_product_or_single_partition(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["hits_by_agent_month"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
