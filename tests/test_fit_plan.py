"""How listings meet profiles."""

import os

import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", ["fit_rank", "fit_reasons"])
def test_pairs_are_dealt_to_tasks_and_ranked_by_numbers(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # few bytes of live listings would be coalesced into one task, which would then score all pairs
    assert "REPARTITION_BY_NUM" in plan
    order = [line for line in plan.splitlines() if "Window" in line]
    assert order and all("title" not in line and "source_url" not in line for line in order)


def test_the_best_of_classes_equal_all_pairs_where_profiles_are_many(spark):
    """Listings that score alike meet profiles once; at this size 15 profiles have thousands of listings each."""
    import oracle

    assert not oracle.differences(spark, "fit_rank", catalog.QUERIES["fit_rank"], catalog.ORACLE_SQL["fit_rank"], "/root/testdata/sf0.01")
