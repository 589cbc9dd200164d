"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest
from oracle import compare, views

from pulsegrid.plans.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twin(spark, con, name):
    compare(queries()[name](spark, SMALL), con, oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    assert queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_have_no_python_and_no_product(spark):
    """Grouped buckets, not range joins: nothing that is measured runs Python or a nested loop over rows."""
    for name in ("aggregate_day_by_type", "interval_islands_per_type", "workout_hr_containment_join", "trend_ols_by_type", "page_contiguity"):
        plan = queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_filters_reach_the_scan(spark):
    plan = queries()["list_samples_topk"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type)" in plan and "EqualTo(event_type,click)" in plan
    assert "TakeOrderedAndProject" in plan
