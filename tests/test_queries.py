"""All registered queries that have SQL, against it."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle_check import connect, difference
from tidemart.catalog import oracle
from tidemart.plans import semantic

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in oracle.statements() if n in entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    assert difference(df, connect(SF), entry.oracle_sql()[name]) is None


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()


def test_no_nested_loop_or_cartesian_joins(spark):
    for name in ("ts3_customer_training_dataset", "j5_eligible_snapshots", "a12_overview_kpis", "q2_high_risk_count_by_region"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_semantic_names():
    model = semantic.SEMANTIC_MODEL["daily_sales"]
    assert semantic.resolve(model.facts, "売上") == "total_amount"
    with pytest.raises(KeyError):
        semantic.resolve(model.facts, "profit")
