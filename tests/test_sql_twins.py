"""Registered queries against their independent SQL at the smallest scale."""

import pytest
from compare import connect, difference

import __spark_entry__ as spark_entry

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "week_spine", "sales_weekly", "inventory_weekly", "po_position_by_week", "po_weekly",
    "promotion_candidates", "override_candidates", "mart_validation", "completed_po_lines",
    "vendor_performance", "promo_uplift", "feature_quality", "source_quality",
    "orphan_receipts", "facts_outside_scope", "mapping_completeness", "join_cardinality", "demand_metrics",
    "stockout_metrics", "leakage_audit", "reorder_actions", "kpi_summary", "export_demand",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_text_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 129375


@pytest.mark.parametrize("name", CHECKED)
def test_same_result(spark, con, name):
    ours = spark_entry.queries()[name](spark, FOLDER).toPandas()
    assert difference(ours, con.execute(spark_entry.oracle_sql()[name]).df()) is None


def test_settings_can_be_applied_to_a_running_session(spark):
    """A caller's own session may have none of the settings; all of them must be settable."""
    from shelfspark.session import RUNTIME_SETTINGS, tuned

    for key in RUNTIME_SETTINGS:
        assert spark.conf.isModifiable(key), key
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(key, "true")
    assert tuned(spark).conf.get(key) == "false"
