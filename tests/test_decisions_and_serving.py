"""Quantities, action tiers, exports, quality rules and contracts."""

import pytest
from fixtures import D, MAPPING, Sources, rows_of, table
from pyspark.sql import functions as F

from shelfspark.fixed_values import KPI_GROUPS, REORDER_COLUMNS
from shelfspark.operators import contracts, decisions, quality, serving

INPUT = dict(
    sku_id="S1", channel_id="A", center_id="C1", week_start_date="2025-01-06", category_l1="",
    category_l2="", brand="", demand_pred=10.0, stockout_risk_pred_proba=0.05,
    stockout_risk_pred_label=0, available_qty=0.0, inbound_qty_next_1w=0.0,
    inbound_qty_next_2w=0.0, inbound_qty_next_4w=0.0, inventory_cover_weeks=1.0,
    safety_stock_qty=0.0, standard_lead_time_days=14.0, order_cycle_days=7.0, open_po_qty=0.0,
    overdue_po_qty=0.0, moq_qty=0.0, order_multiple=1.0, min_order_amount=0.0, unit_cost=1.0,
    active_flag=1.0, order_block_flag=0.0, manual_override_flag=0.0, promo_flag=0.0,
    override_type="", override_reason="",
)
SCHEMA = ", ".join(
    f"{name} {'string' if isinstance(value, str) else 'double' if isinstance(value, float) else 'int'}"
    for name, value in INPUT.items())


def decide(spark, **changes):
    rows = [tuple({**INPUT, **changes}.values())]
    df = decisions.order_constraints(spark.createDataFrame(rows, SCHEMA))
    row = decisions.reorder_actions(df).first()
    return row.recommended_action, row.recommended_order_qty, row.action_reason


def quantity(spark, **changes):
    rows = [tuple({**INPUT, **changes}.values())]
    return decisions.order_constraints(
        spark.createDataFrame(rows, SCHEMA)).first().recommended_order_qty


@pytest.mark.parametrize("changes, expected", [
    (dict(available_qty=30.0, moq_qty=50.0), 0),
    (dict(), 30),
    (dict(moq_qty=35.0, order_multiple=8.0), 40),
    (dict(min_order_amount=100.5, unit_cost=2.0), 51),
    (dict(min_order_amount=100.0, unit_cost=0.0), 30),
    (dict(order_multiple=None), 30),
    (dict(order_multiple=-3.0), 30),
    (dict(safety_stock_qty=None, standard_lead_time_days=None), 10),
    (dict(demand_pred=-5.0), 0),
])
def test_constrained_quantity(spark, changes, expected):
    assert quantity(spark, **changes) == expected


@pytest.mark.parametrize("changes, action, qty, reason", [
    (dict(active_flag=0.0, manual_override_flag=1.0, override_type="EXPEDITE"), "HOLD", 0,
     "HOLD: Inactive or blocked SKU"),
    (dict(manual_override_flag=1.0, override_type="block_buy", override_reason=" \t"), "HOLD", 0,
     "HOLD: manual override - No override reason provided"),
    (dict(manual_override_flag=1.0, override_type="EXPEDITE", override_reason=" late "),
     "EXPEDITE", 30, "EXPEDITE: manual override - late"),
    (dict(manual_override_flag=1.0, override_type="OTHER"), "BUY", 30, None),
    (dict(stockout_risk_pred_proba=0.4, open_po_qty=5.0, available_qty=90.0), "EXPEDITE", 0, None),
    (dict(stockout_risk_pred_proba=0.4), "BUY", 30, None),
    (dict(inventory_cover_weeks=None, stockout_risk_pred_proba=0.3), "BUY", 30, None),
    (dict(inventory_cover_weeks=None, stockout_risk_pred_proba=0.2), "HOLD", 0,
     "HOLD: inventory position sufficient"),
    (dict(inventory_cover_weeks=26.0, available_qty=260.0, open_po_qty=50.0,
          inbound_qty_next_4w=40.0), "REDUCE", 0, None),
    (dict(inventory_cover_weeks=26.0, available_qty=260.0, open_po_qty=50.0,
          inbound_qty_next_4w=39.0), "HOLD", 0, None),
    (dict(inventory_cover_weeks=26.0, available_qty=260.0, open_po_qty=50.0,
          inbound_qty_next_4w=40.0, promo_flag=1.0), "HOLD", 0, None),
])
def test_action_tiers(spark, changes, action, qty, reason):
    got = decide(spark, **changes)
    assert got[:2] == (action, qty)
    assert reason is None or got[2] == reason


def test_position_is_recomputed_but_cover_is_not(spark):
    rows = [tuple({**INPUT, "available_qty": None, "inbound_qty_next_4w": 7.0,
                   "inventory_cover_weeks": 3.5}.values())]
    row = decisions.reorder_actions(
        decisions.order_constraints(spark.createDataFrame(rows, SCHEMA))).first()
    assert (row.inventory_position_qty, row.inventory_cover_weeks) == (7.0, 3.5)
    assert row.__fields__ == REORDER_COLUMNS


def test_decision_rules_are_counted(spark):
    rows = [("S1", "BUY", 0), ("S1", "HOLD", 5), ("S2", "WAIT", -1), ("S3", None, 1)]
    df = spark.createDataFrame(rows, "sku_id string, recommended_action string, "
                               "recommended_order_qty int").select(
        "*", F.lit("A").alias("channel_id"), F.lit("C").alias("center_id"),
        F.lit("w").alias("week_start_date"))
    assert dict(rows_of(decisions.decision_violations(df), "rule", "violations")) == {
        "duplicate_key": 1, "unknown_action": 2, "buy_without_quantity": 1,
        "hold_or_reduce_with_quantity": 1, "negative_quantity": 1}
    with pytest.raises(ValueError, match="duplicate_key=1"):
        decisions.require_valid_decisions(df)


def test_buckets_and_flags(spark):
    df = spark.createDataFrame([(0.7,), (0.69,), (0.4,), (0.39,), (None,)], "p double")
    assert [r[0] for r in df.select(serving.risk_bucket("p")).collect()] == [
        "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW"]
    names = spark.createDataFrame([("My_BASELINE", 0.4000001), ("model", 0.5), (None, None)],
                                  "model_name string, threshold double")
    assert [tuple(r) for r in names.select(serving.is_baseline(), serving.is_final_threshold())
            .collect()] == [(True, True), (False, False), (False, False)]


def test_kpis_without_decisions(spark):
    empty = spark.createDataFrame([], "recommended_action string, recommended_order_qty int")
    values = {r.kpi_name: r.kpi_value for r in serving.reorder_kpis(empty).collect()}
    assert list(values) == list(KPI_GROUPS["Reorder Decision"])
    assert values["buy_ratio"] is None and values["total_decision_rows"] == 0.0


def test_source_rules_find_planted_errors(spark):
    sources = Sources(
        spark,
        sku_master=[{}, {"sku_id": "S2", "default_vendor_id": "?"}],
        wms_inventory_snapshot=[dict(available_qty=4), dict(stockout_flag=1)],
        oms_sales_orders=[dict(fulfilled_qty=2), dict(cancelled_qty=2)],
        erp_purchase_orders=[dict(confirmed_qty=11)],
        wms_goods_receipts=[dict(received_qty=5), dict(po_id="lost")],
        md_promotion_calendar=[dict(promo_type="?")],
        sku_code_mapping=[*MAPPING, dict(source_system="?", source_sku_code="?")])
    assert dict(rows_of(quality.source_quality(sources), "rule", "violations")) == {
        "available_balance": 1, "stockout_flag_matches": 1, "some_stockout": 0,
        "fulfilled_within_ordered": 1, "cancelled_within_ordered": 1,
        "some_partial_fulfillment": 1, "confirmed_within_ordered": 1, "received_balance": 1,
        "promo_type_domain": 1, "source_system_domain": 1, "sku_vendor_reference": 1,
        "receipt_po_reference": 1, "vendor_outcomes_absent": 0}


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    with pytest.raises(ValueError, match="t is missing required columns: c, d"):
        contracts.require_columns(df, ["a", "c", "d"], "t")
    with pytest.raises(ValueError):
        contracts.require_unique(df, ["a"], "t")
    with pytest.raises(ValueError):
        contracts.require_rows(df.filter("a = 9"), "t")
    assert tuple(contracts.key_duplicates(df, ["a"], "t").first()) == ("t", 2, 1, 1)


def test_mapping_completeness(spark):
    got = quality.mapping_completeness(
        table(spark, "sku_master", [{}, {"sku_id": "S2"}]), table(spark, "sku_code_mapping", MAPPING))
    assert rows_of(got, "sku_id", "system_count", "complete_flag") == [("S1", 4, 1), ("S2", 0, 0)]


def test_sku_detail_takes_one_row(spark):
    df = table(spark, "sku_master", [{}, {}, {"sku_id": "S2", "launch_date": D("2025-01-01")}])
    assert serving.sku_detail(df).count() == 2
