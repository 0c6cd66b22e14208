"""Tiny hand-written source tables, one trap per test."""

from __future__ import annotations

from datetime import date, datetime

from shelfspark.operators.grids import PlanningScope
from shelfspark.schemas import schema_of

D, TS = date.fromisoformat, datetime.fromisoformat

SCOPE = PlanningScope(("A", "B"), ("C1", "C2"), "2025-01-06", "2025-03-31")

DEFAULTS = {
    "sku_master": dict(
        sku_id="S1", category_l1="c1", category_l2="c2", brand="b", default_vendor_id="V1",
        launch_date=D("2024-12-02"), unit_cost=10.0, list_price=20.0, gross_margin_rate=0.5,
        shelf_life_days=100, moq_qty=1, order_multiple=1, min_order_amount=0.0, active_flag=1),
    "vendor_master": dict(
        vendor_id="V1", vendor_country="x", import_flag=0, standard_lead_time_days=14,
        order_cycle_days=7, payment_terms="NET30", supply_region="r", reliability_tier="HIGH",
        lead_time_profile="STABLE", fill_rate_profile="LOW", vendor_active_flag=1),
    "sku_code_mapping": dict(
        sku_id="S1", effective_from=D("2020-01-01"), mapping_status="VALID"),
    "oms_sales_orders": dict(
        order_id="O", channel_id="A", fulfillment_center_id="C1", oms_sku_code="OMS-1",
        ordered_qty=1, fulfilled_qty=1, cancelled_qty=0, unit_selling_price=5.0,
        order_status="COMPLETED"),
    "wms_inventory_snapshot": dict(
        center_id="C1", wms_sku_code="WMS-1", on_hand_qty=5, reserved_qty=0, damaged_qty=0,
        quality_hold_qty=0, available_qty=5, stockout_flag=0),
    "erp_purchase_orders": dict(
        po_id="P1", po_line_id="1", po_created_date=D("2025-01-01"), vendor_id="V1",
        erp_sku_code="ERP-1", center_id="C1", ordered_qty=10, confirmed_qty=10,
        promised_delivery_date=D("2025-01-20"), po_status="Open", cancelled_qty=0),
    "wms_goods_receipts": dict(
        receipt_id="R1", receipt_line_id="1", po_id="P1", po_line_id="1", center_id="C1",
        wms_sku_code="WMS-1", received_qty=1, accepted_qty=1, rejected_qty=0,
        receipt_status="RECEIVED"),
    "md_promotion_calendar": dict(
        promotion_id="P", md_sku_code="MD-1", channel_id="A", promo_type="COUPON",
        promo_start_date=D("2025-01-13"), promo_end_date=D("2025-01-19"),
        planned_discount_rate=0.1, planned_promo_price=9.0, promo_priority="LOW"),
    "manual_overrides": dict(
        override_id="X", sku_id="S1", effective_from=D("2025-01-13"),
        effective_to=D("2025-01-19"), override_type="FORCE_HOLD", override_reason="why",
        created_at=TS("2025-01-01T09:00:00"), approval_status="APPROVED"),
}

MAPPING = [
    dict(source_system=system, source_sku_code=f"{system}-1")
    for system in ("OMS", "WMS", "ERP", "MD")
]


def table(spark, name: str, rows=()):
    schema = schema_of(name)
    values = [
        tuple({**DEFAULTS[name], **row}.get(field) for field in schema.fieldNames())
        for row in rows
    ]
    return spark.createDataFrame(values, schema)


class Sources:
    """Source tables given by keyword; the others are minimal or empty."""

    def __init__(self, spark, scope=SCOPE, **rows):
        self.spark, self.scope = spark, scope
        rows = {"sku_master": [{}], "vendor_master": [{}], "sku_code_mapping": MAPPING, **rows}
        for name in DEFAULTS:
            setattr(self, name, table(spark, name, rows.get(name, [])))


def rows_of(df, *columns):
    out = [tuple(row) for row in df.select(*columns).collect()]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))
