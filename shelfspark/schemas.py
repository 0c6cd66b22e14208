"""Declared schemas of the nine source tables. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql.types import StructType

# --- fixed values: source columns and types ------------------------------
_DDL = {
    "sku_master": """
        sku_id string, sku_name string, category_l1 string, category_l2 string, brand string,
        default_vendor_id string, launch_date date, discontinue_date date, unit_cost double,
        list_price double, gross_margin_rate double, shelf_life_days bigint,
        base_weekly_demand bigint, demand_volatility_tier string, moq_qty bigint,
        order_multiple bigint, min_order_amount double, active_flag int""",
    "vendor_master": """
        vendor_id string, vendor_name string, vendor_country string, import_flag int,
        standard_lead_time_days bigint, order_cycle_days bigint, payment_terms string,
        supply_region string, reliability_tier string, lead_time_profile string,
        fill_rate_profile string, vendor_active_flag int""",
    "sku_code_mapping": """
        sku_id string, source_system string, source_sku_code string, effective_from date,
        effective_to date, mapping_status string""",
    "oms_sales_orders": """
        order_id string, order_line_id string, order_datetime timestamp_ntz, channel_id string,
        fulfillment_center_id string, oms_sku_code string, ordered_qty bigint,
        fulfilled_qty bigint, cancelled_qty bigint, unit_selling_price double,
        order_status string""",
    "wms_inventory_snapshot": """
        snapshot_datetime timestamp_ntz, center_id string, wms_sku_code string,
        on_hand_qty bigint, reserved_qty bigint, damaged_qty bigint, quality_hold_qty bigint,
        available_qty bigint, stockout_flag int""",
    "erp_purchase_orders": """
        po_id string, po_line_id string, po_created_date date, vendor_id string,
        erp_sku_code string, center_id string, ordered_qty bigint, confirmed_qty bigint,
        promised_delivery_date date, po_status string, cancelled_qty bigint,
        last_updated_at timestamp_ntz""",
    "wms_goods_receipts": """
        receipt_id string, receipt_line_id string, po_id string, po_line_id string,
        receipt_datetime timestamp_ntz, center_id string, wms_sku_code string,
        received_qty bigint, accepted_qty bigint, rejected_qty bigint, receipt_status string""",
    "md_promotion_calendar": """
        promotion_id string, md_sku_code string, channel_id string, promo_type string,
        promo_start_date date, promo_end_date date, planned_discount_rate double,
        planned_promo_price double, promo_priority string, calendar_updated_at timestamp_ntz""",
    "manual_overrides": """
        override_id string, sku_id string, channel_id string, center_id string,
        effective_from date, effective_to date, override_type string, override_value string,
        override_reason string, created_at timestamp_ntz, created_by string,
        approval_status string""",
}

SOURCE_TABLES = list(_DDL)


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(" ".join(_DDL[table].split()))
