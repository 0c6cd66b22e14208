"""The feature table: the mart plus 27 features and two labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.contracts import require_columns
from ..operators.grids import PlanningScope
from ..operators.panel import (
    inventory_features, lag_features, product_features, promo_calendar_features, promo_uplift,
    rolling_features, sales_distortion, targets,
)
from ..operators.vendors import vendor_performance
from ..session import staged
from .mart import weekly_mart

VENDOR_PROFILE = [
    "standard_lead_time_days", "reliability_tier", "lead_time_profile", "fill_rate_profile",
]
NEEDED = [
    "sku_id", "channel_id", "center_id", "week_start_date", "default_vendor_id", "launch_date",
    "discontinue_date", "active_flag", "standard_lead_time_days", "ordered_qty_1w",
    "fulfilled_qty_1w", "partial_fulfillment_flag", "stockout_flag", "promo_flag",
    "available_qty", "inbound_qty_next_4w",
]
FEATURE_COLUMNS = [
    "observed_sales_qty", "demand_gap_qty", "sales_censored_flag", "stockout_adjusted_sales",
    "sales_lag_1w", "sales_lag_4w", "sales_rolling_mean_4w", "sales_rolling_std_4w",
    "demand_volatility_index", "stockout_adjusted_sales_rolling_mean_4w",
    "stockout_days_last_4w", "in_stock_rate_4w", "sales_history_weeks",
    "historical_promo_uplift", "promo_duration_days", "promo_days_in_week", "promo_day_index",
    "vendor_avg_lead_time", "vendor_lead_time_std", "po_fill_rate", "on_time_delivery_rate",
    "inventory_position_qty", "inventory_cover_weeks", "safety_stock_qty", "order_block_flag",
    "product_age_weeks", "new_product_flag", "target_demand_next_1w",
    "target_stockout_risk_next_2w",
]


def default_vendors(skus: DataFrame, vendors: DataFrame) -> DataFrame:
    """The vendors some SKU names as its default, with their delivery profile."""
    named = skus.select(F.col("default_vendor_id").alias("vendor_id")).distinct()
    return named.join(vendors.select("vendor_id", *VENDOR_PROFILE), "vendor_id", "left")


def vendor_features(sources, scope: PlanningScope, keep=lambda performance: performance) -> DataFrame:
    """Vendor performance brought to SKU and week.

    Joining vendors to SKUs here keeps the join on the small side: the panel then joins
    on its own SKU partitioning instead of being shuffled by vendor. ``keep`` may store the
    performance, a row per vendor and week, so that the lines it is summed from leave the disk.
    """
    skus = sources.sku_master
    performance = keep(vendor_performance(
        default_vendors(skus, sources.vendor_master),
        sources.erp_purchase_orders, sources.wms_goods_receipts, scope,
    ))
    return (
        skus.select("sku_id", F.col("default_vendor_id").alias("vendor_id"))
        .join(performance, "vendor_id")
        .drop("vendor_id")
    )


def add_features(mart: DataFrame, vendor_weeks: DataFrame) -> DataFrame:
    """All features and labels on a mart that covers every week of every series."""
    require_columns(mart, NEEDED, "weekly mart")
    df = rolling_features(lag_features(sales_distortion(mart)))
    df = targets(df)
    df = promo_calendar_features(promo_uplift(df))
    df = df.join(vendor_weeks, ["sku_id", "week_start_date"], "left")
    df = product_features(inventory_features(df))
    return df.select(*mart.columns, *FEATURE_COLUMNS)


def feature_table(sources, scope: PlanningScope) -> DataFrame:
    vendor_weeks = vendor_features(sources, scope, lambda performance: staged(performance, "vendor-weeks"))
    return add_features(weekly_mart(sources, scope), vendor_weeks)
