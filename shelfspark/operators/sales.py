"""Order lines to weekly sales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import KEY_COLUMNS
from ..functions.columns import monday_of
from .mapping import map_codes


def mapped_sales(orders: DataFrame, mapping: DataFrame) -> DataFrame:
    """Order lines with their SKU and the Monday of their week."""
    return map_codes(orders, mapping, "OMS", "oms_sku_code", "order_datetime").select(
        "order_line_id",
        "sku_id",
        "channel_id",
        F.col("fulfillment_center_id").alias("center_id"),
        monday_of("order_datetime").alias("week_start_date"),
        "ordered_qty",
        "fulfilled_qty",
        "cancelled_qty",
        "unit_selling_price",
    )


def sales_weekly(orders: DataFrame, mapping: DataFrame) -> DataFrame:
    """Weekly sums per SKU, channel and center.

    Lines meet the mapping as they are and are summed once: the few columns of a line are shuffled at most as often
    as the mapping is too large to broadcast, and the sums of each task once.
    """
    lines = orders.select(
        "oms_sku_code",
        "channel_id",
        F.col("fulfillment_center_id").alias("center_id"),
        F.to_date("order_datetime").alias("order_day"),
        "ordered_qty",
        "fulfilled_qty",
        "cancelled_qty",
        "unit_selling_price",
    )
    return (
        map_codes(lines, mapping, "OMS", "oms_sku_code", "order_day")
        .withColumn("week_start_date", monday_of("order_day"))
        .groupBy(*KEY_COLUMNS)
        .agg(
            F.sum("ordered_qty").alias("ordered_qty_1w"),
            F.sum("fulfilled_qty").alias("fulfilled_qty_1w"),
            F.sum("cancelled_qty").alias("cancelled_qty_1w"),
            F.try_divide(F.sum("unit_selling_price"), F.count("unit_selling_price"))
            .alias("avg_selling_price"),
            F.count(F.lit(1)).alias("order_line_count"),
            F.coalesce(F.max((F.col("fulfilled_qty") < F.col("ordered_qty")).cast("int")), F.lit(0))
            .alias("partial_fulfillment_flag"),
        )
    )
