"""Vendor delivery performance from purchase orders completed before each weekly cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import (
    FILL_RATE_PROXY, LEAD_TIME_STD_PROXY, ON_TIME_PROXY, SNAPSHOT_HOUR,
)
from ..functions.columns import bounded, flag, known, week_floor_of_cutoff
from .grids import PlanningScope, vendor_grid

LINE = ["po_id", "po_line_id"]


def receipt_summary(receipts: DataFrame) -> DataFrame:
    """Accepted quantity and last receipt time per PO line."""
    return receipts.groupBy(*LINE).agg(
        F.sum("accepted_qty").alias("accepted_qty"),
        F.max("receipt_datetime").alias("completion_datetime"),
    )


def completed_po_lines(orders: DataFrame, receipts: DataFrame) -> DataFrame:
    """PO lines whose accepted quantity reached the confirmed one, with their outcome."""
    done = F.to_date("completion_datetime")
    return (
        orders.join(receipt_summary(receipts), LINE, "left")
        .filter((F.col("confirmed_qty") > 0) & (F.col("accepted_qty") >= F.col("confirmed_qty"))
                & F.col("completion_datetime").isNotNull())
        .select(
            *LINE,
            "vendor_id",
            "completion_datetime",
            F.datediff(done, F.to_date("po_created_date")).alias("actual_lead_time_days"),
            bounded(F.try_divide(F.col("accepted_qty").cast("double"), F.col("ordered_qty")),
                    0.0, 1.0).alias("po_fill_rate"),
            flag(done <= F.to_date("promised_delivery_date")).alias("on_time_delivery"),
        )
    )


def vendor_performance(
    vendors: DataFrame, orders: DataFrame, receipts: DataFrame, scope: PlanningScope
) -> DataFrame:
    """Mean lead time, its deviation, fill rate and on-time rate per vendor and week.

    ``vendors`` holds vendor_id, standard_lead_time_days and the three profile columns.
    Each completed line is added to the first week whose cutoff lies after it; moments
    are summed per vendor and week on the map side and then run up over the weeks, so
    no line is paired with more than one week. Vendors without history get the proxies;
    a profile without a proxy fails the job, a vendor without a profile gets NULL.
    """
    lead = F.col("actual_lead_time_days").cast("long")
    counted = F.greatest(
        week_floor_of_cutoff(F.col("completion_datetime"), SNAPSHOT_HOUR), scope.first
    )
    moments = ["n", "lead", "lead_sq", "filled", "filled_n", "on_time"]
    weekly = (
        completed_po_lines(orders, receipts)
        .groupBy("vendor_id", counted.alias("week_start_date"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(lead).alias("lead"),
            F.sum(lead * lead).alias("lead_sq"),
            F.sum("po_fill_rate").alias("filled"),
            F.count("po_fill_rate").alias("filled_n"),
            F.sum("on_time_delivery").alias("on_time"),
        )
    )
    so_far = (
        Window.partitionBy("vendor_id").orderBy("week_start_date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    history = vendor_grid(vendors, scope).join(
        weekly, ["vendor_id", "week_start_date"], "left"
    ).select(
        "*", *[F.coalesce(F.sum(name).over(so_far), F.lit(0)).alias(f"past_{name}")
               for name in moments],
    )
    n = F.col("past_n").cast("double")
    # Lead times are whole days, so both moments and their difference are exact.
    spread = F.sqrt((F.col("past_n") * F.col("past_lead_sq")
                     - F.col("past_lead") * F.col("past_lead")).cast("double")) / n
    seen = F.col("past_n") > 0
    return history.select(
        "vendor_id",
        "week_start_date",
        F.when(seen, F.col("past_lead") / n)
        .otherwise(F.col("standard_lead_time_days").cast("double")).alias("vendor_avg_lead_time"),
        F.when(F.col("past_n") >= 2, spread)
        .otherwise(known(F.col("lead_time_profile"), LEAD_TIME_STD_PROXY, "lead_time_profile"))
        .alias("vendor_lead_time_std"),
        F.when(seen, F.try_divide(F.col("past_filled"), F.col("past_filled_n")))
        .otherwise(known(F.col("fill_rate_profile"), FILL_RATE_PROXY, "fill_rate_profile")).alias("po_fill_rate"),
        F.when(seen, F.col("past_on_time") / n)
        .otherwise(known(F.col("reliability_tier"), ON_TIME_PROXY, "reliability_tier"))
        .alias("on_time_delivery_rate"),
    )
