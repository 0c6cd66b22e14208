"""Promotion calendar to one promotion per SKU, channel and week."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import PROMO_PRIORITY_OTHER, PROMO_PRIORITY_RANK
from ..functions.columns import lookup, monday_of
from .grids import PlanningScope, mondays_between
from .mapping import map_codes

GRAIN = ["sku_id", "channel_id", "week_start_date"]


def promotion_candidates(
    calendar: DataFrame, mapping: DataFrame, skus: DataFrame, scope: PlanningScope
) -> DataFrame:
    """Every promotion in every week it touches, ranked within SKU, channel and week.

    A promotion touches the weeks from the Monday of its first day to the Monday of its
    last day, so it is exploded to those weeks; no range join is needed. Rank 1 is the
    best priority, then the deepest discount, then the smallest id.
    """
    mapped = map_codes(
        calendar.filter(F.col("channel_id").isin(*scope.channels)),
        mapping, "MD", "md_sku_code", "promo_start_date", "promo_end_date",
    ).join(skus.select("sku_id"), "sku_id", "left_semi")
    first = F.greatest(monday_of("promo_start_date"), scope.first)
    last = F.least(monday_of("promo_end_date"), scope.last)
    # Dates in the wrong order count while both touch the week, as a test on weeks has it.
    touched = monday_of("promo_start_date") <= monday_of("promo_end_date")
    weekly = mapped.filter(touched).select(
        "promotion_id", "sku_id", "channel_id",
        F.explode(mondays_between(first, last)).alias("week_start_date"),
        "promo_type", F.col("planned_discount_rate").alias("promo_depth"),
        "planned_promo_price", "promo_priority",
    )
    best_first = Window.partitionBy(*GRAIN).orderBy(
        lookup(F.col("promo_priority"), PROMO_PRIORITY_RANK, PROMO_PRIORITY_OTHER),
        F.col("promo_depth").desc_nulls_last(),
        "promotion_id",
    )
    return weekly.withColumn("promo_rank", F.row_number().over(best_first))


def promotion_weekly(
    calendar: DataFrame, mapping: DataFrame, skus: DataFrame, scope: PlanningScope
) -> DataFrame:
    """The winning promotion; Spark cuts each task to its own best row before the shuffle."""
    return (
        promotion_candidates(calendar, mapping, skus, scope)
        .filter(F.col("promo_rank") == 1)
        .select(*GRAIN, F.lit(1).alias("promo_flag"), "promo_type", "promo_depth",
                "planned_promo_price", "promo_priority")
    )
