"""Approved manual overrides to one rule per decision cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import KEY_COLUMNS
from ..functions.columns import blank_to_null, first_monday_on_or_after, monday_of
from .grids import PlanningScope, literal_array, mondays_between


def _in_scope(value: Column, everything) -> Column:
    """The named member, or every member when the rule leaves it blank."""
    return F.when(value.isNull(), literal_array(everything)).when(
        value.isin(*everything), F.array(value)
    ).otherwise(F.array().cast("array<string>"))


def override_candidates(
    overrides: DataFrame, skus: DataFrame, scope: PlanningScope
) -> DataFrame:
    """Each approved rule spread over the channels, centers and weeks it names.

    Blank channel or center means all of them, so the rule is exploded to the cells it
    covers instead of joined with an OR condition. Rank 1 is the newest, then the
    smallest id.
    """
    first = F.greatest(first_monday_on_or_after(F.to_date("effective_from")), scope.first)
    last = F.least(monday_of("effective_to"), scope.last)
    cells = (
        overrides.filter(F.col("approval_status") == "APPROVED")
        .join(skus.select("sku_id"), "sku_id", "left_semi")
        .withColumn("channel", F.explode(_in_scope(blank_to_null("channel_id"), scope.channels)))
        .withColumn("center", F.explode(_in_scope(blank_to_null("center_id"), scope.centers)))
        .select(
            "override_id", "sku_id", F.col("channel").alias("channel_id"),
            F.col("center").alias("center_id"),
            F.explode(mondays_between(first, last)).alias("week_start_date"),
            "override_type", "override_reason", "created_at",
        )
    )
    newest_first = Window.partitionBy(*KEY_COLUMNS).orderBy(
        F.col("created_at").desc_nulls_last(), "override_id"
    )
    return cells.withColumn("override_rank", F.row_number().over(newest_first)).drop("created_at")


def override_weekly(overrides: DataFrame, skus: DataFrame, scope: PlanningScope) -> DataFrame:
    return (
        override_candidates(overrides, skus, scope)
        .filter(F.col("override_rank") == 1)
        .select(*KEY_COLUMNS, F.lit(1).alias("manual_override_flag"), "override_type",
                "override_reason")
    )
