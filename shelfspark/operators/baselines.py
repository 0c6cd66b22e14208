"""Rule predictions that the models are measured against, and the result tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    BASELINE_COVER_WEEKS, DEMAND_RESULT_COLUMNS, DEMAND_TARGET, FINAL_THRESHOLD,
    STOCKOUT_RESULT_COLUMNS,
)
from ..functions.columns import bounded, flag
from .splits import is_test


def with_demand_baseline(labelled: DataFrame, start: date) -> DataFrame:
    """Test rows with the four-week mean, or the median training demand without one.

    Demands are whole numbers, so the exact median keeps one counter per distinct
    quantity and merges these counters, not the rows.
    """
    test = labelled.filter(is_test(start))
    fallback = (
        labelled.filter(~is_test(start)).select(F.median(DEMAND_TARGET).alias("m")).scalar()
    )
    filled = test.withColumn("baseline_pred", F.coalesce("sales_rolling_mean_4w", fallback))
    return filled.withColumn("baseline_pred", bounded(F.col("baseline_pred"), 0.0))


def stockout_rule() -> Column:
    """Low cover or a recent stockout; unknown cover counts as ample."""
    low_cover = F.coalesce(F.col("inventory_cover_weeks") < BASELINE_COVER_WEEKS, F.lit(False))
    return flag(low_cover | (F.coalesce(F.col("stockout_days_last_4w"), F.lit(0)) > 0))


def with_stockout_baseline(labelled: DataFrame, start: date) -> DataFrame:
    return labelled.filter(is_test(start)).withColumn("baseline_risk_pred", stockout_rule())


def demand_result(scored: DataFrame) -> DataFrame:
    """Forecast table: needs baseline_pred and demand_pred; adds the errors."""
    error = F.col("demand_pred") - F.col(DEMAND_TARGET)
    actual = F.col(DEMAND_TARGET)
    return scored.withColumn("demand_pred", bounded(F.col("demand_pred"), 0.0)).withColumns({
        "error": error,
        "abs_error": F.abs(error),
        "ape": F.when(actual != 0, F.abs(error) / F.abs(actual.cast("double"))),
    }).select(*DEMAND_RESULT_COLUMNS)


def stockout_result(scored: DataFrame) -> DataFrame:
    """Risk table: needs stockout_risk_pred_proba and baseline_risk_pred; adds the label."""
    return scored.withColumn(
        "stockout_risk_pred_label",
        flag(F.col("stockout_risk_pred_proba") >= FINAL_THRESHOLD),
    ).select(*STOCKOUT_RESULT_COLUMNS)
