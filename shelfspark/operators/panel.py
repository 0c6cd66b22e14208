"""Point-in-time features and future labels over the dense weekly panel.

All series windows share one partitioning and order, so Spark sorts the panel once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import (
    DEMAND_TARGET, NEW_PRODUCT_WEEKS, SERIES_COLUMNS, STOCKOUT_TARGET, UPLIFT_DEFAULT, UPLIFT_MAX,
    UPLIFT_MIN,
)
from ..functions.columns import bounded, flag, larger_if_known, ratio


def _series():
    return Window.partitionBy(*SERIES_COLUMNS).orderBy("week_start_date")


def _past_4():
    return _series().rowsBetween(-4, -1)


def sales_distortion(df: DataFrame) -> DataFrame:
    """Observed sales, the demand that was not served, and a censoring flag."""
    return df.withColumns({
        "observed_sales_qty": F.col("fulfilled_qty_1w"),
        "demand_gap_qty": bounded(F.col("ordered_qty_1w") - F.col("fulfilled_qty_1w"), 0),
        "sales_censored_flag": flag(
            (F.col("partial_fulfillment_flag") == 1) | (F.col("stockout_flag") == 1)
        ),
    }).withColumn("stockout_adjusted_sales", F.col("observed_sales_qty") + F.col("demand_gap_qty"))


def lag_features(df: DataFrame) -> DataFrame:
    """Sales one and four weeks ago, and the number of weeks of history."""
    return df.withColumns({
        "sales_lag_1w": F.lag("observed_sales_qty", 1).over(_series()),
        "sales_lag_4w": F.lag("observed_sales_qty", 4).over(_series()),
        "sales_history_weeks": F.row_number().over(_series()) - 1,
    })


def rolling_features(df: DataFrame) -> DataFrame:
    """Mean, deviation and stockout count over up to four previous weeks."""
    df = df.withColumns({
        "sales_rolling_mean_4w": F.avg("observed_sales_qty").over(_past_4()),
        "sales_rolling_std_4w": F.stddev_pop("observed_sales_qty").over(_past_4()),
        "stockout_adjusted_sales_rolling_mean_4w":
            F.avg("stockout_adjusted_sales").over(_past_4()),
        "stockout_days_last_4w": F.coalesce(F.sum("stockout_flag").over(_past_4()), F.lit(0)),
    })
    return df.withColumns({
        "demand_volatility_index":
            ratio(F.col("sales_rolling_std_4w"), F.col("sales_rolling_mean_4w")),
        "in_stock_rate_4w": bounded(1.0 - F.col("stockout_days_last_4w") / 4.0, 0.0, 1.0),
    })


def promo_uplift(df: DataFrame) -> DataFrame:
    """Mean promoted over mean regular sales of the SKU in all earlier weeks.

    A range frame over the week number sums every channel and center of the earlier
    weeks in one pass; no aggregate has to be joined back to the panel.
    """
    earlier = (
        Window.partitionBy("sku_id").orderBy(F.unix_date("week_start_date"))
        .rangeBetween(Window.unboundedPreceding, -1)
    )

    def past_mean(promoted: int) -> Column:
        taken = F.col("promo_flag") == promoted
        return ratio(
            F.sum(F.when(taken, F.col("stockout_adjusted_sales")).otherwise(0)).over(earlier),
            F.sum(F.when(taken, 1).otherwise(0)).over(earlier),
        )

    df = df.withColumns({"_promo_mean": past_mean(1), "_regular_mean": past_mean(0)})
    uplift = F.coalesce(ratio(F.col("_promo_mean"), F.col("_regular_mean")), F.lit(UPLIFT_DEFAULT))
    return df.withColumn(
        "historical_promo_uplift", bounded(uplift, UPLIFT_MIN, UPLIFT_MAX)
    ).drop("_promo_mean", "_regular_mean")


def promo_calendar_features(df: DataFrame) -> DataFrame:
    """Duration fields that are constants while the mart carries no promotion dates."""
    return df.withColumns({
        "promo_duration_days": F.lit(0),
        "promo_days_in_week": F.when(F.col("promo_flag") == 1, 7).otherwise(0),
        "promo_day_index": F.lit(0),
    })


def inventory_features(df: DataFrame) -> DataFrame:
    """Inventory position, cover in weeks and safety stock."""
    lead_weeks = larger_if_known(
        F.col("standard_lead_time_days").cast("double"), F.lit(1.0)
    ) / F.lit(7.0)
    return df.withColumn(
        "inventory_position_qty", F.col("available_qty") + F.col("inbound_qty_next_4w")
    ).withColumns({
        "inventory_cover_weeks":
            ratio(F.col("inventory_position_qty"), F.col("sales_rolling_mean_4w")),
        "safety_stock_qty": F.col("sales_rolling_std_4w") * F.sqrt(lead_weeks),
    })


def product_features(df: DataFrame) -> DataFrame:
    """Order block and product age."""
    age = F.floor(F.datediff("week_start_date", "launch_date") / F.lit(7.0))
    return df.withColumns({
        "order_block_flag": flag(
            (F.col("active_flag") == 0)
            | F.coalesce(F.col("discontinue_date") <= F.col("week_start_date"), F.lit(False))
        ),
        "product_age_weeks": bounded(age, 0),
    }).withColumn("new_product_flag", flag(F.col("product_age_weeks") <= NEW_PRODUCT_WEEKS))


def targets(df: DataFrame) -> DataFrame:
    """Demand of the next week, and whether either of the next two weeks stocks out."""
    return df.withColumns({
        DEMAND_TARGET: F.lead("stockout_adjusted_sales", 1).over(_series()),
        STOCKOUT_TARGET: larger_if_known(
            F.lead("stockout_flag", 1).over(_series()), F.lead("stockout_flag", 2).over(_series())
        ),
    })
