"""Labelled modelling rows and the time-based hold-out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    CATEGORICAL_FEATURES, COVER_CAP_WEEKS, HOLDOUT_WEEKS, KEY_COLUMNS, MISSING_CATEGORY,
    NUMERIC_FEATURES,
)
from ..functions.columns import as_number, bounded
from .contracts import forbid_features, require_columns


def labelled_rows(features: DataFrame, target: str) -> DataFrame:
    """Rows with a known label; cover capped; features as doubles and filled text.

    The cap belongs to the models and their output only. Decisions read the uncapped
    cover from the feature table.
    """
    forbid_features(NUMERIC_FEATURES + CATEGORICAL_FEATURES)
    require_columns(features, [*KEY_COLUMNS, *NUMERIC_FEATURES, *CATEGORICAL_FEATURES, target,
                               "stockout_flag"], "feature table")
    return features.filter(F.col(target).isNotNull()).withColumn(
        "inventory_cover_weeks",
        bounded(as_number("inventory_cover_weeks"), high=float(COVER_CAP_WEEKS)),
    )


def model_inputs(labelled: DataFrame) -> DataFrame:
    """Numeric features as doubles, categories as text with a name for the missing ones."""
    numeric = {f"num_{name}": as_number(name) for name in NUMERIC_FEATURES}
    text = {
        f"cat_{name}": F.coalesce(F.col(name).cast("string"), F.lit(MISSING_CATEGORY))
        for name in CATEGORICAL_FEATURES
    }
    return labelled.withColumns({**numeric, **text})


def non_binary_labels(labelled: DataFrame, target: str) -> DataFrame:
    return labelled.filter(~F.col(target).isin(0, 1)).limit(1)


def holdout_start(labelled: DataFrame, weeks: int = HOLDOUT_WEEKS) -> date:
    """First Monday of the last ``weeks`` labelled weeks.

    Only that many dates reach the driver; as a literal, the split then prunes week
    partitions at the scan.
    """
    latest = (
        labelled.select("week_start_date").distinct()
        .orderBy(F.col("week_start_date").desc()).limit(weeks + 1).collect()
    )
    if len(latest) <= weeks:
        raise ValueError(f"at least {weeks + 1} labelled weeks are needed, found {len(latest)}")
    return latest[weeks - 1][0]


def is_test(start: date):
    return F.col("week_start_date") >= F.lit(start)


def split_metadata(labelled: DataFrame, start: date) -> DataFrame:
    """One row: sizes and week ranges of both parts."""
    test = is_test(start)
    week = F.col("week_start_date")
    return labelled.agg(
        F.count_if(~test).alias("train_rows"),
        F.count_if(test).alias("test_rows"),
        *[
            F.date_format(pick(F.when(part, week)), "yyyy-MM-dd").alias(f"{name}_week_{edge}")
            for name, part in (("train", ~test), ("test", test))
            for edge, pick in (("min", F.min), ("max", F.max))
        ],
    )


def split_weeks(labelled: DataFrame, start: date) -> DataFrame:
    """Each labelled week, its part and its rows."""
    return (
        labelled.groupBy("week_start_date").agg(F.count(F.lit(1)).alias("row_count"))
        .select("week_start_date",
                F.when(is_test(start), "test").otherwise("train").alias("split"), "row_count")
    )
