"""Forecast and classification metrics, each in one pass over the predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    DEFAULT_THRESHOLD, DEMAND_BASELINE_NAME, DEMAND_METRIC_COLUMNS, DEMAND_MODEL_NAME,
    DEMAND_TARGET, FINAL_THRESHOLD, KEY_COLUMNS, SPLIT_NAME, STOCKOUT_BASELINE_NAME,
    STOCKOUT_METRIC_COLUMNS, STOCKOUT_MODEL_NAME, STOCKOUT_TARGET,
)
from .ranking import score_histogram, threshold_metrics


def regression_metrics(rows: DataFrame, actual: str, predicted: str, by=()) -> DataFrame:
    """MAE, RMSE, WAPE, bias and 1 - WAPE per group; the last three NULL at zero demand."""
    error = F.col(predicted) - F.col(actual)
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.abs(error)).alias("abs_error"),
        F.sum(error * error).alias("squared_error"),
        F.sum(error).alias("signed_error"),
        F.sum(F.col(actual).cast("double")).alias("total"),
    )

    def share(value: str) -> Column:
        return F.when(F.col("total") != 0, F.col(value) / F.col("total"))

    return sums.select(
        *by,
        F.try_divide("abs_error", "n").alias("mae"),
        F.sqrt(F.try_divide("squared_error", "n")).alias("rmse"),
        share("abs_error").alias("wape"),
        share("signed_error").alias("bias"),
        (1 - share("abs_error")).alias("forecast_accuracy"),
    )


def demand_metrics(predictions: DataFrame, metadata: DataFrame,
                   model_name: str = DEMAND_MODEL_NAME) -> DataFrame:
    """One row for the model and one for the baseline, with the split they share."""
    candidates = F.array(
        F.struct(F.lit(model_name).alias("model_name"), F.col("demand_pred").alias("predicted")),
        F.struct(F.lit(DEMAND_BASELINE_NAME).alias("model_name"),
                 F.col("baseline_pred").alias("predicted")),
    )
    rows = predictions.select(F.col(DEMAND_TARGET).alias("actual"), F.inline(candidates))
    return _with_metadata(
        regression_metrics(rows, "actual", "predicted", ["model_name"]), metadata
    ).select(*DEMAND_METRIC_COLUMNS)


def _with_metadata(metrics: DataFrame, metadata: DataFrame) -> DataFrame:
    """Attach the one metadata row through a constant key."""
    return (
        metrics.withColumn("split", F.lit(SPLIT_NAME))
        .join(metadata.withColumn("split", F.lit(SPLIT_NAME)), "split")
    )


def confusion_counts(rows: DataFrame, label: str, predicted: str, by=()) -> DataFrame:
    y, p = F.col(label), F.col(predicted)
    return rows.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("true_negative"),
        F.count_if((y == 0) & (p == 1)).alias("false_positive"),
        F.count_if((y == 1) & (p == 0)).alias("false_negative"),
        F.count_if((y == 1) & (p == 1)).alias("true_positive"),
    )


def classification_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 where undefined) and both positive rates."""
    tn, fp, fn, tp = (F.col(name) for name in
                      ("true_negative", "false_positive", "false_negative", "true_positive"))

    def rate(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))

    everything = tn + fp + fn + tp
    return counts.withColumns({
        "accuracy": rate(tp + tn, everything),
        "precision": rate(tp, tp + fp),
        "recall": rate(tp, tp + fn),
        "f1": rate(2 * tp, 2 * tp + fp + fn),
        "positive_rate_actual": rate(tp + fn, everything),
        "positive_rate_pred": rate(tp + fp, everything),
    })


def stockout_metrics(predictions: DataFrame, metadata: DataFrame,
                     model_name: str = STOCKOUT_MODEL_NAME) -> DataFrame:
    """The model at two thresholds and the rule baseline, from one histogram of scores."""
    rows = predictions.select(
        F.col(STOCKOUT_TARGET).alias("label"),
        F.inline(F.array(
            F.struct(F.lit(model_name).alias("model_name"),
                     F.col("stockout_risk_pred_proba").cast("double").alias("score")),
            F.struct(F.lit(STOCKOUT_BASELINE_NAME).alias("model_name"),
                     F.col("baseline_risk_pred").cast("double").alias("score")),
        )))
    # The rule's score is its label, so it is cut at 1 and names no threshold.
    cuts = {str(DEFAULT_THRESHOLD): DEFAULT_THRESHOLD, str(FINAL_THRESHOLD): FINAL_THRESHOLD,
            "label": 1.0}
    found = threshold_metrics(
        score_histogram(rows, "label", "score", ["model_name"]), cuts, ["model_name"]
    ).filter((F.col("model_name") == STOCKOUT_BASELINE_NAME) == (F.col("at") == "label"))
    at = F.when(F.col("at") != "label", F.col("at").cast("double"))
    return _with_metadata(
        classification_rates(found.withColumn("threshold", at)), metadata
    ).select(*STOCKOUT_METRIC_COLUMNS)


def leakage_audit(predictions: DataFrame, features: DataFrame) -> DataFrame:
    """Is this week's stockout flag alone as good as the model? Metrics side by side."""
    flags = features.select(*KEY_COLUMNS, "stockout_flag")
    rows = predictions.join(flags, KEY_COLUMNS, "left").select(
        F.col(STOCKOUT_TARGET).alias("label"),
        F.inline(F.array(
            F.struct(F.lit("stockout_flag").alias("predictor"),
                     F.coalesce(F.col("stockout_flag"), F.lit(0)).cast("double").alias("score")),
            F.struct(F.lit("model").alias("predictor"),
                     F.col("stockout_risk_pred_proba").cast("double").alias("score")),
        )),
    )
    # The flag is cut at 1, the model where its label is.
    cuts = {"stockout_flag": 1.0, "model": FINAL_THRESHOLD}
    found = threshold_metrics(
        score_histogram(rows, "label", "score", ["predictor"]), cuts, ["predictor"])
    return classification_rates(found.filter("predictor = at").drop("at"))


def target_rate_by_flag(predictions: DataFrame, features: DataFrame) -> DataFrame:
    """Rows and share of positive labels per value of this week's stockout flag."""
    return (
        predictions.join(features.select(*KEY_COLUMNS, "stockout_flag"), KEY_COLUMNS, "left")
        .groupBy("stockout_flag")
        .agg(F.count(F.lit(1)).alias("row_count"),
             F.avg(F.col(STOCKOUT_TARGET).cast("double")).alias("target_rate"))
    )


def feature_quality(features: DataFrame) -> DataFrame:
    """Counts that tell whether a feature table came out complete."""
    return features.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(DEMAND_TARGET).alias("demand_label_count"),
        F.count(STOCKOUT_TARGET).alias("stockout_label_count"),
        F.sum("stockout_adjusted_sales").alias("stockout_adjusted_sales_sum"),
        F.count_if(F.col("sales_lag_1w").isNull()).alias("sales_lag_1w_null_count"),
        F.count_if(F.col("inventory_cover_weeks").isNull())
        .alias("inventory_cover_weeks_null_count"),
    )
