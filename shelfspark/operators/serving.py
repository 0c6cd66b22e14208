"""KPI table and the five dashboard tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    ACTION_PRIORITY, DEMAND_RESULT_COLUMNS, FINAL_THRESHOLD, HIGH_APE, HIGH_RISK, KPI_COLUMNS,
    KPI_GROUPS, MEDIUM_RISK, REORDER_COLUMNS, SKU_DETAIL_COLUMNS, STOCKOUT_BASELINE_NAME,
    STOCKOUT_RESULT_COLUMNS, STOCKOUT_TARGET,
)
from ..functions.columns import as_number, flag, lookup, ratio
from .contracts import require_columns


def is_baseline(name: str = "model_name") -> Column:
    """Does a name contain "baseline" in any case? A missing name does not."""
    return F.coalesce(F.lower(name).contains("baseline"), F.lit(False))


def is_final_threshold(name: str = "threshold") -> Column:
    """Tolerant float comparison with the threshold in use."""
    distance = F.abs(as_number(name) - FINAL_THRESHOLD)
    return F.coalesce(distance <= 1e-8 + 1e-5 * FINAL_THRESHOLD, F.lit(False))


def _long_form(one_row: DataFrame, group: str) -> DataFrame:
    texts = KPI_GROUPS[group]
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(group).alias("kpi_group"), F.lit(name).alias("kpi_name"),
                 F.col(name).cast("double").alias("kpi_value"), F.lit(text).alias("description"))
        for name, text in texts.items()
    ])))


def _pick(condition: Column, column: str) -> Column:
    return F.max(F.when(condition, F.col(column)))


def demand_kpis(metrics: DataFrame) -> DataFrame:
    require_columns(metrics, ["model_name", "wape", "bias", "forecast_accuracy"], "demand metrics")
    base = is_baseline()
    picked = metrics.agg(*[
        _pick(base if side == "baseline" else ~base, column).alias(f"{side}_{column}")
        for side in ("model", "baseline") for column in ("wape", "bias", "forecast_accuracy")
    ])
    gain = (F.col("baseline_wape") - F.col("model_wape")) * 100
    return _long_form(picked.withColumn("wape_improvement_pp", gain), "Demand Forecast")


def stockout_kpis(metrics: DataFrame) -> DataFrame:
    columns = ["precision", "recall", "f1", "pr_auc", "roc_auc", "false_negative"]
    require_columns(metrics, ["model_name", "threshold", *columns], "stockout metrics")
    model = ~is_baseline() & is_final_threshold()
    base = F.col("model_name") == STOCKOUT_BASELINE_NAME
    names = {
        **{f"model_{column}": (model, column) for column in columns[:5]},
        **{f"baseline_{column}": (base, column) for column in columns[:4]},
        "false_negative_model": (model, "false_negative"),
        "false_negative_baseline": (base, "false_negative"),
    }
    return _long_form(
        metrics.agg(*[_pick(*source).alias(name) for name, source in names.items()]),
        "Stockout Risk",
    )


def reorder_kpis(decisions: DataFrame) -> DataFrame:
    require_columns(decisions, ["recommended_action", "recommended_order_qty"], "decisions")
    qty = as_number("recommended_order_qty")
    actions = ["buy", "hold", "expedite", "reduce"]
    totals = decisions.agg(
        F.count(F.lit(1)).alias("total_decision_rows"),
        F.coalesce(F.sum(qty), F.lit(0.0)).alias("total_recommended_order_qty"),
        F.avg(qty).alias("avg_recommended_order_qty"),
        F.max(qty).alias("max_recommended_order_qty"),
        *[F.count_if(F.col("recommended_action") == name.upper()).alias(f"{name}_count")
          for name in actions],
    )
    shares = {f"{name}_ratio": ratio(F.col(f"{name}_count"), F.col("total_decision_rows"))
              for name in actions}
    return _long_form(totals.withColumns(shares), "Reorder Decision")


def kpi_summary(demand: DataFrame, stockout: DataFrame, decisions: DataFrame) -> DataFrame:
    """Thirty KPIs in long form."""
    return (
        demand_kpis(demand).unionByName(stockout_kpis(stockout))
        .unionByName(reorder_kpis(decisions)).select(*KPI_COLUMNS)
    )


def risk_bucket(probability: str = "stockout_risk_pred_proba") -> Column:
    p = as_number(probability)
    return F.when(p >= HIGH_RISK, "HIGH").when(p >= MEDIUM_RISK, "MEDIUM").otherwise("LOW")


def export_overview(kpis: DataFrame) -> DataFrame:
    return require_columns(kpis, KPI_COLUMNS, "KPI summary").select(*KPI_COLUMNS)


def export_demand(result: DataFrame) -> DataFrame:
    require_columns(result, DEMAND_RESULT_COLUMNS, "demand result")
    error = as_number("error")
    return result.select(
        *DEMAND_RESULT_COLUMNS,
        F.when(error > 0, "OVER_FORECAST").when(error < 0, "UNDER_FORECAST").otherwise("EXACT")
        .alias("forecast_error_direction"),
        flag(as_number("ape") >= HIGH_APE).alias("high_ape_flag"),
    )


def export_stockout(result: DataFrame) -> DataFrame:
    require_columns(result, STOCKOUT_RESULT_COLUMNS, "stockout result")
    actual, predicted = as_number(STOCKOUT_TARGET), as_number("stockout_risk_pred_label")
    right = F.when(actual == predicted, "TRUE").otherwise("FALSE")
    kind = F.when(predicted == 1, "POSITIVE").otherwise("NEGATIVE")
    known = actual.isin(0.0, 1.0) & predicted.isin(0.0, 1.0)
    return result.select(
        *STOCKOUT_RESULT_COLUMNS,
        risk_bucket().alias("risk_bucket"),
        F.when(known, F.concat_ws("_", right, kind)).otherwise("UNKNOWN")
        .alias("prediction_result"),
    )


def export_reorder(decisions: DataFrame) -> DataFrame:
    require_columns(decisions, REORDER_COLUMNS, "decisions")
    amount = (F.coalesce(as_number("recommended_order_qty"), F.lit(0.0))
              * F.coalesce(as_number("unit_cost"), F.lit(0.0)))
    return decisions.select(
        *REORDER_COLUMNS,
        lookup(F.col("recommended_action"), ACTION_PRIORITY).alias("action_priority"),
        amount.alias("estimated_order_amount"),
        risk_bucket().alias("risk_bucket"),
    )


def sku_detail(features: DataFrame) -> DataFrame:
    """One row per SKU. The attributes do not vary within a SKU, so any row will do;
    the smallest is taken to be definite."""
    require_columns(features, SKU_DETAIL_COLUMNS, "feature table")
    rest = [name for name in SKU_DETAIL_COLUMNS if name != "sku_id"]
    return (
        features.groupBy("sku_id").agg(F.min(F.struct(*rest)).alias("row"))
        .select("sku_id", "row.*")
    )
