"""Predictions to constrained order quantities and explained actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    ACTIONS, BUY_RISK, FINAL_THRESHOLD, KEY_COLUMNS, REASON_BLOCKED, REASON_BUY, REASON_EXPEDITE,
    REASON_HOLD, REASON_OVERRIDE_DEFAULT, REASON_OVERRIDE_EXPEDITE, REASON_OVERRIDE_HOLD,
    REASON_REDUCE, REDUCE_COVER_FACTOR, REDUCE_INBOUND_FACTOR, REDUCE_MIN_COVER, REDUCE_RISK,
    REORDER_COLUMNS,
)
from ..functions.columns import as_number, bounded, ceil_weeks
from .contracts import require_columns, unique_rows

ZERO_WHEN_MISSING = [
    "available_qty", "inbound_qty_next_1w", "inbound_qty_next_2w", "inbound_qty_next_4w",
    "safety_stock_qty", "standard_lead_time_days", "order_cycle_days", "open_po_qty",
    "overdue_po_qty", "moq_qty", "min_order_amount", "unit_cost", "active_flag",
    "order_block_flag", "manual_override_flag", "promo_flag",
]


def decision_inputs(features: DataFrame, demand: DataFrame, risk: DataFrame) -> DataFrame:
    """Feature rows that have both predictions; the cover stays uncapped.

    Keeping only rows with both is an inner join, so the predictions, which cover a few
    weeks, are joined with each other first. Both have one row per decision key, or the job
    fails.
    """
    require_columns(features, [*KEY_COLUMNS, *ZERO_WHEN_MISSING, "order_multiple",
                               "inventory_cover_weeks"], "feature table")
    risk_columns = ["stockout_risk_pred_proba", "stockout_risk_pred_label"]
    require_columns(demand, [*KEY_COLUMNS, "demand_pred"], "demand predictions")
    require_columns(risk, [*KEY_COLUMNS, *risk_columns], "stockout predictions")
    scored = (
        unique_rows(demand.select(*KEY_COLUMNS, "demand_pred"), KEY_COLUMNS, "demand predictions")
        .join(unique_rows(risk.select(*KEY_COLUMNS, *risk_columns), KEY_COLUMNS,
                          "stockout predictions"), KEY_COLUMNS)
        .filter(F.col("demand_pred").isNotNull() & F.col("stockout_risk_pred_proba").isNotNull())
    )
    return features.join(scored, KEY_COLUMNS)


def normalized_inputs(df: DataFrame) -> DataFrame:
    numbers = {name: F.coalesce(as_number(name), F.lit(0.0)) for name in ZERO_WHEN_MISSING}
    multiple = as_number("order_multiple")
    return df.withColumns({
        **numbers,
        "order_multiple": F.when(multiple > 0, multiple).otherwise(1.0),
        "inventory_cover_weeks": as_number("inventory_cover_weeks"),
        "demand_pred": bounded(as_number("demand_pred"), 0.0),
        "stockout_risk_pred_proba": bounded(as_number("stockout_risk_pred_proba"), 0.0, 1.0),
    })


def constrained_quantity(need: Column) -> Column:
    """Need raised to MOQ and minimum amount, then rounded up to the order multiple."""
    multiple = F.greatest(F.ceil("order_multiple"), F.lit(1))
    amount, cost = F.col("min_order_amount"), F.col("unit_cost")
    for_amount = F.when((amount > 0) & (cost > 0), F.ceil(amount / cost)).otherwise(0)
    lots = F.ceil(F.greatest(need, F.col("moq_qty"), for_amount.cast("double")) / multiple)
    return F.when(need > 0, (lots * multiple).cast("long")).otherwise(F.lit(0).cast("long"))


def order_constraints(inputs: DataFrame) -> DataFrame:
    """Target inventory, raw need and the executable quantity.

    The inventory position is recomputed from the filled inputs; the cover is not.
    """
    return (
        normalized_inputs(inputs)
        .withColumns({
            "lead_time_weeks": ceil_weeks(F.col("standard_lead_time_days")),
            "review_period_weeks": ceil_weeks(F.col("order_cycle_days")),
            "inventory_position_qty": F.col("available_qty") + F.col("inbound_qty_next_4w"),
        })
        .withColumn("target_cover_weeks", F.col("lead_time_weeks") + F.col("review_period_weeks"))
        .withColumn("target_inventory_qty",
                    F.col("demand_pred") * F.col("target_cover_weeks") + F.col("safety_stock_qty"))
        .withColumn("raw_order_need", bounded(
            F.col("target_inventory_qty") - F.col("inventory_position_qty"), 0.0))
        .withColumn("recommended_order_qty", constrained_quantity(F.col("raw_order_need")))
    )


def reorder_actions(constrained: DataFrame) -> DataFrame:
    """First matching tier wins; an unknown cover satisfies no cover test."""
    qty, risk = F.col("recommended_order_qty"), F.col("stockout_risk_pred_proba")
    cover, target = F.col("inventory_cover_weeks"), F.col("target_cover_weeks")
    overridden = F.col("manual_override_flag") == 1
    kind = F.upper(F.coalesce(F.col("override_type"), F.lit("")))
    said = F.btrim(F.coalesce(F.col("override_reason"), F.lit("")), F.lit(" \t\r\n\f\v"))
    said = F.when(said == "", F.lit(REASON_OVERRIDE_DEFAULT)).otherwise(said)

    tiers = [
        ((F.col("active_flag") == 0) | (F.col("order_block_flag") == 1),
         "HOLD", F.lit(REASON_BLOCKED)),
        (overridden & kind.isin("FORCE_HOLD", "BLOCK_BUY"),
         "HOLD", F.concat(F.lit(REASON_OVERRIDE_HOLD), said)),
        (overridden & (kind == "EXPEDITE"),
         "EXPEDITE", F.concat(F.lit(REASON_OVERRIDE_EXPEDITE), said)),
        ((risk >= FINAL_THRESHOLD) & (cover < F.col("lead_time_weeks"))
         & ((F.col("overdue_po_qty") > 0) | (F.col("open_po_qty") > 0)),
         "EXPEDITE", F.lit(REASON_EXPEDITE)),
        ((qty > 0) & ((risk >= BUY_RISK) | (cover < target)), "BUY", F.lit(REASON_BUY)),
        ((cover >= F.greatest(F.lit(REDUCE_MIN_COVER), target * REDUCE_COVER_FACTOR))
         & (risk < REDUCE_RISK) & (F.col("raw_order_need") == 0) & (F.col("open_po_qty") > 0)
         & (F.col("inbound_qty_next_4w") >= F.col("demand_pred") * REDUCE_INBOUND_FACTOR)
         & (F.col("promo_flag") == 0),
         "REDUCE", F.lit(REASON_REDUCE)),
    ]
    verdict = None
    for condition, action, reason in tiers:
        outcome = F.struct(F.lit(action).alias("action"), reason.alias("reason"))
        verdict = (F.when(condition, outcome) if verdict is None
                   else verdict.when(condition, outcome))
    verdict = verdict.otherwise(
        F.struct(F.lit("HOLD").alias("action"), F.lit(REASON_HOLD).alias("reason")))
    return (
        constrained.withColumn("_verdict", verdict)
        .withColumns({
            "recommended_action": F.col("_verdict.action"),
            "action_reason": F.col("_verdict.reason"),
            "recommended_order_qty":
                F.when(F.col("_verdict.action").isin("BUY", "EXPEDITE"), qty).otherwise(0),
        })
        .select(*REORDER_COLUMNS)
    )


def action_summary(decisions: DataFrame) -> DataFrame:
    """Rows, ordered units and rows per action; actions nobody got count 0."""
    return decisions.agg(
        F.count(F.lit(1)).alias("output_rows"),
        F.coalesce(F.sum("recommended_order_qty"), F.lit(0)).alias("recommended_order_qty_sum"),
        *[F.count_if(F.col("recommended_action") == action).alias(f"{action.lower()}_count")
          for action in ACTIONS],
    )


def decision_violations(decisions: DataFrame) -> DataFrame:
    """Decision rows that break a rule, one row per rule."""
    action, qty = F.col("recommended_action"), F.col("recommended_order_qty")
    keyed = decisions.groupBy(*KEY_COLUMNS).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.coalesce(action.isin(*ACTIONS), F.lit(False))).alias("unknown_action"),
        F.count_if((action == "BUY") & (qty <= 0)).alias("buy_without_quantity"),
        F.count_if(action.isin("HOLD", "REDUCE") & (qty > 0)).alias("hold_or_reduce_with_quantity"),
        F.count_if(qty < 0).alias("negative_quantity"),
    )
    rules = ["unknown_action", "buy_without_quantity", "hold_or_reduce_with_quantity",
             "negative_quantity"]
    totals = keyed.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_key"),
        *[F.coalesce(F.sum(rule), F.lit(0)).alias(rule) for rule in rules],
    )
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.col(rule).cast("long").alias("violations"))
        for rule in ["duplicate_key", *rules]
    ])))


def require_valid_decisions(decisions: DataFrame) -> DataFrame:
    broken = decision_violations(decisions).filter("violations > 0").collect()
    if broken:
        raise ValueError("decision rules broken: "
                         + ", ".join(f"{row.rule}={row.violations}" for row in broken))
    return decisions
