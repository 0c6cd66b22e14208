"""Every query of the package by name, over the retail tables of a test folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import (
    CATEGORICAL_FEATURES, DEMAND_RESULT_COLUMNS, KEY_COLUMNS, NUMERIC_FEATURES, REORDER_COLUMNS,
)
from ..operators import (
    contracts, decisions, grids, inventory, metrics, modeling, overrides, panel, promotions,
    purchasing, quality, sales, serving, splits, vendors,
)
from ..operators.baselines import with_demand_baseline, with_stockout_baseline
from ..operators.ranking import ranking_metrics
from ..session import tuned
from ..sources.testbed import (
    BASE_TABLES, PURCHASE_VIEWS, RETAIL_TABLES, SCOPE, STAGED_VIEWS, Retail,
)
from .decisions import FormulaStages, ModelStages
from .features import default_vendors, feature_table
from .mart import panel_width, weekly_mart
from .model_store import ModelStore

# Results that hang on the order of adding fractions are compared at six places.
FUZZY = {
    "sales_rolling_std_4w", "demand_volatility_index", "vendor_lead_time_std", "po_fill_rate",
    "safety_stock_qty", "target_inventory_qty", "raw_order_need", "pr_auc", "roc_auc", "rmse",
    "num_sales_rolling_std_4w", "num_demand_volatility_index", "num_vendor_lead_time_std",
    "num_po_fill_rate", "num_safety_stock_qty", "kpi_value",
}

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame) -> DataFrame:
    names = {name: F.round(name, 6) for name in df.columns if name in FUZZY}
    return df.withColumns(names) if names else df


def _retail(build: Callable[[Retail], DataFrame], stage_lines: bool = False, views=STAGED_VIEWS) -> Query:
    """A query on the retail tables alone."""
    return lambda spark, folder: rounded(build(Retail(tuned(spark), folder, stage_lines, views)))


# The feature table is a stage table: written once per application and source folder, then read
# by every query downstream of it. Models and what they need are kept for later applications.
_STAGES: dict[tuple, FormulaStages] = {}
_MODEL_STAGES: dict[tuple, ModelStages] = {}


def forget_stages() -> None:
    """Make the next query build its stages again."""
    _STAGES.clear()
    _MODEL_STAGES.clear()


def _stages(spark: SparkSession, folder: str) -> FormulaStages:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STAGES:
        source = Retail(tuned(spark), folder, stage_lines=True)
        _STAGES[key] = FormulaStages.from_sources(source, source.scope)
    return _STAGES[key]


def _model_stages(spark: SparkSession, folder: str, rounds: int = 250, depth: int = 5) -> ModelStages:
    key = (spark.sparkContext.applicationId, folder, rounds, depth)
    if key not in _MODEL_STAGES:
        store = ModelStore(tuned(spark), [f"{folder}/{name}.parquet" for name in BASE_TABLES],
                           scope=repr(SCOPE), rounds=rounds, depth=depth)
        _MODEL_STAGES[key] = ModelStages.stored(
            store, lambda: _stages(spark, folder).features, rounds, depth)
    return _MODEL_STAGES[key]


def _formula(build: Callable[[FormulaStages], DataFrame]) -> Query:
    """A query downstream of the feature table, with formula predictions."""
    return lambda spark, folder: rounded(build(_stages(spark, folder)))


def _model(build: Callable[[ModelStages], DataFrame]) -> Query:
    """A query downstream of the fitted models."""
    return lambda spark, folder: build(_model_stages(spark, folder))


def _mart(r: Retail) -> DataFrame:
    return weekly_mart(r, r.scope)


def _positions(build) -> Query:
    """Positions of the purchase-order lines, which are laid by SKU like the panel."""
    return _retail(lambda r: build(
        r.erp_purchase_orders, r.wms_goods_receipts, r.sku_code_mapping, r.sku_master, r.scope,
        panel_width(r.sku_master, r.scope)), stage_lines=True, views=PURCHASE_VIEWS)


def _week_spine(r: Retail) -> DataFrame:
    orders = r.base("orders")
    per_week = orders.groupBy(
        F.to_date(F.date_trunc("week", "o_orderdate")).alias("week_start_date")
    ).agg(F.count("o_orderkey").alias("n"))
    spine = grids.week_spine(orders, "o_orderdate")
    return spine.join(per_week, "week_start_date", "left").select(
        "week_start_date", F.coalesce("n", F.lit(0)).alias("order_count"))


def _po_remaining(*tables) -> DataFrame:
    open_lines = purchasing.po_open_position(*tables)
    return open_lines.groupBy("week_start_date").agg(
        F.sum("remaining_qty").alias("remaining_qty"),
        F.sum("open_line_count").alias("open_line_count"))


def _mart_validation(r: Retail) -> DataFrame:
    sums = {
        "stockout_flag": "stockout_flag_sum", "promo_flag": "promo_flag_sum",
        "partial_fulfillment_flag": "partial_fulfillment_sum",
        "inbound_qty_next_4w": "inbound_qty_next_4w_sum",
        "fulfilled_qty_1w": "fulfilled_qty_1w_sum",
    }
    by_key = _mart(r).groupBy(*KEY_COLUMNS).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(name).alias(name) for name in sums])
    return by_key.agg(
        F.sum("n").alias("mart_row_count"),
        F.sum(F.col("n") - 1).alias("primary_key_duplicate_count"),
        *[F.sum(name).alias(total) for name, total in sums.items()],
    )


def _grain_duplicates(r: Retail) -> DataFrame:
    tables = {
        "sku_master": (r.sku_master, ["sku_id"]),
        "vendor_master": (r.vendor_master, ["vendor_id"]),
        "sku_code_mapping": (
            r.sku_code_mapping, ["source_system", "source_sku_code", "effective_from"]),
        "oms_sales_orders": (r.oms_sales_orders, ["order_line_id"]),
        "erp_purchase_orders": (r.erp_purchase_orders, ["po_id", "po_line_id"]),
        "weekly_mart": (_mart(r), KEY_COLUMNS),
    }
    parts = [contracts.key_duplicates(df, keys, name) for name, (df, keys) in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _panel(columns, *steps) -> Query:
    """Some features of the panel, on top of the mart."""
    def build(r: Retail) -> DataFrame:
        df = _mart(r)
        for step in steps:
            df = step(df)
        return df.select(*KEY_COLUMNS, *columns)
    return _retail(build, stage_lines=True)


def _promo_uplift(r: Retail) -> DataFrame:
    uplift = panel.promo_uplift(panel.sales_distortion(_mart(r)))
    return uplift.groupBy("sku_id", "week_start_date").agg(
        F.max("historical_promo_uplift").alias("historical_promo_uplift"))


def _time_split(s: FormulaStages) -> DataFrame:
    return splits.split_weeks(s.demand.rows, s.demand.start).select(
        F.lit("demand").alias("target"), "*"
    ).unionByName(splits.split_weeks(s.stockout.rows, s.stockout.start).select(
        F.lit("stockout").alias("target"), "*"))


def _model_inputs(s: FormulaStages) -> DataFrame:
    return splits.model_inputs(s.demand.rows).select(
        *KEY_COLUMNS, *[f"num_{c}" for c in NUMERIC_FEATURES],
        *[f"cat_{c}" for c in CATEGORICAL_FEATURES])


def _ranking(s: FormulaStages) -> DataFrame:
    from ..fixed_values import STOCKOUT_BASELINE_NAME, STOCKOUT_MODEL_NAME, STOCKOUT_TARGET

    rows = s.stockout_predictions().select(
        F.col(STOCKOUT_TARGET).alias("label"),
        F.inline(F.array(
            F.struct(F.lit(STOCKOUT_MODEL_NAME).alias("model_name"),
                     F.col("stockout_risk_pred_proba").alias("score")),
            F.struct(F.lit(STOCKOUT_BASELINE_NAME).alias("model_name"),
                     F.col("baseline_risk_pred").cast("double").alias("score")),
        )))
    return ranking_metrics(rows, "label", "score", ["model_name"])


def _kpi_filters(s: FormulaStages) -> DataFrame:
    return s.stockout_metrics().select(
        "model_name", "threshold",
        serving.is_baseline().cast("int").alias("baseline_flag"),
        serving.is_final_threshold().cast("int").alias("final_threshold_flag"),
        F.round("precision", 6).alias("precision"))


RETAIL_QUERIES: dict[str, Query] = {
    "staging_row_counts": _retail(
        lambda r: contracts.row_counts({name: getattr(r, name) for name in RETAIL_TABLES})),
    "table_row_counts": _retail(
        lambda r: contracts.row_counts({name: r.base(name) for name in BASE_TABLES})),
    "week_spine": _retail(_week_spine),
    "decision_grid": _retail(lambda r: grids.decision_grid(r.sku_master, r.scope)),
    "mapped_sales": _retail(
        lambda r: sales.mapped_sales(r.oms_sales_orders, r.sku_code_mapping)),
    "mapped_inventory": _retail(
        lambda r: inventory.mapped_inventory(r.wms_inventory_snapshot, r.sku_code_mapping)),
    "mapped_po": _retail(
        lambda r: purchasing.mapped_po(r.erp_purchase_orders, r.sku_code_mapping)),
    "mapped_receipts": _retail(
        lambda r: purchasing.mapped_receipts(r.wms_goods_receipts, r.sku_code_mapping)),
    "sales_weekly": _retail(
        lambda r: sales.sales_weekly(r.oms_sales_orders, r.sku_code_mapping)),
    "inventory_weekly": _retail(
        lambda r: inventory.inventory_weekly(r.wms_inventory_snapshot, r.sku_code_mapping)),
    "po_position_by_week": _positions(purchasing.po_open_position),
    "po_remaining_by_week": _positions(_po_remaining),
    "po_weekly": _positions(purchasing.po_weekly),
    "promotion_candidates": _retail(lambda r: promotions.promotion_candidates(
        r.md_promotion_calendar, r.sku_code_mapping, r.sku_master, r.scope)),
    "promotion_weekly": _retail(lambda r: promotions.promotion_weekly(
        r.md_promotion_calendar, r.sku_code_mapping, r.sku_master, r.scope)),
    "override_candidates": _retail(
        lambda r: overrides.override_candidates(r.manual_overrides, r.sku_master, r.scope)),
    "manual_override_weekly": _retail(
        lambda r: overrides.override_weekly(r.manual_overrides, r.sku_master, r.scope)),
    "weekly_mart": _retail(_mart, stage_lines=True),
    "mart_validation": _retail(_mart_validation, stage_lines=True),
    "grain_duplicates": _retail(_grain_duplicates),
    "receipt_summary": _retail(lambda r: vendors.receipt_summary(r.wms_goods_receipts)),
    "completed_po_lines": _retail(
        lambda r: vendors.completed_po_lines(r.erp_purchase_orders, r.wms_goods_receipts)),
    "vendor_performance": _retail(lambda r: vendors.vendor_performance(
        default_vendors(r.sku_master, r.vendor_master), r.erp_purchase_orders,
        r.wms_goods_receipts, r.scope)),
    "sales_distortion": _panel(
        ["observed_sales_qty", "demand_gap_qty", "sales_censored_flag",
         "stockout_adjusted_sales"], panel.sales_distortion),
    "lag_features": _panel(
        ["sales_lag_1w", "sales_lag_4w", "sales_history_weeks"],
        panel.sales_distortion, panel.lag_features),
    "rolling_features": _panel(
        ["sales_rolling_mean_4w", "sales_rolling_std_4w", "demand_volatility_index",
         "stockout_adjusted_sales_rolling_mean_4w", "stockout_days_last_4w",
         "in_stock_rate_4w"], panel.sales_distortion, panel.rolling_features),
    "promo_uplift": _retail(_promo_uplift, stage_lines=True),
    "inventory_features": _panel(
        ["inventory_position_qty", "inventory_cover_weeks", "safety_stock_qty"],
        panel.sales_distortion, panel.rolling_features, panel.inventory_features),
    "product_features": _panel(
        ["order_block_flag", "product_age_weeks", "new_product_flag"], panel.product_features),
    "targets": _panel(
        ["target_demand_next_1w", "target_stockout_risk_next_2w"],
        panel.sales_distortion, panel.targets),
    "feature_table": _retail(lambda r: feature_table(r, r.scope), stage_lines=True),
    "feature_quality": _retail(
        lambda r: metrics.feature_quality(feature_table(r, r.scope)), stage_lines=True),
    "sku_detail": _retail(lambda r: serving.sku_detail(_mart(r)), stage_lines=True),
    "source_quality": _retail(quality.source_quality, stage_lines=True),
    "facts_outside_scope": _retail(lambda r: quality.facts_outside_scope(r, r.scope)),
    "orphan_receipts": _retail(lambda r: quality.orphan_receipts(
        r.wms_goods_receipts, purchasing.mapped_po(r.erp_purchase_orders, r.sku_code_mapping))),
    "mapping_completeness": _retail(
        lambda r: quality.mapping_completeness(r.sku_master, r.sku_code_mapping)),
    "snapshot_gaps": _retail(lambda r: quality.snapshot_gaps(
        r.sku_master, r.wms_inventory_snapshot, r.sku_code_mapping, r.scope)),
    "join_cardinality": _retail(lambda r: contracts.join_cardinality(
        r.erp_purchase_orders, r.wms_goods_receipts, ["po_id", "po_line_id"],
        "po lines with receipts")),
}

FORMULA_QUERIES: dict[str, Query] = {
    "time_split": _formula(_time_split),
    "model_inputs": _formula(_model_inputs),
    "demand_baseline": _formula(
        lambda s: with_demand_baseline(s.demand.rows, s.demand.start)
        .select(*KEY_COLUMNS, "baseline_pred")),
    "demand_forecast_formula": _formula(
        lambda s: s.demand_predictions().select(*DEMAND_RESULT_COLUMNS)),
    "stockout_baseline": _formula(
        lambda s: with_stockout_baseline(s.stockout.rows, s.stockout.start)
        .select(*KEY_COLUMNS, "baseline_risk_pred")),
    "stockout_risk_formula": _formula(lambda s: s.stockout_predictions()),
    "demand_metrics": _formula(lambda s: s.demand_metrics()),
    "stockout_metrics": _formula(lambda s: s.stockout_metrics()),
    "ranking_metrics": _formula(_ranking),
    "leakage_audit": _formula(
        lambda s: metrics.leakage_audit(s.stockout_predictions(), s.features)),
    "target_rate_by_flag": _formula(
        lambda s: metrics.target_rate_by_flag(s.stockout_predictions(), s.features)),
    "decision_inputs": _formula(lambda s: s.inputs().select(
        *KEY_COLUMNS, "demand_pred", "stockout_risk_pred_proba", "stockout_risk_pred_label",
        "inventory_cover_weeks")),
    "order_constraints": _formula(lambda s: s.constrained().select(
        *KEY_COLUMNS, "lead_time_weeks", "review_period_weeks", "target_cover_weeks",
        "target_inventory_qty", "raw_order_need")),
    "constrained_order_qty": _formula(
        lambda s: s.constrained().select(*KEY_COLUMNS, "recommended_order_qty")),
    "reorder_actions": _formula(lambda s: s.decisions().select(*REORDER_COLUMNS)),
    "action_summary": _formula(lambda s: decisions.action_summary(s.decisions())),
    "decision_validation": _formula(lambda s: decisions.decision_violations(s.decisions())),
    "kpi_summary": _formula(lambda s: s.kpis()),
    "kpi_rows_baseline_filter": _formula(_kpi_filters),
    "export_overview": _formula(lambda s: serving.export_overview(s.kpis())),
    "export_demand": _formula(lambda s: serving.export_demand(s.demand_predictions())),
    "export_stockout": _formula(lambda s: serving.export_stockout(s.stockout_predictions())),
    "export_reorder": _formula(lambda s: serving.export_reorder(s.decisions())),
}

MODEL_QUERIES: dict[str, Query] = {
    "demand_forecast_result": _model(lambda s: s.demand_predictions()),
    "stockout_risk_result": _model(lambda s: s.stockout_predictions()),
    "model_result_audit": _model(lambda s: quality.prediction_audit(*s.predictions())),
    "model_demand_metrics": _model(lambda s: s.demand_metrics()),
    "model_stockout_metrics": _model(lambda s: s.stockout_metrics()),
    "model_reorder_actions": _model(lambda s: s.decisions()),
    "model_kpi_summary": _model(lambda s: s.kpis()),
    "demand_permutation_importance": _model(lambda s: modeling.top_features(
        modeling.demand_importance(s.demand_model, s.demand.rows, s.demand.start))),
    "stockout_permutation_importance": _model(lambda s: modeling.top_features(
        modeling.stockout_importance(s.stockout_model, s.stockout.rows, s.stockout.start))),
}

QUERIES: dict[str, Query] = {**RETAIL_QUERIES, **FORMULA_QUERIES, **MODEL_QUERIES}
