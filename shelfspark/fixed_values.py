"""Values that have to equal the published ones for results to be comparable.

Everything below is a fixed value: key names, thresholds, texts and lookup
tables. Nothing here is logic.
"""

# --- fixed values: keys and horizons -------------------------------------
KEY_COLUMNS = ["sku_id", "channel_id", "center_id", "week_start_date"]
SERIES_COLUMNS = ["sku_id", "channel_id", "center_id"]
SNAPSHOT_HOUR = 8
HOLDOUT_WEEKS = 8
COVER_CAP_WEEKS = 52
RANDOM_SEED = 42

# --- fixed values: source domains ----------------------------------------
SOURCE_SYSTEMS = ["OMS", "WMS", "ERP", "MD"]
PROMO_TYPES = ["PRICE_DISCOUNT", "COUPON", "SPECIAL_EXHIBITION"]
ACTIONS = ["BUY", "HOLD", "EXPEDITE", "REDUCE"]
VENDOR_OUTCOME_COLUMNS = [
    "vendor_avg_lead_time",
    "vendor_lead_time_std",
    "on_time_delivery_rate",
    "po_fill_rate",
]

# --- fixed values: cold-start proxies by vendor profile ------------------
LEAD_TIME_STD_PROXY = {"STABLE": 2.0, "MODERATE": 5.0, "VARIABLE": 9.0, "HIGH_VARIANCE": 15.0}
FILL_RATE_PROXY = {"HIGH": 0.97, "MEDIUM": 0.88, "LOW": 0.75}
ON_TIME_PROXY = {"HIGH": 0.94, "MEDIUM": 0.82, "LOW": 0.65}

# --- fixed values: promotion ranking and uplift bounds -------------------
PROMO_PRIORITY_RANK = {"HIGH": 1, "MEDIUM": 2, "LOW": 3}
PROMO_PRIORITY_OTHER = 4
UPLIFT_DEFAULT, UPLIFT_MIN, UPLIFT_MAX = 1.0, 0.25, 4.0

# --- fixed values: model inputs and targets ------------------------------
DEMAND_TARGET = "target_demand_next_1w"
STOCKOUT_TARGET = "target_stockout_risk_next_2w"
FORBIDDEN_FEATURES = ["target_demand_next_1w", "target_stockout_risk_next_2w", "demand_pred"]
NUMERIC_FEATURES = [
    "observed_sales_qty", "demand_gap_qty", "sales_censored_flag", "stockout_adjusted_sales",
    "sales_lag_1w", "sales_lag_4w", "sales_rolling_mean_4w", "sales_rolling_std_4w",
    "demand_volatility_index", "stockout_adjusted_sales_rolling_mean_4w",
    "stockout_days_last_4w", "in_stock_rate_4w", "sales_history_weeks",
    "promo_flag", "promo_depth", "promo_duration_days", "promo_days_in_week",
    "promo_day_index", "historical_promo_uplift",
    "available_qty", "reserved_qty", "inbound_qty_next_1w", "inbound_qty_next_2w",
    "inbound_qty_next_4w", "inventory_position_qty", "inventory_cover_weeks",
    "safety_stock_qty", "standard_lead_time_days", "vendor_avg_lead_time",
    "vendor_lead_time_std", "po_fill_rate", "on_time_delivery_rate",
    "open_po_qty", "overdue_po_qty", "moq_qty", "order_multiple", "min_order_amount",
    "unit_cost", "list_price", "product_age_weeks", "new_product_flag",
    "active_flag", "order_block_flag", "manual_override_flag",
]
CATEGORICAL_FEATURES = [
    "sku_id", "channel_id", "center_id", "category_l1", "category_l2", "brand",
    "default_vendor_id", "promo_type", "vendor_country", "import_flag",
    "reliability_tier", "lead_time_profile", "fill_rate_profile",
]
MISSING_CATEGORY = "UNKNOWN"
LEARNING_RATE = 0.06
PERMUTATION_REPEATS = 3
TOP_FEATURES = 20

# --- fixed values: thresholds --------------------------------------------
DEFAULT_THRESHOLD = 0.5
FINAL_THRESHOLD = 0.4
BASELINE_COVER_WEEKS = 2
BUY_RISK = 0.25
REDUCE_RISK = 0.10
REDUCE_MIN_COVER = 26.0
REDUCE_COVER_FACTOR = 4.0
REDUCE_INBOUND_FACTOR = 4.0
HIGH_RISK, MEDIUM_RISK = 0.7, 0.4
HIGH_APE = 0.5
NEW_PRODUCT_WEEKS = 12

# --- fixed values: names in metric tables --------------------------------
SPLIT_NAME = "time_based_test_last_8_weeks"
DEMAND_BASELINE_NAME = "sales_rolling_mean_4w_baseline"
STOCKOUT_BASELINE_NAME = "inventory_cover_stockout_rule_baseline"
# The boosted-tree learners of Spark ML stand in for the published ones.
DEMAND_MODEL_NAME = "GBTRegressor"
STOCKOUT_MODEL_NAME = "GBTClassifier"

# --- fixed values: reason texts ------------------------------------------
REASON_BLOCKED = "HOLD: Inactive or blocked SKU"
REASON_OVERRIDE_HOLD = "HOLD: manual override - "
REASON_OVERRIDE_EXPEDITE = "EXPEDITE: manual override - "
REASON_OVERRIDE_DEFAULT = "No override reason provided"
REASON_EXPEDITE = (
    "EXPEDITE: high stockout risk with overdue/open PO before normal replenishment; "
    "expedite existing supply"
)
REASON_BUY = (
    "BUY: demand forecast exceeds inventory position after lead time and order constraints"
)
REASON_REDUCE = (
    "REDUCE: severe excess cover with open PO and excessive near-term inbound supply to review"
)
REASON_HOLD = "HOLD: inventory position sufficient"
ACTION_PRIORITY = {"EXPEDITE": 1, "BUY": 2, "REDUCE": 3, "HOLD": 4}

# --- fixed values: output column orders ----------------------------------
SKU_ATTRIBUTES = [
    "category_l1", "category_l2", "brand", "default_vendor_id", "launch_date",
    "discontinue_date", "unit_cost", "list_price", "gross_margin_rate", "shelf_life_days",
    "moq_qty", "order_multiple", "min_order_amount", "active_flag",
]
VENDOR_ATTRIBUTES = [
    "vendor_country", "import_flag", "standard_lead_time_days", "order_cycle_days",
    "payment_terms", "supply_region", "reliability_tier", "lead_time_profile",
    "fill_rate_profile", "vendor_active_flag",
]
SALES_COLUMNS = [
    "ordered_qty_1w", "fulfilled_qty_1w", "cancelled_qty_1w", "avg_selling_price",
    "order_line_count", "partial_fulfillment_flag",
]
INVENTORY_COLUMNS = [
    "on_hand_qty", "reserved_qty", "damaged_qty", "quality_hold_qty", "available_qty",
    "stockout_flag",
]
PO_COLUMNS = [
    "inbound_qty_next_1w", "inbound_qty_next_2w", "inbound_qty_next_4w", "open_po_qty",
    "overdue_po_qty",
]
PROMO_COLUMNS = ["promo_flag", "promo_type", "promo_depth", "planned_promo_price", "promo_priority"]
OVERRIDE_COLUMNS = ["manual_override_flag", "override_type", "override_reason"]
MART_COLUMNS = (
    KEY_COLUMNS + SKU_ATTRIBUTES + VENDOR_ATTRIBUTES + SALES_COLUMNS + INVENTORY_COLUMNS
    + PO_COLUMNS + PROMO_COLUMNS + OVERRIDE_COLUMNS
)
DEMAND_METRIC_COLUMNS = [
    "model_name", "split", "mae", "rmse", "wape", "bias", "forecast_accuracy",
    "train_rows", "test_rows", "train_week_min", "train_week_max", "test_week_min",
    "test_week_max",
]
STOCKOUT_METRIC_COLUMNS = [
    "model_name", "split", "threshold", "accuracy", "precision", "recall", "f1", "roc_auc",
    "pr_auc", "positive_rate_actual", "positive_rate_pred", "true_negative",
    "false_positive", "false_negative", "true_positive", "train_rows", "test_rows",
    "train_week_min", "train_week_max", "test_week_min", "test_week_max",
]
DEMAND_RESULT_COLUMNS = KEY_COLUMNS + [
    "target_demand_next_1w", "baseline_pred", "demand_pred", "abs_error", "ape", "error",
    "promo_flag", "stockout_flag", "inventory_cover_weeks",
]
STOCKOUT_RESULT_COLUMNS = KEY_COLUMNS + [
    "target_stockout_risk_next_2w", "stockout_risk_pred_proba", "stockout_risk_pred_label",
    "baseline_risk_pred", "inventory_cover_weeks", "stockout_days_last_4w", "available_qty",
    "inbound_qty_next_2w", "promo_flag", "overdue_po_qty",
]
REORDER_COLUMNS = KEY_COLUMNS + [
    "category_l1", "category_l2", "brand", "demand_pred", "stockout_risk_pred_proba",
    "stockout_risk_pred_label", "available_qty", "inbound_qty_next_1w",
    "inbound_qty_next_2w", "inbound_qty_next_4w", "inventory_position_qty",
    "inventory_cover_weeks", "safety_stock_qty", "lead_time_weeks", "review_period_weeks",
    "target_cover_weeks", "target_inventory_qty", "raw_order_need",
    "recommended_order_qty", "recommended_action", "action_reason", "moq_qty",
    "order_multiple", "min_order_amount", "unit_cost", "open_po_qty", "overdue_po_qty",
    "promo_flag", "manual_override_flag", "override_type", "override_reason",
]
SKU_DETAIL_COLUMNS = [
    "sku_id", "category_l1", "category_l2", "brand", "default_vendor_id", "unit_cost",
    "list_price", "gross_margin_rate", "shelf_life_days", "moq_qty", "order_multiple",
    "min_order_amount", "active_flag",
]
KPI_COLUMNS = ["kpi_group", "kpi_name", "kpi_value", "description"]

# --- fixed values: KPI names and descriptions ----------------------------
DEMAND_KPIS = {
    "model_wape": "WAPE of demand forecast model",
    "baseline_wape": "WAPE of sales rolling mean 4-week baseline",
    "wape_improvement_pp": "WAPE improvement of model versus baseline in percentage points",
    "model_bias": "Bias of demand forecast model",
    "baseline_bias": "Bias of sales rolling mean 4-week baseline",
    "model_forecast_accuracy": "Forecast Accuracy of demand forecast model, defined as 1 - WAPE",
    "baseline_forecast_accuracy": "Forecast Accuracy of baseline, defined as 1 - WAPE",
}
STOCKOUT_KPIS = {
    "model_precision": "Precision of stockout risk classifier at threshold 0.4",
    "model_recall": "Recall of stockout risk classifier at threshold 0.4",
    "model_f1": "F1 score of stockout risk classifier at threshold 0.4",
    "model_pr_auc": "PR-AUC of stockout risk classifier",
    "model_roc_auc": "ROC-AUC of stockout risk classifier",
    "baseline_precision": "Precision of inventory cover stockout rule baseline",
    "baseline_recall": "Recall of inventory cover stockout rule baseline",
    "baseline_f1": "F1 score of inventory cover stockout rule baseline",
    "baseline_pr_auc": "PR-AUC of inventory cover stockout rule baseline",
    "false_negative_model": "False negatives of stockout risk classifier at threshold 0.4",
    "false_negative_baseline": "False negatives of inventory cover stockout rule baseline",
}
REORDER_KPIS = {
    "total_decision_rows": "Total number of SKU-channel-center-week decision rows",
    "total_recommended_order_qty": "Total recommended order quantity across all decisions",
    "buy_count": "Number of BUY recommendations",
    "hold_count": "Number of HOLD recommendations",
    "expedite_count": "Number of EXPEDITE recommendations",
    "reduce_count": "Number of REDUCE recommendations",
    "buy_ratio": "Share of BUY recommendations",
    "hold_ratio": "Share of HOLD recommendations",
    "expedite_ratio": "Share of EXPEDITE recommendations",
    "reduce_ratio": "Share of REDUCE recommendations",
    "avg_recommended_order_qty": "Average recommended order quantity across all decisions",
    "max_recommended_order_qty": "Maximum recommended order quantity across all decisions",
}
KPI_GROUPS = {
    "Demand Forecast": DEMAND_KPIS,
    "Stockout Risk": STOCKOUT_KPIS,
    "Reorder Decision": REORDER_KPIS,
}
