"""Independent SQL for every query that SQL can express.

The texts run on DuckDB over the generic test tables. They state each result the plain
way (pairwise joins with every week, correlated sums, self-joins), not the way the engine
computes it, so that a mistake in a rewrite shows as a difference.
"""

from __future__ import annotations

from ..fixed_values import (
    ACTION_PRIORITY, CATEGORICAL_FEATURES, DEMAND_BASELINE_NAME, DEMAND_METRIC_COLUMNS,
    DEMAND_MODEL_NAME, DEMAND_RESULT_COLUMNS, KPI_GROUPS, MART_COLUMNS, NUMERIC_FEATURES,
    REASON_BLOCKED, REASON_BUY, REASON_EXPEDITE, REASON_HOLD, REASON_OVERRIDE_DEFAULT,
    REASON_OVERRIDE_EXPEDITE, REASON_OVERRIDE_HOLD, REASON_REDUCE, REORDER_COLUMNS,
    SKU_ATTRIBUTES, SKU_DETAIL_COLUMNS, SPLIT_NAME, STOCKOUT_BASELINE_NAME,
    STOCKOUT_METRIC_COLUMNS, STOCKOUT_MODEL_NAME, STOCKOUT_RESULT_COLUMNS, VENDOR_ATTRIBUTES,
)
from ..plans.features import FEATURE_COLUMNS
from ..sources.testbed import BASE_TABLES, DUCKDB_DIALECT, RETAIL_TABLES, SCOPE, view_ctes

KEY = "sku_id, channel_id, center_id, week_start_date"


def _values(items) -> str:
    return ", ".join(f"('{item}')" for item in items)


def _valid(system: str, alias: str, code: str, day: str, until: str | None = None) -> str:
    return f"""JOIN sku_code_mapping m ON m.source_system = '{system}'
        AND m.mapping_status = 'VALID' AND m.source_sku_code = {alias}.{code}
        AND {day} >= m.effective_from
        AND {until or day} <= coalesce(m.effective_to, date '9999-12-31')"""


def _not_in(column: str, block: str, key: str) -> str:
    return f"coalesce({column} NOT IN (SELECT {key} FROM {block}), true)"


def _no_week(day: str) -> str:
    return (f"NOT EXISTS (SELECT 1 FROM weeks w WHERE {day} >= w.week_start_date "
            f"AND {day} < w.week_start_date + 7)")


# Building blocks: name -> (retail tables or blocks it reads, SQL).
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "weeks": ((), f"""
        SELECT cast(unnest(generate_series(timestamp '{SCOPE.first_week}',
               timestamp '{SCOPE.last_week}', INTERVAL '7' DAY)) AS date) AS week_start_date"""),
    "channels": ((), f"SELECT * FROM (VALUES {_values(SCOPE.channels)}) t(channel_id)"),
    "centers": ((), f"SELECT * FROM (VALUES {_values(SCOPE.centers)}) t(center_id)"),
    "grid": (("sku_master", "channels", "centers", "weeks"), """
        SELECT sku_id, channel_id, center_id, week_start_date
        FROM sku_master, channels, centers, weeks"""),
    "mapped_sales": (("oms_sales_orders", "sku_code_mapping"), f"""
        SELECT o.order_line_id, m.sku_id, o.channel_id, o.fulfillment_center_id AS center_id,
               cast(date_trunc('week', o.order_datetime) AS date) AS week_start_date,
               o.ordered_qty, o.fulfilled_qty, o.cancelled_qty, o.unit_selling_price
        FROM oms_sales_orders o
        {_valid('OMS', 'o', 'oms_sku_code', 'cast(o.order_datetime AS date)')}"""),
    "sales_weekly": (("mapped_sales",), f"""
        SELECT {KEY}, cast(sum(ordered_qty) AS bigint) AS ordered_qty_1w,
               cast(sum(fulfilled_qty) AS bigint) AS fulfilled_qty_1w,
               cast(sum(cancelled_qty) AS bigint) AS cancelled_qty_1w,
               avg(unit_selling_price) AS avg_selling_price, count(*) AS order_line_count,
               cast(bool_or(fulfilled_qty < ordered_qty) AS int) AS partial_fulfillment_flag
        FROM mapped_sales GROUP BY {KEY}"""),
    "mapped_inventory": (("wms_inventory_snapshot", "sku_code_mapping"), f"""
        SELECT m.sku_id, s.center_id,
               cast(date_trunc('week', s.snapshot_datetime) AS date) AS week_start_date,
               s.snapshot_datetime, s.on_hand_qty, s.reserved_qty, s.damaged_qty,
               s.quality_hold_qty, s.available_qty, s.stockout_flag
        FROM wms_inventory_snapshot s
        {_valid('WMS', 's', 'wms_sku_code', 'cast(s.snapshot_datetime AS date)')}"""),
    "inventory_weekly": (("mapped_inventory",), """
        SELECT sku_id, center_id, week_start_date, on_hand_qty, reserved_qty, damaged_qty,
               quality_hold_qty, available_qty,
               (SELECT max(x.stockout_flag) FROM mapped_inventory x
                WHERE x.sku_id = i.sku_id AND x.center_id = i.center_id
                  AND x.week_start_date = i.week_start_date) AS stockout_flag
        FROM mapped_inventory i
        QUALIFY row_number() OVER (PARTITION BY sku_id, center_id, week_start_date
            ORDER BY snapshot_datetime DESC, on_hand_qty DESC) = 1"""),
    "mapped_po": (("erp_purchase_orders", "sku_code_mapping"), f"""
        SELECT m.sku_id, p.po_id, p.po_line_id, p.po_created_date, p.center_id,
               p.confirmed_qty, p.cancelled_qty, p.promised_delivery_date
        FROM erp_purchase_orders p
        {_valid('ERP', 'p', 'erp_sku_code', 'p.po_created_date')}"""),
    "mapped_receipts": (("wms_goods_receipts", "sku_code_mapping"), f"""
        SELECT m.sku_id, r.po_id, r.po_line_id, r.center_id, r.receipt_datetime, r.accepted_qty
        FROM wms_goods_receipts r
        {_valid('WMS', 'r', 'wms_sku_code', 'cast(r.receipt_datetime AS date)')}"""),
    # Every PO line with every later week, and what had been accepted by then.
    "po_numbered": (("mapped_po",), """
        SELECT *, row_number() OVER () AS no FROM mapped_po"""),
    "receipt_numbered": (("po_numbered", "mapped_receipts"), """
        SELECT p.no, r.receipt_datetime, r.accepted_qty FROM mapped_receipts r
        JOIN po_numbered p USING (po_id, po_line_id, sku_id, center_id)"""),
    "accepted_by_week": (("receipt_numbered", "weeks"), """
        SELECT r.no, w.week_start_date, sum(r.accepted_qty) AS accepted
        FROM receipt_numbered r
        JOIN weeks w ON r.receipt_datetime < w.week_start_date + INTERVAL '8' HOUR
        GROUP BY r.no, w.week_start_date"""),
    "po_position": (("po_numbered", "weeks", "accepted_by_week"), """
        SELECT p.sku_id, p.center_id, w.week_start_date, p.promised_delivery_date AS promised,
               p.confirmed_qty, coalesce(a.accepted, 0) AS accepted,
               greatest(p.confirmed_qty - coalesce(a.accepted, 0), 0) AS remaining
        FROM po_numbered p JOIN weeks w ON w.week_start_date >= p.po_created_date
        LEFT JOIN accepted_by_week a ON a.no = p.no AND a.week_start_date = w.week_start_date"""),
    "po_sums": (("po_position",), """
        SELECT sku_id, center_id, week_start_date,
               cast(sum(remaining) FILTER (WHERE promised >= week_start_date
                    AND promised < week_start_date + 7) AS bigint) AS inbound_qty_next_1w,
               cast(sum(remaining) FILTER (WHERE promised >= week_start_date
                    AND promised < week_start_date + 14) AS bigint) AS inbound_qty_next_2w,
               cast(sum(remaining) FILTER (WHERE promised >= week_start_date
                    AND promised < week_start_date + 28) AS bigint) AS inbound_qty_next_4w,
               cast(sum(remaining) AS bigint) AS open_po_qty,
               cast(sum(remaining) FILTER (WHERE promised < week_start_date) AS bigint)
                   AS overdue_po_qty,
               count(*) FILTER (WHERE remaining > 0) AS open_line_count,
               cast(sum(confirmed_qty) FILTER (WHERE remaining > 0) AS bigint)
                   AS confirmed_open_qty,
               cast(sum(accepted) FILTER (WHERE remaining > 0) AS bigint)
                   AS accepted_qty_as_of_week
        FROM po_position GROUP BY sku_id, center_id, week_start_date"""),
    "po_dense": (("po_sums", "sku_master", "centers", "weeks"), """
        SELECT s.sku_id, c.center_id, w.week_start_date,
               coalesce(inbound_qty_next_1w, 0) AS inbound_qty_next_1w,
               coalesce(inbound_qty_next_2w, 0) AS inbound_qty_next_2w,
               coalesce(inbound_qty_next_4w, 0) AS inbound_qty_next_4w,
               coalesce(open_po_qty, 0) AS open_po_qty,
               coalesce(overdue_po_qty, 0) AS overdue_po_qty,
               coalesce(open_line_count, 0) AS open_line_count,
               coalesce(confirmed_open_qty, 0) AS confirmed_open_qty,
               coalesce(accepted_qty_as_of_week, 0) AS accepted_qty_as_of_week
        FROM (SELECT sku_id FROM sku_master) s, centers c, weeks w
        LEFT JOIN po_sums p ON p.sku_id = s.sku_id AND p.center_id = c.center_id
             AND p.week_start_date = w.week_start_date"""),
    "promotion_candidates": (
        ("md_promotion_calendar", "sku_code_mapping", "sku_master", "channels", "weeks"), f"""
        SELECT p.promotion_id, m.sku_id, p.channel_id, w.week_start_date, p.promo_type,
               p.planned_discount_rate AS promo_depth, p.planned_promo_price, p.promo_priority,
               cast(row_number() OVER (
                   PARTITION BY m.sku_id, p.channel_id, w.week_start_date
                   ORDER BY coalesce(list_position(['HIGH', 'MEDIUM', 'LOW'], p.promo_priority),
                                     4),
                            p.planned_discount_rate DESC, p.promotion_id) AS int) AS promo_rank
        FROM md_promotion_calendar p
        {_valid('MD', 'p', 'md_sku_code', 'p.promo_start_date', 'p.promo_end_date')}
        JOIN sku_master s ON s.sku_id = m.sku_id
        JOIN channels c ON c.channel_id = p.channel_id
        JOIN weeks w ON p.promo_start_date < w.week_start_date + 7
             AND p.promo_end_date >= w.week_start_date"""),
    "promotion_weekly": (("promotion_candidates",), """
        SELECT sku_id, channel_id, week_start_date, 1 AS promo_flag, promo_type, promo_depth,
               planned_promo_price, promo_priority
        FROM promotion_candidates WHERE promo_rank = 1"""),
    "override_candidates": (("grid", "manual_overrides"), f"""
        SELECT o.override_id, g.sku_id, g.channel_id, g.center_id, g.week_start_date,
               o.override_type, o.override_reason,
               cast(row_number() OVER (
                   PARTITION BY g.sku_id, g.channel_id, g.center_id, g.week_start_date
                   ORDER BY o.created_at DESC, o.override_id) AS int) AS override_rank
        FROM manual_overrides o JOIN grid g ON g.sku_id = o.sku_id
             AND coalesce(o.channel_id, '') IN ('', g.channel_id)
             AND coalesce(o.center_id, '') IN ('', g.center_id)
             AND g.week_start_date >= o.effective_from AND g.week_start_date <= o.effective_to
        WHERE o.approval_status = 'APPROVED'"""),
    "override_weekly": (("override_candidates",), f"""
        SELECT {KEY}, 1 AS manual_override_flag, override_type, override_reason
        FROM override_candidates WHERE override_rank = 1"""),
    "weekly_mart": (
        ("grid", "sku_master", "vendor_master", "sales_weekly", "inventory_weekly", "po_dense",
         "promotion_weekly", "override_weekly"),
        "SELECT g.*, "
        + ", ".join(f"s.{c}" for c in SKU_ATTRIBUTES) + ", "
        + ", ".join(f"v.{c}" for c in VENDOR_ATTRIBUTES) + """,
               coalesce(sw.ordered_qty_1w, 0) AS ordered_qty_1w,
               coalesce(sw.fulfilled_qty_1w, 0) AS fulfilled_qty_1w,
               coalesce(sw.cancelled_qty_1w, 0) AS cancelled_qty_1w, sw.avg_selling_price,
               coalesce(sw.order_line_count, 0) AS order_line_count,
               coalesce(sw.partial_fulfillment_flag, 0) AS partial_fulfillment_flag,
               coalesce(iw.on_hand_qty, 0) AS on_hand_qty,
               coalesce(iw.reserved_qty, 0) AS reserved_qty,
               coalesce(iw.damaged_qty, 0) AS damaged_qty,
               coalesce(iw.quality_hold_qty, 0) AS quality_hold_qty,
               coalesce(iw.available_qty, 0) AS available_qty,
               coalesce(iw.stockout_flag, 0) AS stockout_flag,
               po.inbound_qty_next_1w, po.inbound_qty_next_2w, po.inbound_qty_next_4w,
               po.open_po_qty, po.overdue_po_qty,
               coalesce(pr.promo_flag, 0) AS promo_flag, pr.promo_type, pr.promo_depth,
               pr.planned_promo_price, pr.promo_priority,
               coalesce(ov.manual_override_flag, 0) AS manual_override_flag, ov.override_type,
               ov.override_reason
        FROM grid g JOIN sku_master s USING (sku_id)
        LEFT JOIN vendor_master v ON v.vendor_id = s.default_vendor_id
        LEFT JOIN sales_weekly sw USING (sku_id, channel_id, center_id, week_start_date)
        LEFT JOIN inventory_weekly iw USING (sku_id, center_id, week_start_date)
        LEFT JOIN po_dense po USING (sku_id, center_id, week_start_date)
        LEFT JOIN promotion_weekly pr USING (sku_id, channel_id, week_start_date)
        LEFT JOIN override_weekly ov USING (sku_id, channel_id, center_id, week_start_date)"""),
    "receipt_summary": (("wms_goods_receipts",), """
        SELECT po_id, po_line_id, cast(sum(accepted_qty) AS bigint) AS accepted_qty,
               max(receipt_datetime) AS completion_datetime
        FROM wms_goods_receipts GROUP BY po_id, po_line_id"""),
    "completed_po": (("erp_purchase_orders", "receipt_summary"), """
        SELECT p.po_id, p.po_line_id, p.vendor_id, r.completion_datetime,
               cast(date_diff('day', p.po_created_date, cast(r.completion_datetime AS date))
                    AS int) AS actual_lead_time_days,
               CASE WHEN p.ordered_qty <> 0
                    THEN least(greatest(cast(r.accepted_qty AS double) / p.ordered_qty, 0), 1)
                    END AS po_fill_rate,
               CASE WHEN cast(r.completion_datetime AS date) <= p.promised_delivery_date
                    THEN 1 ELSE 0 END AS on_time_delivery
        FROM erp_purchase_orders p JOIN receipt_summary r USING (po_id, po_line_id)
        WHERE p.confirmed_qty > 0 AND r.accepted_qty >= p.confirmed_qty"""),
    # Every vendor and week with every line completed before that week's cutoff.
    "vendor_history": (("sku_master", "weeks", "completed_po"), """
        SELECT v.vendor_id, w.week_start_date, count(*) AS n,
               avg(c.actual_lead_time_days) AS lead, stddev_pop(c.actual_lead_time_days) AS dev,
               avg(c.po_fill_rate) AS fill, avg(c.on_time_delivery) AS on_time
        FROM (SELECT DISTINCT default_vendor_id AS vendor_id FROM sku_master) v
        JOIN completed_po c ON c.vendor_id = v.vendor_id
        JOIN weeks w ON c.completion_datetime < w.week_start_date + INTERVAL '8' HOUR
        GROUP BY v.vendor_id, w.week_start_date"""),
    "vendor_performance": (("sku_master", "vendor_master", "weeks", "vendor_history"), """
        SELECT d.vendor_id, w.week_start_date,
               coalesce(h.lead, cast(v.standard_lead_time_days AS double)) AS vendor_avg_lead_time,
               CASE WHEN h.n >= 2 THEN h.dev ELSE CASE v.lead_time_profile
                    WHEN 'STABLE' THEN 2.0 WHEN 'MODERATE' THEN 5.0 WHEN 'VARIABLE' THEN 9.0
                    WHEN 'HIGH_VARIANCE' THEN 15.0 END END AS vendor_lead_time_std,
               coalesce(h.fill, CASE v.fill_rate_profile WHEN 'HIGH' THEN 0.97
                    WHEN 'MEDIUM' THEN 0.88 WHEN 'LOW' THEN 0.75 END) AS po_fill_rate,
               coalesce(h.on_time, CASE v.reliability_tier WHEN 'HIGH' THEN 0.94
                    WHEN 'MEDIUM' THEN 0.82 WHEN 'LOW' THEN 0.65 END) AS on_time_delivery_rate
        FROM (SELECT DISTINCT default_vendor_id AS vendor_id FROM sku_master) d
        CROSS JOIN weeks w
        LEFT JOIN vendor_master v ON v.vendor_id = d.vendor_id
        LEFT JOIN vendor_history h ON h.vendor_id = d.vendor_id
             AND h.week_start_date = w.week_start_date"""),
    "distorted": (("weekly_mart",), """
        SELECT *, fulfilled_qty_1w AS observed_sales_qty,
               CASE WHEN ordered_qty_1w > fulfilled_qty_1w
                    THEN ordered_qty_1w - fulfilled_qty_1w ELSE 0 END AS demand_gap_qty,
               CASE WHEN partial_fulfillment_flag = 1 OR stockout_flag = 1 THEN 1 ELSE 0 END
                   AS sales_censored_flag,
               fulfilled_qty_1w + CASE WHEN ordered_qty_1w > fulfilled_qty_1w
                    THEN ordered_qty_1w - fulfilled_qty_1w ELSE 0 END AS stockout_adjusted_sales
        FROM weekly_mart"""),
    # The four previous weeks of each cell, found by date.
    "history": (("distorted",), f"""
        SELECT a.sku_id, a.channel_id, a.center_id, a.week_start_date,
               avg(b.observed_sales_qty) AS mean4, stddev_pop(b.observed_sales_qty) AS std4,
               avg(b.stockout_adjusted_sales) AS adjusted4,
               coalesce(cast(sum(b.stockout_flag) AS bigint), 0) AS stockouts4,
               max(b.observed_sales_qty) FILTER (WHERE b.week_start_date = a.week_start_date - 7)
                   AS lag1,
               max(b.observed_sales_qty) FILTER (WHERE b.week_start_date = a.week_start_date - 28)
                   AS lag4
        FROM distorted a LEFT JOIN distorted b
          ON b.sku_id = a.sku_id AND b.channel_id = a.channel_id AND b.center_id = a.center_id
         AND (b.week_start_date = a.week_start_date - 7
              OR b.week_start_date = a.week_start_date - 14
              OR b.week_start_date = a.week_start_date - 21
              OR b.week_start_date = a.week_start_date - 28)
        GROUP BY a.sku_id, a.channel_id, a.center_id, a.week_start_date"""),
    "sku_week": (("distorted",), """
        SELECT sku_id, week_start_date,
               sum(CASE WHEN promo_flag = 1 THEN stockout_adjusted_sales ELSE 0 END) AS promo_sales,
               sum(CASE WHEN promo_flag = 0 THEN stockout_adjusted_sales ELSE 0 END) AS base_sales,
               sum(promo_flag) AS promo_n, sum(1 - promo_flag) AS base_n
        FROM distorted GROUP BY sku_id, week_start_date"""),
    "uplift_sums": (("sku_week",), """
        SELECT a.sku_id, a.week_start_date,
               CASE WHEN sum(b.promo_n) > 0
                    THEN cast(sum(b.promo_sales) AS double) / sum(b.promo_n) END AS promo_mean,
               CASE WHEN sum(b.base_n) > 0
                    THEN cast(sum(b.base_sales) AS double) / sum(b.base_n) END AS base_mean
        FROM sku_week a
        LEFT JOIN sku_week b ON b.sku_id = a.sku_id AND b.week_start_date < a.week_start_date
        GROUP BY a.sku_id, a.week_start_date"""),
    "promo_uplift": (("uplift_sums",), """
        SELECT sku_id, week_start_date,
               least(greatest(coalesce(CASE WHEN base_mean > 0 THEN promo_mean / base_mean END,
                                       1.0), 0.25), 4.0) AS historical_promo_uplift
        FROM uplift_sums"""),
    "features": (("distorted", "history", "promo_uplift", "vendor_performance"), f"""
        SELECT d.*, h.lag1 AS sales_lag_1w, h.lag4 AS sales_lag_4w,
               h.mean4 AS sales_rolling_mean_4w, h.std4 AS sales_rolling_std_4w,
               CASE WHEN h.mean4 > 0 THEN h.std4 / h.mean4 END AS demand_volatility_index,
               h.adjusted4 AS stockout_adjusted_sales_rolling_mean_4w,
               h.stockouts4 AS stockout_days_last_4w,
               1 - h.stockouts4 / cast(4 AS double) AS in_stock_rate_4w,
               cast(date_diff('week', date '{SCOPE.first_week}', d.week_start_date) AS int)
                   AS sales_history_weeks,
               u.historical_promo_uplift, 0 AS promo_duration_days,
               7 * d.promo_flag AS promo_days_in_week, 0 AS promo_day_index,
               v.vendor_avg_lead_time, v.vendor_lead_time_std, v.po_fill_rate,
               v.on_time_delivery_rate,
               d.available_qty + d.inbound_qty_next_4w AS inventory_position_qty,
               CASE WHEN h.mean4 > 0 THEN (d.available_qty + d.inbound_qty_next_4w) / h.mean4 END
                   AS inventory_cover_weeks,
               CASE WHEN d.standard_lead_time_days IS NOT NULL
                    THEN h.std4 * sqrt(greatest(d.standard_lead_time_days, 1) / cast(7 AS double))
                    END AS safety_stock_qty,
               CASE WHEN d.active_flag = 0
                      OR coalesce(d.discontinue_date, date '9999-12-31') <= d.week_start_date
                    THEN 1 ELSE 0 END AS order_block_flag,
               CASE WHEN d.launch_date IS NOT NULL
                    THEN greatest(cast(floor((d.week_start_date - d.launch_date)
                                             / cast(7 AS double)) AS bigint), 0) END
                   AS product_age_weeks,
               CASE WHEN (d.week_start_date - d.launch_date) < 13 * 7 THEN 1 ELSE 0 END
                   AS new_product_flag,
               n1.stockout_adjusted_sales AS target_demand_next_1w,
               CASE WHEN n2.sku_id IS NOT NULL
                    THEN greatest(n1.stockout_flag, n2.stockout_flag) END
                   AS target_stockout_risk_next_2w
        FROM distorted d
        JOIN history h USING (sku_id, channel_id, center_id, week_start_date)
        JOIN promo_uplift u USING (sku_id, week_start_date)
        JOIN vendor_performance v ON v.vendor_id = d.default_vendor_id
             AND v.week_start_date = d.week_start_date
        LEFT JOIN distorted n1 ON n1.sku_id = d.sku_id AND n1.channel_id = d.channel_id
             AND n1.center_id = d.center_id AND n1.week_start_date = d.week_start_date + 7
        LEFT JOIN distorted n2 ON n2.sku_id = d.sku_id AND n2.channel_id = d.channel_id
             AND n2.center_id = d.center_id AND n2.week_start_date = d.week_start_date + 14"""),
    "demand_rows": (("features",), """
        SELECT * REPLACE (least(inventory_cover_weeks, CASE WHEN inventory_cover_weeks IS NOT NULL
                                THEN 52.0 END) AS inventory_cover_weeks),
               week_start_date IN (SELECT DISTINCT week_start_date FROM features
                   WHERE target_demand_next_1w IS NOT NULL ORDER BY 1 DESC LIMIT 8) AS is_test
        FROM features WHERE target_demand_next_1w IS NOT NULL"""),
    "stockout_rows": (("features",), """
        SELECT * REPLACE (least(inventory_cover_weeks, CASE WHEN inventory_cover_weeks IS NOT NULL
                                THEN 52.0 END) AS inventory_cover_weeks),
               week_start_date IN (SELECT DISTINCT week_start_date FROM features
                   WHERE target_stockout_risk_next_2w IS NOT NULL ORDER BY 1 DESC LIMIT 8)
                   AS is_test
        FROM features WHERE target_stockout_risk_next_2w IS NOT NULL"""),
    "demand_base": (("demand_rows",), """
        SELECT *, greatest(coalesce(sales_rolling_mean_4w,
                   (SELECT median(target_demand_next_1w) FROM demand_rows WHERE NOT is_test)), 0)
                   AS baseline_pred
        FROM demand_rows WHERE is_test"""),
    "demand_scored": (("demand_base",), """
        SELECT *, demand_pred - target_demand_next_1w AS error,
               abs(demand_pred - target_demand_next_1w) AS abs_error,
               CASE WHEN target_demand_next_1w <> 0
                    THEN abs(demand_pred - target_demand_next_1w)
                         / abs(cast(target_demand_next_1w AS double)) END AS ape
        FROM (SELECT *, greatest(coalesce(stockout_adjusted_sales_rolling_mean_4w, baseline_pred),
                                 0) AS demand_pred FROM demand_base) x"""),
    "stockout_scored": (("stockout_rows",), """
        SELECT *, CASE WHEN stockout_risk_pred_proba >= cast(0.4 AS double) THEN 1 ELSE 0 END
                   AS stockout_risk_pred_label
        FROM (SELECT *, (CASE WHEN inventory_cover_weeks < 2 THEN 35
                              WHEN inventory_cover_weeks < 8 THEN 20 ELSE 5 END
                         + 15 * stockout_days_last_4w) / cast(100 AS double)
                         AS stockout_risk_pred_proba,
                     CASE WHEN coalesce(inventory_cover_weeks, 1e9) < 2
                            OR stockout_days_last_4w > 0 THEN 1 ELSE 0 END AS baseline_risk_pred
              FROM stockout_rows WHERE is_test) x"""),
    "decision_rows": (("features", "demand_scored", "stockout_scored"), """
        SELECT f.*, d.demand_pred, s.stockout_risk_pred_proba, s.stockout_risk_pred_label
        FROM features f
        JOIN demand_scored d USING (sku_id, channel_id, center_id, week_start_date)
        JOIN stockout_scored s USING (sku_id, channel_id, center_id, week_start_date)"""),
    "constrained": (("decision_rows",), """
        SELECT * REPLACE (available_qty + inbound_qty_next_4w AS inventory_position_qty),
               CASE WHEN raw_order_need > 0
                    THEN cast(ceil(greatest(raw_order_need, moq_qty,
                              CASE WHEN min_order_amount > 0 AND unit_cost > 0
                                   THEN ceil(min_order_amount / unit_cost) ELSE 0 END)
                              / order_multiple) AS bigint) * order_multiple
                    ELSE 0 END AS recommended_order_qty
        FROM (SELECT *, greatest(target_inventory_qty
                                 - (available_qty + inbound_qty_next_4w), 0) AS raw_order_need
              FROM (SELECT *, demand_pred * target_cover_weeks + coalesce(safety_stock_qty, 0)
                           AS target_inventory_qty
                    FROM (SELECT *, lead_time_weeks + review_period_weeks AS target_cover_weeks
                          FROM (SELECT * REPLACE (coalesce(safety_stock_qty, 0)
                                                  AS safety_stock_qty),
                                       cast(ceil(coalesce(standard_lead_time_days, 0)
                                            / cast(7 AS double)) AS int) AS lead_time_weeks,
                                       cast(ceil(coalesce(order_cycle_days, 0)
                                            / cast(7 AS double)) AS int) AS review_period_weeks
                                FROM decision_rows) a) b) c) d"""),
    "tiers": (("constrained",), f"""
        SELECT *, CASE
              WHEN active_flag = 0 OR order_block_flag = 1 THEN 'blocked'
              WHEN manual_override_flag = 1 AND override_type IN ('FORCE_HOLD', 'BLOCK_BUY')
                   THEN 'override hold'
              WHEN manual_override_flag = 1 AND override_type = 'EXPEDITE'
                   THEN 'override expedite'
              WHEN stockout_risk_pred_proba >= cast(0.4 AS double)
                   AND coalesce(inventory_cover_weeks < lead_time_weeks, false)
                   AND open_po_qty + overdue_po_qty > 0 THEN 'expedite'
              WHEN recommended_order_qty > 0
                   AND (stockout_risk_pred_proba >= cast(0.25 AS double)
                        OR coalesce(inventory_cover_weeks < target_cover_weeks, false)) THEN 'buy'
              WHEN coalesce(inventory_cover_weeks >= 26, false)
                   AND coalesce(inventory_cover_weeks >= 4 * target_cover_weeks, false)
                   AND stockout_risk_pred_proba < cast(0.1 AS double) AND raw_order_need = 0
                   AND open_po_qty > 0 AND inbound_qty_next_4w >= 4 * demand_pred
                   AND promo_flag = 0 THEN 'reduce'
              ELSE 'hold' END AS tier,
              CASE WHEN trim(coalesce(override_reason, '')) = '' THEN '{REASON_OVERRIDE_DEFAULT}'
                   ELSE trim(override_reason) END AS said
        FROM constrained"""),
    "decisions": (("tiers",), f"""
        SELECT * REPLACE (CASE WHEN tier IN ('override expedite', 'expedite', 'buy')
                               THEN recommended_order_qty ELSE 0 END AS recommended_order_qty),
               CASE WHEN tier IN ('override expedite', 'expedite') THEN 'EXPEDITE'
                    WHEN tier = 'buy' THEN 'BUY' WHEN tier = 'reduce' THEN 'REDUCE'
                    ELSE 'HOLD' END AS recommended_action,
               CASE tier WHEN 'blocked' THEN '{REASON_BLOCKED}'
                    WHEN 'override hold' THEN '{REASON_OVERRIDE_HOLD}' || said
                    WHEN 'override expedite' THEN '{REASON_OVERRIDE_EXPEDITE}' || said
                    WHEN 'expedite' THEN '{REASON_EXPEDITE}' WHEN 'buy' THEN '{REASON_BUY}'
                    WHEN 'reduce' THEN '{REASON_REDUCE}' ELSE '{REASON_HOLD}' END AS action_reason
        FROM tiers"""),
}


def _split(rows: str) -> str:
    return f"""(SELECT '{SPLIT_NAME}' AS split, count(*) FILTER (WHERE NOT is_test) AS train_rows,
        count(*) FILTER (WHERE is_test) AS test_rows,
        strftime(min(week_start_date) FILTER (WHERE NOT is_test), '%Y-%m-%d') AS train_week_min,
        strftime(max(week_start_date) FILTER (WHERE NOT is_test), '%Y-%m-%d') AS train_week_max,
        strftime(min(week_start_date) FILTER (WHERE is_test), '%Y-%m-%d') AS test_week_min,
        strftime(max(week_start_date) FILTER (WHERE is_test), '%Y-%m-%d') AS test_week_max
        FROM {rows})"""


def _areas(rows: str, by: str) -> str:
    """AUC over all positive-negative pairs and average precision by rank, per group."""
    return f"""(SELECT {by}, (SELECT sum(CASE WHEN p.score > n.score THEN p.k * n.k
                                      WHEN p.score = n.score THEN p.k * n.k * 0.5 ELSE 0 END)
                              / nullif(sum(p.k * n.k), 0)
                       FROM per_score p JOIN per_score n ON p.{by} = n.{by}
                       WHERE p.label = 1 AND n.label = 0 AND p.{by} = g.{by}) AS roc_auc,
               (SELECT sum(p.k * (SELECT sum(x.k) FILTER (WHERE x.label = 1)
                                         / cast(sum(x.k) AS double) FROM per_score x
                                  WHERE x.{by} = p.{by} AND x.score >= p.score))
                       / sum(p.k) FROM per_score p WHERE p.label = 1 AND p.{by} = g.{by}) AS pr_auc
        FROM (SELECT DISTINCT {by} FROM {rows}) g)"""


_RATES = """true_negative, false_positive, false_negative, true_positive,
    (true_positive + true_negative) / cast(n AS double) AS accuracy,
    coalesce(true_positive / cast(nullif(true_positive + false_positive, 0) AS double), 0)
        AS precision,
    coalesce(true_positive / cast(nullif(true_positive + false_negative, 0) AS double), 0)
        AS recall,
    coalesce(2 * true_positive
        / cast(nullif(2 * true_positive + false_positive + false_negative, 0) AS double), 0) AS f1,
    (true_positive + false_negative) / cast(n AS double) AS positive_rate_actual,
    (true_positive + false_positive) / cast(n AS double) AS positive_rate_pred"""

_CONFUSION = """count(*) AS n, count(*) FILTER (WHERE label = 0 AND predicted = 0)
        AS true_negative, count(*) FILTER (WHERE label = 0 AND predicted = 1) AS false_positive,
    count(*) FILTER (WHERE label = 1 AND predicted = 0) AS false_negative,
    count(*) FILTER (WHERE label = 1 AND predicted = 1) AS true_positive"""

# Metric tables: each a chain of CTEs, usable by other texts.
BLOCKS.update({
    "demand_metrics": (("demand_scored", "demand_rows"), f"""
        SELECT x.*, s.train_rows, s.test_rows, s.train_week_min, s.train_week_max,
               s.test_week_min, s.test_week_max
        FROM (SELECT model_name, '{SPLIT_NAME}' AS split, avg(abs(p - y)) AS mae,
                     sqrt(avg((p - y) * (p - y))) AS rmse, sum(abs(p - y)) / sum(y) AS wape,
                     sum(p - y) / sum(y) AS bias, 1 - sum(abs(p - y)) / sum(y)
                         AS forecast_accuracy
              FROM (SELECT '{DEMAND_MODEL_NAME}' AS model_name, demand_pred AS p,
                           cast(target_demand_next_1w AS double) AS y FROM demand_scored
                    UNION ALL SELECT '{DEMAND_BASELINE_NAME}', baseline_pred,
                           cast(target_demand_next_1w AS double) FROM demand_scored) c
              GROUP BY model_name) x JOIN {_split('demand_rows')} s USING (split)"""),
    "scored_long": (("stockout_scored",), f"""
        SELECT '{STOCKOUT_MODEL_NAME}' AS model_name, t AS threshold,
               target_stockout_risk_next_2w AS label,
               CASE WHEN stockout_risk_pred_proba >= t THEN 1 ELSE 0 END AS predicted,
               stockout_risk_pred_proba AS score
        FROM stockout_scored CROSS JOIN (VALUES (cast(0.5 AS double)), (cast(0.4 AS double))) v(t)
        UNION ALL
        SELECT '{STOCKOUT_BASELINE_NAME}', NULL, target_stockout_risk_next_2w,
               baseline_risk_pred, baseline_risk_pred FROM stockout_scored"""),
    "per_score": (("scored_long",), """
        SELECT model_name, score, label, count(*) AS k FROM scored_long
        WHERE threshold IS NULL OR threshold < 0.45 GROUP BY model_name, score, label"""),
    "stockout_metrics": (("scored_long", "per_score", "stockout_rows"), f"""
        SELECT c.model_name, s.split, c.threshold, {_RATES}, a.roc_auc, a.pr_auc, s.train_rows,
               s.test_rows, s.train_week_min, s.train_week_max, s.test_week_min, s.test_week_max
        FROM (SELECT model_name, threshold, {_CONFUSION} FROM scored_long
              GROUP BY model_name, threshold) c
        JOIN {_areas('scored_long', 'model_name')} a USING (model_name)
        CROSS JOIN {_split('stockout_rows')} s"""),
})


def _closure(names) -> list[str]:
    """Blocks needed for some names, dependencies first, and the retail tables they read."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        if name in BLOCKS:
            for part in BLOCKS[name][0]:
                visit(part)
        order.append(name)

    for name in names:
        visit(name)
    return order


def text(select: str, *needs: str) -> str:
    """Complete SQL: the CTEs that ``needs`` stand on, then the final select."""
    order = _closure(needs)
    retail = [name for name in order if name in RETAIL_TABLES or name == "order_line"]
    ctes = []
    if retail:
        ctes.append(view_ctes(retail, **DUCKDB_DIALECT, **{t: t for t in BASE_TABLES}))
    ctes += [f"{name} AS ({BLOCKS[name][1]})" for name in order if name in BLOCKS]
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _rounded(columns, fuzzy) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in fuzzy else c for c in columns)


# Sums of fractions depend on the order of adding; both sides round these.
FUZZY = {
    "sales_rolling_std_4w", "demand_volatility_index", "vendor_lead_time_std", "po_fill_rate",
    "safety_stock_qty", "target_inventory_qty", "raw_order_need", "pr_auc", "roc_auc", "rmse",
}


def _rules(*rules: tuple[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS rule, cast(({sql}) AS bigint) AS violations" for name, sql in rules)


def _count(table: str, condition: str) -> str:
    return f"SELECT count(*) FROM {table} WHERE {condition}"


def _kpis() -> str:
    model_d, base_d = f"model_name = '{DEMAND_MODEL_NAME}'", f"model_name = '{DEMAND_BASELINE_NAME}'"
    model_s = f"model_name = '{STOCKOUT_MODEL_NAME}' AND abs(threshold - 0.4) < 0.001"
    base_s = f"model_name = '{STOCKOUT_BASELINE_NAME}'"

    def d(column: str, row: str) -> str:
        return f"SELECT {column} FROM demand_metrics WHERE {row}"

    def s(column: str, row: str) -> str:
        return f"SELECT {column} FROM stockout_metrics WHERE {row}"

    values = {
        "model_wape": d("wape", model_d), "baseline_wape": d("wape", base_d),
        "wape_improvement_pp": f"SELECT (({d('wape', base_d)}) - ({d('wape', model_d)})) * 100",
        "model_bias": d("bias", model_d), "baseline_bias": d("bias", base_d),
        "model_forecast_accuracy": d("forecast_accuracy", model_d),
        "baseline_forecast_accuracy": d("forecast_accuracy", base_d),
        **{f"model_{c}": s(c, model_s) for c in ("precision", "recall", "f1", "pr_auc", "roc_auc")},
        **{f"baseline_{c}": s(c, base_s) for c in ("precision", "recall", "f1", "pr_auc")},
        "false_negative_model": s("false_negative", model_s),
        "false_negative_baseline": s("false_negative", base_s),
        "total_decision_rows": "SELECT count(*) FROM decisions",
        "total_recommended_order_qty": "SELECT sum(recommended_order_qty) FROM decisions",
        **{f"{a}_count": _count("decisions", f"recommended_action = '{a.upper()}'")
           for a in ("buy", "hold", "expedite", "reduce")},
        **{f"{a}_ratio": f"SELECT avg(CASE WHEN recommended_action = '{a.upper()}' THEN 1 ELSE 0 "
                         "END) FROM decisions" for a in ("buy", "hold", "expedite", "reduce")},
        "avg_recommended_order_qty": "SELECT avg(recommended_order_qty) FROM decisions",
        "max_recommended_order_qty": "SELECT max(recommended_order_qty) FROM decisions",
    }
    return " UNION ALL ".join(
        f"SELECT '{group}' AS kpi_group, '{name}' AS kpi_name, "
        f"round(cast(({values[name]}) AS double), 6) AS kpi_value, '{words}' AS description"
        for group, texts in KPI_GROUPS.items() for name, words in texts.items())


def oracle_sql() -> dict[str, str]:
    keyed = KEY.split(", ")
    features = [*MART_COLUMNS, *FEATURE_COLUMNS]
    number = {"moq_qty", "unit_cost", "open_po_qty", "overdue_po_qty", "promo_flag",
              "manual_override_flag", "available_qty", "inbound_qty_next_1w",
              "inbound_qty_next_2w", "inbound_qty_next_4w", "inventory_position_qty",
              "order_multiple", "min_order_amount"}
    reorder = ", ".join(
        f"cast({c} AS double) AS {c}" if c in number
        else f"round({c}, 6) AS {c}" if c in FUZZY else c for c in REORDER_COLUMNS)
    risk_bucket = ("CASE WHEN stockout_risk_pred_proba >= cast(0.7 AS double) THEN 'HIGH' "
                   "WHEN stockout_risk_pred_proba >= cast(0.4 AS double) THEN 'MEDIUM' "
                   "ELSE 'LOW' END AS risk_bucket")
    priority = " ".join(f"WHEN '{a}' THEN {p}" for a, p in ACTION_PRIORITY.items())
    systems = "count(DISTINCT source_system)"
    stock = "wms_inventory_snapshot"
    balance = "on_hand_qty - reserved_qty - damaged_qty - quality_hold_qty"

    def pick(block: str, columns, *more: str) -> str:
        return text(f"SELECT {_rounded(columns, FUZZY)} FROM {block}", block, *more)

    return {
        # sources
        "staging_row_counts": text(" UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
            for t in RETAIL_TABLES), *RETAIL_TABLES),
        "table_row_counts": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in BASE_TABLES),
        # spines and mapped facts
        "week_spine": """
            WITH edges AS (SELECT date_trunc('week', min(o_orderdate)) AS a,
                                  date_trunc('week', max(o_orderdate)) AS b FROM orders),
                 w AS (SELECT cast(unnest(generate_series(cast(a AS timestamp),
                                   cast(b AS timestamp), INTERVAL '7' DAY)) AS date)
                              AS week_start_date FROM edges)
            SELECT w.week_start_date, count(o.o_orderkey) AS order_count
            FROM w LEFT JOIN orders o
              ON cast(date_trunc('week', o.o_orderdate) AS date) = w.week_start_date
            GROUP BY w.week_start_date""",
        "decision_grid": text(f"SELECT {KEY} FROM grid", "grid"),
        "mapped_sales": pick("mapped_sales", [
            "order_line_id", *keyed, "ordered_qty", "fulfilled_qty", "cancelled_qty",
            "unit_selling_price"]),
        "mapped_inventory": pick("mapped_inventory", [
            "sku_id", "center_id", "week_start_date", "snapshot_datetime", "on_hand_qty",
            "reserved_qty", "damaged_qty", "quality_hold_qty", "available_qty",
            "stockout_flag"]),
        "mapped_po": text("SELECT * FROM mapped_po", "mapped_po"),
        "mapped_receipts": text("SELECT * FROM mapped_receipts", "mapped_receipts"),
        "sales_weekly": text("SELECT * FROM sales_weekly", "sales_weekly"),
        "inventory_weekly": text("SELECT * FROM inventory_weekly", "inventory_weekly"),
        "po_position_by_week": text(
            "SELECT sku_id, center_id, week_start_date, open_line_count, confirmed_open_qty, "
            "accepted_qty_as_of_week, open_po_qty AS remaining_qty FROM po_dense", "po_dense"),
        "po_remaining_by_week": text(
            "SELECT w.week_start_date, cast(coalesce(sum(remaining), 0) AS bigint) AS remaining_qty,"
            " count(*) FILTER (WHERE remaining > 0) AS open_line_count FROM weeks w "
            "LEFT JOIN po_position USING (week_start_date) GROUP BY w.week_start_date",
            "po_position", "weeks"),
        "po_weekly": text(
            "SELECT sku_id, center_id, week_start_date, inbound_qty_next_1w, inbound_qty_next_2w,"
            " inbound_qty_next_4w, open_po_qty, overdue_po_qty FROM po_dense", "po_dense"),
        "promotion_candidates": text("SELECT * FROM promotion_candidates", "promotion_candidates"),
        "promotion_weekly": text("SELECT * FROM promotion_weekly", "promotion_weekly"),
        "override_candidates": text("SELECT * FROM override_candidates", "override_candidates"),
        "manual_override_weekly": text("SELECT * FROM override_weekly", "override_weekly"),
        # mart
        "weekly_mart": pick("weekly_mart", MART_COLUMNS),
        "mart_validation": text(f"""
            SELECT count(*) AS mart_row_count,
                   count(*) - count(DISTINCT ({KEY})) AS primary_key_duplicate_count,
                   cast(sum(stockout_flag) AS bigint) AS stockout_flag_sum,
                   cast(sum(promo_flag) AS bigint) AS promo_flag_sum,
                   cast(sum(partial_fulfillment_flag) AS bigint) AS partial_fulfillment_sum,
                   cast(sum(inbound_qty_next_4w) AS bigint) AS inbound_qty_next_4w_sum,
                   cast(sum(fulfilled_qty_1w) AS bigint) AS fulfilled_qty_1w_sum
            FROM weekly_mart""", "weekly_mart"),
        "grain_duplicates": text(" UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count, "
            f"count(DISTINCT ({k})) AS unique_key_count, "
            f"count(*) - count(DISTINCT ({k})) AS duplicate_key_count FROM {t}"
            for t, k in GRAINS.items()), *GRAINS),
        # features
        "receipt_summary": text("SELECT * FROM receipt_summary", "receipt_summary"),
        "completed_po_lines": text(
            "SELECT po_id, po_line_id, vendor_id, completion_datetime, actual_lead_time_days, "
            "round(po_fill_rate, 6) AS po_fill_rate, on_time_delivery FROM completed_po",
            "completed_po"),
        "vendor_performance": pick("vendor_performance", [
            "vendor_id", "week_start_date", "vendor_avg_lead_time", "vendor_lead_time_std",
            "po_fill_rate", "on_time_delivery_rate"]),
        "sales_distortion": pick("distorted", [
            *keyed, "observed_sales_qty", "demand_gap_qty", "sales_censored_flag",
            "stockout_adjusted_sales"]),
        "lag_features": text(
            f"SELECT {KEY}, lag1 AS sales_lag_1w, lag4 AS sales_lag_4w, "
            f"cast(date_diff('week', date '{SCOPE.first_week}', week_start_date) AS int) "
            "AS sales_history_weeks FROM history", "history"),
        "rolling_features": text(
            f"SELECT {KEY}, mean4 AS sales_rolling_mean_4w, "
            "round(std4, 6) AS sales_rolling_std_4w, "
            "round(CASE WHEN mean4 > 0 THEN std4 / mean4 END, 6) AS demand_volatility_index, "
            "adjusted4 AS stockout_adjusted_sales_rolling_mean_4w, "
            "stockouts4 AS stockout_days_last_4w, "
            "1 - stockouts4 / cast(4 AS double) AS in_stock_rate_4w FROM history", "history"),
        "promo_uplift": text("SELECT * FROM promo_uplift", "promo_uplift"),
        "inventory_features": pick("features", [
            *keyed, "inventory_position_qty", "inventory_cover_weeks", "safety_stock_qty"]),
        "product_features": pick("features", [
            *keyed, "order_block_flag", "product_age_weeks", "new_product_flag"]),
        "targets": pick("features", [
            *keyed, "target_demand_next_1w", "target_stockout_risk_next_2w"]),
        "feature_table": pick("features", features),
        "feature_quality": text("""
            SELECT count(*) AS row_count, count(target_demand_next_1w) AS demand_label_count,
                   count(target_stockout_risk_next_2w) AS stockout_label_count,
                   cast(sum(stockout_adjusted_sales) AS bigint) AS stockout_adjusted_sales_sum,
                   count(*) - count(sales_lag_1w) AS sales_lag_1w_null_count,
                   count(*) - count(inventory_cover_weeks) AS inventory_cover_weeks_null_count
            FROM features""", "features"),
        # model-side tables and metrics
        "time_split": text("""
            SELECT 'demand' AS target, week_start_date,
                   CASE WHEN is_test THEN 'test' ELSE 'train' END AS split,
                   count(*) AS row_count FROM demand_rows GROUP BY week_start_date, is_test
            UNION ALL
            SELECT 'stockout', week_start_date, CASE WHEN is_test THEN 'test' ELSE 'train' END,
                   count(*) FROM stockout_rows GROUP BY week_start_date, is_test""",
                           "demand_rows", "stockout_rows"),
        "model_inputs": text(
            f"SELECT {KEY}, "
            + ", ".join(f"round(cast({c} AS double), 6) AS num_{c}" if c in FUZZY
                        else f"cast({c} AS double) AS num_{c}" for c in NUMERIC_FEATURES) + ", "
            + ", ".join(f"coalesce(cast({c} AS string), 'UNKNOWN') AS cat_{c}"
                        for c in CATEGORICAL_FEATURES)
            + " FROM demand_rows", "demand_rows"),
        "demand_baseline": pick("demand_base", [*keyed, "baseline_pred"]),
        "demand_forecast_formula": pick("demand_scored", DEMAND_RESULT_COLUMNS),
        "stockout_baseline": pick("stockout_scored", [*keyed, "baseline_risk_pred"]),
        "stockout_risk_formula": pick("stockout_scored", STOCKOUT_RESULT_COLUMNS),
        "demand_metrics": pick("demand_metrics", DEMAND_METRIC_COLUMNS),
        "stockout_metrics": pick("stockout_metrics", STOCKOUT_METRIC_COLUMNS),
        "ranking_metrics": text(
            "SELECT a.model_name, round(a.roc_auc, 6) AS roc_auc, round(a.pr_auc, 6) AS pr_auc, "
            "cast(sum(k) FILTER (WHERE label = 1) AS bigint) AS positives, "
            "cast(sum(k) FILTER (WHERE label = 0) AS bigint) AS negatives "
            f"FROM per_score JOIN {_areas('scored_long', 'model_name')} a USING (model_name) "
            "GROUP BY a.model_name, a.roc_auc, a.pr_auc", "per_score", "scored_long"),
        "leakage_audit": text(
            "SELECT predictor, " + _RATES + ", round(roc_auc, 6) AS roc_auc, "
            "round(pr_auc, 6) AS pr_auc FROM (SELECT predictor, " + _CONFUSION
            + " FROM audit GROUP BY predictor) c JOIN "
            + _areas("audit", "predictor") + " a USING (predictor)", "audit", "audit_per_score"
        ).replace("per_score p", "audit_per_score p").replace(
            "per_score n", "audit_per_score n").replace("per_score x", "audit_per_score x"),
        "target_rate_by_flag": text("""
            SELECT stockout_flag, count(*) AS row_count,
                   avg(target_stockout_risk_next_2w) AS target_rate
            FROM stockout_scored GROUP BY stockout_flag""", "stockout_scored"),
        # decisions
        "decision_inputs": pick("decision_rows", [
            *keyed, "demand_pred", "stockout_risk_pred_proba", "stockout_risk_pred_label",
            "inventory_cover_weeks"]),
        "order_constraints": pick("constrained", [
            *keyed, "lead_time_weeks", "review_period_weeks", "target_cover_weeks",
            "target_inventory_qty", "raw_order_need"]),
        "constrained_order_qty": pick("constrained", [*keyed, "recommended_order_qty"]),
        "reorder_actions": text(f"SELECT {reorder} FROM decisions", "decisions"),
        "action_summary": text("""
            SELECT count(*) AS output_rows,
                   cast(sum(recommended_order_qty) AS bigint) AS recommended_order_qty_sum,
                   count(*) FILTER (WHERE recommended_action = 'BUY') AS buy_count,
                   count(*) FILTER (WHERE recommended_action = 'HOLD') AS hold_count,
                   count(*) FILTER (WHERE recommended_action = 'EXPEDITE') AS expedite_count,
                   count(*) FILTER (WHERE recommended_action = 'REDUCE') AS reduce_count
            FROM decisions""", "decisions"),
        "decision_validation": text(_rules(
            ("duplicate_key", f"SELECT count(*) - count(DISTINCT ({KEY})) FROM decisions"),
            ("unknown_action", _count("decisions", "recommended_action NOT IN "
                                      "('BUY', 'HOLD', 'EXPEDITE', 'REDUCE')")),
            ("buy_without_quantity", _count("decisions", "recommended_action = 'BUY' "
                                            "AND recommended_order_qty <= 0")),
            ("hold_or_reduce_with_quantity", _count(
                "decisions", "recommended_action IN ('HOLD', 'REDUCE') "
                "AND recommended_order_qty > 0")),
            ("negative_quantity", _count("decisions", "recommended_order_qty < 0")),
        ), "decisions"),
        # serving
        "kpi_summary": text(_kpis(), "demand_metrics", "stockout_metrics", "decisions"),
        "export_overview": text(_kpis(), "demand_metrics", "stockout_metrics", "decisions"),
        "kpi_rows_baseline_filter": text(
            "SELECT model_name, threshold, "
            "CASE WHEN model_name ILIKE '%baseline%' THEN 1 ELSE 0 END AS baseline_flag, "
            "CASE WHEN coalesce(abs(threshold - 0.4) < 0.00001, false) THEN 1 ELSE 0 END "
            "AS final_threshold_flag, round(precision, 6) AS precision FROM stockout_metrics",
            "stockout_metrics"),
        "export_demand": text(
            f"SELECT {_rounded(DEMAND_RESULT_COLUMNS, FUZZY)}, "
            "CASE sign(error) WHEN 1 THEN 'OVER_FORECAST' WHEN -1 THEN 'UNDER_FORECAST' "
            "ELSE 'EXACT' END AS forecast_error_direction, "
            "CASE WHEN ape >= cast(0.5 AS double) THEN 1 ELSE 0 END AS high_ape_flag "
            "FROM demand_scored", "demand_scored"),
        "export_stockout": text(
            f"SELECT {_rounded(STOCKOUT_RESULT_COLUMNS, FUZZY)}, {risk_bucket}, "
            "CASE 10 * target_stockout_risk_next_2w + stockout_risk_pred_label "
            "WHEN 11 THEN 'TRUE_POSITIVE' WHEN 1 THEN 'FALSE_POSITIVE' "
            "WHEN 10 THEN 'FALSE_NEGATIVE' WHEN 0 THEN 'TRUE_NEGATIVE' ELSE 'UNKNOWN' END "
            "AS prediction_result FROM stockout_scored", "stockout_scored"),
        "export_reorder": text(
            f"SELECT {reorder}, CASE recommended_action {priority} END AS action_priority, "
            "recommended_order_qty * unit_cost AS estimated_order_amount, "
            f"{risk_bucket} FROM decisions", "decisions"),
        "sku_detail": text(
            f"SELECT DISTINCT {', '.join(SKU_DETAIL_COLUMNS)} FROM weekly_mart", "weekly_mart"),
        # source quality
        "source_quality": text(_rules(
            ("available_balance", _count(stock, f"available_qty <> {balance}")),
            ("stockout_flag_matches", _count(
                stock, "(stockout_flag = 1) <> (available_qty <= 0)")),
            ("some_stockout", f"SELECT CASE WHEN max(stockout_flag) = 1 THEN 0 ELSE 1 END "
                              f"FROM {stock}"),
            ("fulfilled_within_ordered", _count("oms_sales_orders", "fulfilled_qty > ordered_qty")),
            ("cancelled_within_ordered", _count("oms_sales_orders", "cancelled_qty > ordered_qty")),
            ("some_partial_fulfillment", "SELECT CASE WHEN bool_or(fulfilled_qty < ordered_qty) "
                                         "THEN 0 ELSE 1 END FROM oms_sales_orders"),
            ("confirmed_within_ordered", _count("erp_purchase_orders",
                                                "confirmed_qty > ordered_qty")),
            ("received_balance", _count("wms_goods_receipts",
                                        "received_qty <> accepted_qty + rejected_qty")),
            ("promo_type_domain", _count("md_promotion_calendar", "promo_type NOT IN "
                                         "('PRICE_DISCOUNT', 'COUPON', 'SPECIAL_EXHIBITION')")),
            ("source_system_domain", _count("sku_code_mapping", "source_system NOT IN "
                                            "('OMS', 'WMS', 'ERP', 'MD')")),
            ("sku_vendor_reference", _count("sku_master", "default_vendor_id NOT IN "
                                            "(SELECT vendor_id FROM vendor_master)")),
            ("receipt_po_reference", "SELECT count(*) FROM wms_goods_receipts r LEFT JOIN "
             "erp_purchase_orders p USING (po_id, po_line_id) WHERE p.vendor_id IS NULL"),
            ("vendor_outcomes_absent", "SELECT 0"),
        ), stock, "oms_sales_orders", "erp_purchase_orders", "wms_goods_receipts",
            "md_promotion_calendar", "sku_code_mapping", "sku_master", "vendor_master"),
        "orphan_receipts": text("""
            SELECT receipt_id, receipt_line_id, po_id, po_line_id FROM wms_goods_receipts r
            WHERE NOT EXISTS (SELECT 1 FROM mapped_po p WHERE p.po_id = r.po_id
                              AND p.po_line_id = r.po_line_id)""",
                                "wms_goods_receipts", "mapped_po"),
        "facts_outside_scope": text(" UNION ALL ".join(
            f"SELECT '{table}' AS table_name, count(*) AS row_count, "
            f"count(*) FILTER (WHERE {channel or 'false'}) AS outside_channels, "
            f"count(*) FILTER (WHERE {center or 'false'}) AS outside_centers, "
            f"count(*) FILTER (WHERE {week}) AS outside_weeks FROM {table}"
            for table, channel, center, week in (
                ("oms_sales_orders", _not_in("channel_id", "channels", "channel_id"),
                 _not_in("fulfillment_center_id", "centers", "center_id"),
                 _no_week("order_datetime")),
                ("wms_inventory_snapshot", None, _not_in("center_id", "centers", "center_id"),
                 _no_week("snapshot_datetime")),
                ("erp_purchase_orders", None, _not_in("center_id", "centers", "center_id"),
                 _no_week("po_created_date")),
                ("wms_goods_receipts", None, _not_in("center_id", "centers", "center_id"),
                 _no_week("receipt_datetime")),
                ("md_promotion_calendar", _not_in("channel_id", "channels", "channel_id"), None,
                 "NOT EXISTS (SELECT 1 FROM weeks w WHERE promo_start_date < w.week_start_date + 7"
                 " AND promo_end_date >= w.week_start_date)"),
            )), "oms_sales_orders", "wms_inventory_snapshot", "erp_purchase_orders",
            "wms_goods_receipts", "md_promotion_calendar", "channels", "centers", "weeks"),
        "model_result_audit": text("""
            SELECT rule, rows_checked, 0 AS violations FROM (
                SELECT unnest(['demand_not_negative', 'demand_error', 'demand_abs_error',
                               'demand_ape']) AS rule, count(*) AS rows_checked
                FROM demand_scored
                UNION ALL SELECT unnest(['risk_is_probability', 'risk_label']), count(*)
                FROM stockout_scored) x""", "demand_scored", "stockout_scored"),
        "mapping_completeness": text(f"""
            SELECT sku_id, coalesce(n, 0) AS system_count,
                   CASE WHEN n = 4 THEN 1 ELSE 0 END AS complete_flag
            FROM sku_master LEFT JOIN (SELECT sku_id, {systems} AS n FROM sku_code_mapping
                 WHERE mapping_status = 'VALID' GROUP BY sku_id) x USING (sku_id)""",
                                     "sku_master", "sku_code_mapping"),
        "snapshot_gaps": text("""
            SELECT sku_id, center_id, week_start_date FROM sku_master, centers, weeks
            EXCEPT SELECT sku_id, center_id, week_start_date FROM mapped_inventory""",
                              "sku_master", "centers", "weeks", "mapped_inventory"),
        "join_cardinality": text("""
            SELECT 'po lines with receipts' AS join_name,
                   count(*) FILTER (WHERE l > 0 AND r > 0) AS matched_keys,
                   count(*) FILTER (WHERE r IS NULL) AS left_only_keys,
                   count(*) FILTER (WHERE l IS NULL) AS right_only_keys,
                   max(coalesce(l, 0)) AS max_left_rows, max(coalesce(r, 0)) AS max_right_rows
            FROM (SELECT po_id, po_line_id, count(*) AS l FROM erp_purchase_orders
                  GROUP BY po_id, po_line_id) a
            FULL JOIN (SELECT po_id, po_line_id, count(*) AS r FROM wms_goods_receipts
                       GROUP BY po_id, po_line_id) b USING (po_id, po_line_id)""",
                                 "erp_purchase_orders", "wms_goods_receipts"),
    }


GRAINS = {
    "sku_master": "sku_id",
    "vendor_master": "vendor_id",
    "sku_code_mapping": "source_system, source_sku_code, effective_from",
    "oms_sales_orders": "order_line_id",
    "erp_purchase_orders": "po_id, po_line_id",
    "weekly_mart": KEY,
}

BLOCKS.update({
    "audit": (("stockout_scored",), """
        SELECT 'stockout_flag' AS predictor, target_stockout_risk_next_2w AS label,
               stockout_flag AS predicted, cast(stockout_flag AS double) AS score
        FROM stockout_scored
        UNION ALL
        SELECT 'model', target_stockout_risk_next_2w, stockout_risk_pred_label,
               stockout_risk_pred_proba FROM stockout_scored"""),
    "audit_per_score": (("audit",), """
        SELECT predictor, score, label, count(*) AS k FROM audit
        GROUP BY predictor, score, label"""),
})
