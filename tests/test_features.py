"""Panel features, vendor history and labels."""

import random
from datetime import date, datetime, timedelta
from statistics import fmean, pstdev

import pytest
from fixtures import D, SCOPE, TS, Sources, table
from pyspark.sql import functions as F

from shelfspark.operators import panel, vendors
from shelfspark.plans.features import FEATURE_COLUMNS, add_features, feature_table

WEEKS = [date(2025, 1, 6) + timedelta(7 * i) for i in range(13)]


def series(spark, **columns):
    names = list(columns)
    rows = [("S1", "A", "C1", WEEKS[i], *[columns[n][i] for n in names])
            for i in range(len(columns[names[0]]))]
    return spark.createDataFrame(
        rows, "sku_id string, channel_id string, center_id string, week_start_date date, "
        + ", ".join(f"{n} bigint" for n in names))


def by_week(df, *columns):
    return [tuple(r) for r in df.orderBy("week_start_date").select(*columns).collect()]


def test_first_weeks_and_short_history(spark):
    df = series(spark, observed_sales_qty=[4, 8, 0, 0, 0, 0, 0],
                stockout_adjusted_sales=[4, 8, 0, 0, 0, 0, 0], stockout_flag=[1, 0, 1, 0, 0, 0, 0])
    got = by_week(panel.rolling_features(panel.lag_features(df)), "sales_lag_1w", "sales_lag_4w",
                  "sales_rolling_mean_4w", "sales_rolling_std_4w", "stockout_days_last_4w",
                  "in_stock_rate_4w", "sales_history_weeks", "demand_volatility_index")
    assert got[0] == (None, None, None, None, 0, 1.0, 0, None)
    assert got[1] == (4, None, 4.0, 0.0, 1, 0.75, 1, 0.0)
    assert got[2][2:4] == (6.0, 2.0)
    assert got[4] == (0, 4, 3.0, pytest.approx(pstdev([4, 8, 0, 0])), 2, 0.5, 4,
                      pytest.approx(pstdev([4, 8, 0, 0]) / 3))
    assert got[6][2:4] == (0.0, 0.0) and got[6][7] is None, "zero mean has no volatility"


def test_distortion(spark):
    df = series(spark, ordered_qty_1w=[5, 2], fulfilled_qty_1w=[3, 4],
                partial_fulfillment_flag=[1, 0], stockout_flag=[0, 0])
    assert by_week(panel.sales_distortion(df), "observed_sales_qty", "demand_gap_qty",
                   "sales_censored_flag", "stockout_adjusted_sales") == [
        (3, 2, 1, 5), (4, 0, 0, 4)]


@pytest.mark.parametrize("flags, sales, expected", [
    ([0, 0, 0], [5, 5, 5], [1.0, 1.0, 1.0]),
    ([0, 1, 0], [10, 0, 5], [1.0, 1.0, 0.25]),
    ([0, 1, 0], [10, 100, 5], [1.0, 1.0, 4.0]),
    ([0, 1, 0], [10, 20, 5], [1.0, 1.0, 2.0]),
])
def test_uplift(spark, flags, sales, expected):
    df = series(spark, promo_flag=flags, stockout_adjusted_sales=sales)
    assert [r[0] for r in by_week(panel.promo_uplift(df), "historical_promo_uplift")] == expected


def test_uplift_pools_channels_of_earlier_weeks_only(spark):
    rows = [("S1", ch, "C1", WEEKS[w], p, s) for ch, w, p, s in [
        ("A", 0, 1, 30), ("B", 0, 0, 10), ("A", 1, 0, 20), ("B", 1, 0, 999), ("A", 2, 0, 1)]]
    df = spark.createDataFrame(rows, "sku_id string, channel_id string, center_id string, "
                               "week_start_date date, promo_flag int, "
                               "stockout_adjusted_sales bigint")
    got = panel.promo_uplift(df).groupBy("week_start_date").agg(
        F.min("historical_promo_uplift"), F.max("historical_promo_uplift"))
    values = {r[0]: (r[1], r[2]) for r in got.collect()}
    assert values == {WEEKS[0]: (1.0, 1.0), WEEKS[1]: (3.0, 3.0), WEEKS[2]: (0.25, 0.25)}


def test_label_tail(spark):
    df = series(spark, stockout_adjusted_sales=[1, 2, 3, 4], stockout_flag=[0, 0, 1, 0])
    assert by_week(panel.targets(df), "target_demand_next_1w",
                   "target_stockout_risk_next_2w") == [(2, 1), (3, 1), (4, None), (None, None)]


def vendor_rows(spark, po, receipts, scope=SCOPE):
    out = vendors.vendor_performance(
        table(spark, "vendor_master", [{}]), table(spark, "erp_purchase_orders", po),
        table(spark, "wms_goods_receipts", receipts), scope)
    return {r.week_start_date: tuple(r)[2:] for r in out.collect()}


def test_vendor_cold_start(spark):
    po = [dict(po_id="1", ordered_qty=20, promised_delivery_date=D("2025-01-10")),
          dict(po_id="2", promised_delivery_date=D("2025-01-10"))]
    receipts = [
        dict(po_id="1", accepted_qty=10, receipt_datetime=TS("2025-01-09T10:00:00")),
        dict(po_id="2", accepted_qty=10, receipt_datetime=TS("2025-01-20T08:00:00"))]
    got = vendor_rows(spark, po, receipts)
    assert got[D("2025-01-06")] == (14.0, 2.0, 0.75, 0.94)
    assert got[D("2025-01-13")] == (8.0, 2.0, 0.5, 1.0)
    assert got[D("2025-01-20")] == got[D("2025-01-13")], "08:00 itself is not before the cutoff"
    assert got[D("2025-01-27")] == (13.5, 5.5, 0.75, 0.5)


def test_vendor_history_equals_pairwise_join(spark):
    rng = random.Random(3)
    po, receipts, done = [], [], []
    for i in range(80):
        created = date(2024, 11, 1) + timedelta(rng.randrange(140))
        at = datetime.combine(created, datetime.min.time()) + timedelta(
            days=rng.randrange(1, 40), hours=rng.choice([7, 8, 9]))
        ordered, accepted = rng.randrange(10, 20), rng.randrange(8, 14)
        promised = created + timedelta(20)
        po.append(dict(po_id=f"{i}", po_created_date=created, ordered_qty=ordered,
                       confirmed_qty=10, promised_delivery_date=promised))
        receipts.append(dict(po_id=f"{i}", accepted_qty=accepted, receipt_datetime=at))
        if accepted >= 10:
            done.append((at, (at.date() - created).days, min(accepted / ordered, 1.0),
                         at.date() <= promised))
    got = vendor_rows(spark, po, receipts)
    for week in WEEKS:
        cutoff = datetime.combine(week, datetime.min.time()) + timedelta(hours=8)
        past = [d for d in done if d[0] < cutoff]
        assert got[week] == pytest.approx((
            fmean(d[1] for d in past), pstdev([d[1] for d in past]) if len(past) > 1 else 2.0,
            fmean(d[2] for d in past), fmean(d[3] for d in past)))


def busy_sources(spark, until=None):
    rng = random.Random(11)
    orders, snapshots, po, receipts = [], [], [], []
    for i in range(150):
        day = datetime(2025, 1, 6, 10) + timedelta(days=rng.randrange(91))
        q = rng.randrange(1, 9)
        orders.append(dict(order_line_id=str(i), order_datetime=day, ordered_qty=q,
                           fulfilled_qty=q - rng.randrange(2), channel_id=rng.choice("AB")))
        n = rng.randrange(4)
        snapshots.append(dict(snapshot_datetime=day.replace(hour=8), on_hand_qty=n,
                              available_qty=n, stockout_flag=int(n == 0)))
        if i % 3 == 0:
            po.append(dict(po_id=str(i), po_created_date=day.date(),
                           promised_delivery_date=day.date() + timedelta(9)))
            receipts.append(dict(po_id=str(i), accepted_qty=10,
                                 receipt_datetime=day + timedelta(rng.randrange(3, 20))))
    if until:
        orders = [r for r in orders if r["order_datetime"] < until]
        snapshots = [r for r in snapshots if r["snapshot_datetime"] < until]
        po = [r for r in po if r["po_created_date"] < until.date()]
        receipts = [r for r in receipts if r["receipt_datetime"] < until]
    return Sources(spark, oms_sales_orders=orders, wms_inventory_snapshot=snapshots,
                   erp_purchase_orders=po, wms_goods_receipts=receipts,
                   md_promotion_calendar=[{}], manual_overrides=[{}])


def test_features_use_no_later_rows(spark):
    """Deleting everything after a week changes no feature up to that week."""
    week = date(2025, 2, 10)
    labels = {"target_demand_next_1w", "target_stockout_risk_next_2w"}
    sides = [
        feature_table(busy_sources(spark, until), SCOPE).filter(F.col("week_start_date") <= week)
        for until in (None, datetime(2025, 2, 17))
    ]
    columns = [c for c in sides[0].columns if c not in labels]
    a, b = (side.select(*columns) for side in sides)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).isEmpty()


def test_feature_table_shape(spark):
    df = feature_table(busy_sources(spark), SCOPE)
    assert len(df.columns) == 82
    assert df.columns[53:] == FEATURE_COLUMNS
    with pytest.raises(ValueError, match="missing required columns: launch_date"):
        add_features(df.drop("launch_date"), None)
