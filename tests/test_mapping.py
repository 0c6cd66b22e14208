"""Codes, their intervals, and codes that own most of a table."""

import random
from datetime import datetime, timedelta

import pytest
from fixtures import MAPPING, D, Sources, rows_of, table
from pyspark.sql import functions as F

from shelfspark.operators.mapping import CodeMapping, map_codes, measured_mapping
from shelfspark.plans.mart import weekly_mart
from shelfspark.sources.testbed import SPARK_DIALECT, view_ctes


def _random_rows(rng, facts=400, intervals=40):
    day = lambda: D("2025-01-01") + timedelta(days=rng.randrange(60))
    mapping = [
        dict(sku_id=rng.choice(["S1", "S2", None]), source_system=rng.choice(["OMS", "WMS"]),
             source_sku_code=rng.choice(["a", "b", "c", None]),
             effective_from=rng.choice([day(), day(), None]),
             effective_to=rng.choice([day(), None]), mapping_status=rng.choice(["VALID", "VALID", "INVALID"]))
        for _ in range(intervals)]
    mapping += mapping[:5]  # a row given twice fans out twice
    orders = [
        dict(order_line_id=str(k), oms_sku_code=rng.choice(["a", "a", "a", "b", "c", "z", None]),
             order_datetime=rng.choice([datetime.combine(day(), datetime.min.time()), None]))
        for k in range(facts)]
    return mapping, orders


@pytest.mark.parametrize("hot", [{}, {"OMS": ["a"], "WMS": ["b"]}])
def test_intervals_equal_the_pairwise_join(spark, hot):
    """Overlapping and repeated intervals fan out, NULL codes and days match nothing, hot codes lose and repeat no row."""
    mapping, orders = _random_rows(random.Random(3))
    rows = table(spark, "sku_code_mapping", mapping)
    got = map_codes(table(spark, "oms_sales_orders", orders), CodeMapping(rows, hot, 7), "OMS", "oms_sku_code", "order_datetime")
    assert got.columns == [*table(spark, "oms_sales_orders").columns, "sku_id"]
    expected = [
        (o["order_line_id"], m["sku_id"]) for o in orders for m in mapping
        if m["source_system"] == "OMS" and m["mapping_status"] == "VALID" and o["oms_sku_code"] is not None
        and o["oms_sku_code"] == m["source_sku_code"] and o["order_datetime"] is not None and m["effective_from"] is not None
        and m["effective_from"] <= o["order_datetime"].date()
        and (m["effective_to"] is None or o["order_datetime"].date() <= m["effective_to"])]
    assert len(expected) > 100
    assert rows_of(got, "order_line_id", "sku_id") == sorted(expected, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_a_code_with_most_of_the_facts_is_spread(spark):
    """Nine tenths of the snapshots are of one code: measured as hot, its facts reach all tasks of a shuffle join."""
    sources = Sources(spark, sku_code_mapping=[*MAPPING, *[
        dict(source_system="WMS", source_sku_code=f"WMS-{k}") for k in range(2, 400)]])
    sources.wms_inventory_snapshot = spark.range(40_000).select(
        F.concat(F.lit("WMS-"), F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id") % 399 + 1)).alias("wms_sku_code"),
        F.lit(datetime(2025, 1, 6, 8)).alias("snapshot_datetime"), F.col("id").alias("on_hand_qty"))
    mapping = measured_mapping(sources)
    assert mapping.hot == {"WMS": ["WMS-1"]}
    before = {key: spark.conf.get(key) for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        largest = {}
        for name, given in (("plain", sources.sku_code_mapping), ("spread", mapping)):
            mapped = map_codes(sources.wms_inventory_snapshot, given, "WMS", "wms_sku_code", "snapshot_datetime")
            per_task = [r["count"] for r in mapped.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(per_task) == 40_000
            largest[name] = max(per_task)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert largest["plain"] >= 36_000 and largest["spread"] <= 12_000


def test_mart_is_the_same_with_measured_codes(spark):
    sources = Sources(
        spark, oms_sales_orders=[dict(order_datetime=datetime(2025, 1, 7), ordered_qty=k) for k in range(20)],
        wms_inventory_snapshot=[dict(snapshot_datetime=datetime(2025, 1, 8))], erp_purchase_orders=[{}],
        wms_goods_receipts=[dict(receipt_datetime=datetime(2025, 1, 9))], md_promotion_calendar=[{}])
    mapping = measured_mapping(sources)
    assert set(mapping.hot) == {"OMS", "WMS", "ERP", "MD"}
    facts = ["ordered_qty_1w", "available_qty", "open_po_qty", "promo_flag"]
    plain, spread = (weekly_mart(sources, sources.scope, m).cache() for m in (None, mapping))
    assert rows_of(plain, "*") == rows_of(spread, "*")
    assert all(spread.filter(F.col(name) > 0).count() for name in facts)


def test_skus_grow_with_the_parts(spark):
    """25,000 parts are three blocks of brands; the promotions of 15,000 customers belong to two of them."""
    part = spark.range(25_000).selectExpr(
        "id AS p_partkey", "'Brand#' || (id % 25 + 1) AS p_brand", "'T' AS p_type", "'N' AS p_name", "10.0D AS p_retailprice")
    customer = spark.range(15_000).selectExpr(
        "id AS c_custkey", "id % 25 AS c_nationkey", "'BUILDING' AS c_mktsegment", "1.0D AS c_acctbal")
    fill = {**SPARK_DIALECT, "part": "{part}", "customer": "{customer}"}
    read = lambda name, **t: spark.sql(f"WITH {view_ctes([name], **fill)} SELECT * FROM {name}", **t)
    skus, codes = read("sku_master", part=part), read("sku_code_mapping", part=part)
    assert skus.count() == skus.select("sku_id").distinct().count() == 75 and codes.count() == 300
    assert skus.filter("default_vendor_id NOT BETWEEN 'NATION_0' AND 'NATION_9' OR launch_date > '1999-01-01'").count() == 0
    known = {r.source_sku_code for r in codes.filter("source_system = 'MD'").collect()}
    used = {r.md_sku_code for r in read("md_promotion_calendar", customer=customer).select("md_sku_code").distinct().collect()}
    assert used < known and len(used) == 50
