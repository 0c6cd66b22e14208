"""What the retail queries leave on disk: layouts, staging and shuffle files."""

import tempfile
import time
from pathlib import Path

import pytest
from fixtures import MAPPING, SCOPE, Sources, rows_of, table
from pyspark.sql import functions as F

from shelfspark.operators import purchasing, quality
from shelfspark.plans import catalog, features
from shelfspark.session import ROWS_PER_TASK, shuffle_width, staged, tuned, widen_shuffles
from shelfspark.sources.testbed import Retail

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def shuffle_files(spark) -> set[str]:
    root = Path(spark.conf.get("spark.local.dir", tempfile.gettempdir()))
    return {str(f) for f in root.glob("blockmgr-*/*/shuffle_*")}


def test_a_stage_leaves_no_shuffle_files(spark):
    """A stage's result is written, so what it was shuffled from goes at once, not with the next garbage collection."""
    tuned(spark)
    before = shuffle_files(spark)
    counts = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and counts.count() == 7


def test_shuffles_begin_as_wide_as_the_lines_need(spark):
    kept = spark.conf.get(INITIAL, None)
    try:
        widen_shuffles(spark, 1)
        assert int(spark.conf.get(INITIAL)) == shuffle_width(spark)
        widen_shuffles(spark, 100 * ROWS_PER_TASK + 1)
        assert int(spark.conf.get(INITIAL)) == 101
    finally:
        spark.conf.set(INITIAL, kept) if kept else spark.conf.unset(INITIAL)


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Base tables with repeated and missing keys."""
    folder = str(tmp_path_factory.mktemp("base"))
    tables = {
        "region": spark.range(3).selectExpr("id AS r_regionkey", "concat('R', id) AS r_name"),
        "nation": spark.range(6).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name", "id % 3 AS n_regionkey"),
        "customer": spark.range(3).selectExpr("id AS c_custkey", "id AS c_nationkey", "'BUILDING' AS c_mktsegment", "1.0D AS c_acctbal"),
        "supplier": spark.range(8).selectExpr("id AS s_suppkey", "IF(id = 5, NULL, id % 6) AS s_nationkey"),
        "part": spark.range(40).selectExpr(
            "id * 400 AS p_partkey", "IF(id = 7, NULL, concat('Brand#', id % 25 + 1)) AS p_brand", "'T' AS p_type",
            "'N' AS p_name", "10.0D AS p_retailprice", "CAST(id AS int) AS p_size"),
        "orders": spark.range(30).selectExpr(
            "IF(id = 4, NULL, id) AS o_orderkey", "substr('FOP', CAST(id % 3 AS int) + 1, 1) AS o_orderstatus",
            "IF(id = 6, NULL, timestamp_ntz'1995-01-02 00:00:00' + id * INTERVAL '40' DAY) AS o_orderdate"),
        "lineitem": spark.range(300).selectExpr(
            "IF(id % 50 = 3, NULL, id % 33) AS l_orderkey", "CAST(id % 4 AS int) AS l_linenumber", "id % 43 * 400 AS l_partkey",
            "IF(id % 60 = 8, NULL, id % 9) AS l_suppkey", "CAST(id % 11 + 1 AS double) AS l_quantity", "id * 3.5D AS l_extendedprice",
            "IF(id % 5 = 0, 'R', 'N') AS l_returnflag", "IF(id % 2 = 0, 0.0D, 0.1D) AS l_tax"),
    }
    for name, df in tables.items():
        if name in ("orders", "lineitem", "part"):
            df = df.unionByName(df.filter(F.col(df.columns[0]).isNull() | (F.col(df.columns[0]) % 4 == 0)))
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


def same_rows(a, b) -> bool:
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_order_lines_equal_their_text(spark, odd_tables):
    """Orders joined last change no row of the view or of what reads it."""
    retail = Retail(spark, odd_tables)
    lines = retail._order_line()
    assert lines.count() > 100 and same_rows(lines, retail._query("order_line", {}))
    for name in ("oms_sales_orders", "wms_inventory_snapshot", "erp_purchase_orders", "wms_goods_receipts"):
        assert same_rows(retail._build(name), retail._query(name, {})), name


def test_positions_are_laid_by_sku(spark):
    """Registered positions meet by SKU: same rows, and no exchange by purchase-order line or of their changes."""
    orders = table(spark, "erp_purchase_orders", [dict(po_id="P1"), dict(po_id="P2", confirmed_qty=7), dict(po_id=None)])
    receipts = table(spark, "wms_goods_receipts", [dict(po_id="P2", accepted_qty=3), dict(po_id="P1", accepted_qty=99)])
    tables = orders, receipts, table(spark, "sku_code_mapping", MAPPING), table(spark, "sku_master", [{}, {"sku_id": "S2"}]), SCOPE
    for positions in (purchasing.po_weekly, purchasing.po_open_position):
        by_line, by_sku = positions(*tables), positions(*tables, 5)
        assert same_rows(by_line, by_sku) and by_sku.count() == 2 * 2 * 13
        assert "hashpartitioning(po_id" not in by_sku._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["po_weekly", "po_position_by_week", "po_remaining_by_week", "source_quality", "inventory_features"])
def test_queries_read_stored_purchase_lines(spark, odd_tables, name, monkeypatch):
    """The purchase-order lines that positions, receipts and checks read are summed and written once."""
    from shelfspark.sources import testbed
    written = []
    monkeypatch.setattr(testbed, "staged", lambda df, name: written.append(name) or staged(df, name))
    found = catalog.QUERIES[name](spark, odd_tables)
    assert written.count("erp_purchase_orders") == 1 and len(set(written)) == len(written)
    # Queries on purchase-order lines alone sum the lines while they are joined.
    assert ("order_line" in written) != name.startswith("po_")
    assert not any("lineitem" in file for file in found.inputFiles())


def test_vendor_weeks_are_stored(spark, monkeypatch):
    """The feature table reads the performance per vendor and week, not the lines it is summed from."""
    written = []
    monkeypatch.setattr(features, "staged", lambda df, name: written.append((name, df.count())) or staged(df, name))
    sources = Sources(spark, erp_purchase_orders=[{}])
    assert features.feature_table(sources, SCOPE).count() == 2 * 2 * 13
    assert written == [("vendor-weeks", 13)]


def test_orphans_are_counted_per_receipt(spark):
    """Repeated receipts and receipts without a line count one each, though they are looked up per line."""
    receipts = [dict(po_id="P1"), dict(po_id="P9"), dict(po_id="P9"), dict(po_id="P9", po_line_id="2"), dict(po_id=None)]
    sources = Sources(spark, erp_purchase_orders=[{}, {}], wms_goods_receipts=receipts)
    assert dict(rows_of(quality.source_quality(sources), "rule", "violations"))["receipt_po_reference"] == 4
