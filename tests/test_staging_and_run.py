"""CSV staging, table outputs and the complete run."""

import pytest
from fixtures import SCOPE, Sources
from pyspark.sql import functions as F
from test_features import busy_sources

from shelfspark.fixed_values import MART_COLUMNS
from shelfspark.operators import contracts, purchasing, vendors
from shelfspark.operators.quality import orphan_receipts
from shelfspark.plans.weekly_run import run
from shelfspark.schemas import SOURCE_TABLES, schema_of
from shelfspark.sources import bucketed, versions
from shelfspark.sources.staging import (
    Staged, read_csv, require_inputs, require_outputs, require_schema, stage_csv, write_csv,
)


def test_csv_with_mark_blanks_and_bad_text(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("﻿sku_id,source_system,source_sku_code,effective_from,effective_to,"
                    "mapping_status\nS1,OMS,c,2022-10-03,,VALID\nS2,OMS,,soon,2023-01-01,\n",
                    encoding="utf-8")
    rows = read_csv(spark, str(path), schema_of("sku_code_mapping")).collect()
    assert rows[0].sku_id == "S1" and str(rows[0].effective_from) == "2022-10-03"
    assert rows[0].effective_to is None
    assert rows[1].effective_from is None and rows[1].source_sku_code is None


def test_missing_inputs_are_all_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    with pytest.raises(FileNotFoundError, match="b .*c "):
        require_inputs(spark, {n: str(tmp_path / f"{n}.csv") for n in "abc"})


def test_sources_to_exports(spark, tmp_path):
    """Write the fixtures as CSV, stage them, and run every stage to the exports."""
    raw, staging, out = (str(tmp_path / n) for n in ("raw", "staging", "out"))
    given = busy_sources(spark)
    for name in SOURCE_TABLES:
        write_csv(getattr(given, name), f"{raw}/{name}.csv")
    counts = stage_csv(spark, raw, staging)
    assert counts["oms_sales_orders"] == 150

    sources = Staged(spark, staging, SCOPE)
    for name in SOURCE_TABLES:
        assert getattr(sources, name).exceptAll(getattr(given, name)).isEmpty(), name

    paths = run(sources, out, rounds=2, importance=False)
    mart = spark.read.parquet(paths["weekly_mart"])
    assert sorted(mart.columns) == sorted(MART_COLUMNS) and mart.count() == 2 * 2 * 13
    assert spark.read.parquet(paths["kpi_summary"]).count() == 30
    assert spark.read.parquet(paths["export_reorder"]).count() == 28
    spark.read.parquet(paths["kpi_summary"]).filter("1 = 0").write.parquet(f"{out}/none")
    with pytest.raises(ValueError, match="empty outputs: none"):
        require_outputs(spark, {"none": f"{out}/none"})


def test_reading_one_week_prunes_the_others(spark, tmp_path):
    from shelfspark.plans.mart import weekly_mart
    from shelfspark.sources.staging import write_weekly

    mart = write_weekly(weekly_mart(busy_sources(spark), SCOPE), str(tmp_path / "mart"))
    assert mart.columns == MART_COLUMNS
    week = mart.filter("week_start_date = DATE '2025-02-10'").select("sku_id", "ordered_qty_1w")
    plan = week._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(week_start_date" in scan
    assert "ReadSchema: struct<sku_id:string,ordered_qty_1w:bigint>" in scan
    assert week.count() == 4


def po_csv(spark, folder, lines=40, receipts=3):
    """PO lines and receipts as CSV, one line without receipts, one receipt without a line."""
    orders = [dict(po_id=f"P{k}", po_line_id=str(k % 3)) for k in range(lines)]
    rows = [dict(receipt_id=f"R{k}-{j}", po_id=f"P{k}", po_line_id=str(k % 3), accepted_qty=3 + j)
            for k in range(1, lines) for j in range(receipts)]
    rows.append(dict(receipt_id="lost", po_id="none", po_line_id="1"))
    given = Sources(spark, erp_purchase_orders=orders, wms_goods_receipts=rows)
    for name in SOURCE_TABLES:
        write_csv(getattr(given, name), f"{folder}/{name}.csv")
    return given


def line_results(s):
    """Four jobs that bring PO lines and receipts together; the few code mappings are broadcast."""
    segments = purchasing.po_segments(
        s.erp_purchase_orders, s.wms_goods_receipts, F.broadcast(s.sku_code_mapping), SCOPE)
    return {
        "segments": segments,
        "completed": vendors.completed_po_lines(s.erp_purchase_orders, s.wms_goods_receipts),
        "orphans": orphan_receipts(s.wms_goods_receipts, s.erp_purchase_orders),
        "cardinality": contracts.join_cardinality(
            s.erp_purchase_orders, s.wms_goods_receipts, bucketed.LINE, "po"),
    }


def test_lines_and_receipts_meet_without_exchange(spark, tmp_path):
    raw, staging = str(tmp_path / "raw"), str(tmp_path / "staging")
    given = po_csv(spark, raw)
    stage_csv(spark, raw, staging, bucket_bytes=1000)
    marker = versions.current(spark, f"{staging}/wms_goods_receipts")
    assert marker.buckets > 1 and marker.row_count == 118
    assert marker.buckets == versions.current(spark, f"{staging}/erp_purchase_orders").buckets
    expected = line_results(given)
    # The tables of another session are declared anew from the marker.
    for path in (versions.current_path(spark, f"{staging}/{name}") for name in bucketed.TABLES):
        spark.sql(f"DROP TABLE {bucketed._name(path)}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for name, rows in line_results(Staged(spark, staging, SCOPE)).items():
        assert rows.exceptAll(expected[name]).isEmpty() and expected[name].exceptAll(rows).isEmpty(), name
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sources = Staged(spark, staging, SCOPE)
        for name, rows in line_results(sources).items():
            plan = rows._jdf.queryExecution().executedPlan().toString()
            exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning(po_id" in line]
            # Both sides of the cardinality are summed in their buckets; the union of the sums is shuffled once.
            assert len(exchanges) == (1 if name == "cardinality" else 0), (name, plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_heavy_line_is_not_bucketed(spark, tmp_path):
    raw, staging = str(tmp_path / "raw"), str(tmp_path / "staging")
    po_csv(spark, raw)
    heavy = [dict(receipt_id=f"H{k}", po_id="P1", po_line_id="1") for k in range(500)]
    write_csv(Sources(spark, wms_goods_receipts=heavy).wms_goods_receipts, f"{raw}/wms_goods_receipts.csv")
    stage_csv(spark, raw, staging, bucket_bytes=1000)
    assert versions.current(spark, f"{staging}/wms_goods_receipts").buckets == 0
    assert Staged(spark, staging, SCOPE).wms_goods_receipts.count() == 500


def test_failed_staging_leaves_the_old_tables(spark, tmp_path):
    raw, staging = str(tmp_path / "raw"), str(tmp_path / "staging")
    po_csv(spark, raw)
    stage_csv(spark, raw, staging)
    old = versions.current_path(spark, f"{staging}/sku_master")
    text = ",".join(schema_of("vendor_master").fieldNames()) + "\nV1,,,x,,,,,,,,\n"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "vendor_master.csv").write_text(text)
    write_csv(Sources(spark, sku_master=[{}, dict(sku_id="S2")]).sku_master, str(tmp_path / "bad" / "sku_master.csv"))
    with pytest.raises(ValueError, match="unreadable"):
        stage_csv(spark, str(tmp_path / "bad"), staging, ["sku_master", "vendor_master"])
    assert versions.current_path(spark, f"{staging}/sku_master") == old
    assert Staged(spark, staging, SCOPE).sku_master.count() == 1
    stage_csv(spark, str(tmp_path / "bad"), staging, ["sku_master"])
    assert Staged(spark, staging, SCOPE).sku_master.count() == 2
    assert versions.drop_superseded(spark, f"{staging}/sku_master") == [old.rsplit("/", 1)[1]]
    assert Staged(spark, staging, SCOPE).sku_master.count() == 2


def test_failed_run_leaves_the_last_one(spark, tmp_path, monkeypatch):
    from shelfspark.plans import weekly_run

    out = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError, match="nothing published"):
        versions.current_path(spark, out)
    versions.publish(spark, out, "earlier")

    def broken(*_):
        raise RuntimeError("lost between two stages")

    monkeypatch.setattr(weekly_run, "vendor_features", broken)
    with pytest.raises(RuntimeError, match="lost between"):
        run(busy_sources(spark), out, rounds=2, importance=False)
    assert versions.current_path(spark, out) == f"{out}/earlier"


def test_stored_columns_are_compared(spark, tmp_path):
    declared = schema_of("vendor_master")
    stored = Sources(spark).vendor_master
    require_schema(stored.schema, declared, "vendor_master")
    other = stored.drop("payment_terms").withColumn("import_flag", stored.import_flag.cast("string"))
    version = versions.new_version()
    other.write.parquet(f"{tmp_path}/vendor_master/{version}")
    versions.publish(spark, f"{tmp_path}/vendor_master", version, 1)
    with pytest.raises(ValueError, match="vendor_master: stored columns differ.* import_flag, payment_terms"):
        Staged(spark, str(tmp_path), SCOPE).vendor_master
    with pytest.raises(FileNotFoundError, match="sku_master is not staged"):
        Staged(spark, str(tmp_path), SCOPE).sku_master


def test_all_keys_in_one_pass(spark):
    s = Sources(spark, sku_master=[{}, dict(sku_id="S2")])
    tables = {"skus": (s.sku_master, ["sku_id"]), "vendors": (s.vendor_master, ["vendor_id"])}
    assert contracts.require_keys(tables) == {"skus": 2, "vendors": 1}
    with pytest.raises(ValueError, match="lines has no rows"):
        contracts.require_keys({**tables, "lines": (s.erp_purchase_orders, ["po_id"])})
    with pytest.raises(ValueError, match="skus has more than one row for some brand"):
        contracts.require_keys({**tables, "skus": (s.sku_master, ["brand"])})
