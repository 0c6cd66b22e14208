"""Inputs that break a contract stop the job, and the message names the table."""

import pytest
from fixtures import SCOPE, Sources

from shelfspark.fixed_values import KEY_COLUMNS
from shelfspark.operators import contracts, decisions
from shelfspark.plans.features import vendor_features
from shelfspark.plans.weekly_run import check_sources
from shelfspark.sources.staging import stage_csv

KEYS = "sku_id string, channel_id string, center_id string, week_start_date string"
ROW = ("S1", "A", "C1", "2025-01-06")


def test_repeated_predictions_fail(spark):
    needed = [*decisions.ZERO_WHEN_MISSING, "order_multiple", "inventory_cover_weeks"]
    features = spark.createDataFrame(
        [(*ROW, *[1.0] * len(needed))], f"{KEYS}, " + ", ".join(f"{n} double" for n in needed))
    demand = spark.createDataFrame([(*ROW, 1.0)], f"{KEYS}, demand_pred double")
    risk = spark.createDataFrame(
        [(*ROW, 0.5, 1)],
        f"{KEYS}, stockout_risk_pred_proba double, stockout_risk_pred_label int")
    assert decisions.decision_inputs(features, demand, risk).count() == 1
    with pytest.raises(Exception, match="demand predictions has more than one row"):
        decisions.decision_inputs(features, demand.union(demand), risk).collect()
    with pytest.raises(Exception, match="stockout predictions has more than one row"):
        decisions.decision_inputs(features, demand, risk.union(risk)).collect()
    with pytest.raises(ValueError, match="feature table is missing .*moq_qty"):
        decisions.decision_inputs(features.drop("moq_qty"), demand, risk)
    with pytest.raises(ValueError, match="demand predictions is missing .*demand_pred"):
        decisions.decision_inputs(features, demand.drop("demand_pred"), risk)


def test_unique_rows_keep_rows_and_columns(spark):
    df = spark.createDataFrame([ROW, ("S2", *ROW[1:])], KEYS)
    kept = contracts.unique_rows(df, KEY_COLUMNS, "t")
    assert kept.columns == df.columns and kept.count() == 2
    assert contracts.unique_rows(df.limit(0), KEY_COLUMNS, "t").count() == 0


@pytest.mark.parametrize("column", ["lead_time_profile", "fill_rate_profile", "reliability_tier"])
def test_unknown_vendor_profile_fails(spark, column):
    odd = Sources(spark, vendor_master=[{column: "ODD"}])
    with pytest.raises(Exception, match=f"unknown {column}: ODD"):
        vendor_features(odd, SCOPE).collect()
    # Without any profile the proxies stay empty in queries; the weekly run refuses it.
    empty = Sources(spark, vendor_master=[{column: None}], erp_purchase_orders=[{}])
    assert vendor_features(empty, SCOPE).count() == 13
    with pytest.raises(ValueError, match="vendor_master has no value"):
        check_sources(empty)


def test_unknown_default_vendor_stops_the_run(spark):
    sources = Sources(spark, sku_master=[{"default_vendor_id": "V9"}], erp_purchase_orders=[{}])
    with pytest.raises(ValueError, match="default vendor that vendor_master does not have"):
        check_sources(sources)


@pytest.mark.parametrize("table", ["sku_master", "vendor_master", "erp_purchase_orders"])
def test_repeated_or_missing_source_rows_fail(spark, table):
    good = {"erp_purchase_orders": [{}]}
    check_sources(Sources(spark, **good))
    with pytest.raises(ValueError, match=f"{table} has more than one row"):
        check_sources(Sources(spark, **{**good, table: [{}, {}]}))
    with pytest.raises(ValueError, match=f"{table} has no rows"):
        check_sources(Sources(spark, **{**good, table: []}))


def test_unreadable_values_fail_unless_allowed(spark, tmp_path):
    source = tmp_path / "raw"
    source.mkdir()
    from shelfspark.schemas import schema_of

    names = schema_of("vendor_master").fieldNames()
    values = {"vendor_id": "V1", "import_flag": "zero", "standard_lead_time_days": " "}
    line = ",".join(values.get(name, "") for name in names)
    (source / "vendor_master.csv").write_text(",".join(names) + "\n" + line + "\n")
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="vendor_master: unreadable values: {'import_flag': 1}"):
        stage_csv(spark, str(source), out, ["vendor_master"])
    assert stage_csv(spark, str(source), out, ["vendor_master"], allow_rejected=True) == {
        "vendor_master": 1}
