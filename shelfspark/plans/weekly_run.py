"""The complete weekly run: sources to mart, features, predictions, decisions, KPIs, exports.

Each stage is written before the next one reads it, and a failed contract stops the run. A run writes to a folder of
its own, which one marker publishes at the end: a run that fails or dies leaves the tables of the last one as they were.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import KEY_COLUMNS
from ..operators import serving
from ..operators.contracts import orphans, require_keys, require_rows
from ..operators.decisions import require_valid_decisions
from ..operators.mapping import measured_mapping
from ..operators.modeling import demand_importance, stockout_importance, top_features
from ..session import tuned
from ..sources import versions
from ..sources.staging import require_outputs, write_weekly
from .decisions import ModelStages
from .features import VENDOR_PROFILE, add_features, vendor_features
from .mart import panel_width, weekly_mart


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def check_sources(sources) -> None:
    """One row per key where others join, a known vendor for every SKU, full vendor profiles."""
    require_keys({
        "sku_master": (sources.sku_master, ["sku_id"]),
        "vendor_master": (sources.vendor_master, ["vendor_id"]),
        "erp_purchase_orders": (sources.erp_purchase_orders, ["po_id", "po_line_id"]),
    })
    vendors = sources.vendor_master
    wanted = sources.sku_master.select(F.col("default_vendor_id").alias("vendor_id"))
    if not orphans(wanted, vendors, ["vendor_id"]).isEmpty():
        raise ValueError("sku_master names a default vendor that vendor_master does not have")
    if not vendors.select(*VENDOR_PROFILE).filter(
            reduce(or_, [F.col(name).isNull() for name in VENDOR_PROFILE])).isEmpty():
        raise ValueError(f"vendor_master has no value for some of {', '.join(VENDOR_PROFILE)}")


def run(sources, target: str, rounds: int = 250, importance: bool = True) -> dict[str, str]:
    """Run everything into a new version under ``target``; returns the path of each output table."""
    spark: SparkSession = tuned(sources.spark)
    paths: dict[str, str] = {}
    version = versions.new_version()
    check_sources(sources)

    def store(name: str, df: DataFrame) -> DataFrame:
        paths[name] = f"{target}/{version}/{name}"
        return _store(df, paths[name])

    def store_weekly(name: str, df: DataFrame) -> DataFrame:
        paths[name] = f"{target}/{version}/{name}"
        return write_weekly(df, paths[name])

    mart = store_weekly("weekly_mart", weekly_mart(sources, sources.scope, measured_mapping(sources)))

    # One shuffle by SKU serves every window and join of the feature step.
    by_sku = mart.repartition(panel_width(sources.sku_master, sources.scope), "sku_id")
    features = store_weekly(
        "feature_table", add_features(by_sku, vendor_features(sources, sources.scope)))
    require_keys({"weekly mart": (mart, KEY_COLUMNS), "feature table": (features, KEY_COLUMNS)})
    stages = ModelStages(features, rounds, keep=store)
    demand, stockout = stages.predictions()
    demand_scores = store("demand_model_metrics", stages.demand_metrics())
    stockout_scores = store("stockout_model_metrics", stages.stockout_metrics())
    decisions = store("reorder_action_result", stages.decisions())
    require_valid_decisions(require_rows(decisions, "overlap of both predictions"))
    kpis = store("kpi_summary", serving.kpi_summary(demand_scores, stockout_scores, decisions))
    if importance:
        store("demand_importance", top_features(demand_importance(
            stages.demand_model, stages.demand.rows, stages.demand.start)))
        store("stockout_importance", top_features(stockout_importance(
            stages.stockout_model, stages.stockout.rows, stages.stockout.start)))
    store("export_overview", serving.export_overview(kpis))
    store("export_demand", serving.export_demand(demand))
    store("export_stockout", serving.export_stockout(stockout))
    store("export_reorder", serving.export_reorder(decisions))
    store("export_sku_detail", serving.sku_detail(features))
    require_outputs(spark, paths)
    versions.publish(spark, target, version)
    return paths
