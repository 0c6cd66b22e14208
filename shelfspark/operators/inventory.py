"""Inventory snapshots to one weekly position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import monday_of
from .mapping import map_codes

QUANTITIES = ["on_hand_qty", "reserved_qty", "damaged_qty", "quality_hold_qty", "available_qty"]
GRAIN = ["sku_id", "center_id", "week_start_date"]


def mapped_inventory(snapshots: DataFrame, mapping: DataFrame) -> DataFrame:
    """Snapshots with their SKU and the Monday of their week."""
    return map_codes(snapshots, mapping, "WMS", "wms_sku_code", "snapshot_datetime").select(
        "sku_id",
        "center_id",
        monday_of("snapshot_datetime").alias("week_start_date"),
        "snapshot_datetime",
        *QUANTITIES,
        "stockout_flag",
    )


def inventory_weekly(snapshots: DataFrame, mapping: DataFrame) -> DataFrame:
    """Quantities of the latest snapshot and whether any snapshot was a stockout.

    One aggregate answers both: ``max_by`` over (time, quantities) keeps one row per
    task before the shuffle. Equal times are settled by the larger quantities.
    """
    newest = F.struct("snapshot_datetime", *QUANTITIES)
    return (
        mapped_inventory(snapshots, mapping)
        .groupBy(*GRAIN)
        .agg(F.max(newest).alias("newest"), F.max("stockout_flag").alias("stockout_flag"))
        .select(*GRAIN, *[F.col(f"newest.{name}").alias(name) for name in QUANTITIES],
                "stockout_flag")
    )
