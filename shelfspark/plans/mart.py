"""The weekly mart: one row per SKU, channel, center and week.

The SKU rows are hash-partitioned by SKU once, while they are still few, and then
exploded to the grid in place. With co-partitioning on a subset of the join keys
allowed (see ``session``), every join below keeps that partitioning, so the panel
itself is never shuffled; only the already aggregated facts are. Inventory, purchase
orders and promotions are joined at their own coarser grain before the missing
dimension is exploded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    INVENTORY_COLUMNS, KEY_COLUMNS, MART_COLUMNS, PO_COLUMNS, SALES_COLUMNS, SKU_ATTRIBUTES,
    VENDOR_ATTRIBUTES,
)
from ..operators.grids import PlanningScope, cells_per_sku, center_grid, with_channels
from ..operators.inventory import inventory_weekly
from ..operators.mapping import CodeMapping
from ..operators.overrides import override_weekly
from ..operators.promotions import promotion_weekly
from ..operators.purchasing import po_changes, po_segments, running_positions
from ..operators.sales import sales_weekly
from ..session import shuffle_width, tuned

CELLS_PER_TASK = 100_000  # of the panel: the sorts of one task stay in memory

# Columns that stay NULL where there is no fact.
KEEP_NULL = {"avg_selling_price"}


def sku_dimension(skus: DataFrame, vendors: DataFrame) -> DataFrame:
    """SKU attributes with those of the default vendor, unknown vendors left NULL."""
    vendor = vendors.select(F.col("vendor_id").alias("default_vendor_id"), *VENDOR_ATTRIBUTES)
    return skus.select("sku_id", *SKU_ATTRIBUTES).join(vendor, "default_vendor_id", "left")


def panel_width(skus: DataFrame, scope: PlanningScope) -> int:
    """Partitions of the panel: the shuffle width, more where the SKUs are too many for tasks of CELLS_PER_TASK cells.

    Adaptive execution sees the few SKU rows, not the cells they are exploded to, so it can't choose this number.
    """
    cells = skus.count() * cells_per_sku(scope)
    return max(shuffle_width(skus.sparkSession), -(-cells // CELLS_PER_TASK))


def _filled(columns) -> list:
    return [
        F.col(name) if name in KEEP_NULL else F.coalesce(F.col(name), F.lit(0)).alias(name)
        for name in columns
    ]


def weekly_mart(sources, scope: PlanningScope, mapping: CodeMapping | None = None) -> DataFrame:
    """Join the dense grid with every weekly fact; missing counts and flags become 0.

    ``mapping`` brings measured hot codes; without it the code mapping of the sources is used as it is.
    """
    tuned(sources.spark)
    skus, width = sources.sku_master, panel_width(sources.sku_master, scope)
    # A run that measures its codes stores lines and receipts in buckets of the line and may have hot ones: they meet by line.
    sku_width = width if mapping is None else None
    mapping = mapping or sources.sku_code_mapping
    by_sku = sku_dimension(skus, sources.vendor_master).repartition(width, "sku_id")
    center_week = ["sku_id", "center_id", "week_start_date"]
    channel_week = ["sku_id", "channel_id", "week_start_date"]

    changes = po_changes(
        po_segments(sources.erp_purchase_orders, sources.wms_goods_receipts, mapping, scope, sku_width), scope
    )
    stock = running_positions(center_grid(by_sku, scope), changes, PO_COLUMNS).join(
        inventory_weekly(sources.wms_inventory_snapshot, mapping), center_week, "left"
    )
    cells = (
        with_channels(stock, scope)
        .join(promotion_weekly(sources.md_promotion_calendar, mapping, skus, scope),
              channel_week, "left")
        .join(sales_weekly(sources.oms_sales_orders, mapping), KEY_COLUMNS, "left")
        .join(override_weekly(sources.manual_overrides, skus, scope), KEY_COLUMNS, "left")
    )
    filled = _filled([*SALES_COLUMNS, *INVENTORY_COLUMNS, *PO_COLUMNS, "promo_flag",
                      "manual_override_flag"])
    raw = ["promo_type", "promo_depth", "planned_promo_price", "promo_priority",
           "override_type", "override_reason"]
    return cells.select(*KEY_COLUMNS, *SKU_ATTRIBUTES, *VENDOR_ATTRIBUTES, *filled, *raw).select(
        *MART_COLUMNS
    )
