"""Purchase-order positions as of each week, in work linear in PO and receipt lines.

A PO line's remaining quantity is a step function of the week: it starts at the first
Monday after creation and steps down with each receipt. Instead of pairing every PO line
with every later week, each line emits the *changes* of its remaining quantity, of its
overdue part and of its three inbound horizons. Summing the changes per
SKU, center and week and running them up over the dense week grid gives the same
figures as the pairwise join, at a cost that does not depend on how long lines stay open.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import PO_COLUMNS, SNAPSHOT_HOUR
from ..functions.columns import first_monday_on_or_after, monday_of, week_floor_of_cutoff
from .grids import PlanningScope, center_grid, mondays_between
from .mapping import map_codes

LINE = ["po_id", "po_line_id", "sku_id", "center_id"]
# A Monday after every plannable week: lines without a further receipt stay open until then.
FAR = date(9999, 1, 4)


def mapped_po(orders: DataFrame, mapping: DataFrame) -> DataFrame:
    return map_codes(orders, mapping, "ERP", "erp_sku_code", "po_created_date").select(
        "sku_id",
        "po_id",
        "po_line_id",
        F.to_date("po_created_date").alias("po_created_date"),
        "center_id",
        "confirmed_qty",
        "cancelled_qty",
        F.to_date("promised_delivery_date").alias("promised_delivery_date"),
    )


def mapped_receipts(receipts: DataFrame, mapping: DataFrame) -> DataFrame:
    return map_codes(receipts, mapping, "WMS", "wms_sku_code", "receipt_datetime").select(
        "sku_id", "po_id", "po_line_id", "center_id", "receipt_datetime", "accepted_qty"
    )


def _laid_by_sku(df: DataFrame, sku_width: int | None) -> DataFrame:
    return df if sku_width is None else df.repartition(sku_width, "sku_id")


def _receipts_by_week(receipts: DataFrame, mapping: DataFrame, sku_width: int | None = None) -> DataFrame:
    """Accepted quantity per PO line and the first week whose cutoff counts it."""
    counted = mapped_receipts(receipts, mapping).select(
        *LINE, week_floor_of_cutoff(F.col("receipt_datetime"), SNAPSHOT_HOUR).alias("counted_from"),
        "accepted_qty")
    return (
        _laid_by_sku(counted, sku_width)
        .groupBy(*LINE, "counted_from")
        .agg(F.sum("accepted_qty").alias("accepted"))
    )


def po_position_lines(
    orders: DataFrame, receipts: DataFrame, mapping: DataFrame, scope: PlanningScope
) -> DataFrame:
    """One row per PO line and week in scope, with the quantity accepted so far.

    This is the long form, for inspection. It grows with lines x weeks; the weekly
    figures below do not need it.
    """
    po = mapped_po(orders, mapping)
    start = F.greatest(first_monday_on_or_after(F.col("po_created_date")), scope.first)
    weeks = po.select("*", F.explode(mondays_between(start, scope.last)).alias("week_start_date"))
    counted = _receipts_by_week(receipts, mapping)
    in_week = (F.col("counted_from") <= F.col("week_start_date"))
    return (
        weeks.join(counted, LINE, "left")
        .groupBy("sku_id", "center_id", "week_start_date", "po_id", "po_line_id",
                 "promised_delivery_date", "confirmed_qty")
        .agg(F.coalesce(F.sum(F.when(in_week, F.col("accepted")).otherwise(0)), F.lit(0))
             .alias("accepted_qty_as_of_week"))
    )


def po_segments(
    orders: DataFrame, receipts: DataFrame, mapping: DataFrame, scope: PlanningScope,
    sku_width: int | None = None,
) -> DataFrame:
    """Week ranges [lo, hi) over which a PO line has one constant open quantity.

    With ``sku_width`` lines and receipts are hashed by SKU to that many partitions before anything else is done
    with them: the sums, the join, the windows and what follows per SKU all keep that partitioning, so both
    tables are shuffled once and their many changes never. Without it they meet by PO line, as tables stored
    in buckets of the line do without a shuffle, and a SKU that owns much of the data is spread over its lines.
    """
    po = _laid_by_sku(mapped_po(orders, mapping).select(
        *LINE, F.greatest(first_monday_on_or_after(F.col("po_created_date")), scope.first).alias("start"),
        "confirmed_qty", "promised_delivery_date"), sku_width)
    # Lines that share an id but not their promise or quantity are positions of their own.
    by_line = Window.partitionBy(*LINE, "promised_delivery_date", "confirmed_qty").orderBy("counted_from")
    so_far = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = (
        po.join(_receipts_by_week(receipts, mapping, sku_width), LINE, "left")
        .withColumn("step", F.row_number().over(by_line))
        .withColumn("accepted", F.coalesce(F.sum("accepted").over(so_far), F.lit(0)))
        .withColumn("next_from", F.coalesce(F.lead("counted_from").over(by_line), F.lit(FAR)))
        .withColumn("counted_from", F.coalesce("counted_from", F.lit(FAR)))
    )
    before = F.struct(
        F.col("start").alias("lo"), F.col("counted_from").alias("hi"), F.lit(0).cast("long").alias("acc")
    )
    after = F.struct(
        F.greatest("counted_from", "start").alias("lo"), F.col("next_from").alias("hi"),
        F.col("accepted").alias("acc"),
    )
    pieces = F.when(F.col("step") == 1, F.array(before, after)).otherwise(F.array(after))
    return (
        steps.select("sku_id", "center_id", "promised_delivery_date", "confirmed_qty",
                     F.explode(pieces).alias("piece"))
        .select(
            "sku_id", "center_id", "promised_delivery_date", "confirmed_qty",
            "piece.lo", "piece.hi", F.col("piece.acc").alias("accepted_qty"),
            (F.col("confirmed_qty") - F.col("piece.acc")).alias("remaining_qty"),
        )
        .filter((F.col("lo") < F.col("hi")) & (F.col("remaining_qty") > 0)
                & (F.col("lo") <= scope.last))
    )


MEASURES = ["lines", "confirmed", "accepted", *PO_COLUMNS]


def _change(week: str, **parts: str) -> str:
    """SQL struct of one week and the change of each measure in it."""
    fields = ", ".join(f"'{name}', cast({parts.get(name, 0)} AS bigint)" for name in MEASURES)
    return f"named_struct('week_start_date', {week}, {fields})"


def po_changes(segments: DataFrame, scope: PlanningScope) -> DataFrame:
    """Weekly changes of open, overdue and inbound quantities per SKU and center."""
    # Monday of the promised week, and where each inbound horizon starts before it.
    starts = {
        "inbound_qty_next_1w": "due",
        "inbound_qty_next_2w": "date_sub(due, 7)",
        "inbound_qty_next_4w": "date_sub(due, 21)",
    }
    late = "date_add(due, 7)"

    def whole(week: str, sign: str) -> dict[str, str]:
        """All measures of the segment as they stand in one week."""
        return {
            "lines": f"{sign}1",
            "confirmed": f"{sign}confirmed_qty",
            "accepted": f"{sign}accepted_qty",
            "open_po_qty": f"{sign}remaining_qty",
            "overdue_po_qty": f"CASE WHEN {week} >= {late} THEN {sign}remaining_qty ELSE 0 END",
            **{
                name: f"CASE WHEN {week} >= {start} AND {week} < {late} "
                      f"THEN {sign}remaining_qty ELSE 0 END"
                for name, start in starts.items()
            },
        }

    changes = [_change("lo", **whole("lo", "")), _change("hi", **whole("date_sub(hi, 7)", "-"))]
    for name, start in starts.items():
        changes.append(f"CASE WHEN {start} > lo AND {start} < hi "
                       f"THEN {_change(start, **{name: 'remaining_qty'})} END")
    overdue = {"overdue_po_qty": "remaining_qty", **{name: "-remaining_qty" for name in starts}}
    changes.append(f"CASE WHEN {late} > lo AND {late} < hi THEN {_change(late, **overdue)} END")

    return (
        segments.withColumn("due", monday_of("promised_delivery_date"))
        .selectExpr("sku_id", "center_id", f"explode(array({', '.join(changes)})) AS change")
        .filter(F.col("change").isNotNull())
        .select("sku_id", "center_id", "change.*")
        .filter(F.col("week_start_date") <= scope.last)
        .groupBy("sku_id", "center_id", "week_start_date")
        .agg(*[F.sum(name).alias(name) for name in MEASURES])
    )


def running_positions(grid: DataFrame, changes: DataFrame, columns) -> DataFrame:
    """Run weekly changes up over a dense SKU x center x week grid."""
    so_far = (
        Window.partitionBy("sku_id", "center_id").orderBy("week_start_date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    keep = grid.columns
    return grid.join(changes, ["sku_id", "center_id", "week_start_date"], "left").select(
        *keep, *[F.coalesce(F.sum(name).over(so_far), F.lit(0)).alias(name) for name in columns]
    )


def po_weekly(
    orders: DataFrame, receipts: DataFrame, mapping: DataFrame, skus: DataFrame,
    scope: PlanningScope, sku_width: int | None = None,
) -> DataFrame:
    """Open, overdue and inbound quantity for every SKU, center and week; ``sku_width`` as in ``po_segments``."""
    changes = po_changes(po_segments(orders, receipts, mapping, scope, sku_width), scope)
    grid = center_grid(_laid_by_sku(skus.select("sku_id"), sku_width), scope)
    return running_positions(grid, changes, PO_COLUMNS)


def po_open_position(
    orders: DataFrame, receipts: DataFrame, mapping: DataFrame, skus: DataFrame,
    scope: PlanningScope, sku_width: int | None = None,
) -> DataFrame:
    """Number, confirmed, accepted and remaining quantity of the lines open in a week; ``sku_width`` as in ``po_segments``."""
    changes = po_changes(po_segments(orders, receipts, mapping, scope, sku_width), scope)
    return running_positions(
        center_grid(_laid_by_sku(skus.select("sku_id"), sku_width), scope), changes,
        ["lines", "confirmed", "accepted", "open_po_qty"],
    ).select(
        "sku_id", "center_id", "week_start_date",
        F.col("lines").alias("open_line_count"), F.col("confirmed").alias("confirmed_open_qty"),
        F.col("accepted").alias("accepted_qty_as_of_week"),
        F.col("open_po_qty").alias("remaining_qty"),
    )
