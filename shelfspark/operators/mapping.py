"""As-of mapping of system-specific product codes to SKUs."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null
from ..session import shuffle_width

# System and code column of every table whose codes are mapped.
CODED_TABLES = {
    "oms_sales_orders": ("OMS", "oms_sku_code"),
    "wms_inventory_snapshot": ("WMS", "wms_sku_code"),
    "wms_goods_receipts": ("WMS", "wms_sku_code"),
    "erp_purchase_orders": ("ERP", "erp_sku_code"),
    "md_promotion_calendar": ("MD", "md_sku_code"),
}


class CodeMapping(NamedTuple):
    """Mapping rows, the hot codes of each source system, and the copies their intervals get in a join."""

    rows: DataFrame
    hot: dict[str, list[str]]
    copies: int


def measured_mapping(sources, copies: int | None = None) -> CodeMapping:
    """The mapping with the hot codes of the sources: one job over the code columns alone, summed on the map side.

    A code is hot that has more than twice an average shuffle partition of its table's rows, so there
    are fewer of them than half the partitions per table. NULL codes have no SKU and are not counted.
    """
    width = shuffle_width(sources.spark)
    codes = [
        getattr(sources, name).select(
            F.lit(name).alias("table"), F.lit(system).alias("system"), F.col(code).alias("code"))
        for name, (system, code) in CODED_TABLES.items()
    ]
    counts = (
        reduce(DataFrame.unionByName, codes).filter("code IS NOT NULL")
        .groupBy("table", "system", "code").agg(F.count(F.lit(1)).alias("n"))
    )
    # One row per table.
    totals = F.broadcast(counts.groupBy("table").agg(F.sum("n").alias("total")))
    found = counts.join(totals, "table").filter(F.col("n") * width > 2 * F.col("total"))
    hot: dict[str, list[str]] = {}
    for row in found.select("system", "code").distinct().collect():
        hot.setdefault(row.system, []).append(row.code)
    return CodeMapping(sources.sku_code_mapping, hot, copies or 4 * width)


def code_intervals(mapping: DataFrame, system: str) -> DataFrame:
    """One row per code of a source system: its valid rows as an array of (_from, _to, sku_id), by first day."""
    return (
        mapping.filter((F.col("source_system") == system) & (F.col("mapping_status") == "VALID")
                       & F.col("source_sku_code").isNotNull())
        .groupBy(F.col("source_sku_code").alias("_code"))
        .agg(F.sort_array(F.collect_list(F.struct(
            F.col("effective_from").cast("date").alias("_from"),
            blank_to_null(F.col("effective_to").cast("string")).cast("date").alias("_to"),
            F.col("sku_id"),
        ))).alias("_valid"))
    )


def map_codes(
    facts: DataFrame,
    mapping: DataFrame | CodeMapping,
    system: str,
    code: str,
    valid_on: str,
    valid_until: str | None = None,
) -> DataFrame:
    """Inner join of facts to the valid mapping rows of one source system.

    A fact matches when its day lies inside the validity range; with
    ``valid_until`` the whole range from ``valid_on`` to it must lie inside.
    Unmapped facts drop out, and several valid rows fan a fact out.

    The join is on the code alone, one row per code; the interval is found in that row's array, so
    facts meet no interval but those that hold them. No join hint: the mapping is broadcast only when
    Spark's size estimate allows it. Beyond that facts are shuffled on the code. With a ``CodeMapping``
    the facts of its hot codes are spread by a hash of the whole row over copies of those codes'
    intervals, which is the same on every attempt of a task.
    """
    plain = not isinstance(mapping, CodeMapping)
    intervals = code_intervals(mapping if plain else mapping.rows, system)
    on = F.col(code) == F.col("_code")
    hot = [] if plain else mapping.hot.get(system, [])
    if hot:
        spread = F.pmod(F.xxhash64(*facts.columns), F.lit(mapping.copies)).cast("int")
        facts = facts.withColumn("_part", F.when(F.col(code).isin(hot), spread).otherwise(0))
        last = F.when(F.col("_code").isin(hot), mapping.copies - 1).otherwise(0)
        intervals = intervals.withColumn("_copy", F.explode(F.sequence(F.lit(0), last)))
        # One key of two fields: the partitioning by code alone, which the intervals have, must not serve this join.
        on = F.struct(F.col(code).alias("code"), F.col("_part").alias("part")) == F.struct(
            F.col("_code").alias("code"), F.col("_copy").alias("part"))
    start = F.to_date(F.col(valid_on))
    end = F.to_date(F.col(valid_until or valid_on))
    kept = [name for name in facts.columns if name != "_part"]
    holding = F.filter("_valid", lambda v: (start >= v["_from"]) & (v["_to"].isNull() | (end <= v["_to"])))
    return (
        facts.join(intervals, on)
        .select(*kept, F.explode(holding).alias("_held"))
        .select(*kept, F.col("_held.sku_id").alias("sku_id"))
    )
