"""Contracts between stages: columns, keys, cardinality, emptiness, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import FORBIDDEN_FEATURES


def require_columns(df: DataFrame, columns, name: str) -> DataFrame:
    """Fail before any work when a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing required columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame, name: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{name} has no rows")
    return df


def forbid_features(features) -> None:
    """No future label or prediction may be a model input."""
    leaked = sorted(set(features) & set(FORBIDDEN_FEATURES))
    if leaked:
        raise ValueError(f"features contain future labels or predictions: {', '.join(leaked)}")


def key_duplicates(df: DataFrame, keys, name: str) -> DataFrame:
    """One row: rows, distinct keys and surplus rows of a table."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
             F.count(F.lit(1)).alias("unique_key_count"))
        .select(F.lit(name).alias("table_name"), "row_count", "unique_key_count",
                (F.col("row_count") - F.col("unique_key_count")).alias("duplicate_key_count"))
    )


def require_unique(df: DataFrame, keys, name: str) -> DataFrame:
    """Guard one side of a join that must not fan out."""
    repeated = df.groupBy(*keys).count().filter("count > 1")
    if not repeated.isEmpty():
        raise ValueError(f"{name} has more than one row for some {', '.join(keys)}")
    return df


def require_keys(tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, int]:
    """Every table has rows and no key twice, NULL being a value; one job for all. Returns the row counts."""
    keys = [
        df.select(F.lit(name).alias("table"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("key"))
        for name, (df, names) in tables.items()
    ]
    found = {
        row["table"]: row
        for row in reduce(DataFrame.unionByName, keys)
        .groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("table").agg(F.sum("n").alias("row_count"), F.max("n").alias("most")).collect()
    }
    for name, (_, names) in tables.items():
        if name not in found:
            raise ValueError(f"{name} has no rows")
        if found[name].most > 1:
            raise ValueError(f"{name} has more than one row for some {', '.join(names)}")
    return {name: row.row_count for name, row in found.items()}


def unique_rows(df: DataFrame, keys, name: str) -> DataFrame:
    """The same rows; the job that reads them fails when a key repeats.

    The check is a window on the join keys, so a shuffle join that follows reuses its partitioning.
    """
    repeated = F.raise_error(F.lit(f"{name} has more than one row for some {', '.join(keys)}"))
    return (
        df.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        .filter(F.when(F.col("_rows") > 1, repeated.cast("boolean")).otherwise(True))
        .drop("_rows")
    )


def join_cardinality(left: DataFrame, right: DataFrame, keys, name: str) -> DataFrame:
    """How a join on ``keys`` relates: keys on both sides and the most rows per key."""
    sides = [
        side.groupBy(*keys).agg(
            F.sum(F.lit(own)).alias("left_rows"), F.sum(F.lit(1 - own)).alias("right_rows")
        )
        for side, own in ((left, 1), (right, 0))
    ]
    return (
        sides[0].unionByName(sides[1])
        .groupBy(*keys).agg(F.sum("left_rows").alias("l"), F.sum("right_rows").alias("r"))
        .agg(
            F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("matched_keys"),
            F.count_if(F.col("r") == 0).alias("left_only_keys"),
            F.count_if(F.col("l") == 0).alias("right_only_keys"),
            F.max("l").alias("max_left_rows"),
            F.max("r").alias("max_right_rows"),
        )
        .select(F.lit(name).alias("join_name"), "*")
    )


def orphans(child: DataFrame, parent: DataFrame, keys) -> DataFrame:
    """Child rows whose key the parent does not have."""
    return child.join(parent.select(*keys), list(keys), "left_anti")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Table inventory: name and row count of each table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
