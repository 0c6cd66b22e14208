"""CSV files to typed staging tables, and tables to CSV."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from ..operators.grids import PlanningScope
from ..schemas import SOURCE_TABLES, schema_of
from . import bucketed, versions
from .records import read_records, record_count


def read_text(spark: SparkSession, path: str, schema: StructType,
              multi_line: bool = False) -> DataFrame:
    """Headered UTF-8 CSV, with or without a byte-order mark, every column as text.

    Line breaks inside quotes need ``multi_line``, which finds the records before they are parsed.
    """
    if multi_line:
        return read_records(spark, path, schema)
    text = StructType([StructField(field.name, StringType()) for field in schema])
    return (
        spark.read.schema(text).option("header", True).option("enforceSchema", False)
        .option("escape", '"').csv(path)
    )


def typed(rows: DataFrame, schema: StructType) -> DataFrame:
    """Text columns cast to a declared schema; a blank or unreadable text becomes NULL."""
    return rows.select(*[
        F.col(field.name).try_cast(field.dataType).alias(field.name) for field in schema
    ])


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return typed(read_text(spark, path, schema), schema)


def rejected_counts(schema: StructType) -> list:
    """Per column, the texts that are not blank and yet no value of the declared type."""
    return [
        F.count_if((F.trim(field.name) != "") & F.col(field.name).try_cast(field.dataType).isNull())
        .alias(field.name)
        for field in schema
    ]


def require_inputs(spark: SparkSession, paths: dict[str, str]) -> None:
    """Name every missing input in one error, before anything is written."""
    missing = []
    for name, path in paths.items():
        try:
            spark.read.text(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            missing.append(f"{name} ({path})")
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))


def stage_csv(spark: SparkSession, folder: str, target: str, tables=None,
              allow_rejected: bool = False, multi_line: bool = False,
              bucket_bytes: int = bucketed.BUCKET_BYTES) -> dict[str, int]:
    """New versions of the staging tables from ``folder/<table>.csv``; returns their row counts.

    Each file is parsed once: rows and unreadable values are counted while it is written. The rows
    parsed must equal those stored and the records of the file, which are counted without the parser;
    unreadable values are an error unless allowed. All tables are
    published after the last one has passed; until then, and after an error, readers see the old
    ones. Staged together, PO lines and receipts are stored in buckets of their line.
    """
    tables = list(tables or SOURCE_TABLES)
    require_inputs(spark, {name: f"{folder}/{name}.csv" for name in tables})
    counts, fresh = {}, {name: versions.new_version() for name in tables}
    path = {name: f"{target}/{name}/{fresh[name]}" for name in tables}
    for name in tables:
        schema, seen = schema_of(name), Observation()
        records = record_count(spark, f"{folder}/{name}.csv", multi_line)
        rows = read_text(spark, f"{folder}/{name}.csv", schema, multi_line).observe(
            seen, F.count(F.lit(1)).alias("_rows"), *rejected_counts(schema))
        typed(rows, schema).write.parquet(path[name])
        rejected = {column: n for column, n in seen.get.items() if n and column != "_rows"}
        if rejected and not allow_rejected:
            raise ValueError(f"{name}: unreadable values: {rejected}")
        read, stored = seen.get["_rows"], spark.read.parquet(path[name]).count()
        if not records == read == stored:
            raise ValueError(f"{name}: {records} records in the file, {read} rows read, {stored} stored")
        counts[name] = stored
    buckets = 0
    if set(bucketed.TABLES) <= set(tables):
        buckets = bucketed.bucket_count(spark, {name: (path[name], counts[name]) for name in bucketed.TABLES}, bucket_bytes)
    if buckets:
        for name in bucketed.TABLES:
            plain, fresh[name] = path[name], versions.new_version()
            path[name] = f"{target}/{name}/{fresh[name]}"
            bucketed.write_bucketed(spark.read.parquet(plain), path[name], buckets)
            versions.delete(spark, plain)
    for name in tables:
        versions.publish(spark, f"{target}/{name}", fresh[name], counts[name], buckets if name in bucketed.TABLES else 0)
    return counts


def require_schema(stored: StructType, declared: StructType, name: str) -> None:
    """The files' own columns and types must be the declared ones, in any order."""
    own, wanted = ({f.name: f.dataType for f in schema} for schema in (stored, declared))
    wrong = sorted(column for column in own.keys() | wanted.keys() if own.get(column) != wanted.get(column))
    if wrong:
        raise ValueError(f"{name}: stored columns differ from the declared ones: {', '.join(wrong)}")


class Staged:
    """The nine source tables of a staging folder, as published when first read, for a planning scope."""

    def __init__(self, spark: SparkSession, folder: str, scope: PlanningScope):
        self.spark, self.folder, self.scope = spark, folder.rstrip("/"), scope
        self._tables: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SOURCE_TABLES:
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = self._read(name)
        return self._tables[name]

    def _read(self, name: str) -> DataFrame:
        marker, schema = versions.current(self.spark, f"{self.folder}/{name}"), schema_of(name)
        if marker is None:
            raise FileNotFoundError(f"{name} is not staged in {self.folder}")
        path = f"{self.folder}/{name}/{marker.version}"
        if marker.row_count:  # a table without rows may have no file to tell its columns
            require_schema(self.spark.read.parquet(path).schema, schema, name)
        if marker.buckets:
            return bucketed.read_bucketed(self.spark, path, schema, marker.buckets)
        return self.spark.read.schema(schema).parquet(path)


def write_weekly(df: DataFrame, path: str) -> DataFrame:
    """A new weekly table, one folder per week so that readers prune weeks; reads it back.

    Rows of a week are brought together first; without that every task would write a file into every week.
    Adaptive execution splits weeks above its advisory partition size and merges small ones, so the number of
    files follows the data.
    """
    df.hint("rebalance", "week_start_date").write.partitionBy("week_start_date").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def write_csv(df: DataFrame, path: str) -> None:
    """Headered CSV with dates as ISO text, doubled quotes and the columns in their given order."""
    dates = {field.name for field in df.schema if isinstance(field.dataType, DateType)}
    df.select(*[
        F.date_format(name, "yyyy-MM-dd").alias(name) if name in dates else F.col(name)
        for name in df.columns
    ]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def require_outputs(spark: SparkSession, paths: dict[str, str]) -> None:
    """Every written Parquet output must exist and hold at least one row."""
    require_inputs(spark, paths)
    empty = [name for name, path in paths.items() if spark.read.parquet(path).isEmpty()]
    if empty:
        raise ValueError("empty outputs: " + ", ".join(sorted(empty)))
