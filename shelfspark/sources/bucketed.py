"""Purchase-order lines and receipts stored co-partitioned by their line.

Positions, vendor history, orphans and cardinality all join the two on (po_id, po_line_id). Both are stored in the same
number of buckets of that key, so those joins and the sums before them read matching buckets and shuffle neither side.
The number of buckets follows the size of the larger table. Buckets cannot be split at run time, so a line with more rows than
``HEAVY`` buckets hold keeps both tables unbucketed: they are shuffled then, where adaptive execution splits the hot key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = ["po_id", "po_line_id"]
TABLES = ("erp_purchase_orders", "wms_goods_receipts")
BUCKET_BYTES = 128 << 20
HEAVY = 2


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a folder, from their listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.sum("length")).first()[0] or 0


def heaviest_line(rows: DataFrame) -> int:
    """Rows of the line that has most; rows without a line count as one line."""
    return rows.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def bucket_count(spark: SparkSession, tables: dict[str, tuple[str, int]], bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for (path, rows) of the tables; 0 if a line is too heavy for one bucket."""
    n = max(1, *(-(-stored_bytes(spark, path) // bucket_bytes) for path, _ in tables.values()))
    for path, rows in tables.values():
        if heaviest_line(spark.read.parquet(path)) * n > HEAVY * max(rows, n):
            return 0
    return n


def _name(path: str) -> str:
    return f"shelfspark_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def write_bucketed(rows: DataFrame, path: str, buckets: int) -> None:
    """One file per bucket, sorted by line."""
    (
        rows.repartition(buckets, *LINE).write.format("parquet").option("path", path)
        .bucketBy(buckets, *LINE).sortBy(*LINE).saveAsTable(_name(path))
    )


def read_bucketed(spark: SparkSession, path: str, schema, buckets: int) -> DataFrame:
    """The table with its buckets known; another session's files are declared, not written again."""
    if not spark.catalog.tableExists(_name(path)):
        columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
        keys = ", ".join(LINE)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(path)} ({columns}) USING parquet "
                  f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(_name(path)).select(*schema.fieldNames())
