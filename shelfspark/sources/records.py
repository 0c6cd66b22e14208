"""CSV files with line breaks inside quotes, read by many tasks.

A line break ends a record when an even number of quotes stands before it. Each byte range of a file numbers its own lines
and counts quotes; a running sum over the ranges tells which begin inside a quoted field; with that every line knows the
line its record starts on. Records of one line are parsed where they were read, only the lines of longer ones are shuffled,
by record. Quotes inside a field are doubled, and a field that holds one must be quoted itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RANGE = ["file", "block"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): lines with the byte range that holds their beginning."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place in the range, the parity of quotes before them in it and in them, and the last line up to
    them that has an even (start0) and an odd (start1) number of quotes before it, -1 if there is none."""
    quotes = F.regexp_count("value", F.lit('"'))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at, before, starts = None, 0, 0, [-1, -1]
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for file, block, odd in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "odd")), strict=True):
                if (file, block) != here:
                    here, at, before, starts = (file, block), 0, 0, [-1, -1]
                starts[before] = at
                out.append((at, before, *starts))
                at, before = at + 1, before ^ odd
            columns = [pa.array(column, pa.int64()) for column in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "at", "before", "start0", "start1"])

    rows = lines(spark, path).withColumn("odd", F.pmod(quotes, F.lit(2)).cast("long"))
    return rows.mapInArrow(work, "value string, file string, block long, odd long, at long, before long, start0 long, start1 long")


def _ranges(numbered: DataFrame) -> DataFrame:
    """Per byte range: whether it begins inside quotes, its records, the last record begun before it."""
    filled = F.trim(F.regexp_replace("value", "\r$", "")) != ""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.col("open") == 0, F.col("last0")).otherwise(F.col("last1"))
    return (
        numbered.groupBy(*RANGE).agg(
            F.sum("odd").alias("odd"), F.max("start0").alias("last0"), F.max("start1").alias("last1"),
            F.count_if((F.col("before") == 0) & filled).alias("records0"),
            F.count_if((F.col("before") == 1) & filled).alias("records1"))
        .withColumn("open", F.pmod(F.coalesce(F.sum("odd").over(earlier), F.lit(0)), F.lit(2)))
        .withColumn("own", F.when(last >= 0, F.struct(F.col("block"), last.alias("at"))))
        .select(*RANGE, "odd", "open", F.last("own", True).over(earlier).alias("from_earlier"),
                F.when(F.col("open") == 0, F.col("records0")).otherwise(F.col("records1")).alias("records"))
    )


def record_count(spark: SparkSession, path: str, multi_line: bool) -> int:
    """Records below the headers, counted without parsing: lines with text, or quoted records when they may span lines."""
    if not multi_line:
        filled = F.trim(F.regexp_replace("value", "[\r﻿]", "")) != ""
        files = lines(spark, path).groupBy("file").agg(F.count_if(filled).alias("records"))
    else:
        files = _ranges(_numbered(spark, path)).groupBy("file").agg(F.sum("records").alias("records"), F.sum("odd").alias("odd"))
        unclosed = [row.file for row in files.filter("odd % 2 = 1").select("file").limit(5).collect()]
        if unclosed:
            raise ValueError(f"a quote is never closed in: {', '.join(unclosed)}")
    return files.agg(F.sum(F.greatest(F.col("records") - 1, F.lit(0)))).first()[0] or 0


def read_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Headered UTF-8 CSV as text columns of the schema; line breaks inside quotes stay in their field.

    Every file needs the schema's names as its header, with or without a byte-order mark; a job that reads another header
    fails. Blank lines between records are skipped; a file without any record is empty. ``record_count`` refuses a file whose last quote
    stays open, and should be called first: its rest would be one record.
    """
    numbered = _numbered(spark, path)
    rows = numbered.join(_ranges(numbered).select(*RANGE, "open", "from_earlier"), RANGE)
    inside = F.col("before").bitwiseXOR(F.col("open")) == 1
    start = F.when(F.col("open") == 0, F.col("start0")).otherwise(F.col("start1"))
    rows = rows.select(
        "value", *RANGE, "at", (~inside & (F.col("odd") == 0)).alias("whole"),
        F.when(start >= 0, F.struct(F.col("block"), start.alias("at"))).otherwise(F.col("from_earlier")).alias("record"))
    pieces = (
        rows.filter("NOT whole").groupBy("file", "record")
        .agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("lines"))
        .select("file", "record", F.array_join("lines.value", "\n").alias("value"))
    )
    records = rows.filter("whole").select("file", "record", "value").unionByName(pieces)
    text = F.regexp_replace("value", "\r$", "")
    names = schema.fieldNames()
    parsed = F.from_csv(text, ", ".join(f"`{name}` string" for name in names), {"multiLine": "true", "escape": '"'})
    first = (F.col("record.block") == 0) & (F.col("record.at") == 0)
    plain = F.regexp_replace(text, '["﻿]', "")
    wrong = F.raise_error(F.concat(F.lit(f"header is not {','.join(names)} but "), plain)).cast("boolean")
    header = F.when(F.lower(plain) == ",".join(names).lower(), F.lit(True)).otherwise(wrong)
    return (
        records.filter(F.trim(text) != "").filter(F.when(first, ~header).otherwise(True))
        .select(parsed.alias("row")).select("row.*")
    )
