"""Versions of a table or of a run, published by one small marker.

Every write goes to a new version folder. What readers see is the newest marker under ``current``, appended when a
version is complete, so a job that dies before leaves the last version in place and readers of it undisturbed. Markers
carry a running number; of two writers that publish at once, all readers take the same one.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_MARKER = "number bigint, version string, row_count bigint, buckets int"


def new_version() -> str:
    return uuid4().hex


def _markers(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(_MARKER).json(f"{root}/current")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, root: str) -> Row | None:
    """The marker readers follow, None if nothing is published."""
    markers = _markers(spark, root)
    if markers is None:
        return None
    newest = markers.agg(F.max_by(F.struct("*"), F.struct("number", "version")).alias("m")).first()
    return newest.m


def current_path(spark: SparkSession, root: str) -> str:
    marker = current(spark, root)
    if marker is None:
        raise FileNotFoundError(f"nothing published under {root}")
    return f"{root}/{marker.version}"


def publish(spark: SparkSession, root: str, version: str, row_count: int | None = None, buckets: int = 0) -> None:
    """Make a complete version the one that readers see."""
    before = current(spark, root)
    row = ((before.number if before else 0) + 1, version, row_count, buckets)
    spark.createDataFrame([row], _MARKER).coalesce(1).write.mode("append").json(f"{root}/current")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that no marker names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_superseded(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete the versions published before the newest ``keep``; for times without readers of old versions."""
    markers = _markers(spark, root)
    if markers is None:
        return []
    old = [row.version for row in markers.orderBy(F.desc("number"), F.desc("version")).offset(keep).collect()]
    for version in old:
        delete(spark, f"{root}/{version}")
    return old
