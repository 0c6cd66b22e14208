"""Session settings and durable lineage cuts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans rely on. The first one lets every join of the weekly panel
# keep the SKU partitioning instead of shuffling the panel once per join.
RUNTIME_SETTINGS = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Longer generated methods are never compiled by the JVM: the wide panel ran interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Shuffle files go when their query ends, not when the driver happens to collect garbage: a stage's result is
    # written by then, and the next stage needs the disk. A frame that is collected again is computed again.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Compressed tables grow tenfold in memory: with the default of 128 MB the sums of one scan task spill.
    "spark.sql.files.maxPartitionBytes": "32m",
}
# Rows of the largest table that one shuffle partition begins with.
ROWS_PER_TASK = 500_000
# Fixed once a session runs, so it only helps sessions built here: call-site capture per
# column costs more than planning does in expression-heavy plans.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(master: str | None = None, app: str = "shelfspark", **settings) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**START_SETTINGS, **RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tuned(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else has built."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def widen_shuffles(spark: SparkSession, rows: int) -> None:
    """Let shuffles begin with a partition for each ROWS_PER_TASK rows of the largest table, so that their sorts stay in memory.

    Adaptive execution merges partitions that turn out small, but never makes more of them.
    """
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                   str(max(shuffle_width(spark), -(-rows // ROWS_PER_TASK))))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stage_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    return tempfile.mkdtemp(prefix="shelfspark-stage-")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a stage result as a table in the shared folder and read it back.

    This is the hand-off between two stages: it cuts the lineage, survives the loss of
    executors, and lets the next stage read only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{name}-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: one zip per application, fetched from the driver."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix=f"{root.name}-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as bundle:
        for file in sorted(root.rglob("*.py")):
            bundle.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(application)
