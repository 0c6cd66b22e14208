"""Exact deduplication as a stateful stream.

The table is read as a stream of files. Each row gives the SHA-256 digest of its text, its doc_id and a locator of the
content (file and row in it); the text itself is not shuffled. A streaming aggregation keyed by the digest holds, on disk
(RocksDB, saved with the checkpoint) and without expiry, how many rows came, the row that stays, and the locator of the
content the digest stands for. Rows of a digest are combined before the shuffle, so a text in a third of all rows is one
row a task. Every micro-batch writes the digests it changed under its number, so a repeated batch replaces itself; the
next start on the same folder goes on with the files that are new.

A digest met again is a hit, and its rows must hold the bytes of the content at the locator: the least and the greatest
text of each digest are found, in each task first, and compared. Digests for which they differ are told apart by the text.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_folder
from .common import staged

# The state lies on disk; files grow as needed, as there is one small store for each partition of the state.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def located(docs: DataFrame, digest=sha256) -> DataFrame:
    """(doc_id, text, digest, file, row) of the rows of a Parquet table; file and row are the locator of the content."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"),
                       F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).withColumn("digest", digest(F.col("text")))


def drain(spark: SparkSession, path: str, folder: str, digest=sha256, batch_bytes: int = 64 << 30) -> None:
    """Bring the state in `folder` up to all files of the table at `path`, at most about `batch_bytes` of them in a batch."""
    schema = spark.read.parquet(path).schema
    files = f"{path[:-1]}[{path[-1]}]"  # a stream takes a table of a single file by a pattern only
    arrivals = located(spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(files), digest)
    keep = F.max(F.struct("doc_id", "file", "row"))
    seen = arrivals.groupBy("digest").agg(F.count("*").alias("n"), keep.alias("keep"), F.min(F.struct("file", "row")).alias("at"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        (seen.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def retained(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, n, keep, at): the last state of every digest. n only grows, so its largest value is the last."""
    row = "digest binary, n long, keep struct<doc_id: long, file: string, row: long>, at struct<file: string, row: long>"
    changes = spark.read.schema(row).parquet(f"{folder}/changes")
    last = changes.groupBy("digest").agg(F.max(F.struct("n", "keep", "at")).alias("last"))
    return last.select("digest", "last.*")


def unequal(docs: DataFrame, state: DataFrame) -> DataFrame:
    """The digests met more than once whose rows do not all hold the same bytes. Two texts a digest and task are shuffled."""
    compared = docs.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    return compared.filter("least <> most").join(state.filter("n > 1"), "digest", "left_semi").select("digest")


def classes(docs: DataFrame, state: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row of `docs`, as `located`, by the state and a check of all bytes."""
    state = staged(state, "digests")
    different = staged(unequal(docs, state), "unequal-digests")
    kept = F.struct("doc_id", "file", "row").eqNullSafe(F.col("keep"))
    out = ["doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest"]
    found = docs.drop("text").join(state.drop("at").join(different, "digest", "left_anti"), "digest").select(*out)
    if different.isEmpty():
        return found
    rest = docs.join(different, "digest", "left_semi")
    apart = rest.groupBy("digest", "text").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
    return found.unionByName(rest.join(apart, ["digest", "text"]).select(*out))


def exact_duplicates(spark: SparkSession, path: str, folder: str | None = None, digest=sha256, batch_bytes: int = 64 << 30) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row of the Parquet table at `path`.

    Rows of equal text are one group; the one with the largest doc_id stays, of repeated rows of that id the last by file
    and place. Null texts count as empty, null ids are the smallest. An empty table gives no rows. Other columns are not
    read. `folder` holds the state between calls (a new one if not given): later calls read only new files into it, but
    compare the bytes of the whole table.
    """
    path = path.rstrip("/")
    folder = folder or f"{stage_folder(spark)}/seen-{uuid4().hex}"
    docs = located(spark.read.parquet(path), digest)
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, digest binary")
    drain(spark, path, folder, digest, batch_bytes)
    return classes(docs, retained(spark, folder))
