"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, staged

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 8 << 20


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids get a null fold."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string")) % modulus


def is_fold(doc_id: str, modulus: int, remainder: int) -> Column:
    """True where the fold is the remainder; a null id is in no held-out fold."""
    return F.coalesce(fold(doc_id, modulus) == remainder, F.lit(False))


def bounded_share(rows: int, bound: int, key: Column) -> Column:
    """A filter that keeps about `bound` of `rows` rows, the same ones on every run."""
    if rows <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * bound / rows)


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most `limit` bytes of text and `rows` rows each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for at, size in enumerate(sizes):
        if at > start and (total + size > limit or at - start >= rows):
            yield batch.slice(start, at - start)
            start, total = at, 0
        total += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def map_slices(df: DataFrame, column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
               limit: int = CHUNK_BYTES) -> DataFrame:
    """Apply `work` to Arrow batches of at most `limit` bytes of text, one row at least; it returns one batch each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                yield work(part)
    return df.mapInArrow(run, schema)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with one column replaced or appended."""
    at = batch.schema.get_field_index(name)
    return batch.set_column(at, name, values) if at >= 0 else batch.append_column(name, values)


def release(written: DataFrame) -> None:
    """Delete a table that `staged` wrote, once all that is read from it is written itself."""
    spark = written.sparkSession
    folders = {file.rsplit("/", 1)[0] for file in written.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BROADCAST_ROWS = 500_000  # narrow keys that are sent to all tasks at most; more are shuffled


def keys_for_join(keys: DataFrame) -> DataFrame:
    """A written table of narrow keys, marked for broadcast while it has few rows, so that the texts it selects stay in place."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


__all__ = ["CHUNK_BYTES", "WORD", "bounded_share", "fold", "is_fold", "keys_for_join", "map_slices", "release", "ship_package", "slices", "staged", "table", "with_column"]
