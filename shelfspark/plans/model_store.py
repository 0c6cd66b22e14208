"""Fitted models and their tables, kept so that later processes load what an earlier one has made.

An entry lies under a key made of the state of the source files (path, length, time of change), the parameters, the
package's code and Spark's version, so a change in any of them starts a new entry. Every attempt writes to a version
folder of its own; a marker names the version that counts, written when all of it is there. A process that dies before
leaves no marker, and of two that end at once both markers are read and the smaller version counts for everybody.
"""

from __future__ import annotations

import getpass
import hashlib
import json
import tempfile
from collections.abc import Callable
from pathlib import Path
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER_SETTING = "spark.shelfspark.modelStore"


def store_folder(spark: SparkSession) -> str:
    """The named folder, else one in the shared checkpoint folder; on a local master else one that outlives the process."""
    if named := spark.conf.get(FOLDER_SETTING, None):
        return named.rstrip("/")
    if shared := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return f"{shared.rstrip('/')}/models"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {FOLDER_SETTING} or spark.checkpoint.dir to a folder that all executors share.")
    return f"{tempfile.gettempdir()}/shelfspark-models-{getpass.getuser()}"


def files_state(spark: SparkSession, paths: list[str]) -> list:
    """Number, bytes and a checksum of paths, lengths and times of change of all files; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    row = files.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", F.unix_micros("modificationTime")))).first()
    return list(row)


def code_state() -> str:
    root, digest = Path(__file__).resolve().parents[1], hashlib.sha256()
    for part in ("functions", "operators", "plans", "sources"):
        for file in sorted((root / part).glob("*.py")):
            digest.update(file.read_bytes())
    return digest.hexdigest()


class ModelStore:
    """Named tables and models under one key."""

    def __init__(self, spark: SparkSession, sources: list[str], **parameters):
        self.spark = spark
        made_of = [files_state(spark, sources), sorted(sources), parameters, code_state(), spark.version]
        key = hashlib.sha256(json.dumps(made_of, sort_keys=True).encode()).hexdigest()[:32]
        self.root = f"{store_folder(spark)}/{key}"

    def _version(self, name: str) -> str | None:
        try:
            marker = self.spark.read.schema("version string").json(f"{self.root}/{name}/current")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return marker.agg(F.min("version")).first()[0]

    def has(self, name: str) -> bool:
        return self._version(name) is not None

    def _publish(self, name: str, write: Callable[[str], None]) -> str:
        """The folder of the version that counts, written now if there is none."""
        version = self._version(name)
        if version is None:
            mine = uuid4().hex
            write(f"{self.root}/{name}/{mine}")
            self.spark.createDataFrame([(mine,)], "version string").coalesce(1).write.mode("append").json(f"{self.root}/{name}/current")
            version = self._version(name)
        return f"{self.root}/{name}/{version}"

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stored table, built and stored first if there is none."""
        return self.spark.read.parquet(self._publish(name, lambda path: build().write.parquet(path)))

    def model(self, name: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
        """The stored model, fitted and stored first if there is none."""
        return PipelineModel.load(self._publish(name, lambda path: fit().write().save(path)))
