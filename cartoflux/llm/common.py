"""Helpers shared by the training-data operators: staged tables and word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Whether shuffle files go at the end of the action that made them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a batch on its way to Python; of texts, fewer than usual, as both sides keep what the largest batches took.
ROWS, TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most TEXTS rows, so that what is made of one is small."""
    for batch in batches:
        for at in range(0, max(1, len(batch)), TEXTS):
            yield batch.slice(at, TEXTS)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(col, _UPPER, _UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local session; a cluster without one is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="cartoflux-")
    spark.conf.set("spark.checkpoint.dir", made) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return made


class Staging:
    """Tables written once to the shared folder, so that lineage ends there and a lost executor
    costs only the tasks that were running on it."""

    def __init__(self, spark: SparkSession, name: str, rows: int = 0):
        """``rows``: at most so many rows go to Python at a time while a table is written; 0 leaves it to the session."""
        self.spark, self.settings = spark, {CLEANUP: "true"}
        now = spark.conf.get(ROWS, None)
        if rows and not (now and 0 < int(now) <= rows):
            self.settings[ROWS] = str(rows)
        self.root = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
        fs, path = self._fs(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        jpath = jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jpath

    def table(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """The rows, written and read again. Shuffle files that the writing made go as soon as it is done, not when
        the driver happens to collect its garbage."""
        path, before = f"{self.root}/{name}", {k: self.spark.conf.get(k, None) for k in self.settings}
        try:
            for k, v in self.settings.items():
                self.spark.conf.set(k, v)
            writer = df.write.option("compression", "zstd")
            (writer.partitionBy(*by) if by else writer).parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Free tables that nothing reads any more."""
        for name in names:
            fs, path = self._fs(f"{self.root}/{name}")
            fs.delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
