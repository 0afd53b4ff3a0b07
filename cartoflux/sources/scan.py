"""Lines of text files, read by byte ranges: Spark cuts large files into splits at line ends, one file is read by many
tasks, and what needs the lines before (a number, a record's number) is a sum within the split plus one over splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, pos, line): ``block`` is where in the file a line's split begins, and ``pos`` is in the lines'
    order within it. Lines end with a line feed, a carriage return or both."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line")
    )


def has_mark(spark: SparkSession, path: str) -> bool:
    """Whether the file (the first, if there are several) starts with a UTF-8 byte-order mark: three bytes are read."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = list(fs.globStatus(found) or [])
    files = [f for entry in files for f in (fs.listStatus(entry.getPath()) if entry.isDirectory() else [entry]) if f.isFile()]
    if not files:
        return False
    stream = fs.open(files[0].getPath())
    try:
        return [stream.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]
    finally:
        stream.close()


def with_block(text_lines: DataFrame) -> DataFrame:
    """Lines that don't come from splits (file, pos, line) are one block of their file."""
    return text_lines if "block" in text_lines.columns else text_lines.withColumn("block", F.lit(0).cast("long"))


def counted_before(text_lines: DataFrame, what: Column, name: str) -> DataFrame:
    """Adds how many lines of the file before each line have ``what``: those of the same split by a window over the
    split, those of earlier splits by a sum over the splits, a row for each."""
    text_lines = with_block(text_lines)
    one = F.coalesce(what, F.lit(False)).cast("int")
    splits = text_lines.groupBy("file", "block").agg(F.sum(one).alias("__own"))
    over = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("file", "block", F.coalesce(F.sum("__own").over(over), F.lit(0)).alias("__before"))
    within = W.partitionBy("file", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    inside = text_lines.withColumn("__inside", F.coalesce(F.sum(one).over(within), F.lit(0)))
    return inside.join(splits, ["file", "block"]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def placed(text_lines: DataFrame) -> DataFrame:
    """``pos`` in the order of the whole file: the split first."""
    return with_block(text_lines).withColumn("pos", F.struct("block", "pos")).drop("block")


#: Records that are numbered together.
RUN = 100_000


def ranked(records: DataFrame, number: str, name: str, by: str = "file") -> DataFrame:
    """Adds each record's rank (from 0) in its file, or other group, in order of a number of which few are left out:
    ranks within runs of numbers, plus the records of earlier runs."""
    rows = records.withColumn("__run", F.floor(F.col(number) / RUN))
    runs = rows.groupBy(by, "__run").count()
    runs = runs.select(by, "__run", F.coalesce(F.sum("count").over(W.partitionBy(by).orderBy("__run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy(by, "__run").orderBy(number)) - 1
    return rows.withColumn("__own", own).join(runs, [by, "__run"]).withColumn(name, F.col("__own") + F.col("__before")).drop("__run", "__own", "__before")
