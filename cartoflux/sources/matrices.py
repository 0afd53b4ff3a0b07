"""Numeric matrices from separated text, and their sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoflux.functions.text import strip
from cartoflux.sources.scan import counted_before, lines

NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"


def leading_number(text: Column) -> Column:
    """The number that a text starts with, else 0."""
    return F.coalesce(F.regexp_extract(strip(text), NUMBER, 0).try_cast("double"), F.lit(0.0))


def strict_number(text: Column) -> Column:
    return F.coalesce(strip(text).try_cast("double"), F.lit(0.0))


def fields(line: Column, sep: str = ",") -> Column:
    """A line's trimmed fields; quotes enclose separators and a doubled quote is one quote.

    Separators outside quotes are those with an even number of quotes after them. A field of two quotes only
    reads as one quote, as the original tool has it.
    """
    quoted = "\\" + sep if sep in "|.^$*+?" else sep
    parts = F.split(line, f'{quoted}(?=(?:[^"]*"[^"]*")*[^"]*$)')

    def clean(p: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, '""', "\u0001"), '"', ""), "\u0001", '"')
        return strip(inner)

    return F.transform(parts, clean)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line): lines with their number in the file, which many tasks may have read."""
    return counted_before(lines(spark, path), F.lit(True), "number").select(F.col("number").alias("pos"), "line")


def read_profile(spark: SparkSession, path: str, label_index: int = 0, ignore: tuple[int, ...] = (), sep: str = ",") -> tuple[DataFrame, list[str]]:
    """(rows, components): rows (row_id, label, features) of a file with a header. Blank lines are dropped, rows
    with fewer fields than the header too; what is no number counts as 0. Fewer than two lines are an error."""
    return profile_rows(numbered(spark, path), label_index, ignore, sep)


def profile_rows(text: DataFrame, label_index: int = 0, ignore: tuple[int, ...] = (), sep: str = ",") -> tuple[DataFrame, list[str]]:
    kept = text.select("pos", strip(F.regexp_replace("line", "^﻿", "")).alias("line")).filter("line <> ''")
    head = kept.orderBy("pos").limit(2).select("pos", fields(F.col("line"), sep).alias("f")).collect()
    if len(head) < 2:
        raise ValueError("a header and one row at least")
    names = head[0]["f"]
    used = [i for i in range(len(names)) if i != label_index and i not in ignore]
    rows = kept.filter(F.col("pos") > head[0]["pos"]).select("pos", fields(F.col("line"), sep).alias("f")).filter(F.size("f") >= len(names))
    made = rows.select(F.col("pos").cast("long").alias("row_id"), F.col("f")[label_index].alias("label"), F.array(*[leading_number(F.col("f")[i]) for i in used]).alias("features"))
    return made, [names[i] for i in used]


def read_numbers(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(row_id, features) of a file without labels; a first row with any field that is no number is a header."""
    return number_rows(numbered(spark, path), sep)


def number_rows(text: DataFrame, sep: str = ",") -> DataFrame:
    """(row_id, features) of lines (pos, line), blank ones left out."""
    parsed = text.filter(strip(F.col("line")) != "").select(F.col("pos").cast("long").alias("row_id"), fields(F.col("line"), sep).alias("f"))
    header = F.exists("f", lambda v: strip(v).try_cast("double").isNull())
    first = parsed.agg(F.min_by(F.struct("row_id", header.alias("header")), "row_id").alias("first"))
    joined = parsed.join(F.broadcast(first), F.lit(True)).filter(~(F.col("first.header") & (F.col("row_id") == F.col("first.row_id"))))
    return joined.select("row_id", F.transform("f", strict_number).alias("features"))


def cells(rows: DataFrame, components: list[str]) -> DataFrame:
    """Long form (row_id, label, component, value)."""
    names = F.array(*[F.lit(c) for c in components])
    return rows.select("row_id", "label", F.posexplode("features").alias("k", "value")).select("row_id", "label", names[F.col("k")].alias("component"), "value")


def features(long: DataFrame, components: list[str]) -> DataFrame:
    """Back from the long form, components in a given order."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(components) for x in (c, i)])
    kept = F.sort_array(F.collect_list(F.struct(order[F.col("component")].alias("k"), "value")))
    return long.groupBy("row_id", "label").agg(F.transform(kept, lambda s: s["value"]).alias("features"))


def write_csv(df: DataFrame, path: str, order: str | None = None) -> None:
    """One file with a header: for exports of display size."""
    (df.orderBy(order) if order else df).coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def save_project(path: str, tables: dict[str, DataFrame], settings: dict, spark: SparkSession, version: str = "1.0") -> None:
    """A project: a Parquet table for each DataFrame and a manifest."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/tables/{name}")
    manifest = json.dumps({"version": version, "tables": sorted(tables), "settings": settings})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_project(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
    return {name: spark.read.parquet(f"{path}/tables/{name}") for name in manifest["tables"]}, manifest["settings"]
