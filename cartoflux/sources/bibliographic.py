"""Bibliographic exports as DataFrames: comma-separated exports with a byte-order mark, RIS, and tagged text (two-letter tags with
three-space continuation, and four-letter tags with six-space continuation).

Files are read as text lines by byte ranges (``scan.lines``), so one large file is read and parsed by many tasks; a
record's number comes from counts within and over the ranges, and a record may span two of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartoflux.functions.text import clean_year, normalise_terms, split_terms, strip
from cartoflux.sources.scan import counted_before, has_mark, lines, placed, with_block

#: Tags of tagged text and the columns of comma-separated exports that hold the same.
TAG_COLUMNS = {
    "AU": "Authors",
    "DE": "Author Keywords",
    "ID": "Index Keywords",
    "TI": "Title",
    "SO": "Source title",
    "PY": "Year",
    "AB": "Abstract",
    "DI": "DOI",
    "TC": "Cited by",
    "UT": "EID",
}

DATE_TAGS = ("DP", "PY", "PD")


def column_for(tag: str) -> str:
    """An unknown tag is taken for a column's name."""
    return TAG_COLUMNS.get(tag.strip(), tag)


def split_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(F.col(key).alias("file"), F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("pos", "line"))


def is_scopus(text: Column) -> Column:
    """A byte-order mark, and a first line with Authors and Title."""
    header = F.substring_index(text, "\n", 1)
    return text.startswith("﻿") & F.contains(header, F.lit("Authors")) & F.contains(header, F.lit("Title"))


def is_ris(text: Column) -> Column:
    """The first line that is not blank starts with a TY tag."""
    return text.rlike(r"^﻿?\s*TY {1,2}-")


def detect(text: Column) -> Column:
    return F.when(is_ris(text), "ris").when(is_scopus(text), "scopus").otherwise("tagged")


def detect_file(spark: SparkSession, path: str) -> str:
    """The format of a file, from its first line and its first that is not blank, however far down that is."""
    read = lines(spark, path)
    first = read.filter("block = 0").select("line").take(1)
    filled = read.filter(F.col("line").rlike(r"\S"))
    start = filled.filter("block = 0").select("line").take(1) or filled.agg(F.min_by("line", F.struct("file", "block", "pos")).alias("line")).collect()
    head = "\ufeff" * has_mark(spark, path) + "\n".join(r["line"] or "" for r in [*first, *start])  # readers of lines drop the mark
    return spark.range(1).select(detect(F.lit(head))).first()[0]


def read_scopus(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, blanks empty; doubled quotes stand for quotes, fields may span lines."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', encoding="UTF-8", nanValue="\u0000", emptyValue="")
    names = [c.lstrip("﻿") for c in rows.columns]
    return rows.toDF(*names).na.fill("")


def scopus_records(rows: DataFrame, tag: str = "DE") -> DataFrame:
    """doc_id, title, year, terms of a tag's column and authors, both lower-case lists."""
    text = lambda c: F.col(f"`{c}`") if c in rows.columns else F.lit("")
    keyed = F.concat_ws("\u0001", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in rows.columns])
    doc_id = F.coalesce(F.when(text("EID") != "", text("EID")), F.md5(keyed))
    return rows.select(doc_id.alias("doc_id"), text("Title").alias("title"), text("Year").alias("year"), split_terms(text(column_for(tag))).alias("terms"), split_terms(text("Authors")).alias("authors"))


_RIS_TAGS = {"title": ("TI", "T1"), "year": ("PY", "Y1"), "journal": ("JO", "T2", "J2", "JF"), "abstract": ("AB",), "doi": ("DO",)}


def parse_ris(text_lines: DataFrame, strict_end: bool = False) -> DataFrame:
    """Records of RIS lines (file, pos, line). A stripped line that starts with ER ends a record (with
    ``strict_end`` only a true ER tag), the last record needs none. The first title, year (4 characters), journal,
    abstract and doi count, the last type; keywords and authors are lists in order."""
    body = strip(F.col("line"))
    ends = body.rlike("^ER {0,2}-") if strict_end else body.startswith("ER")
    marked = placed(counted_before(text_lines.withColumn("ends", ends), F.col("ends"), "rec"))
    tagged = marked.filter(~F.col("ends") & F.col("line").rlike("^[A-Z0-9]{2}  - ")).select("file", "rec", "pos", F.substring("line", 1, 2).alias("tag"), strip(F.expr("substring(line, 7)")).alias("value"))

    def first(tags: tuple[str, ...]) -> Column:
        return F.coalesce(F.min_by(F.when(F.col("tag").isin(*tags), F.col("value")), F.when(F.col("tag").isin(*tags), F.col("pos"))), F.lit(""))

    def listed(tag: str) -> Column:
        kept = F.sort_array(F.collect_list(F.when(F.col("tag") == tag, F.struct("pos", "value"))))
        return F.transform(kept, lambda s: s["value"])

    found = tagged.groupBy("file", "rec").agg(
        *[first(tags).alias(name) for name, tags in _RIS_TAGS.items()],
        F.coalesce(F.max_by(F.when(F.col("tag") == "TY", F.col("value")), F.when(F.col("tag") == "TY", F.col("pos"))), F.lit("")).alias("doc_type"),
        listed("KW").alias("keywords"),
        listed("AU").alias("authors"),
    )
    return found.withColumn("year", F.substring("year", 1, 4))


def ris_records(records: DataFrame) -> DataFrame:
    doc_id = F.concat_ws("#", "file", F.col("rec").cast("string"))
    return records.select(doc_id.alias("doc_id"), "title", "year", normalise_terms(F.col("keywords")).alias("terms"), normalise_terms(F.col("authors")).alias("authors"))


def parse_tagged(text_lines: DataFrame) -> DataFrame:
    """(file, rec, tags: map from tag to list of values) of tagged text.

    Both layouts are known by their lines: "XX value" with three spaces before what goes on, records ending
    with ER; "XXXX- value" with six, a blank line between records. What goes on a line joins the value
    before it, except that a continued author or reference is a value of its own.
    """
    line = F.col("line")
    medline = r"^([A-Z][A-Z0-9 ]{3})- (.*)$"
    two = r"^([A-Z][A-Z0-9])(?: (.*))?$"
    is_medline, is_two = line.rlike(medline), line.rlike(two)
    tag = F.when(is_medline, F.rtrim(F.regexp_extract(line, medline, 1))).when(is_two, F.regexp_extract(line, two, 1))
    value = F.when(is_medline, F.regexp_extract(line, medline, 2)).when(is_two, F.regexp_extract(line, two, 2)).otherwise(line)
    text_lines = with_block(text_lines)
    layout = text_lines.groupBy("file").agg(F.coalesce(F.bool_or(is_medline), F.lit(False)).alias("medline"))
    marked = text_lines.select("file", "block", "pos", "line", tag.alias("own"), strip(value).alias("value")).join(layout, "file")
    ends = (F.col("own") == "ER") | (F.col("medline") & (strip(F.col("line")) == ""))
    marked = placed(counted_before(marked.withColumn("ends", F.coalesce(ends, F.lit(False))), F.col("ends"), "rec"))
    body = marked.filter(~F.col("ends") & (strip(F.col("line")) != "") & ~F.coalesce(F.col("own").isin("FN", "VR", "EF"), F.lit(False)))
    within = W.partitionBy("file", "rec").orderBy("pos")
    body = body.withColumn("tag", F.last("own", ignorenulls=True).over(within)).filter(F.col("tag").isNotNull())
    # a list tag's continued line is a value of its own
    starts = F.col("own").isNotNull() | F.col("tag").isin("AU", "AF", "CR", "C1")
    body = body.withColumn("part", F.sum(starts.cast("int")).over(within))
    values = body.groupBy("file", "rec", "tag", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]), " ").alias("value"))
    lists = values.groupBy("file", "rec", "tag").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "value"))), lambda s: s["value"]).alias("values"))
    return lists.groupBy("file", "rec").agg(F.map_from_entries(F.collect_list(F.struct("tag", "values"))).alias("tags"))


def tag_values(tags: Column, tag: str) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(tag)), F.array().cast("array<string>"))


def tagged_list(tags: Column, tag: str) -> Column:
    """A tag's terms: keyword tags hold separated lists, the others one term a value; dates are cleaned."""
    values = tag_values(tags, tag)
    if tag in DATE_TAGS:
        values = F.transform(values, clean_year)
    if tag in ("DE", "ID", "MH", "OT"):
        values = F.flatten(F.transform(values, lambda v: F.split(v, ";")))
    return normalise_terms(values)


def tagged_year(tags: Column) -> Column:
    """PY, else the first four characters of DP, as a number if it is one."""
    py = F.try_element_at(tag_values(tags, "PY"), F.lit(1))
    dp = F.substring(F.try_element_at(tag_values(tags, "DP"), F.lit(1)), 1, 4)
    return F.coalesce(py, dp).try_cast("int")


def tagged_records(records: DataFrame, tag: str = "DE") -> DataFrame:
    tags = F.col("tags")
    title = F.coalesce(F.try_element_at(tag_values(tags, "TI"), F.lit(1)), F.lit("Unknown Title"))
    return records.select(
        F.concat_ws("#", "file", F.col("rec").cast("string")).alias("doc_id"),
        title.alias("title"),
        tagged_year(tags).cast("string").alias("year"),
        tagged_list(tags, tag).alias("terms"),
        tagged_list(tags, "AU").alias("authors"),
        tagged_list(tags, "CR").alias("refs"),
    )


def read_records(spark: SparkSession, path: str, tag: str = "DE") -> tuple[str, DataFrame]:
    """(format, records) of an export: RIS is tried first, then the comma-separated form, else tagged text."""
    kind = detect_file(spark, path)
    if kind == "scopus":
        return kind, scopus_records(read_scopus(spark, path), tag)
    if kind == "ris":
        return kind, ris_records(parse_ris(lines(spark, path)))
    return kind, tagged_records(parse_tagged(lines(spark, path)), tag)
