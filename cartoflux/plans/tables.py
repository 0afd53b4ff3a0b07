"""The library's inputs in terms of the driver's tables.

Documents are orders with their year; keywords are part brands, authors suppliers, references parts. Vectors
are the embeddings. The entity and time matrix is events by user and day, a component for each event type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoflux.operators import som

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
GRID = (4, 4)


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


#: Lines of orders that a task joins, deduplicates and pairs; fewer tasks than FEW are left to Spark.
LINES, FEW = 250_000, 8


def _line_terms(spark: SparkSession, sf: str, key: str, names: DataFrame) -> DataFrame:
    """(doc_id, year, term): the terms of an order's lines; names: (key, term). What follows goes by order too, all of it
    in one stage whose sorts and sets are held together, so its tasks grow in number, not in size, with the table; and
    where the names are too many to be sent to each executor, so do those that join them."""
    orders = read(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    lines = read(spark, sf, "lineitem").select("l_orderkey", key)
    tasks = -(-lines.count() // LINES)
    if tasks <= FEW:
        named = lines.join(names, F.col(key) == F.col("key"))
    elif names.count() <= LINES:
        named = lines.repartition(tasks, "l_orderkey").join(F.broadcast(names), F.col(key) == F.col("key"))
        orders = orders.repartition(tasks, "o_orderkey")
    else:
        named = lines.repartition(tasks, key).join(names.repartition(tasks, "key"), F.col(key) == F.col("key"))
        named, orders = named.select("l_orderkey", "term").repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    dated = named.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return dated.select(F.col("o_orderkey").alias("doc_id"), "year", "term").distinct()


def brand_terms(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, year, term): brands of an order's parts."""
    return _line_terms(spark, sf, "l_partkey", read(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.lower("p_brand").alias("term")))


def author_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _line_terms(spark, sf, "l_suppkey", read(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.lower("s_name").alias("term")))


def reference_terms(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").cast("string").alias("term")).distinct()


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, entity, day, <event types>): summed values by user and day."""
    day = F.to_date("ts")
    sums = [F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("value"))), F.lit(0.0)).alias(t) for t in EVENT_TYPES]
    rows = read(spark, sf, "events").groupBy(F.col("user_id").alias("entity"), day.alias("day")).agg(*sums)
    return rows.withColumn("row_id", F.col("entity") * 100 + F.dayofmonth("day"))


def event_cells(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, entity, component, value)."""
    rows = event_rows(spark, sf)
    return rows.unpivot(["row_id", "entity"], EVENT_TYPES, "component", "value")


def nation_cells(spark: SparkSession, sf: str) -> DataFrame:
    """(year, label, component, value): orders and their price by customers' nation and year."""
    customer = read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = read(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("label"))
    orders = read(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = joined.groupBy("year", "label").agg(F.count("*").cast("double").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    return rows.unpivot(["year", "label"], ["orders", "price"], "component", "value")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, label, features) of the embeddings, in double precision."""
    rows = read(spark, sf, "embeddings").filter("embedding IS NOT NULL")
    return rows.select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("features"))


def first_codebook(spark: SparkSession, sf: str):
    """The first vectors by id as a codebook: a start that SQL can name too."""
    import numpy as np

    rows, cols = GRID
    first = vectors(spark, sf).orderBy("row_id").limit(rows * cols).select("features").collect()
    return np.array([r[0] for r in first])


def assigned(spark: SparkSession, sf: str, metric: str = "euclidean") -> DataFrame:
    return som.assign(vectors(spark, sf), first_codebook(spark, sf), metric)


def plane(spark: SparkSession, sf: str) -> DataFrame:
    """(id, x, y, value, category): the vectors' first two components."""
    v = vectors(spark, sf)
    return v.select(F.col("row_id").alias("id"), F.col("features")[0].alias("x"), F.col("features")[1].alias("y"), F.col("features")[2].alias("value"), F.concat(F.lit("c"), "label").alias("category"))
