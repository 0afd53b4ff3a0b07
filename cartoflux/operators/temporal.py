"""Series of entities over time: smoothing with a shrinking window, trajectories and their steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartoflux.functions.text import parse_label


def with_entity_and_time(rows: DataFrame, label: str = "label") -> DataFrame:
    parsed = rows.withColumn("__p", parse_label(F.col(label)))
    return parsed.select(*rows.columns, "__p.entity", "__p.time_text", "__p.is_temporal")


def is_temporal(rows: DataFrame, label: str = "label") -> DataFrame:
    """One row: whether any label reads as temporal."""
    return rows.agg(F.coalesce(F.max(parse_label(F.col(label)).getField("is_temporal")), F.lit(False)).alias("temporal"))


def moving_average(rows: DataFrame, window: int, entity: str = "entity", order: str = "row_id", value: str = "value", *more: str) -> DataFrame:
    """The centred mean of each entity's rows in order; near an end the window shrinks on both sides alike.

    From running sums: at row i of n with half width h = min(window // 2, i, n - 1 - i) the mean is
    (S[i + h] - S[i - h - 1]) / (2 h + 1). Each h is a fixed lag and lead, so one window pass serves.
    """
    half = window // 2
    keys = [entity, *more]
    w = W.partitionBy(*keys).orderBy(order)
    ranked = rows.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(W.partitionBy(*keys)))
    h = F.least(F.lit(half), F.col("__i"), F.col("__n") - 1 - F.col("__i"))
    means = [F.avg(value).over(w.rowsBetween(-k, k)) for k in range(half + 1)]
    mean = means[0]
    for k in range(1, half + 1):
        mean = F.when(h == k, means[k]).otherwise(mean)
    return ranked.withColumn("smoothed", mean).drop("__i", "__n")


def trajectories(assigned: DataFrame, entity: str = "entity", order: str = "row_id", place: str = "bmu") -> DataFrame:
    """Each entity's places in row order, those of two points or more being drawn."""
    points = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(place))))
    return assigned.groupBy(entity).agg(points.alias("points")).withColumn("drawn", F.size("points") >= 2)


def steps(assigned: DataFrame, entity: str = "entity", order: str = "row_id", place: str = "bmu") -> DataFrame:
    """(entity, row, from, to) of each move."""
    w = W.partitionBy(entity).orderBy(order)
    moved = assigned.withColumn("to_place", F.lead(place).over(w))
    return moved.filter(F.col("to_place").isNotNull()).select(entity, order, F.col(place).alias("from_place"), "to_place")


def chosen(assigned: DataFrame, entities: DataFrame, entity: str = "entity") -> DataFrame:
    return assigned.join(entities.select(entity).distinct(), entity, "left_semi")


def placed(assigned: DataFrame, points: DataFrame | None, neurons: DataFrame) -> DataFrame:
    """Rows with x, y: their own point's (row_id, x, y), else their neuron's (neuron, x, y); without either they go."""
    grid = neurons.select(F.col("neuron").alias("bmu"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    joined = assigned.join(F.broadcast(grid), "bmu", "left")
    if points is not None:
        joined = joined.join(points.select("row_id", "x", "y"), "row_id", "left")
        joined = joined.withColumn("x", F.coalesce("x", "nx")).withColumn("y", F.coalesce("y", "ny"))
    else:
        joined = joined.withColumnRenamed("nx", "x").withColumnRenamed("ny", "y")
    return joined.filter("x IS NOT NULL AND y IS NOT NULL").drop("nx", "ny")


def spline(points: DataFrame, pieces: int = 8, alpha: float = 0.5) -> DataFrame:
    """Catmull-Rom curves (centripetal for alpha = .5) through each entity's x, y in row order, as columns.

    Barry and Goldman's scheme, with the end points doubled in direction.
    """
    w = W.partitionBy("entity").orderBy("row_id")
    at = lambda c, k: F.lag(c, -k).over(w)
    p = points.select("entity", "row_id", *[c for k in (-1, 0, 1, 2) for c in (at("x", k).alias(f"x{k + 1}"), at("y", k).alias(f"y{k + 1}"))])
    p = p.filter("x2 IS NOT NULL")
    for axis in "xy":
        p = p.withColumn(f"{axis}0", F.coalesce(f"{axis}0", F.expr(f"2 * {axis}1 - {axis}2"))).withColumn(f"{axis}3", F.coalesce(f"{axis}3", F.expr(f"2 * {axis}2 - {axis}1")))
    p = p.withColumn("t1", F.lit(0.0))
    for k in (0, 1, 2):
        span = F.pow(F.hypot(F.col(f"x{k + 1}") - F.col(f"x{k}"), F.col(f"y{k + 1}") - F.col(f"y{k}")), alpha)
        p = p.withColumn(f"d{k}", F.greatest(span, F.lit(1e-9)))
    p = p.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces)))).withColumn("t", F.col("d1") * F.col("piece") / pieces)

    def mix(a: Column, b: Column, ta: Column, tb: Column) -> Column:
        return (tb - F.col("t")) / (tb - ta) * a + (F.col("t") - ta) / (tb - ta) * b

    t0, t1, t2, t3 = -F.col("d0"), F.lit(0.0), F.col("d1"), F.col("d1") + F.col("d2")
    out = []
    for axis in "xy":
        q = [F.col(f"{axis}{k}") for k in range(4)]
        a1, a2, a3 = mix(q[0], q[1], t0, t1), mix(q[1], q[2], t1, t2), mix(q[2], q[3], t2, t3)
        b1, b2 = mix(a1, a2, t0, t2), mix(a2, a3, t1, t3)
        out.append(mix(b1, b2, t1, t2).alias(axis))
    return p.select("entity", "row_id", "piece", *out)
