"""Normalisations of matrices in long form, and profiles of their components.

Component matrices are cells (row_id, component, value); co-occurrence and two-mode matrices are cells
(row_term, col_term, w). ``by`` names further key columns, such as the year, within which to normalise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoflux.operators.selection import at_ranks

COMPONENT = ("div_max", "min_max", "z_score")
COOCCURRENCE = ("cooc_cosine", "cooc_association", "cooc_jaccard", "cooc_inclusion")
BIPARTITE = ("bipartite_row", "bipartite_col", "bipartite_sym")
OFFERED = {"csv": COMPONENT, "monothematic": (*COMPONENT, *COOCCURRENCE), "bipartite": (*COMPONENT, *BIPARTITE)}


def _or_one(divisor: Column) -> Column:
    return F.when(divisor == 0, 1.0).otherwise(divisor)


def normalise_components(cells: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """div_max, min_max or z_score (population deviation) of each component; a zero divisor counts as 1.

    Statistics are one grouped aggregate, joined back on the component."""
    stats = cells.groupBy(*by, "component").agg(
        F.max("value").alias("hi"), F.min("value").alias("lo"), F.avg("value").alias("mid"), F.stddev_pop("value").alias("dev")
    )
    joined = cells.join(stats, [*by, "component"])
    value = {
        "div_max": F.col("value") / _or_one(F.col("hi")),
        "min_max": (F.col("value") - F.col("lo")) / _or_one(F.col("hi") - F.col("lo")),
        "z_score": (F.col("value") - F.col("mid")) / _or_one(F.col("dev")),
    }[kind]
    return joined.select(*cells.columns[: cells.columns.index("value")], value.alias("value"))


def inverse_components(normal: DataFrame, original: DataFrame, kind: str) -> DataFrame:
    """Back to the original scale, from the original's statistics."""
    stats = original.groupBy("component").agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.avg("value").alias("mid"), F.stddev_pop("value").alias("dev"))
    value = {
        "div_max": F.col("value") * _or_one(F.col("hi")),
        "min_max": F.col("value") * _or_one(F.col("hi") - F.col("lo")) + F.col("lo"),
        "z_score": F.col("value") * _or_one(F.col("dev")) + F.col("mid"),
    }[kind]
    return normal.join(stats, "component").select(*normal.columns[: normal.columns.index("value")], value.alias("value"))


def normalise_cooccurrence(cells: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """Similarities from the cells above the diagonal, mirrored; 1 on the diagonal.

    0 / 0 is 0; another number over 0 stays infinite."""
    w, keys = F.col("w").cast("double"), list(by)
    diagonal = cells.filter("row_term = col_term").select(*keys, F.col("row_term").alias("term"), w.alias("d"))
    upper = cells.filter("row_term < col_term").select(*keys, "row_term", "col_term", w.alias("m"))
    joined = upper.join(diagonal.select(*keys, F.col("term").alias("row_term"), F.col("d").alias("a")), [*keys, "row_term"], "left").join(
        diagonal.select(*keys, F.col("term").alias("col_term"), F.col("d").alias("b")), [*keys, "col_term"], "left"
    )
    joined = joined.na.fill(0.0, ["a", "b"])
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    divisor = {"cooc_cosine": F.sqrt(a * b), "cooc_association": a * b, "cooc_jaccard": a + b - m, "cooc_inclusion": F.least(a, b)}[kind]
    value = F.when(divisor != 0, m / F.when(divisor != 0, divisor)).when(m == 0, 0.0).otherwise(F.lit(float("inf")))
    out = joined.select(*keys, "row_term", "col_term", value.alias("value"))
    mirrored = out.select(*keys, F.col("col_term").alias("row_term"), F.col("row_term").alias("col_term"), "value")
    ones = diagonal.select(*keys, F.col("term").alias("row_term"), F.col("term").alias("col_term"), F.lit(1.0).alias("value"))
    return out.unionByName(mirrored).unionByName(ones)


def normalise_bipartite(cells: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """Cells over the row's sum, the column's, or the root of both; a zero sum counts as 1."""
    keys = list(by)
    rows = cells.groupBy(*keys, "row_term").agg(F.sum("w").cast("double").alias("r"))
    columns = cells.groupBy(*keys, "col_term").agg(F.sum("w").cast("double").alias("c"))
    joined = cells
    if kind != "bipartite_col":
        joined = joined.join(rows, [*keys, "row_term"])
    if kind != "bipartite_row":
        joined = joined.join(columns, [*keys, "col_term"])
    divisor = {
        "bipartite_row": lambda: _or_one(F.col("r")),
        "bipartite_col": lambda: _or_one(F.col("c")),
        "bipartite_sym": lambda: _or_one(F.sqrt(F.col("r") * F.col("c"))),
    }[kind]()
    return joined.select(*keys, "row_term", "col_term", (F.col("w") / divisor).alias("value"))


def normalise(cells: DataFrame, kind: str, origin: str, by: Sequence[str] = ()) -> DataFrame:
    """Any normalisation that an origin (csv, monothematic, bipartite) offers."""
    if kind not in OFFERED[origin]:
        raise ValueError(f"{kind} is not offered for {origin}: {', '.join(OFFERED[origin])}")
    run = normalise_components if kind in COMPONENT else normalise_cooccurrence if kind in COOCCURRENCE else normalise_bipartite
    return run(cells, kind, by)


def five_numbers(cells: DataFrame) -> DataFrame:
    """min, the sorted values at floor(n q) for the quartiles, and max of each component; no interpolation.

    Ranks are found by refined histograms, so a component's values are never sorted; NaN and null don't count."""
    found = at_ranks(cells, "value", {name: F.floor(F.col("n") * q) for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}, ["component"])
    return found.select("component", "lo", "q1", "median", "q3", "hi")


def component_statistics(cells: DataFrame) -> DataFrame:
    return cells.groupBy("component").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"))


def preview(wide: DataFrame, order: str, rows: int = 5, columns: int = 10) -> DataFrame:
    """The first rows in a given order, of the first components."""
    return wide.orderBy(order).limit(rows).select(*wide.columns[: columns + 1])


def page(components: list[str], number: int, size: int = 9) -> list[str]:
    return components[number * size : (number + 1) * size]


def colour_domain(cells: DataFrame) -> DataFrame:
    """Values at floor(.02 n) and floor(.98 n) of each component, its extremes if those are equal; NaN and null don't
    count."""
    found = at_ranks(cells, "value", {name: F.floor(F.col("n") * q) for name, q in (("a", 0.02), ("b", 0.98))}, ["component"])
    same = F.col("a") == F.col("b")
    return found.select("component", F.when(same, F.col("lo")).otherwise(F.col("a")).alias("low"), F.when(same, F.col("hi")).otherwise(F.col("b")).alias("high"))
