"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014).

Each half-round is a grouped minimum, aggregated before the shuffle, joined back to the edges; every round
is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflux.llm.common import Staging


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with b < a in, each node's farther neighbours linked to its nearest minimum out."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, stage: Staging, name: str) -> DataFrame:
    """(id, component) of every id on an edge (a, b); the component is the smallest id reachable."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark, turn = stage.table(edges, f"{name}0"), None, 0
    while True:
        # settled once no edge changes: then every node hangs on its component's smallest id
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark or not seen[0]:
            break
        mark, turn = seen, turn + 1
        after = stage.table(_star(_star(now, True), False), f"{name}{turn}")
        stage.drop(f"{name}{turn - 1}")
        now = after
    ends = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
