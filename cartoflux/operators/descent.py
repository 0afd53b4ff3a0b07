"""An approximate neighbour graph by descent (Dong et al. 2011): neighbours of neighbours are likely neighbours.

The graph starts from groups of points that random hyperplanes leave together. In each round every point brings its
neighbours, and the points it is a neighbour of, together in one row; pairs of these that have not met before are
compared, and each keeps its nearest. The work of a round is a few joins on ids and grows with the points, where exact
neighbours compare all pairs. What a point brings together is capped, by rank of distance: hubs and points that lie on
each other stay small.

Vectors go to each point that brings them, some sixty times, so a round takes the points in slices: what a slice shuffles
is gone before the next one comes, and what it found is merged once it is as much as the graph. A graph that has been
followed is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartoflux.functions.arrays import matrix
from cartoflux.llm.common import Staging

#: Points that the start compares with each other, and how often they are grouped anew.
GROUP, TABLES = 128, 3
#: Rounds at most, and the share of changed neighbours at which they end.
ROUNDS, SETTLED = 12, 0.002
#: Bytes that a slice shuffles, about; points whose edges are merged in one group.
SLICE, MERGED = 1 << 30, 1024

_EDGE = "id long, neighbour long, distance double"
_KEPT = ("id", "neighbour", "distance", "fresh")


def _edges(ids: np.ndarray, others: np.ndarray, distances: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(distances, pa.float64())], names=["id", "neighbour", "distance"])


def _distances(x: np.ndarray) -> np.ndarray:
    """Between all rows, from their differences: products would lose what near points differ by."""
    return np.sqrt(np.stack([((row - x) ** 2).sum(axis=1) for row in x]))


def start(points: DataFrame, width: int, n: int, seed: int = 42) -> Iterator[DataFrame]:
    """(id, neighbour, distance): each point's nearest among those on the same side of random hyperplanes through the
    points' mean, for a few sets of planes, one after the other. Large groups are cut by a hash of the id."""
    size = len(points.first()["features"])
    depth = max(0, int(np.ceil(np.log2(max(1, n) / GROUP))))
    middle = points.select(F.posexplode("features").alias("d", "v")).groupBy("d").agg(F.avg("v").alias("m")).collect()  # as many as components
    mean = np.zeros(size)
    for r in middle:
        mean[r["d"]] = r["m"]
    planes = np.random.default_rng(seed).normal(size=(size, TABLES * depth))
    shared = points.sparkSession.sparkContext.broadcast((mean, planes))

    def nearest(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        d = _distances(matrix(group.column("features"), size))
        d[ids[:, None] == ids[None]] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :width]
        found = np.take_along_axis(d, near, 1)
        rows, at = np.nonzero(np.isfinite(found))
        return pa.Table.from_batches([_edges(ids[rows], ids[near[rows, at]], found[rows, at])])

    for side in range(TABLES):
        own = slice(side * depth, (side + 1) * depth)

        def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mean, planes = shared.value
            for batch in batches:
                above = (matrix(batch.column(1), size) - mean) @ planes[:, own] > 0
                codes = (above * (1 << np.arange(depth))).sum(axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], names=["id", "features", "code"])

        coded = points.mapInArrow(sides, f"id long, features {points.schema['features'].dataType.simpleString()}, code long")
        parts = coded.groupBy("code").agg(F.ceil(F.count("*") / (2 * GROUP)).alias("parts"))
        grouped = coded.join(parts, "code").withColumn("part", F.pmod(F.xxhash64("id", F.lit(side)), F.col("parts")))
        yield grouped.groupBy("code", "part").applyInArrow(nearest, _EDGE)


def _kept(edges: DataFrame, width: int, n: int) -> DataFrame:
    """(id, neighbour, distance, fresh, rank): each point's nearest, of equals the smaller ids; an edge that was there
    before is not fresh. Edges go in packets of MERGED points, so they are shuffled once and as columns."""
    packets = max(1, -(-n // MERGED))
    types = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            packet = ((columns[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(packets)).astype(np.int64)
            order = np.argsort(packet, kind="stable")
            first = np.flatnonzero(np.diff(packet[order], prepend=-1))
            ends = pa.array(np.append(first, len(order)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(c[order], t)) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(packet[order][first], pa.int64()), *lists], names=["packet", *_KEPT])

    def nearest(table: pa.Table) -> pa.Table:
        ids, others, d, fresh = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in _KEPT)
        order = np.lexsort((fresh, d, others, ids))
        ids, others, d, fresh = ids[order], others[order], d[order], fresh[order]
        once = np.append(True, (ids[1:] != ids[:-1]) | (others[1:] != others[:-1]))
        ids, others, d, fresh = ids[once], others[once], d[once], fresh[once]
        order = np.lexsort((others, d, ids))
        ids, others, d, fresh = ids[order], others[order], d[order], fresh[order]
        rank = np.arange(len(ids)) - np.searchsorted(ids, ids, "left") + 1
        kept = rank <= width
        return pa.table([ids[kept], others[kept], d[kept], fresh[kept], rank[kept].astype(np.int32)], names=[*_KEPT, "rank"])

    lists = ", ".join(f"{c} array<{t}>" for c, t in zip(_KEPT, ("long", "long", "double", "boolean"), strict=True))
    return edges.select(*_KEPT).mapInArrow(packed, f"packet long, {lists}").groupBy("packet").applyInArrow(nearest, f"{_EDGE}, fresh boolean, rank int")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of points met (id, radius, fresh, features): the pairs nearer than one of the two has its neighbours, if
    either is fresh to the point that brings them together."""
    for batch in batches:
        out: list[tuple[np.ndarray, ...]] = []
        for met in batch.column(0):
            ids, radius, fresh, features = (met.values.field(i) for i in range(4))
            if len(ids) < 2:
                continue
            ids, radius, fresh = ids.to_numpy(), radius.to_numpy(), fresh.to_numpy(zero_copy_only=False)
            d = _distances(matrix(features, len(features[0])))
            meets = (fresh[:, None] | fresh[None]) & (ids[:, None] != ids[None]) & (d < radius[:, None])
            a, b = np.nonzero(meets)
            out.append((ids[a], ids[b], d[a, b]))
        if out:
            yield _edges(*(np.concatenate(c) for c in zip(*out, strict=True)))


def _reached(points: DataFrame, graph: DataFrame, width: int) -> DataFrame:
    """(met, features, radius): the points, and within what distance a neighbour is new to each."""
    reach = graph.groupBy("id").agg(F.when(F.count("*") >= width, F.max("distance")).otherwise(float("inf")).alias("radius"))
    return points.join(reach, "id", "left").select(F.col("id").alias("met"), "features", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))


def _found(known: DataFrame, graph: DataFrame, width: int, slices: int, own: int) -> DataFrame:
    """(id, neighbour, distance, fresh) of the pairs that the points of one slice bring together."""
    here = F.pmod(F.xxhash64("via"), F.lit(slices)) == own
    there = graph.select(F.col("id").alias("via"), F.col("neighbour").alias("met"), "fresh").filter(here)
    back = graph.select(F.col("neighbour").alias("via"), F.col("id").alias("met"), "fresh", "distance").filter(here)
    back = back.withColumn("rank", F.row_number().over(W.partitionBy("via").orderBy(F.desc("fresh"), "distance", "met"))).filter(F.col("rank") <= width)
    brought = there.union(back.select("via", "met", "fresh")).groupBy("via", "met").agg(F.bool_or("fresh").alias("fresh"))
    rows = brought.join(known, "met").groupBy("via").agg(F.collect_list(F.struct("met", "radius", "fresh", "features")).alias("all"))
    return rows.select("all").mapInArrow(_meetings, _EDGE).withColumn("fresh", F.lit(True))


def descend(points: DataFrame, graph: DataFrame, width: int, n: int, stage: Staging, turn: int) -> tuple[DataFrame, str]:
    """One round: a graph (id, neighbour, distance, fresh, rank) that has what neighbours' neighbours add, and its name."""
    cell = 4 if points.schema["features"].dataType.elementType.simpleString() == "float" else 8
    slices = max(1, -(-n * 2 * width * (cell * len(points.first()["features"]) + 60) // SLICE))
    now, made, waiting, rows = graph.withColumn("fresh", F.lit(False)), 0, {}, 0
    if slices == 1:
        edges = now.select(*_KEPT).unionByName(_found(_reached(points, graph, width), graph, width, 1, 0))
        return stage.table(_kept(edges, width, n), f"graph{turn}.1"), f"graph{turn}.1"
    known = stage.table(_reached(points, graph, width), f"known{turn}.0")
    for own in range(slices):
        name = f"found{turn}.{own}"
        waiting[name] = stage.table(_found(known, graph, width, slices, own), name)
        rows += waiting[name].count()
        if rows < n * width and own + 1 < slices:
            continue
        edges = now.select(*_KEPT)
        for found in waiting.values():
            edges = edges.unionByName(found)
        now = stage.table(_kept(edges, width, n), f"graph{turn}.{made + 1}")
        stage.drop(f"known{turn}.{made}", f"graph{turn}.{made}", *waiting)
        made, waiting, rows = made + 1, {}, 0
        if own + 1 < slices:  # what is near enough is less from now on
            known = stage.table(_reached(points, now, width), f"known{turn}.{made}")
    return now, f"graph{turn}.{made}"


def approximate_knn(points: DataFrame, k: int, width: int | None = None, rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """(id, rank, neighbour, distance): about the k nearest others of each point; distances are exact.

    ``width`` neighbours are kept while the graph grows, by default three times k and 30 at least; more find more.
    """
    width = max(k, width or max(30, 3 * k))
    stage = Staging(points.sparkSession, "descent")
    points = points.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))
    if not points.take(1):
        return points.select("id", F.lit(1).alias("rank"), F.col("id").alias("neighbour"), F.lit(0.0).alias("distance"))
    # what single precision holds exactly is kept and shuffled in half the bytes
    single = F.forall("features", lambda v: v.cast("float").cast("double").eqNullSafe(v))
    n, short = points.agg(F.count("*"), F.bool_and(single)).first()
    points = stage.table(points.withColumn("features", F.col("features").cast("array<float>")) if short else points, "points")
    graph, name = None, ""
    for side, edges in enumerate(start(points, width, n, seed)):
        edges = edges.withColumn("fresh", F.lit(True))
        graph = stage.table(_kept(edges if graph is None else edges.unionByName(graph.select(*_KEPT)), width, n), f"start{side}")
        if side:
            stage.drop(name)
        name = f"start{side}"
    for turn in range(rounds):
        before = name
        graph, name = descend(points, graph, width, n, stage, turn)
        stage.drop(before)
        if graph.filter("fresh").count() <= SETTLED * n * width:
            break
    return graph.filter(F.col("rank") <= k).select("id", "rank", "neighbour", "distance")
