"""Approximate nearest neighbours by inner product: a forest of random-projection trees searched through one
priority queue for all trees, then exact reranking of the leaves' vectors.

Trees are fitted on at most ``SAMPLE`` distinct vectors (by hash of their ids) and index every vector. A query
takes leaves in order of how likely one of its neighbours lies in them, over all trees: a neighbour's
projection on a node's direction is taken as a multiple of the query's own with a normal error, and a
node's log probability is the sum of those of the sides on the way to it. Margins are computed on that way.

How many leaves a query takes is measured, not set: ``CALIBRATION`` queries are compared with all vectors, and
the budget is that which would have found ``RECALL`` of their neighbours. So vectors in clusters cost little,
and those that fill all dimensions evenly as much as they need.

Equal vectors are indexed once, with their smallest ids: no more than ``k`` + 1 of them can be among a
query's ``k`` nearest. Leaves side by side in a tree are packed into blocks of about ``BLOCK_ROWS`` vectors; a
larger leaf is split over several blocks, which a query that takes the leaf visits all. A group has one block
and of at most about ``TASK_QUERIES`` queries those that take one of its leaves; each leaf's vectors are
multiplied with the queries that took that leaf only, and each query's ``k`` + 1 best of the block go on.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do
those of another length than most (the longer, if two lengths tie), as they have no inner product with
the others; rows repeated are candidates each, and queries each, only a query's own row is none; equal
scores go to the smaller id; extra columns are ignored; with fewer candidates than ``k`` all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartoflux.llm.common import Staging

TREES, RECALL, LEAF_ROWS, SAMPLE, BLOCK_ROWS = 12, 0.96, 96, 50_000, 65_536
#: Queries that are compared with all vectors to measure what the others need.
CALIBRATION = 96
#: Queries that meet a leaf at a time, and a block in one task; a block goes to a task for each so many.
CHUNK_QUERIES, TASK_QUERIES = 4_096, 65_536
_HALF = math.sqrt(0.5)


def _log_side(x: float) -> float:
    """Log probability that a normal deviate is below x."""
    return math.log(max(0.5 * math.erfc(-x * _HALF), 1e-300))


_log_sides = np.vectorize(_log_side, otypes=[float])


class Forest:
    """Trees of one depth; a leaf's number counts through all trees."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth, self.trees, self.leaves = depth, trees, 1 << depth
        inner, width = self.leaves - 1, sample.shape[1]
        self.directions = np.zeros((trees, inner, width))
        self.cuts = np.zeros((trees, inner))
        #: A neighbour's projection is this multiple of the query's own, with this error.
        self.alike, self.error = 1.0, 1.0
        for tree in range(trees):
            members = [np.arange(len(sample))]
            for level in range(depth):
                halves = []
                for node, own in enumerate(members, start=(1 << level) - 1):
                    tried = rng.normal(size=(4, width))
                    tried /= np.linalg.norm(tried, axis=1, keepdims=True)
                    lean = sample[own] @ tried.T
                    best = int(lean.std(axis=0).argmax()) if len(own) else 0  # the direction that spreads them most
                    lean = lean[:, best]
                    self.directions[tree, node] = tried[best]
                    self.cuts[tree, node] = np.median(lean) if len(own) else 0.0
                    high = lean >= self.cuts[tree, node]
                    halves += [own[~high], own[high]]
                members = halves

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(vectors), self.trees), np.int64)
        for tree in range(self.trees):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                lean = np.einsum("ij,ij->i", vectors, self.directions[tree, node])
                node = 2 * node + 1 + (lean >= self.cuts[tree, node])
            out[:, tree] = node - (self.leaves - 1) + tree * self.leaves
        return out

    def learn(self, queries: np.ndarray, neighbours: np.ndarray) -> None:
        """The regression of neighbours' projections on those of their queries, over all directions."""
        directions = self.directions.reshape(-1, queries.shape[1])[:4096]
        x, y = (queries @ directions.T).ravel(), (neighbours @ directions.T).ravel()
        square = float(x @ x)
        if square:
            self.alike = float(x @ y) / square
            self.error = max(float(np.std(y - self.alike * x)), 1e-9)

    def ranks(self, queries: np.ndarray, of: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """For each row of leaves: which place the first of them would take in the search of query ``of``."""
        margins = (self.alike * np.einsum("qd,tnd->qtn", queries, self.directions, optimize=True) - self.cuts) / self.error
        low, high = _log_sides(-margins), _log_sides(margins)
        scores = np.zeros((len(queries), self.trees, 1))
        for level in range(self.depth):
            at = slice((1 << level) - 1, (2 << level) - 1)
            scores = np.stack([scores + low[:, :, at], scores + high[:, :, at]], axis=3).reshape(len(queries), self.trees, -1)
        scores = scores.reshape(len(queries), -1)
        best = scores[of[:, None], leaves].max(axis=1)
        return np.array([(scores[q] > b).sum() + 1 for q, b in zip(of.tolist(), best.tolist(), strict=True)])

    def search(self, vector: np.ndarray, budget: int) -> list[int]:
        """Best-first: of all trees' open nodes the most likely one is next."""
        inner, leaves = self.leaves - 1, self.leaves
        directions, cuts, alike, error = self.directions, self.cuts, self.alike, self.error
        queue = [(0.0, tree, 0) for tree in range(self.trees)]
        taken: list[int] = []
        while queue and len(taken) < budget:
            cost, tree, node = heapq.heappop(queue)
            while node < inner:
                m = (alike * float(directions[tree, node] @ vector) - cuts[tree, node]) / error
                near, far = (2 * node + 2, 2 * node + 1) if m >= 0 else (2 * node + 1, 2 * node + 2)
                m = abs(m)
                heapq.heappush(queue, (cost - _log_side(-m), tree, far))
                cost -= _log_side(m)
                node = near
                if queue[0][0] < cost:
                    break
            if node >= inner:
                taken.append(node - inner + tree * leaves)
            else:
                heapq.heappush(queue, (cost, tree, node))
        return taken


def _matrix(column) -> np.ndarray:
    """An Arrow list column without nulls, all of one length, as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _best_of_all(queries: np.ndarray, k: int):
    """The k best vectors of a task for each of a few queries."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            if not len(batch):
                continue
            vectors, vids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            for found, scores in zip(best, queries @ vectors.T, strict=True):
                at = np.argpartition(-scores, k - 1)[:k] if len(scores) > k else np.arange(len(scores))
                found += [(float(scores[i]), int(vids[i]), vectors[i].tolist()) for i in at.tolist()]
                found.sort(key=lambda x: (-x[0], x[1]))
                del found[k:]
        rows = [(q, *hit) for q, found in enumerate(best) for hit in found]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        kinds = [pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["q", "score", "vid", "vector"])

    return compare


def _calibrated(distinct: DataFrame, asked: DataFrame, forest: Forest, k: int, recall: float, calibration: int) -> int:
    """How many leaves queries take; teaches the forest how alike neighbours are."""
    every = forest.trees * forest.leaves
    some = asked.dropDuplicates(["vid"]).orderBy(F.xxhash64("vid"), "vid").limit(calibration).select("vid", "vector").toArrow()
    if recall >= 1 or not len(some) or not forest.depth:
        return every
    queries = _matrix(some.column("vector"))
    found = distinct.select("vid", "vector").mapInArrow(_best_of_all(queries, k + 1), "q long, score double, vid long, vector array<double>")
    w = W.partitionBy("q").orderBy(F.desc("score"), "vid")
    found = found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k + 1).toArrow()  # calibration x (k + 1)
    of = found.column("q").to_numpy()
    other = found.column("vid").to_numpy() != some.column("vid").to_numpy()[of]
    if not other.any():
        return every
    of, near = of[other], _matrix(found.column("vector"))[other]
    forest.learn(queries[of], near)
    ranks = forest.ranks(queries, of, forest.route(near))
    return int(np.sort(ranks)[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)])


def _leaves(shared):
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = shared.value.route(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.list_(pa.int64())), *batch.columns], names=["leaves", "vid", "vector"])

    return leaves


def _visits(shared, blocks, budget: int):
    """For each query the blocks that hold a leaf it takes, with those leaves."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, splits = blocks.value
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                rows, numbers, taken = [], [], []
                for i, vector in enumerate(_matrix(part.column(1))):
                    of: dict[int, list[int]] = {}
                    for leaf in shared.value.search(vector, budget):
                        for block in range(first[leaf], first[leaf] + splits[leaf]):
                            of.setdefault(block, []).append(leaf)
                    rows += [i] * len(of)
                    numbers += of.keys()
                    taken += of.values()
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers, pa.int64()), part.column(0).take(rows), part.column(1).take(rows), pa.array(taken, pa.list_(pa.int64()))],
                    names=["block", "qvid", "vector", "leaves"],
                )

    return visits


_FOUND = "qvid long, vid long, score double"


def best_of_leaves(leaf: np.ndarray, vid: np.ndarray, vectors: np.ndarray, queries: np.ndarray, taken: list[list[int]], k: int) -> tuple[np.ndarray, ...]:
    """(query row, vid, score) of each query's k best vectors of the leaves that it takes; leaf is sorted."""
    scores = np.full((len(queries), k), -np.inf)
    best = np.full((len(queries), k), -1)
    pairs = np.array([(x, q) for q, leaves in enumerate(taken) for x in leaves], np.int64).reshape(-1, 2)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    cuts = [0, *(np.flatnonzero(np.diff(pairs[:, 0])) + 1).tolist(), len(pairs)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        low, high = np.searchsorted(leaf, [pairs[a, 0], pairs[a, 0] + 1]) if b > a else (0, 0)
        for at in range(a, b, CHUNK_QUERIES):
            rows = pairs[at : min(at + CHUNK_QUERIES, b), 1]
            for start in range(low, high, 2048):  # bounds what is held of a large leaf
                own = queries[rows] @ vectors[start : min(start + 2048, high)].T
                better = own.max(axis=1) >= scores[rows, -1]
                some, own = rows[better], own[better]
                both = np.concatenate([scores[some], own], axis=1)
                which = np.concatenate([best[some], np.broadcast_to(vid[start : start + own.shape[1]], own.shape)], axis=1)
                order = np.argsort(-both, axis=1, kind="stable")[:, :k]  # vid rises within a leaf, so of equals the smaller stays
                scores[some], best[some] = np.take_along_axis(both, order, 1), np.take_along_axis(which, order, 1)
    rows, at = np.nonzero(best >= 0)
    return rows, best[rows, at], scores[rows, at]


def _scorer(k: int):
    def score(index: pa.Table, queries: pa.Table) -> pa.Table:
        """Each query's k + 1 best vectors of the leaves that it takes in this block."""
        kinds, names = [pa.int64(), pa.int64(), pa.float64()], ["qvid", "vid", "score"]
        if not len(index) or not len(queries):
            return pa.table([pa.array([], t) for t in kinds], names=names)
        index = index.sort_by([("leaf", "ascending"), ("vid", "ascending")])
        rows, vid, found = best_of_leaves(
            index.column("leaf").to_numpy(), index.column("vid").to_numpy(), _matrix(index.column("vector")), _matrix(queries.column("vector")), queries.column("leaves").to_pylist(), k + 1
        )
        return pa.table([pa.array(queries.column("qvid").to_numpy()[rows]), pa.array(vid), pa.array(found)], names=names)

    return score


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, trees: int = TREES, recall: float = RECALL, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, calibration: int = CALIBRATION
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest among vectors (vec_id, embedding).

    ``queries`` are rows of ``vectors``; a query is no candidate for itself. ``recall`` 1 compares all.
    """
    spark = vectors.sparkSession
    stage = Staging(spark, "ann")

    def sound(df: DataFrame) -> DataFrame:
        ok = "vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
        return df.select(F.col("vec_id").cast("long"), "embedding").filter(ok).filter("exists(embedding, x -> x <> 0)")

    own = sound(vectors)
    widths = own.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = widths["width"] if widths else 1
    own = own.filter(F.size("embedding") == width)
    # equal vectors are one, with their k + 1 smallest ids, repeated ones as often as there are rows
    ranked = own.withColumn("rn", F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("rn") <= k + 1)
    distinct = ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # vid numbers the vectors in order of their smallest ids, as an id may be that of several
    distinct = distinct.select(F.element_at("ids", 1).alias("first"), F.col("embedding").alias("vector"), "ids").orderBy("first", "vector")
    distinct = stage.table(distinct.withColumn("vid", F.monotonically_increasing_id()), "distinct")

    asked = sound(queries).filter(F.size("embedding") == width).select(F.col("vec_id").alias("query_id"), "embedding")
    asked = asked.join(distinct.select("vid", "vector"), F.col("embedding") == F.col("vector")).select("query_id", "vid", "vector")
    asked = stage.table(asked, "asked")

    count = distinct.count()
    fitted = distinct.orderBy(F.xxhash64("first"), "vid").limit(sample).select("vector").toArrow()
    points = _matrix(fitted.column("vector")) if len(fitted) else np.empty((0, width))
    depth = max(0, min(round(np.log2(max(1, count) / leaf_rows)), int(np.log2(max(1, len(points)) / 16)) if len(points) else 0))
    forest = Forest(points, trees, depth)
    budget = _calibrated(distinct, asked, forest, k, recall, calibration)
    shared = spark.sparkContext.broadcast(forest)

    routed = distinct.select("vid", "vector").mapInArrow(_leaves(shared), "leaves array<long>, vid long, vector array<float>")
    routed = stage.table(routed, "routed")
    index = routed.select(F.explode("leaves").alias("leaf"), "vid", "vector")
    sizes = {r["leaf"]: r["count"] for r in routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()}  # as many as the forest has leaves
    first, splits, block, filled = {}, {}, 0, 0
    for leaf in range(trees << depth):
        n = sizes.get(leaf, 0)
        if filled and (filled + n > BLOCK_ROWS or leaf % (1 << depth) == 0):  # a block holds no vector twice
            block, filled = block + 1, 0
        first[leaf], splits[leaf] = block, max(1, -(-n // BLOCK_ROWS))
        filled += n
        if splits[leaf] > 1:
            block, filled = block + splits[leaf], 0
    blocks = spark.sparkContext.broadcast((first, splits))
    where = spark.createDataFrame([(leaf, first[leaf], splits[leaf]) for leaf in first], "leaf long, block long, splits long")
    placed = index.join(F.broadcast(where), "leaf").withColumn("block", F.col("block") + F.pmod(F.xxhash64("vid"), F.col("splits"))).drop("splits")

    visits = asked.select(F.col("vid").alias("qvid"), "vector").dropDuplicates(["qvid"])
    asked_n = asked.count()
    tasks = max(1, min(10_000, -(-asked_n // 256)))
    visits = visits.repartition(tasks, "qvid").mapInArrow(_visits(shared, blocks, budget), "block long, qvid long, vector array<float>, leaves array<long>")
    chunks = max(1, -(-asked_n // TASK_QUERIES))
    placed = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    visits = visits.withColumn("chunk", F.pmod(F.xxhash64("qvid"), F.lit(chunks)).cast("int"))
    found = placed.groupBy("block", "chunk").cogroup(visits.groupBy("block", "chunk")).applyInArrow(_scorer(k), _FOUND)
    # one vector may come from several trees
    found = found.groupBy("qvid", "vid").agg(F.max("score").alias("score"))
    best = found.withColumn("rn", F.row_number().over(W.partitionBy("qvid").orderBy(F.desc("score"), "vid"))).filter(F.col("rn") <= k + 1)
    best = best.join(distinct.select("vid", "ids"), "vid").select("qvid", "score", "vid", F.explode("ids").alias("vec_id"))
    best = best.withColumn("rn", F.row_number().over(W.partitionBy("qvid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rn") <= k + 1)
    best = best.groupBy("qvid").agg(F.sort_array(F.collect_list(F.struct("rn", "vec_id", "score", "vid"))).alias("best"))
    # the query's own row goes: the first of its id and its vector
    mine = F.expr(f"slice(filter(best, (x, i) -> i + 1 <> coalesce(array_position(transform(best, y -> y.vec_id = query_id AND y.vid = qvid), true), 0)), 1, {k})")
    return (
        asked.select("query_id", F.col("vid").alias("qvid"))
        .join(best, "qvid")
        .select("query_id", F.posexplode(mine).alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
    )


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)
