"""Exact neighbours, intrinsic dimension, projections and the maps drawn from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartoflux.functions.arrays import list_column, matrix
from cartoflux.functions.settle import settled
from cartoflux.operators.selection import percentiles
from cartoflux.operators.som import principal_axes

#: Points of a block; each task compares two blocks. A larger table has larger blocks: SPREAD of them keep all cores
#: busy, and from then on they grow up to LARGEST points, so that the copies of blocks stay few.
BLOCK, SPREAD, LARGEST = 2048, 8, 49_152
#: Rows and columns of the distances that are held at a time, so few that they stay in a core's cache.
TILE = 512
#: Rows and columns of a piece of products; pairs whose exact distances are taken at a time.
ROWS, COLUMNS, EXACT = 256, 8192, 1 << 14
#: Pairs that are held before they are cut to each row's nearest.
HELD = 1 << 22


def blocks_of(n: int, largest: int | None = None) -> int:
    return max(1, min(SPREAD, -(-n // BLOCK)), -(-n // (largest or LARGEST)))


def in_blocks(points: DataFrame, blocks: int, *columns: str) -> DataFrame:
    return points.select("id", "features", *columns, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))


def block_pairs(points: DataFrame, *columns: str, once: bool = False, own: bool = True, largest: int | None = None, n: int | None = None):
    """Points (id, features, further columns) in blocks, every block cogrouped with every other and itself; each
    two blocks in both orders, or ``once``, then without itself unless ``own``. Every pair of blocks is a task of its
    own: a pair is little to read but much to compare, so what deals tasks by their bytes, or pairs by their hash, would
    leave cores idle."""
    blocks = blocks_of(points.count() if n is None else n, largest)
    placed = in_blocks(points, blocks, *columns)
    apart = 0 if own else 1
    first, last = (placed, placed) if own else (placed.filter(f"block < {blocks - 1}"), placed.filter("block > 0"))
    later = F.explode(F.sequence(F.col("block") + apart if once else F.lit(0), F.lit(blocks - 1)))
    earlier = F.explode(F.sequence(F.lit(0), F.col("block") - apart if once else F.lit(blocks - 1)))
    sides = [F.col(c).alias(c) for c in ("id", "features", *columns)]  # columns of each side's own, so the two can be told apart
    left = first.select(*sides, F.col("block").alias("p"), later.alias("q"))
    right = last.select(*sides, F.col("block").alias("q"), earlier.alias("p"))
    if once:
        number, tasks = (f"q * (q + {1 - 2 * apart}) div 2 + p", blocks * (blocks + 1 - 2 * apart) // 2)
    else:
        number, tasks = f"p * {blocks} + q", blocks * blocks
    left, right = (side.withColumn("met", F.expr(number).cast("int")).repartitionById(tasks, "met") for side in (left, right))
    return left.groupBy("met").cogroup(right.groupBy("met"))


def exactly(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs (x[i], y[j]) from their differences."""
    out = np.empty(len(i))
    for at in range(0, len(i), EXACT):
        out[at : at + EXACT] = np.sqrt(((x[i[at : at + EXACT]] - y[j[at : at + EXACT]]) ** 2).sum(axis=1))
    return out


def apart(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row of x, first row of y, distances) of a tile at a time, from products; those so small that the
    products' rounding would show are taken from differences. A tile is gone when the next one comes."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    most, held = yy.max(initial=0), np.empty((TILE, TILE))
    rows = np.column_stack([-2 * x, xx, np.ones(len(x))])
    columns = np.ascontiguousarray(np.column_stack([y, np.ones(len(y)), yy]).T)
    for at in range(0, len(x), TILE):
        short = 1e-6 * (xx[at : at + TILE, None] + most)
        for column in range(0, len(y), TILE):
            a, b = rows[at : at + TILE], columns[:, column : column + TILE]
            d = np.matmul(a, b, out=held[: len(a), : b.shape[1]])
            if d.min() > short.max():
                np.sqrt(d, out=d)
            else:
                i, j = few_true(~(d > short))  # also what is no number
                np.sqrt(d, out=d, where=d > 0)
                d[i, j] = exactly(x, y, at + i, column + j)
            yield at, column, d


def few_true(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix that is false nearly everywhere: eight cells are looked at at once."""
    flat = np.ascontiguousarray(mask).ravel()
    whole = flat.size // 8 * 8
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate([at, np.arange(whole, flat.size)])
    return np.divmod(at[flat[at]], max(1, mask.shape[1]))


class Products:
    """Pairs of rows of x and y whose distance may be at most a bound: products of single precision sieve them, with
    room for their rounding, and exact distances are left to the caller. The rows of y are in order of ``ib``; pairs
    of equal ids are out, as is what is not finite."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ia: np.ndarray, ib: np.ndarray):
        self.count, width = len(y), x.shape[1]
        finite = np.isfinite(y).all(axis=1)
        middle = y[finite].mean(axis=0) if finite.any() else np.zeros(width)
        with np.errstate(all="ignore"):
            length = lambda m: np.sqrt((m * m).sum(axis=1))
            offset = np.nanmax([length(x)[np.isfinite(x).all(axis=1)].max(initial=0), length(y)[finite].max(initial=0)])
            x, y = x - middle, y - middle
            self.xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
            reach = np.sqrt(self.xx) + np.sqrt(yy[finite].max(initial=0))
            single = np.nanmax(reach[np.isfinite(reach)], initial=0) < 1e15 and offset < 1e15
            shift = 2.0**-48 * offset
            self.slack = (width + 8) * 2.0 ** (-23 if single else -48) * reach**2 + 2 * shift * reach + shift**2
            kind = np.float32 if single else np.float64
            yy[~finite] = np.nan
            self.x, self.y = np.column_stack([-2 * x, np.ones(len(x))]).astype(kind), np.column_stack([y, yy]).astype(kind)
        self.low, self.high, self.held = np.searchsorted(ib, ia, "left"), np.searchsorted(ib, ia, "right"), None

    def piece(self, at: int, column: int) -> np.ndarray:
        """Square distances less the square lengths of x, about, of a piece; pairs of equal ids are nan. A piece is gone
        when the next one comes."""
        x, y = self.x[at : at + ROWS], self.y[column : column + COLUMNS]
        if self.held is None or self.held.shape != (len(x), len(y)):
            self.held = np.empty((len(x), len(y)), x.dtype)
        with np.errstate(all="ignore"):
            a = np.matmul(x, y.T, out=self.held)
        low, high = self.low[at : at + ROWS], self.high[at : at + ROWS]
        for more in range(int((high - low).max(initial=0))):
            own = low + more
            rows = np.flatnonzero((own < high) & (own >= column) & (own < column + a.shape[1]))
            a[rows, own[rows] - column] = np.nan
        return a

    def below(self, at: int, column: int, a: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of x and y that a piece's pairs up to a bound on the distance have."""
        with np.errstate(all="ignore"):
            most = bound * bound - self.xx[at : at + ROWS] + self.slack[at : at + ROWS]
            i, j = few_true(a <= most.astype(a.dtype)[:, None])
        return at + i, column + j


    def below_either(self, at: int, column: int, a: np.ndarray, bound_x: np.ndarray, bound_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of pairs up to the bound of one of the two rows; the piece is used up."""
        own = slice(at, at + ROWS)
        with np.errstate(all="ignore"):
            most = bound_x[own] ** 2 - self.xx[own] + self.slack[own]
            mask = a <= most.astype(a.dtype)[:, None]
            other = (bound_y[column : column + COLUMNS] ** 2).astype(a.dtype)
            a += (self.xx[own] - self.slack[own]).astype(a.dtype)[:, None]
            mask |= a <= other * a.dtype.type(1 + 4 * np.finfo(a.dtype).eps)
            i, j = few_true(mask)
        return at + i, column + j


def least_of_sixteen(a: np.ndarray) -> np.ndarray:
    """The least of each sixteen cells of a row, nan aside: the k-th of these is no less than the k-th of all, and there
    are fewer to search."""
    width = a.shape[1] // 16
    return np.fmin.reduce(a[:, : 16 * width].reshape(len(a), 16, width), axis=1)


def nearest(x: np.ndarray, y: np.ndarray, ia: np.ndarray, ib: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the k rows of y nearest to each row of x, some rows at a time; y is in order of ``ib``, the
    ids, and of equal distances the smaller id goes first."""
    products = Products(x, y, ia, ib)
    for at in range(0, len(x), ROWS):
        bound = np.full(len(x[at : at + ROWS]), np.inf)
        i, j, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for column in range(0, len(y), COLUMNS):
            a = products.piece(at, column)
            if a.shape[1] > k and np.isinf(bound).any():  # the first piece's k-th: nothing beyond it is among the k
                least = least_of_sixteen(a)
                with np.errstate(all="ignore"):
                    kth = np.partition(least if least.shape[1] > 4 * k else a, k - 1, axis=1)[:, k - 1] + products.xx[at : at + ROWS] + products.slack[at : at + ROWS]
                    bound = np.minimum(bound, np.where(np.isnan(kth), np.inf, np.sqrt(np.maximum(kth, 0)) * (1 + 2.0**-50)))
            more_i, more_j = products.below(at, column, a, bound)
            found = exactly(x, y, more_i, more_j)
            sound = np.isfinite(found)
            i, j, d = np.concatenate([i, more_i[sound]]), np.concatenate([j, more_j[sound]]), np.concatenate([d, found[sound]])
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
            last = rank == k - 1
            bound[i[last] - at] = d[last]
            i, j, d = i[rank < k], j[rank < k], d[rank < k]
        yield i, j, d


def fewest(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each i the k pairs (i, j) of the least distance, of equal ones those of the least j."""
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
    return i[kept], j[kept], d[kept]


class Within:
    """Pairs (i, j, distance) that may be among the k nearest of i; cut to these where they become many."""

    def __init__(self, bound: np.ndarray, k: int):
        self.bound, self.k, self.held, self.parts = bound, k, 0, []

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray):
        near = (d <= self.bound[i]) & np.isfinite(d)
        self.parts.append((i[near], j[near], d[near]))
        self.held += int(near.sum())
        if self.held > HELD:
            self.parts = [self.take()]
            i, _, d = self.parts[0]
            last = np.flatnonzero(np.append(i[1:] != i[:-1], True))
            full = np.bincount(i, minlength=len(self.bound))[i[last]] == self.k
            self.bound[i[last[full]]] = np.minimum(self.bound[i[last[full]]], d[last[full]])
            self.held = len(i)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [np.concatenate(c) for c in zip(*self.parts, strict=True)] if self.parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        self.parts, self.held = [], 0
        return fewest(*found, self.k)


def nearest_across(x: np.ndarray, y: np.ndarray, bound_x: np.ndarray, bound_y: np.ndarray, k: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    """(whether from y to x, i, j, distance) of the rows of y that may be among the k nearest of each row of x, and of those
    of x for y: each product serves both. The rows are in order of their ids, x and y have none in common, and what
    is beyond a row's bound is not among its nearest."""
    none = np.zeros(0, np.int64)
    products = Products(x, y, none, none)
    bound_x, bound_y = bound_x.astype(float), bound_y.astype(float)
    back = Within(bound_y, k)
    for at in range(0, len(x), ROWS):
        there = Within(bound_x, k)
        for column in range(0, len(y), COLUMNS):
            a = products.piece(at, column)
            i, j = products.below_either(at, column, a, bound_x, bound_y)
            d = exactly(x, y, i, j)
            there.add(i, j, d)
            back.add(j, i, d)
        yield (False, *there.take())
    yield (True, *back.take())


def by_cosine(x: np.ndarray, y: np.ndarray, ia: np.ndarray, ib: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``nearest``, by one less the cosine."""
    x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
    for at in range(0, len(x), 64):
        d = 1 - x[at : at + 64] @ y.T
        d[ia[at : at + 64, None] == ib[None]] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(d, near, 1)
        rows, place = np.nonzero(np.isfinite(found))
        yield at + rows, near[rows, place], found[rows, place]


#: Points whose neighbours of all blocks are merged in one group.
MERGED = 4096


_PACKETS = "packet long, id array<long>, neighbour array<long>, distance array<double>"


def in_packets(packets: int, ids: np.ndarray, others: np.ndarray, d: np.ndarray) -> dict[str, pa.Array]:
    """Neighbours by the packet of their point."""
    packet = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(packets)).astype(np.int64)
    order = np.argsort(packet, kind="stable")
    ends = np.flatnonzero(np.diff(packet[order], prepend=-1, append=-1)) if len(order) else np.zeros(1, np.int64)
    types = (pa.int64(), pa.int64(), pa.float64())
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c[order], t)) for c, t in zip((ids, others, d), types, strict=True)]
    return dict(zip(("packet", "id", "neighbour", "distance"), (pa.array(packet[order][ends[:-1]], pa.int64()), *lists), strict=True))


def _joined(found: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def knn(points: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """(id, rank, neighbour, distance): each point's k nearest others, ties to the smaller id.

    Exact. Each block's points first find their k nearest of their own block, whose k-th bounds what another block can
    add; then every two blocks meet once in a task, and a product serves both sides. Only pairs that may be near enough
    have their distances taken. What is found goes on in packets of MERGED points.
    """
    n = points.count()
    packets = max(1, -(-n // MERGED))
    blocks = blocks_of(n)

    def own(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids = table.column("id").to_numpy()
        x = matrix(table.column("features"), len(table.column("features")[0]))
        i, j, d = _joined(list((nearest if metric != "cosine" else by_cosine)(x, x, ids, ids, k)))
        count = np.bincount(i, minlength=len(ids))
        ends = np.concatenate([[0], np.cumsum(count)])
        bound = np.full(len(ids), np.inf)
        bound[count == k] = d[ends[1:][count == k] - 1]
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c)) for c in (ids[j], d)]
        return table.select(["id", "features"]).append_column("bound", pa.array(bound)).append_column("neighbours", lists[0]).append_column("distances", lists[1])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.column(1).value_lengths().to_numpy()
            found = [batch.column(c).flatten().to_numpy() for c in (1, 2)]
            yield pa.RecordBatch.from_pydict(in_packets(packets, np.repeat(batch.column(0).to_numpy(), count), *found))

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if len(a) and len(b):
            a, b = a.sort_by("id"), b.sort_by("id")
            (ia, x, bound_x), (ib, y, bound_y) = ((t.column("id").to_numpy(), matrix(t.column("features"), len(t.column("features")[0])), t.column("bound").to_numpy()) for t in (a, b))
            if metric != "cosine":
                for back, i, j, d in nearest_across(x, y, bound_x, bound_y, k):
                    out.append((ib[i], ia[j], d) if back else (ia[i], ib[j], d))
            else:
                out += [(ia[i], ib[j], d) for i, j, d in by_cosine(x, y, ia, ib, k)] + [(ib[i], ia[j], d) for i, j, d in by_cosine(y, x, ib, ia, k)]
        return pa.table(in_packets(packets, *_joined(out)))

    def merge(table: pa.Table) -> pa.Table:
        ids, others, d = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("id", "neighbour", "distance"))
        order = np.lexsort((others, d, ids))
        ids, others, d = ids[order], others[order], d[order]
        rank = np.arange(len(ids)) - np.searchsorted(ids, ids, "left") + 1
        kept = rank <= k
        return pa.table([ids[kept], rank[kept].astype(np.int32), others[kept], d[kept]], names=["id", "rank", "neighbour", "distance"])

    placed = in_blocks(points.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features")), blocks)
    found = placed.repartitionById(blocks, "block").groupBy("block").applyInArrow(own, "id long, features array<double>, bound double, neighbours array<long>, distances array<double>")
    found = settled(found) if blocks > 1 else found
    near = found.select("id", "neighbours", "distances").mapInArrow(listed, _PACKETS)
    if blocks > 1:
        near = near.unionByName(block_pairs(found, "bound", once=True, own=False, n=n).applyInArrow(pair, _PACKETS))
    return near.groupBy("packet").applyInArrow(merge, "id long, rank int, neighbour long, distance double")


def pointwise_mle(near: DataFrame, k: int) -> DataFrame:
    """(id, d): Levina and Bickel's estimate at each point, from its k neighbours' distances."""
    w = W.partitionBy("id")
    far = F.max(F.when(F.col("rank") == k, F.col("distance"))).over(w)
    terms = near.filter("distance > 0").withColumn("far", far).filter(F.col("rank") < k)
    found = terms.groupBy("id").agg(F.sum(F.ln(F.col("far") / F.col("distance"))).alias("s"), F.count("*").alias("n"))
    return found.filter("s > 0").select("id", (F.col("n") / F.col("s")).alias("d"))


def ceiling_dimension(pointwise: DataFrame) -> DataFrame:
    """One row: interpolated percentiles, max and mean of pointwise estimates; p95 is the estimate."""
    pointwise = settled(pointwise)
    found = percentiles(pointwise, "d", {"p50": 0.5, "p90": 0.9, "p95": 0.95})
    return pointwise.agg(F.avg("d").alias("mean")).join(found, F.lit(True), "left").select("p50", "p90", "p95", F.col("hi").alias("largest"), "mean")


def two_nn(near: DataFrame, discard: float = 0.1) -> DataFrame:
    """One row (Facco et al. 2017): slope through the origin of -ln(1 - F) on ln(T2 / T1), without the top tenth."""
    pair = near.filter("rank <= 2").groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("t1"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("t2"))
    # a global rank: numbers within ranges of mu, plus those of the ranges before
    mu = settled(pair.filter("t1 > 0 AND t2 IS NOT NULL").select("id", (F.col("t2") / F.col("t1")).alias("mu")))
    ranked = _ranked(mu, "mu", "id")
    x, y = F.ln("mu"), -F.ln(1 - F.col("rn") / F.col("n"))
    kept = ranked.filter(F.col("rn") <= F.floor(F.col("n") * (1 - discard))).select(x.alias("x"), y.alias("y"))
    return kept.agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))).alias("dimension"))


def _ranked(rows: DataFrame, by: str, then: str) -> DataFrame:
    """Adds rn (from 1) and n over all rows: ranks within bins of equal width, plus the bins before."""
    span = rows.agg(F.min(by).alias("lo"), F.max(by).alias("hi"), F.count("*").alias("n"))
    binned = rows.join(F.broadcast(span), F.lit(True)).withColumn("bin", F.floor(F.coalesce(F.try_divide((F.ln(by) - F.ln("lo")) * 1024, F.ln("hi") - F.ln("lo")), F.lit(0.0))))
    before = binned.groupBy("bin").count().withColumn("before", F.sum("count").over(W.orderBy("bin")) - F.col("count")).select("bin", "before")
    w = W.partitionBy("bin").orderBy(by, then)
    return binned.join(F.broadcast(before), "bin").withColumn("rn", F.row_number().over(w) + F.col("before"))


def method_of_moments(near: DataFrame, k: int) -> DataFrame:
    """(id, d): m / (T_k - m) with m the mean distance."""
    found = near.groupBy("id").agg(F.avg("distance").alias("m"), F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("far"))
    return found.select("id", F.try_divide(F.col("m"), F.col("far") - F.col("m")).alias("d")).filter("d IS NOT NULL")


def mada(near: DataFrame, k: int) -> DataFrame:
    """(id, d): ln 2 / ln(T_k / T_ceil(k / 2))."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("distance")))
    found = near.groupBy("id").agg(at(k).alias("far"), at(-(-k // 2)).alias("half")).filter("half > 0 AND far > half")
    return found.select("id", (math.log(2) / F.ln(F.col("far") / F.col("half"))).alias("d"))


def correlation_dimension(points: DataFrame, near: DataFrame, k1: int, k2: int) -> DataFrame:
    """One row: slope of ln C between the median distances of two neighbour ranks, C(r) being the share of all
    pairs closer than r; each task of two blocks counts its own pairs."""
    medians = {r["rank"]: r["median"] for r in percentiles(near.filter(F.col("rank").isin(k1, k2)), "distance", {"median": 0.5}, ["rank"]).collect()}
    r1, r2 = medians.get(k1), medians.get(k2)
    radii = [r or 0.0 for r in (r1, r2)]

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        counts = [0, 0]
        if len(a) and len(b):
            b = b.sort_by("id")
            width = len(a.column("features")[0])
            twice = 1 if a.column("p")[0] == a.column("q")[0] else 2
            x, y = matrix(a.column("features"), width), matrix(b.column("features"), width)
            products = Products(x, y, a.column("id").to_numpy(), b.column("id").to_numpy())
            for at in range(0, len(x), ROWS):
                for column in range(0, len(y), COLUMNS):
                    piece = products.piece(at, column)
                    d = exactly(x, y, *products.below(at, column, piece, np.full(len(piece), max(radii))))
                    counts = [c + twice * int((d < r).sum()) for c, r in zip(counts, radii, strict=True)]
        return pa.table([pa.array([c], pa.int64()) for c in counts], names=["c1", "c2"])

    met = block_pairs(points, once=True).applyInArrow(pair, "c1 long, c2 long")
    both = met.agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    spread = F.ln(F.try_divide(F.lit(r2).cast("double"), F.lit(r1).cast("double")))
    return both.select(F.try_divide(F.ln(F.try_divide("c2", "c1")), spread).alias("dimension"))


def mind_ml(near: DataFrame, k: int, most: int = 64) -> DataFrame:
    """One row: the whole number d that maximises the likelihood of T_1 / T_{k+1} (Rozza et al. 2012)."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("distance")))
    rho = near.groupBy("id").agg(at(1).alias("a"), at(k + 1).alias("b")).filter("a > 0 AND b > a").select((F.col("a") / F.col("b")).alias("rho"))
    tried = rho.select("rho", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("d"))
    value = F.ln(F.lit(float(k)) * F.col("d")) + (F.col("d") - 1) * F.ln("rho") + (k - 1) * F.ln(1 - F.pow("rho", "d"))
    scored = tried.groupBy("d").agg(F.sum(value).alias("likelihood"))
    return scored.agg(F.max_by("d", F.struct("likelihood", -F.col("d"))).cast("double").alias("dimension"))


def local_pca(points: DataFrame, share: float = 0.05) -> float:
    """Covariance eigenvalues above a share of the largest."""
    _, values, _ = principal_axes(points, len(points.first()["features"]))
    return float((values > share * values[0]).sum()) if values[0] > 0 else 0.0


ESTIMATORS = ("CorrInt", "DANCo", "ESS", "FisherS", "KNN", "lPCA", "MADA", "MiND_ML", "MLE", "MOM", "TLE", "TwoNN")


def estimate_dimension(points: DataFrame, name: str, k: int = 20) -> float:
    """One estimate by name, with k neighbours where it looks at any; unknown names are an error."""
    from cartoflux.operators import dimension

    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name}; one of {', '.join(ESTIMATORS)}")
    if name == "lPCA":
        return local_pca(points)
    if name == "FisherS":
        return dimension.fisher_separability(points).first()[0]
    if name == "KNN":
        return dimension.graph_dimension(points, k).first()[0]
    near = knn(points, k + 1).persist()
    upto = near.filter(F.col("rank") <= k)
    found = {
        "MLE": lambda: pointwise_mle(upto, k).agg(F.avg("d")),
        "MOM": lambda: method_of_moments(upto, k).agg(F.avg("d")),
        "MADA": lambda: mada(upto, k).agg(F.avg("d")),
        "TwoNN": lambda: two_nn(near),
        "CorrInt": lambda: correlation_dimension(points, near, max(1, k // 2), k),
        "MiND_ML": lambda: mind_ml(near, k),
        "TLE": lambda: dimension.tight_locality(points, upto, k).agg(F.avg("d")),
        "ESS": lambda: dimension.simplex_skewness(points, upto, k).agg(F.avg("d")),
        "DANCo": lambda: dimension.danco_dimension(points, near, k),
    }[name]().first()[0]
    near.unpersist()
    return found


def target_dimension(width: int, target: int | None, estimate: float | None, manual: bool = False) -> int:
    """max(2, target) if set by hand, else a positive target, else the estimate or 10; within [2, width - 1]."""
    wanted = max(2, target or 0) if manual else target if target and target > 0 else math.ceil(estimate) if estimate else 10
    return max(2, min(int(wanted), max(2, width - 1)))


def pca(points: DataFrame, k: int) -> DataFrame:
    """(id, scores): centred projections on the first k axes."""
    width = len(points.first()["features"])
    mean, _, axes = principal_axes(points, width)
    shared = points.sparkSession.sparkContext.broadcast((mean, axes[:k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), list_column((matrix(batch.column(1), width) - mean) @ axes.T)], names=["id", "scores"])

    return points.select(F.col("id").cast("long"), F.col("features").cast("array<double>")).mapInArrow(run, "id long, scores array<double>")


#: The layout moves all points at once on the driver; more are an error.
MOST_LAYOUT_POINTS = 20_000


def fuzzy_graph(near: DataFrame, k: int) -> DataFrame:
    """(a, b, w), a < b: smoothed neighbour weights, made symmetric by a + b - a b (McInnes et al. 2018).

    Each point's width is found by bisection so that its weights sum to log2 k.
    """
    goal = math.log2(k)

    def smooth(table: pa.Table) -> pa.Table:
        d = np.sort(table.column("distance").to_numpy())
        rho = d[d > 0][0] if (d > 0).any() else 0.0
        lo, hi = 0.0, np.inf
        sigma = 1.0
        for _ in range(64):
            total = np.exp(-np.maximum(d - rho, 0) / sigma).sum()
            if abs(total - goal) < 1e-5:
                break
            lo, hi = (lo, sigma) if total > goal else (sigma, hi)
            sigma = (lo + hi) / 2 if np.isfinite(hi) else sigma * 2
        w = np.exp(-np.maximum(table.column("distance").to_numpy() - rho, 0) / max(sigma, 1e-3 * d.mean(), 1e-12))
        return pa.table([table.column("id"), table.column("neighbour"), pa.array(w)], names=["a", "b", "w"])

    directed = near.filter(F.col("rank") <= k).groupBy("id").applyInArrow(smooth, "a long, b long, w double")
    pairs = directed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.ln(1 - F.least("w", F.lit(1 - 1e-12))).alias("l"))
    return pairs.groupBy("a", "b").agg((1 - F.exp(F.sum("l"))).alias("w"))


def umap(points: DataFrame, n_components: int = 2, n_neighbors: int = 15, min_dist: float = 0.1, metric: str = "euclidean", epochs: int = 200, seed: int = 42) -> DataFrame:
    """(id, scores). The graph is made in Spark; the layout, one seeded descent over at most
    MOST_LAYOUT_POINTS points that starts from their principal axes, on the driver."""
    n = points.count()
    if n > MOST_LAYOUT_POINTS:
        raise ValueError(f"the layout takes at most {MOST_LAYOUT_POINTS} points, not {n}; use pca")
    k = min(n_neighbors, max(1, n - 1))
    if n < 3:
        return pca(points, n_components)
    edges = fuzzy_graph(knn(points, k, metric), k).collect()
    start = sorted(pca(points, n_components).collect(), key=lambda r: r["id"])
    ids = [r["id"] for r in start]
    place = {v: i for i, v in enumerate(ids)}
    y = np.array([r["scores"] for r in start], float)
    y = np.pad(y, ((0, 0), (0, n_components - y.shape[1])))
    y = 10 * y / max(np.abs(y).max(), 1e-9)
    a_, b_ = _curve(min_dist)
    rng = np.random.default_rng(seed)
    y += rng.normal(0, 1e-4, y.shape)
    i = np.array([place[e["a"]] for e in edges])
    j = np.array([place[e["b"]] for e in edges])
    w = np.array([e["w"] for e in edges])
    for t in range(epochs):
        rate = 1 - t / epochs
        on = rng.random(len(w)) < w / w.max()
        p, q = i[on], j[on]
        off = y[p] - y[q]
        d2 = (off**2).sum(axis=1)
        pull = -2 * a_ * b_ * np.where(d2 > 0, d2, 1) ** (b_ - 1) * (d2 > 0) / (1 + a_ * d2**b_)
        step = np.clip(pull[:, None] * off, -4, 4) * rate
        np.add.at(y, p, step)
        np.add.at(y, q, -step)
        for ends in (p, q):
            other = rng.integers(0, n, (5, len(ends)))
            for o in other:
                off = y[ends] - y[o]
                d2 = (off**2).sum(axis=1)
                push = 2 * b_ / ((0.001 + d2) * (1 + a_ * d2**b_))
                np.add.at(y, ends, np.clip(push[:, None] * off, -4, 4) * rate)
    return points.sparkSession.createDataFrame([(v, row.tolist()) for v, row in zip(ids, y, strict=True)], "id long, scores array<double>")


def _curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a, b of 1 / (1 + a x^(2 b)), fitted by Gauss-Newton to the wanted fall from min_dist on."""
    x = np.linspace(1e-3, 3 * spread, 300)
    goal = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b = 1.5, 0.9
    for _ in range(100):
        p = x ** (2 * b)
        f = 1 / (1 + a * p)
        jac = np.stack([-p * f**2, -2 * a * p * np.log(x) * f**2], axis=1)
        da, db = np.linalg.lstsq(jac, goal - f, rcond=None)[0]
        a, b = max(1e-3, a + 0.5 * da), max(1e-2, b + 0.5 * db)
    return a, b


def splat(points: DataFrame, resolution: int = 200, sigma: float = 0.1, pad: float = 0.1) -> DataFrame:
    """(px, py, weight, value, alpha): Gaussian splats of points (x, y, value), cut at three deviations.

    Each point is scattered to the pixels around it; sums by pixel are aggregated before the shuffle.
    """
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    for c in "xy":
        span = F.col(f"{c}1") - F.col(f"{c}0")
        box = box.withColumn(f"s{c}", F.when(span == 0, 1.0).otherwise(span) * (1 + 2 * pad)).withColumn(f"o{c}", F.col(f"{c}0") - pad * F.when(span == 0, 1.0).otherwise(span))
    s = max(sigma, 0.01) * resolution
    r = math.ceil(3 * s)
    at = lambda c: (F.col(c) - F.col(f"o{c}")) / F.col(f"s{c}") * (resolution - 1)
    placed = points.join(F.broadcast(box.select("ox", "sx", "oy", "sy")), F.lit(True)).select("value", at("x").alias("gx"), at("y").alias("gy"))
    reach = lambda c: F.sequence(F.greatest(F.lit(0), F.floor(F.col(c)).cast("int") - r), F.least(F.lit(resolution - 1), F.floor(F.col(c)).cast("int") + r))
    pixels = placed.select("*", F.explode(reach("gx")).alias("px")).select("*", F.explode(reach("gy")).alias("py"))
    d2 = F.pow(F.col("px") - F.col("gx"), 2) + F.pow(F.col("py") - F.col("gy"), 2)
    near = pixels.withColumn("d2", d2).filter(F.col("d2") <= 9 * s * s).withColumn("w", F.exp(-F.col("d2") / (2 * s * s)))
    grid = near.groupBy("px", "py").agg(F.sum("w").alias("weight"), (F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    top = F.max("weight").over(W.partitionBy(F.lit(1)))  # pixels, not points
    return grid.withColumn("alpha", F.least(F.lit(1.0), F.col("weight") / (0.08 * top))).filter("weight > 0.001")


def nearest_point(points: DataFrame, x: float, y: float, reach: float = 16.0) -> DataFrame:
    """The nearest point within reach, if any."""
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    return points.withColumn("d", d).filter(F.col("d") < reach).agg(F.min_by("id", F.struct("d", "id")).alias("id"), F.min("d").alias("d")).filter("id IS NOT NULL")


def map_coordinates(points: DataFrame, noise: str = "Ruido") -> DataFrame:
    """x, y over the larger range to [-1, 1]; categories numbered in order, noise -1, noise drawn first."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    span = F.when(span == 0, 1.0).otherwise(span)
    scaled = lambda c: 2 * (F.col(c) - (F.col(f"{c}0") + F.col(f"{c}1")) / 2) / span
    names = points.select("category").distinct().filter(F.col("category") != noise)
    numbered = names.withColumn("number", F.row_number().over(W.orderBy("category")) - 1)  # a row for each category
    joined = points.join(F.broadcast(box), F.lit(True)).join(numbered, "category", "left")
    return joined.select("id", scaled("x").alias("x"), scaled("y").alias("y"), F.coalesce("number", F.lit(-1)).alias("number"), F.when(F.col("category") == noise, 0).otherwise(1).alias("layer"))


def label_tiers(sizes: DataFrame, ranks: tuple[int, ...] = (16, 46, 101), fallback: tuple[int, ...] = (50, 15, 5)) -> DataFrame:
    """(category, size, tier): a tier for each size at least that of the 16th, 46th and 101st largest, the rank
    being clamped to how many there are; 0 below all."""
    ranked = sizes.withColumn("rn", F.row_number().over(W.orderBy(F.desc("size"), "category"))).withColumn("n", F.count("*").over(W.partitionBy(F.lit(1))))
    every = W.partitionBy(F.lit(1))
    tier = F.lit(0)
    for t in reversed(range(len(ranks))):
        cut = F.coalesce(F.max(F.when(F.col("rn") == F.least(F.lit(ranks[t]), F.col("n")), F.col("size"))).over(every), F.lit(fallback[t]))
        tier = F.when(F.col("size") >= cut, t + 1).otherwise(tier)
    return ranked.select("category", "size", tier.alias("tier"))
