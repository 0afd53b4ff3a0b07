"""Estimators of intrinsic dimension beyond distances to neighbours: separability by Fisher's discriminant, tight
localities, the skewness of simplices, the growth of the neighbour graph, and angles beside distances.

All take points (id, features) and, where they look at neighbourhoods, the table of ``neighbours.knn``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoflux.functions.arrays import list_column, matrix
from cartoflux.functions.settle import settled
from cartoflux.operators import neighbours
from cartoflux.operators.som import principal_axes

#: Thresholds of separability.
ALPHAS = [(60 + 2 * i) / 100.0 for i in range(20)]
#: Steps of Newton's rule for Lambert's W.
STEPS = 40


# separability

def whitened(points: DataFrame, condition: float = 10.0) -> DataFrame:
    """(id, features): points about their mean on their principal axes, each over its deviation, at length 1. Axes
    whose variance is below the largest over ``condition`` go; a point at the mean stays at the origin."""
    width = len(points.first()["features"])
    mean, values, axes = principal_axes(points, width)
    kept = values * condition > values[0]
    shared = points.sparkSession.sparkContext.broadcast((mean, axes[kept] / np.sqrt(values[kept])[:, None]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes = shared.value
        for batch in batches:
            made = (matrix(batch.column(1), width) - mean) @ axes.T
            length = np.linalg.norm(made, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), list_column(made / np.where(length > 0, length, 1))], names=["id", "features"])

    return points.select(F.col("id").cast("long"), F.col("features").cast("array<double>")).mapInArrow(run, "id long, features array<double>")


def inseparable(sphere: DataFrame, alphas: list[float] = ALPHAS) -> DataFrame:
    """(alpha, p): the share of other points that are not separable from a point, over all points: points of the unit
    sphere whose product is above alpha. Every two blocks meet once, in a task that counts its own pairs."""
    n = sphere.count()

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        counts = np.zeros(len(alphas), np.int64)
        if len(a) and len(b):
            width = len(a.column("features")[0])
            x, y = matrix(a.column("features"), width), matrix(b.column("features"), width)
            ia, ib = a.column("id").to_numpy(), b.column("id").to_numpy()
            twice = 1 if a.column("p")[0] == a.column("q")[0] else 2
            for at in range(0, len(x), 256):
                near = x[at : at + 256] @ y.T
                near[ia[at : at + 256, None] == ib[None]] = -1
                above = np.searchsorted(alphas, near[near > alphas[0]], "left")  # so many thresholds are below
                counts += twice * (len(above) - np.cumsum(np.bincount(above, minlength=len(alphas) + 1))[: len(alphas)])
        return pa.table([pa.array(alphas), pa.array(counts)], names=["alpha", "pairs"])

    met = neighbours.block_pairs(sphere, once=True).applyInArrow(pair, "alpha double, pairs long")
    return met.groupBy("alpha").agg((F.sum("pairs") / (float(n) * max(n - 1, 1))).alias("p"))


def sphere_dimension(alpha: Column, p: Column) -> Column:
    """n for which a share p of uniform points of an n-sphere is not separable at alpha:
    W(-ln(1 - a) / (2 pi p^2 a (1 - a))) / -ln(1 - a), a = alpha^2, W by Newton's rule on w + ln w = ln z."""
    a = alpha * alpha
    low = -F.ln(1 - a)
    z = low / (2 * math.pi * p * p * a * (1 - a))
    w = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.ln(1 + z), lambda w, _: w * (1 + F.ln(z) - F.ln(w)) / (1 + w))
    return F.when(p > 0, w / low)


def fisher_separability(points: DataFrame, condition: float = 10.0) -> DataFrame:
    """One row (Albergante et al. 2019): the dimension at the threshold nearest to 0.9 of the largest at which any
    pair is not separable; of two as near, the lower."""
    curve = inseparable(whitened(points, condition)).withColumn("n", sphere_dimension(F.col("alpha"), F.col("p"))).filter("n IS NOT NULL")
    top = curve.agg(F.max("alpha").alias("top"))
    near = curve.join(F.broadcast(top), F.lit(True))
    return near.agg(F.min_by("n", F.struct(F.abs(F.col("alpha") - F.lit(0.9) * F.col("top")), "alpha")).alias("dimension"))


# neighbourhoods

def neighbourhoods(points: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(id, centre, distances, vectors): each point with its k neighbours in order, so that distances among the
    neighbours can be taken: a join to the neighbours' vectors and one to the point's own."""
    vectors = points.select("id", "features")
    hop = near.filter(F.col("rank") <= k).select("id", "rank", "neighbour", "distance").join(vectors.select(F.col("id").alias("neighbour"), "features"), "neighbour")
    own = hop.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "distance", "features"))).alias("near"))
    return own.join(vectors.withColumnRenamed("features", "centre"), "id").select("id", "centre", F.col("near.distance").alias("distances"), F.col("near.features").alias("vectors"))


def _by_neighbourhood(around: DataFrame, value: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[float, ...]], names: tuple[str, ...]) -> DataFrame:
    """(id, names): what ``value`` makes of centre, distances and vectors; None stands for no estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for centre, distances, vectors in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                d = distances.values.to_numpy()
                rows.append(value(centre.values.to_numpy(), d, vectors.values.flatten().to_numpy().reshape(len(d), len(centre))))
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *names])

    rows = around.select(F.col("id").cast("long").alias("id"), F.col("centre").cast("array<double>"), "distances", F.col("vectors").cast("array<array<double>>"))
    return rows.mapInArrow(run, "id long, " + ", ".join(f"{n} double" for n in names))


def tight_locality_at(_: np.ndarray, d: np.ndarray, x: np.ndarray) -> tuple[float | None]:
    """Amsaleg et al. 2019: besides the distances from the point, those that its neighbours' view of each other gives:
    for v and w the distance from v at which w, and w's reflection through the point, would lie on a ball that touches
    the neighbourhood's rim. Terms with a distance of 0 are left out."""
    r = d.max(initial=0.0)
    if r <= 0:
        return (None,)
    v2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    i, j = np.nonzero(~np.eye(len(d), dtype=bool) & (v2 > 0) & (d[:, None] > 0) & (d[None] > 0))
    a, b, seen = d[i], d[j], v2[i, j]
    logs = [2 * np.log(d[d > 0] / r)]
    counted = float((d > 0).sum())
    sound, reach = np.ones(len(i), bool), []
    for square in (seen, 2 * a * a + 2 * b * b - seen):
        square = np.maximum(square, 0)
        over, slack = a * a + square - b * b, r * r - a * a
        rim = slack <= 0
        inner = r * (np.sqrt(over * over + 4 * square * slack) - over) / np.where(rim, 1, 2 * slack)
        outer = r * square / np.where(rim & (r * r + square - b * b > 0), r * r + square - b * b, 1)
        reach.append(np.where(rim, outer, inner))
        sound &= reach[-1] > 0
    logs += [np.log(t[sound] / r) for t in reach]
    total = float(sum(part.sum() for part in logs))
    return (-2 * (counted + float(sound.sum())) / total if total < 0 else None,)


def tight_locality(points: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(id, d): the estimate within each point's k neighbours, distances among these included."""
    return _by_neighbourhood(neighbourhoods(points, near, k), tight_locality_at, ("d",)).filter("d IS NOT NULL")


def skewness_reference(most: int) -> np.ndarray:
    """The mean sine of the angle of two random directions in 1 .. most dimensions."""
    n = np.arange(2, most + 1)
    return np.array([0.0, *(math.exp(2 * math.lgamma(i / 2) - math.lgamma((i + 1) / 2) - math.lgamma((i - 1) / 2)) for i in n.tolist())])


def simplex_skewness(points: DataFrame, near: DataFrame, k: int, most: int = 1024) -> DataFrame:
    """(id, d) (Johnsson et al. 2015): areas spanned by pairs of neighbours about the neighbours' centroid, over the
    products of their lengths, against what is expected by dimension; between whole dimensions by a straight line."""
    reference = skewness_reference(most)

    def value(_: np.ndarray, __: np.ndarray, x: np.ndarray) -> tuple[float | None]:
        gram = (x - x.mean(axis=0)) @ (x - x.mean(axis=0)).T
        i, j = np.triu_indices(len(x), 1)
        size = gram[i, i] * gram[j, j]
        whole = np.sqrt(size).sum()
        if not whole > 0:
            return (None,)
        skew = float(np.sqrt(np.maximum(size - gram[i, j] ** 2, 0)).sum() / whole)
        n = min(int(np.searchsorted(reference, skew, "right")), most - 1)  # the last dimension expected to have no more
        return (n + (skew - reference[n - 1]) / (reference[n] - reference[n - 1]),)

    return _by_neighbourhood(neighbourhoods(points, near, k), value, ("d",)).filter("d IS NOT NULL")


# growth of the neighbour graph

def level(key: Column, levels: int) -> Column:
    """How often the samples that hold a key have been halved: the leading bits of its md5 that are 0, and fewer than
    ``levels``. Samples are nested, and the same in any engine that has md5."""
    first = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return sum((F.when(first < 2 ** (32 - j), 1).otherwise(0) for j in range(1, levels)), F.lit(0))


def graph_lengths(points: DataFrame, k: int, levels: int = 4) -> DataFrame:
    """(level, n, length): points and summed neighbour distances of samples halved again and again."""
    marked = points.select("id", "features", level(F.col("id"), levels).alias("level"))
    found = None
    for j in range(levels):
        near = neighbours.knn(marked.filter(F.col("level") >= j).select("id", "features"), k)
        step = near.agg(F.lit(j).alias("level"), F.sum((F.col("rank") == 1).cast("long")).alias("n"), F.sum("distance").alias("length"), F.max("rank").alias("most"))
        found = step if found is None else found.union(step)
    return found.filter(F.col("most") == k).select("level", "n", "length")


def graph_dimension(points: DataFrame, k: int, levels: int = 4) -> DataFrame:
    """One row (Costa and Hero 2004): 1 / (1 - s) with s the slope of the log length of the neighbour graph on the
    log of the points, over nested samples."""
    lengths = graph_lengths(points, k, levels).filter("length > 0")
    return lengths.agg(F.regr_slope(F.ln("length"), F.ln("n")).alias("s")).select(F.try_divide(F.lit(1.0), 1 - F.col("s")).alias("dimension"))


# angles beside distances

#: Points of a part of a calibration set, tasks at most; nodes of the divergence's quadrature and of a full turn.
PART, TASKS, NODES, TURN = 8192, 8192, 200, 512


def concentration(r: float) -> float:
    """Fisher's approximation of a von Mises concentration from the mean resultant length."""
    if r < 0.53:
        return 2 * r + r**3 + 5 * r**5 / 6
    if r < 0.85:
        return -0.4 + 1.39 * r + 0.43 / (1 - r)
    return 1 / max(r**3 - 4 * r**2 + 3 * r, 1e-12)


def angles_at(centre: np.ndarray, _: np.ndarray, x: np.ndarray) -> tuple[float | None, float | None]:
    """Mean direction and concentration of the angles between a point's neighbours, seen from it."""
    off = x - centre
    length = np.linalg.norm(off, axis=1)
    off = off[length > 0] / length[length > 0, None]
    if len(off) < 2:
        return None, None
    i, j = np.triu_indices(len(off), 1)
    theta = np.arccos(np.clip((off @ off.T)[i, j], -1, 1))
    c, s = np.cos(theta).mean(), np.sin(theta).mean()
    return float(np.arctan2(s, c)), concentration(min(float(np.hypot(c, s)), 1 - 1e-9))


def most_likely(likelihood: Callable[[list[float]], list[float]], most: float) -> float:
    """The d up to ``most`` of the greatest likelihood: a grid, refined twice around its best."""
    low, high = 0.1, most
    for _ in range(4):
        tried = np.linspace(low, high, 65).tolist()
        at = int(np.argmax(likelihood(tried)))
        low, high = tried[max(0, at - 1)], tried[min(64, at + 1)]
    return tried[at]


def distance_divergence(a: float, b: float, k: int) -> float:
    """Kullback-Leibler divergence of the densities k d r^(d-1) (1 - r^d)^(k-1), of d = a from d = b."""
    u, weight = np.polynomial.legendre.leggauss(NODES)
    u, weight = (u + 1) / 2, weight / 2
    r = u ** (1 / a)
    gain = math.log(a / b) + (a - b) * np.log(r) + (k - 1) * (np.log1p(-u) - np.log1p(-np.minimum(r**b, 1 - 1e-16)))
    return float((weight * k * (1 - u) ** (k - 1) * gain).sum())


def angle_divergence(nu_a: float, tau_a: float, nu_b: float, tau_b: float) -> float:
    """Kullback-Leibler divergence of two von Mises densities."""
    c = np.cos(np.arange(TURN) * 2 * np.pi / TURN)
    log_bessel = lambda t: t + math.log(np.exp(t * (c - 1)).mean())
    mean = float((c * np.exp(tau_a * (c - 1))).sum() / np.exp(tau_a * (c - 1)).sum())
    return log_bessel(tau_b) - log_bessel(tau_a) + mean * (tau_a - tau_b * math.cos(nu_a - nu_b))


def in_ball(n: int, d: int, seed: int, part: int = 0) -> np.ndarray:
    """n points spread evenly in the unit ball of d dimensions; each part has its own."""
    rng = np.random.default_rng([seed, d, part] if part else [seed, d])
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * rng.random((n, 1)) ** (1 / d)


def nearest_in_parts(ends: list[int], part: Callable[[int], np.ndarray], own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, vectors) of the k nearest others of each point of part ``own``, in order, among all parts. ``part``
    makes the points between two ends; beside the own ones those of one part are held at a time."""
    x = part(own)
    ids, none = np.arange(len(x)), np.zeros(0, np.int64)
    held = neighbours.Within(np.full(len(x), np.inf), k)
    for p in [own, *(p for p in range(len(ends) - 1) if p != own)]:  # the own part first: its k-th bound what others add
        if p == own:
            i, j, d = (np.concatenate(c) for c in zip(*neighbours.nearest(x, x, ids, ids, k), strict=True))
            held.add(i, j + ends[own], d)
        else:
            y = part(p)
            products = neighbours.Products(x, y, none, none)
            for at in range(0, len(x), neighbours.ROWS):
                for column in range(0, len(y), neighbours.COLUMNS):
                    i, j = products.below(at, column, products.piece(at, column), held.bound[at : at + neighbours.ROWS])
                    held.add(i, j + ends[p], neighbours.exactly(x, y, i, j))
        held.parts = [held.take()]
        i, _, d = held.parts[0]
        last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i, "left") == k - 1)
        held.bound[i[last]] = d[last]
    _, j, d = held.take()
    vectors = np.empty((len(j), x.shape[1]))
    for p in range(len(ends) - 1):
        here = (j >= ends[p]) & (j < ends[p + 1])
        if here.any():
            vectors[here] = part(p)[j[here] - ends[p]]
    return d.reshape(len(x), k), vectors.reshape(len(x), k, x.shape[1])


def seen(x: np.ndarray, d: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shares of the first in the (k + 1)-th distance, and (nu, tau) of the angles of each point."""
    with np.errstate(all="ignore"):
        rho = d[:, 0] / d[:, k]
    angles = [angles_at(x[i], d[i], vectors[i, :k]) for i in range(len(x))]
    return rho[(rho > 0) & (rho < 1)], np.array([a for a in angles if a[0] is not None]).reshape(-1, 2)


def most_likely_share(rho: np.ndarray, k: int, most: float) -> float:
    ln, n = float(np.log(rho).sum()), len(rho)
    return most_likely(lambda ds: [n * math.log(k * v) + (v - 1) * ln + (k - 1) * float(np.log1p(-(rho**v)).sum()) for v in ds], most)


def local_statistics(x: np.ndarray, k: int, most: float) -> tuple[float, float, float]:
    """(d, nu, tau) of a set of points held in memory."""
    rho, angles = seen(x, *nearest_in_parts([0, len(x)], lambda _: x, 0, k + 1), k)
    return most_likely_share(rho, k, most), *angles.mean(axis=0).tolist()


def danco(points: DataFrame, near: DataFrame, k: int, most: int | None = None, calibration: int | None = None, seed: int = 42) -> DataFrame:
    """(dimension, divergence) for each whole dimension up to the points' width (Ceruti et al. 2014): how far the
    distances and angles of the points' neighbours are from those of points spread evenly in a ball of that dimension.

    ``near`` holds k + 1 neighbours. Calibration sets have as many points as there are, unless ``calibration`` names
    fewer. They are made anew, part by part, wherever they are looked at: a task finds the neighbours of one part of one
    dimension's set, so none holds a set, and all that is kept of a point is a share.
    """
    spark, width = points.sparkSession, len(points.first()["features"])
    most, n = most or width, points.count()
    near = settled(near)
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("distance")))
    rho = near.groupBy("id").agg(at(1).alias("a"), at(k + 1).alias("b")).filter("a > 0 AND b > a").select((F.col("a") / F.col("b")).alias("rho")).persist()

    def likelihood(tried: list[float]) -> list[float]:
        value = lambda d: F.sum(F.ln(F.lit(k * d)) + (d - 1) * F.ln("rho") + (k - 1) * F.log1p(-F.pow("rho", F.lit(d))))
        return [v if v is not None else -math.inf for v in rho.agg(*[value(d).alias(f"v{i}") for i, d in enumerate(tried)]).first()]

    limit = 2.0 * most + 1
    fitted = most_likely(likelihood, limit)
    rho.unpersist()
    angles = _by_neighbourhood(neighbourhoods(points, near, k), angles_at, ("nu", "tau")).agg(F.avg("nu").alias("nu"), F.avg("tau").alias("tau")).first()
    size = max(k + 2, n if calibration is None else min(n, calibration))
    parts = max(1, min(-(-size // PART), size // (k + 2)))
    ends = [size * p // parts for p in range(parts + 1)]

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                d, own = number // parts + 1, number % parts
                part = lambda p, d=d: in_ball(ends[p + 1] - ends[p], d, seed, p)
                shares, turned = seen(part(own), *nearest_in_parts(ends, part, own, k + 1), k)
                row = {"dimension": d, "part": own, "rho": shares.tolist(), "n": len(turned), "nu": float(turned[:, 0].sum()), "tau": float(turned[:, 1].sum())}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("dimension", pa.int32()), ("part", pa.int32()), ("rho", pa.list_(pa.float64())), ("n", pa.int64()), ("nu", pa.float64()), ("tau", pa.float64())]))

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by("part").combine_chunks()
        own = most_likely_share(table.column("rho").combine_chunks().flatten().to_numpy(), k, limit)
        n, nu, tau = (sum(table.column(c).to_pylist()) for c in ("n", "nu", "tau"))
        value = distance_divergence(fitted, own, k) + angle_divergence(angles["nu"], angles["tau"], nu / n, tau / n)
        return pa.table({"dimension": pa.array(table.column("dimension")[:1].to_pylist(), pa.int32()), "divergence": pa.array([value], pa.float64())})

    tasks = spark.range(0, most * parts, 1, numPartitions=min(most * parts, TASKS))
    made = settled(tasks.mapInArrow(calibrate, "dimension int, part int, rho array<double>, n long, nu double, tau double"))
    return made.groupBy("dimension").applyInArrow(judge, "dimension int, divergence double")


def danco_dimension(points: DataFrame, near: DataFrame, k: int, **more) -> DataFrame:
    """One row: the dimension of the least divergence, of equals the lower."""
    return danco(points, near, k, **more).agg(F.min_by("dimension", F.struct("divergence", "dimension")).cast("double").alias("dimension"))
