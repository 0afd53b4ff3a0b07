"""Self-organising maps on a hexagonal grid.

The codebook (rows x cols neurons) is small and goes to the tasks as a broadcast; the data never leaves them.
A batch epoch needs each neuron's count and component sums only: the neighbourhood weight of a sample depends
on it through its best-matching unit alone. So an epoch is one pass whose result has the codebook's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartoflux.functions.arrays import matrix, summed
from cartoflux.sources.scan import ranked

METRICS = ("euclidean", "manhattan", "canberra")
#: The largest grid; its codebook is broadcast and its grid distances are held on the driver.
MOST_NEURONS = 10_000


@dataclass(frozen=True)
class SomConfig:
    """The training form's defaults; the engine's own were 10 x 10, random, eps .5 and min_samples 3."""

    rows: int = 8
    cols: int = 8
    iterations: int = 100
    method: str = "batch"
    init: str = "pca"
    metric: str = "euclidean"
    learning_rate: float = 0.5
    n_clusters: int = 4
    clustering: str = "dbscan"
    eps: float = 1.5
    min_samples: int = 2
    seed: int = 42

    def __post_init__(self):
        if self.rows * self.cols > MOST_NEURONS:
            raise ValueError(f"{self.rows} x {self.cols} neurons; at most {MOST_NEURONS}")


def hex_grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """(neuron, row, col, x, y): columns 1.5 apart, every other one shifted by half a step."""
    ids = spark.range(rows * cols).select(F.col("id").cast("int").alias("neuron"))
    i, j = F.floor(F.col("neuron") / cols).cast("int"), (F.col("neuron") % cols).cast("int")
    return ids.select(
        "neuron", i.alias("row"), j.alias("col"), (i * 1.5).alias("x"), (j * F.sqrt(F.lit(3.0)) + F.when(i % 2 == 1, F.sqrt(F.lit(3.0)) / 2).otherwise(0.0)).alias("y")
    )


def grid_points(rows: int, cols: int) -> np.ndarray:
    i, j = np.divmod(np.arange(rows * cols), cols)
    return np.stack([1.5 * i, np.sqrt(3) * j + np.where(i % 2, np.sqrt(3) / 2, 0)], axis=1)


def grid_distances(rows: int, cols: int) -> np.ndarray:
    p = grid_points(rows, cols)
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))


def distances(x: np.ndarray, weights: np.ndarray, metric: str) -> np.ndarray:
    """Rows to neurons; an unknown metric is Euclidean."""
    if metric not in ("manhattan", "canberra"):
        return np.sqrt(np.maximum(((x[:, None] - weights[None]) ** 2).sum(axis=2), 0))
    out = np.empty((len(x), len(weights)))
    for m, w in enumerate(weights):
        off = np.abs(x - w)
        out[:, m] = (off if metric == "manhattan" else off / (np.abs(x) + np.abs(w) + 1e-15)).sum(axis=1)
    return out


def _nearest(x: np.ndarray, weights: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Best-matching units and distances, a block of rows at a time; of equals the lowest neuron."""
    step = max(1, 4_000_000 // max(1, weights.size))
    bmu, dist = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), step):
        d = distances(x[at : at + step], weights, metric)
        bmu[at : at + step] = d.argmin(axis=1)
        dist[at : at + step] = d[np.arange(len(d)), d.argmin(axis=1)]
    return bmu, dist


def assign(data: DataFrame, weights: np.ndarray, metric: str = "euclidean") -> DataFrame:
    """Adds bmu and dist to rows with a ``features`` column."""
    shared = data.sparkSession.sparkContext.broadcast(weights)
    names = data.columns
    at = names.index("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bmu, dist = _nearest(matrix(batch.column(at), shared.value.shape[1]), shared.value, metric)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bmu.astype("i4")), pa.array(dist)], names=[*names, "bmu", "dist"])

    schema = T.StructType([*data.schema.fields, T.StructField("bmu", T.IntegerType()), T.StructField("dist", T.DoubleType())])
    return data.mapInArrow(run, schema)


def init_weights(data: DataFrame, rows: int, cols: int, init: str, seed: int = 42) -> np.ndarray:
    """random: uniform within each component's range; pca or linear: along the first two axes; else zeros."""
    m, width = rows * cols, len(data.select("features").first()[0])
    if init == "random":
        span = data.select(F.posexplode("features").alias("d", "v")).groupBy("d").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        lo, hi = np.zeros(width), np.zeros(width)
        for r in span:
            lo[r["d"]], hi[r["d"]] = r["lo"], r["hi"]
        return np.random.default_rng(seed).uniform(lo, hi, (m, width))
    if init not in ("pca", "linear"):
        return np.zeros((m, width))
    mean, values, axes = principal_axes(data, width)
    p = grid_points(rows, cols)
    span = np.where(np.ptp(p, axis=0) > 0, np.ptp(p, axis=0), 1)
    at = 2 * (p - p.min(axis=0)) / span - 1
    out = np.tile(mean, (m, 1))
    for k in range(2):
        if width > k + 1:  # the second axis needs three components
            out += at[:, k : k + 1] * axes[k] * np.sqrt(max(values[k], 0))
    return out


def principal_axes(data: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, sample variances and unit axes by falling variance; each axis's largest coefficient is positive."""
    first = summed(data, "features", width, {"n": (1,), "x": (width,)}, lambda x: {"n": np.array([len(x)]), "x": x.sum(axis=0)})
    n, mean = first["n"][0], first["x"] / max(first["n"][0], 1)
    second = summed(data, "features", width, {"xx": (width, width)}, lambda x: {"xx": (x - mean).T @ (x - mean)})
    values, axes = np.linalg.eigh(second["xx"] / max(n - 1, 1))
    order = np.argsort(-values, kind="stable")
    values, axes = values[order], axes[:, order].T
    flip = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return mean, values, axes * np.where(flip == 0, 1, flip)[:, None]


def batch_statistics(data: DataFrame, weights: np.ndarray, metric: str, before: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Counts and component sums by best-matching unit, in one pass; ``error`` is the summed Euclidean distance
    of each row to ``weights`` at its unit in ``before``, the previous epoch's codebook."""
    m, width = weights.shape

    def part(x: np.ndarray) -> dict[str, np.ndarray]:
        bmu, _ = _nearest(x, weights, metric)
        sums = np.zeros((m, width))
        np.add.at(sums, bmu, x)
        error = 0.0
        if before is not None:
            old, _ = _nearest(x, before, metric)
            error = np.sqrt(((x - weights[old]) ** 2).sum(axis=1)).sum()
        return {"n": np.bincount(bmu, minlength=m), "x": sums, "error": np.array([error])}

    return summed(data, "features", width, {"n": (m,), "x": (m, width), "error": (1,)}, part)


def batch_update(weights: np.ndarray, counts: np.ndarray, sums: np.ndarray, grid: np.ndarray, sigma: float) -> np.ndarray:
    h = np.exp(-(grid**2) / (2 * sigma**2))
    below = h @ counts
    return np.where(below[:, None] > 0, (h @ sums) / np.where(below > 0, below, 1)[:, None], weights)


def train_batch(data: DataFrame, weights: np.ndarray, rows: int, cols: int, iterations: int, metric: str = "euclidean") -> tuple[np.ndarray, list[float]]:
    """(weights, mean error of each epoch). An epoch's error needs its new weights, so the next pass has it."""
    grid, start = grid_distances(rows, cols), max(rows, cols) / 2
    before, errors = None, []
    for t in range(iterations):
        found = batch_statistics(data, weights, metric, before)
        if before is not None:
            errors.append(float(found["error"][0] / max(found["n"].sum(), 1)))
        before, weights = weights, batch_update(weights, found["n"], found["x"], grid, max(0.1, start * np.exp(-t / iterations)))
    if before is not None:
        found = batch_statistics(data, weights, metric, before)
        errors.append(float(found["error"][0] / max(found["n"].sum(), 1)))
    return weights, errors


#: Online training visits samples one after another, so it is one task; more rows are an error.
MOST_ONLINE_ROWS = 200_000


def train_online(data: DataFrame, weights: np.ndarray, rows: int, cols: int, iterations: int, rate: float, metric: str = "euclidean", seed: int = 42):
    """Every sample moves all neurons, in a new seeded order each epoch; rate and radius fall to their ends."""
    grid, start = grid_distances(rows, cols), max(rows, cols) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if batches else None
        w, errors = weights.copy(), []
        x = matrix(table.sort_by("row_id").column("features"), w.shape[1])
        rng = np.random.default_rng(seed)
        for t in range(iterations):
            sigma, lr = start * np.exp(-t / iterations), rate * (1 - t / iterations)
            total = 0.0
            for i in rng.permutation(len(x)):
                b = int(distances(x[i : i + 1], w, metric)[0].argmin())
                h = np.exp(-(grid[b] ** 2) / (2 * sigma**2))
                w += lr * h[:, None] * (x[i] - w)
                total += float(np.sqrt(((x[i] - w[b]) ** 2).sum()))
            errors.append(total / max(len(x), 1))
        yield pa.RecordBatch.from_arrays([pa.array([w.ravel()], pa.list_(pa.float64())), pa.array([errors], pa.list_(pa.float64()))], names=["w", "errors"])

    n = data.count()
    if n > MOST_ONLINE_ROWS:
        raise ValueError(f"online training takes at most {MOST_ONLINE_ROWS} rows, not {n}; use batch")
    if not n:
        return weights, []
    found = data.select("row_id", "features").coalesce(1).mapInArrow(run, "w array<double>, errors array<double>").first()
    return np.array(found["w"]).reshape(weights.shape), list(found["errors"])


def codebook(spark: SparkSession, weights: np.ndarray, rows: int, cols: int) -> DataFrame:
    """hex_grid with each neuron's weights."""
    made = spark.createDataFrame([(m, w.tolist()) for m, w in enumerate(weights)], "neuron int, w array<double>")
    return hex_grid(spark, rows, cols).join(F.broadcast(made), "neuron")


#: The six neighbours (row, col) of a cell in even and in odd rows of the grid.
NEIGHBOURS = [
    [(0, -1), (0, 1), (-1, -1), (-1, 0), (1, -1), (1, 0)],
    [(0, -1), (0, 1), (-1, 0), (-1, 1), (1, 0), (1, 1)],
]


def neighbours(grid: DataFrame) -> DataFrame:
    """(neuron, nrow, ncol): the six places around each neuron, inside the grid or not."""
    offsets = [F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in side]) for side in NEIGHBOURS]
    around = F.explode(F.when(F.col("row") % 2 == 0, offsets[0]).otherwise(offsets[1])).alias("o")
    return grid.select("*", around).select(*grid.columns, (F.col("row") + F.col("o.dr")).alias("nrow"), (F.col("col") + F.col("o.dc")).alias("ncol")).drop("o")


def _apart(a: str, b: str):
    return F.sqrt(F.expr(f"aggregate(zip_with({a}, {b}, (p, q) -> (p - q) * (p - q)), 0D, (s, v) -> s + v)"))


def umatrix(book: DataFrame) -> DataFrame:
    """Mean distance of each neuron's weights to its neighbours'; 0 without any."""
    other = book.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("w").alias("nw"))
    joined = neighbours(book).join(other, ["nrow", "ncol"], "left")
    return joined.groupBy("neuron", "row", "col").agg(F.coalesce(F.avg(_apart("w", "nw")), F.lit(0.0)).alias("u"))


def hit_and_error_map(assigned: DataFrame, grid: DataFrame) -> DataFrame:
    """Of each neuron the rows it wins and their mean error, each over the largest of all neurons."""
    found = assigned.groupBy(F.col("bmu").alias("neuron")).agg(F.count("*").alias("hits"), F.avg("dist").alias("error"))
    whole = grid.select("neuron").join(found, "neuron", "left").na.fill(0, ["hits"]).na.fill(0.0, ["error"])
    every = W.partitionBy(F.lit(1))
    over = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.max(c).over(every)), F.lit(0.0))
    return whole.select("neuron", "hits", over("hits").alias("frequency"), over("error").alias("quantization"))


def label_places(assigned: DataFrame, label: str = "label", order: str = "row_id") -> DataFrame:
    """(neuron, place, label): each neuron's labels numbered from 0 in row order, a row for each; for maps whose neurons
    win more rows than one list should hold."""
    rows = assigned.select(F.col("bmu").alias("neuron"), F.col(order).alias("order"), F.col(label).alias("label"))
    return ranked(rows, "order", "place", "neuron").select("neuron", "place", "label")


def mapped_labels(assigned: DataFrame, label: str = "label", order: str = "row_id") -> DataFrame:
    """Each neuron's labels in row order."""
    kept = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(label)))), lambda s: s.getField(label))
    return assigned.groupBy(F.col("bmu").alias("neuron")).agg(kept.alias("labels"))


def visible_labels(assigned: DataFrame, query: str = "", excluded: DataFrame | None = None, most: int = 10, label: str = "label", order: str = "row_id") -> DataFrame:
    """The first ``most`` labels of each neuron that hold the query and are not excluded."""
    found = assigned.filter(F.contains(F.lower(F.col(label)), F.lit(query.lower()))) if query else assigned
    if excluded is not None:
        found = found.join(excluded.select(label).distinct(), label, "left_anti")
    ranked = found.withColumn("rn", F.row_number().over(W.partitionBy("bmu").orderBy(order)))
    return ranked.filter(F.col("rn") <= most).drop("rn")


def move_label(assigned: DataFrame, name: str, to: int, label: str = "label") -> DataFrame:
    """Every row that bears a label goes to another neuron."""
    return assigned.withColumn("bmu", F.when(F.col(label) == name, F.lit(to)).otherwise(F.col("bmu")))


def component_plane(book: DataFrame, k: int) -> DataFrame:
    return book.select("neuron", "row", "col", F.element_at("w", k + 1).alias("value"))


def cluster_borders(grid: DataFrame, clusters: DataFrame) -> DataFrame:
    """(neuron, nrow, ncol): sides to a place outside the grid or to a neuron of another cluster."""
    own = grid.join(clusters, "neuron")
    other = own.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("cluster").alias("ncluster"))
    joined = neighbours(own).join(other, ["nrow", "ncol"], "left")
    return joined.filter("ncluster IS NULL OR ncluster <> cluster").select("neuron", "nrow", "ncol")


def clustered_rows(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """The rows with the cluster of their best-matching unit."""
    return assigned.join(F.broadcast(clusters.select(F.col("neuron").alias("bmu"), "cluster")), "bmu")


@dataclass
class Som:
    """A trained map; its tables are lazy."""

    config: SomConfig
    weights: np.ndarray
    errors: list[float]
    neurons: DataFrame
    assignments: DataFrame
    umatrix: DataFrame
    maps: DataFrame
    clusters: DataFrame
    extras: dict[str, DataFrame] = field(default_factory=dict)


def train(data: DataFrame, config: SomConfig = SomConfig(), weights: np.ndarray | None = None) -> Som:
    """data: (row_id, label, features)."""
    from cartoflux.operators.clustering import cluster_codebook

    c, spark = config, data.sparkSession
    start = init_weights(data, c.rows, c.cols, c.init, c.seed) if weights is None else weights
    if c.method == "batch":
        found, errors = train_batch(data, start, c.rows, c.cols, c.iterations, c.metric)
    else:
        found, errors = train_online(data, start, c.rows, c.cols, c.iterations, c.learning_rate, c.metric, c.seed)
    neurons = codebook(spark, found, c.rows, c.cols)
    assigned = assign(data, found, c.metric)
    clusters = cluster_codebook(spark, found, c.clustering, c.n_clusters, c.eps, c.min_samples)
    return Som(c, found, errors, neurons, assigned, umatrix(neurons), hit_and_error_map(assigned, neurons), clusters, {"labels": mapped_labels(assigned)})
