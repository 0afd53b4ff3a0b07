"""From a file to a map: the actions of the tool as functions over DataFrames.

    kind, records = studio.read(spark, "export.ris")
    made = studio.preprocess(records, kind, max_terms=50)
    som = studio.train(studio.rows_of(made))
    studio.recluster(som, "ward", k=5); studio.evaluate(som); studio.estimate(rows, "TwoNN"); studio.reduce(rows)

Tables stay lazy; a number or a map of bounded size comes back as itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoflux.operators import clustering, neighbours, network, som
from cartoflux.sources import bibliographic, matrices

#: Networks of one mode by the list that a record has for them.
ONE_MODE = {"co-occurrence": "terms", "co-authorship": "authors", "co-citation": "refs"}


@dataclass
class Directed:
    """Nodes and edges of a network whose edges join two kinds of nodes, or papers."""

    nodes: DataFrame
    edges: DataFrame


def status(spark: SparkSession) -> dict[str, str]:
    """What runs the work."""
    return {"spark": spark.version, "master": spark.sparkContext.master, "parallelism": str(spark.sparkContext.defaultParallelism)}


def read(spark: SparkSession, path: str, tag: str = "DE") -> tuple[str, DataFrame]:
    """(format, records) of an export."""
    return bibliographic.read_records(spark, path, tag)


def preprocess(records: DataFrame, kind: str, network_type: str = "co-occurrence", max_terms: int = 100, min_weight: int = 2, temporal: bool = False) -> network.Network | Directed:
    """The network that is asked for, of the most frequent terms; networks that a format has no fields for are an error.

    A temporal network has the edges and matrices of each year of the records too."""
    network.check_capability(kind, network_type)
    dated = records.withColumn("year", F.when(F.col("year").rlike("^[0-9]{4}$"), F.col("year").cast("int")))
    if network_type in ONE_MODE:
        return network.build(network.doc_terms(dated, ONE_MODE[network_type], "year"), max_terms, min_weight, temporal)
    if network_type == "bipartite":
        nodes, edges = network.bipartite(network.doc_terms(dated, "authors"), network.doc_terms(dated, "terms"), "AU", "DE")
        return Directed(*network.filter_bipartite(nodes, edges, "DE", max_terms, min_weight))
    refs = network.doc_terms(dated, "refs")
    edges = network.citation(refs) if network_type == "citation" else network.coupling(refs, min_weight)
    ends = edges.select(F.col("source").alias("term")).unionByName(edges.select(F.col("target").alias("term")))
    return Directed(ends.groupBy("term").agg(F.count("*").alias("frequency")), edges)


def rows_of(made: network.Network) -> DataFrame:
    """(row_id, label, features) for a map: a row for each term of the network, or of a temporal one for each year and
    term, with a component for each kept term in alphabetical order."""
    cells = made.by_year["stack"].select("label", "col_term", "w") if made.by_year else made.adjacency.select(F.col("row_term").alias("label"), "col_term", "w")
    names = made.nodes.agg(F.sort_array(F.collect_list("term")).alias("names"))  # at most max_terms
    summed = cells.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("col_term", F.col("w").cast("double")))).alias("of"))
    features = F.transform("names", lambda n: F.coalesce(F.try_element_at("of", n), F.lit(0.0)))
    return summed.join(F.broadcast(names), F.lit(True)).select(F.xxhash64("label").alias("row_id"), "label", features.alias("features"))


def read_matrix(spark: SparkSession, path: str, label_index: int = 0, ignore: tuple[int, ...] = (), sep: str = ",") -> tuple[DataFrame, list[str]]:
    return matrices.read_profile(spark, path, label_index, ignore, sep)


def train(rows: DataFrame, config: som.SomConfig = som.SomConfig()) -> som.Som:
    """A map of (row_id, label, features)."""
    return som.train(rows, config)


def evaluate(made: som.Som, rows: DataFrame, most: int = 15) -> list[dict]:
    """Quality of k = 2 .. ``most`` clusters of the map's neurons."""
    return clustering.quality_sweep(_neurons(made, rows), most)


def recluster(made: som.Som, rows: DataFrame, algorithm: str = "dbscan", k: int = 4, eps: float = 0.5, min_samples: int = 3) -> DataFrame:
    """(neuron, cluster) of a trained map, clustered anew."""
    return clustering.cluster_codebook(rows.sparkSession, made.weights, algorithm, k, eps, min_samples)


def _neurons(made: som.Som, rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([(m, w.tolist()) for m, w in enumerate(made.weights)], "id long, features array<double>")


def map_points(made: som.Som, rows: DataFrame, component: int, source: str = "data", n_neighbors: int = 15, min_dist: float = 0.1) -> DataFrame:
    """(id, x, y, value, label) on a plane: of the rows with their own labels, or of the neurons with the labels of the
    rows that they win; ``value`` is a component of what is shown. Values that are no number are left out."""
    if source not in ("data", "weights"):
        raise ValueError(f"unknown source {source}; data or weights")
    if source == "data":
        points, labels = rows.select(F.col("row_id").alias("id"), "features"), rows.select(F.col("row_id").alias("id"), "label")
    else:
        points = _neurons(made, rows)
        labels = som.mapped_labels(made.assignments).select(F.col("neuron").cast("long").alias("id"), F.array_join("labels", ", ").alias("label"))
    placed = neighbours.umap(points, 2, n_neighbors, min_dist, "euclidean")
    shown = placed.join(points, "id").join(labels, "id", "left")
    value = F.try_element_at("features", F.lit(component + 1))
    return shown.select("id", F.col("scores")[0].alias("x"), F.col("scores")[1].alias("y"), value.alias("value"), F.coalesce("label", F.lit("")).alias("label")).filter("value IS NOT NULL AND NOT isnan(value)")


def estimate(rows: DataFrame, name: str | None = None, k: int = 20) -> dict[str, float]:
    """The intrinsic dimension by a named estimator; without a name the percentiles of the pointwise estimates, of which
    the 95th is recommended."""
    points = rows.select(F.col("row_id").alias("id"), "features")
    if name:
        return {"dimension": neighbours.estimate_dimension(points, name, k)}
    found = neighbours.ceiling_dimension(neighbours.pointwise_mle(neighbours.knn(points, k), k)).first().asDict()
    return {"dimension": found["p95"], **found}


def reduce(rows: DataFrame, target: int | None = None, estimated: float | None = None, manual: bool = False) -> DataFrame:
    """(row_id, label, features) on as many principal axes as are asked for, or were estimated."""
    points = rows.select(F.col("row_id").alias("id"), "features")
    width = len(points.first()["features"])
    scores = neighbours.pca(points, neighbours.target_dimension(width, target, estimated, manual))
    return rows.select("row_id", "label").join(scores.withColumnsRenamed({"id": "row_id", "scores": "features"}), "row_id")
