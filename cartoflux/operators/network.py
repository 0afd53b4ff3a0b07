"""Bibliometric networks: co-occurrence, co-authorship, co-citation, citation, coupling and two-mode, over all
documents and by year, with their matrices in long form.

The core table is doc_term (doc_id, term[, year]), one row for each term of a document. Matrices stay long
(row, column, value); ``pivoted`` makes the wide form for an export. Nodes are cut to the most frequent
*before* pairs are made: the induced subgraph's edges only need the kept terms of each document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflux.functions.text import title_case

#: Up to so many kept terms their list is broadcast; beyond it is joined.
BROADCAST_TERMS = 100_000

ALL = ("co-occurrence", "co-authorship", "co-citation", "citation", "bibliographic-coupling", "bipartite")
CAPABILITIES = {"ris": ALL[:2], "scopus": (*ALL[:2], "bipartite"), "tagged": ALL}


class UnsupportedNetwork(ValueError):
    """A network that a source's records don't carry."""


def check_capability(source: str, network: str) -> None:
    if network not in CAPABILITIES[source]:
        raise UnsupportedNetwork(f"{source} records support {', '.join(CAPABILITIES[source])}; not {network}")


def doc_terms(records: DataFrame, terms: str, *keep: str) -> DataFrame:
    """One row for each distinct term in the array column ``terms`` of each record; arrays are deduplicated
    in place, so nothing is shuffled."""
    return records.select("doc_id", *keep, F.explode(F.array_distinct(terms)).alias("term"))


def document_frequency(dt: DataFrame, *by: str) -> DataFrame:
    return dt.groupBy(*by, "term").agg(F.count("*").alias("frequency"))


def top_terms(nodes: DataFrame, k: int) -> DataFrame:
    """The k most frequent; of equals the first in order of the term."""
    return nodes.orderBy(F.desc("frequency"), "term").limit(k)


def _small(kept: DataFrame, k: int) -> DataFrame:
    return F.broadcast(kept) if k <= BROADCAST_TERMS else kept


def restrict(dt: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    return dt.join(_small(kept.select("term"), k), "term", "left_semi")


def cooccurrence(dt: DataFrame, *by: str) -> DataFrame:
    """Unordered pairs of terms with the number of documents that have both: (source, target, weight)."""
    keys = ["doc_id", *by]
    a = dt.select(*keys, F.col("term").alias("source"))
    b = dt.select(*keys, F.col("term").alias("target"))
    return a.join(b, keys).filter("source < target").groupBy(*by, "source", "target").agg(F.count("*").alias("weight"))


def cooccurrence_sets(dt: DataFrame) -> DataFrame:
    """(year, yearly, source, target, weight): the pairs of all documents (yearly false, year null) and those of each
    year (yearly true, a null year left out), from one shuffle: each pair is counted for both sets where it is made."""
    a = dt.select("doc_id", "year", F.col("term").alias("source"))
    b = dt.select("doc_id", F.col("term").alias("target"), F.col("year").alias("other"))
    pairs = a.join(b, "doc_id").filter(F.col("year").eqNullSafe(F.col("other")) & (F.col("source") < F.col("target")))
    sets = pairs.groupingSets([("source", "target"), ("year", "source", "target")], "year", "source", "target").agg(F.grouping("year").alias("all"), F.count("*").alias("weight"))
    return sets.filter("all = 1 OR year IS NOT NULL").select("year", (F.col("all") == 0).alias("yearly"), "source", "target", "weight")


def threshold(edges: DataFrame, least: int) -> DataFrame:
    return edges.filter(F.col("weight") >= least)


def citation(refs: DataFrame) -> DataFrame:
    """Directed edges from a paper to what it cites; refs: (doc_id, term)."""
    return refs.groupBy(F.col("doc_id").cast("string").alias("source"), F.col("term").alias("target")).agg(F.lit(1).cast("long").alias("weight"))


#: Citing papers of one reference that meet the others in one task.
SALTED = 1000


def coupling(refs: DataFrame, least: int = 1) -> DataFrame:
    """Pairs of papers with the number of references they share. The papers that cite a reference more than SALTED
    times are dealt to salts by their number, and each part meets all of them, so a much cited one is spread over many
    tasks; the others, nearly all, have one salt and are met by no list but that of the much cited."""
    much = refs.groupBy("term").count().filter(F.col("count") > SALTED).select("term", F.ceil(F.col("count") / SALTED).cast("int").alias("many"))
    rows = refs.join(much, "term", "left").withColumn("salts", F.coalesce("many", F.lit(1)))
    a = rows.select("term", F.col("doc_id").alias("source"), F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"))
    b = rows.select("term", F.col("doc_id").alias("target"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return a.join(b, ["term", "salt"]).filter("source < target").groupBy("source", "target").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)


def bipartite(dt1: DataFrame, dt2: DataFrame, tag1: str, tag2: str, *by: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a two-mode network. A string in both modes is one node, of the second mode."""
    keys = ["doc_id", *by]
    edges = (
        dt1.select(*keys, F.col("term").alias("source"))
        .join(dt2.select(*keys, F.col("term").alias("target")), keys)
        .groupBy(*by, "source", "target")
        .agg(F.count("*").alias("weight"))
    )
    first = document_frequency(dt1).withColumn("type", F.lit(tag1))
    second = document_frequency(dt2).withColumn("type", F.lit(tag2))
    nodes = first.join(second.select("term"), "term", "left_anti").unionByName(second)
    return nodes, edges


def filter_bipartite(nodes: DataFrame, edges: DataFrame, tag2: str, k: int, least: int) -> tuple[DataFrame, DataFrame]:
    """The k most frequent of the second mode, what has an edge of at least ``least`` to them, those edges."""
    kept = top_terms(nodes.filter(F.col("type") == tag2), k)
    edges = threshold(edges, least).join(_small(kept.select(F.col("term").alias("target")), k), "target", "left_semi").select("source", "target", "weight")
    linked = nodes.filter(F.col("type") != tag2).join(edges.select(F.col("source").alias("term")), "term", "left_semi")
    return linked.unionByName(kept.select(linked.columns)), edges


def adjacency(nodes: DataFrame, edges: DataFrame, *by: str) -> DataFrame:
    """Symmetric cells (row_term, col_term, w), the diagonal holding the document frequency."""
    there = edges.select(*by, F.col("source").alias("row_term"), F.col("target").alias("col_term"), F.col("weight").alias("w"))
    back = edges.select(*by, F.col("target").alias("row_term"), F.col("source").alias("col_term"), F.col("weight").alias("w"))
    own = nodes.select(*by, F.col("term").alias("row_term"), F.col("term").alias("col_term"), F.col("frequency").alias("w"))
    return there.unionByName(back).unionByName(own)


def incidence(edges: DataFrame, *by: str) -> DataFrame:
    return edges.select(*by, F.col("source").alias("row_term"), F.col("target").alias("col_term"), F.col("weight").alias("w"))


def doc_term_matrix(dt: DataFrame, kept: DataFrame, k: int, documents: DataFrame | None = None) -> DataFrame:
    """Cells (doc_id, term, w = 1); with ``documents`` those without a kept term have one cell of a null term."""
    cells = restrict(dt, kept, k).select("doc_id", "term", F.lit(1).cast("long").alias("w"))
    return cells if documents is None else documents.select("doc_id").join(cells, "doc_id", "left").withColumn("w", F.coalesce("w", F.lit(0)))


def temporal_stack(dt: DataFrame, kept: DataFrame, k: int, least: int, edges: DataFrame | None = None) -> DataFrame:
    """For each year and pair of kept terms a cell (label "<year>_<term>", col_term, w): that year's document
    frequency on the diagonal, its weight of at least ``least`` elsewhere, else 0. ``edges`` may give the yearly
    edges where they have been made."""
    own = restrict(dt, kept, k)
    yearly = threshold(cooccurrence(own, "year"), least) if edges is None else edges
    cells = adjacency(document_frequency(own, "year"), yearly, "year")
    # the spine is the result's own size: years x terms x terms
    listed = kept.agg(F.collect_list("term").alias("terms"))
    spine = (
        dt.select("year").distinct().join(F.broadcast(listed), F.lit(True))
        .select("year", F.explode("terms").alias("row_term"), "terms")
        .select("year", "row_term", F.explode("terms").alias("col_term"))
    )
    full = spine.join(cells, ["year", "row_term", "col_term"], "left")
    return full.select("year", F.concat_ws("_", F.col("year").cast("string"), "row_term").alias("label"), "row_term", "col_term", F.coalesce("w", F.lit(0)).alias("w"))


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("term")).unionByName(edges.select(F.col("target").alias("term")))
    return nodes.join(ends, "term", "left_semi")


def display_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("label", title_case(F.col("term")))


def pivoted(cells: DataFrame, row: str, column: str, value: str, columns: list[str] | None = None) -> DataFrame:
    """The wide form for an export, rows and columns sorted, empty cells 0."""
    return cells.groupBy(row).pivot(column, columns).agg(F.first(value)).na.fill(0).orderBy(row)


@dataclass
class Network:
    """Lazy tables of one network; ``by_year`` holds year-keyed nodes, edges and the stacked matrix."""

    documents: DataFrame
    nodes: DataFrame
    edges: DataFrame
    adjacency: DataFrame
    frequency: DataFrame
    by_year: dict[str, DataFrame] = field(default_factory=dict)

    def document_count(self) -> int:
        return self.documents.count()


def build(dt: DataFrame, max_terms: int = 100, min_weight: int = 2, temporal: bool = False) -> Network:
    """A one-mode network of the most frequent terms. Isolated nodes stay. A temporal one has its edges, those of each
    year and the stacked matrix from the same grouping sets."""
    nodes = top_terms(document_frequency(dt), max_terms)
    own = restrict(dt, nodes, max_terms)
    sets = threshold(cooccurrence_sets(own), min_weight) if temporal else None
    edges = sets.filter("NOT yearly").select("source", "target", "weight") if temporal else threshold(cooccurrence(own), min_weight)
    made = Network(dt.select("doc_id").distinct(), nodes, edges, adjacency(nodes, edges), doc_term_matrix(dt, nodes, max_terms))
    if temporal:
        yearly = own.filter(F.col("year").isNotNull())
        of_year = sets.filter("yearly").select("year", "source", "target", "weight")
        made.by_year = {
            "sets": sets,
            "nodes": document_frequency(yearly, "year"),
            "edges": of_year,
            "stack": temporal_stack(dt.filter(F.col("year").isNotNull()), nodes, max_terms, min_weight, of_year),
        }
        made.frequency = made.by_year["stack"]
    return made
