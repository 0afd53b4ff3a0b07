"""Network and matrix queries, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflux.functions import text
from cartoflux.operators import network as net
from cartoflux.operators import normalize as norm
from cartoflux.plans import tables as t

QUERIES: dict = {}
SQL: dict = {}

K, LEAST = 15, 2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BRANDS = """brands AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(year(o_orderdate) AS INT) AS year, lower(p_brand) AS term
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""
AUTHORS = """authors AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(year(o_orderdate) AS INT) AS year, lower(s_name) AS term
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey)"""
REFS = "refs AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS term FROM lineitem)"


def _network(table: str, k: int, least: int) -> str:
    return f"""df AS (SELECT term, count(*) AS frequency FROM {table} GROUP BY term),
  nodes AS (SELECT * FROM df ORDER BY frequency DESC, term LIMIT {k}),
  pairs AS (SELECT a.term AS source, b.term AS target, count(*) AS weight FROM {table} a JOIN {table} b ON a.doc_id = b.doc_id AND a.term < b.term
    GROUP BY 1, 2),
  edges AS (SELECT * FROM pairs WHERE weight >= {least} AND source IN (SELECT term FROM nodes) AND target IN (SELECT term FROM nodes))"""


BRAND_NET = f"WITH {BRANDS}, {_network('brands', K, LEAST)}"
ADJACENCY = """cells AS (SELECT source AS row_term, target AS col_term, weight AS w FROM edges UNION ALL SELECT target, source, weight FROM edges
  UNION ALL SELECT term, term, frequency FROM nodes)"""


def _brand_net(spark, sf, temporal=False):
    return net.build(t.brand_terms(spark, sf), K, LEAST, temporal)


@query(f"WITH {BRANDS} SELECT term, count(*) AS frequency FROM brands GROUP BY term")
def doc_frequency(spark, sf):
    return net.document_frequency(t.brand_terms(spark, sf))


@query(f"{BRAND_NET} SELECT * FROM nodes")
def top_terms(spark, sf):
    return net.top_terms(net.document_frequency(t.brand_terms(spark, sf)), K)


@query(f"{BRAND_NET} SELECT * FROM edges")
def cooccurrence_edges(spark, sf):
    return _brand_net(spark, sf).edges


@query(f"{BRAND_NET}, {ADJACENCY} SELECT * FROM cells")
def adjacency_long(spark, sf):
    return _brand_net(spark, sf).adjacency


@query(f"WITH {AUTHORS}, {_network('authors', 40, 1)} SELECT * FROM edges")
def coauthorship_edges(spark, sf):
    return net.build(t.author_terms(spark, sf), 40, 1).edges


@query(f"WITH {REFS}, {_network('refs', 100, 1)} SELECT * FROM edges")
def cocitation_edges(spark, sf):
    return net.build(t.reference_terms(spark, sf), 100, 1).edges


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS source, CAST(l_partkey AS VARCHAR) AS target, CAST(1 AS BIGINT) AS weight FROM lineitem")
def citation_edges(spark, sf):
    return net.citation(t.reference_terms(spark, sf))


@query(f"""WITH {REFS} SELECT a.doc_id AS source, b.doc_id AS target, count(*) AS weight FROM refs a JOIN refs b
  ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def bib_coupling(spark, sf):
    return net.coupling(t.reference_terms(spark, sf), 2)


TWO_MODE = f"""WITH {AUTHORS}, {BRANDS}, edges AS (SELECT a.term AS source, b.term AS target, count(*) AS weight
  FROM authors a JOIN brands b ON a.doc_id = b.doc_id GROUP BY 1, 2),
  first AS (SELECT term, count(*) AS frequency, 'AU' AS type FROM authors GROUP BY term),
  second AS (SELECT term, count(*) AS frequency, 'DE' AS type FROM brands GROUP BY term),
  nodes AS (SELECT * FROM first WHERE term NOT IN (SELECT term FROM second) UNION ALL SELECT * FROM second),
  kept2 AS (SELECT * FROM second ORDER BY frequency DESC, term LIMIT 10),
  kept_edges AS (SELECT * FROM edges WHERE weight >= 5 AND target IN (SELECT term FROM kept2)),
  kept_nodes AS (SELECT * FROM nodes WHERE type = 'AU' AND term IN (SELECT source FROM kept_edges) UNION ALL SELECT * FROM kept2)"""


def _two_mode(spark, sf):
    return net.bipartite(t.author_terms(spark, sf), t.brand_terms(spark, sf), "AU", "DE")


@query(f"{TWO_MODE} SELECT * FROM edges")
def bipartite_edges(spark, sf):
    return _two_mode(spark, sf)[1]


@query(f"{TWO_MODE} SELECT * FROM nodes")
def bipartite_nodes(spark, sf):
    return _two_mode(spark, sf)[0].select("term", "frequency", "type")


@query(f"{TWO_MODE} SELECT * FROM kept_edges")
def bipartite_kept_edges(spark, sf):
    return net.filter_bipartite(*_two_mode(spark, sf), "DE", 10, 5)[1]


@query(f"{TWO_MODE} SELECT * FROM kept_nodes")
def bipartite_kept_nodes(spark, sf):
    return net.filter_bipartite(*_two_mode(spark, sf), "DE", 10, 5)[0].select("term", "frequency", "type")


@query(f"{TWO_MODE} SELECT source AS row_term, target AS col_term, weight AS w FROM edges")
def bipartite_incidence(spark, sf):
    return net.incidence(_two_mode(spark, sf)[1])


@query(f"""WITH {AUTHORS}, {BRANDS} SELECT a.year, a.term AS row_term, b.term AS col_term, count(*) AS w
  FROM authors a JOIN brands b ON a.doc_id = b.doc_id GROUP BY 1, 2, 3""")
def temporal_incidence(spark, sf):
    edges = net.bipartite(t.author_terms(spark, sf), t.brand_terms(spark, sf), "AU", "DE", "year")[1]
    return net.incidence(edges, "year")


@query(f"{BRAND_NET} SELECT doc_id, term, CAST(1 AS BIGINT) AS w FROM brands WHERE term IN (SELECT term FROM nodes)")
def doc_term_matrix(spark, sf):
    return _brand_net(spark, sf).frequency


@query(f"""{BRAND_NET} SELECT o_orderkey AS doc_id, term, CASE WHEN term IS NULL THEN 0 ELSE 1 END::BIGINT AS w FROM orders
  LEFT JOIN (SELECT * FROM brands WHERE term IN (SELECT term FROM nodes)) k ON o_orderkey = doc_id""")
def doc_term_matrix_all(spark, sf):
    dt = t.brand_terms(spark, sf)
    docs = t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return net.doc_term_matrix(dt, net.top_terms(net.document_frequency(dt), K), K, docs)


YEARLY = """own AS (SELECT * FROM brands WHERE term IN (SELECT term FROM nodes)),
  ynodes AS (SELECT year, term, count(*) AS frequency FROM own GROUP BY 1, 2),
  yedges AS (SELECT a.year, a.term AS source, b.term AS target, count(*) AS weight FROM own a JOIN own b
    ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY 1, 2, 3 HAVING count(*) >= 2),
  ycells AS (SELECT year, source AS row_term, target AS col_term, weight AS w FROM yedges UNION ALL SELECT year, target, source, weight FROM yedges
    UNION ALL SELECT year, term, term, frequency FROM ynodes)"""


@query(f"{BRAND_NET}, {YEARLY} SELECT * FROM ynodes")
def yearly_nodes(spark, sf):
    return _brand_net(spark, sf, True).by_year["nodes"]


@query(f"{BRAND_NET}, {YEARLY} SELECT * FROM yedges")
def yearly_edges(spark, sf):
    return _brand_net(spark, sf, True).by_year["edges"]


@query(f"{BRAND_NET}, {YEARLY} SELECT source, target, weight FROM yedges WHERE year = 1996")
def year_selected(spark, sf):
    return _brand_net(spark, sf, True).by_year["edges"].filter("year = 1996").select("source", "target", "weight")


@query(f"{BRAND_NET}, {YEARLY} SELECT year, true AS yearly, source, target, weight FROM yedges UNION ALL SELECT NULL, false, source, target, weight FROM edges")
def edge_sets(spark, sf):
    """The edges of all years and of each, from one pair table."""
    return _brand_net(spark, sf, True).by_year["sets"]


@query(f"""{BRAND_NET}, {YEARLY} SELECT y.year, y.year || '_' || a.term AS label, a.term AS row_term, b.term AS col_term, coalesce(w, 0)::BIGINT AS w
  FROM (SELECT DISTINCT year FROM brands) y CROSS JOIN nodes a CROSS JOIN nodes b
  LEFT JOIN ycells c ON c.year = y.year AND c.row_term = a.term AND c.col_term = b.term""")
def temporal_stack(spark, sf):
    return _brand_net(spark, sf, True).by_year["stack"]


@query(f"""WITH {REFS}, {_network('refs', 100, 1)} SELECT term, frequency FROM nodes
  WHERE term IN (SELECT source FROM edges UNION SELECT target FROM edges)""")
def connected_nodes(spark, sf):
    made = net.build(t.reference_terms(spark, sf), 100, 1)
    return net.connected_nodes(made.nodes, made.edges).select("term", "frequency")


@query(f"""{BRAND_NET} SELECT term, upper(term[1]) || term[2:] AS label, least(greatest(sqrt(frequency) * 3 + 4, 6.0), 30.0) AS radius FROM nodes""")
def node_display(spark, sf):
    nodes = net.display_nodes(_brand_net(spark, sf).nodes)
    return nodes.select("term", "label", text.node_radius(F.col("frequency")).alias("radius"))


@query(f"{BRAND_NET} SELECT source, target, least(greatest(sqrt(weight) * 1.5, 1.0), 6.0) AS width FROM edges")
def link_display(spark, sf):
    return _brand_net(spark, sf).edges.select("source", "target", text.link_width(F.col("weight")).alias("width"))


# normalisations

EVENT_CELLS = """rows0 AS (SELECT user_id AS entity, CAST(ts AS DATE) AS day, event_type, value FROM events),
  keys AS (SELECT DISTINCT entity, day, entity * 100 + day(day) AS row_id FROM rows0),
  cells AS (SELECT CAST(k.row_id AS BIGINT) AS row_id, k.entity, c.component, coalesce(sum(r.value), 0.0) AS value FROM keys k
    CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) c(component)
    LEFT JOIN rows0 r ON r.entity = k.entity AND r.day = k.day AND r.event_type = c.component GROUP BY ALL)"""


def _component_query(kind: str, formula: str):
    def run(spark, sf):
        return norm.normalise(t.event_cells(spark, sf), kind, "csv").withColumn("value", F.round("value", 6))

    run.__name__ = f"norm_{kind}"
    query(f"""WITH {EVENT_CELLS}, st AS (SELECT component, max(value) AS hi, min(value) AS lo, avg(value) AS mid, stddev_pop(value) AS dev FROM cells GROUP BY 1)
      SELECT row_id, entity, component, round({formula}, 6) AS value FROM cells JOIN st USING (component)""")(run)


_component_query("div_max", "value / CASE WHEN hi = 0 THEN 1 ELSE hi END")
_component_query("min_max", "(value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END")
_component_query("z_score", "(value - mid) / CASE WHEN dev = 0 THEN 1 ELSE dev END")


@query(f"WITH {EVENT_CELLS} SELECT row_id, component, kind, round(value, 6) + 0.0 AS value FROM cells, (VALUES ('div_max'), ('min_max'), ('z_score')) k(kind)")
def norm_reverted(spark, sf):
    """Each normalisation and back: the original values."""
    cells = t.event_cells(spark, sf).select("row_id", "component", "value")
    back = [norm.inverse_components(norm.normalise_components(cells, kind), cells, kind).withColumn("kind", F.lit(kind)) for kind in norm.COMPONENT]
    return reduce(DataFrame.union, back).select("row_id", "component", "kind", (F.round("value", 6) + 0.0).alias("value"))


def _cooc_query(kind: str, divisor: str):
    def run(spark, sf):
        return norm.normalise(_brand_net(spark, sf).adjacency, kind, "monothematic").withColumn("value", F.round("value", 9))

    run.__name__ = f"norm_{kind}"
    query(f"""{BRAND_NET}, {ADJACENCY}, d AS (SELECT row_term AS term, w::DOUBLE AS d FROM cells WHERE row_term = col_term),
      u AS (SELECT c.row_term, c.col_term, w::DOUBLE / ({divisor}) AS value FROM cells c JOIN d x ON c.row_term = x.term JOIN d y ON c.col_term = y.term
        WHERE c.row_term < c.col_term)
      SELECT row_term, col_term, round(value, 9) AS value FROM (SELECT * FROM u UNION ALL SELECT col_term, row_term, value FROM u UNION ALL SELECT term, term, 1.0 FROM d)""")(run)


_cooc_query("cooc_cosine", "sqrt(x.d * y.d)")
_cooc_query("cooc_association", "x.d * y.d")
_cooc_query("cooc_jaccard", "x.d + y.d - w")
_cooc_query("cooc_inclusion", "least(x.d, y.d)")


def _two_mode_query(kind: str, divisor: str):
    def run(spark, sf):
        return norm.normalise(net.incidence(_two_mode(spark, sf)[1]), kind, "bipartite").withColumn("value", F.round("value", 9))

    run.__name__ = f"norm_{kind}"
    query(f"""{TWO_MODE}, c AS (SELECT source AS row_term, target AS col_term, weight, sum(weight) OVER (PARTITION BY source) AS r,
        sum(weight) OVER (PARTITION BY target) AS k FROM edges)
      SELECT row_term, col_term, round(weight / ({divisor})::DOUBLE, 9) AS value FROM c""")(run)


_two_mode_query("bipartite_row", "r")
_two_mode_query("bipartite_col", "k")
_two_mode_query("bipartite_sym", "sqrt(r::DOUBLE * k::DOUBLE)")

NATION_CELLS = """raw AS (SELECT CAST(year(o_orderdate) AS INT) AS year, n_name AS label, count(*)::DOUBLE AS orders, round(sum(o_totalprice), 2) AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
  cells AS (SELECT year, label, 'orders' AS component, orders AS value FROM raw UNION ALL SELECT year, label, 'price', price FROM raw)"""


@query(f"""WITH {NATION_CELLS} SELECT year || '_' || label AS label, component,
  round((value - min(value) OVER w) / CASE WHEN max(value) OVER w = min(value) OVER w THEN 1 ELSE max(value) OVER w - min(value) OVER w END, 6) AS value
  FROM cells WINDOW w AS (PARTITION BY year, component)""")
def per_year_norm(spark, sf):
    made = norm.normalise(t.nation_cells(spark, sf), "min_max", "csv", ["year"])
    return made.select(F.concat_ws("_", F.col("year").cast("string"), "label").alias("label"), "component", F.round("value", 6).alias("value"))


@query(f"""WITH {EVENT_CELLS}, r AS (SELECT component, value, row_number() OVER (PARTITION BY component ORDER BY value) AS rn,
    count(*) OVER (PARTITION BY component) AS n FROM cells)
  SELECT component, round(min(value), 6) AS lo, round(max(CASE WHEN rn = floor(n * 0.25) + 1 THEN value END), 6) AS q1,
    round(max(CASE WHEN rn = floor(n * 0.5) + 1 THEN value END), 6) AS median,
    round(max(CASE WHEN rn = floor(n * 0.75) + 1 THEN value END), 6) AS q3, round(max(value), 6) AS hi FROM r GROUP BY component""")
def five_numbers(spark, sf):
    found = norm.five_numbers(t.event_cells(spark, sf))
    return found.select("component", *[F.round(c, 6).alias(c) for c in ("lo", "q1", "median", "q3", "hi")])


@query(f"WITH {EVENT_CELLS} SELECT component, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean FROM cells GROUP BY 1")
def component_stats(spark, sf):
    found = norm.component_statistics(t.event_cells(spark, sf))
    return found.select("component", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "mean")])


@query(f"""WITH {EVENT_CELLS}, r AS (SELECT component, value, row_number() OVER (PARTITION BY component ORDER BY value) AS rn,
    count(*) OVER (PARTITION BY component) AS n, min(value) OVER (PARTITION BY component) AS lo, max(value) OVER (PARTITION BY component) AS hi FROM cells),
  d AS (SELECT component, max(CASE WHEN rn = floor(n * 0.02) + 1 THEN value END) AS a, max(CASE WHEN rn = floor(n * 0.98) + 1 THEN value END) AS b,
    min(lo) AS lo, max(hi) AS hi FROM r GROUP BY component)
  SELECT component, round(CASE WHEN a = b THEN lo ELSE a END, 6) AS low, round(CASE WHEN a = b THEN hi ELSE b END, 6) AS high FROM d""")
def colour_domain(spark, sf):
    found = norm.colour_domain(t.event_cells(spark, sf))
    return found.select("component", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT vec_id AS row_id, label::VARCHAR AS label FROM embeddings ORDER BY vec_id LIMIT 5")
def data_preview(spark, sf):
    return norm.preview(t.vectors(spark, sf).select("row_id", "label"), "row_id", 5, 10)
