"""Queries on series, maps, clusters and neighbours, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartoflux.functions import colours, text
from cartoflux.operators import clustering, descent, neighbours, som, temporal
from cartoflux.plans import tables as t
from cartoflux.plans.network_queries import EVENT_CELLS

QUERIES: dict = {}
SQL: dict = {}

ROWS, COLS = t.GRID
M = ROWS * COLS


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# series

LABELS = "labels AS (SELECT DISTINCT CASE user_id % 5 WHEN 0 THEN '2024_' || user_id || '_x' WHEN 1 THEN 'u' || user_id || '_2024' WHEN 2 THEN user_id || '_' || event_type WHEN 3 THEN event_type ELSE '_' || event_type END AS label FROM events)"


def _labels(spark, sf):
    e = t.read(spark, sf, "events")
    u, kind = F.col("user_id").cast("string"), F.col("event_type")
    which = F.col("user_id") % 5
    label = (
        F.when(which == 0, F.concat(F.lit("2024_"), u, F.lit("_x"))).when(which == 1, F.concat(F.lit("u"), u, F.lit("_2024")))
        .when(which == 2, F.concat_ws("_", u, kind)).when(which == 3, kind).otherwise(F.concat(F.lit("_"), kind))
    )
    return e.select(label.alias("label")).distinct()


@query(f"""WITH {LABELS}, p AS (SELECT label, string_split(label, '_') AS s FROM labels),
  q AS (SELECT *, len(s) >= 2 AS many, s[1] = '' OR try_cast(s[1] AS DOUBLE) IS NOT NULL AS n1, s[-1] = '' OR try_cast(s[-1] AS DOUBLE) IS NOT NULL AS n2 FROM p)
  SELECT label, CASE WHEN NOT many THEN label WHEN NOT n1 AND n2 THEN array_to_string(s[1:len(s) - 1], '_') ELSE array_to_string(s[2:], '_') END AS entity,
    CASE WHEN NOT many THEN '' WHEN NOT n1 AND n2 THEN s[-1] ELSE s[1] END AS time_text, many AS is_temporal FROM q""")
def label_parse(spark, sf):
    return temporal.with_entity_and_time(_labels(spark, sf))


@query(f"WITH {LABELS} SELECT bool_or(contains(label, '_')) AS temporal FROM labels")
def temporal_detection(spark, sf):
    return temporal.is_temporal(_labels(spark, sf))


def _average_query(window: int):
    def run(spark, sf):
        made = temporal.moving_average(t.event_cells(spark, sf), window, "entity", "row_id", "value", "component")
        return made.select("row_id", "component", F.round("smoothed", 6).alias("smoothed"))

    run.__name__ = f"cma_w{window}"
    half = window // 2
    query(f"""WITH {EVENT_CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, component ORDER BY row_id) - 1 AS i,
        count(*) OVER (PARTITION BY entity, component) AS n FROM cells),
      h AS (SELECT *, least({half}, i, n - 1 - i) AS h FROM r)
      SELECT a.row_id, a.component, round(avg(b.value), 6) AS smoothed FROM h a JOIN h b ON a.entity = b.entity AND a.component = b.component
        AND b.i BETWEEN a.i - a.h AND a.i + a.h GROUP BY 1, 2""")(run)


for _w in (3, 5, 15):
    _average_query(_w)

VECTORS = "v AS (SELECT vec_id AS row_id, label::VARCHAR AS label, embedding::DOUBLE[] AS f FROM embeddings WHERE embedding IS NOT NULL)"
BOOK = f"book AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS neuron, f AS w FROM v ORDER BY row_id LIMIT {M})"
EUCLIDEAN = "list_distance(f, w)"
MANHATTAN = "list_sum(list_transform(range(1, len(f) + 1), lambda i: abs(f[i] - w[i])))"
CANBERRA = "list_sum(list_transform(range(1, len(f) + 1), lambda i: abs(f[i] - w[i]) / (abs(f[i]) + abs(w[i]) + 1e-15)))"


def _nearest_sql(metric: str) -> str:
    return f"""{VECTORS}, {BOOK}, near AS (SELECT row_id, label, f, neuron, {metric} AS d FROM v CROSS JOIN book),
  a AS (SELECT row_id, label, f, neuron AS bmu, d AS dist FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, neuron) AS rn FROM near) WHERE rn = 1)"""


ASSIGNED = f"WITH {_nearest_sql(EUCLIDEAN)}"


def _bmu_query(metric: str, sql: str):
    def run(spark, sf):
        return t.assigned(spark, sf, metric).select("row_id", F.col("bmu").cast("int").alias("bmu"), F.round("dist", 6).alias("dist"))

    run.__name__ = f"bmu_{metric}"
    query(f"WITH {_nearest_sql(sql)} SELECT row_id, bmu::INT AS bmu, round(dist, 6) AS dist FROM a")(run)


_bmu_query("euclidean", EUCLIDEAN)
_bmu_query("manhattan", MANHATTAN)
_bmu_query("canberra", CANBERRA)


@query(f"""{ASSIGNED} SELECT label, string_agg(row_id || ':' || bmu, ' ' ORDER BY row_id) AS points, count(*) >= 2 AS drawn FROM a GROUP BY 1""")
def trajectories(spark, sf):
    found = temporal.trajectories(t.assigned(spark, sf), "label")
    listed = F.array_join(F.transform("points", lambda p: F.concat_ws(":", p.row_id.cast("string"), p.bmu.cast("string"))), " ")
    return found.select("label", listed.alias("points"), "drawn")


@query(f"""{ASSIGNED}, s AS (SELECT label, row_id, bmu::INT AS from_place, lead(bmu::INT) OVER (PARTITION BY label ORDER BY row_id) AS to_place FROM a)
  SELECT * FROM s WHERE to_place IS NOT NULL""")
def trajectory_steps(spark, sf):
    return temporal.steps(t.assigned(spark, sf), "label")


@query(f"{ASSIGNED} SELECT row_id, label, bmu::INT AS bmu FROM a WHERE label IN ('1', '2')")
def active_trajectories(spark, sf):
    wanted = spark.createDataFrame([("1",), ("2",)], "label string")
    return temporal.chosen(t.assigned(spark, sf), wanted, "label").select("row_id", "label", "bmu")


GRID_SQL = f"""grid AS (SELECT n::INT AS neuron, (n // {COLS})::INT AS row, (n % {COLS})::INT AS col, 1.5 * (n // {COLS}) AS x,
  sqrt(3.0::DOUBLE) * (n % {COLS}) + CASE WHEN (n // {COLS}) % 2 = 1 THEN sqrt(3.0::DOUBLE) / 2 ELSE 0 END AS y FROM range({M}) r(n))"""


@query(f"""{ASSIGNED}, {GRID_SQL} SELECT neuron, row, col, round(x::DOUBLE, 9) AS x, round(y, 9) AS y, count(row_id) AS hits FROM grid LEFT JOIN a ON bmu = neuron GROUP BY ALL""")
def hex_grid(spark, sf):
    """The grid with the rows that each neuron wins."""
    hits = t.assigned(spark, sf).groupBy(F.col("bmu").alias("neuron")).agg(F.count("*").alias("hits"))
    made = som.hex_grid(spark, ROWS, COLS).join(hits, "neuron", "left").na.fill(0, ["hits"])
    return made.select("neuron", "row", "col", F.round(F.col("x").cast("double"), 9).alias("x"), F.round("y", 9).alias("y"), "hits")


@query(f"{ASSIGNED}, {GRID_SQL} SELECT row_id, label, round(x::DOUBLE, 9) AS x, round(y, 9) AS y FROM a JOIN grid ON bmu = neuron")
def trajectory_points(spark, sf):
    made = temporal.placed(t.assigned(spark, sf), None, som.hex_grid(spark, ROWS, COLS))
    return made.select("row_id", "label", F.round(F.col("x").cast("double"), 9).alias("x"), F.round("y", 9).alias("y"))


def _epoch_sql(epochs: int) -> str:
    sql = f"""WITH {VECTORS}, {BOOK}, {GRID_SQL}, g AS (SELECT a.neuron AS p, b.neuron AS q, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM grid a CROSS JOIN grid b),
  vd AS (SELECT row_id, unnest(range(1, 65)) AS k, unnest(f) AS x FROM v), b0 AS (SELECT neuron, w FROM book)"""
    for e in range(epochs):
        sigma = f"(2.0 * exp(-{e}.0 / 2))"  # the radius starts at half of the larger side
        sql += f""", n{e} AS (SELECT row_id, neuron AS bmu FROM (SELECT row_id, neuron, row_number() OVER (PARTITION BY row_id ORDER BY list_distance(f, w), neuron) AS rn
    FROM v CROSS JOIN b{e}) WHERE rn = 1),
  s{e} AS (SELECT bmu, k, count(*) AS n, sum(x) AS s FROM n{e} JOIN vd USING (row_id) GROUP BY 1, 2),
  u{e} AS (SELECT q AS neuron, k, sum(exp(-d2 / (2 * {sigma} ** 2)) * s) / sum(exp(-d2 / (2 * {sigma} ** 2)) * n) AS w FROM s{e} JOIN g ON p = bmu GROUP BY 1, 2),
  b{e + 1} AS (SELECT neuron, list(w ORDER BY k) AS w FROM u{e} GROUP BY 1)"""
    return sql


def _trained(spark, sf, epochs):
    return som.train_batch(t.vectors(spark, sf), t.first_codebook(spark, sf), ROWS, COLS, 2)[0] if epochs == 2 else None


def _weights(spark, weights):
    rows = [(m, k + 1, float(w)) for m, row in enumerate(weights) for k, w in enumerate(row)]
    return spark.createDataFrame(rows, "neuron int, k int, w double").select("neuron", "k", F.round("w", 6).alias("w"))


@query(f"{_epoch_sql(1)} SELECT neuron, k::INT AS k, round(w, 6) AS w FROM u0")
def som_epoch1(spark, sf):
    data, start = t.vectors(spark, sf), t.first_codebook(spark, sf)
    found = som.batch_statistics(data, start, "euclidean")
    return _weights(spark, som.batch_update(start, found["n"], found["x"], som.grid_distances(ROWS, COLS), 2.0))


@query(f"{_epoch_sql(2)} SELECT neuron, k::INT AS k, round(w, 6) AS w FROM u1")
def som_epoch2(spark, sf):
    return _weights(spark, _trained(spark, sf, 2))


@query(f"""{_epoch_sql(2)}, e0 AS (SELECT avg(list_distance(f, w)) AS e FROM n0 JOIN v USING (row_id) JOIN b1 ON bmu = neuron),
  e1 AS (SELECT avg(list_distance(f, w)) AS e FROM n1 JOIN v USING (row_id) JOIN b2 ON bmu = neuron)
  SELECT 1 AS epoch, round(e, 6) AS error FROM e0 UNION ALL SELECT 2, round(e, 6) FROM e1""")
def som_errors(spark, sf):
    errors = som.train_batch(t.vectors(spark, sf), t.first_codebook(spark, sf), ROWS, COLS, 2)[1]
    return spark.createDataFrame([(i + 1, e) for i, e in enumerate(errors)], "epoch int, error double").select("epoch", F.round("error", 6).alias("error"))


def _book(spark, sf):
    """The codebook after two epochs over the whole table."""
    return som.codebook(spark, _trained(spark, sf, 2), ROWS, COLS)


UMATRIX = f"""{_epoch_sql(2)}, um AS (SELECT a.neuron, a.row, a.col, avg(list_distance(p.w, q.w)) AS u FROM grid a JOIN grid b
  ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 1.85 ** 2 AND a.neuron <> b.neuron JOIN b2 p ON p.neuron = a.neuron JOIN b2 q ON q.neuron = b.neuron GROUP BY 1, 2, 3)"""


@query(f"{UMATRIX} SELECT neuron, row, col, round(u, 6) AS u FROM um")
def umatrix(spark, sf):
    return som.umatrix(_book(spark, sf)).withColumn("u", F.round("u", 6))


def _ramp_sql(value: str, low: str, high: str, name: str) -> str:
    stops = colours.RAMPS[name]
    place, last = f"least(greatest(({value} - {low}) / ({high} - {low}), 0), 1) * {len(stops) - 1}", len(stops) - 2
    channel = lambda at: "[" + ", ".join(str(int(c[at : at + 2], 16)) for c in stops) + "]"
    piece = f"least(floor({place}), {last})::INT"
    one = lambda at: f"lpad(lower(hex(floor({channel(at)}[{piece} + 1] + ({channel(at)}[{piece} + 2] - {channel(at)}[{piece} + 1]) * ({place} - {piece}) + 0.5)::BIGINT)), 2, '0')"
    return "'#' || " + " || ".join(one(at) for at in (1, 3, 5))


@query(f"{UMATRIX}, z AS (SELECT neuron, round(u, 6) AS u, round(min(u) OVER (), 6) AS lo, round(max(u) OVER (), 6) AS hi FROM um) SELECT neuron, {_ramp_sql('u', 'lo', 'hi', 'umatrix')} AS colour FROM z")
def umatrix_colours(spark, sf):
    made = umatrix(spark, sf)
    span = made.agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    return made.join(F.broadcast(span), F.lit(True)).select("neuron", colours.ramp(F.col("u"), F.col("lo"), F.col("hi"), colours.RAMPS["umatrix"]).alias("colour"))


@query(f"""{ASSIGNED}, {GRID_SQL}, c AS (SELECT bmu, count(*) AS hits, avg(dist) AS e FROM a GROUP BY 1),
  w AS (SELECT neuron, coalesce(hits, 0) AS hits, coalesce(e, 0) AS e FROM grid LEFT JOIN c ON bmu = neuron)
  SELECT neuron, hits, round(hits::DOUBLE / max(hits) OVER (), 6) AS frequency, round(e / max(e) OVER (), 6) AS quantization FROM w""")
def hit_map(spark, sf):
    made = som.hit_and_error_map(t.assigned(spark, sf), som.hex_grid(spark, ROWS, COLS))
    return made.select("neuron", "hits", F.round("frequency", 6).alias("frequency"), F.round("quantization", 6).alias("quantization"))


@query(f"{ASSIGNED} SELECT bmu::INT AS neuron, string_agg(label, ' ' ORDER BY row_id) AS labels FROM a GROUP BY 1")
def mapped_labels(spark, sf):
    return som.mapped_labels(t.assigned(spark, sf)).select("neuron", F.array_join("labels", " ").alias("labels"))


@query(f"{ASSIGNED} SELECT bmu::INT AS neuron, row_number() OVER (PARTITION BY bmu ORDER BY row_id) - 1 AS place, label FROM a")
def label_places(spark, sf):
    return som.label_places(t.assigned(spark, sf))


@query(f"""{ASSIGNED} SELECT row_id, label, bmu::INT AS bmu FROM (SELECT *, row_number() OVER (PARTITION BY bmu ORDER BY row_id) AS rn FROM a WHERE label <> '3') WHERE rn <= 4""")
def visible_labels(spark, sf):
    hidden = spark.createDataFrame([("3",)], "label string")
    return som.visible_labels(t.assigned(spark, sf), "", hidden, 4).select("row_id", "label", "bmu")


@query(f"{ASSIGNED} SELECT row_id, CASE WHEN label = '2' THEN 7 ELSE bmu END::INT AS bmu FROM a")
def moved_label(spark, sf):
    return som.move_label(t.assigned(spark, sf), "2", 7).select("row_id", "bmu")


@query(f"{_epoch_sql(2)} SELECT grid.neuron, row, col, round(w[4], 6) AS value FROM grid JOIN b2 ON b2.neuron = grid.neuron")
def component_plane(spark, sf):
    return som.component_plane(_book(spark, sf), 3).withColumn("value", F.round("value", 6))


@query(f"{_epoch_sql(2)}, z AS (SELECT neuron, round(w[4], 6) AS u, round(min(w[4]) OVER (), 6) AS lo, round(max(w[4]) OVER (), 6) AS hi FROM b2) SELECT neuron, {_ramp_sql('u', 'lo', 'hi', 'viridis')} AS colour FROM z")
def component_colours(spark, sf):
    made = component_plane(spark, sf)
    span = made.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return made.join(F.broadcast(span), F.lit(True)).select("neuron", colours.ramp(F.col("value"), F.col("lo"), F.col("hi"), colours.RAMPS["viridis"]).alias("colour"))


def _clusters(spark):
    return spark.range(M).select(F.col("id").cast("int").alias("neuron"), (F.col("id") % 3).cast("int").alias("cluster"))


@query(f"""{ASSIGNED}, {GRID_SQL}, o AS (SELECT * FROM (VALUES (0, 0, -1), (0, 0, 1), (0, -1, -1), (0, -1, 0), (0, 1, -1), (0, 1, 0),
    (1, 0, -1), (1, 0, 1), (1, -1, 0), (1, -1, 1), (1, 1, 0), (1, 1, 1)) t(odd, dr, dc)),
  m AS (SELECT bmu, label, row_number() OVER (PARTITION BY bmu ORDER BY count(*) DESC, label) AS rn FROM a GROUP BY 1, 2),
  c AS (SELECT grid.*, coalesce(label, '') AS cluster FROM grid LEFT JOIN m ON bmu = neuron AND rn = 1),
  n AS (SELECT neuron, cluster, row + dr AS nrow, col + dc AS ncol FROM c JOIN o ON odd = row % 2)
  SELECT n.neuron, n.nrow, n.ncol FROM n LEFT JOIN c ON c.row = n.nrow AND c.col = n.ncol WHERE c.neuron IS NULL OR c.cluster <> n.cluster""")
def cluster_borders(spark, sf):
    """Borders between neurons whose rows are mostly of different labels."""
    grid = som.hex_grid(spark, ROWS, COLS)
    counts = t.assigned(spark, sf).groupBy(F.col("bmu").alias("neuron"), "label").agg(F.count("*").alias("n"))
    most = counts.groupBy("neuron").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("cluster"))
    return som.cluster_borders(grid, grid.select("neuron").join(most, "neuron", "left").na.fill("", ["cluster"]))


@query(f"{ASSIGNED} SELECT row_id, label, (bmu % 3)::INT AS cluster FROM a")
def clustered_export(spark, sf):
    return som.clustered_rows(t.assigned(spark, sf), _clusters(spark)).select("row_id", "label", "cluster")


@query("SELECT DISTINCT label AS cluster, CASE WHEN label >= 0 THEN (label * 137.5::DOUBLE) % 360.0::DOUBLE END AS hue FROM embeddings")
def cluster_hues(spark, sf):
    c = t.read(spark, sf, "embeddings").select(F.col("label").alias("cluster")).distinct()
    return c.withColumn("hue", text.cluster_hue(F.col("cluster")))


# clusters

PLANE = "p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS value, 'c' || label AS category FROM embeddings WHERE embedding IS NOT NULL)"


def _plane_points(spark, sf):
    return t.plane(spark, sf).select("id", F.array("x", "y").alias("features"))


@query(f"""WITH {PLANE}, w AS (SELECT id AS row_id, category AS label, x, y FROM p), l0 AS (SELECT row_id, label, x, y, lag(x) OVER w AS xa, lag(y) OVER w AS ya, lead(x) OVER w AS xc, lead(y) OVER w AS yc, lead(x, 2) OVER w AS xd, lead(y, 2) OVER w AS yd
    FROM w WINDOW w AS (PARTITION BY label ORDER BY row_id)),
  q AS (SELECT row_id, label, coalesce(xa, 2 * x - xc) AS x0, coalesce(ya, 2 * y - yc) AS y0, x AS x1, y AS y1, xc AS x2, yc AS y2, coalesce(xd, 2 * xc - x) AS x3, coalesce(yd, 2 * yc - y) AS y3 FROM l0 WHERE xc IS NOT NULL),
  d AS (SELECT *, greatest(((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.25, 1e-9) AS d0, greatest(((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.25, 1e-9) AS d1,
    greatest(((x3 - x2) ** 2 + (y3 - y2) ** 2) ** 0.25, 1e-9) AS d2 FROM q),
  s AS (SELECT *, d1 * piece / 4 AS t FROM d, range(5) r(piece)),
  u AS (SELECT row_id, label, piece, d0, d1, d2, t, unnest(['x', 'y']) AS axis, unnest([x0, y0]) AS q0, unnest([x1, y1]) AS q1, unnest([x2, y2]) AS q2, unnest([x3, y3]) AS q3 FROM s),
  l AS (SELECT *, -t / d0 * q0 + (t + d0) / d0 * q1 AS a1, (d1 - t) / d1 * q1 + t / d1 * q2 AS a2, (d1 + d2 - t) / d2 * q2 + (t - d1) / d2 * q3 AS a3 FROM u),
  m AS (SELECT *, (d1 - t) / (d1 + d0) * a1 + (t + d0) / (d1 + d0) * a2 AS b1, (d1 + d2 - t) / (d1 + d2) * a2 + t / (d1 + d2) * a3 AS b2 FROM l),
  o AS (SELECT row_id, label, piece, axis, round((d1 - t) / d1 * b1 + t / d1 * b2, 5) + 0.0 AS v FROM m)
  SELECT label AS entity, row_id, piece::INT AS piece, max(CASE WHEN axis = 'x' THEN v END) AS x, max(CASE WHEN axis = 'y' THEN v END) AS y FROM o GROUP BY 1, 2, 3""")
def trajectory_splines(spark, sf):
    """Curves through the vectors' first two components, a curve for each label."""
    places = t.plane(spark, sf).select(F.col("category").alias("entity"), F.col("id").alias("row_id"), "x", "y")
    return temporal.spline(places, 4).select("entity", "row_id", "piece", *[(F.round(c, 5) + 0.0).alias(c) for c in "xy"])


@query(f"""WITH RECURSIVE {PLANE}, st AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM p),
  z AS (SELECT id, (x - mx) / sx AS x, (y - my) / sy AS y FROM p, st),
  near AS (SELECT a.id AS a, b.id AS b FROM z a JOIN z b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.15),
  core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 4),
  link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
  reach(id, root) AS (SELECT id, id FROM core UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.id WHERE r.root < l.b),
  root AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
  num AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM root),
  border AS (SELECT a AS id, min(cluster) AS cluster FROM near JOIN num ON num.id = near.b GROUP BY a)
  SELECT p.id, coalesce(num.cluster, border.cluster, -1)::INT AS cluster FROM p LEFT JOIN num ON num.id = p.id LEFT JOIN border ON border.id = p.id""")
def dbscan(spark, sf):
    return clustering.dbscan(clustering.standardised(_plane_points(spark, sf)), 0.15, 4)


def _labelled(spark, sf):
    return t.vectors(spark, sf).select(F.col("row_id").alias("id"), "features", F.col("label").cast("int").alias("cluster"))


LABELLED = "v AS (SELECT vec_id AS id, label AS cluster, embedding::DOUBLE[] AS f FROM embeddings WHERE embedding IS NOT NULL)"
CENTRES = """vd AS (SELECT id, cluster, unnest(range(1, 65)) AS k, unnest(f) AS x FROM v),
  cd AS (SELECT cluster, k, avg(x) AS c FROM vd GROUP BY 1, 2), centres AS (SELECT cluster, list(c ORDER BY k) AS c FROM cd GROUP BY 1)"""


@query(f"""WITH {LABELLED}, d AS (SELECT a.id, a.cluster AS own, b.cluster AS other, sum(list_distance(a.f, b.f)) AS s, count(*) AS n FROM v a CROSS JOIN v b GROUP BY 1, 2, 3),
  m AS (SELECT id, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY 1)
  SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m""")
def silhouette(spark, sf):
    return clustering.silhouette(_labelled(spark, sf)).select(F.round("silhouette", 6).alias("silhouette"))


@query(f"""WITH {LABELLED}, {CENTRES}, s AS (SELECT cluster, avg(list_distance(f, c)) AS s FROM v JOIN centres USING (cluster) GROUP BY 1),
  r AS (SELECT a.cluster, max((a.s + b.s) / list_distance(ca.c, cb.c)) AS r FROM s a JOIN s b ON a.cluster <> b.cluster
    JOIN centres ca ON ca.cluster = a.cluster JOIN centres cb ON cb.cluster = b.cluster GROUP BY 1)
  SELECT round(avg(r), 6) AS davies_bouldin FROM r""")
def davies_bouldin(spark, sf):
    return clustering.davies_bouldin(_labelled(spark, sf)).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(f"""WITH {LABELLED}, {CENTRES}, g AS (SELECT k, avg(x) AS g FROM vd GROUP BY 1), n AS (SELECT cluster, count(*) AS n FROM v GROUP BY 1),
  b AS (SELECT sum(n * (c - g) ** 2) AS b FROM cd JOIN g USING (k) JOIN n USING (cluster)),
  w AS (SELECT sum((x - c) ** 2) AS w FROM vd JOIN cd USING (cluster, k))
  SELECT round((b / ((SELECT count(*) FROM n) - 1)) / (w / ((SELECT count(*) FROM v) - (SELECT count(*) FROM n))), 5) AS calinski_harabasz FROM b, w""")
def calinski_harabasz(spark, sf):
    return clustering.calinski_harabasz(_labelled(spark, sf)).select(F.round("calinski_harabasz", 5).alias("calinski_harabasz"))


@query(f"WITH {PLANE} SELECT category AS cluster, round(quantile_cont(x, 0.5), 6) AS x, round(quantile_cont(y, 0.5), 6) AS y, count(*) AS size FROM p GROUP BY 1")
def cluster_medians(spark, sf):
    made = clustering.medians(t.plane(spark, sf).select(F.col("category").alias("cluster"), "x", "y"))
    return made.select("cluster", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "size")


@query(f"""WITH {LABELLED}, {CENTRES}, s AS (SELECT cluster, id, CASE WHEN id % 4 = 0 THEN '' ELSE 'title ' || id END AS title,
    list_sum(list_transform(range(1, 65), lambda i: f[i] * c[i])) / (sqrt(list_sum(list_transform(f, lambda x: x * x))) * sqrt(list_sum(list_transform(c, lambda x: x * x))) + 1e-9) AS sim
    FROM v JOIN centres USING (cluster)),
  r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY sim DESC, id) AS rank FROM s WHERE title <> '')
  SELECT cluster, rank::INT AS rank, id, title, round(sim, 6) AS similarity FROM r WHERE rank <= 10""")
def representatives(spark, sf):
    rows = _labelled(spark, sf).withColumn("title", F.when(F.col("id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("title "), F.col("id").cast("string"))))
    return clustering.representatives(rows).withColumn("similarity", F.round("similarity", 6))


# neighbours and maps

KNN = f"""{LABELLED}, d AS (SELECT a.id, b.id AS neighbour, list_distance(a.f, b.f) AS distance FROM v a JOIN v b ON a.id <> b.id),
  near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour)::INT AS rank FROM d)"""


def _points(spark, sf):
    return t.vectors(spark, sf).select(F.col("row_id").alias("id"), "features")


@query(f"WITH {KNN} SELECT id, rank, neighbour, round(distance, 6) AS distance FROM near WHERE rank <= 5")
def knn(spark, sf):
    return neighbours.knn(_points(spark, sf), 5).withColumn("distance", F.round("distance", 6))


def _near(spark, sf, k=11):
    return neighbours.knn(_points(spark, sf), k)


MLE = f"""WITH {KNN}, f AS (SELECT *, max(CASE WHEN rank = 10 THEN distance END) OVER (PARTITION BY id) AS far FROM near WHERE rank <= 10),
  m AS (SELECT id, count(*) / sum(ln(far / distance)) AS d FROM f WHERE rank < 10 AND distance > 0 GROUP BY 1)"""


@query(f"{MLE} SELECT id, round(d, 5) AS d FROM m")
def dimension_mle(spark, sf):
    return neighbours.pointwise_mle(_near(spark, sf, 10), 10).withColumn("d", F.round("d", 5))


@query(f"""{MLE} SELECT round(quantile_cont(d, 0.5), 5) AS p50, round(quantile_cont(d, 0.9), 5) AS p90, round(quantile_cont(d, 0.95), 5) AS p95,
  round(max(d), 5) AS largest, round(avg(d), 5) AS mean FROM m""")
def dimension_ceiling(spark, sf):
    found = neighbours.ceiling_dimension(neighbours.pointwise_mle(_near(spark, sf, 10), 10))
    return found.select(*[F.round(c, 5).alias(c) for c in found.columns])


@query(f"""WITH {KNN}, p AS (SELECT id, max(CASE WHEN rank = 2 THEN distance END) / max(CASE WHEN rank = 1 THEN distance END) AS mu FROM near WHERE rank <= 2 GROUP BY 1
    HAVING max(CASE WHEN rank = 1 THEN distance END) > 0),
  r AS (SELECT mu, row_number() OVER (ORDER BY mu, id) AS rn, count(*) OVER () AS n FROM p),
  xy AS (SELECT ln(mu) AS x, -ln(1 - rn / n) AS y FROM r WHERE rn <= floor(n * 0.9))
  SELECT round(sum(x * y) / sum(x * x), 5) AS dimension FROM xy""")
def dimension_two_nn(spark, sf):
    return neighbours.two_nn(_near(spark, sf, 2)).select(F.round("dimension", 5).alias("dimension"))


@query(f"""WITH {KNN}, m AS (SELECT id, avg(distance) AS m, max(CASE WHEN rank = 10 THEN distance END) AS far FROM near WHERE rank <= 10 GROUP BY 1)
  SELECT id, round(m / (far - m), 5) AS d FROM m WHERE far <> m""")
def dimension_moments(spark, sf):
    return neighbours.method_of_moments(_near(spark, sf, 10), 10).withColumn("d", F.round("d", 5))


@query(f"""WITH {KNN}, m AS (SELECT id, max(CASE WHEN rank = 5 THEN distance END) AS half, max(CASE WHEN rank = 10 THEN distance END) AS far FROM near GROUP BY 1)
  SELECT id, round(ln(2) / ln(far / half), 5) AS d FROM m WHERE half > 0 AND far > half""")
def dimension_mada(spark, sf):
    return neighbours.mada(_near(spark, sf, 10), 10).withColumn("d", F.round("d", 5))


@query(f"""WITH {KNN}, r AS (SELECT quantile_cont(CASE WHEN rank = 5 THEN distance END, 0.5) AS r1, quantile_cont(CASE WHEN rank = 10 THEN distance END, 0.5) AS r2 FROM near)
  SELECT round(ln(sum(CASE WHEN distance < r2 THEN 1 ELSE 0 END) / sum(CASE WHEN distance < r1 THEN 1 ELSE 0 END)) / ln(max(r2) / max(r1)), 5) AS dimension FROM near, r""")
def dimension_correlation(spark, sf):
    return neighbours.correlation_dimension(_points(spark, sf), _near(spark, sf, 10), 5, 10).select(F.round("dimension", 5).alias("dimension"))


@query(f"""WITH {KNN}, r AS (SELECT id, max(CASE WHEN rank = 1 THEN distance END) / max(CASE WHEN rank = 11 THEN distance END) AS rho FROM near GROUP BY 1),
  l AS (SELECT d, sum(ln(10.0 * d) + (d - 1) * ln(rho) + 9 * ln(1 - rho ** d)) AS l FROM r CROSS JOIN range(1, 65) t(d) WHERE rho > 0 AND rho < 1 GROUP BY d)
  SELECT d::DOUBLE AS dimension FROM l ORDER BY l DESC, d LIMIT 1""")
def dimension_mind_ml(spark, sf):
    return neighbours.mind_ml(_near(spark, sf, 11), 10)


@query(f"""WITH {PLANE}, b AS (SELECT min(x) AS x0, max(x) - min(x) AS sx, min(y) AS y0, max(y) - min(y) AS sy FROM p),
  g AS (SELECT value, (x - (x0 - 0.1 * sx)) / (sx * 1.2) * 39 AS gx, (y - (y0 - 0.1 * sy)) / (sy * 1.2) * 39 AS gy FROM p, b),
  w AS (SELECT px, py, value, exp(-((px - gx) ** 2 + (py - gy) ** 2) / (2 * 2.0 ** 2)) AS w FROM g, range(40) a(px), range(40) c(py)
    WHERE (px - gx) ** 2 + (py - gy) ** 2 <= 9 * 2.0 ** 2),
  s AS (SELECT px, py, sum(w) AS weight, sum(w * value) / sum(w) AS value FROM w GROUP BY 1, 2)
  SELECT px::INT AS px, py::INT AS py, round(weight, 5) AS weight, round(value, 5) AS value, round(alpha, 5) AS alpha
  FROM (SELECT *, least(1.0, weight / (0.08 * max(weight) OVER ())) AS alpha FROM s) WHERE weight > 0.001""")
def splat_grid(spark, sf):
    made = neighbours.splat(t.plane(spark, sf), 40, 0.05)
    return made.select("px", "py", *[F.round(c, 5).alias(c) for c in ("weight", "value", "alpha")])


@query(f"""WITH {PLANE}, d AS (SELECT id, sqrt((x - 0.1) ** 2 + (y + 0.05) ** 2) AS d FROM p) SELECT id, round(d, 6) AS d FROM d WHERE d < 16 ORDER BY d.d, id LIMIT 1""")
def nearest_point(spark, sf):
    return neighbours.nearest_point(t.plane(spark, sf), 0.1, -0.05).select("id", F.round("d", 6).alias("d"))


@query(f"""WITH {PLANE}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, greatest(max(x) - min(x), max(y) - min(y)) AS s FROM p),
  c AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS number FROM (SELECT DISTINCT category FROM p WHERE category <> 'c0'))
  SELECT id, round(2 * (x - (x0 + x1) / 2) / s, 6) AS x, round(2 * (y - (y0 + y1) / 2) / s, 6) AS y, coalesce(number, -1)::INT AS number,
    CASE WHEN category = 'c0' THEN 0 ELSE 1 END::INT AS layer FROM p CROSS JOIN b LEFT JOIN c USING (category)""")
def map_coordinates(spark, sf):
    made = neighbours.map_coordinates(t.plane(spark, sf), "c0")
    return made.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "number", "layer")


@query("""WITH s AS (SELECT p_brand || '/' || p_type AS category, count(*) AS size FROM part GROUP BY 1),
  r AS (SELECT *, row_number() OVER (ORDER BY size DESC, category) AS rn, count(*) OVER () AS n FROM s),
  c AS (SELECT max(CASE WHEN rn = least(16, n) THEN size END) AS a, max(CASE WHEN rn = least(46, n) THEN size END) AS b,
    max(CASE WHEN rn = least(101, n) THEN size END) AS c FROM r)
  SELECT category, size, CASE WHEN size >= a THEN 1 WHEN size >= b THEN 2 WHEN size >= c THEN 3 ELSE 0 END::INT AS tier FROM s, c""")
def label_tiers(spark, sf):
    sizes = t.read(spark, sf, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("category")).agg(F.count("*").alias("size"))
    return neighbours.label_tiers(sizes)


@query(f"""WITH {LABELLED}, d AS (SELECT id, unnest(range(1, len(f) + 1)) AS k, unnest(f) AS x FROM v), m AS (SELECT k, avg(x) AS m FROM d GROUP BY 1),
  z AS (SELECT id, k, x - m AS x FROM d JOIN m USING (k)),
  c AS (SELECT a.k AS i, b.k AS j, sum(a.x * b.x) / ((SELECT count(*) FROM v) - 1) AS s FROM z a JOIN z b USING (id) GROUP BY 1, 2),
  c2 AS (SELECT a.i, b.j, sum(a.s * b.s) AS s FROM c a JOIN c b ON a.j = b.i GROUP BY 1, 2)
  SELECT round((SELECT sum(s) FROM c WHERE i = j), 6) AS power1, round((SELECT sum(s) FROM c2 WHERE i = j), 6) AS power2,
    round((SELECT sum(c.s * c2.s) FROM c JOIN c2 ON c.i = c2.j AND c.j = c2.i), 6) AS power3""")
def pca_spectrum(spark, sf):
    """Power sums of the variances on all principal axes: those of the covariance matrix's eigenvalues, its traces."""
    points = _points(spark, sf)
    width = len(points.first()["features"])
    long = neighbours.pca(points, width).select(F.posexplode("scores").alias("k", "x"))
    spread = long.groupBy("k").agg(F.var_samp("x").alias("v"))
    return spread.agg(*[F.round(F.sum(F.pow("v", F.lit(float(p)))), 6).alias(f"power{p}") for p in (1, 2, 3)])


@query()
def neighbour_descent(spark, sf):
    """Approximate, so tested by its recall."""
    return descent.approximate_knn(_points(spark, sf), 10)


@query()
def pca_projection(spark, sf):
    """Tested by its variances; signs are fixed, not SQL's."""
    return neighbours.pca(_points(spark, sf), 3)
