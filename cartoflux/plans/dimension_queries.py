"""Queries on intrinsic dimension beyond distances to neighbours, each with its SQL where there is one."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cartoflux.operators import dimension, neighbours
from cartoflux.plans import tables as t
from cartoflux.plans.map_queries import KNN, LABELLED

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _points(spark, sf):
    return t.vectors(spark, sf).select(F.col("row_id").alias("id"), "features")


def _few(spark, sf):
    """The first eight components: in all 64 of so even a table, no two vectors are as near as the thresholds ask."""
    return _points(spark, sf).withColumn("features", F.slice("features", 1, 8))


# the inverse covariance by elimination gives the whitened products without any axes
SEPARABLE = f"""{LABELLED.replace("embedding::DOUBLE[] AS f", "embedding[1:8]::DOUBLE[] AS f")}, m AS (SELECT k, avg(x) AS m FROM (SELECT unnest(range(1, len(f) + 1)) AS k, unnest(f) AS x FROM v) GROUP BY 1),
  ml AS (SELECT list(m ORDER BY k) AS m FROM m), c AS (SELECT id, list_transform(list_zip(f, m), lambda z: z[1] - z[2]) AS c FROM v, ml),
  cd AS (SELECT id, unnest(range(1, len(c) + 1)) AS k, unnest(c) AS x FROM c),
  cov AS (SELECT a.k AS i, b.k AS j, sum(a.x * b.x) / ((SELECT count(*) FROM v) - 1) AS s FROM cd a JOIN cd b USING (id) GROUP BY 1, 2),
  w AS (SELECT max(i) AS w FROM cov),
  start AS (SELECT list(list_concat(r, list_transform(range(1, w + 1), lambda j: CASE WHEN j = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) ORDER BY i) AS m
    FROM (SELECT i, list(s ORDER BY j) AS r FROM cov GROUP BY 1), w),
  g(k, m) AS (SELECT 1::BIGINT, m FROM start UNION ALL
    SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k])
      ELSE list_transform(list_zip(r, m[k]), lambda z: z[1] - r[k] / m[k][k] * z[2]) END) FROM g, w WHERE k <= w),
  inv AS (SELECT list_transform(m, lambda r: r[w + 1:]) AS m FROM g, w WHERE k = w + 1),
  y AS (SELECT id, c, list_transform(m, lambda r: list_inner_product(r, c)) AS y FROM c, inv), u AS (SELECT *, sqrt(list_inner_product(c, y)) AS s FROM y),
  near AS (SELECT list_inner_product(a.c, b.y) / (a.s * b.s) AS near FROM u a JOIN u b ON a.id <> b.id),
  al AS (SELECT (60 + 2 * i) / 100.0::DOUBLE AS alpha FROM range(20) t(i)),
  p AS (SELECT alpha, sum(CASE WHEN near > alpha THEN 1 ELSE 0 END) / count(*) AS p FROM near, al GROUP BY 1),
  z AS (SELECT alpha, p, -ln(1 - alpha * alpha) AS low FROM p WHERE p > 0),
  n AS (SELECT alpha, p, list_reduce(range(1, 41)::DOUBLE[], lambda w, i: w * (1 + ln(z) - ln(w)) / (1 + w), ln(1 + z)) / low AS n
    FROM (SELECT *, low / (2 * {math.pi!r} * p * p * alpha * alpha * (1 - alpha * alpha)) AS z FROM z))"""


@query(f"WITH RECURSIVE {SEPARABLE} SELECT alpha, round(p, 8) AS p, round(n, 5) AS n FROM n")
def separability_curve(spark, sf):
    curve = dimension.inseparable(dimension.whitened(_few(spark, sf))).withColumn("n", dimension.sphere_dimension(F.col("alpha"), F.col("p")))
    return curve.filter("n IS NOT NULL").select("alpha", F.round("p", 8).alias("p"), F.round("n", 5).alias("n"))


@query(f"""WITH RECURSIVE {SEPARABLE} SELECT round(n, 5) AS dimension FROM n, (SELECT max(alpha) AS top FROM n) ORDER BY abs(alpha - 0.9::DOUBLE * top), alpha LIMIT 1""")
def dimension_fisher(spark, sf):
    return dimension.fisher_separability(_few(spark, sf)).select(F.round("dimension", 5).alias("dimension"))


@query(f"""WITH {KNN}, n10 AS (SELECT near.id, rank, distance AS d, v.f, max(distance) OVER (PARTITION BY near.id) AS r FROM near JOIN v ON v.id = neighbour WHERE rank <= 10),
  p AS (SELECT a.id, a.r, a.d AS a, b.d AS b, list_distance(a.f, b.f) ** 2 AS v2 FROM n10 a JOIN n10 b ON a.id = b.id AND a.rank <> b.rank WHERE a.d > 0 AND b.d > 0),
  q AS (SELECT id, r, a, b, unnest([v2, greatest(2 * a * a + 2 * b * b - v2, 0)]) AS s, unnest(['seen', 'turned']) AS side, row_number() OVER () AS pair FROM p WHERE v2 > 0),
  e AS (SELECT id, r, pair, CASE WHEN r <= a THEN r * s / (r * r + s - b * b)
    ELSE r * (sqrt((a * a + s - b * b) ** 2 + 4 * s * (r * r - a * a)) - (a * a + s - b * b)) / (2 * (r * r - a * a)) END AS reach FROM q),
  l AS (SELECT id, pair, sum(ln(reach / r)) AS l FROM e GROUP BY id, pair HAVING min(reach) > 0),
  t AS (SELECT id, count(*) AS n, sum(l) AS l FROM l GROUP BY 1), o AS (SELECT id, count(*) AS n, 2 * sum(ln(d / r)) AS l FROM n10 WHERE d > 0 GROUP BY 1)
  SELECT o.id, round(-2 * (o.n + coalesce(t.n, 0)) / (o.l + coalesce(t.l, 0)), 5) AS d FROM o LEFT JOIN t USING (id) WHERE o.l + coalesce(t.l, 0) < 0""")
def dimension_tle(spark, sf):
    points = _points(spark, sf)
    return dimension.tight_locality(points, neighbours.knn(points, 10), 10).withColumn("d", F.round("d", 5))


@query(f"""WITH {KNN}, n10 AS (SELECT near.id, rank, v.f FROM near JOIN v ON v.id = neighbour WHERE rank <= 10),
  m AS (SELECT id, list(m ORDER BY k) AS m FROM (SELECT id, k, avg(x) AS m FROM (SELECT id, unnest(range(1, 65)) AS k, unnest(f) AS x FROM n10) GROUP BY 1, 2) GROUP BY 1),
  c AS (SELECT id, rank, list_transform(list_zip(f, m), lambda z: z[1] - z[2]) AS c FROM n10 JOIN m USING (id)),
  p AS (SELECT a.id, list_inner_product(a.c, a.c) * list_inner_product(b.c, b.c) AS whole, list_inner_product(a.c, b.c) AS ab FROM c a JOIN c b ON a.id = b.id AND a.rank < b.rank),
  e AS (SELECT id, sum(sqrt(greatest(whole - ab * ab, 0))) / sum(sqrt(whole)) AS skew FROM p GROUP BY 1),
  r AS (SELECT n, CASE WHEN n = 1 THEN 0 ELSE exp(2 * lgamma(n / 2) - lgamma((n + 1) / 2) - lgamma(CASE WHEN n = 1 THEN 1 ELSE (n - 1) / 2 END)) END AS r FROM range(1, 1025) t(n)),
  s AS (SELECT n, r, lead(r) OVER (ORDER BY n) AS s FROM r)
  SELECT id, round(n + (skew - r) / (s - r), 4) AS d FROM e JOIN s ON skew >= r AND skew < s""")
def dimension_ess(spark, sf):
    points = _points(spark, sf)
    return dimension.simplex_skewness(points, neighbours.knn(points, 10), 10).withColumn("d", F.round("d", 4))


GRAPH = f"""{LABELLED}, h AS (SELECT id, f, ('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT AS h FROM v),
  l AS (SELECT id, f, (CASE WHEN h < 2 ** 31 THEN 1 ELSE 0 END + CASE WHEN h < 2 ** 30 THEN 1 ELSE 0 END + CASE WHEN h < 2 ** 29 THEN 1 ELSE 0 END) AS level FROM h),
  near AS (SELECT j AS level, a.id, list_distance(a.f, b.f) AS d, row_number() OVER (PARTITION BY j, a.id ORDER BY list_distance(a.f, b.f), b.id) AS rank
    FROM l a JOIN l b ON a.id <> b.id JOIN range(4) t(j) ON a.level >= j AND b.level >= j),
  g AS (SELECT level, count(DISTINCT id) AS n, sum(d) AS length FROM near WHERE rank <= 5 GROUP BY 1)"""


@query(f"WITH {GRAPH} SELECT level::INT AS level, n, round(length, 5) AS length FROM g")
def graph_lengths(spark, sf):
    return dimension.graph_lengths(_points(spark, sf), 5).withColumn("length", F.round("length", 5))


@query(f"WITH {GRAPH} SELECT round(1 / (1 - regr_slope(ln(length), ln(n))), 4) AS dimension FROM g")
def dimension_graph(spark, sf):
    return dimension.graph_dimension(_points(spark, sf), 5).select(F.round("dimension", 4).alias("dimension"))


@query()
def dimension_danco(spark, sf):
    """Tested against the same in numpy; its calibration sets are seeded, not SQL's."""
    points = _points(spark, sf)
    return dimension.danco(points, neighbours.knn(points, 11), 10)
