import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from cartoflux.operators import clustering, neighbours


def test_correlation_dimension_counts_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    x = np.random.default_rng(1).normal(size=(151, 3))
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    r1, r2 = np.median(np.sort(d, axis=1)[:, [4, 9]], axis=0)
    want = np.log((d < r2).sum() / (d < r1).sum()) / np.log(r2 / r1)
    assert np.isclose(neighbours.correlation_dimension(points, neighbours.knn(points, 10), 5, 10).first()[0], want)
    assert np.isclose(neighbours.estimate_dimension(points, "CorrInt", 10), want)


def test_silhouette_has_no_greatest_number_of_points(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    monkeypatch.setattr(clustering, "MOST_POINTS", 100)
    x = np.random.default_rng(2).normal(size=(151, 3))
    of = np.array([i % 3 for i in range(150)] + [9])
    rows = [(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, of, strict=True))]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    values = []
    for i, c in enumerate(of):
        a = d[i, of == c].sum() / max((of == c).sum() - 1, 1)
        b = min(d[i, of == o].mean() for o in set(of.tolist()) - {c})
        values.append((b - a) / max(a, b) if (of == c).sum() > 1 else 0.0)
    schema = "id long, features array<double>, cluster int"
    assert np.isclose(clustering.silhouette(spark.createDataFrame(rows, schema)).first()[0], np.mean(values))
    assert clustering.silhouette(spark.createDataFrame(rows, schema).limit(0)).first()[0] is None
    assert clustering.silhouette(spark.createDataFrame([(1, [0.0], 5), (2, [1.0], 5)], schema)).first()[0] == -1
    assert clustering.silhouette(spark.createDataFrame([(1, [0.0], 5), (2, [0.0], 5)], schema)).first()[0] == 0


def test_neighbours_come_from_products_not_from_all_differences(spark, monkeypatch):
    """Of the pairs of all blocks, few have their differences taken; results are those of all differences, with copies,
    ids that repeat, vectors far from the origin or of any size, and some that hold no number."""
    monkeypatch.setattr(neighbours, "COLUMNS", 64)
    rng = np.random.default_rng(3)
    for scale, offset in ((1.0, 0.0), (1e-3, 1e3), (1e20, 0.0), (1e-20, 0.0)):
        x = rng.normal(size=(400, 8)) * scale + offset
        x[200:230] = x[7]
        x[399], x[398, 2] = np.nan, np.inf
        ids = np.arange(400)
        ids[300:303] = 5
        order = np.argsort(ids, kind="stable")
        taken, whole = [], neighbours.exactly
        monkeypatch.setattr(neighbours, "exactly", lambda a, b, i, j: taken.append(len(i)) or whole(a, b, i, j))  # noqa: B023
        found = list(neighbours.nearest(x, x[order], ids, ids[order], 5))
        monkeypatch.setattr(neighbours, "exactly", whole)
        got = {}
        for i, j, d in found:
            for p, q, r in zip(i.tolist(), j.tolist(), d.tolist(), strict=True):
                got.setdefault(p, []).append((r, ids[order][q]))
        with np.errstate(all="ignore"):
            d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        d[ids[:, None] == ids[None]] = np.inf
        for i in range(400):
            want = sorted((v, w) for v, w in zip(d[i].tolist(), ids.tolist(), strict=True) if np.isfinite(v))[:5]
            assert got.get(i, []) == want
        assert sum(taken) < 400 * 400 / 3


def test_neighbours_of_many_blocks_are_merged_in_packets(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    monkeypatch.setattr(neighbours, "LARGEST", 40)
    monkeypatch.setattr(neighbours, "MERGED", 50)
    x = np.random.default_rng(4).normal(size=(151, 3))
    points = spark.createDataFrame([(i * 20, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :4]
    want = sorted((i * 20, r + 1, int(j) * 20, d[i, j]) for i in range(151) for r, j in enumerate(near[i]))
    assert sorted(map(tuple, neighbours.knn(points, 4).collect())) == want
    assert neighbours.knn(points.limit(0), 4).count() == 0
    assert neighbours.knn(points.limit(1), 4).count() == 0


def test_every_pair_of_blocks_is_a_task_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    points = spark.createDataFrame([(i, [float(i)]) for i in range(150)], "id long, features array<double>")

    def met(a, b):
        return pa.table([pa.array([TaskContext.get().partitionId()]), a.column("p")[:1].combine_chunks(), b.column("q")[:1].combine_chunks()], names=["task", "p", "q"])

    for once, pairs in ((True, [(p, q) for p in range(8) for q in range(p, 8)]), (False, [(p, q) for p in range(8) for q in range(8)])):
        found = neighbours.block_pairs(points, once=once).applyInArrow(met, "task long, p int, q int").collect()
        assert sorted((r.p, r.q) for r in found) == pairs
        assert len({r.task for r in found}) == len(pairs)


def test_distances_come_in_tiles(monkeypatch):
    """Tiles stay small, and distances from products are those of differences, with copies, far vectors and no numbers."""
    monkeypatch.setattr(neighbours, "TILE", 16)
    x = np.random.default_rng(5).normal(size=(70, 4))
    y = np.random.default_rng(6).normal(size=(45, 4))
    y[3:9], x[60], y[44] = x[5], 1e6, np.nan
    with np.errstate(all="ignore"):
        want, found = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)), np.full((70, 45), -1.0)
        for at, column, d in neighbours.apart(x, y):
            assert d.shape[0] <= 16 and d.shape[1] <= 16
            found[at : at + d.shape[0], column : column + d.shape[1]] = d
    assert np.allclose(found, want, rtol=1e-9, atol=0, equal_nan=True)


def test_a_product_of_two_blocks_serves_both(spark, monkeypatch):
    """Two blocks meet once, and what is beyond a point's k nearest of its own block has no distance taken."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 6)), rng.normal(size=(280, 6))
    x[:40], y[:40], y[50, 2], x[60, 1] = x[0], x[0], np.nan, np.inf
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    bound_x, bound_y = np.sort(np.where(np.isfinite(d), d, np.inf), axis=1)[:, 6], np.sort(np.where(np.isfinite(d), d, np.inf), axis=0)[6]
    monkeypatch.setattr(neighbours, "COLUMNS", 64)
    for held in (1 << 22, 300):
        monkeypatch.setattr(neighbours, "HELD", held)
        taken, whole = [], neighbours.exactly
        monkeypatch.setattr(neighbours, "exactly", lambda a, b, i, j: taken.append(len(i)) or whole(a, b, i, j))  # noqa: B023
        found = list(neighbours.nearest_across(x, y, bound_x, bound_y, 5))
        monkeypatch.setattr(neighbours, "exactly", whole)
        for back, m in ((False, d), (True, d.T)):
            got = {(int(i), int(j)) for b, *rest in found if b == back for i, j in zip(*rest[:2], strict=True)}
            want = {(i, int(j)) for i, row in enumerate(m) for j in np.lexsort((np.arange(len(row)), row))[:5] if np.isfinite(row[j])}
            assert got == want
        assert sum(taken) < d.size / 8
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 3)))], "id long, features array<double>")
    met = neighbours.block_pairs(points, once=True, own=False).applyInArrow(lambda a, b: pa.table({"p": a.column("p").slice(0, 1), "q": a.column("q").slice(0, 1)}), "p int, q int")
    assert sorted(map(tuple, met.collect())) == [(p, q) for p in range(5) for q in range(p + 1, 5)]
