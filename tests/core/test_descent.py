"""The approximate neighbour graph against exact neighbours."""

import numpy as np

from cartoflux.operators import descent, neighbours


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")


def recall(spark, x, k=10, **more):
    points = frame(spark, x)
    found = {(r["id"], r["neighbour"]): r["distance"] for r in descent.approximate_knn(points, k, **more).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert all(np.isclose(v, d[a, b]) for (a, b), v in found.items())
    np.fill_diagonal(d, np.inf)
    bound = np.sort(d, axis=1)[:, k - 1]
    near = np.zeros(len(x))
    for (a, b), v in found.items():
        near[a] += v <= bound[a] + 1e-12  # a tie with the k-th is as good
    return np.minimum(near, k).sum() / (k * len(x))


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(descent, "GROUP", 32)
    x = np.random.default_rng(1).normal(size=(1500, 12))
    assert recall(spark, x) >= 0.95
    clusters = np.random.default_rng(2).normal(size=(1200, 30)) * 0.2 + np.random.default_rng(3).normal(size=(8, 30))[np.arange(1200) % 8]
    assert recall(spark, clusters) >= 0.9


def test_points_that_lie_on_each_other(spark, monkeypatch):
    monkeypatch.setattr(descent, "GROUP", 16)
    x = np.random.default_rng(4).normal(size=(400, 6))
    x[:150] = x[0]
    assert recall(spark, x, 5) >= 0.9


def test_few_points(spark):
    assert descent.approximate_knn(frame(spark, np.zeros((1, 2))), 3).count() == 0
    assert descent.approximate_knn(frame(spark, np.zeros((1, 2))).limit(0), 3).count() == 0
    x = np.random.default_rng(5).normal(size=(9, 2))
    got, want = (sorted(map(tuple, found.collect())) for found in (descent.approximate_knn(frame(spark, x), 3), neighbours.knn(frame(spark, x), 3)))
    assert np.allclose(got, want)


def test_slices(spark, monkeypatch):
    """Points in slices of a round find what they find at once."""
    x = np.random.default_rng(6).normal(size=(900, 8)).astype(np.float32).astype(float)
    whole = sorted(map(tuple, descent.approximate_knn(frame(spark, x), 6, rounds=2).collect()))
    monkeypatch.setattr(descent, "SLICE", 900 * 60 * 92 // 4)
    assert sorted(map(tuple, descent.approximate_knn(frame(spark, x), 6, rounds=2).collect())) == whole
    assert recall(spark, x + 1e-9 * x[::-1], 6) >= 0.95  # of double precision


def test_graphs_that_were_followed_go(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    folder, before = spark.conf.get("spark.checkpoint.dir", None), spark.conf.isModifiable("spark.checkpoint.dir")
    spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path}") if before else None
    x = np.random.default_rng(7).normal(size=(1000, 8))
    assert descent.approximate_knn(frame(spark, x), 6, rounds=4).count() == 6000
    if before:
        spark.conf.set("spark.checkpoint.dir", folder) if folder else spark.conf.unset("spark.checkpoint.dir")
    held = [f for f in tmp_path.rglob("*.parquet")] + [f for f in tmp_path.rglob("part-*") if f.is_file() and f.suffix != ".parquet"]
    assert sum(f.stat().st_size for f in held) < 1000 * 30 * 24 + 1000 * 8 * 8  # one graph and the points
