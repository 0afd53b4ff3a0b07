"""Estimators of dimension against the same by loops, and on sets whose dimension is known."""

import math

import numpy as np
import pytest

from cartoflux.operators import dimension, neighbours


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")


def flat(d, width, n=400, seed=5):
    """n points of a d-dimensional cube, turned into more components."""
    rng = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(rng.normal(size=(width, width)))
    return np.pad(rng.random((n, d)), ((0, 0), (0, width - d))) @ turn


def nearest(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    return near, np.take_along_axis(d, near, 1)


def tle_by_loops(x, k):
    near, d = nearest(x, k)
    out = {}
    for i in range(len(x)):
        r, logs, n = d[i, -1], 0.0, 0
        for a in range(k):
            if d[i, a] > 0:
                logs, n = logs + 2 * math.log(d[i, a] / r), n + 1
            for b in range(k):
                v2 = ((x[near[i, a]] - x[near[i, b]]) ** 2).sum()
                if a == b or v2 == 0 or d[i, a] == 0 or d[i, b] == 0:
                    continue
                da, db, found = d[i, a] ** 2, d[i, b] ** 2, []
                for s in (v2, max(0.0, 2 * da + 2 * db - v2)):
                    h = da + s - db
                    found.append(r * s / (r * r + s - db) if d[i, a] >= r else r * (math.sqrt(h * h + 4 * s * (r * r - da)) - h) / (2 * (r * r - da)))
                if min(found) > 0:
                    logs, n = logs + sum(math.log(t / r) for t in found), n + 1
        out[i] = -2 * n / logs
    return out


def test_tight_localities(spark):
    x = flat(2, 4, 80)
    points = frame(spark, x)
    got = {r["id"]: r["d"] for r in dimension.tight_locality(points, neighbours.knn(points, 8), 8).collect()}
    want = tle_by_loops(x, 8)
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-8) for i in want)
    same = frame(spark, np.zeros((12, 3)))
    assert dimension.tight_locality(same, neighbours.knn(same, 4), 4).count() == 0


def test_simplex_skewness(spark):
    x = flat(3, 5, 120)
    points = frame(spark, x)
    got = {r["id"]: r["d"] for r in dimension.simplex_skewness(points, neighbours.knn(points, 9), 9).collect()}
    near, _ = nearest(x, 9)
    expected = lambda n: 0.0 if n == 1 else math.gamma(n / 2) ** 2 / (math.gamma((n + 1) / 2) * math.gamma((n - 1) / 2))
    for i in range(0, 120, 7):
        c = x[near[i]] - x[near[i]].mean(axis=0)
        pairs = [(np.linalg.norm(c[a]) * np.linalg.norm(c[b]), c[a] @ c[b]) for a in range(9) for b in range(a)]
        skew = sum(math.sqrt(max(0, w * w - p * p)) for w, p in pairs) / sum(w for w, _ in pairs)
        n = max(m for m in range(1, 100) if expected(m) <= skew)
        assert math.isclose(got[i], n + (skew - expected(n)) / (expected(n + 1) - expected(n)), rel_tol=1e-7)
    assert np.allclose(dimension.skewness_reference(3), [0, 2 / math.pi, math.pi / 4])


def test_separability(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    x = np.random.default_rng(6).normal(size=(151, 4)) * [1, 1, 0.8, 0.01]
    sphere = dimension.whitened(frame(spark, x))
    u = np.array([r["features"] for r in sorted(sphere.collect(), key=lambda r: r["id"])])
    assert u.shape == (151, 3) and np.allclose(np.linalg.norm(u, axis=1), 1)  # the fourth axis is too thin
    near = u @ u.T
    np.fill_diagonal(near, -1)
    got = {r["alpha"]: r["p"] for r in dimension.inseparable(sphere).collect()}
    assert len(got) == 20 and all(math.isclose(got[a], (near > a).sum() / (151 * 150)) for a in dimension.ALPHAS)


def test_separability_knows_the_sphere(spark):
    x = np.random.default_rng(7).normal(size=(1500, 5))
    assert 4.2 < dimension.fisher_separability(frame(spark, x)).first()[0] < 5.8


def test_graph_lengths(spark):
    import hashlib

    x = flat(2, 3, 200)
    got = {r["level"]: (r["n"], r["length"]) for r in dimension.graph_lengths(frame(spark, x), 4, 3).collect()}
    first = [int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) for i in range(200)]
    for j in range(3):
        own = x[[h < 2 ** (32 - j) for h in first]]
        assert got[j][0] == len(own) and math.isclose(got[j][1], nearest(own, 4)[1].sum())
    assert dimension.graph_lengths(frame(spark, x[:3]), 4).count() == 0


def test_danco(spark):
    x = flat(3, 6, 300)
    points = frame(spark, x)
    got = {r["dimension"]: r["divergence"] for r in dimension.danco(points, neighbours.knn(points, 9), 8, calibration=200).collect()}
    own, nu, tau = dimension.local_statistics(x, 8, 13.0)
    want = {}
    for d in range(1, 7):
        other = dimension.local_statistics(dimension.in_ball(200, d, 42), 8, 13.0)
        want[d] = dimension.distance_divergence(own, other[0], 8) + dimension.angle_divergence(nu, tau, *other[1:])
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], rel_tol=1e-3, abs_tol=1e-4) for d in want)
    assert min(got, key=got.get) == 3
    assert abs(dimension.distance_divergence(4.0, 4.0, 8)) < 1e-9 and abs(dimension.angle_divergence(1.2, 0.7, 1.2, 0.7)) < 1e-9
    assert dimension.distance_divergence(4.0, 7.0, 8) > 0 and dimension.angle_divergence(1.2, 0.7, 0.9, 2.0) > 0


@pytest.mark.parametrize("name", ["FisherS", "KNN", "TLE", "ESS", "DANCo", "MLE"])
def test_names(spark, name):
    found = neighbours.estimate_dimension(frame(spark, flat(2, 4, 250)), name, 10)
    assert 1.2 < found < 3.2, found


def test_calibration_sets_are_as_large_as_the_table(spark):
    x = flat(2, 3, 1200)
    points = frame(spark, x)
    got = {r["dimension"]: r["divergence"] for r in dimension.danco(points, neighbours.knn(points, 9), 8).collect()}
    own, nu, tau = dimension.local_statistics(x, 8, 7.0)
    for d in (1, 2, 3):
        other = dimension.local_statistics(dimension.in_ball(1200, d, 42), 8, 7.0)
        want = dimension.distance_divergence(own, other[0], 8) + dimension.angle_divergence(nu, tau, *other[1:])
        assert math.isclose(got[d], want, rel_tol=1e-6, abs_tol=1e-8)


def test_sets_in_parts():
    x = np.random.default_rng(9).normal(size=(500, 4))
    ends = [0, 130, 131, 300, 500]
    near, d = nearest(x, 6)
    for own in range(4):
        found, vectors = dimension.nearest_in_parts(ends, lambda p: x[ends[p] : ends[p + 1]], own, 6)
        assert np.allclose(found, d[ends[own] : ends[own + 1]]) and np.allclose(vectors, x[near[ends[own] : ends[own + 1]]])
