import numpy as np

from cartoflux.llm.ann import nearest

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, k, every):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 16}
    ids = np.array(sorted(good))
    points = np.array([good[i] for i in ids])
    out = {}
    for q in [i for i in ids if i % every == 0]:
        scores = points @ good[q]
        order = np.lexsort((ids, -np.round(scores, 12)))
        out[q] = [(int(ids[j]), float(scores[j])) for j in order if ids[j] != q][:k]
    return out


def rows_of(n, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(20, 16))
    rows = [(i, (middles[i % 20] + rng.normal(size=16)).tolist()) for i in range(n)]
    same = rng.normal(size=16).tolist()
    rows += [(n + i, same) for i in range(90)]
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0] * 15]
    return rows + [(n + 100 + 20 * i, v) for i, v in enumerate(odd)]


def test_recall_and_scores(spark):
    rows = rows_of(3000, 1)
    vectors = spark.createDataFrame([(i, v, 7) for i, v in rows], SCHEMA)
    found = nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20).collect()
    want = brute(rows, 20, 20)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.95
    exact = dict(rows)
    for q, hit in got.items():
        assert hit == sorted(hit, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - np.dot(np.float32(exact[q]).astype(float), np.float32(exact[i]).astype(float))) < 1e-9 and i != q for i, s in hit)


def test_all_leaves_give_the_exact_answer(spark):
    rows = rows_of(700, 2)
    vectors = spark.createDataFrame([(i, v, 7) for i, v in rows + rows[:30]], SCHEMA)
    found = nearest(vectors, vectors.filter("vec_id % 20 = 0"), 5, recall=1.0, leaf_rows=16).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in v] for q, v in brute(rows, 5, 20).items()}


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (20, [0.0, 1.0], 1), (40, [1.0, 0.0], 1)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    found = sorted(tuple(r) for r in nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20, recall=1.0).collect())
    assert found[:3] == [(0, 1, 40, 1.0), (0, 2, 1, 0.5), (0, 3, 20, 0.0)] and len(found) == 9
    assert nearest(vectors.limit(0), vectors.limit(0), 20).collect() == []


def test_rows_that_repeat_an_id(spark):
    """Only the query's own row is no candidate: a row of the same id is, with the same vector or another."""
    rows = [(20, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (20, [0.0, 2.0], 1), (3, [0.5, 0.5], 1)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    found = sorted(tuple(r) for r in nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20, recall=1.0).collect())
    first = [(20, 1, 20, 1.0), (20, 2, 3, 0.5), (20, 3, 20, 0.0)]
    other = [(20, 1, 3, 1.0), (20, 2, 20, 0.0), (20, 3, 20, 0.0)]
    assert found == sorted(first + first + other)
