"""Exact top-k against all products, and against its SQL."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoflux.llm import exact_topk
from cartoflux.llm.exact_topk import best_of, op11_exact_topk, pack, top_k, unpack

SCHEMA = "vec_id long, embedding array<float>, score string"


def plain(rows, every, k, scale=1024):
    """Of (vec_id, vector): (query_id, rank, vec_id, score), by all products of whole numbers within 64 bits."""
    told = lambda s: max(-(2**63), min(2**63 - 1, s))
    fit = [(v, [math.floor(scale * float(np.float32(x))) for x in e]) for v, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (q, a) in enumerate(fit):
        if q is None or q % every:
            continue
        near = [(-told(sum(x * y for x, y in zip(a, b, strict=True))), v is None, v or 0, v) for j, (v, b) in enumerate(fit) if j != i and len(a) == len(b)]
        out += [(q, rank, v, -s) for rank, (s, _, _, v) in enumerate(sorted(near, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, every=5, k=4):
    docs = spark.createDataFrame([(v, e, "clash") for v, e in rows], SCHEMA)
    return sorted(map(tuple, top_k(docs, F.col("vec_id") % every == 0, k).collect()), key=repr)


def test_whole_blocks_against_all_products():
    rng = np.random.default_rng(1)
    for width, scale in ((64, 300), (5, 3), (1, 2), (20, 1)):
        x = np.floor(rng.normal(size=(400, width)) * scale)
        uids, ids = np.arange(400), rng.permutation(400)
        for q in range(0, 400, 57):
            s = x @ x[q]
            want = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], ids[i]))[:7]
            at, score = best_of(x[q], q, -np.inf, 7, uids, ids, np.ascontiguousarray(x.T), (x * x).sum(axis=1))
            assert at.tolist() == want and score.tolist() == s[want].tolist()
            floor = float(s[want[3]])
            at, _ = best_of(x[q], q, floor, 7, uids, ids, np.ascontiguousarray(x.T), (x * x).sum(axis=1))
            assert at.tolist() == [i for i in want if s[i] >= floor]


def test_packing_keeps_all():
    for most in (10, 40_000, 2**40):
        rows = np.array([[most, -most, 3.0], [0, 1, 2]])
        r = {c: v[0] for c, v in pack(3, np.array([7, 9]), [None, 5], [True, False], rows).to_pydict().items()}
        uids, ids, cells = unpack(r)
        assert uids.tolist() == [7, 9] and ids.tolist() == [np.iinfo(np.int64).max, 5] and (cells == rows.T).all()


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "SLICE", 1)
    monkeypatch.setattr(exact_topk, "CHUNK", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    rows += [(5, rows[5][1]), (5, rows[7][1]), (None, rows[5][1]), (70, None), (75, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (80, [float("nan")] * 6), (85, [float("inf")] * 6)]
    rows += [(90, []), (91, []), (95, [1.0, 2.0]), (96, [0.0, -1.0]), (100, [0.0] * 6), (101, [0.0] * 6)] + [(200 + i, [0.5] * 6) for i in range(30)]
    assert found(spark, rows) == plain(rows, 5, 4)
    assert found(spark, []) == [] and found(spark, [(0, [1.0])]) == []
    huge = [(i, [float(np.float32(s)), 1.0]) for i, s in enumerate((3e12, -3e12, 7e12, 1.0, 2e10))]
    assert found(spark, huge, 2, 10) == plain(huge, 2, 10)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_the_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(exact_topk.ORACLE_SQL)
    got = op11_exact_topk(spark, sf)
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows and rows == sorted(want.fetchall())
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(rows, key=repr) == plain(table, 100, 10)
