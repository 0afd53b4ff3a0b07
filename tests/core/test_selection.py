"""Values at ranks against sorting."""

import math
import struct

import numpy as np
from pyspark.sql import functions as F

from cartoflux.operators.selection import at_ranks, ordered_bits, percentiles

ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, -1.0, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 1 / 3, 2.0**-1000, 2.0**1000, 1 - 2**-53, 1 + 2**-52, 3.0, 4.0 - 2**-51, 8.0, 1e-310]


def bits(x):
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def test_bits_of_doubles(spark):
    rng = np.random.default_rng(1)
    values = ODD + [v for v in np.frombuffer(rng.bytes(8 * 3000), np.float64).tolist() if not math.isnan(v)] + [2.0**e * s for e in range(-1074, 1024, 3) for s in (1, -1)]
    values += [math.nextafter(2.0**e, d) for e in range(-1022, 1023, 7) for d in (0, math.inf)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_bits(F.col("v")).alias("b")).collect()
    assert [r["b"] for r in rows] == [bits(r["v"]) for r in rows]


def test_ranks_of_groups(spark):
    rng = np.random.default_rng(2)
    groups = {
        "a": rng.normal(size=3000).tolist(), "b": ODD * 3, "c": [7.0], None: [1.0, 2.0, 2.0, 3.0], "ties": [4.5] * 900 + [4.500000000000001] * 100,
        "wide": (10.0 ** rng.uniform(-300, 300, 500)).tolist(), "bad": [float("nan")], "mixed": [float("nan"), 3.0, None, -3.0],
    }
    rows = spark.createDataFrame([(g, v, 1) for g, vs in groups.items() for v in vs], "g string, v double, n int")
    ranks = {"first": F.lit(0), "quarter": F.floor(F.col("n") * 0.25), "half": F.floor(F.col("n") * 0.5), "last": F.col("n") - 1, "beyond": F.col("n")}
    got = {r["g"]: r for r in at_ranks(rows, "v", ranks, ["g"]).collect()}
    assert got.keys() == groups.keys() - {"bad"}
    for g, vs in groups.items():
        vs = sorted(v for v in vs if v is not None and not math.isnan(v))
        if vs:
            n = len(vs)
            assert tuple(got[g])[1:] == (n, vs[0], vs[-1], vs[0], vs[n // 4], vs[n // 2], vs[-1], None)


def test_percentiles_of_all_rows(spark):
    x = np.random.default_rng(3).normal(size=777)
    rows = spark.createDataFrame([(float(v),) for v in x], "v double")
    r = percentiles(rows, "v", {"p50": 0.5, "p90": 0.9, "p0": 0.0, "p100": 1.0}).first()
    assert np.allclose([r["p50"], r["p90"], r["p0"], r["p100"]], np.percentile(x, [50, 90, 0, 100])) and r["n"] == 777
    assert percentiles(rows.limit(0), "v", {"p50": 0.5}).count() == 0


def test_many_groups_are_joined(spark, monkeypatch):
    monkeypatch.setattr("cartoflux.operators.selection.BROADCAST_ROWS", 3)
    rows = spark.createDataFrame([(i % 7, float((i * 37) % 101)) for i in range(500)], "g int, v double")
    got = {r["g"]: r["half"] for r in at_ranks(rows, "v", {"half": F.floor(F.col("n") / 2)}, ["g"]).collect()}
    for g in range(7):
        vs = sorted(float((i * 37) % 101) for i in range(500) if i % 7 == g)
        assert got[g] == vs[len(vs) // 2]
