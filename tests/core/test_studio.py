"""From files to maps, colours, and requests that are made again."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.error import HTTPError

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoflux import studio
from cartoflux.functions.colours import RAMPS, ramp
from cartoflux.functions.text import title_case
from cartoflux.operators import network, semantic, som


@pytest.fixture(scope="module")
def export(tmp_path_factory):
    path = tmp_path_factory.mktemp("studio") / "a.txt"
    words = [("sea", "ship"), ("sea", "wind"), ("ship", "sea"), ("code", "test"), ("code", "loop"), ("test", "code")]
    body = "".join(f"PT J\nAU A{i % 3}\n   B{i % 2}\nTI T{i}\nDE {'; '.join(w)}\nCR r{i % 2}\n   r{i % 3 + 2}\nPY {2000 + i % 2}\nUT {i}\nER\n\n" for i, w in enumerate(words * 4))
    path.write_text(body)
    return str(path)


def test_networks_of_a_file(spark, export):
    kind, records = studio.read(spark, export)
    assert kind == "tagged" and records.count() == 24
    made = studio.preprocess(records, kind, max_terms=6, min_weight=1)
    assert {r["term"]: r["frequency"] for r in made.nodes.collect()} == {"sea": 12, "ship": 8, "wind": 4, "code": 12, "test": 8, "loop": 4}
    assert {(r["source"], r["target"], r["weight"]) for r in made.edges.collect()} == {("sea", "ship", 8), ("sea", "wind", 4), ("code", "test", 8), ("code", "loop", 4)}
    yearly = studio.preprocess(records, kind, max_terms=2, min_weight=1, temporal=True)
    assert {r["label"] for r in studio.rows_of(yearly).collect()} == {f"{y}_{w}" for y in (2000, 2001) for w in ("sea", "code")}
    assert studio.preprocess(records, kind, "co-authorship").edges.count() > 0
    assert studio.preprocess(records, kind, "co-citation", min_weight=1).edges.count() > 0
    two = studio.preprocess(records, kind, "bipartite", max_terms=3, min_weight=1)
    assert {r["target"] for r in two.edges.collect()} <= {r["term"] for r in two.nodes.collect()}
    cited = studio.preprocess(records, kind, "citation")
    assert cited.edges.count() == 48 and studio.preprocess(records, kind, "bibliographic-coupling", min_weight=2).edges.count() > 0
    with pytest.raises(network.UnsupportedNetwork):
        studio.preprocess(records, "ris", "citation")
    assert studio.status(spark)["spark"] == spark.version


def test_a_map_of_a_network(spark, export):
    kind, records = studio.read(spark, export)
    rows = studio.rows_of(studio.preprocess(records, kind, max_terms=6, min_weight=1)).cache()
    of = {r["label"]: r["features"] for r in rows.collect()}
    assert of["sea"] == [0.0, 0.0, 12.0, 8.0, 0.0, 4.0] and len(of) == 6  # code, loop, sea, ship, test, wind
    made = studio.train(rows, som.SomConfig(rows=2, cols=3, iterations=3))
    assert len(made.errors) == 3 and studio.recluster(made, rows, "ward", 2).select("cluster").distinct().count() == 2
    assert [s["k"] for s in studio.evaluate(made, rows, 3)] == [2, 3]
    shown = studio.map_points(made, rows, 2, n_neighbors=3).collect()
    assert {(r["label"], r["value"]) for r in shown} == {(w, f[2]) for w, f in of.items()}
    neurons = studio.map_points(made, rows, 2, "weights", n_neighbors=3).collect()
    assert len(neurons) == 6 and sorted(", ".join(r["label"] for r in neurons if r["label"]).split(", ")) == sorted(of)
    assert np.allclose(sorted(r["value"] for r in neurons), sorted(made.weights[:, 2]))
    with pytest.raises(ValueError):
        studio.map_points(made, rows, 0, "both")
    assert [len(r["features"]) for r in studio.reduce(rows, 2).collect()] == [2] * 6


def test_dimension_of_rows(spark):
    x = np.random.default_rng(1).normal(size=(200, 2)) @ np.random.default_rng(2).normal(size=(2, 5))
    rows = spark.createDataFrame([(i, f"r{i}", v.tolist()) for i, v in enumerate(x)], "row_id long, label string, features array<double>")
    found = studio.estimate(rows, k=10)
    assert found["dimension"] == found["p95"] >= found["p50"] > 1.5 and 1.5 < studio.estimate(rows, "TwoNN")["dimension"] < 2.6


def plain_colour(v, lo, hi, stops, middle=None):
    share = min(1, max(0, (v - lo) / (hi - lo))) if hi > lo else 0
    place = share * (len(stops) - 1)
    if middle is not None:
        place = min(1, max(0, (v - lo) / (middle - lo))) if v <= middle else 1 + min(1, (v - middle) / (hi - middle))
    i = min(int(place), len(stops) - 2)
    rgb = [(int(stops[i][a : a + 2], 16), int(stops[i + 1][a : a + 2], 16)) for a in (1, 3, 5)]
    return "#" + "".join(f"{int(a + (b - a) * (place - i) + 0.5):02x}" for a, b in rgb)


def test_ramps(spark):
    values = [-1.0, 0.0, 0.1, 1.3, 2.0, 2.5, 3.999, 4.0, 9.0]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    for stops in RAMPS.values():
        got = [r[0] for r in df.select(ramp(F.col("v"), F.lit(0.0), F.lit(4.0), stops)).collect()]
        assert got == [plain_colour(v, 0, 4, stops) for v in values] + [None]
    got = [r[0] for r in df.select(ramp(F.col("v"), F.lit(0.0), F.lit(4.0), RAMPS["standard"], F.lit(1.0))).collect()]
    assert got[:-1] == [plain_colour(v, 0, 4, RAMPS["standard"], 1) for v in values]
    assert df.limit(1).select(ramp(F.lit(2.0), F.lit(2.0), F.lit(2.0), RAMPS["viridis"])).first()[0] == "#440154"


def test_titles_of_any_length(spark):
    long = "a" * 1_200_000
    assert spark.createDataFrame([(long,)], "t string").select(F.length(title_case(F.col("t"))).alias("n")).first()["n"] == 1_200_000


def test_requests_are_made_again(monkeypatch):
    answers = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            code = answers.pop(0) if answers else 200
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(json.dumps({"data": [{"index": i, "embedding": [len(t), i]} for i, t in reversed(list(enumerate(texts)))]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    embed = semantic.http_embedder(f"http://127.0.0.1:{server.server_port}/", "m", "key", 10, wait=0.01)
    answers[:] = [503, 429]
    assert embed(["ab", "c"]).tolist() == [[2, 0], [1, 1]] and not answers
    answers[:] = [500] * 9
    with pytest.raises(HTTPError):
        embed(["x"])
    assert len(answers) == 5
    answers[:] = [401, 200]
    with pytest.raises(HTTPError):
        embed(["x"])
    assert answers == [200]
    server.shutdown()
