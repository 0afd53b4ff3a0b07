"""Operators on small hand-made inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoflux.functions import text
from cartoflux.operators import clustering, keywords, neighbours, semantic, som, temporal
from cartoflux.operators import network as net
from cartoflux.operators import normalize as norm
from cartoflux.sources import bibliographic as bib
from cartoflux.sources import matrices
from cartoflux.streaming import terms


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def papers(spark):
    return spark.createDataFrame([(1, 2000, ["a", "b", "a"]), (2, 2000, ["b", "a", "c"]), (3, 2001, ["c", "a", "d"])], "doc_id long, year int, terms array<string>")


def test_network(papers):
    made = net.build(net.doc_terms(papers, "terms", "year"), 3, 2, temporal=True)
    assert rows(made.nodes) == [("a", 3), ("b", 2), ("c", 2)]
    assert rows(made.edges) == [("a", "b", 2), ("a", "c", 2)]
    cells = {(r[0], r[1]): r[2] for r in rows(made.adjacency)}
    assert cells["a", "a"] == 3 and cells["b", "a"] == cells["a", "b"] == 2 and ("b", "c") not in cells
    assert rows(made.by_year["edges"]) == [(2000, "a", "b", 2)]
    stack = {(r.label, r.col_term): r.w for r in made.by_year["stack"].collect()}
    assert len(stack) == 18 and stack["2001_b", "b"] == 0 and stack["2000_a", "b"] == 2 and stack["2000_a", "c"] == 0 and stack["2001_a", "a"] == 1
    assert made.document_count() == 3
    wide = net.pivoted(made.adjacency, "row_term", "col_term", "w")
    assert wide.columns == ["row_term", "a", "b", "c"] and rows(wide)[1] == ("b", 2, 2, 0)
    with pytest.raises(net.UnsupportedNetwork):
        net.check_capability("ris", "citation")


def test_two_modes(spark):
    one = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "doc_id long, term string")
    two = spark.createDataFrame([(1, "k"), (2, "k"), (2, "x")], "doc_id long, term string")
    nodes, edges = net.bipartite(one, two, "AU", "DE")
    assert rows(edges) == [("x", "k", 2), ("x", "x", 1), ("y", "k", 1)]
    assert {tuple(r) for r in nodes.select("term", "frequency", "type").collect()} == {("y", 1, "AU"), ("k", 2, "DE"), ("x", 1, "DE")}
    kept, strong = net.filter_bipartite(nodes, edges, "DE", 1, 1)
    assert rows(strong) == [("x", "k", 2), ("y", "k", 1)] and {r.term for r in kept.collect()} == {"y", "k"}


def test_normalisations(spark):
    cells = spark.createDataFrame([(i, c, float(v)) for c, vs in {"zero": [0, 0, 0], "same": [2, 2, 2], "x": [1, 2, 4]}.items() for i, v in enumerate(vs)], "row_id long, component string, value double")
    got = lambda kind: {(r.row_id, r.component): r.value for r in norm.normalise(cells, kind, "csv").collect()}
    assert got("div_max")[1, "x"] == 0.5 and got("div_max")[0, "zero"] == 0 and got("min_max")[2, "same"] == 0
    z = got("z_score")
    assert z[0, "same"] == 0 and math.isclose(sum(z[i, "x"] ** 2 for i in range(3)), 3)
    back = norm.inverse_components(norm.normalise(cells, "z_score", "csv"), cells, "z_score")
    assert np.allclose(sorted(r.value for r in back.collect()), sorted(r.value for r in cells.collect()))
    w = spark.createDataFrame([("a", "a", 0), ("b", "b", 4), ("a", "b", 2), ("c", "c", 0), ("a", "c", 0), ("b", "c", 3), ("c", "b", 9)], "row_term string, col_term string, w long")
    cos = {(r.row_term, r.col_term): r.value for r in norm.normalise(w, "cooc_cosine", "monothematic").collect()}
    assert cos["a", "b"] == math.inf and cos["a", "c"] == 0 and cos["c", "b"] == cos["b", "c"] == math.inf and cos["a", "a"] == 1
    with pytest.raises(ValueError):
        norm.normalise(w, "cooc_cosine", "csv")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_five_numbers(spark, n):
    values = sorted(float((7 * i) % 11) for i in range(n))
    cells = spark.createDataFrame([("c", v) for v in values] + [("c", None), ("c", float("nan"))], "component string, value double")
    r = norm.five_numbers(cells).first()
    assert tuple(r)[1:] == (values[0], values[n // 4], values[n // 2], values[3 * n // 4], values[-1])


@pytest.mark.parametrize("n,window", [(1, 3), (2, 5), (3, 3), (7, 3), (7, 5), (7, 15)])
def test_moving_average(spark, n, window):
    values = [float((5 * i) % 7) for i in range(n)]
    found = temporal.moving_average(spark.createDataFrame([("e", i, v) for i, v in enumerate(values)], "entity string, row_id long, value double"), window)
    for r in found.collect():
        h = min(window // 2, r.row_id, n - 1 - r.row_id)
        assert math.isclose(r.smoothed, np.mean(values[r.row_id - h : r.row_id + h + 1]))


def test_labels(spark):
    want = {"2025_X": ("X", "2025", True), "X_2025": ("X", "2025", True), "2024_2025": ("2025", "2024", True), "a_b": ("b", "a", True), "_X": ("X", "", True), "X": ("X", "", False), "": ("", "", False), "a_b_2020": ("a_b", "2020", True)}
    found = temporal.with_entity_and_time(spark.createDataFrame([(k,) for k in want], "label string")).collect()
    assert {r.label: (r.entity, r.time_text, r.is_temporal) for r in found} == want


def test_spline_passes_its_points(spark):
    pts = spark.createDataFrame([("e", 0, 0.0, 0.0), ("e", 1, 1.0, 2.0), ("e", 2, 3.0, 1.0)], "entity string, row_id long, x double, y double")
    curve = {(r.row_id, r.piece): (r.x, r.y) for r in temporal.spline(pts, 4).collect()}
    assert np.allclose(curve[0, 0], (0, 0)) and np.allclose(curve[0, 4], (1, 2)) and np.allclose(curve[1, 0], (1, 2)) and np.allclose(curve[1, 4], (3, 1))


def test_som(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.1, (40, 3)) for m in (0, 5)])
    data = spark.createDataFrame([(i, f"2020_e{i}", v.tolist()) for i, v in enumerate(x)], "row_id long, label string, features array<double>")
    made = som.train(data, som.SomConfig(rows=3, cols=4, iterations=5, eps=1.0))
    assert made.weights.shape == (12, 3) and len(made.errors) == 5 and made.errors[-1] < made.errors[0]
    assert (made.weights >= x.min(axis=0) - 1e-9).all() and (made.weights <= x.max(axis=0) + 1e-9).all()
    assert made.maps.agg(F.sum("hits")).first()[0] == 80 and made.umatrix.count() == 12 and made.clusters.count() == 12
    grid, start = som.grid_distances(3, 4), som.init_weights(data, 3, 4, "pca")
    bmu = ((x[:, None] - start[None]) ** 2).sum(axis=2).argmin(axis=1)
    h = np.exp(-(grid[:, bmu] ** 2) / (2 * 2.0**2))
    found = som.batch_statistics(data, start, "euclidean")
    assert np.allclose(som.batch_update(start, found["n"], found["x"], grid, 2.0), (h @ x) / h.sum(axis=1, keepdims=True))
    online = som.train(data, som.SomConfig(rows=2, cols=2, iterations=3, method="online", init="random", clustering="ward", n_clusters=2))
    assert online.errors[-1] < online.errors[0] and online.clusters.select("cluster").distinct().count() == 2
    assert (som.init_weights(data, 2, 2, "none") == 0).all()
    pairs = {(r.neuron, r.nrow, r.ncol) for r in som.neighbours(som.hex_grid(spark, 3, 4)).collect()}
    near = {(int(a), int(b) // 4, int(b) % 4) for a, b in zip(*np.nonzero((grid > 0) & (grid < 1.85)), strict=True)}
    assert near == {p for p in pairs if 0 <= p[1] < 3 and 0 <= p[2] < 4}


def test_clusters(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    pts = [(0, 0.0), (1, 1.0), (2, 2.0), (3, 3.0), (4, 5.0), (5, 7.0), (6, 8.0), (7, 9.0), (8, 99.0)]
    data = spark.createDataFrame([(i, [v, 0.0]) for i, v in pts], "id long, features array<double>")
    assert rows(clustering.dbscan(data, 1.0, 3)) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, -1), (5, 1), (6, 1), (7, 1), (8, -1)]
    assert rows(clustering.ward(data, 3)) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1), (7, 1), (8, 2)]
    sweep = clustering.quality_sweep(data, 4)
    assert [s["k"] for s in sweep] == [2, 3, 4] and max(sweep, key=lambda s: s["calinski_harabasz"])["k"] >= 3
    rng = np.random.default_rng(1)
    blobs = np.concatenate([rng.normal(m, 0.2, (30, 2)) for m in (0, 4, 8)])
    made = clustering.hdbscan(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(blobs)], "id long, features array<double>"), 8)
    labels = np.array([c for _, c in rows(made.orderBy("id"))])
    labels = np.array([dict(rows(made))[i] for i in range(90)])
    assert len(set(labels[labels >= 0])) == 3 and (labels >= 0).mean() > 0.8


def test_neighbours_and_dimension(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 8))
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    near = {(r.id, r.rank): r.neighbour for r in neighbours.knn(data, 3).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert all(near[i, k + 1] == j for i in range(400) for k, j in enumerate(np.argsort(d[i])[:3]))
    for name in ("MLE", "TwoNN", "MOM", "MADA", "MiND_ML", "lPCA"):
        assert 1.9 < neighbours.estimate_dimension(data, name, 10) < 4.1, name
    with pytest.raises(ValueError):
        neighbours.estimate_dimension(data, "nothing")
    scores = np.array([r.scores for r in neighbours.pca(data, 3).orderBy("id").collect()])
    assert np.allclose(((x - x.mean(axis=0)) ** 2).sum(), (scores**2).sum())
    assert [neighbours.target_dimension(*a) for a in ((50, 1, None, True), (50, 7, None), (50, None, 3.2), (5, None, None))] == [2, 7, 4, 4]
    small = data.filter("id < 60")
    a, b = (rows(neighbours.umap(small, epochs=30, n_neighbors=8)) for _ in range(2))
    assert a == b and len(a) == 60 and np.isfinite([r[1] for r in a]).all()


def test_text(spark):
    r = spark.range(1).select(
        text.clean_text(F.lit(" <b>A</b>\n\tb ")).alias("c"), text.title_case(F.lit("deep-learning of x")).alias("t"), text.split_terms(F.lit(" A ;;b\t; ")).alias("s"),
        text.first_doi([F.lit(" ")], [F.lit("no"), F.lit("x 10.1234/ABC.d)")]).alias("d"), text.doi_url(F.lit("PMID_7"), F.lit("x")).alias("u"),
    ).first()
    assert (r.c, r.t, r.s, r.d, r.u) == ("A b", "Deep-Learning Of X", ["a", "b"], "10.1234/ABC.d", "https://pubmed.ncbi.nlm.nih.gov/7")


def test_files(spark, tmp_path):
    ris = tmp_path / "a.ris"
    ris.write_text("\nTY  - JOUR\nT1  - One\nT1  - Two\nPY  - 2023///\nKW  - Deep Learning\nKW  -  deep learning \nAU  - A\nER  - \nTY  - BOOK\nTI  - Last\n")
    kind, found = bib.read_records(spark, str(ris))
    assert kind == "ris" and [(r.title, r.year, r.terms, r.authors) for r in found.orderBy("doc_id").collect()] == [("One", "2023", ["deep learning"], ["a"]), ("Last", "", [], [])]
    scopus = tmp_path / "b.csv"
    scopus.write_text('﻿"Authors","Title","Year","Author Keywords","EID"\n"A;B","x ""q""\ny",2020,"K1; k2;K1",e1\n', encoding="utf-8")
    kind, found = bib.read_records(spark, str(scopus))
    assert kind == "scopus" and [tuple(r) for r in found.collect()] == [("e1", 'x "q"\ny', "2020", ["k1", "k2", "k1"], ["a", "b"])]
    tagged = tmp_path / "c.txt"
    tagged.write_text("FN x\nVR 1\nPT J\nAU A, B\n   C, D\nTI A long\n   title\nDE K1; K2\nCR ref one\n   ref two\nPY 1999\nER\n\nPT J\nTI Other\nER\nEF\n")
    kind, found = bib.read_records(spark, str(tagged))
    got = found.orderBy("doc_id").collect()
    assert kind == "tagged" and (got[0].title, got[0].year, got[0].terms, got[0].authors, got[0].refs) == ("A long title", "1999", ["k1", "k2"], ["a, b", "c, d"], ["ref one", "ref two"])
    assert got[1].title == "Other" and got[1].year is None and got[1].terms == []
    profile = tmp_path / "d.csv"
    profile.write_text('Name,a,b\n\n"x, ""y""",1.5kg,-\nshort,1\nz, 2e1 ,3\n')
    made, names = matrices.read_profile(spark, str(profile))
    assert names == ["a", "b"] and [(r.label, r.features) for r in made.orderBy("row_id").collect()] == [('x, "y"', [1.5, 0.0]), ("z", [20.0, 3.0])]
    numbers = tmp_path / "e.csv"
    numbers.write_text("h,2\n1,x\n3,4\n")
    assert [r.features for r in matrices.read_numbers(spark, str(numbers)).orderBy("row_id").collect()] == [[1.0, 0.0], [3.0, 4.0]]
    matrices.save_project(str(tmp_path / "p"), {"m": made}, {"k": 1}, spark)
    tables, settings = matrices.load_project(spark, str(tmp_path / "p"))
    assert settings == {"k": 1} and tables["m"].count() == 2
    again = matrices.features(matrices.cells(made, names), names)
    assert rows(again.select("label", "features")) == rows(made.select("label", "features"))


def test_keywords(spark):
    titles = spark.createDataFrame([(1, "The deep learning of maps"), (2, "Deep learning para mapas"), (3, "la de y")], "id long, title string")
    scores = {r.term: r.score for r in keywords.term_scores(titles).collect()}
    assert "deep learning" in scores and "the" not in scores and "learning maps" in scores
    assert keywords.top_keywords(titles, 2).first().keywords[0] in ("Deep", "Learning", "Deep Learning")
    assert keywords.term_scores(titles.filter("id = 3")).collect() == []


def test_semantic(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    body = "TI <i>A</i> title\nAB Some 10.5555/xyz text\nDE k1; k2\nAU A\n   B\nPY 2001\nSO J\nER\n"
    other = "PMID- 12\nTI  - Other\nMH  - m1\n\n"
    lines = bib.split_lines(spark.createDataFrame([("f", body), ("g", other)], "file string, t string"), "file", "t")
    a, b = semantic.semantic_records(bib.parse_tagged(lines)).orderBy("file").collect()
    assert (a.id, a.title, a.keywords, a.extras["AU"], a.extras["PY"]) == ("10.5555/xyz", "A title", ["k1", "k2"], "A, B", "2001")
    assert a.concatenated_text == "Title: A title | Abstract: Some 10.5555/xyz text | Keywords: k1, k2 | Journal: J"
    assert b.keywords == ["m1"] and b.doi == "" and b.id == "PMID_12"
    texts = spark.createDataFrame([(i, ["sea ship sail wind", "code data test loop"][i % 2] + f" w{i}") for i in range(60)], "row_id long, concatenated_text string")
    points = semantic.embed(texts)
    with pytest.raises(ValueError):
        semantic.embed(texts, "nothing")
    clusters = semantic.first_level(points, 10)
    xy = neighbours.pca(points, 2).select("id", F.col("scores")[0].alias("x"), F.col("scores")[1].alias("y"))
    tree, assignment = semantic.topics(clusters.join(xy, "id"), texts.selectExpr("row_id AS id", "concatenated_text AS title"), 10)
    assert assignment.count() == 60 and tree.filter("level = 1").count() >= 1 and tree.filter("size < 10").count() == 0


def test_stream(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 02:00:00", "a", 2.0), ("2024-01-02 01:00:00", "b", 4.0)], "t string, event_type string, value double")
    events = events.select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = terms.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert rows(spark.table("counts")) == rows(terms.windowed_counts(events))


def test_grouping_sets(spark):
    dt = spark.createDataFrame([(1, 2000, "a"), (1, 2000, "b"), (2, 2000, "a"), (2, 2000, "b"), (3, 2001, "b"), (3, 2001, "a"), (4, None, "a"), (4, None, "b"), (5, 2001, "z")], "doc_id long, year int, term string")
    assert rows(net.cooccurrence_sets(dt)) == [(2000, True, "a", "b", 2), (2001, True, "a", "b", 1), (None, False, "a", "b", 4)]
    plan = net.cooccurrence_sets(dt)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Join") == 1
    assert net.cooccurrence_sets(dt.limit(0)).count() == 0


def test_many_kmeans(spark):
    rng = np.random.default_rng(3)
    spots = {"a": [(0, 0), (9, 0), (0, 9)], "b": [(5, 5), (-5, -5)], "c": [(1, 1)]}
    points, i = [], 0
    for path, centres in spots.items():
        for n, c in enumerate(centres):
            for _ in range(30 + 5 * n):
                points.append((path, i, *(rng.normal(c, 0.3)).tolist(), len(centres), f"{path}{n}"))
                i += 1
    points += [("same", 1000 + j, 2.0, 2.0, 2, "same") for j in range(20)]
    df = spark.createDataFrame(points, "path string, id long, x double, y double, k int, true string")
    found = semantic.many_kmeans(df).join(df.select("id", "true"), "id").collect()
    parts = {}
    for r in found:
        parts.setdefault(r["true"], set()).add(r["part"])
    assert len(found) == len(points) and all(len(p) == 1 for p in parts.values())
    assert len({(t[0], *p) for t, p in parts.items() if t != "same"}) == 6
    # every point is nearest to the mean of its own part
    for path in spots:
        own = [r for r in found if r["path"] == path]
        means = {p: np.mean([(r["x"], r["y"]) for r in own if r["part"] == p], axis=0) for p in {r["part"] for r in own}}
        assert all(min(means, key=lambda p: np.hypot(*(means[p] - (r["x"], r["y"])))) == r["part"] for r in own)
    cut = semantic.sub_clusters(df.select("id", "path", "x", "y"), 25, 2)
    sizes = {r["path"]: r["count"] for r in cut.groupBy("path").count().collect()}
    assert all(n >= 25 for n in sizes.values()) and {p.split(".")[0] for p in sizes} <= {"a", "b"} and sizes["a.0"] >= sizes["a.1"]
    assert semantic.many_kmeans(df.limit(0)).count() == 0


def test_stream_network(spark, tmp_path):
    from cartoflux.streaming import network as stream

    first = [(f"2024-01-0{d} 0{h}:00:00", f"p{d}{h}", t) for d in (1, 2) for h in (1, 2) for t in ("a", "b", "c")[: h + 1]]
    again = [("2024-01-02 03:00:00", "p22", "z"), ("2024-01-02 02:30:00", "p22", "a"), ("2024-01-09 01:00:00", "p91", "b"), ("2024-01-09 01:00:00", "p91", "a"), ("2024-01-09 01:00:00", None, "a"), ("2024-01-09 01:00:00", "p91", None)]
    after = [("2024-01-01 05:00:00", "late", "a"), ("2024-01-01 05:00:00", "late", "b"), ("2024-01-09 02:00:00", "p91", "c")]
    make = lambda rs: spark.createDataFrame(rs, "t string, doc_id string, term string").select(F.to_timestamp("t").alias("ts"), "doc_id", "term")
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def feed(rs):
        make(rs).coalesce(1).write.mode("append").parquet(source)
        terms_stream = spark.readStream.schema(make(rs).schema).parquet(source)
        run = stream.keep(stream.new_pairs(terms_stream, "1 day"), sink, state)  # each time a new query from the same checkpoint
        run.awaitTermination(120)

    feed(first)
    feed(again)
    got = rows(stream.network(spark, sink))
    known = make(first + again).filter("doc_id IS NOT NULL AND term IS NOT NULL").select("doc_id", "term").distinct()
    assert got == rows(net.cooccurrence(known)) and ("a", "z", 1) in got
    feed(after)  # the watermark has passed the late document, not the other
    in_time = make(first + again + after).filter("doc_id <> 'late' AND term IS NOT NULL").select("doc_id", "term").distinct()
    assert rows(stream.network(spark, sink)) == rows(net.cooccurrence(in_time))
