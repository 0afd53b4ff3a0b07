"""Topics of documents: records, embeddings, reduction, and a labelled hierarchy of clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartoflux.functions.arrays import list_column
from cartoflux.functions.settle import settled
from cartoflux.functions.text import NOISE, choose_keywords, clean_text, doi_in_tags, embedding_text, surrogate_id
from cartoflux.operators.clustering import MOST_POINTS, hdbscan, kmeans, medians
from cartoflux.operators.keywords import top_keywords
from cartoflux.sources.bibliographic import tag_values
from cartoflux.sources.scan import ranked

BATCH = 32


def _first(tags: Column, *names: str) -> Column:
    options = [F.try_element_at(F.filter(tag_values(tags, n), lambda v: v != ""), F.lit(1)) for n in names]
    return F.coalesce(*options, F.lit(""))


def semantic_records(records: DataFrame, use_mesh: bool = True) -> DataFrame:
    """(row_id, id, doi, title, abstract, keywords, concatenated_text, extras) of tagged records (file, rec, tags).

    Extras are the other tags, authors joined by commas and other lists by bars, with fallbacks for authors,
    year and source."""
    t = F.col("tags")
    numbered = ranked(records, "rec", "row_id")
    doi = F.coalesce(F.try_element_at(F.filter(tag_values(t, "DI"), lambda v: v != ""), F.lit(1)), doi_in_tags(t))
    split = lambda name: F.flatten(F.transform(tag_values(t, name), lambda v: F.split(v, ";")))
    keywords = choose_keywords(tag_values(t, "MH"), split("DE"), tag_values(t, "OT"), split("ID"), use_mesh)
    joined = F.transform_values(t, lambda k, v: F.when(k == "AU", F.array_join(v, ", ")).otherwise(F.array_join(v, " | ")))
    others = F.map_filter(joined, lambda k, v: ~k.isin("TI", "T1", "AB", "DE", "ID", "MH", "OT", "DI", "PMID", "AU", "PY", "SO"))
    known = F.map_from_arrays(
        F.array(F.lit("AU"), F.lit("PY"), F.lit("SO")),
        F.array(
            F.coalesce(F.nullif(F.array_join(tag_values(t, "AU"), ", "), F.lit("")), F.array_join(tag_values(t, "AF"), ", ")),
            F.coalesce(F.nullif(_first(t, "PY"), F.lit("")), F.substring(_first(t, "DP"), 1, 4)),
            _first(t, "SO", "JT"),
        ),
    )
    made = numbered.select(
        "file", "row_id", F.coalesce(doi, F.lit("")).alias("doi"), clean_text(_first(t, "TI", "T1")).alias("title"), clean_text(_first(t, "AB")).alias("abstract"),
        keywords.alias("keywords"), _first(t, "PMID").alias("pmid"), F.map_concat(others, known).alias("extras"),
    )
    return made.select(
        "file", "row_id", surrogate_id(F.col("doi"), F.col("pmid"), F.col("row_id")).alias("id"), "doi", "title", "abstract", "keywords",
        embedding_text(F.col("title"), F.col("abstract"), F.col("keywords"), F.col("extras")["SO"]).alias("concatenated_text"), "extras",
    )


def hashing_embedder(texts: list[str], width: int = 64) -> np.ndarray:
    """A deterministic stand-in for a model: signed hashed words, scaled to length 1."""
    out = np.zeros((len(texts), width))
    for row, text in zip(out, texts, strict=True):
        for w in text.lower().split():
            h = xxhash.xxh3_64_intdigest(w.encode())
            row[h % width] += 1 if h >> 63 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


#: Answers after which a request is made again: the server is busy or failed.
AGAIN = (408, 429, 500, 502, 503, 504)


def http_embedder(url: str, model: str, key: str | None = None, timeout: float = 60.0, tries: int = 4, wait: float = 1.0) -> Callable[[list[str]], np.ndarray]:
    """Texts to vectors by a server with the common embeddings interface; certificates are verified, and the
    key goes in a header. A request that fails on the way, or whose answer says that the server is busy, is made again
    after a wait that doubles each time; other errors, and the last one, are raised."""

    def embed(texts: list[str]) -> np.ndarray:
        import json
        import time
        from urllib.error import HTTPError, URLError
        from urllib.request import Request, urlopen

        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        for attempt in range(tries):
            try:
                with urlopen(Request(url, json.dumps({"model": model, "input": texts}).encode(), head), timeout=timeout) as reply:
                    rows = json.load(reply)["data"]
                break
            except (HTTPError, URLError, TimeoutError, ConnectionError) as error:
                if attempt + 1 == tries or isinstance(error, HTTPError) and error.code not in AGAIN:
                    raise
                time.sleep(wait * 2**attempt)
        return np.array([r["embedding"] for r in sorted(rows, key=lambda r: r["index"])])

    return embed


EMBEDDERS: dict[str, Callable[[list[str]], np.ndarray]] = {"hashing": hashing_embedder}


def embed(texts: DataFrame, model: str | Callable[[list[str]], np.ndarray] = "hashing", column: str = "concatenated_text") -> DataFrame:
    """(id, features): texts in batches of 32. ``model`` is a registered name or a function of a list of texts."""
    if isinstance(model, str) and model not in EMBEDDERS:
        raise ValueError(f"unknown model {model}; one of {', '.join(EMBEDDERS)}")
    run_batch = EMBEDDERS[model] if isinstance(model, str) else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v or "" for v in batch.column(1).to_pylist()]
            if values:
                made = np.concatenate([run_batch(values[i : i + BATCH]) for i in range(0, len(values), BATCH)])
                yield pa.RecordBatch.from_arrays([batch.column(0), list_column(made)], names=["id", "features"])

    return texts.select(F.col("row_id").cast("long").alias("id"), column).mapInArrow(run, "id long, features array<double>")


def fallback(points: DataFrame) -> DataFrame:
    """(id, cluster) by KMeans with min(5, max(2, n // 20)) clusters: for sets without clusters of their own, or too
    large for a tree of them."""
    return kmeans(points, min(5, max(2, points.count() // 20))).select("id", "cluster")


def first_level(points: DataFrame, min_size: int) -> DataFrame:
    """HDBSCAN; where it finds two labels at most, or there are more points than it takes, the fallback."""
    if points.limit(MOST_POINTS + 1).count() > MOST_POINTS:
        return fallback(points)
    found = hdbscan(points, min_size)
    return found if found.select("cluster").distinct().count() > 2 else fallback(points)


#: Rounds of k-means at most.
ROUNDS = 50


def many_kmeans(placed: DataFrame) -> DataFrame:
    """(path, id, x, y, part) of (path, id, x, y, k): the points of each path in k parts, all paths at once.

    A path's first centre is the point whose id hashes lowest, each further one the point farthest from those before
    (of equals the smaller id). A round sends the paths' few centres to the points and adds up the points by path and
    part before they are shuffled, so neither a large path nor many paths are brought together anywhere.
    """
    own = settled(placed.select("path", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "k"))
    spot = F.struct("x", "y")
    apart = lambda c: (F.col("x") - c["x"]) * (F.col("x") - c["x"]) + (F.col("y") - c["y"]) * (F.col("y") - c["y"])
    distances = F.transform("centres", apart)
    most = own.agg(F.max("k")).first()[0] or 0
    centres = settled(own.groupBy("path").agg(F.array(F.min_by(spot, F.struct(F.xxhash64("id"), "id"))).alias("centres")))
    for step in range(1, most):
        near = own.filter(F.col("k") > step).join(centres, "path").select("path", "x", "y", "id", F.array_min(distances).alias("d"))
        farthest = near.groupBy("path").agg(F.max_by(spot, F.struct("d", -F.col("id"))).alias("next"))
        grown = centres.join(farthest, "path", "left")
        centres = settled(grown.select("path", F.when(F.col("next").isNull(), F.col("centres")).otherwise(F.concat("centres", F.array("next"))).alias("centres")))
    part = (F.array_position(distances, F.array_min(distances)) - 1).cast("int")
    for _ in range(ROUNDS):
        sums = own.join(centres, "path").select("path", part.alias("part"), "x", "y").groupBy("path", "part").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
        means = sums.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("part", spot.alias("spot")))).alias("means"))
        moved = F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("means", i), c))  # a part without points keeps its centre
        now = centres.join(means, "path").select("path", moved.alias("moved"), "centres")
        close = lambda a, b: F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)
        same = F.forall(F.arrays_zip("moved", "centres"), lambda z: close(z["moved"]["x"], z["centres"]["x"]) & close(z["moved"]["y"], z["centres"]["y"]))
        now = settled(now.select("path", F.col("moved").alias("centres"), same.alias("same")))
        centres = now.select("path", "centres")
        if not now.filter("NOT same").take(1):
            break
    return own.join(centres, "path").select("path", "id", "x", "y", part.alias("part"))


def sub_clusters(placed: DataFrame, min_size: int, levels: int) -> DataFrame:
    """(id, path, level) below the first level: each cluster (id, path, x, y) is cut into at most four by its
    plane coordinates while that leaves ``min_size`` points a part; smaller parts are dropped, the others
    numbered by falling size."""
    now, out = placed.select("id", "path", "x", "y"), None
    for level in range(2, levels + 1):
        parts = F.least(F.lit(4), F.floor(F.col("count") / min_size).cast("int"))
        large = now.groupBy("path").count().select("path", parts.alias("k")).filter("k >= 2")
        cut = settled(many_kmeans(now.join(large, "path")))
        sizes = cut.groupBy("path", "part").count()
        order = F.row_number().over(W.partitionBy("path").orderBy(F.desc("count"), "part")) - 1  # at most four of a path
        kept = sizes.withColumn("number", order).filter(F.col("count") >= min_size)
        now = settled(cut.join(kept, ["path", "part"]).select("id", F.concat_ws(".", "path", F.col("number").cast("string")).alias("path"), "x", "y"))
        step = now.select("id", "path", F.lit(level).alias("level"))
        out = step if out is None else out.unionByName(step)
    return out if out is not None else placed.select("id", "path", F.lit(1).alias("level")).limit(0)


def topics(placed: DataFrame, titles: DataFrame, min_size: int, levels: int = 2, labeler: Callable[[DataFrame], DataFrame] | None = None):
    """(tree, assignment) of placed points (id, cluster, x, y) and titles (id, title).

    tree: path, parent_path, level, label, x, y, size, with the noise cluster in it if large enough;
    assignment: id and its first-level label, noise for clusters that are too small. A label is the two best
    keywords, else a number; ``labeler`` may replace (path, label)."""
    first = placed.select("id", F.col("cluster").cast("string").alias("path"), F.lit(1).alias("level"))
    kept = first.groupBy("path").count().filter(F.col("count") >= min_size).select("path")
    first = first.join(kept, "path", "left_semi").select("id", "path", "level")
    xy = placed.select("id", "x", "y")
    every = first.unionByName(sub_clusters(first.join(xy, "id"), min_size, levels))
    every = settled(every)
    centres = medians(every.join(xy, "id").select(F.col("path").alias("cluster"), "x", "y")).withColumnRenamed("cluster", "path")
    # a title goes once to its clusters of all levels
    paths = every.groupBy("id").agg(F.collect_list("path").alias("paths"))
    words = top_keywords(paths.join(titles, "id").select(F.explode("paths").alias("path"), "id", "title"), 5, by="path")
    level = F.size(F.split("path", r"\."))
    number = F.element_at(F.split("path", r"\."), -1)
    plain = F.when(level == 1, F.concat(F.lit("Tema "), number)).otherwise(F.concat(F.lit("Sub-tema "), number))
    label = F.coalesce(F.nullif(F.array_join(F.slice("keywords", 1, 2), " / "), F.lit("")), plain)
    tree = centres.join(words, "path", "left").select(
        "path", F.when(level > 1, F.regexp_replace("path", r"\.[^.]*$", "")).alias("parent_path"), level.alias("level"),
        F.when(F.col("path") == "-1", F.lit(NOISE)).otherwise(label).alias("label"), "x", "y", "size",
    )
    if labeler:
        named = labeler(every).select("path", F.col("label").alias("__label"))
        tree = tree.join(named, "path", "left").withColumn("label", F.coalesce("__label", "label")).drop("__label")
    own = tree.filter("level = 1").select("path", "label")
    assignment = placed.select("id", F.col("cluster").cast("string").alias("path")).join(own, "path", "left").select("id", F.coalesce("label", F.lit(NOISE)).alias("label"))
    return tree, assignment
