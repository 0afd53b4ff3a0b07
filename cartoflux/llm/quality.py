"""Quality classifier by hierarchical empirical Bayes: a document's own evidence is combined with posteriors
of its host and of its path, sparse sites shrunk toward the global prior by grouped aggregation.

Own evidence: hashed word n-grams (single words and pairs, ``BUCKETS`` each) have weights, the log odds of the
good documents that hold them, learned from one half of the labelled rows; a document's mean weight is one
measure, beside seven of its surface. Each measure's bins have rates from labelled rows (those of the mean
weight from the other half), and their summed log odds, tempered by ``TEMPER`` as measures overlap, are the
evidence. What is fitted comes from at most about ``FIT_ROWS`` labelled rows, by hash of their ids.

Site levels: (host) and (host, path), here the columns source and lang, as the table has no urls; a site's rate
is its documents' summed posteriors under its parent's rate, with a prior of as many documents as the spread
of rates between sites supports (method of moments). The last posterior takes the path's rate for its prior.
These cover all documents, and every document is scored in one pass over the texts.

Edge cases: a null text is an empty one; a null source or lang is a site of its own; labels that are null,
or of no document, are ignored, and a document labelled twice counts twice; without labels of both kinds
the evidence is 0 and all are kept; rows repeated are judged each; very long texts are judged whole; an empty
table gives no rows; extra columns are ignored by ``judge`` and kept by ``accepted``, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartoflux.llm.common import Staging, documents

TEMPER = 0.7
#: A document is rejected if it is less likely than this to be good.
KEEP_FROM = 0.2
#: No site's prior counts for fewer or more documents than this.
LEAST_PRIOR, MOST_PRIOR = 10.0, 10_000.0
#: Labelled rows that are fitted on, and buckets of words and of pairs.
FIT_ROWS, BUCKETS = 50_000, 1 << 17

_SHARE_EDGES = np.array((0.0, 0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9))
MEASURES = ("upper", "marks", "digits", "stops", "distinct", "repeats", "length", "grams")
_UPPER, _MARKS, _DIGITS, _STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!#$%&*|@<>{}[]=~^", b"0123456789", b".,;:?"


@dataclass
class Weights:
    """What is learned: log odds of the n-grams' buckets, and of the bins of each measure."""

    grams: np.ndarray = field(default_factory=lambda: np.zeros(2 * BUCKETS))
    bins: dict[tuple[int, int], float] = field(default_factory=dict)


def _share_bin(part: int, of: int) -> int:
    return int(np.searchsorted(_SHARE_EDGES, part / max(of, 1), "left"))


def _words(text: bytes) -> list[bytes]:
    """Words between white space, A-Z lower-cased."""
    return text.lower().split()


def surface(text: bytes, words: list[bytes]) -> tuple[int, ...]:
    """The bins of the first seven measures."""
    n, count = len(text), len(words)
    without = lambda marks: n - len(text.translate(None, marks))
    return (
        _share_bin(without(_UPPER), n),
        _share_bin(without(_MARKS), n),
        _share_bin(without(_DIGITS), n),
        _share_bin(without(_STOPS), count),
        _share_bin(len(set(words)), count),
        _share_bin(sum(map(eq, words, words[1:])), count),
        n.bit_length(),
    )


def gram_bin(mean: float) -> int:
    return int(min(max(math.floor(mean * 8), -24), 24))


def grams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct n-grams of each text, by text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    hashes = np.fromiter(map(zlib.crc32, chain.from_iterable(texts)), np.uint64, total)
    text = np.repeat(np.arange(len(texts)), sizes)
    pairs = (hashes[:-1] * np.uint64(0x9E3779B1) + hashes[1:]) >> np.uint64(7)
    inside = text[1:] == text[:-1]
    codes = np.concatenate(
        [text * 2 * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), text[1:][inside] * 2 * BUCKETS + BUCKETS + (pairs[inside] % np.uint64(BUCKETS)).astype(np.int64)]
    )
    codes = np.unique(codes)
    return codes // (2 * BUCKETS), codes % (2 * BUCKETS)


def _parts(column, most: int = 1 << 22) -> Iterator[tuple[list[bytes], list[list[bytes]]]]:
    """Texts and their words, some bytes at a time."""
    texts, size = [], 0
    for text in column:
        texts.append(text.as_py() or b"")
        size += len(texts[-1])
        if size > most:
            yield texts, [_words(t) for t in texts]
            texts, size = [], 0
    if texts:
        yield texts, [_words(t) for t in texts]


def _measured(texts: list[bytes], words: list[list[bytes]], weights: Weights) -> Iterator[tuple[int, ...]]:
    text, bucket = grams(words)
    means = np.bincount(text, weights.grams[bucket], len(texts)) / np.maximum(np.bincount(text, minlength=len(texts)), 1)
    for t, w, mean in zip(texts, words, means.tolist(), strict=True):
        yield (*surface(t, w), gram_bin(mean))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, good, bad): labelled documents that hold an n-gram of the bucket."""
    total = np.zeros((2, 2 * BUCKETS), np.int64)
    for batch in batches:
        quality, at = batch.column(1).to_numpy(), 0
        for texts, words in _parts(batch.column(0)):
            text, bucket = grams(words)
            good = quality[at + text] == 1
            total[0] += np.bincount(bucket[good], minlength=2 * BUCKETS)
            total[1] += np.bincount(bucket[~good], minlength=2 * BUCKETS)
            at += len(texts)
    found = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[0, found]), pa.array(total[1, found])], names=["bucket", "good", "bad"])


def _count_bins(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], list[int]] = {}
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for texts, words in _parts(batch.column(0)):
                for bins in _measured(texts, words, shared.value):
                    quality, half = next(rows)
                    for measure, at in enumerate(bins):
                        if half or measure < len(MEASURES) - 1:
                            found.setdefault((measure, at), [0, 0])[1 - quality] += 1
        columns = zip(*((m, b, *n) for (m, b), n in found.items()), strict=True) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["measure", "bin", "good", "bad"])

    return count


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Weights, float]:
    """The weights, and the rate of good documents, from labelled rows."""
    spark = docs.sparkSession
    valid = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").alias("__id"), F.col("quality").cast("long").alias("quality"))
    counted = {r["quality"]: r["count"] for r in valid.groupBy("quality").count().collect()}
    if not counted.get(0) or not counted.get(1):
        return Weights(), 0.5
    share = min(1.0, FIT_ROWS / sum(counted.values()))
    spread = F.crc32(F.col("__id").cast("string").cast("binary"))
    chosen = valid.filter(spread.bitwiseAND(0xFFFFF) < share * (1 << 20)).withColumn("half", F.shiftright(spread, 20).bitwiseAND(1).cast("int"))
    marked = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))  # FIT_ROWS rows
    marked = Staging(spark, "labelled").table(marked.select("text", "quality", "half"), "rows")

    weights = Weights()
    of = {r["quality"]: r["count"] for r in marked.filter("half = 0").groupBy("quality").count().collect()}
    sums = marked.filter("half = 0").mapInArrow(_count_grams, "bucket long, good long, bad long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    for r in sums.collect():  # as many as there are buckets
        weights.grams[r["bucket"]] = math.log((r["good"] + 1) / (of.get(1, 0) + 2)) - math.log((r["bad"] + 1) / (of.get(0, 0) + 2))
    shared = spark.sparkContext.broadcast(weights)
    bins = marked.mapInArrow(_count_bins(shared), "measure long, bin long, good long, bad long").groupBy("measure", "bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    odds = {}
    for measure in range(len(MEASURES)):
        own = [r for r in bins if r["measure"] == measure]
        good, bad = sum(r["good"] for r in own), sum(r["bad"] for r in own)
        for r in own:
            odds[measure, r["bin"]] = math.log((r["good"] + 0.5) / (good + 0.5 * len(own))) - math.log((r["bad"] + 0.5) / (bad + 0.5 * len(own)))
    return Weights(weights.grams, odds), counted[1] / (counted[0] + counted[1])


def _evidence(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: Weights = shared.value
        for batch in batches:
            out = []
            for texts, words in _parts(batch.column("text")):
                out += [TEMPER * sum(weights.bins.get(b, 0.0) for b in enumerate(bins)) for bins in _measured(texts, words, weights)]
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(out, pa.float64())], names=[*kept, "evidence"])

    return score


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _posterior(evidence: Column, rate: Column) -> Column:
    return 1 / (1 + F.exp(-(evidence + _logit(rate))))


def _strength(sites: DataFrame, parent: str) -> float:
    """Documents that a site's prior counts for: from the variance of site rates beyond that of sampling."""
    row = sites.agg(
        F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - F.col(parent), 2)).alias("between"),
        F.sum(F.col(parent) * (1 - F.col(parent))).alias("within"),
        F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))).alias("spread"),
        F.count("*").alias("sites"),
    ).first()
    if not row["sites"] or row["between"] <= row["within"]:
        return MOST_PRIOR
    share = (row["between"] - row["within"]) / max(row["spread"] - row["within"], 1e-9)  # intraclass correlation
    return min(MOST_PRIOR, max(LEAST_PRIOR, 1 / max(share, 1e-9) - 1))


def _judged(docs: DataFrame, labels: DataFrame, row: Column, host: str, path: str) -> DataFrame:
    """row, evidence, host_rate, path_rate and quality of every document."""
    spark = docs.sparkSession
    stage = Staging(spark, "quality")
    weights, rate = learn(docs, labels)
    rows = docs.select(row.alias("row"), F.col(host).alias("host"), F.col(path).alias("path"), F.col("text").cast("binary").alias("text"))
    schema = T.StructType([*(f for f in rows.schema if f.name != "text"), T.StructField("evidence", T.DoubleType())])
    rows = stage.table(rows.mapInArrow(_evidence(spark.sparkContext.broadcast(weights)), schema), "evidence")

    def level(rows: DataFrame, keys: list[str], parent: Column, name: str) -> DataFrame:
        sites = rows.withColumn("parent", parent).groupBy(*keys).agg(
            F.count("*").alias("n"), F.sum(_posterior(F.col("evidence"), F.col("parent"))).alias("total"), F.first("parent").alias("parent")
        )
        sites = stage.table(sites, name)
        strength = _strength(sites, "parent")
        return sites.select(*[F.col(k).alias(f"__{k}") for k in keys], ((F.col("parent") * strength + F.col("total")) / (strength + F.col("n"))).alias(name))

    hosts = level(rows, ["host"], F.lit(rate), "host_rate")
    rows = rows.join(hosts, F.col("host").eqNullSafe(F.col("__host")), "left").drop("__host")
    paths = level(rows, ["host", "path"], F.col("host_rate"), "path_rate")
    rows = rows.join(paths, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path")), "left")
    return rows.select("row", "evidence", "host_rate", "path_rate", _posterior(F.col("evidence"), F.col("path_rate")).alias("quality"))


def judge(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, quality and keep."""
    found = _judged(docs, labels, F.col("doc_id"), host, path)
    return found.withColumnRenamed("row", "doc_id").withColumn("keep", F.col("quality") >= keep_from)


def accepted(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, host: str = "source", path: str = "lang") -> DataFrame:
    """The documents, as they are, that are not rejected."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _judged(docs, labels, whole, host, path).filter(F.col("quality") >= keep_from).select("row.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
