"""Periodic runs of words, found by bit-parallel lags.

Each distinct word of a text has a number; bit b of the numbers of all words is one plane, a big integer with a bit
for each word. A plane XOR itself shifted by a lag q shows the words whose bit differs from that of the word q
further on; the OR over the planes shows every mismatch, its complement the matches. ANDing that with itself at
doubling shifts leaves the places where enough matches stand in a row: a run of period q. Lags are tried from 1 to a
quarter of the words, so the first period at which a stretch is met is its smallest.

A run is a stretch of consecutive words with smallest period q and at least max(least, repeats * q) words that
neither neighbouring word extends. A word is dropped from the text if any run holds it after the run's first q words.

Edge cases: a null or empty text, or one without words, has no runs and collapses to an empty text; a null doc_id
stays null; equal rows give equal rows; very long texts are worked through whole, in time that grows with the square
of their words over 64, as every lag is tried; an empty table gives no rows; other columns stay out of the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoflux.llm.common import WORD, documents

LEAST, REPEATS = 6, 4
#: Texts, and characters of texts, that make one batch of results.
ROWS, CHARACTERS = 512, 4 << 20
#: So many stretches are read from a big integer one by one; more are unpacked together.
FEW = 8

_WORD = re.compile(WORD)


def planes(ids: np.ndarray) -> list[int]:
    """Bit b of all ids as one big integer whose lowest bit is the first word's."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(bits)]


def stretches(bits: int, length: int) -> int:
    """Where ``length`` set bits in a row begin: ANDs at doubling shifts, as long as any are left."""
    have = 1
    while have < length and bits:
        step = min(have, length - have)
        bits &= bits >> step
        have += step
    return bits


def places(bits: int) -> list[int]:
    """The places of the set bits, in order."""
    if bits.bit_count() > FEW:
        raw = np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 8), "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()
    out = []
    while bits:
        out.append((low := bits & -bits).bit_length() - 1)
        bits ^= low
    return out


def runs_of(words: list[str], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n, number = len(words), {}
    if n < least:
        return []
    bit_planes = planes(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n))
    found, met = [], set()
    for q in range(1, n // repeats + 1):
        need = max(least, repeats * q) - q  # matches in a row
        match = every = (1 << (n - q)) - 1
        begins = match
        for plane in bit_planes:
            match &= ~(plane ^ plane >> q)
            if not (begins := stretches(match & every, need)):
                break  # the planes to come can only take matches away
        if not begins:
            continue
        firsts, lasts = places(begins & ~(begins << 1)), places(begins & ~(begins >> 1))
        for first, last in zip(firsts, lasts, strict=True):
            end = last + need + q
            if (first, end) not in met:  # else its smallest period has been met
                met.add((first, end))
                found.append((first, end - first, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that only go on with a run, joined by a space."""
    if not runs:
        return " ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    return " ".join([words[i] for i in kept.tolist()])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, runs, collapsed): every run's start, length and period, in order of start and period, and the text
    without what only repeats. Each text is worked through by itself, where it lies."""

    def made(ids: list, runs: list, texts: list[str]) -> pa.RecordBatch:
        flat = [r for rs in runs for r in rs]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(rs) for rs in runs])]).astype(np.int32))
        parts = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
        column = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(_RUN)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), column, pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs, texts, size = [], [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = _WORD.findall(text.as_py() or "")
                runs.append(runs_of(words, least, repeats))
                texts.append(collapsed(words, runs[-1]))
                ids.append(doc_id.as_py())
                size += len(texts[-1])
                if len(ids) >= ROWS or size >= CHARACTERS:
                    yield made(ids, runs, texts)
                    ids, runs, texts, size = [], [], [], 0
            if ids:
                yield made(ids, runs, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32(doc_id), g = h div 10, each word i >= a of a text with h % 10 = 0 becomes the
    text's word a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8). Other texts stay."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words").cast("long"))
    g = F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when(F.col("n") > 0, g % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    part = lambda array, at, n: F.slice(array, (at + 1).cast("int"), n.cast("int"))
    a, p, rest = F.col("a"), F.col("p"), F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(part(F.col("words"), a, p), F.ceil(rest / p).cast("int")))
    text = F.array_join(F.concat(part(F.col("words"), F.lit(0), a), part(again, F.lit(0), rest)), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def _line(run: Column) -> Column:
    return F.concat_ws(",", run["start"].cast("string"), run["length"].cast("string"), run["period"].cast("string"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(looped(documents(spark, sf_dir)))
    # the greatest length, then the smallest start and period: the least of the negated length and these
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"))))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(_line(r), F.lit("\n"))), "")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    length, period = -F.col("longest.least"), F.col("longest.period")
    return told.select(
        "doc_id", "n_runs", F.col("longest.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
