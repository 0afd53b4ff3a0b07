"""Exact top-k by inner product: branch and bound over vectors in vertical layout.

Components are whole numbers, floor(scale * x). Candidates lie in packed blocks, a dimension's components side by
side. For each query the dimensions go in falling order of its own components, a few at a time: the products are
added up for the candidates still in play, and by Cauchy and Schwarz a candidate can gain no more than the product of
what is left of the query's length and of its own. Candidates that cannot reach the k-th best score so far leave, and
the survivors are compacted. The bound is rounded up, so nothing is lost; scores are exact.

Every row but the query's own is a candidate, rows that repeat a vec_id included. Vectors are compared with those of
their own length. Ties go to the smaller vec_id, a null vec_id last.

Edge cases: vectors that are null or hold a null or a component that is not finite take no part; empty vectors score
0 with each other; rows repeated are candidates each, and queries each; components so large that doubles cannot add
their products exactly are added as Python's whole numbers, and a score beyond 64 bits is told as the nearest that
fits; with fewer than k candidates all are returned; an empty table gives no rows; other columns are not read.

All queries meet all blocks, as the task says: work and the candidates' copies grow with the table times its queries,
a copy for each CHUNK of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartoflux.llm.common import Staging

#: Vectors of a packed block, queries of a chunk, and blocks that a task lays beside a chunk.
BLOCK, CHUNK, SLICE = 2048, 4096, 4
#: Dimensions that are added at a time.
STEP = 8
#: Doubles add whole numbers exactly up to here.
EXACT = 2.0**53

_PACKED = "width int, uids binary, ids array<long>, asks array<boolean>, cells binary"
_BEST = "quid long, query_id long, uid long, vec_id long, score long"
_LONG = np.iinfo(np.int64)


def pack(width: int, uids: np.ndarray, ids: list, asks: list, rows: np.ndarray) -> pa.RecordBatch:
    """One row: vectors in vertical layout, a dimension after the other, in the smallest type that holds them."""
    most = np.abs(rows).max(initial=0)
    kind, letter = next((k, c) for k, c, top in ((np.int16, b"h", 2**15), (np.int32, b"i", 2**31), (np.float64, b"d", np.inf)) if most < top or c == b"d")
    cells = letter + np.ascontiguousarray(rows.T).astype(kind).tobytes()
    columns = [pa.array([width], pa.int32()), pa.array([uids.tobytes()]), pa.array([ids], pa.list_(pa.int64())), pa.array([asks], pa.list_(pa.bool_())), pa.array([cells])]
    return pa.RecordBatch.from_arrays(columns, names=["width", "uids", "ids", "asks", "cells"])


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uids, ids (null as the largest long, beyond which none sorts) with a mask of nulls, and cells by dimension."""
    kind = {b"h": np.int16, b"i": np.int32, b"d": np.float64}[row["cells"][:1]]
    uids = np.frombuffer(row["uids"], np.int64)
    return uids, np.array([_LONG.max if v is None else v for v in row["ids"]], np.int64), np.frombuffer(row["cells"], kind, offset=1).reshape(row["width"], len(uids)).astype(np.float64)


def _blocks(scale: int):
    """Packed blocks of (uid, vec_id, ask, vector) rows, by their vectors' length, as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def told(width: int) -> pa.RecordBatch:
            uids, ids, asks, rows = zip(*held.pop(width), strict=True)
            cells = np.array(rows, np.float64).reshape(len(rows), width)
            with np.errstate(over="ignore"):
                cells = np.floor(np.clip(scale * cells, -np.finfo(float).max, np.finfo(float).max))
            return pack(width, np.array(uids, np.int64), list(ids), list(asks), cells)

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), (v.values.to_numpy() for v in batch.column(3)), strict=True):
                of = held.setdefault(len(row[3]), [])
                of.append(row)
                if len(of) >= BLOCK:
                    yield told(len(row[3]))
        for width in list(held):
            yield told(width)

    return run


def best_of(query: np.ndarray, uid: int, floor: float, k: int, uids: np.ndarray, ids: np.ndarray, cells: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of a block's best k candidates for one query, those below ``floor`` left out.

    ``lengths`` are the candidates' squared lengths.
    """
    order = np.argsort(-np.abs(query), kind="stable")
    at = np.flatnonzero(uids != uid)
    score, gone, left = np.zeros(len(at)), np.zeros(len(at)), float(query @ query)
    rest = lengths[at]
    for first in range(0, len(order), STEP):
        dims = order[first : first + STEP]
        here = cells[dims] if len(at) == len(uids) else cells[dims[:, None], at]
        score = score + query[dims] @ here
        if first + STEP >= len(order):
            break
        gone = gone + np.einsum("ij,ij->j", here, here)
        left -= float(query[dims] @ query[dims])
        if len(at) > k:
            # sums of whole numbers are exact, so one unit more than the bound covers the root's rounding
            most = score + np.sqrt(max(left, 0.0) * np.maximum(rest - gone, 0)) * (1 + 1e-12) + 1
            least = score - (most - score)
            floor = max(floor, float(np.partition(least, len(at) - k)[len(at) - k]))
            stay = most >= floor
            if not stay.all():
                at, score, gone, rest = at[stay], score[stay], gone[stay], rest[stay]
    keep = np.flatnonzero(score >= floor)
    if len(keep) > k:
        cut = np.partition(score[keep], len(keep) - k)[len(keep) - k]
        keep = keep[score[keep] >= cut]
    keep = keep[np.lexsort((uids[at[keep]], ids[at[keep]], -score[keep]))[:k]]
    return at[keep], score[keep].astype(np.int64)


def _whole(query: np.ndarray, uid: int, k: int, uids: np.ndarray, ids: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``best_of``, for components whose products doubles cannot add: all candidates, in whole numbers."""
    q = [int(v) for v in query]
    scores = [sum(a * int(b) for a, b in zip(q, column, strict=True)) for column in cells.T]
    order = sorted((i for i in range(len(uids)) if uids[i] != uid), key=lambda i: (-max(_LONG.min, min(_LONG.max, scores[i])), ids[i], uids[i]))[:k]
    return np.array(order, np.int64), np.array([max(_LONG.min, min(_LONG.max, scores[i])) for i in order], np.int64)


def _searcher(k: int):
    """The best k of a few blocks for each query of a chunk; the k-th best so far bounds what is to come."""

    def search(key: tuple, asked: pa.Table, blocks: pa.Table) -> pa.Table:
        found = []
        if len(asked) and len(blocks):
            width = key[2].as_py()
            quids, qids, queries = asked.column("uid").to_numpy(), asked.column("vec_id").to_numpy(), np.array(asked.column("vector").to_pylist(), np.float64).reshape(len(asked), width)
            best: list[list] = [[] for _ in quids]
            for at in range(len(blocks)):
                uids, ids, cells = unpack({c: blocks.column(c)[at].as_py() for c in ("width", "uids", "ids", "cells")})
                lengths = np.einsum("ij,ij->j", cells, cells)
                most = np.abs(cells).max(initial=0)
                for i, query in enumerate(queries):
                    floor = float(best[i][k - 1][0]) if len(best[i]) >= k else -np.inf
                    top = max(most, np.abs(query).max(initial=0))
                    near = best_of(query, quids[i], floor, k, uids, ids, cells, lengths) if top * top * width < EXACT / 4 else _whole(query, quids[i], k, uids, ids, cells)
                    best[i] = sorted([*best[i], *((s, v, u) for s, v, u in zip(near[1].tolist(), ids[near[0]].tolist(), uids[near[0]].tolist(), strict=True))], key=lambda x: (-x[0], x[1], x[2]))[:k]
            found = [(quid, qid, u, v, s) for quid, qid, of in zip(quids.tolist(), qids.tolist(), best, strict=True) for s, v, u in of]
        columns = list(zip(*found, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["quid", "query_id", "uid", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, asks: Column, k: int, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of (vec_id, embedding): the k best other rows for each row that ``asks``."""
    spark = vectors.sparkSession
    stage = Staging(spark, "topk")
    fit = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above all numbers
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(asks, F.lit(False)).alias("asks")).filter(fit)
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "asks", "embedding")
    packed = stage.table(rows.mapInArrow(_blocks(scale), _PACKED), "packed")

    n, asked_n = packed.agg(F.sum(F.size("ids")), F.sum(F.size(F.filter("asks", lambda x: x)))).first()
    chunks, slices = max(1, -(-(asked_n or 0) // CHUNK)), max(1, -(-(n or 0) // (BLOCK * SLICE)))
    asked = packed.filter(F.exists("asks", lambda x: x)).mapInArrow(_asked, "uid long, vec_id long, width int, vector array<double>")
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int"))
    every = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    beside = packed.select("width", "uids", "ids", "cells", F.pmod(F.xxhash64("uids"), F.lit(slices)).cast("int").alias("slice"), every(chunks).alias("chunk"))
    asked = asked.select("*", every(slices).alias("slice"))
    found = asked.groupBy("chunk", "slice", "width").cogroup(beside.groupBy("chunk", "slice", "width")).applyInArrow(_searcher(k), _BEST)
    # the largest long stands for null, and there it is after all others by its row
    w = W.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") < _LONG.max, F.col("vec_id")).alias("vec_id"), "score")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of packed blocks that are queries."""
    for batch in batches:
        for row in batch.to_pylist():
            uids, ids, cells = unpack(row)
            on = np.flatnonzero(np.array(row["asks"], bool))
            columns = [pa.array(uids[on]), pa.array(ids[on]), pa.array([row["width"]] * len(on), pa.int32()), pa.array(cells[:, on].T.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "vec_id", "width", "vector"])


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 100 == 0, 10)


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.row AS q, q.vec_id AS query_id, c.row AS c, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON c.row <> q.row AND len(c.x) = len(q.x) WHERE q.vec_id % 100 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, c) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, coalesce(score, 0) AS score FROM r WHERE rank <= 10
"""
