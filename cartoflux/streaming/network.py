"""A one-mode network kept over a stream of documents' terms.

The state of a document are its terms so far: a term that comes makes a pair with each of them, once, in whatever files
and order they come. New pairs are appended to a table, so a restart from the same checkpoint neither loses nor repeats
any, and the network is their count. Rows older than the watermark are late and dropped, as is the state of documents
that it has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_PAIRS = "doc_id string, ts timestamp, source string, target string"


def _pairs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The pairs that a document's new terms make with each other and with those it has."""
    if state.hasTimedOut:
        state.remove()
        return
    terms, until = state.get if state.exists else ([], 0)
    known, last = set(terms), until
    for batch in batches:
        out = []
        for at, ts, term in sorted(zip(batch["at"], batch["ts"], batch["term"], strict=True)):
            last = max(last, at)
            if term not in known:
                out += [(key[0], ts, *sorted((term, other))) for other in known]
                known.add(term)
        yield pd.DataFrame(out, columns=["doc_id", "ts", "source", "target"])
    state.update((sorted(known), last))
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)  # gone when the watermark has passed its last term


def new_pairs(terms: DataFrame, late: str = "1 day") -> DataFrame:
    """(doc_id, ts, source, target) of a stream (ts, doc_id, term): each pair of a document's terms once, source before
    target. Rows without a document or term are left out."""
    sound = terms.filter("doc_id IS NOT NULL AND term IS NOT NULL").select("ts", F.col("doc_id").cast("string").alias("doc_id"), "term", F.unix_millis("ts").alias("at")).withWatermark("ts", late)
    return sound.groupBy("doc_id").applyInPandasWithState(_pairs, _PAIRS, "terms array<string>, until long", "append", GroupStateTimeout.EventTimeTimeout)


def keep(pairs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has come to the table at ``path`` and ends; started again, goes on from the checkpoint."""
    return pairs.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def network(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, weight) of the pairs so far."""
    return spark.read.schema(_PAIRS).parquet(path).groupBy("source", "target").agg(F.count("*").alias("weight"))
