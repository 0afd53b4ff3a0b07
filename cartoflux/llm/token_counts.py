"""Token counts by byte-pair merging with a heap and a linked list: the lowest-ranked adjacent pair is
popped again and again, and the count is the initial symbols less the merges; no identifiers are made.

Characters without a piece count as their UTF-8 bytes. Edge cases: a null or empty text has no tokens;
rows repeated are counted each; a long run without spaces is one chunk, merged in n log n; very
long texts are counted whole; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoflux.llm.common import documents
from cartoflux.llm.pieces import MARKER, Vocabulary, WordCache, chunks, load

LIMIT = 4096


class MergeCounter:
    def __init__(self, vocabulary: Vocabulary, most: int = 250_000):
        """Pieces are ranked by falling score; equal scores share a rank, and the leftmost pair goes first."""
        order = {score: rank for rank, score in enumerate(sorted({vocabulary.scores[i] for i in vocabulary.normal}, reverse=True))}
        self.ranks = {vocabulary.pieces[i].replace(MARKER, " "): order[vocabulary.scores[i]] for i in vocabulary.normal}
        self.splits = vocabulary.splits
        self.cache = WordCache(self.merge, most)

    def merge(self, chunk: str) -> int:
        symbols, ranks = list(chunk), self.ranks
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in ranks:
                heap.append((ranks[pair], i, pair))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, pair = heapq.heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or left + symbols[j] != pair:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = pair, None
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (joined := pair + symbols[k]) in ranks:
                    heapq.heappush(heap, (ranks[joined], i, joined))
            if (h := before[i]) >= 0 and (joined := symbols[h] + pair) in ranks:
                heapq.heappush(heap, (ranks[joined], h, joined))
        # byte fallback: what no merge has reached and no piece covers counts once for each byte
        return count + sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in ranks)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        self.cache.turn()
        return sum(map(self.cache.__getitem__, chunks(text, self.splits)))


#: One counter for each worker process and model: words met in one task are known in the next.
_COUNTERS: dict[str, MergeCounter] = {}


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for the model file at ``model``."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(model) or _COUNTERS.setdefault(model, MergeCounter(shared.value))
        for batch in batches:
            tokens = [counter.count(t.as_py()) for t in batch.column(2)]
            over = [n > limit for n in tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(over, pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    sized = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
