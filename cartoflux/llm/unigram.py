"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores,
with byte fallback and whitespace-marker decoding.

The pieces are those of a model file; their log scores are estimated here from the corpus (``estimate``), by
expectation-maximisation over the counts of all its chunks: expected uses of each piece over all ways to cut
a chunk, which begin with equal scores. A file's own scores serve too (``encode_decode`` with them given).

The path of the highest summed score wins; of equal paths the one whose last piece is the longest. A
character that no piece covers becomes its UTF-8 bytes and costs the lowest score less ``UNKNOWN_PENALTY``.
Decoding joins pieces and bytes, turns markers into spaces and drops the dummy space put first; so a text
comes back as it was, except that a marker character in it comes back as a space.

Lattices of many chunks are worked through together, place by place. A chunk of more than ``LONG`` characters
is worked through alone, and its best path stands for its expected uses in the estimation.

Edge cases: a null or empty text has no pieces and decodes to an empty text; rows repeated are encoded (and
counted) each; bytes that form no character decode to U+FFFD; very long texts are encoded whole; columns other
than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoflux.llm.common import Staging, documents
from cartoflux.llm.pieces import MARKER, Vocabulary, WordCache, chunks, load

UNKNOWN_PENALTY = 10.0
#: Rounds of the estimation, and the uses that each piece has beside those expected.
ROUNDS, PRIOR = 2, 0.1
LONG = 256
#: Cells of the lattices that are held at a time.
CELLS = 1 << 19


class DoubleArrayTrie:
    """Pieces by their characters: from state s, character code c leads to base[s] + c if check there is s."""

    def __init__(self, pieces: dict[str, int]):
        self.codes = {c: i + 1 for i, c in enumerate(sorted({c for p in pieces for c in p}))}
        children: list[dict[int, int]] = [{}]  # a plain trie first
        value = [-1]
        for piece, i in pieces.items():
            node = 0
            for c in piece:
                node = children[node].setdefault(self.codes[c], len(children))
                if node == len(children):
                    children.append({})
                    value.append(-1)
            value[node] = i
        size = len(children) + len(self.codes) + 2
        self.base, self.check, self.value = [0] * (2 * size), [-1] * (2 * size), [-1] * (2 * size)
        self.check[0] = 0
        placed, lowest, todo = {0: 0}, 1, [0]
        for node in todo:  # breadth first; each node's children go to the first free places
            state, labels = placed[node], sorted(children[node])
            self.value[state] = value[node]
            if not labels:
                continue
            while self.check[lowest] >= 0:
                lowest += 1
            base = max(0, lowest - labels[0])
            while True:
                if base + labels[-1] >= len(self.check):
                    for array, fill in ((self.base, 0), (self.check, -1), (self.value, -1)):
                        array.extend([fill] * len(array))
                if all(self.check[base + c] < 0 for c in labels):
                    break
                base += 1
            self.base[state] = base
            for c in labels:
                self.check[base + c] = state
                placed[children[node][c]] = base + c
                todo.append(children[node][c])


_TRIE: list = []


class UnigramCodec:
    def __init__(self, vocabulary: Vocabulary, most: int = 250_000):
        self.vocabulary = vocabulary
        if not _TRIE or _TRIE[0] != vocabulary.pieces:  # one for each process
            _TRIE[:] = vocabulary.pieces, DoubleArrayTrie({vocabulary.pieces[i].replace(MARKER, " "): i for i in sorted(vocabulary.normal)})
        self.trie = _TRIE[1]
        self.lowest = min(vocabulary.scores[i] for i in vocabulary.normal) - UNKNOWN_PENALTY
        self.splits = vocabulary.splits
        self.cache = WordCache(self.viterbi, most)
        self.texts = [p.replace(MARKER, " ") for p in vocabulary.pieces]
        self.bytes_of = {i: b for b, i in vocabulary.bytes_.items()}
        self.coded = [bytes((self.bytes_of[i],)) if i in self.bytes_of else t.encode() for i, t in enumerate(self.texts)]
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value))
        self.codes = np.zeros(0x110000, np.int32)
        for c, code in self.trie.codes.items():
            self.codes[ord(c)] = code
        self.scores = np.array(vocabulary.scores)

    def _lattices(self, listed: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of the list, [row, place] codes padded by -1) of chunks of like lengths, the longest first."""
        lengths = np.array([len(c) for c in listed])
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            longest = int(lengths[order[at]])
            rows = order[at : at + max(1, CELLS // max(1, longest))]
            codes = np.full((len(rows), longest), -1, np.int32)
            codes[np.arange(longest) < lengths[rows, None]] = self.codes[np.frombuffer("".join([listed[i] for i in rows.tolist()]).encode("utf-32-le"), "<u4")]
            yield rows, codes
            at += len(rows)

    def _edges(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
        """(rows, start, end, pieces or -1 for a character without one), by rising start, then end."""
        lengths = (codes >= 0).sum(axis=1)
        for start in range(codes.shape[1]):
            rows = np.flatnonzero(lengths > start)
            state, whole = np.zeros(len(rows), np.int32), rows
            single = np.zeros(len(codes), bool)
            for end in range(start, codes.shape[1]):
                c = codes[rows, end]
                place = np.minimum(self.base[state] + c, len(self.check) - 1)
                on = (c > 0) & (self.check[place] == state)
                rows, state = rows[on], place[on]
                if not len(rows):
                    break
                piece = self.value[state]
                hit = piece >= 0
                if hit.any():
                    if end == start:
                        single[rows[hit]] = True
                    yield rows[hit], start, end + 1, piece[hit]
            bare = whole[~single[whole]]
            if len(bare):
                yield bare, start, start + 1, np.full(len(bare), -1, np.int32)

    def _cost(self, pieces: np.ndarray) -> np.ndarray:
        return np.where(pieces < 0, self.lowest, self.scores[pieces])

    @staticmethod
    def _back(back: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, first): each row's best path in its last places, from place ``first`` on; all rows go a step at a time."""
        ids, place, first = np.zeros((len(back), back.shape[1] - 1), "<i4"), lengths.copy(), np.full(len(back), back.shape[1] - 1)
        at = np.flatnonzero(place)
        while len(at):
            step = back[at, place[at]]
            first[at] -= 1
            ids[at, first[at]] = step[:, 1]
            place[at] = step[:, 0]
            at = at[step[:, 0] > 0]
        return ids, first

    def paths(self, listed: list[str]) -> list[bytes]:
        """``viterbi`` of each of the chunks."""
        out: list[bytes] = [b""] * len(listed)
        short = [i for i, c in enumerate(listed) if len(c) <= LONG]
        for i, c in enumerate(listed):
            if len(c) > LONG:
                out[i] = self.viterbi(c)
        bytes_, unknown = self.vocabulary.bytes_, self.vocabulary.unknown
        for rows, codes in self._lattices([listed[i] for i in short]):
            best = np.full((len(rows), codes.shape[1] + 1), -np.inf)
            best[:, 0] = 0.0
            back = np.zeros((*best.shape, 2), np.int32)
            for at, start, end, pieces in self._edges(codes):
                total = best[at, start] + self._cost(pieces)
                better = total > best[at, end]
                at = at[better]
                best[at, end] = total[better]
                back[at, end, 0], back[at, end, 1] = start, pieces[better]
            ids, first = self._back(back, (codes >= 0).sum(axis=1))
            taken = np.arange(ids.shape[1]) >= first[:, None]
            bare = (taken & (ids < 0)).any(axis=1)
            whole, ends = ids[taken].tobytes(), 4 * np.cumsum(ids.shape[1] - first)
            for row, low, high in zip(rows.tolist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                out[short[row]] = whole[low:high]
            for i in np.flatnonzero(bare).tolist():
                chunk, listed_ids, steps = listed[short[rows[i]]], [], back[i].tolist()
                place = len(chunk)
                while place:
                    start, piece = steps[place]
                    if piece >= 0:
                        listed_ids.append(piece)
                    else:
                        listed_ids.extend(bytes_.get(b, unknown) for b in reversed(chunk[start:place].encode()))
                    place = start
                out[short[rows[i]]] = np.array(listed_ids[::-1], "<i4").tobytes()
        return out

    def expected(self, listed: list[str], n: np.ndarray) -> np.ndarray:
        """Uses of each piece in chunks that stand n times each, over all ways to cut them, by their chance."""
        uses = np.zeros(len(self.scores))
        short = np.array([i for i, c in enumerate(listed) if len(c) <= LONG], np.int64)
        for i, c in enumerate(listed):
            if len(c) > LONG:
                np.add.at(uses, np.frombuffer(self.viterbi(c), "<i4"), n[i])
        for rows, codes in self._lattices([listed[i] for i in short.tolist()]):
            ahead = np.full((len(rows), codes.shape[1] + 1), -np.inf)
            ahead[:, 0] = 0.0
            edges = list(self._edges(codes))
            for at, start, end, pieces in edges:
                ahead[at, end] = np.logaddexp(ahead[at, end], ahead[at, start] + self._cost(pieces))
            lengths = (codes >= 0).sum(axis=1)
            behind = np.full(ahead.shape, -np.inf)
            every = np.arange(len(rows))
            behind[every, lengths] = 0.0
            whole = ahead[every, lengths]
            for at, start, end, pieces in reversed(edges):
                total = self._cost(pieces) + behind[at, end]
                behind[at, start] = np.logaddexp(behind[at, start], total)
                piece = pieces >= 0
                chance = np.exp((ahead[at, start] + total - whole[at])[piece])
                uses += np.bincount(pieces[piece], chance * n[short[rows[at[piece]]]], len(uses))
        return uses

    def viterbi(self, chunk: str) -> bytes:
        """The ids of the best path, as little-endian 32-bit numbers."""
        base, check, value, codes = self.trie.base, self.trie.check, self.trie.value, self.trie.codes
        scores, n = self.vocabulary.scores, len(chunk)
        best = [None] * (n + 1)
        back = [None] * (n + 1)
        best[0] = 0.0
        coded = [codes.get(c, 0) for c in chunk]
        for start in range(n):
            here, state, single = best[start], 0, False
            for end in range(start, n):
                c = coded[end]
                if not c:
                    break
                place = base[state] + c
                if place >= len(check) or check[place] != state:
                    break
                state = place
                i = value[state]
                if i >= 0:
                    single = single or end == start
                    total = here + scores[i]
                    if best[end + 1] is None or total > best[end + 1]:
                        best[end + 1], back[end + 1] = total, (start, i)
            if not single:
                total = here + self.lowest
                if best[start + 1] is None or total > best[start + 1]:
                    best[start + 1], back[start + 1] = total, (start, -1)
        ids, place = [], n
        while place:
            start, i = back[place]
            ids.extend([i] if i >= 0 else [self.vocabulary.bytes_.get(b, self.vocabulary.unknown) for b in reversed(chunk[start:place].encode())])
            place = start
        return np.array(ids[::-1], "<i4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; what its chunks' paths are is kept for the next ones."""
        self.cache.turn()
        parts = [chunks(t or "", self.splits) for t in texts]
        older = self.cache.older
        new = [c for c in dict.fromkeys(c for p in parts for c in p) if c not in self.cache]
        fresh = [c for c in new if c not in older]
        found = dict(zip(fresh, self.paths(fresh), strict=True))
        for c in new:
            if len(c) <= self.cache.longest:
                self.cache[c] = found.pop(c) if c in found else older[c]
        known = self.cache if not found else {**found, **{c: self.cache[c] for p in parts for c in p if c in self.cache}}
        return [np.frombuffer(b"".join(map(known.__getitem__, p)), "<i4") for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        bytes_of = self.bytes_of
        listed = ids.tolist()
        if bytes_of.keys().isdisjoint(listed):
            text = "".join(map(self.texts.__getitem__, listed))
        else:
            text = b"".join(map(self.coded.__getitem__, listed)).decode("utf-8", "replace")
        return text[1:]


def _count_chunks(splits: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["chunk", "n"])
            counts.clear()
            return batch

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(chunks(text.as_py() or "", splits))
                if len(counts) > 400_000:
                    yield rows()
        yield rows()

    return count


def _uses(shared):
    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, total = UnigramCodec(shared.value), 0.0
        for batch in batches:
            total = total + codec.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy())
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.broadcast_to(total, len(codec.scores))[found])], names=["piece", "uses"])

    return uses


def estimate(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Vocabulary:
    """The vocabulary with log scores from all texts."""
    spark = docs.sparkSession
    stage = Staging(spark, "unigram")
    counted = docs.select("text").mapInArrow(_count_chunks(vocabulary.splits), "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    counted = stage.table(counted, "chunks")
    normal = np.array(sorted(vocabulary.normal))
    scores = np.zeros(len(vocabulary.pieces))
    scores[normal] = -np.log(max(1, len(normal)))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(dataclasses.replace(vocabulary, scores=scores.tolist()))
        found = counted.mapInArrow(_uses(shared), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        uses = np.zeros(len(scores))
        for r in found.collect():  # as many as there are pieces
            uses[r["piece"]] = r["uses"]
        uses[normal] = np.round(uses[normal], 3) + PRIOR  # sums in any order are the same scores
        scores[normal] = np.round(np.log(uses[normal] / uses[normal].sum()), 6)
    stage.drop("chunks")
    return dataclasses.replace(vocabulary, scores=scores.tolist())


_CODEC: list = []


def encode_decode(docs: DataFrame, model: str, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_tokens, n_fallback (byte pieces), ids, decoded: every text there and back. The scores are those
    of ``vocabulary`` or else estimated from the texts."""
    vocabulary = vocabulary or estimate(docs, load(model))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _CODEC or _CODEC[0] != shared.value.scores:
            _CODEC[:] = shared.value.scores, UnigramCodec(shared.value)
        codec = _CODEC[1]
        byte_ids = np.array(sorted(codec.bytes_of))
        for batch in batches:
            for at in range(0, len(batch), 1000):  # bounds what is held of long texts
                part = batch.slice(at, 1000)
                ids = codec.encode_all(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(offsets).astype("i8")),
                        pa.array([int(np.isin(x, byte_ids).sum()) for x in ids], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, "i4")]).astype("i4"))),
                        pa.array([codec.decode(x) for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "n_fallback", "ids", "decoded"],
                )

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(rows, "doc_id long, n_tokens long, n_fallback long, ids array<int>, decoded string")


def op2_unigram_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and the digest of what they decode to."""
    import public_tokenizers

    coded = encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", "n_fallback", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
