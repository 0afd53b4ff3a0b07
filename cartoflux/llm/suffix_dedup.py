"""Suffix-array dedup: every byte covered by a string of ``length`` bytes that also starts elsewhere goes.

A sparse suffix array serves. In each window of ``window`` bytes the 32-byte gram of the smallest hash is an
anchor (the leftmost of equals), so equal strings of ``length`` bytes have an anchor at one offset, at most
``reach`` bytes in, and are told from it: an anchor stands for the strings that start from ``low`` to ``high``.

1. Leads. All anchors' suffixes, by their first ``lead`` bytes, go through sampled splitters to buckets that
   sort by multikey quicksort. Anchors of one lead whose surroundings (all bytes of their strings, by a
   128-bit hash) are equal too repeat as a whole. Of a lead with several surroundings, one anchor for each
   goes on; so do all of a lead that equals a splitter's, since its suffixes may stand in several buckets.
2. Suffixes. Those anchors come with all bytes of their strings, and go through sampled splitters again, by
   the bytes after the anchor, then by those before it from right to left; so what follows splits a lead or
   passage that a third of the documents share. Each bucket sorts by multikey quicksort, and common
   lengths of neighbours, to the right and to the left, tell which strings are there twice.
3. Boundaries. What equals a string in another bucket also has its bytes after the anchor in common with the
   splitter between them. Each bucket passes such strings on, once each, by 128-bit hashes in blocks; those
   that come from two buckets repeat.

Samples are a few keys for each bucket, and buckets are as many as the rows ask for, so neither a bucket nor
a splitter table depends on how often a passage repeats. Texts are told apart by 128-bit hashes.

Edge cases: a null text is empty; texts shorter than ``length`` are left as they are; copies repeat each
other whole; strings are judged as bytes, so a cut may split a character (``deduplicated`` drops the pieces);
very long texts are scanned piece by piece; columns other than doc_id and text are ignored by ``suffix_dedup``
and kept by ``deduplicated``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartoflux.llm.common import TEXTS, Staging, documents, few

#: Bytes of text hashed at a time, and anchors sorted at a time.
PIECE, BLOCK = 1 << 18, 150_000
#: Leads and suffixes that a bucket holds on average, and keys that are sampled for each bucket.
BUCKET_LEADS, BUCKET_SUFFIXES, SAMPLED = 1 << 17, 1 << 14, 16
#: Sampled suffixes are sent by so many bytes, and whole only where these are frequent.
SHORT = 64
_PLACE = np.uint64((1 << 28) - 1)


@dataclass(frozen=True)
class Shape:
    length: int = 400
    window: int = 256
    gram: int = 32

    @property
    def reach(self) -> int:
        return self.window - self.gram

    @property
    def core(self) -> int:
        """Bytes from an anchor on that are within all its strings."""
        return self.length - self.reach

    @property
    def lead(self) -> int:
        return min(self.core, 96) // 8 * 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class AnchorFinder:
    def __init__(self, shape: Shape):
        self.shape = shape
        n = PIECE * 2 + shape.length
        factor = 0x9E3779B97F4A7C15
        ones = np.ones(n + 1, np.uint64)
        self.powers, self.inverse = ones.copy(), ones.copy()
        self.powers[1:] = np.cumprod(np.full(n, factor, np.uint64), dtype=np.uint64)
        self.inverse[1:] = np.cumprod(np.full(n, pow(factor, -1, 1 << 64), np.uint64), dtype=np.uint64)

    def find(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Anchors of all strings of ``length`` bytes within the pieces [start, end) of a buffer; and where the
        first and the last string start that each stands for."""
        s, n = self.shape, len(buffer)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        grams = (sums[s.gram :] - sums[: -s.gram]) * self.inverse[: n - s.gram + 1]
        value = (_mix(grams) & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        # the minimum of each w values: of the rest of one row of w, and of the start of the next
        w = s.reach + 1
        rows = np.full(-(-len(value) // w) * w, ~np.uint64(0))
        rows[: len(value)] = value
        rows = rows.reshape(-1, w)
        first = np.minimum.accumulate(rows, axis=1).ravel()
        rest = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(rest[: len(value) - w + 1], first[w - 1 : len(value)])
        inside = np.zeros(n + 2, np.int64)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends - s.length + 1, -1)
        strings = np.flatnonzero(np.cumsum(inside)[: len(least)])
        places = (least[strings] & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.diff(places, prepend=-1))
        return places[new], strings[new], strings[np.append(new[1:], len(strings)) - 1] if len(new) else strings


_BLOCKS = "bucket long, kind int, x binary, y binary, z binary, w binary"
_MARKS = "kind int, tid binary, at long, low long, high long"
#: Kinds of rows: stretches of a text that repeat, anchors that go on, and leads on their way to a bucket.
REPEATED, MIXED, LEADS = 1, 2, 3


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes, all of one width, as an Arrow column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype="<i4") * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows))])


def _places(keys: np.ndarray, splitters: list[bytes]) -> np.ndarray:
    """How many splitters are not above each of the rows of bytes; the first 8 bytes settle most."""
    first = keys[:, :8].copy().view(">u8").ravel().astype(np.uint64)
    known = np.array([int.from_bytes(s[:8].ljust(8, b"\0")) for s in splitters], np.uint64)
    out, upto = np.searchsorted(known, first, "right"), np.searchsorted(known, first, "left")
    for i in np.flatnonzero(out != upto).tolist():
        out[i] = bisect_right(splitters, keys[i].tobytes())
    return out


class _Anchors:
    """The anchors of texts that are added one after the other."""

    def __init__(self, shape: Shape):
        self.shape, self.finder = shape, AnchorFinder(shape)
        self.clear()

    def clear(self):
        self.tids: list[bytes] = []
        self.texts: list[bytes] = []
        self.pieces: list[tuple[int, int, bytes]] = []  # text, place in it, bytes: of the buffer
        self.parts: list[tuple[np.ndarray, ...]] = []  # text, place, low, high, lead
        self.held = self.size = self.found = 0

    def add(self, tid: bytes, text: bytes):
        length = self.shape.length
        self.tids.append(tid)
        self.texts.append(text)
        self.size += len(text)
        for offset in range(0, len(text) - length + 1, PIECE):
            self.pieces.append((len(self.texts) - 1, offset, text[offset : offset + PIECE + length - 1]))
            self.held += len(self.pieces[-1][2])
            if self.held >= PIECE // 4:
                self._search()

    def _search(self):
        if not self.pieces:
            return
        buffer = np.frombuffer(b"".join(p[2] for p in self.pieces), np.uint8)
        ends = np.cumsum([len(p[2]) for p in self.pieces])
        starts = ends - np.array([len(p[2]) for p in self.pieces])
        places, low, high = self.finder.find(buffer, starts, ends)
        which = np.searchsorted(ends, places, side="right")
        shift = np.array([p[1] for p in self.pieces], np.int64)[which] - starts[which]
        rows = np.array([p[0] for p in self.pieces], np.int64)[which]
        lead = buffer[places[:, None] + np.arange(self.shape.lead)]
        self.parts.append((rows, places + shift, low + shift, high + shift, lead))
        self.found += len(places)
        self.pieces.clear()
        self.held = 0

    def take(self) -> tuple[np.ndarray, ...] | None:
        """(text, place, low, high, lead, surroundings) of all anchors; an anchor in two pieces is one."""
        self._search()
        if not self.found:
            return None
        row, at, low, high, lead = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        new = np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1]))
        high = high[np.append(np.flatnonzero(new)[1:], len(row)) - 1]
        row, at, low, lead = row[new], at[new], low[new], lead[new]
        digest, length, texts = xxhash.xxh3_128_digest, self.shape.length, self.texts
        around = b"".join(
            [digest(texts[r][a : b + length], (p - a) << 20 | (p - b)) for r, p, a, b in zip(row.tolist(), at.tolist(), low.tolist(), high.tolist(), strict=True)]
        )
        return row, at, low, high, lead, np.frombuffer(around, np.uint8).reshape(-1, 16)


def _equal_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows of two words, and where in it a row differs from the one before."""
    order = np.lexsort((words[:, 1], words[:, 0]))
    return order, np.append(True, (words[order[1:]] != words[order[:-1]]).any(axis=1))


def _sampler(shape: Shape, thin: int):
    """Every ``thin``-th anchor's key, of the texts given."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _Anchors(shape)

        def keys():
            found = anchors.take()
            anchors.clear()
            rows = np.concatenate(found[4:], axis=1)[::thin] if found else np.empty((0, shape.lead + 16), np.uint8)
            return pa.RecordBatch.from_arrays([_binary(rows)], names=["key"])

        for batch in batches:
            for text in batch.column(1):
                text = text.as_py() or b""
                if len(text) >= shape.length:
                    anchors.add(b"", text)
                if anchors.size >= 1 << 24:
                    yield keys()
        yield keys()

    return sample


def _scanner(shape: Shape, shared):
    """Blocks of repeated stretches (text, from, to), and of leads by their bucket, each of a task's
    surroundings once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = shared.value
        anchors = _Anchors(shape)

        def flush() -> list[tuple]:
            found = anchors.take()
            rows: list[tuple] = []
            if found:
                row, at, low, high, lead, around = found
                tid = np.frombuffer(b"".join(anchors.tids), np.uint8).reshape(-1, 16)
                order, new = _equal_runs(around.view("<u8"))
                kind = np.cumsum(new) - 1
                twice = np.zeros(len(row), bool)
                twice[order] = np.bincount(kind)[kind] > 1
                if twice.any():
                    text, a, b = row[twice], low[twice], high[twice] + shape.length
                    # a text's stretches that overlap are one; both ends rise with the anchor
                    begins = np.append(True, (text[1:] != text[:-1]) | (a[1:] > b[:-1]))
                    ends = np.append(begins[1:], True)
                    rows.append((int(at[0]) % (len(splitters) + 1), REPEATED, tid[text[begins]].tobytes(), a[begins].tobytes(), b[ends].tobytes(), b""))
                sent = order[new]
                keys = np.concatenate([lead[sent], around[sent]], axis=1)
                bucket = _places(keys, splitters)
                by = np.argsort(bucket, kind="stable")
                sent, keys, bucket = sent[by], keys[by], bucket[by]
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                where = np.stack([at, low, high], axis=1).astype("<i8")
                for a, b in zip(cuts, cuts[1:], strict=False):
                    rows.append((int(bucket[a]), LEADS, keys[a:b].tobytes(), tid[row[sent[a:b]]].tobytes(), where[sent[a:b]].tobytes(), b""))
            anchors.clear()
            return rows

        def batch_of(rows):
            types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            names = ["bucket", "kind", "x", "y", "z", "w"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or b""
                if len(text) >= shape.length:
                    anchors.add(t, text)
                if anchors.found >= BLOCK or anchors.size >= 1 << 24:
                    if rows := flush():
                        yield batch_of(rows)
        if rows := flush():
            yield batch_of(rows)

    return scan


def _lead_sorter(shape: Shape, shared):
    """A bucket's blocks: what repeats as a whole, and the anchors that go on."""

    def gather(table: pa.Table) -> pa.Table:
        between = {s[: shape.lead] for s in shared.value}
        out: list[tuple] = []
        keys, tids, where = [], [], []
        for kind, x, y, z in zip(*(table.column(c).to_pylist() for c in ("kind", "x", "y", "z")), strict=True):
            if kind == LEADS:
                keys.append(np.frombuffer(x, np.uint8).reshape(-1, shape.lead + 16))
                tids.append(np.frombuffer(y, np.uint8).reshape(-1, 16))
                where.append(np.frombuffer(z, "<i8").reshape(-1, 3))
            else:
                a, b = np.frombuffer(y, "<i8"), np.frombuffer(z, "<i8")
                out.append((np.full(len(a), REPEATED, "i4"), np.frombuffer(x, np.uint8).reshape(-1, 16), a, a, b - shape.length))
        if keys:
            key, tid, at = np.concatenate(keys), np.concatenate(tids), np.concatenate(where)
            order = multikey_quicksort(key.view(">u8").astype(np.uint64))
            key, tid, at = key[order], tid[order], at[order]
            new_kind = np.append(True, (key[1:] != key[:-1]).any(axis=1))
            new_lead = np.append(True, (key[1:, : shape.lead] != key[:-1, : shape.lead]).any(axis=1))
            kind_of, lead_of = np.cumsum(new_kind) - 1, np.cumsum(new_lead) - 1
            twice = np.bincount(kind_of)[kind_of] > 1
            edge = np.array([k.tobytes() in between for k in key[new_lead, : shape.lead]])
            on = new_kind & ((np.bincount(lead_of, new_kind) > 1) | edge)[lead_of]
            for kind, chosen in ((REPEATED, twice), (MIXED, on)):
                out.append((np.full(chosen.sum(), kind, "i4"), tid[chosen], *at[chosen].T))
        kind, tid, *rest = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table([pa.array(kind), _binary(tid), *[pa.array(c) for c in rest]], names=["kind", "tid", "at", "low", "high"])

    return gather


def _cutter(shape: Shape):
    """The suffixes (with what stands before them in their strings) at the places listed for each text, once
    for each task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            rows = []
            for t, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if t in done:
                    continue
                done.add(t)
                text = text.as_py()
                for p in places:
                    at, low, high = p["at"], p["low"], p["high"]
                    rows.append((t, at, low, high, text[at : high + shape.length], text[low:at]))
            if rows:
                types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                names = ["tid", "place", "low", "high", "suffix", "before"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return cut


def _key(suffix: bytes, before: bytes, shape: Shape) -> bytes:
    return suffix.ljust(shape.length, b"\0") + before[::-1]


def _keys(shape: Shape, short: bool):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_key(s, b, shape) for s, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([k[:SHORT] if short else k for k in found], pa.binary())], names=["key"])

    return keys


def _dealt(shape: Shape, shared):
    """Adds the bucket of each suffix."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = shared.value
        for batch in batches:
            pairs = zip(batch.column("suffix").to_pylist(), batch.column("before").to_pylist(), strict=True)
            buckets = [bisect_right(splitters, _key(s, b, shape)) for s, b in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), *batch.columns], names=["bucket", *batch.schema.names])

    return deal


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of rows of 64-bit words: three-way partition by one word, equals go on to the next."""
    out = np.empty(len(words), np.int64)
    stack = [(np.arange(len(words)), 0, 0)]
    while stack:
        rows, depth, at = stack.pop()
        if len(rows) <= 1 or depth == words.shape[1]:
            out[at : at + len(rows)] = rows
            continue
        if len(rows) <= 48:
            out[at : at + len(rows)] = rows[np.lexsort(words[rows, depth:].T[::-1])]
            continue
        key = words[rows, depth]
        pivot = np.partition(key[:: max(1, len(key) // 64)], len(key[:: max(1, len(key) // 64)]) // 2)[len(key[:: max(1, len(key) // 64)]) // 2]
        less, same = key < pivot, key == pivot
        for part, deeper in ((less, 0), (same, 1), (~(less | same), 0)):
            chosen = rows[part]
            stack.append((chosen, depth + deeper, at))
            at += len(chosen)
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that rows have in common from the left."""
    same = a == b
    return np.where(same.all(axis=1), a.shape[1], np.argmin(same, axis=1))


def _padded(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width)


def repeated_offsets(suffixes: list[bytes], before: list[bytes], least: np.ndarray, shape: Shape) -> np.ndarray:
    """[offset, suffix]: whether the string that starts so many bytes before the suffix is found twice; a suffix
    has strings from ``least`` offsets on, as far as the bytes before it reach.

    Equal strings share ``offset`` bytes to the left and the rest to the right of their suffixes; suffixes
    with so many in common are neighbours in the order to the right, and in that to the left. Short ones are
    padded, and only rows that have the bytes themselves count.
    """
    m = len(suffixes)
    right_n, left_n = np.array([len(s) for s in suffixes]), np.array([len(s) for s in before])
    width = -(-shape.length // 8) * 8
    right = _padded(suffixes, width)
    order = multikey_quicksort(right.view(">u8").astype(np.uint64))
    right, right_n, least = right[order], right_n[order], least[order]
    common = _common(right[1:], right[:-1])
    group = np.concatenate([[0], np.cumsum(common < shape.core)])
    alone = np.bincount(group)[group] < 2
    left_n = left_n[order]
    width = -(-max(1, shape.reach) // 8) * 8
    left = _padded([before[i][::-1] for i in order.tolist()], width)
    by_left = multikey_quicksort(np.concatenate([group[:, None].astype(np.uint64), left.view(">u8").astype(np.uint64)], axis=1))
    sorted_left, sorted_group = left[by_left], group[by_left]
    common_left = _common(sorted_left[1:], sorted_left[:-1])
    common_left[sorted_group[1:] != sorted_group[:-1]] = -1
    found = np.zeros((shape.reach + 1, m), bool)
    left_block = np.empty(m, np.int64)
    for offset in range(shape.reach + 1):
        can = np.flatnonzero((least <= offset) & (right_n >= shape.length - offset) & (left_n >= offset) & ~alone)
        if not len(can):
            continue
        right_block = np.concatenate([[0], np.cumsum(common < shape.length - offset)])
        left_block[by_left] = np.concatenate([[0], np.cumsum(common_left < offset)])
        _, which, count = np.unique(right_block[can] * m + left_block[can], return_inverse=True, return_counts=True)
        found[offset, order[can[count[which] > 1]]] = True
    return found


def _shared_bytes(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    same = np.frombuffer(a, np.uint8, n) == np.frombuffer(b, np.uint8, n)
    return int(same.argmin())


def _suffix_sorter(shape: Shape, shared):
    """Of a bucket, the strings found twice as spans of their texts; and the hashes of those that may also
    stand in another bucket, with their place unless they are found twice here."""

    def sort(table: pa.Table) -> pa.Table:
        splitters = shared.value
        bucket = table.column("bucket")[0].as_py()
        tids = table.column("tid").to_pylist()
        suffixes, before = table.column("suffix").to_pylist(), table.column("before").to_pylist()
        place, high = table.column("place").to_numpy(), table.column("high").to_numpy()
        found = repeated_offsets(suffixes, before, place - high, shape)
        edges = np.diff(found.astype(np.int8), axis=0, prepend=0, append=0)
        which, low_at = np.nonzero(edges.T == 1)
        _, high_at = np.nonzero(edges.T == -1)
        a, b = place[which] - (high_at - 1), place[which] - low_at + shape.length
        rows = [(tids[i], x, y, None) for i, x, y in zip(which.tolist(), a.tolist(), b.tolist(), strict=True)]
        between = [s[: shape.length] for s in (*splitters[bucket - 1 : bucket], *splitters[bucket : bucket + 1]) if len(s) >= shape.length]
        passed: dict[bytes, tuple] = {}
        for i, (suffix, left, at, least) in enumerate(zip(suffixes, before, place.tolist(), (place - high).tolist(), strict=True)):
            shared_n = max((_shared_bytes(suffix, s) for s in between), default=0)
            if shared_n < shape.core:
                continue
            whole, n = left + suffix, len(left)
            for offset in range(max(least, shape.length - shared_n), n + 1):
                h = xxhash.xxh3_128_digest(whole[n - offset : n - offset + shape.length])
                if h not in passed or found[offset, i]:
                    passed[h] = (tids[i], at - offset, None) if found[offset, i] else (tids[i], at - offset, at - offset + shape.length)
        blocks: dict[int, list[bytes]] = {}
        for h, (t, x, y) in passed.items():
            blocks.setdefault(int.from_bytes(h[:6]) % (len(splitters) + 1), []).append(h + t + x.to_bytes(8, "little") + bytes([y is not None]))
        rows = [(*r, None) for r in rows] + [(None, None, None, part, b"".join(block)) for part, block in blocks.items()]
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names=["tid", "a", "b", "part", "block"])

    return sort


#: A string that a bucket passes on: its hash, its text and place, and whether it is found once there.
_PASSED = np.dtype([("h", "<u8", 2), ("tid", "u1", 16), ("a", "<i8"), ("lone", "?")])


def _across(shape: Shape):
    """Of strings passed on, by parts of the hashes' range, those that come from two buckets and are found once
    in their own."""

    def resolve(table: pa.Table) -> pa.Table:
        held = np.frombuffer(b"".join(table.column("block").to_pylist()), _PASSED)
        order, new = _equal_runs(held["h"])
        held = held[order]
        kind = np.cumsum(new) - 1
        held = held[(np.bincount(kind) > 1)[kind] & held["lone"]]
        return pa.table([_binary(held["tid"]), pa.array(held["a"]), pa.array(held["a"] + shape.length)], names=["tid", "a", "b"])

    return resolve


def _every(keys: list[bytes], buckets: int) -> list[bytes]:
    """Splitters at equal distances of sampled keys."""
    keys.sort()
    return sorted({keys[len(keys) * i // buckets] for i in range(1, buckets)} - {keys[0]}) if keys else []


def _tid(docs: DataFrame):
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def repeated_spans(docs: DataFrame, shape: Shape = Shape(), stage: Staging | None = None, buckets: int = 0) -> DataFrame:
    """tid, spans (a, b) of the bytes to remove, for each text (by its 128-bit hash) that has any; ``buckets`` is
    the least number of them."""
    spark = docs.sparkSession
    stage = stage or Staging(spark, "suffix", TEXTS)
    partitions = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = spark.sparkContext.broadcast
    texts = docs.select(_tid(docs).alias("tid"), F.col("text").cast("binary").alias("text"))

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = max(1, 2 * size // (shape.reach + 1))
    buckets = max(partitions, anchors // BUCKET_LEADS)
    part, thin = min(1.0, 8 * SAMPLED * buckets / anchors), 1 if 8 * SAMPLED * buckets < anchors else max(1, anchors // (SAMPLED * buckets))
    sampled = texts.sample(fraction=part, seed=1) if part < 1 else texts
    keys = [bytes(r["key"]) for r in sampled.mapInArrow(_sampler(shape, 8 if part < 1 else thin), "key binary").collect()]
    leads = share(_every(keys, buckets))
    marks = texts.mapInArrow(_scanner(shape, leads), _BLOCKS).groupBy("bucket").applyInArrow(_lead_sorter(shape, leads), _MARKS)
    marks = stage.table(marks, "marks")

    places = marks.filter(F.col("kind") == MIXED).groupBy("tid").agg(F.collect_set(F.struct("at", "low", "high")).alias("places"))
    suffixes = texts.join(places, "tid").select("tid", "text", "places")
    columns = "tid binary, place long, low long, high long, suffix binary, before binary"
    suffixes = stage.table(suffixes.mapInArrow(_cutter(shape), columns), "suffixes")

    n = suffixes.count()
    buckets = max(partitions, n // BUCKET_SUFFIXES)
    sampled = suffixes.filter(F.rand(1) < min(1.0, SAMPLED * buckets / max(n, 1))).select("suffix", "before")
    sampled = stage.table(sampled, "sampled")
    frequent = {bytes(r["key"]): r["count"] for r in sampled.mapInArrow(_keys(shape, True), "key binary").groupBy("key").count().collect()}
    hot = [k for k, m in frequent.items() if m > SAMPLED // 2]
    keys = [k for k, m in frequent.items() if m <= SAMPLED // 2 for _ in range(m)]
    if hot:
        known = spark.createDataFrame([(bytearray(k),) for k in hot], "short binary")
        whole = sampled.mapInArrow(_keys(shape, False), "key binary").join(F.broadcast(known), F.expr(f"substring(key, 1, {SHORT})") == F.col("short"))
        keys += [bytes(r["key"]) for r in whole.select("key").collect()]
    splitters = share(_every(keys, buckets))
    dealt = suffixes.mapInArrow(_dealt(shape, splitters), "bucket long, " + columns)
    found = dealt.groupBy("bucket").applyInArrow(_suffix_sorter(shape, splitters), "tid binary, a long, b long, part long, block binary")
    found = stage.table(found, "found")
    across = found.filter("part IS NOT NULL").select("part", "block").groupBy("part").applyInArrow(_across(shape), "tid binary, a long, b long")
    whole = marks.filter(F.col("kind") == REPEATED).select("tid", F.col("low").alias("a"), (F.col("high") + shape.length).alias("b"))
    spans = whole.unionByName(found.filter("part IS NULL").select("tid", "a", "b")).unionByName(across)
    spans = spans.groupBy("tid", "a").agg(F.max("b").alias("b")).groupBy("tid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    spans = stage.table(spans, "spans")
    stage.drop("marks", "suffixes", "sampled", "found")
    return spans


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def _digests(texts: bool):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text, spans = text.as_py() or b"", merged(spans)
                rest = kept(text, spans)
                rows.append((len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
            types, names = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()], ["n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)]
            n = 5 if texts else 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[:n]], names=["doc_id", *names[:n]])

    return digests


def suffix_dedup(docs: DataFrame, shape: Shape = Shape(), buckets: int = 0, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with ``texts`` also what is kept of its text,
    less the pieces of characters that a cut splits."""
    spans = repeated_spans(docs.select("text"), shape, buckets=buckets)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), _tid(docs).alias("tid"))
    rows = rows.join(spans, "tid", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_digests(texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * texts)


def _cleaner(words: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            texts = []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                cut = [(a, b) for a, b in merged(spans) if len(text[a:b].split()) >= words] if spans else []
                texts.append(kept(text, cut).decode("utf-8", "ignore").encode() if cut else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["row", "text"])

    return clean


def deduplicated(docs: DataFrame, shape: Shape = Shape(), words: int = 0) -> DataFrame:
    """The documents with their columns, their texts without what repeats; n_chars follows the text. Of the runs
    of repeated strings those of fewer than ``words`` words stay."""
    spans = repeated_spans(docs.select("text"), shape).select(F.col("tid").alias("__tid"), F.col("spans").alias("__spans"))
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row"), F.col("text").cast("binary").alias("__text"), _tid(docs).alias("__key"))
    packed = packed.join(spans, F.col("__key") == F.col("__tid"), "left").select(F.col("__row").alias("row"), F.col("__text").alias("text"), F.col("__spans").alias("spans"))
    schema = T.StructType([packed.schema["row"], T.StructField("text", T.BinaryType())])
    out = packed.mapInArrow(_cleaner(words), schema).withColumn("text", F.col("text").cast("string"))
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    out = out.select(*columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir), texts=True)
