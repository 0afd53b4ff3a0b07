"""LM scoring with Brown's class-based bigrams: exchange clustering assigns words to classes; class
transitions and word emissions give a smoothed perplexity.

Each of about ``COMMON`` most frequent words (ties by a hash) is a unit of its own, and the rest are units by their last letters;
so every word, known or not, has a class. Pairs of neighbouring units are counted over the whole corpus. The
exchange begins with the ``SEEDS`` most frequent words and the endings, moved one by one on the driver; a
word then takes its ending's class, and in ``ROUNDS`` rounds each half of the words in turn moves, in Spark,
to the class whose transitions its own neighbours' classes fit best. The number of classes rises with the
square root of the number of words that have units. A text's probability is the product over its tokens of

    P(class | class before) * P(word | class),   the end of text having a class of its own,

both smoothed by adding one half and one; each class keeps room for one unknown word, so the probabilities
of all words after any word sum to 1.

All counts cover the whole corpus. Counts of the ``COMMON`` words are broadcast; the others' are joined to
the texts they occur in. Words are told apart by 64-bit hashes in that join.

Edge cases: a null text is an empty one, which is scored as its end alone; a null doc_id counts as an empty
string in the split; rows repeated are counted each; very long texts are one row's work and nothing is cut;
without training texts every class is uniform; columns other than doc_id and text are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoflux.llm.common import Staging, documents

FOLDS, HELD_OUT = 7, 2
COMMON, SEEDS, ENDINGS, SWEEPS, ROUNDS = 200_000, 500, 256, 6, 4
#: Bytes of a common word on average, at most: together they bound what is broadcast.
WORD_BYTES = 64
#: Pairs that a task sorts at a time (and from both ends; twice as many sides make a bucket), and units and pairs of a packed block.
HELD, BLOCK_UNITS, BLOCK_PAIRS = 1_000_000, 4_096, 250_000
#: Pairs of a bucket, whose sides one group sorts: a few copies of 32 bytes for each.
BUCKET_PAIRS = 250_000
#: Words that a task counts at a time, and rare words whose endings it remembers.
WORDS_HELD, REMEMBERED = 200_000, 100_000
#: Bytes of the batches that go to the tasks: packed blocks are large rows, so their number says little.
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most BATCH_BYTES or one row in the jobs that run meanwhile."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def classes_for(words: int) -> int:
    """Classes for so many words, the end of text's included."""
    return 16 + math.isqrt(words) // 4


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int, sweeps: int, fixed: int) -> np.ndarray:
    """Class of each unit, by moving one unit at a time to the class that raises the likelihood of the pair
    counts most. Unit ``fixed`` stays alone in the last class."""
    k = len(pairs)
    weight = pairs.sum(axis=1) + pairs.sum(axis=0)
    order = [int(u) for u in np.argsort(-weight, kind="stable") if u != fixed]
    of = np.full(k, classes - 1)
    of[order] = np.arange(len(order)) % (classes - 1)
    member = np.zeros((k, classes))
    member[np.arange(k), of] = 1
    between = member.T @ pairs @ member
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            old = of[u]
            member[u, old] = 0
            after, before, own = pairs[u] @ member, pairs[:, u] @ member, pairs[u, u]
            between[old] -= after
            between[:, old] -= before
            between[old, old] -= own
            # the change in sum n log n of class pairs, less that of the classes on either side
            gain = (_plogp(between + after) - _plogp(between)).sum(axis=1) + (_plogp(between.T + before) - _plogp(between.T)).sum(axis=1)
            d = np.diagonal(between)
            gain += _plogp(d + after + before + own) + _plogp(d) - _plogp(d + after) - _plogp(d + before)
            rows, columns = between.sum(axis=1), between.sum(axis=0)
            gain -= _plogp(rows + pairs[u].sum()) - _plogp(rows) + _plogp(columns + pairs[:, u].sum()) - _plogp(columns)
            new = int(gain[: classes - 1].argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            of[u] = new
            member[u, new] = 1
            between[new] += after
            between[:, new] += before
            between[new, new] += own
            moved += new != old
        if not moved:
            break
    return of


def _ending(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word[-3:]) % ENDINGS


class Units(dict):
    """The unit of each word: a frequent word's place, or else that of its ending behind them, which a second, smaller
    table remembers; the end of text is the last unit."""

    def __init__(self, common: list[bytes]):
        super().__init__(zip(common, range(len(common)), strict=True))
        self.rare: dict[bytes, int] = {}
        self.end = len(common) + ENDINGS

    def __missing__(self, word: bytes) -> int:
        unit = self.rare.get(word)
        if unit is None:
            unit = self.rare[word] = len(self) + _ending(word)
        return unit

    def turn(self) -> None:
        """Call between batches."""
        if len(self.rare) > REMEMBERED:
            self.rare.clear()

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Units of an end and then of each text's words and end; and each text's number of tokens."""
        self.turn()
        sizes = np.array([len(t) for t in texts], np.int64)
        total = int(sizes.sum())
        out = np.full(total + len(texts) + 1, self.end, np.int64)
        out[np.arange(total) + np.repeat(np.arange(1, len(texts) + 1), sizes)] = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, total)
        return out, sizes + 1


def _words(text) -> list[bytes]:
    return (text.as_py() or b"").lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(_words(text))
            if len(counts) > WORDS_HELD:
                yield rows(counts)
                counts.clear()
    yield rows(counts)


def _parts(column, most: int = 1 << 20) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of a batch's texts, in parts of some bytes: (first row, texts)."""
    held, size, first = [], 0, 0
    for i, text in enumerate(column):
        words = _words(text)
        held.append(words)
        size += sum(map(len, words)) + len(words)
        if size > most:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _count_pairs(shared):
    """(u, v, n) of the neighbouring units of a task's texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(shared.value)
        held, size, k = [], 0, units.end + 1

        def rows():
            codes, n = np.unique(np.concatenate([*held, np.empty(0, np.int64)]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((codes // k).astype("i4")), pa.array((codes % k).astype("i4")), pa.array(n.astype("i8"))], names=["u", "v", "n"])

        for batch in batches:
            for _, texts in _parts(batch.column(0)):
                found, _ = units.of(texts)
                held.append(found[:-1] * k + found[1:])
                size += len(found)
                if size > HELD:
                    yield rows()
                    size = 0
        yield rows()

    return count


_SIDES = "bucket int, keys binary, others binary, counts binary"
#: Units with their neighbours after and before them, as columns of their own: sums by class read one side only.
_SIDE = {"units": "<i4", "sizes": "<i4", "others": "<i4", "counts": "<i8"}
_AFTER, _BEFORE = ([f"{c}_{side}" for c in _SIDE] for side in ("after", "before"))
_CONTEXTS = ", ".join(f"{c} binary" for c in [*_AFTER, *_BEFORE])


def _split_sides(buckets: int):
    """Pairs (u, v, n) from both ends, packed by the bucket of the unit: 2 * unit, one more for those before it."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows():
            u, v, n = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            key, other, n = np.concatenate([2 * u, 2 * v + 1]), np.concatenate([v, u]), np.concatenate([n, n])
            bucket = key // 2 % buckets
            order = np.argsort((bucket.astype(np.int64) << 32) + key)
            key, other, n, bucket = key[order].astype("<i4"), other[order].astype("<i4"), n[order].astype("<i8"), bucket[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            parts = [pa.array([x.tobytes() for x in np.split(c, starts[1:])], pa.binary()) for c in (key, other, n)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype("i4")), *parts], names=["bucket", "keys", "others", "counts"])

        for batch in batches:
            if len(batch):
                held.append([c.to_numpy() for c in batch.columns])
                size += len(batch)
            if size > HELD:
                yield rows()
                size = 0
        if held:
            yield rows()

    return split


def _pack(table: pa.Table) -> pa.Table:
    """Blocks of a bucket's units, with their neighbours and counts."""
    kinds = {"keys": "<i4", "others": "<i4", "counts": "<i8"}
    key, other, n = (np.concatenate([np.empty(0, t), *(np.frombuffer(part.as_buffer(), t) for part in table.column(c))]) for c, t in kinds.items())
    del table
    order = np.argsort(key, kind="stable")
    key, other, n = key[order], other[order], n[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    ends = np.append(starts[1:], len(key))
    rows, a = [], 0
    while a < len(starts):
        # a unit's two keys stay together; a block has one unit at least
        b = max(a + 1, min(a + 2 * BLOCK_UNITS, int(np.searchsorted(ends, starts[a] + BLOCK_PAIRS, "right"))))
        b += b < len(starts) and key[starts[b]] // 2 == key[starts[b - 1]] // 2
        at, keys, sizes, row = slice(starts[a], ends[b - 1]), key[starts[a:b]], (ends - starts)[a:b], []
        for side in (0, 1):
            mine = keys % 2 == side
            entries = np.repeat(mine, sizes)
            row += [c.astype(t).tobytes() for c, t in zip((keys[mine] // 2, sizes[mine], other[at][entries], n[at][entries]), _SIDE.values(), strict=True)]
        rows.append(row)
        a = b
    columns = zip(*rows, strict=True) if rows else [[]] * 8
    return pa.table([pa.array(c, pa.binary()) for c in columns], names=[*_AFTER, *_BEFORE])


def _unpacked(batch: pa.RecordBatch, i: int, side: list[str]) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in zip(side, _SIDE.values(), strict=True))


def _sum_groups(shared, groups: int):
    """(code, n): counts of pairs of groups, groups being given for each unit."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        total = np.zeros(groups * groups, np.int64)
        for batch in batches:
            for i in range(len(batch)):
                units, sizes, others, n = _unpacked(batch, i, _AFTER)
                total += np.bincount(np.repeat(of[units] * groups, sizes) + of[others], n, len(total)).astype(np.int64)
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(total[codes])], names=["code", "n"])

    return add


def _group_pairs(contexts: DataFrame, of: np.ndarray, groups: int) -> np.ndarray:
    """Counts of pairs of groups, [before, after]: as many cells as groups allow, whatever the corpus."""
    sums = contexts.select(*_AFTER).mapInArrow(_sum_groups(contexts.sparkSession.sparkContext.broadcast(of), groups), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(groups * groups)
    for r in sums.collect():
        out[r["code"]] = r["n"]
    return out.reshape(groups, groups)


def best_classes(after: np.ndarray, before: np.ndarray, own: np.ndarray, between: np.ndarray) -> np.ndarray:
    """The class that raises the likelihood of a unit's pairs most, with its own pairs taken out of its present
    class. ``after`` and ``before`` are [unit, class] counts of its neighbours; the last class takes none."""
    rows, columns = between.sum(axis=1) + 1, between.sum(axis=0) + 1
    to = np.log((between + 0.5) / rows[:, None])  # of class, next class
    come = np.log((between + 0.5) / columns[None, :])  # of class before, class
    score = after @ to.T + before @ come
    n_after, n_before = after.sum(axis=1), before.sum(axis=1)
    left = np.maximum(between[own] - after, 0) + 0.5
    came = np.maximum(between.T[own] - before, 0) + 0.5
    alone = (after * np.log(left / np.maximum(rows[own] - n_after, 1)[:, None])).sum(axis=1)
    alone += (before * np.log(came / np.maximum(columns[own] - n_before, 1)[:, None])).sum(axis=1)
    score[np.arange(len(own)), own] = alone
    score[:, -1] = -np.inf
    best = score.argmax(axis=1)
    return np.where(score[np.arange(len(own)), best] > alone + 1e-9, best, own)


def _mover(shared, classes: int, turn: int):
    """Units of one half that move, with their new classes."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, between = shared.value
        for batch in batches:
            for i in range(len(batch)):
                sides = [_unpacked(batch, i, side) for side in (_AFTER, _BEFORE)]
                units = np.unique(np.concatenate([side[0] for side in sides]))
                units = units[(units + turn) % 2 == 0]
                sums = []
                for own, sizes, others, n in sides:
                    turns = (own + turn) % 2 == 0
                    mine = np.repeat(turns, sizes)
                    cells = np.repeat(np.searchsorted(units, own[turns]) * classes, sizes[turns]) + of[others[mine]]
                    sums.append(np.bincount(cells, n[mine], len(units) * classes).reshape(len(units), classes))
                now = of[units]
                new = best_classes(*sums, now, between)
                moved = (new != now) & (now != classes - 1)
                yield pa.RecordBatch.from_arrays([pa.array(units[moved].astype("i8")), pa.array(new[moved].astype("i8"))], names=["unit", "class"])

    return move


def cluster(train: DataFrame, common: list[bytes], stage: Staging, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit, and the counts of pairs of classes."""
    spark = train.sparkSession
    share = spark.sparkContext.broadcast
    pairs = train.mapInArrow(_count_pairs(share(common)), "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))
    pairs = stage.table(pairs, "pairs")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs.count() // BUCKET_PAIRS)
    sides = pairs.mapInArrow(_split_sides(buckets), _SIDES)
    contexts = stage.table(sides.groupBy("bucket").applyInArrow(_pack, _CONTEXTS), "contexts")
    stage.drop("pairs")

    seeds, units, classes = min(SEEDS, len(common)), len(common) + ENDINGS + 1, classes_for(len(common))
    coarse = np.array([*range(seeds), *(seeds + _ending(w) for w in common[seeds:]), *range(seeds, seeds + ENDINGS + 1)], np.int64)
    first = exchange(_group_pairs(contexts, coarse, seeds + ENDINGS + 1), classes, SWEEPS, seeds + ENDINGS)
    of = first[coarse]
    for turn in range(2 * rounds):
        between = _group_pairs(contexts, of, classes)
        moved = contexts.mapInArrow(_mover(share((of, between)), classes, turn), "unit long, class long").toArrow()  # of bounded number
        of = of.copy()
        of[moved.column("unit").to_numpy()] = moved.column("class").to_numpy()
    assert len(of) == units
    between = _group_pairs(contexts, of, classes)
    stage.drop("contexts")
    return of, between


@dataclass
class Model:
    common: list[bytes]  # of bounded number and bytes together, most frequent first; each is a unit
    log_count: np.ndarray  # log10(count + 1) of those
    unit_class: np.ndarray  # of the common words, the endings and the end of text
    log_transition: np.ndarray  # [class before, class]
    log_room: np.ndarray  # log10 of what a class's counts are divided by
    tokens: int
    distinct: int
    texts: int


_RARE = pa.struct([("h", pa.int64()), ("n", pa.int64())])


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        units, of, known_n = Units(model.common), model.unit_class, len(model.common)
        end_known = int(model.texts > 0)
        logs = np.concatenate([model.log_count, np.zeros(ENDINGS), [np.log10(model.texts + 1)]])
        digest = xxhash.xxh3_64_intdigest
        row = (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0
        for batch in batches:
            for first, texts in _parts(batch.column(2)):
                flat, sizes = units.of(texts)
                flat_class, tokens = of[flat], flat[1:]
                starts = np.cumsum(sizes) - sizes
                steps = model.log_transition[flat_class[:-1], flat_class[1:]] - model.log_room[flat_class[1:]]
                rare = np.flatnonzero((tokens >= known_n) & (tokens < units.end))
                text = np.repeat(np.arange(len(texts)), sizes)[rare]
                hashes = np.array([digest(texts[t][i]) - (1 << 63) for t, i in zip(text.tolist(), (rare - starts[text]).tolist(), strict=True)], np.int64)
                by = np.lexsort((hashes, text))
                text, hashes = text[by], hashes[by]
                new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(hashes, prepend=0) != 0)) if len(text) else np.empty(0, np.int64)
                counts = np.diff(np.append(new, len(text)))
                offsets = np.searchsorted(text[new], np.arange(len(texts) + 1)).astype("i4")
                entries = pa.StructArray.from_arrays([pa.array(hashes[new]), pa.array(counts.astype("i8"))], fields=list(_RARE))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(np.arange(row, row + len(texts))),
                        pa.array(sizes),
                        pa.array(np.add.reduceat((tokens < known_n).astype(np.int64), starts) + end_known),
                        pa.array(np.add.reduceat(logs[tokens], starts)),
                        pa.array(np.add.reduceat(steps, starts)),
                        pa.ListArray.from_arrays(pa.array(offsets), entries),
                    ],
                    names=["doc_id", "held_out", "row", "n_tokens", "n_common", "log_common", "chain", "rare"],
                )
                row += len(texts)

    return score


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [xxhash.xxh3_64_intdigest(w.as_py()) - (1 << 63) for w in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), batch.column(1)], names=["h", "count"])


def _class_kinds(shared):
    """Distinct words and tokens of each class, of a part of the vocabulary."""

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, of = shared.value
        units = Units(common)
        for batch in batches:
            units.turn()
            classes = of[np.fromiter(map(units.__getitem__, batch.column(0).to_pylist()), np.int64, len(batch))]
            found, n = np.unique(classes, return_counts=True)
            tokens = np.bincount(classes, batch.column(1).to_numpy(), minlength=len(found))[found].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64()), pa.array(tokens, pa.int64())], names=["class", "kinds", "tokens"])

    return kinds


def _most_frequent(words: DataFrame) -> DataFrame:
    """The words above the count that about COMMON words reach (or WORD_BYTES times as many bytes), from a histogram of
    counts by their logarithm, so no task has to hold or send the top of its own part; of the words in the first bin
    that does not fit whole, those whose hash is in the share that does."""
    level = F.floor(F.log2("n") * 64).cast("int")
    bins = words.groupBy(level.alias("level")).agg(F.count("*").alias("count"), F.sum(F.octet_length("word")).alias("bytes")).collect()
    words_left, bytes_left, least, split, share = COMMON, COMMON * WORD_BYTES, None, None, 0.0
    for r in sorted(bins, key=lambda r: -r["level"]):
        if r["count"] > words_left or r["bytes"] > bytes_left:
            split, share = r["level"], min(words_left / r["count"], bytes_left / max(1, r["bytes"]))
            break
        words_left, bytes_left, least = words_left - r["count"], bytes_left - r["bytes"], r["level"]
    whole = level >= F.lit(least) if least is not None else F.lit(False)
    part = (level == F.lit(split)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))) if split is not None else F.lit(False)
    return words.filter(whole | part)


def fit(texts: DataFrame, stage: Staging) -> tuple[Model, DataFrame]:
    """The model of (held_out, text) rows that are not held out, and the vocabulary (word, n)."""
    spark = texts.sparkSession
    train = texts.filter("NOT held_out").select("text")
    vocabulary = stage.table(train.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    texts_n = train.count()
    frequent = sorted(_most_frequent(vocabulary).collect(), key=lambda r: (-r["n"], bytes(r["word"])))
    common = [bytes(r["word"]) for r in frequent]
    of, between = cluster(train, common, stage)
    classes = len(between)

    kinds, emitted = np.zeros(classes), np.zeros(classes)
    counted = vocabulary.mapInArrow(_class_kinds(spark.sparkContext.broadcast((common, of))), "class long, kinds long, tokens long")
    for r in counted.groupBy("class").agg(F.sum("kinds").alias("kinds"), F.sum("tokens").alias("tokens")).collect():
        kinds[r["class"]], emitted[r["class"]] = r["kinds"], r["tokens"]
    kinds[of[-1]] += texts_n > 0
    emitted[of[-1]] += texts_n
    transition = (between + 0.5) / (between.sum(axis=1, keepdims=True) + 0.5 * classes)
    model = Model(
        common, np.log10(np.array([r["n"] for r in frequent], float) + 1), of, np.log10(transition), np.log10(emitted + kinds + 1),
        tokens + texts_n, distinct + (texts_n > 0), texts_n,
    )
    return model, vocabulary


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    stage = Staging(spark, "class_lm")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == HELD_OUT).alias("held_out"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, held_out boolean, row long, n_tokens long, n_common long, log_common double, chain double, rare array<struct<h: long, n: long>>"
    with small_batches(spark):
        model, vocabulary = fit(texts, stage)
        scored = stage.table(texts.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), schema), "scored")
    counts = vocabulary.select("word", "n").mapInArrow(_hash_words, "h long, count long")
    rare = (
        scored.select("row", F.inline("rare"))
        .join(counts, "h")
        .groupBy("row")
        .agg(F.sum("n").alias("n_rare"), F.sum(F.col("n") * F.log10(F.col("count") + 1.0)).alias("log_rare"))
    )
    log_counts = F.col("log_common") + F.coalesce("log_rare", F.lit(0.0))
    room = float(np.log10(model.tokens + model.distinct + 1))
    return scored.drop("rare").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (log_counts - F.col("n_tokens") * F.lit(room)).alias("base_score"),
        (log_counts + F.col("chain")).alias("score"),
        F.pow(F.lit(10.0), -(log_counts + F.col("chain")) / F.col("n_tokens")).alias("perplexity"),
    )


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
