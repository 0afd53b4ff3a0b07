import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoflux.llm import class_lm
from cartoflux.llm.class_lm import exchange, score_documents
from cartoflux.llm.common import Staging


def texts_of(n, seed):
    rng = random.Random(seed)
    tongues = [["the", "of", "and", "to"] + [f"en{i}" for i in range(60)], ["le", "de", "et", "la"] + [f"fr{i}eux" for i in range(60)]]
    out = []
    for _ in range(n):
        words = rng.choice(tongues)
        out.append(" ".join(rng.choices(words, weights=[20] * 4 + [1] * 60, k=rng.randrange(1, 60))) + rng.choice(["", f" own{rng.random()}", " The\x1cOF"]))
    return out


def test_counts_and_scores(spark):
    rows = list(enumerate(texts_of(400, 1))) + [(400, None), (401, ""), (401, ""), (None, "the le"), (403, "w" * 3000), (404, "zz " * 5000)]
    found = score_documents(spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, row string")).collect()
    assert len(found) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    by_id = {}
    for i, t in rows:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))
        by_id[i] = (held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, base)
    for r in found:
        want = by_id[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert math.isclose(r.base_score, want[4], rel_tol=1e-9)
    kept = [r for r in found if r.held_out]
    assert kept and sum(r.score for r in kept) > sum(r.base_score for r in kept)


def test_probabilities_sum_to_one(spark, monkeypatch):
    docs = spark.createDataFrame([(t,) for t in texts_of(200, 2)], "text string")
    train = docs.select(F.lit(False).alias("held_out"), F.col("text").cast("binary").alias("text"))
    model, vocabulary = class_lm.fit(train, Staging(spark, "t"))
    words = {bytes(r.word): r.n for r in vocabulary.collect()}
    units = class_lm.Units(model.common)
    of = {w: model.unit_class[units[w]] for w in words}
    room = 10**model.log_room
    emitted = np.full(len(room), 1.0) / room  # the unknown word of each class
    for w, n in words.items():
        emitted[of[w]] += (n + 1) / room[of[w]]
    emitted[model.unit_class[-1]] += (model.texts + 1) / room[model.unit_class[-1]]
    assert np.allclose(emitted, 1) and np.allclose((10**model.log_transition).sum(axis=1), 1)


@pytest.mark.parametrize("common", [200_000, 40])
def test_scores_by_counting(spark, monkeypatch, common):
    """The score of every text, from classes as they were found and counts made here."""
    monkeypatch.setattr(class_lm, "COMMON", common)
    rows = [*enumerate(texts_of(300, 5)), (300, None), (301, "new words only 7 8 9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.score for r in score_documents(docs).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    fold = spark.createDataFrame([(i, held(i), t) for i, t in rows], "doc_id long, held_out boolean, text string")
    model, _ = class_lm.fit(fold.select("held_out", F.col("text").cast("binary").alias("text")), Staging(spark, "t"))
    units = class_lm.Units(model.common)
    assert (len(model.common) <= 60) == (common == 40) and len(model.unit_class) == units.end + 1
    words = lambda t: (t or "").encode().lower().split()
    of = lambda w: int(model.unit_class[units.end if w is None else units[w]])
    pairs, counts, emitted = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            line = [None, *words(t), None]
            pairs.update((of(a), of(b)) for a, b in zip(line, line[1:], strict=False))
            counts.update(line[1:])
    for w, n in counts.items():
        emitted[of(w)] += n + 1
    k = len(model.log_room)
    for i, t in rows:
        line, want = [None, *words(t), None], 0.0
        for a, b in zip(line, line[1:], strict=False):
            before = sum(n for (c, _), n in pairs.items() if c == of(a))
            want += math.log10((pairs[of(a), of(b)] + 0.5) / (before + 0.5 * k)) + math.log10((counts[b] + 1) / (emitted[of(b)] + 1))
        assert math.isclose(found[i], want, rel_tol=1e-9)


def test_rounds_raise_the_likelihood(spark):
    train = spark.createDataFrame([(t.encode(),) for t in texts_of(400, 6)], "text binary")
    common = [w for w, _ in Counter(w for t in texts_of(400, 6) for w in t.encode().lower().split()).most_common(100)]

    def likelihood(rounds):
        _, between = class_lm.cluster(train, common, Staging(spark, "t"), rounds)
        p = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
        return p(between) - p(between.sum(axis=0)) - p(between.sum(axis=1))

    assert likelihood(4) > likelihood(0)


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(0)
    kind = np.array([0, 1, 2, 3] * 6)
    pairs = np.where(kind[None] == (kind[:, None] + 1) % 4, 50, 0) + rng.integers(0, 3, (24, 24))
    pairs = np.pad(pairs, (0, 1))
    of = exchange(pairs.astype(float), 5, 10, 24)
    assert of[24] == 4 and len({(int(k), int(c)) for k, c in zip(kind, of, strict=False)}) == 4


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(2, "only held out")], "doc_id long, text string")
    n = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    found = score_documents(docs.selectExpr(f"{n}L AS doc_id", "text")).collect()
    assert found[0].held_out and (found[0].n_known, found[0].train_tokens, found[0].base_score) == (0, 0, 0.0)
    assert score_documents(docs.limit(0)).collect() == []


def test_a_bound_within_a_level(spark, monkeypatch):
    """Of words of equal count as many are clustered as fit; a long word counts by its bytes."""
    monkeypatch.setattr(class_lm, "COMMON", 300)
    words = spark.createDataFrame([(f"w{i}".encode(), 1) for i in range(1000)] + [(b"top", 9), (b"x" * 500, 5)], "word binary, n long")
    kept = {bytes(r["word"]) for r in class_lm._most_frequent(words).collect()}
    assert {b"top", b"x" * 500} <= kept and 240 <= len(kept) <= 360
    huge = words.union(spark.createDataFrame([(b"x" * 10_000_000, 5)], "word binary, n long"))
    assert max(len(r["word"]) for r in class_lm._most_frequent(huge).collect()) <= 500
    assert class_lm._most_frequent(words.limit(0)).count() == 0
