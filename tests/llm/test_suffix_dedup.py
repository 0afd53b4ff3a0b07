import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from cartoflux.llm.common import CLEANUP, Staging
from cartoflux.llm.suffix_dedup import Shape, deduplicated, multikey_quicksort, op1_suffix_dedup, suffix_dedup

SMALL = Shape(length=40, window=25, gram=4)


def brute(texts, length):
    """(n_removed, n_spans, kept) of every text, by counting every string."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[min(i + length, len(b))] -= 1
        cover = np.cumsum(gone)[: len(b)] > 0
        runs = int((np.diff(cover.astype(int), prepend=0) == 1).sum())
        out.append((len(b), int(cover.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, cover, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed, n=250):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(rng.randrange(5, 40)) for _ in range(12)]
    texts = [None, "", "x" * 39, "y" * 40, "z" * 41, "ab" * 100, "ab" * 60 + "c" + "ab" * 60, "q" * 500]
    texts += ["\0" * 90, "\0" * 30 + "a" + "\0" * 45, "k" * 25 + "\0" * 20, "m" + "k" * 25 + "\0" * 31, "k" * 25 + "\0" * 15]
    for _ in range(n):
        kind = rng.randrange(5)
        if kind == 0 and len(texts) > 20:
            texts.append(rng.choice(texts))
        elif kind == 1 and len(texts) > 20:
            t = list(rng.choice(texts) or "-")
            t[rng.randrange(len(t))] = "#"
            texts.append("".join(t))
        else:
            texts.append(prose(rng.randrange(40)) + "".join(rng.choice(shared) + prose(rng.randrange(6)) for _ in range(rng.randrange(4))))
    return texts


@pytest.mark.parametrize("seed,buckets", [(1, 0), (2, 1), (3, 60), (4, 400)])
def test_against_brute_force(spark, seed, buckets):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, tid string").repartition(3)
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup(docs, SMALL, buckets=buckets).collect()}
    want = brute(texts, SMALL.length)
    assert [i for i in found if found[i] != want[i]] == [] and len(found) == len(texts)


def test_repeated_and_missing_ids(spark):
    rows = [(1, "abc" * 30), (1, "abd" * 30), (None, "some text " * 9), (None, None)]
    found = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()
    want = brute([t for _, t in rows], SMALL.length)
    assert sorted(tuple(r)[1:] for r in found) == sorted(want)
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string"), SMALL).collect() == []


def test_long_text(spark, monkeypatch):
    monkeypatch.setattr("cartoflux.llm.suffix_dedup.PIECE", 1000)
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab cd") for _ in range(30_000)) for _ in range(2)]
    texts.append(texts[0][500:2600] + texts[1][:70])
    found = sorted((r.doc_id, *tuple(r)[1:]) for r in suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), SMALL).collect())
    assert [r[1:] for r in found] == brute(texts, SMALL.length)


def test_cleaned_documents(spark):
    text = "é" * 20 + "0123456789" * 5
    rows = [(1, "p" + text, "s", 7), (2, text + "q", "s", 7), (3, None, None, None), (4, "own", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    found = {r.doc_id: r for r in deduplicated(docs, SMALL).collect()}
    assert docs.columns == deduplicated(docs, SMALL).columns
    assert (found[1].text, found[1].n_chars, found[2].text, found[3].text, found[4].text) == ("p", 1, "q", None, "own")


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 3, (5000, 6)).astype(np.uint64)
    order = multikey_quicksort(rows)
    assert sorted(order) == list(range(5000))
    assert [tuple(r) for r in rows[order]] == sorted(tuple(r) for r in rows)


def test_the_query_has_the_texts_that_are_kept(spark, tmp_path):
    """After the columns of the contract stands what is kept of the text, so a reader need not go by its digest."""
    shared = " ".join(f"word{i}" for i in range(90))
    rows = [(1, "own start " + shared), (2, shared + " own end"), (3, None), (4, "é" * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in op1_suffix_dedup(spark, str(tmp_path)).collect()}
    assert {i: r.text for i, r in found.items()} == {1: "own start ", 2: " own end", 3: "", 4: "é" * 20}
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in found.values())


def test_shuffle_files_go_when_a_table_is_written(spark):
    """A staged table leaves no shuffle files behind, and the session's setting is as before."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()))
    before, was = kept(), spark.conf.get(CLEANUP)
    staged = Staging(spark, "shuffled").table(spark.range(100_000).repartition(4, "id"), "rows")
    for _ in range(50):  # they go in another thread
        if kept() <= before:
            break
        time.sleep(0.1)
    assert kept() <= before and staged.count() == 100_000 and spark.conf.get(CLEANUP) == was
