"""Periodic runs against a plain search over all stretches."""

import hashlib
import os
import random
import re
import zlib

import pytest

from cartoflux.llm.periodic_runs import collapsed, looped, op12_periodic_runs, periodic_runs, places, runs_of, stretches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=6, repeats=4):
    """Every stretch that no neighbour extends, its smallest period found by trying all."""
    n, found = len(words), set()
    for q in range(1, n // repeats + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= max(least, repeats * q):
                smallest = next(p for p in range(1, q + 1) if all(words[k] == words[k + p] for k in range(start, end - p)))
                if smallest == q:
                    found.add((start, end - start, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_kept(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(plain_kept(words, runs)))


def test_runs_are_those_of_a_plain_search():
    rng = random.Random(3)
    for trial in range(1500):
        words = [rng.choice("ab" if trial % 2 else "abcd") for _ in range(rng.randrange(40))]
        if trial % 3 == 0:
            at, unit = rng.randrange(len(words) + 1), [rng.choice("xyzab") for _ in range(rng.randrange(1, 7))]
            words[at:at] = unit * rng.randrange(1, 9)
        runs = runs_of(words)
        assert runs == plain_runs(words), words
        assert collapsed(words, runs) == plain_kept(words, runs)
        assert runs_of(words, 4, 2) == plain_runs(words, 4, 2)


def test_many_and_long_stretches():
    assert runs_of(["a"] * 5000) == [(0, 5000, 1)]
    words = [w for i in range(400) for w in ["k"] * 6 + [f"w{i}"]]
    assert runs_of(words) == plain_runs(words) and len(runs_of(words)) == 400
    assert places(0) == [] and places(0b1011) == [0, 1, 3] and places((1 << 100) - 1) == list(range(100))
    assert stretches(0b1110111, 3) == 0b10001 and stretches(0b11, 3) == 0


def test_rows(spark):
    texts = [None, "", " \t ", "one", "a a a a a a", "x y x y x y x y z", "é é é é é é\x0bq", "a b", "b " * 3000, " ".join(f"w{i % 7}" for i in range(900))]
    rows = [(i, t, "clash") for i, t in enumerate(texts * 12)] + [(4, "a a a a a a", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic_runs(docs)
    assert got.columns == ["doc_id", "runs", "collapsed"] and got.count() == len(rows)
    found = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()}
    for i, t, _ in rows:
        words = WORD.findall(t or "")
        assert found[i] == (plain_runs(words), plain_kept(words, plain_runs(words)))
    assert periodic_runs(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "a a a a a a")], "doc_id long, text string")
    assert periodic_runs(looped(alone)).collect()[0]["collapsed"] == "a"


def test_the_query(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b", "ç", "long"]) for _ in range(rng.randrange(60))) for _ in range(400)] + [None, "", "  "]
    spark.createDataFrame([(i - 5, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op12_periodic_runs(spark, str(tmp_path)).collect())) == sorted(plain_row(i - 5, t) for i, t in enumerate(texts))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted(map(tuple, op12_periodic_runs(spark, sf).collect())) == sorted(plain_row(r["doc_id"], r["text"]) for r in docs)
