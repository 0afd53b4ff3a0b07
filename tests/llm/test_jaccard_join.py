import random

import numpy as np
import pytest

from cartoflux.llm.jaccard_join import Bands, folded, jaccard_components, overlap_bound, segment_keys, shingle_set, signature


def brute(texts, n=4, percent=85):
    """(size, component) of every text, by comparing every pair."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed, n=300):
    rng = random.Random(seed)
    prose = lambda k: [rng.choice("the of and to in is it be was ha re ti on en er es or an at th".split()) + rng.choice("abcdefghij") for _ in range(k)]
    texts = [None, "", "  \n", "One", "one", "one two", "a b c d", "A B\tC  D", "a b c d e", "x " * 50, "x " * 51]
    whole = prose(300)
    for _ in range(n):
        kind = rng.randrange(6)
        if kind < 2 and len(texts) > 30:
            words = (rng.choice(texts[20:]) or "").split()
            for _ in range(rng.randrange(1 + len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(["new", "other", "word"])
            texts.append(" ".join(words))
        elif kind == 2:
            texts.append(" ".join(whole[: rng.randrange(200, 300)] + prose(rng.randrange(20))))
        else:
            texts.append(" ".join(prose(rng.choice([0, 3, 5, 8, 30, 120, 400]))))
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, id string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    want = dict(enumerate(brute(texts)))
    assert {i: (found[i], want[i]) for i in want if found[i] != want[i]} == {} and len(found) == len(texts)


def test_similar_sets_share_a_segment():
    rng = np.random.default_rng(1)
    bands = Bands(85)
    for _ in range(3000):
        size = int(rng.choice([1, 2, 3, 5, 6, 7, 9, 12, 20, 50, 200, 900]))
        both = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)
        union = size + int(rng.integers(0, size // 5 + 2))
        more = rng.integers(0, 2**63, union - size, dtype=np.uint64)
        cut = int(rng.integers(0, len(more) + 1))
        a, b = (np.unique(np.concatenate([both, m])) for m in (more[:cut], more[cut:]))
        if 100 * size >= 85 * union:
            assert set(segment_keys(a, bands).tolist()) & set(segment_keys(b, bands).tolist())
        marks = [signature(s) for s in (a, b)]
        most = overlap_bound(*folded(marks, min(map(len, marks)))[:, None], np.array([len(a)]), np.array([len(b)]))
        assert most[0] >= size


def test_rows_that_are_odd(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, None), (3, ""), (9, "A b c d e f"), (7, "q r s t"), (None, "lone words stand here")]
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert found == sorted([(5, 3, 5), (5, 3, 5), (3, 0, 3), (3, 0, 3), (9, 3, 5), (7, 1, 7), (None, 1, None)], key=str)
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shingles_split_at_ascii_white_space_only():
    assert len(shingle_set("a b\x0bc d e f".encode(), 4)) == 2 and len(shingle_set(b" \t\r\n\x0c", 4)) == 0


def test_five_words_against_brute_force(spark):
    texts = corpus(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, 5, 80).collect()}
    assert found == dict(enumerate(brute(texts, 5, 80)))
