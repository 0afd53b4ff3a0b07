"""Token counts and the unigram codec against the library itself."""

import dataclasses
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from cartoflux.llm.pieces import chunks, load
from cartoflux.llm.token_counts import MergeCounter, count_tokens
from cartoflux.llm.unigram import DoubleArrayTrie, UnigramCodec, encode_decode, estimate

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  ", "a", "  a  b ", "a▁b", "▁", "<s> hello</s> <0x41>", "héé　x힣 😀", "\t\ta\nb", "\x00a\x00",
    "The quick brown fox jumps over the lazy dog.", "x" * 500, " " * 40, "ß größe straße", "aaaaaaabaaaaaa  bbbb" * 20,
    "Anblewh sttible athawh thonre was is anly hend and, oftionnten.", "日本語のテキスト", "e\u0301\u0302", "\u00a0\u2003x",
]


def noise(n=300):
    rng = random.Random(5)
    letters = "abcdefghiklmnorstu  \n.,AÉñ世😀<>0▁"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(n)]


@pytest.fixture(scope="module")
def vocabulary():
    return load(MODEL)


def test_counts_are_the_librarys(vocabulary):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counter = MergeCounter(vocabulary, most=50)
    for text in TEXTS + noise():
        assert counter.count(text) == len(library.encode(text)), text
    assert counter.count(None) == 0


def as_unigram():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def plain_best(vocabulary, lowest, text):
    """The best summed score, by trying every piece at every place."""
    text = text and "▁" + text.replace(" ", "▁")
    score_of = {vocabulary.pieces[i]: vocabulary.scores[i] for i in vocabulary.normal}
    best = [0.0]
    for end in range(1, len(text) + 1):
        options = [best[at] + score_of[text[at:end]] for at in range(max(0, end - 16), end) if text[at:end] in score_of]
        best.append(max(options + ([] if text[end - 1] in score_of else [best[end - 1] + lowest])))
    return best[-1]


def test_paths_are_the_best(vocabulary):
    library = as_unigram()
    codec = UnigramCodec(vocabulary, most=50)

    covered = set("".join(vocabulary.pieces[i] for i in vocabulary.normal))

    def score(ids):
        unknown = lambda c: 0 if c in covered else codec.lowest
        return sum(vocabulary.scores[i] for i in ids if i in vocabulary.normal) + sum(map(unknown, text.replace(" ", "▁")))

    same = 0
    texts = TEXTS + noise()
    for text in texts:
        ids, want = codec.encode(text).tolist(), library.encode(text)
        assert score(ids) == plain_best(vocabulary, codec.lowest, text), text
        assert score(ids) >= score(want)
        same += ids == want
        assert codec.decode(codec.encode(text)) == text.replace("▁", " ")
    assert same > 0.8 * len(texts)


def test_trie_finds_exactly_its_pieces():
    words = {"a": 0, "ab": 1, "abc": 2, "b": 3, "bca": 4, "cab": 5}
    trie = DoubleArrayTrie(words)

    def look(word):
        state = 0
        for c in word:
            place = trie.base[state] + trie.codes.get(c, 10**6)
            if place >= len(trie.check) or trie.check[place] != state:
                return -1
            state = place
        return trie.value[state]

    assert {w: look(w) for w in words} == words
    assert [look(w) for w in ("c", "ca", "bc", "abca", "x")] == [-1] * 5


@pytest.fixture(scope="module")
def odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x"), (4, "word " * 20_000)]
    return spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, n_tokens string")


def test_odd_rows(spark, odd_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counted = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(odd_rows, MODEL).collect())
    long = len(library.encode("word " * 20_000))
    assert counted == [(0, 1, 1, False), (1, 3, 2, False), (1, 3, 2, False), (2, 0, 0, False), (3, 0, 0, False), (4, 100_000, long, True)]
    back = {(r.doc_id, r.decoded) for r in encode_decode(odd_rows, MODEL).collect()}
    assert back == {(1, "a b"), (2, ""), (3, ""), (None, "x"), (4, "word " * 20_000)}
    assert count_tokens(odd_rows.limit(0), MODEL).collect() == [] == encode_decode(odd_rows.limit(0), MODEL).collect()


def plain_uses(vocabulary, lowest, chunk):
    """Expected uses of pieces, by listing every way to cut a chunk."""
    score_of = {vocabulary.pieces[i].replace("▁", " "): (vocabulary.scores[i], i) for i in vocabulary.normal}

    def ways(at):
        if at == len(chunk):
            yield 0.0, []
        for end in range(at + 1, len(chunk) + 1):
            if chunk[at:end] in score_of:
                score, i = score_of[chunk[at:end]]
                yield from ((score + s, [i, *ids]) for s, ids in ways(end))
        if at < len(chunk) and chunk[at] not in score_of:
            yield from ((lowest + s, ids) for s, ids in ways(at + 1))

    found = list(ways(0))
    total = sum(math.exp(s) for s, _ in found)
    uses = Counter()
    for s, ids in found:
        for i in ids:
            uses[i] += math.exp(s) / total
    return uses


def test_expected_uses(vocabulary):
    scores = [-math.log(32000) - (i % 7) / 3 for i in range(len(vocabulary.pieces))]
    codec = UnigramCodec(dataclasses.replace(vocabulary, scores=scores))
    listed, n = [" the", " anble", "x", " 😀a", "  ", " été", "世a世", " quickly"], np.arange(1, 9)
    found, want = codec.expected(listed, n), Counter()
    for chunk, times in zip(listed, n.tolist(), strict=True):
        for i, u in plain_uses(codec.vocabulary, codec.lowest, chunk).items():
            want[i] += u * times
    assert set(np.flatnonzero(found)) == set(want) and all(math.isclose(found[i], u, rel_tol=1e-9) for i, u in want.items())


def test_many_paths_are_those_of_one(vocabulary):
    codec = UnigramCodec(vocabulary)
    listed = [c for t in [*TEXTS, *noise()] for c in chunks(t)] + [" " + "ab" * 400]
    assert codec.paths(listed) == [codec.viterbi(c) for c in listed]


def test_estimated_scores(spark, vocabulary):
    """Scores are log chances that the corpus makes likelier with each round."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, *noise(100), None, "the cat the dog the end " * 400])], "doc_id long, text string")
    made = [estimate(docs, vocabulary, rounds) for rounds in (1, 3)]
    normal = sorted(vocabulary.normal)
    likely = []
    for v in made:
        assert abs(sum(math.exp(v.scores[i]) for i in normal) - 1) < 1e-2
        codec = UnigramCodec(v)
        likely.append(sum(v.scores[i] for r in docs.collect() for i in codec.encode(r.text).tolist() if i in vocabulary.normal))
    assert likely[1] > likely[0]
    found = encode_decode(docs, MODEL).collect()
    assert all(r.decoded == (t or "").replace("▁", " ") for r, t in zip(sorted(found, key=lambda r: r.doc_id), [r.text for r in docs.orderBy("doc_id").collect()], strict=True))


def test_paths_are_walked_back_together():
    """A step back is one for all chunks, however many these are; chunks of other lengths and empty ones end by themselves."""
    back = np.zeros((3, 5, 2), np.int32)
    back[0, 4], back[0, 3], back[0, 1] = (3, 7), (1, 8), (0, 9)  # pieces 9, 8, 7 of 1, 2 and 1 characters
    back[1, 2] = (0, 5)
    ids, first = UnigramCodec._back(back, np.array([4, 2, 0]))
    assert [r[f:].tolist() for r, f in zip(ids, first, strict=True)] == [[9, 8, 7], [5], []]


def test_bytes_of_pieces_are_made_once(vocabulary):
    codec = UnigramCodec(vocabulary)
    text = "naïve \u4e2d\U0001f600 x\ud7a3 plain"
    assert all(codec.coded[i] == bytes((b,)) for i, b in codec.bytes_of.items())
    assert codec.decode(codec.encode(text)) == text
    assert codec.paths(["\U0001f600a", "", " plain"]) == [codec.viterbi(c) for c in ("\U0001f600a", "", " plain")]
