"""The pipeline against a brute-force version of its stages on a small fixture, and the classifier's cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartoflux.llm import quality
from cartoflux.llm.quality import judge
from tests.llm.test_jaccard_join import brute as brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=1, n=220):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    passage = prose(90)
    rows, labels = [], []
    for i in range(n):
        kind = i % 11
        if kind == 3:
            text = " ".join(f"{word().upper()}!!" for _ in range(60))
        elif kind == 5:
            text = f"{word()} " * 80
        elif kind == 7 and i > 20:
            text = rows[i - 7][1] + " more"
        elif kind == 8:
            text = prose(40) + " " + passage + " " + prose(30)
        else:
            text = prose(rng.randrange(40, 140))
        rows.append((i, text, rng.choice(["en", "fr"]), rng.choice(["s1", "s1", "s1", "s2", "s3"]), len(text)))
        if i % 2:
            labels.append((i, int(kind not in (3, 5)), 0))
    return rows, labels


def without_passages(texts, length=200, words=50):
    """Texts without the runs of bytes, of so many words, that strings of so many bytes found twice cover."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for text, b in zip(texts, raw, strict=True):
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept, at = b"", 0
        for cut, run in groupby(gone):
            part = b[at : at + len(list(run))]
            at += len(part)
            kept += b"" if cut and len(part.split()) >= words else part
        out.append(text if text is None else kept.decode("utf-8", "ignore"))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, labels = documents()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"{number}"))
        docs = spark.read.parquet(str(tmp_path / f"{number}"))
        kept.append(sorted(docs.collect(), key=lambda r: r.doc_id))
        if number < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, apart, cut, mix, coded = kept
    assert {r.doc_id % 11 for r in good} & {3, 5} == set() and len(good) == sum(i % 11 not in (3, 5) for i in range(len(rows)))
    groups = brute_components([r.text for r in good], 5, 80)
    assert [r.doc_id for r in apart] == [r.doc_id for i, r in enumerate(good) if groups[i][1] == i]
    for row, want in zip(cut, without_passages([r.text for r in apart]), strict=True):
        assert row.text == want and row.n_chars == len(row.text)
    assert sum(len(a.text) - len(b.text) for a, b in zip(apart, cut, strict=True)) > 8000
    text = {r.doc_id: r.text for r in cut}
    taken = defaultdict(int)
    for r in mix:
        assert r.text == text[r.doc_id]
        taken[r.doc_id] += 1
    sizes = defaultdict(int)
    for r in cut:
        sizes[r.source] += len(r.text.split())
    got = defaultdict(int)
    for r in mix:
        got[r.source] += len(r.text.split())
    assert max(taken.values()) <= 3 and abs(sum(got.values()) - sum(sizes.values())) <= 3 * 200
    assert [r.doc_id for r in coded] == [r.doc_id for r in mix]
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in coded)
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, ran.collect())) == sorted(map(str, coded))


def test_classifier_cases(spark):
    rows, labels = documents(2)
    rows += [(900, None, None, None, None), (901, "", "en", "s9", 0), (902, rows[1][1] * 300, "en", "s2", 1), rows[1], (None, "no number", "en", "s1", 9)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], COLUMNS + ", keep string")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (77777, 0, 0)], "doc_id long, quality int, toxic int")
    found = judge(docs, marks).collect()
    assert len(found) == len(rows) and all(0 <= r.quality <= 1 and 0 < r.path_rate < 1 for r in found)
    wrong = [r.doc_id for r in found if r.doc_id is not None and r.doc_id < 220 and r.keep != (r.doc_id % 11 not in (3, 5))]
    assert wrong == []
    assert all(r.keep for r in judge(docs, marks.limit(0)).collect()) and judge(docs.limit(0), marks).collect() == []


@pytest.mark.parametrize("strength", ["few", "many"])
def test_sparse_sites_shrink(spark, strength):
    rng = random.Random(3)
    n = 3 if strength == "few" else 400
    rows, labels = documents(4)
    rows += [(1000 + i, " ".join("AB!!" for _ in range(50 + rng.randrange(9))), "en", "bad", 9) for i in range(n)]
    found = judge(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rate = {r.source: r.rate for r in found.join(spark.createDataFrame(rows, COLUMNS).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.max("host_rate").alias("rate")).collect()}
    assert rate["bad"] < min(v for k, v in rate.items() if k != "bad") and (rate["bad"] > 0.1) == (strength == "few")


def test_near_copies_by_five_words_and_four_fifths(spark, tmp_path):
    rows = []
    for size, changes in ((100, 2), (184, 4), (100, 3)):  # of five words 0.811, 0.800, 0.730; of four 0.848, 0.838, 0.780
        words = [f"w{size}x{changes}x{i}" for i in range(size)]
        changed = list(words)
        for c in range(changes):
            changed[(2 * c + 1) * size // (2 * changes)] = f"new{c}"
        rows += [(len(rows) + i, " ".join(w), "en", "s1", 9) for i, w in enumerate((words, changed))]
    apart = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, COLUMNS), str(tmp_path))
    groups = brute_components([r[1] for r in rows], 5, 80)
    assert [g for _, g in groups] == [0, 0, 2, 2, 4, 5]
    assert sorted(r.doc_id for r in apart.collect()) == [0, 2, 4, 5]


def test_passages_of_51_to_65_words_go(spark, tmp_path):
    """Passages of over 50 words in two documents go, ones of 35 words stay, and so does all around them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioulnrstdcm") for _ in range(rng.randrange(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    rows, passages = [], []
    for n in [35, *range(51, 66)]:
        passages.append(prose(n))
        rows += [(len(rows) + i, f"{prose(60)}. {passages[-1]}. {prose(70)}.", "en", "s1", 9) for i in range(2)]
    found = {r.doc_id: r.text for r in corpus_pipeline.repeats_stage(spark, spark.createDataFrame(rows, COLUMNS), str(tmp_path)).collect()}
    want = without_passages([r[1] for r in rows])
    for i, row in enumerate(rows):
        assert found[row[0]] == want[i]
        assert (passages[i // 2] in found[row[0]]) == (i < 2)


CLASHES = ["tid", "spans", "row", "keep", "quality", "evidence", "host", "path", "size", "u", "bits", "rank", "copies", "whole", "col", "bucket", "words", "__row", "__id"]


def test_stages_on_odd_rows(spark, tmp_path):
    """Null, empty, blank, repeated and long rows, extra columns with clashing names, and empty tables."""
    rows, labels = documents(6, 66)
    rows += [(None, None, None, None, None), (None, rows[0][1], "en", "s1", 5), (500, None, None, None, None), (501, "", "en", "s9", 0), (502, " \t ", "en", "s9", 3), rows[1], rows[1]]
    rows += [(503, rows[2][1] * 200, "en", "s2", 1)]
    schema = COLUMNS + "".join(f", `{c}` string" for c in CLASHES)
    docs = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in CLASHES]) for r in rows], schema)
    spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    good, apart, cut, mix, coded = (stage for _, stage in corpus_pipeline.STAGES)
    shape = [f.simpleString() for f in docs.schema]
    for stage in (good, apart, cut, mix):
        found = stage(spark, docs, str(tmp_path))
        assert [f.simpleString() for f in found.schema] == shape
        for r in found.collect():  # extra columns stay with their rows
            assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHES)
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert coded(spark, docs.limit(0), str(tmp_path)).collect() == []
    ids = Counter(r.doc_id for r in apart(spark, docs, str(tmp_path)).collect())
    assert ids[None] == 2 and ids[1] == 1 and {500, 501, 502} <= set(ids)
    texts = {r.doc_id: r.text for r in cut(spark, docs, str(tmp_path)).collect() if r.doc_id in (500, 501, 502)}
    assert texts == {500: None, 501: "", 502: " \t "}
    assert not {500, 501, 502} & {r.doc_id for r in mix(spark, docs, str(tmp_path)).collect()}
    decoded = coded(spark, docs, str(tmp_path))
    assert decoded.count() == len(rows) and decoded.filter("doc_id = 501").first().n_tokens == 0


def test_quality_by_counting(spark):
    """Evidence, sites and posteriors, by plain loops over all rows."""
    rows, labels = documents(9)
    rows += [(900, None, None, "s1", None), (901, "", "fr", None, 0)]
    label = {i: q for i, q, _ in labels}
    half = lambda i: zlib.crc32(str(i).encode()) >> 20 & 1
    b = quality.BUCKETS

    def gram_set(text):
        h = [zlib.crc32(w) for w in (text or "").encode().lower().split()]
        return {x % b for x in h} | {b + ((x * 0x9E3779B1 + y) % 2**64 >> 7) % b for x, y in zip(h, h[1:], strict=False)}

    held, n = {0: Counter(), 1: Counter()}, Counter()
    for r in rows:
        if r[0] in label and not half(r[0]):
            held[label[r[0]]].update(gram_set(r[1]))
            n[label[r[0]]] += 1
    weight = {g: math.log((held[1][g] + 1) / (n[1] + 2)) - math.log((held[0][g] + 1) / (n[0] + 2)) for g in held[0] | held[1]}

    def bins(text):
        raw = (text or "").encode()
        words = raw.lower().split()
        share = lambda k, of: sum(k / max(of, 1) > e for e in quality._SHARE_EDGES)
        some = lambda marks: sum(c in marks for c in raw)
        found = gram_set(text)
        mean = sum(weight.get(g, 0.0) for g in found) / max(len(found), 1)
        repeats = sum(x == y for x, y in zip(words, words[1:], strict=False))
        return [
            share(some(quality._UPPER), len(raw)), share(some(quality._MARKS), len(raw)), share(some(quality._DIGITS), len(raw)), share(some(quality._STOPS), len(words)),
            share(len(set(words)), len(words)), share(repeats, len(words)), len(raw).bit_length(), max(-24, min(24, math.floor(mean * 8))),
        ]

    counts = defaultdict(lambda: [0, 0])
    for r in rows:
        if r[0] in label:
            for m, at in enumerate(bins(r[1])):
                if m < 7 or half(r[0]):
                    counts[m, at][label[r[0]]] += 1

    def odds(m, at):
        own = {k: v for k, v in counts.items() if k[0] == m}
        if (m, at) not in own:
            return 0.0
        rate = lambda q: math.log((own[m, at][q] + 0.5) / (sum(v[q] for v in own.values()) + 0.5 * len(own)))
        return rate(1) - rate(0)

    evidence = [quality.TEMPER * sum(odds(m, at) for m, at in enumerate(bins(r[1]))) for r in rows]
    posterior = lambda e, p: 1 / (1 + math.exp(-(e + math.log(p / (1 - p)))))

    def level(keys, parents):
        sites = defaultdict(list)
        for i, k in enumerate(keys):
            sites[k].append(i)
        size = {k: len(v) for k, v in sites.items()}
        total = {k: sum(posterior(evidence[i], parents[i]) for i in v) for k, v in sites.items()}
        of = {k: parents[v[0]] for k, v in sites.items()}
        between = sum(size[k] * (total[k] / size[k] - of[k]) ** 2 for k in sites)
        within = sum(of[k] * (1 - of[k]) for k in sites)
        spread = sum(size[k] * of[k] * (1 - of[k]) for k in sites)
        strength = 10_000.0 if between <= within else min(10_000.0, max(10.0, 1 / ((between - within) / (spread - within)) - 1))
        return [(of[k] * strength + total[k]) / (strength + size[k]) for k in keys]

    rate = sum(label.values()) / len(label)
    hosts = level([r[3] for r in rows], [rate] * len(rows))
    paths = level([(r[3], r[2]) for r in rows], hosts)
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    found = {r.doc_id: r for r in judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for r, e, h, p in zip(rows, evidence, hosts, paths, strict=True):
        got = found[r[0]]
        want = posterior(e, p)
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in ((got.evidence, e), (got.host_rate, h), (got.path_rate, p), (got.quality, want)))
        assert got.keep == (want >= quality.KEEP_FROM)
