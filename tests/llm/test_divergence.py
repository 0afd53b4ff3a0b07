"""The divergence audit against plain counting, and against its SQL."""

import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from cartoflux.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least, smooth=5, top=50):
    """Of (text, lang, source): the rows of the audit."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    docs = [(TERM.findall(low(t)), lang or "", s or "") for t, lang, s in rows]
    df, n, groups = defaultdict(Counter), defaultdict(Counter), {(lang, s) for _, lang, s in docs}
    for words, lang, s in docs:
        df[lang].update(set(words))
    kept = {lang: {t for t, c in of.items() if c >= least} for lang, of in df.items()}
    for words, lang, s in docs:
        for key in ((lang, s), lang):
            n[key].update(w for w in words if w in kept[lang])
    share = lambda key, lang: {t: 1 + 10**9 * (n[key][t] + smooth) // (sum(n[key].values()) + smooth * len(kept[lang])) for t in kept[lang]}
    out = []
    for lang, s in groups:
        p, q = share((lang, s), lang), share(lang, lang)
        pairs = [(o, sum(abs(p[t] - x) for t, x in share((lang, o), lang).items())) for a, o in groups if a == lang and o != s]
        marked = [(t, p[t] - q[t]) for t in p if n[lang, s][t] > 0 and p[t] > q[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", marked, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, s, part, item, v, rank) for rank, (item, v) in enumerate(found[:most], 1)]
    return sorted(out)


def rows_of(seed, n=160):
    rng = random.Random(seed)
    words = ["the", "The", "été", "x1y", "a-b", "日本", "naïve", "word", "rare", "of", "é", "Ünder"]
    rows = []
    for i in range(n):
        source = rng.choice(["s1", "s2", "s3", "S4", None, ""])
        chosen = words if source != "s2" else words[:5]
        text = rng.choice([" ", ", ", "  ", "\n"]).join(rng.choice(chosen) for _ in range(rng.randrange(14)))
        rows.append((text if i % 17 else None, rng.choice(["de", "fr", None]) if i % 29 else "only", source))
    return rows


def audited(spark, rows, least, **more):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, n int")
    pairs, terms = divergence.audit(docs, least, **more)
    out = [(r["lang"], r["source"], part, r["item"], r["value"], r["rank"]) for part, found in (("pair", pairs), ("term", terms)) for r in found.collect()]
    return sorted(out)


def test_small_tables(spark):
    rows = rows_of(1)
    assert audited(spark, rows, 5) == plain(rows, 5)
    assert audited(spark, rows, 10_000) == plain(rows, 10_000)  # no term is kept: pairs of value 0
    assert audited(spark, [], 1) == []
    assert audited(spark, [(None, None, None), ("", "a", "b")], 1) == []


def test_many_parts_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "AUTOMATON_BYTES", 40)
    monkeypatch.setattr(divergence, "POSTINGS", 20)
    monkeypatch.setattr(divergence, "SOURCES", 2)
    rows = rows_of(2)
    assert audited(spark, rows, 3, top=2) == plain(rows, 3, top=2)


def test_tasks_that_hold_little(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    rows = [("a", "B b c\tC"), ("a", "c d"), ("b", "é É"), ("a", "")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1].encode() for r in rows])], names=["lang", "text"])
    got = Counter()
    for found in divergence._document_counts([batch]):
        for r in found.to_pylist():
            got[r["lang"], r["term"].decode()] += r["docs"]
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 1, ("b", "é"): 1, ("b", "É"): 1}


def test_tiles_by_few_terms_at_a_time(monkeypatch):
    monkeypatch.setattr(divergence, "TERMS", 2)
    rng = np.random.default_rng(3)
    p = rng.integers(1, 9, (4, 7))
    base, names = np.array([2, 3, 1, 5]), ["a", "b", "c", "d"]
    has = rng.random((4, 7)) < 0.5
    rows = [(names[s], None, int(base[s])) for s in range(4)] + [(names[s], f"t{t}", int(p[s, t])) for s in range(4) for t in range(7) if has[s, t]]
    table = pa.table({"source": [r[0] for r in rows], "term": [r[1] for r in rows], "p": [r[2] for r in rows], "block": [0] * len(rows)})
    full = np.where(has, p, base[:, None])
    got = {(r["a"], r["b"]): r["extra"] for r in divergence._tile((pa.scalar("l"), pa.scalar(0), pa.scalar(0), pa.scalar(0)), table).to_pylist()}
    for x in range(4):
        for y in range(x + 1, 4):
            want = int((np.abs(full[x] - full[y]) - abs(base[x] - base[y])).sum())
            assert got.get((names[x], names[y]), 0) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_the_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(divergence.ORACLE_SQL)
    got = divergence.op13_divergence(spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
