"""How far the sources of a language diverge in the words they use.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. The first pass finds in how many
documents of its language each term stands; those of at least ``least`` documents are kept. The second pass lays an
Aho-Corasick automaton of the kept terms, each padded by a delimiter on both sides, over every text and counts their
occurrences by language and source. The counts are postings (term, source, count), only where there are any; with
what a source gives a term it does not have, they make up all pairs of sources and the terms that stand out.

p = 1 + floor(10^9 (count + s) / (N + s V)), with s the smoothing, N the counts' sum and V the kept terms. Sums and
quotients are of whole numbers, so exact.

Edge cases: a null text, language or source counts as ''; rows repeated are counted each; groups without terms stay,
with the p of no counts; a language without kept terms has pairs of value 0 and no terms; very long texts are
worked through whole; an empty table gives no rows; columns other than text, lang and source are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartoflux.llm.common import Staging, documents

LEAST, SMOOTH, TOP, SCALE = 30, 5, 50, 1_000_000_000
#: Counts that a task holds before it passes them on.
HELD = 400_000
#: Bytes of the kept terms in one automaton, which every worker holds (about twelve times these bytes); a larger
#: vocabulary takes more scans.
AUTOMATON_BYTES = 4 << 20
#: Postings and sources of one tile of pairs, and terms that are compared at a time.
POSTINGS, SOURCES, TERMS = 50_000, 256, 2048

#: Letters to lower case, other ASCII to spaces; bytes beyond ASCII stay.
_FOLD = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, docs) of (lang, text), added up as far as a task can hold them."""
    found: dict[str, Counter] = defaultdict(Counter)
    held = 0

    def told() -> pa.RecordBatch:
        columns = [[x for lang, c in found.items() for x in [lang] * len(c)], [t for c in found.values() for t in c], [n for c in found.values() for n in c.values()]]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["lang", "term", "docs"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            of, before = found[lang], len(found[lang])
            of.update(set(text.as_py().translate(_FOLD).split()))
            held += len(of) - before
            if held >= HELD:
                yield told()
                held = 0
    yield told()


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term): terms that stand in at least so many of the language's documents."""
    counted = docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(_document_counts, "lang string, term binary, docs long")
    return counted.groupBy("lang", F.col("term").cast("string").alias("term")).agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "term")


def automaton(terms: list[bytes]) -> ahocorasick.Automaton:
    """Finds each term between two delimiters; its value is its place in the list."""
    made = ahocorasick.Automaton()
    for at, term in enumerate(terms):
        made.add_word(f" {term.decode('latin-1')} ", at)  # bytes as characters
    made.make_automaton()
    return made


#: The automata of one broadcast vocabulary, kept by a worker process for the tasks to come.
_AUTOMATA: dict[str, dict[str, ahocorasick.Automaton]] = {}


def _occurrences(shared, name: str):
    """(lang, source, at, n) of (lang, source, text): packed counts by the terms' places in their language's list, added
    up as far as a task can hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[name] = {lang: automaton(of) for lang, of in shared.value.items()}
        automata, found, held = _AUTOMATA[name], defaultdict(Counter), 0

        def told() -> pa.RecordBatch:
            sizes = np.cumsum([0, *map(len, found.values())]).astype(np.int32)
            at = np.fromiter((k for c in found.values() for k in c), np.int32, sizes[-1])
            n = np.fromiter((v for c in found.values() for v in c.values()), np.int64, sizes[-1])
            groups = list(found)
            found.clear()
            packed = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(v)) for v in (at, n)]
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string()), *packed], names=["lang", "source", "at", "n"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if lang in automata:
                    padded = f" {text.as_py().translate(_FOLD).decode('latin-1')} "
                    of, before = found[lang, source], len(found[lang, source])
                    of.update(at for _, at in automata[lang].iter(padded))
                    held += len(of) - before
                    if held >= HELD:
                        yield told()
                        held = 0
        yield told()

    return run


def _named(shared):
    """(lang, source, term, n) of (lang, source, at, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = {lang: pa.array(of, pa.binary()) for lang, of in shared.value.items()}
        for batch in batches:
            for lang in set(batch.column(0).to_pylist()):
                own = batch.filter(pc.equal(batch.column(0), lang))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), terms[lang].take(own.column(2)), own.column(3)], names=["lang", "source", "term", "n"])

    return run


def occurrences(docs: DataFrame, kept: DataFrame, stage: Staging) -> DataFrame:
    """(lang, source, term, n), n > 0: how often each kept term stands in a source's texts.

    The kept terms are broadcast, at most some AUTOMATON_BYTES at a time; each such part takes a scan of the texts.
    """
    spark = docs.sparkSession
    size = kept.agg(F.sum(F.octet_length("term") + 2)).first()[0] or 0
    parts, tables = -(-size // AUTOMATON_BYTES), []
    texts = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    for part in range(parts):
        terms = defaultdict(list)
        for r in kept.filter(F.pmod(F.xxhash64("lang", "term"), F.lit(parts)) == part).collect():  # about AUTOMATON_BYTES
            terms[r["lang"]].append(r["term"].encode())
        shared = spark.sparkContext.broadcast(dict(terms))
        counted = texts.mapInArrow(_occurrences(shared, f"{stage.root}/{part}"), "lang string, source string, at array<int>, n array<long>")
        counted = counted.select("lang", "source", F.explode(F.arrays_zip("at", "n")).alias("of")).select("lang", "source", "of.at", "of.n")
        summed = counted.groupBy("lang", "source", "at").agg(F.sum("n").alias("n"))
        named = summed.mapInArrow(_named(shared), "lang string, source string, term binary, n long").withColumn("term", F.col("term").cast("string"))
        tables.append(stage.table(named, f"counts{part}"))
        shared.destroy()
    return reduce(DataFrame.union, tables) if tables else spark.createDataFrame([], "lang string, source string, term string, n long")


def _share(n: Column, total: Column, terms: Column, smooth: int) -> Column:
    """p, exact: the quotient of decimals is taken whole."""
    whole = lambda c: c.cast("decimal(20,0)")
    parts = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(n + smooth), whole(total + smooth * terms))
    return F.when(terms > 0, 1 + parts)


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """Of a tile's sources (rows without a term: their p of no counts) and postings: for each pair of sources, the sum
    over the tile's terms of |p - q|, less that of terms that neither has."""
    i, j = key[2].as_py(), key[3].as_py()
    blank = np.array([t is None for t in rows.column("term").to_pylist()])
    source, block, p = np.array(rows.column("source").to_pylist(), object), rows.column("block").to_numpy(), rows.column("p").to_numpy()
    sides = []
    for b in (i, j):
        at = np.flatnonzero(blank & (block == b))
        at = at[np.argsort(source[at])]
        sides.append((source[at], p[at], {s: x for x, s in enumerate(source[at])}))
    number: dict[str, int] = {}
    posted = np.flatnonzero(~blank)
    term = np.array([number.setdefault(t, len(number)) for t in rows.column("term").take(pa.array(posted)).to_pylist()], np.int64)
    (left, base, _), (right, other, _) = sides
    extra = np.zeros((len(left), len(right)), np.int64)
    for first in range(0, len(number), TERMS):
        width = min(TERMS, len(number) - first)
        here = posted[(term >= first) & (term < first + width)]
        column = term[(term >= first) & (term < first + width)] - first
        shares = []
        for b, (_, ground, place) in zip((i, j), sides, strict=True):
            filled = np.repeat(ground[:, None], width, axis=1)
            mine = block[here] == b
            filled[[place[s] for s in source[here[mine]]], column[mine]] = p[here[mine]]
            shares.append(filled)
        for x, row in enumerate(shares[0]):
            extra[x] += np.abs(row - shares[1]).sum(axis=1) - width * np.abs(base[x] - other)
    a, b = np.nonzero(extra if i != j else np.triu(extra, 1))
    a_name, b_name = left[a].tolist(), right[b].tolist()
    return pa.table([pa.array([key[0].as_py()] * len(a), pa.string()), pa.array(a_name, pa.string()), pa.array(b_name, pa.string()), pa.array(extra[a, b])], names=["lang", "a", "b", "extra"])


def _pair_sums(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, extra): what the postings add to |p - q| of sources without any, both ways round."""
    spread = max(1, -(-postings.count() // POSTINGS))
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // SOURCES))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    bare = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("bucket"))
    posted = postings.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.lit(spread)).cast("int").alias("bucket"))
    rows = bare.union(posted).withColumn("block", block)
    tiled = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("to"))
    tiled = tiled.select("lang", "bucket", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), "block", "source", "term", "p")
    sums = tiled.groupBy("lang", "bucket", "i", "j").applyInArrow(_tile, "lang string, a string, b string, extra long")
    sums = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("of"), "extra")
    return sums.groupBy("lang", "of.source", "of.item").agg(F.sum("extra").alias("extra"))


def audit(docs: DataFrame, least: int = LEAST, smooth: int = SMOOTH, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """Pairs (lang, source, item, value, rank), item being each other source of the language and value the sum of
    |p - q| over its kept terms; and terms (the same columns), the top ones whose p is above the language's."""
    spark = docs.sparkSession
    stage = Staging(spark, "divergence")
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = stage.table(vocabulary(read, least), "kept")
    counts = occurrences(read, kept, stage)
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "terms"])
    groups = stage.table(groups.withColumn("base", F.coalesce(_share(F.lit(0), F.col("total"), F.col("terms"), smooth), F.lit(0))), "groups")
    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("terms"), smooth).alias("p"))

    sums = _pair_sums(shares, groups)
    others = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other"))
    pairs = groups.join(others, "lang").filter(F.col("source") != F.col("item")).join(sums, ["lang", "source", "item"], "left")
    bare = F.col("terms") * F.abs(F.col("base") - F.col("other"))
    pairs = pairs.select("lang", "source", "item", (bare + F.coalesce("extra", F.lit(0))).alias("value"))

    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    usual = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(whole, "lang").select("lang", "term", _share(F.col("n"), F.col("total"), F.col("terms"), smooth).alias("q"))
    marked = shares.join(usual, ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank), marked.withColumn("rank", rank).filter(F.col("rank") <= top)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = zip(("pair", "term"), audit(documents(spark, sf_dir)), strict=True)
    return reduce(DataFrame.union, [rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, rows in parts])


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
  w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  kept AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 30),
  v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
  n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
  g AS (SELECT DISTINCT lang, source FROM d),
  full_n AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
  p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM full_n JOIN v USING (lang)),
  ln AS (SELECT lang, term, sum(n) AS n FROM full_n GROUP BY 1, 2),
  q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM ln JOIN v USING (lang)),
  f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
  part AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM part)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
