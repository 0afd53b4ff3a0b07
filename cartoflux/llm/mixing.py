"""Mixing sources to target weights (native): after certain whole copies, Pareto order sampling ranks the
documents of a source by random odds over inclusion odds and takes the sample of the size still due.

How often a document is wanted rises with its length: in proportion to the bits of its size in words, so that
long coherent texts fill more of the mix than fragments do. Within a source the wanted copies add up to its
target, and none is above ``MOST_COPIES``; what a document's capped copies leave is shared by the others. The
whole part of the wanted copies is certain, and the rest is the document's own inclusion chance.

The size of a sample is counted in words. A source's documents are taken in rank order as long as the words due are
not passed; where one does not fit, the ranks begin anew among those of the rest that are no longer than what is still
due, ``FILLS`` times in all; at last the shortest left is taken if that brings the sum nearer. Running sums come from
two levels of rank bins that are aggregated before any shuffle, so no task holds a source.

Edge cases: a null text has size 0 and nothing is taken of it; a null source is a source of its own and
sorts last; rows repeated with one doc_id and size are taken together; very long texts are counted whole; an
empty table gives no rows; columns other than doc_id, text and source are ignored by ``mix`` and kept by
``mixed``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartoflux.llm.common import WORD, Staging, documents

WEIGHTS = (5, 2, 1)
#: No source and no document is taken more than so many times.
MOST_COPIES = 3
#: Bins at each of the two levels of the running sums.
BINS = 1024
#: How often what does not fit is passed over.
FILLS = 4


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of all sizes by weight, none above ``most`` times its
    size, the excess reshared. One row for each source: the windows run over that small table.

    In order of cap over weight, a source stops at its cap if the level left by those before lies above.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    every = W.partitionBy(F.lit(1))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    position = F.row_number().over(ordered) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (position % len(weights)) + 1)
    return (
        sources.withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("words_left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", F.col("words_left") / F.col("weight_left") > F.col("ratio"))
        .withColumn("open_words", F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)))
        .withColumn("open_weight", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every))
        .withColumn(
            "target",
            F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
                F.col("open_words").cast("double") * F.col("weight") / F.col("open_weight")
            ),
        )
        .select("source", "source_size", "target")
    )


def _first_open_bin(binned: DataFrame, bin_col: str, due: str, out: str) -> DataFrame:
    """For each source the first bin whose words pass what is due, and the words before that bin."""
    w = W.partitionBy("source", due).orderBy(bin_col).rowsBetween(W.unboundedPreceding, 0)
    return (
        binned.withColumn("upto", F.sum("words").over(w))
        .filter(F.col("upto") > F.col(due))
        .groupBy("source")
        .agg(F.min(bin_col).alias(out), F.min_by(F.col("upto") - F.col("words"), bin_col).alias(f"{out}_before"))
    )


def _sized(docs: DataFrame) -> DataFrame:
    """Adds ``size`` in words and ``u``, a uniform number from the doc_id alone."""
    digits = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13)
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    return sized.withColumn("bits", F.length(F.bin("size")).cast("long")).withColumn("u", (F.conv(digits, 16, 10).cast("double") + 0.5) / 2.0**52)


def with_chances(levels: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """For each (source, bits) of ``levels`` (also words, source_size, target): ``whole`` certain copies, the
    ``chance`` of one more, and ``due``, the words that a source's sample adds to its certain copies.

    As with the targets, in falling order of bits a level is capped if the share left by those before asks
    for ``most`` copies. One row for each level of a source, of which there are at most 64.
    """
    every = W.partitionBy("source")
    before = every.orderBy(F.desc("bits")).rowsBetween(W.unboundedPreceding, -1)
    weight = F.col("words") * F.col("bits")
    return (
        levels.withColumn("weight", weight)
        .withColumn("words_left", F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", (F.col("weight_left") > 0) & (F.expr("words_left * bits / nullif(weight_left, 0)") >= most))
        .withColumn("open_words", F.col("target") - most * F.coalesce(F.sum(F.when(F.col("capped"), F.col("words"))).over(every), F.lit(0)))
        .withColumn("open_weight", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every))
        .withColumn("copies", F.when(F.col("capped"), float(most)).otherwise(F.coalesce(F.expr("open_words * bits / nullif(open_weight, 0)"), F.lit(0.0))))
        .withColumn("whole", F.floor("copies"))
        .withColumn("chance", F.col("copies") - F.col("whole"))
        .withColumn("due", F.col("target") - F.sum(F.col("words") * F.col("whole")).over(every))
        .select("source", "source_size", "target", "bits", "whole", "chance", "due")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes."""
    return _with_copies(docs.select("doc_id", "source", "text"), weights, most, stage_rows=True).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: each document as often as it is taken; documents without a word are not in it."""
    named = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")
    taken = _with_copies(named, weights, most, stage_rows=False).filter("size > 0 AND copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def _with_copies(docs: DataFrame, weights: tuple[int, ...], most: int, stage_rows: bool) -> DataFrame:
    stage = Staging(docs.sparkSession, "mix")
    sized = stage.table(_sized(docs.select("doc_id", "source", "text")).drop("text"), "sized")
    levels = stage.table(sized.groupBy("source", "bits").agg(F.sum("size").alias("words")), "levels")
    sources = with_targets(levels.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most).withColumnRenamed("source", "__source")
    levels = levels.join(sources, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    share = stage.table(with_chances(levels, most), "share").withColumnRenamed("bits", "__bits")

    def per_source(df: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
        side = side.withColumnRenamed("source", "__source")
        return df.join(side, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")

    # Pareto order sampling: random odds over inclusion odds, brought to [0, 1) in the same order
    def rank(rows: DataFrame) -> DataFrame:
        return (
            per_source(rows, share)
            .filter("bits = __bits")
            .drop("__bits")
            .withColumn("rank", F.expr("CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END"))
            .withColumn("v", F.col("rank") / (F.col("rank") + 1))
            .withColumn("bin", F.floor(F.col("v") * (BINS * BINS)))
            .withColumn("hi", F.expr(f"bin div {BINS}"))
        )

    # a row for each document still open: rows repeated with one doc_id and size are one
    keys = ["source", "bin", "hi", "v", "doc_id", "size"]
    open_ = stage.table(rank(sized).filter("chance > 0 AND size > 0").groupBy(*keys, "due").agg(F.sum("size").alias("words")), "open")
    state = stage.table(open_.groupBy("source").agg(F.max("due").alias("due")).withColumn("fills", F.expr(f"cast(array() AS {_FILLS})")), "state")
    for number in range(FILLS):
        left = per_source(open_.drop("due"), state).filter(f"size <= due AND NOT {_TAKEN}")
        ends = _fitting(left, per_source)
        fill = F.array(F.struct("due", "bin_open", "end"))
        filled = stage.table(per_source(state, ends, "left").select("source", "due", F.concat("fills", fill).cast(_FILLS).alias("fills")), f"filled{number}")
        got = per_source(left.drop("due", "fills"), filled).filter(_TAKEN).groupBy("source").agg(F.sum("words").alias("got"))
        state = stage.table(per_source(filled, got, "left").select("source", (F.col("due") - F.coalesce("got", F.lit(0))).alias("due"), "fills"), f"state{number}")
    shortest = per_source(open_.drop("due"), state).filter(f"NOT {_TAKEN}").groupBy("source", "due").agg(F.min(F.struct("size", "v", "doc_id", "words")).alias("last"))
    shortest = shortest.filter("last.words / 2 <= due").select("source", "last")
    ends = stage.table(per_source(state, shortest, "left").select("source", "fills", "last"), "ends")
    taken_once = F.expr(f"coalesce(chance > 0 AND size > 0 AND ({_TAKEN} OR (last IS NOT NULL AND size = last.size AND v = last.v AND doc_id <=> last.doc_id)), false)")
    rows = rank(sized) if stage_rows else rank(_sized(docs))
    return per_source(rows, ends, "left").withColumn("copies", F.col("whole") + F.when(taken_once, 1).otherwise(0))


_FILLS = "array<struct<due:double,bin_open:bigint,end:struct<v:double,doc_id:bigint,size:bigint>>>"
#: Of a document and its source's fills: one of them took it. Where no bin is open, all that was short enough fitted.
_TAKEN = "exists(fills, f -> size <= f.due AND (f.bin_open IS NULL OR bin < f.bin_open OR (bin = f.bin_open AND f.end IS NOT NULL AND struct(v, doc_id, size) <= f.end)))"


def _fitting(left: DataFrame, per_source) -> DataFrame:
    """For each source of which not all documents fit into what is due: the bin of ranks in which they end, and the last
    document that fits, if any does in that bin."""
    first = _first_open_bin(left.groupBy("source", "due", "hi").agg(F.sum("words").alias("words")), "hi", "due", "hi_open")
    second = per_source(left, first).filter("hi = hi_open").withColumn("due2", F.col("due") - F.col("hi_open_before"))
    third = _first_open_bin(second.groupBy("source", "due2", "bin").agg(F.sum("words").alias("words")), "bin", "due2", "bin_open")
    # the documents of the one bin in which the sample ends
    w = W.partitionBy("source").orderBy("v", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    last = per_source(second, third).filter("bin = bin_open").withColumn("upto", F.sum("words").over(w) + F.col("bin_open_before")).filter("upto <= due2")
    last = last.groupBy("source").agg(F.max(F.struct("v", "doc_id", "size")).alias("end"))
    return per_source(third.select("source", "bin_open"), last, "left").select("source", "bin_open", "end")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
      (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u,
      length(bin(size))::BIGINT AS bits FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)]::BIGINT AS weight FROM s0),
s2 AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE AS words_left,
      (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS weight_left FROM s2
      WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, words_left / weight_left > ratio AS capped FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
      (sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0))::DOUBLE * weight
      / (sum(CASE WHEN NOT capped THEN weight END) OVER ())::DOUBLE END AS target FROM s4),
l0 AS (SELECT source, bits, sum(size)::BIGINT AS words FROM sized GROUP BY source, bits),
l1 AS (SELECT l0.*, source_size, target, words * bits AS weight FROM l0 JOIN s5 ON l0.source IS NOT DISTINCT FROM s5.source),
l2 AS (SELECT *, target - 3 * coalesce(sum(words) OVER b, 0)::DOUBLE AS words_left, (sum(weight) OVER e - coalesce(sum(weight) OVER b, 0))::DOUBLE AS weight_left FROM l1
      WINDOW e AS (PARTITION BY source), b AS (PARTITION BY source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l3 AS (SELECT *, weight_left > 0 AND words_left * bits / nullif(weight_left, 0) >= 3 AS capped FROM l2),
l4 AS (SELECT *, target - 3 * coalesce(sum(CASE WHEN capped THEN words END) OVER e, 0)::DOUBLE AS open_words,
      (sum(CASE WHEN NOT capped THEN weight END) OVER e)::DOUBLE AS open_weight FROM l3 WINDOW e AS (PARTITION BY source)),
l5 AS (SELECT *, CASE WHEN capped THEN 3.0::DOUBLE ELSE coalesce(open_words * bits / nullif(open_weight, 0), 0) END AS copies FROM l4),
l6 AS (SELECT source, source_size, target, bits, floor(copies) AS whole, copies - floor(copies) AS chance,
      target - sum(words * floor(copies)) OVER (PARTITION BY source) AS due FROM l5),
d AS (SELECT s.doc_id, s.size, s.u, t.* FROM sized s JOIN l6 t ON s.source IS NOT DISTINCT FROM t.source AND s.bits = t.bits),
v AS (SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank FROM d),
"""

# the fills, one after the other: what is still due, what is short enough, and what of that fits in order of rank
ORACLE_SQL += "w AS (SELECT *, rank / (rank + 1) AS v, chance > 0 AND size > 0 AS open, false AS took0, due AS due1 FROM v),\n"
for _n in range(1, FILLS + 1):
    ORACLE_SQL += f"""a{_n} AS (SELECT *, open AND NOT took{_n - 1} AND size <= due{_n} AS fits FROM {f"f{_n - 1}" if _n > 1 else "w"}),
b{_n} AS (SELECT *, sum(CASE WHEN fits THEN size END) OVER (PARTITION BY source ORDER BY v, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM a{_n}),
f{_n} AS (SELECT * EXCLUDE (fits, upto), took{_n - 1} OR (fits AND upto <= due{_n}) AS took{_n},
  due{_n} - coalesce(sum(CASE WHEN fits AND upto <= due{_n} THEN size END) OVER (PARTITION BY source), 0) AS due{_n + 1} FROM b{_n}),
"""
ORACLE_SQL += f"""s AS (SELECT *, CASE WHEN open AND NOT took{FILLS} THEN row_number() OVER (PARTITION BY source, open AND NOT took{FILLS} ORDER BY size, v, doc_id NULLS FIRST) END AS place,
  sum(size) OVER (PARTITION BY source, v, doc_id, size) AS own FROM f{FILLS}),
e AS (SELECT *, min(CASE WHEN place = 1 THEN struct_pack(size := size, v := v, doc_id := doc_id, own := own) END) OVER (PARTITION BY source) AS last FROM s)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN took{FILLS} OR (place IS NOT NULL AND size = last.size AND v = last.v
  AND doc_id IS NOT DISTINCT FROM last.doc_id AND last.own / 2.0 <= due{FILLS + 1}) THEN 1 ELSE 0 END))::BIGINT AS taken FROM e
"""
