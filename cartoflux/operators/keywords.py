"""Keywords of titles by TF-IDF over single words and pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartoflux.functions.text import title_case
from cartoflux.llm.common import Staging

#: Words of no use in keywords, Spanish ones and those of any paper.
DOMAIN_WORDS = (
    "el la los las un una unos unas y o en de del al a ante bajo cabe con contra desde durante entre hacia hasta mediante para por según sin so sobre tras que "
    "es se su sus como más pero este esta estos estas son fue lo ya muy también nos sí qué cuando donde quien porque estudio análisis efecto uso study analysis "
    "effect use based artículo investigación research paper results resultados diseño desarrollo"
).split()


def stop_words() -> list[str]:
    """The English list that Spark itself brings, and ``DOMAIN_WORDS``."""
    return [*StopWordsRemover.loadDefaultStopWords("english"), *DOMAIN_WORDS]


def words(title: Column, stop: Sequence[str]) -> Column:
    """Lower-case words of two characters or more, without stop words."""
    found = F.split(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.filter(found, lambda w: (F.length(w) >= 2) & ~w.isin(*sorted(set(stop))))


def neighbours(kept: Column) -> Column:
    """Pairs (first, second) of neighbours, after stop words have gone."""
    n = F.greatest(F.size(kept) - 1, F.lit(0))
    return F.arrays_zip(F.slice(kept, F.lit(1), n).alias("first"), F.slice(kept, F.lit(2), n).alias("second"))


#: Up to so many words or terms their list is broadcast; beyond it is joined.
BROADCAST_TERMS = 200_000


def term_scores(titles: DataFrame, by: str | None = None, most: int = 1000, stop: Sequence[str] | None = None) -> DataFrame:
    """([by,] term, score): summed TF-IDF of titles (id, title), each title's weights scaled to length 1. Words of
    ``stop`` (``stop_words`` unless given) are left out.

    idf = ln((1 + n) / (1 + df)) + 1; the vocabulary is the ``most`` terms of highest count, ties by term.

    Terms of the vocabulary go by their place in it, and every table that is as large as the titles is dropped, with
    the shuffle files that made it, once the next one is written.
    """
    keys = [by] if by else []
    stage = Staging(titles.sparkSession, "terms")
    settled = stage.table
    kept = settled(titles.select(*keys, "id", words(F.col("title"), stop_words() if stop is None else stop).alias("kept")), "kept")
    own = kept.select(*keys, "id", F.explode("kept").alias("term"))
    pairs = kept.select(*keys, "id", F.explode(neighbours(F.col("kept"))).alias("pair")).select(*keys, "id", "pair.first", "pair.second")
    place = F.row_number().over(W.partitionBy(*keys or [F.lit(1)]).orderBy(F.desc("total"), "term"))
    small = lambda rows: F.broadcast(rows) if rows.count() <= BROADCAST_TERMS else rows
    # the vocabulary first, from counts that are added up before their shuffle: only its terms are then followed by title.
    # No pair occurs more often than its words, so a pair of a word that is rarer than ``most`` words are is none of it
    singles = settled(own.groupBy(*keys, "term").agg(F.count("*").alias("total")), "singles")
    last = singles.withColumn("rn", place).filter(F.col("rn") == most).select(*keys, F.col("total").alias("least"))
    known = singles.join(last, keys, "left") if keys else singles.join(F.broadcast(last), F.lit(True), "left")
    common = small(settled(known.filter(F.col("total") >= F.coalesce("least", F.lit(0))).select(*keys, "term"), "common"))
    for side in ("first", "second"):
        pairs = pairs.join(common.withColumnRenamed("term", side), [*keys, side], "left_semi")
    term = F.concat_ws(" ", "first", "second").alias("term")
    totals = singles.unionByName(pairs.groupBy(*keys, "first", "second").agg(F.count("*").alias("total")).select(*keys, term, "total"))
    ranked = small(settled(totals.withColumn("place", place.cast("int")).filter(F.col("place") <= most).select(*keys, "term", "place"), "ranked"))
    terms = own.unionByName(pairs.select(*keys, "id", term))
    tf = settled(terms.filter("id IS NOT NULL").join(ranked, [*keys, "term"]).groupBy(*keys, "id", "place").agg(F.count("*").alias("tf")), "tf")
    sizes = settled(kept.groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    stage.drop("kept", "singles", "common")
    df = tf.groupBy(*keys, "place").agg(F.count("*").alias("df"))
    df = (df.join(sizes, keys) if keys else df.join(F.broadcast(sizes), F.lit(True))).withColumn("idf", F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    df = small(settled(df.select(*keys, "place", "idf"), "df"))
    weighted = tf.join(df, [*keys, "place"]).withColumn("w", F.col("tf") * F.col("idf"))
    whole = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*keys, "id")))
    scores = settled(weighted.withColumn("norm", whole).groupBy(*keys, "place").agg(F.sum(F.col("w") / F.col("norm")).alias("score")), "scores")
    stage.drop("tf")
    return scores.join(ranked, [*keys, "place"]).select(*keys, "term", "score")


def top_keywords(titles: DataFrame, k: int = 5, by: str | None = None, strict: bool = True, looked_at: int = 200, stop: Sequence[str] | None = None) -> DataFrame:
    """([by,] keywords): the k best terms of four characters or more, title-cased, by falling score, ties by term.

    ``strict`` skips a term that contains, or is within, one taken already; otherwise this check compares it
    with the title-cased ones, as the original does, and hardly ever fires.
    """
    keys = [by] if by else []
    scored = term_scores(titles, by, stop=stop).filter(F.length("term") > 3)
    w = W.partitionBy(*keys or [F.lit(1)]).orderBy(F.desc(F.round("score", 9)), "term")
    best = scored.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= looked_at)
    listed = best.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "term"))), lambda s: s["term"]).alias("terms"))

    def take(taken: Column, term: Column) -> Column:
        against = (lambda t: t) if strict else title_case
        clash = F.exists(taken, lambda t: F.contains(against(t), term) | F.contains(term, against(t)))
        return F.when((F.size(taken) < k) & ~clash, F.concat(taken, F.array(term))).otherwise(taken)

    chosen = F.aggregate("terms", F.array().cast("array<string>"), take)
    return listed.select(*keys, F.transform(chosen, title_case).alias("keywords"))
