"""URL filters (native): a blocked Bloom filter of the listed canonical URLs lets possible hits through
to an exact hash join, which removes the false positives.

Edge cases: a null url or one without ``://`` has an empty host and an empty path and fits no rule; rules
with a null or empty host are ignored; very long urls are judged whole; rows repeated are judged each; a rule listed twice counts once; of two rules of one length the
one with the longer host wins, then the smaller rule text (a text with two verdicts: block); extra
columns of the pages are not returned; an empty page or rule table gives no rows or no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoflux.llm.common import ascii_lower

#: Up to so many rules (some 10 MB) the filter and the rules are broadcast; beyond, both joins shuffle.
BROADCAST_RULES = 50_000
#: Bits of the filter for each rule, in blocks of four longs.
BITS_PER_RULE, BLOCK_BITS = 16, 256

#: The rules of the query: (rule, host, path, verdict).
RULES = [
    ("net/", "net", "/", "block"),
    ("example.net/en/", "example.net", "/en/", "allow"),
    ("example.com/de/", "example.com", "/de/", "block"),
    ("org/fr/", "org", "/fr/", "allow"),
]


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    rest = F.expr("CASE WHEN instr(__url, '://') > 0 THEN substring(__url, instr(__url, '://') + 3) END")
    return (
        pages.withColumn("__url", F.col(url))
        .withColumn("__rest", rest)
        .withColumn("host", F.coalesce(ascii_lower(F.regexp_extract("__rest", r"^[^/?#]*", 0)), F.lit("")))
        .withColumn("path", F.coalesce(F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1), F.lit("")))
        .drop("__url", "__rest")
    )


def _bits() -> list[Column]:
    """Two bits in each of the four longs of a key's block."""
    bit = lambda i: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(__h2, {6 * i}) & 63 as int))")
    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(4)]


def _hashed(df: DataFrame, key: str, blocks: int) -> DataFrame:
    return df.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(blocks))).withColumn("__h2", F.xxhash64(F.col(key), F.lit(1)))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judges every page: ``page_id, host, path, rule, verdict``; ``default`` where no rule fits.

    A rule's key is its host and its path up to the last slash; a url's keys are its host's suffixes at
    label borders joined to its path's prefixes at slashes, no deeper than the deepest rule.
    """
    listed = (
        rules.filter(F.coalesce(F.col("host"), F.lit("")) != "")
        .select("rule", "host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("rule", "host", "path")
        .agg(F.max("verdict").alias("verdict"))  # of two verdicts, block
        .withColumn("key_path", F.regexp_extract("path", r"^(.*/)?", 0))
        .withColumn("key", F.concat("host", "key_path"))
        .withColumn("labels", F.size(F.split("host", r"\.")))
        .withColumn("slashes", F.size(F.split("key_path", "/")) - 1)
    )
    shape = listed.agg(F.count("*"), F.max("labels"), F.max("slashes")).first()
    count, labels, slashes = shape[0], shape[1] or 0, shape[2] or 0
    blocks = max(1, -(-count * BITS_PER_RULE // BLOCK_BITS))
    small = (lambda df: F.broadcast(df)) if count <= BROADCAST_RULES else (lambda df: df)

    words = ["w0", "w1", "w2", "w3"]
    bloom = (
        _hashed(listed.select("key").distinct(), "key", blocks)
        .select("__block", *[b.alias(w) for b, w in zip(_bits(), words, strict=True)])
        .groupBy("__block")
        .agg(*[F.bit_or(w).alias(w) for w in words])
    )

    judged = with_host_and_path(pages).select("page_id", "host", "path")
    hosts = F.expr(
        f"transform(sequence(1, least(size(split(host, '[.]')), {max(labels, 1)})), k -> array_join(slice(split(host, '[.]'), -k, k), '.'))"
    )
    paths = F.expr(
        f"transform(sequence(0, least(size(split(path, '/')) - 1, {slashes})), "
        "k -> CASE WHEN k = 0 THEN '' ELSE concat(array_join(slice(split(path, '/'), 1, k), '/'), '/') END)"
    )
    keys = (
        judged.select("host", "path", hosts.alias("hosts"), paths.alias("paths"))
        .select("host", "path", F.explode(F.expr("flatten(transform(hosts, h -> transform(paths, p -> concat(h, p))))")).alias("key"))
    )
    possible = (
        _hashed(keys, "key", blocks)
        .select("host", "path", "key", "__block", *[b.alias(f"k{w}") for b, w in zip(_bits(), words, strict=True)])
        .join(small(bloom), "__block")
        .filter(" AND ".join(f"({w} & k{w}) = k{w}" for w in words))
        .select("host", "path", "key")
    )
    exact = listed.select("key", "rule", "verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    best = (
        possible.join(small(exact), "key")
        .filter(F.expr("startswith(path, rule_path)"))
        .groupBy("host", "path")
        .agg(
            F.expr(
                "min_by(struct(rule, verdict), struct(-(length(rule_host) + length(rule_path)), -length(rule_host), rule, verdict = 'allow'))"
            ).alias("best")
        )
    )
    return judged.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, host string, path string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE_SQL = r"""
WITH rules(rule, rhost, rpath, rverdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
     ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
     coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
fits AS (SELECT host, path, rule, rverdict,
     row_number() OVER (PARTITION BY host, path ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC, rule) AS rn
     FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rverdict, 'allow') AS verdict
FROM parts p LEFT JOIN (SELECT * FROM fits WHERE rn = 1) f ON p.host = f.host AND p.path = f.path
"""
