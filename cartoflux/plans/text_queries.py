"""Queries on bibliographic text: functions, parsers, keywords, topics and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartoflux.functions import text
from cartoflux.functions.settle import settled
from cartoflux.operators import keywords, semantic
from cartoflux.plans import tables as t
from cartoflux.sources import bibliographic as bib
from cartoflux.sources import matrices
from cartoflux.streaming import terms

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"""SELECT page_id, coalesce({STRIP.format(r"regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')")}, '') AS cleaned FROM pages""")
def clean_html(spark, sf):
    return t.read(spark, sf, "pages").select("page_id", text.clean_text(F.col("html")).alias("cleaned"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ' ;' || p_brand || '; ;' || p_type, ';'), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS terms FROM part""")
def split_terms(spark, sf):
    raw = F.concat("p_name", F.lit(" ;"), "p_brand", F.lit("; ;"), "p_type")
    return t.read(spark, sf, "part").select("p_partkey", F.array_join(text.split_terms(raw), "|").alias("terms"))


@query("""SELECT l_orderkey, string_agg(term, '|' ORDER BY first, term) AS terms FROM (SELECT l_orderkey, lower(p_brand) AS term, min(l_linenumber) AS first
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY 1""")
def normalised_terms(spark, sf):
    lines = t.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    joined = lines.join(t.read(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    lists = joined.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_brand"))), lambda s: s.p_brand).alias("raw"))
    return lists.select("l_orderkey", F.array_join(text.normalise_terms(F.col("raw")), "|").alias("terms"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '-') AS label FROM part""")
def title_case(spark, sf):
    return t.read(spark, sf, "part").select("p_partkey", text.title_case(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("label"))


TITLE = "regexp_extract(text, '^[^.]*')"


@query(f"""SELECT doc_id, substr(coalesce({TITLE}, 'Unknown'), 1, 50) || ' (' || CASE WHEN doc_id % 3 = 0 THEN 'N/A' ELSE (1995 + doc_id % 7)::VARCHAR END || ')' AS label FROM documents""")
def row_label(spark, sf):
    year = F.when(F.col("doc_id") % 3 != 0, (1995 + F.col("doc_id") % 7).cast("string"))
    return t.read(spark, sf, "documents").select("doc_id", text.row_label(F.regexp_extract("text", r"^[^.]*", 0), year).alias("label"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '10.1000/X' || o_orderkey WHEN 1 THEN '10.12345/ab.' || o_orderkey || '-c' WHEN 2 THEN '10.1000/(ref)_' || o_orderkey END AS doi FROM orders""")
def doi_extraction(spark, sf):
    o = t.read(spark, sf, "orders")
    key, which = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    given = F.when(which == 0, F.concat(F.lit("10.1000/X"), key))
    body = F.when(which == 1, F.concat(F.lit("see doi:10.12345/ab."), key, F.lit("-c and"))).otherwise(F.lit("nothing"))
    more = F.when(which == 2, F.concat(F.lit("at http://doi.org/10.1000/(ref)_"), key, F.lit(" or 10.1/short"))).otherwise(F.lit("10.12/no"))
    return o.select("o_orderkey", text.first_doi([given], [body, more]).alias("doi"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '10.1/' || o_orderkey WHEN 1 THEN 'PMID_' || o_custkey ELSE 'ID_' || (o_orderkey + 1) END AS id FROM orders""")
def surrogate_ids(spark, sf):
    which = F.col("o_orderkey") % 3
    doi = F.when(which == 0, F.concat(F.lit("10.1/"), F.col("o_orderkey").cast("string"))).otherwise(F.lit(""))
    pmid = F.when(which == 1, F.col("o_custkey").cast("string")).otherwise(F.lit(""))
    return t.read(spark, sf, "orders").select("o_orderkey", text.surrogate_id(doi, pmid, F.col("o_orderkey")).alias("id"))


@query("""SELECT p_partkey, coalesce(nullif(concat_ws(' | ', CASE WHEN p_partkey % 2 = 0 THEN 'Title: ' || p_name END, CASE WHEN p_partkey % 3 = 0 THEN 'Abstract: ' || p_type END,
  CASE WHEN p_partkey % 5 = 0 THEN 'Keywords: ' || p_brand || ', ' || p_type END, CASE WHEN p_partkey % 7 = 0 THEN 'Journal: ' || p_brand END), ''), 'Unknown document content') AS body FROM part""")
def embedding_text(spark, sf):
    part = t.read(spark, sf, "part")
    k = F.col("p_partkey")
    some = lambda n, c: F.when(k % n == 0, c).otherwise(F.lit(""))
    words = F.when(k % 5 == 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>"))
    return part.select("p_partkey", text.embedding_text(some(2, F.col("p_name")), some(3, F.col("p_type")), words, some(7, F.col("p_brand"))).alias("body"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN CASE WHEN p_partkey % 4 = 0 THEN p_type || '|' || p_brand ELSE '' END ELSE p_brand END AS chosen FROM part""")
def keyword_choice(spark, sf):
    which = F.col("p_partkey") % 4
    empty = F.array().cast("array<string>")
    mesh = F.when(which == 0, F.array("p_type", F.lit(""), "p_brand")).otherwise(empty)
    other = F.when(which == 1, F.array("p_name")).otherwise(empty)
    author = F.when(which != 3, F.array("p_brand")).otherwise(empty)
    index = F.array("p_brand")
    return t.read(spark, sf, "part").select("p_partkey", F.array_join(text.choose_keywords(mesh, author, other, index), "|").alias("chosen"))


@query(r"""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN year(o_orderdate) || '///' WHEN 1 THEN 'Mar ' || year(o_orderdate) WHEN 2 THEN 'no date' ELSE year(o_orderdate)::VARCHAR END AS raw FROM orders)
  SELECT o_orderkey, CASE WHEN regexp_extract(raw, '\b((19|20)\d{2})\b', 1) <> '' THEN regexp_extract(raw, '\b((19|20)\d{2})\b', 1) ELSE raw END AS cleaned,
    regexp_full_match(raw, '[0-9]+') AS digits, regexp_full_match(raw, '[0-9]{4}') AS four FROM s""")
def clean_years(spark, sf):
    year, which = F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 4
    raw = F.when(which == 0, F.concat(year, F.lit("///"))).when(which == 1, F.concat(F.lit("Mar "), year)).when(which == 2, F.lit("no date")).otherwise(year)
    rows = t.read(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", text.clean_year(F.col("raw")).alias("cleaned"), text.is_year(F.col("raw")).alias("digits"), text.is_year(F.col("raw"), True).alias("four"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://doi.org/10.1/' || p_partkey WHEN 1 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || p_partkey
  WHEN 2 THEN 'http://x/' || p_partkey ELSE 'https://scholar.google.com/scholar?q=' || replace(p_name, ' ', '+') END AS url FROM part""")
def record_urls(spark, sf):
    key, which = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    doi = F.when(which == 0, F.concat(F.lit("10.1/"), key)).when(which == 1, F.concat(F.lit("PMID_"), key)).when(which == 2, F.concat(F.lit("http://x/"), key)).otherwise(F.lit("none"))
    return t.read(spark, sf, "part").select("p_partkey", text.doi_url(doi, F.col("p_name")).alias("url"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') OR contains(lower(p_brand), 'ring')")
def record_filter(spark, sf):
    part = t.read(spark, sf, "part")
    return part.filter(text.matches_query("RING", F.col("p_name"), F.col("p_type"), F.lit(""), F.array("p_brand"))).select("p_partkey")


# parsers: records rendered as export text, parsed, against the records themselves

SENTENCE = f"trim(regexp_replace(coalesce({TITLE}, ''), '[^a-zA-Z ]', '', 'g'))"


def _titles(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", "lang", "source", F.trim(F.regexp_replace(F.coalesce(F.regexp_extract("text", r"^[^.]*", 0), F.lit("")), "[^a-zA-Z ]", "")).alias("title"))


@query(f"""SELECT doc_id::VARCHAR AS doi, {SENTENCE} AS title, (1990 + doc_id % 30)::VARCHAR AS year, source AS journal, 'JOUR' AS doc_type,
  lang || '|' || source AS keywords, 'A ' || source || '|B ' || lang AS authors FROM documents""")
def ris_roundtrip(spark, sf):
    d = _titles(spark, sf)
    year = (1990 + F.col("doc_id") % 30).cast("string")
    body = F.concat_ws(
        "\n", F.lit("TY  - BOOK"), F.lit("TY  - JOUR"), F.concat(F.lit("TI  - "), "title"), F.lit("T1  - later title"), F.concat(F.lit("PY  - "), year, F.lit("///")), F.concat(F.lit("JO  - "), "source"),
        F.concat(F.lit("AU  - A "), "source"), F.concat(F.lit("AU  - B "), "lang"), F.concat(F.lit("KW  - "), "lang"), F.concat(F.lit("KW  - "), "source"), F.concat(F.lit("DO  - "), F.col("doc_id").cast("string")), F.lit("ER  - "), F.lit(""),
    )
    # fifty records to a file
    numbered = d.select(F.floor(F.col("doc_id") / 50).cast("string").alias("file"), "doc_id", body.alias("body"))
    files = numbered.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "body"))), lambda s: s.body), "\n").alias("whole"))
    found = bib.parse_ris(bib.split_lines(files, "file", "whole"))
    return found.select("doi", "title", "year", "journal", "doc_type", F.array_join("keywords", "|").alias("keywords"), F.array_join("authors", "|").alias("authors"))


@query(f"""SELECT doc_id::VARCHAR AS ut, {SENTENCE} || ' continued' AS title, (1990 + doc_id % 30)::INT AS year, 'a ' || source || '|b ' || lang AS authors,
  lang || '|' || source AS keywords FROM documents""")
def tagged_roundtrip(spark, sf):
    d = _titles(spark, sf)
    year = (1990 + F.col("doc_id") % 30).cast("string")
    two = F.concat_ws(
        "\n", F.lit("PT J"), F.concat(F.lit("AU A "), "source"), F.concat(F.lit("   B "), "lang"), F.concat(F.lit("TI "), "title"), F.lit("   continued"), F.concat(F.lit("DE "), "lang", F.lit("; "), "source"),
        F.concat(F.lit("PY "), year), F.concat(F.lit("UT "), F.col("doc_id").cast("string")), F.lit("ER"), F.lit(""),
    )
    four = F.concat_ws(
        "\n", F.concat(F.lit("UT  - "), F.col("doc_id").cast("string")), F.concat(F.lit("TI  - "), "title"), F.lit("      continued"), F.concat(F.lit("AU  - A "), "source"), F.concat(F.lit("AU  - B "), "lang"),
        F.concat(F.lit("DE  - "), "lang"), F.concat(F.lit("DE  - "), "source"), F.concat(F.lit("DP  - "), year, F.lit(" Mar 4")), F.lit(""),
    )
    # fifty records of a kind to a file
    kind = (F.col("doc_id") % 2).cast("int")
    numbered = d.select(F.concat_ws("-", kind.cast("string"), F.floor(F.col("doc_id") / 100).cast("string")).alias("file"), "doc_id", F.when(kind == 0, two).otherwise(four).alias("body"))
    files = numbered.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "body"))), lambda s: s.body), "\n").alias("whole"))
    found = bib.parse_tagged(bib.split_lines(files, "file", "whole"))
    tags = F.col("tags")
    return found.select(
        F.try_element_at(bib.tag_values(tags, "UT"), F.lit(1)).alias("ut"), F.try_element_at(bib.tag_values(tags, "TI"), F.lit(1)).alias("title"), bib.tagged_year(tags).alias("year"),
        F.array_join(bib.tagged_list(tags, "AU"), "|").alias("authors"), F.array_join(bib.tagged_list(tags, "DE"), "|").alias("keywords"),
    )


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ris' WHEN 1 THEN 'scopus' ELSE 'tagged' END AS kind FROM documents")
def format_detection(spark, sf):
    which = F.col("doc_id") % 3
    raw = F.when(which == 0, F.concat(F.lit("\n \nTY  - JOUR\nTI  - "), "text")).when(which == 1, F.concat(F.lit('﻿"Authors","Title"\n'), "text")).otherwise(F.concat(F.lit("FN x\nPT J\n"), "text"))
    return t.read(spark, sf, "documents").select("doc_id", bib.detect(raw).alias("kind"))


@query("""SELECT p_partkey AS row_id, p_name || ', "x"' AS label, p_size::DOUBLE AS a, CASE WHEN p_partkey % 2 = 0 THEN 0.0 ELSE p_retailprice END::DOUBLE AS b FROM part WHERE p_partkey % 5 <> 0""")
def profile_rows(spark, sf):
    k = F.col("p_partkey")
    label = F.concat(F.lit('"'), "p_name", F.lit(', ""x"""'))
    line = F.concat_ws(",", label, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" kg")), F.when(k % 2 == 0, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string")))
    rows = t.read(spark, sf, "part").select((k + 1).alias("pos"), F.when(k % 5 == 0, F.lit("short,row")).otherwise(line).alias("line"))
    head = spark.createDataFrame([(0, "Name,a,b")], "pos long, line string")
    made, names = matrices.profile_rows(head.unionByName(rows))
    return made.select((F.col("row_id") - 1).alias("row_id"), "label", *[F.col("features")[i].alias(n) for i, n in enumerate(names)])


@query("""SELECT p_partkey AS row_id, p_size::DOUBLE AS a, CASE WHEN p_partkey % 2 = 0 THEN 0.0 ELSE p_retailprice END::DOUBLE AS b FROM part""")
def number_rows(spark, sf):
    k = F.col("p_partkey")
    line = F.concat_ws(";", F.concat(F.lit(" "), F.col("p_size").cast("string")), F.when(k % 2 == 0, F.lit("12 kg")).otherwise(F.concat(F.lit('"'), F.col("p_retailprice").cast("string"), F.lit('"'))))
    rows = t.read(spark, sf, "part").select(k.alias("pos"), line.alias("line"))
    odd = spark.createDataFrame([(-2, "size;price"), (-1, "  ")], "pos long, line string")
    made = matrices.number_rows(odd.unionByName(rows), ";")
    return made.select("row_id", *[F.col("features")[i].alias(n) for i, n in enumerate("ab")])


# keywords, streams and topics

#: What the query leaves out: common English words, which its SQL has to name, and the library's own.
STOP = "a about after all an and any are as at be been but by can for from had has have he her his if in into is it its no not of on or she so that the their them then there they this to was we were what when which who will with you".split() + keywords.DOMAIN_WORDS
STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP)))


@query(rf"""WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2 AND NOT list_contains([{STOPS}], x)) AS k FROM documents),
  g AS (SELECT id, unnest(list_concat(k, list_transform(range(1, greatest(len(k), 1)), lambda i: k[i] || ' ' || k[i + 1]))) AS term FROM w),
  tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
  df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 1000),
  x AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n),
  l AS (SELECT id, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1)
  SELECT term, round(sum(w / norm), 5) AS score FROM x JOIN l USING (id) GROUP BY 1""")
def tfidf_keywords(spark, sf):
    titles = t.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))
    return keywords.term_scores(titles, stop=STOP).withColumn("score", F.round("score", 5))


@query()
def top_keywords(spark, sf):
    """By language; the check against redundant terms is a fold over ranked terms, which has no SQL."""
    titles = t.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), "lang")
    return keywords.top_keywords(titles, 5, by="lang")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, sf):
    found = terms.windowed_counts(t.read(spark, sf, "events"))
    return found.select("start", "event_type", "n", F.round("total", 6).alias("total"))


@query()
def semantic_topics(spark, sf):
    """Text to topics: hashed embeddings, principal axes, clusters and keyword labels."""
    from cartoflux.operators.neighbours import pca

    docs = t.read(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("concatenated_text"))
    points = settled(semantic.embed(docs))
    scores = pca(points, 2).select("id", F.col("scores")[0].alias("x"), F.col("scores")[1].alias("y"))
    placed = settled(semantic.fallback(points).join(scores, "id"))
    titles = docs.select(F.col("row_id").alias("id"), F.col("concatenated_text").alias("title"))
    return semantic.topics(placed, titles, 20, 2)[0].select("path", "level", "label", "size")
