"""Column functions for bibliographic text: trimming, term lists, labels, identifiers and display sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOI = r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)\b"
NOISE = "Ruido"


def strip(col: Column) -> Column:
    """Without white space of any kind at either end (``trim`` knows spaces only)."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def clean_text(col: Column) -> Column:
    """Tags become spaces, runs of white space one space; null becomes empty."""
    return F.coalesce(strip(F.regexp_replace(F.regexp_replace(col, "<[^>]+>", " "), r"\s+", " ")), F.lit(""))


def split_terms(col: Column, sep: str = ";") -> Column:
    """A separated list as lower-case stripped terms without empties; null gives an empty list."""
    terms = F.transform(F.split(F.coalesce(col, F.lit("")), sep), lambda t: F.lower(strip(t)))
    return F.filter(terms, lambda t: t != "")


def normalise_terms(terms: Column) -> Column:
    """Lower-case, stripped, each term once in order of first appearance."""
    kept = F.filter(F.transform(terms, lambda t: F.lower(strip(t))), lambda t: t != "")
    return F.array_distinct(F.coalesce(kept, F.array().cast("array<string>")))


def title_case(col: Column) -> Column:
    """Upper case after every character that is no letter; ``initcap`` does so after spaces only."""
    cut = F.split(F.regexp_replace(F.lower(col), r"(\p{L}+)", "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.transform(cut, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def row_label(title: Column, year: Column, missing: str = "Unknown") -> Column:
    """The first 50 characters of a title with the year in brackets."""
    return F.concat(F.substring(F.coalesce(title, F.lit(missing)), 1, 50), F.lit(" ("), F.coalesce(year, F.lit("N/A")), F.lit(")"))


def first_doi(explicit: list[Column], fields: list[Column]) -> Column:
    """The first explicit identifier that is not empty, else the first found in the fields, in their order."""
    given = [blank_to_null(strip(c)) for c in explicit]
    found = [blank_to_null(F.regexp_extract(F.coalesce(c, F.lit("")), DOI, 1)) for c in fields]
    return F.coalesce(*given, *found, F.lit(None).cast("string"))


def doi_in_tags(tags: Column) -> Column:
    """The first identifier in any value of a map from tag to list of strings."""
    values = F.flatten(F.map_values(tags))
    hits = F.filter(F.transform(values, lambda v: F.regexp_extract(v, DOI, 1)), lambda d: d != "")
    return F.try_element_at(hits, F.lit(1))


def surrogate_id(doi: Column, pmid: Column, position: Column) -> Column:
    """The identifier, else PMID_<pmid>, else ID_<position from 1>; ``position`` counts from 0."""
    return F.coalesce(
        blank_to_null(doi), F.concat(F.lit("PMID_"), blank_to_null(pmid)), F.concat(F.lit("ID_"), (position + 1).cast("string"))
    )


def choose_keywords(mesh: Column, author: Column, other: Column, index: Column, use_mesh: bool = True) -> Column:
    """MeSH headings if asked for and a record has any or other terms; else the first list that is not empty."""
    empty = F.array().cast("array<string>")
    has = lambda c: F.size(F.coalesce(c, empty)) > 0
    plain = F.coalesce(*[F.when(has(c), c) for c in (author, other, index)], empty)
    chosen = F.when(has(mesh) | has(other), F.coalesce(mesh, empty)).otherwise(plain) if use_mesh else plain
    return F.transform(F.filter(chosen, lambda k: k != ""), clean_text)


def embedding_text(title: Column, abstract: Column, keywords: Column, journal: Column) -> Column:
    part = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    whole = F.concat_ws(" | ", part("Title", title), part("Abstract", abstract), part("Keywords", F.array_join(keywords, ", ")), part("Journal", journal))
    return F.coalesce(blank_to_null(whole), F.lit("Unknown document content"))


def _numeric(part: Column) -> Column:
    """Whether a label's part reads as a number; an empty part counts as zero."""
    return F.when(strip(part) == "", True).otherwise(strip(part).rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"))


def parse_label(label: Column) -> Column:
    """struct(entity, time_text, is_temporal) of "<time>_<entity>" or "<entity>_<time>".

    The first part is the time if it is numeric, the last one if only that is; of neither the first is
    taken. One part alone is no temporal label.
    """
    parts = F.split(label, "_")
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    many = F.size(parts) >= 2
    at_end = ~_numeric(first) & _numeric(last)
    return F.struct(
        F.when(~many, label)
        .when(at_end, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "_"))
        .otherwise(F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "_"))
        .alias("entity"),
        F.when(~many, F.lit("")).when(at_end, last).otherwise(first).alias("time_text"),
        many.alias("is_temporal"),
    )


def is_year(col: Column, four_digits: bool = False) -> Column:
    return F.coalesce(col.rlike("^[0-9]{4}$" if four_digits else "^[0-9]+$"), F.lit(False))


def clean_year(col: Column) -> Column:
    """The first year from 1900 to 2099 in a date text; the text itself if it has none."""
    found = F.regexp_extract(col, r"\b((?:19|20)\d{2})\b", 1)
    return F.when(found != "", found).otherwise(col)


def doi_url(doi: Column, fallback: Column) -> Column:
    return (
        F.when(doi.startswith("10."), F.concat(F.lit("https://doi.org/"), doi))
        .when(doi.startswith("PMID_"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.regexp_replace(doi, "^PMID_", "")))
        .when(doi.startswith("http"), doi)
        .otherwise(F.concat(F.lit("https://scholar.google.com/scholar?q="), F.url_encode(fallback)))
    )


def matches_query(query: str, title: Column, abstract: Column, doi: Column, keywords: Column) -> Column:
    """A lower-case substring of any of them."""
    wanted = F.lit(query.lower())
    some = [F.contains(F.lower(F.coalesce(c, F.lit(""))), wanted) for c in (title, abstract, doi)]
    return some[0] | some[1] | some[2] | F.coalesce(F.exists(keywords, lambda k: F.contains(F.lower(k), wanted)), F.lit(False))


def cluster_hue(cluster: Column) -> Column:
    """137.5 degrees further for each cluster; noise has none."""
    return F.when(cluster >= 0, F.pmod(cluster * F.lit(137.5), F.lit(360.0)))


def node_radius(frequency: Column) -> Column:
    return F.least(F.greatest(F.sqrt(frequency) * 3 + 4, F.lit(6.0)), F.lit(30.0))


def link_width(weight: Column) -> Column:
    return F.least(F.greatest(F.sqrt(weight) * 1.5, F.lit(1.0)), F.lit(6.0))
