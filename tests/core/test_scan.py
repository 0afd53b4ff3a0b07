"""Files read by byte ranges against the same files read whole."""

import random

import pytest
from pyspark.sql import functions as F

from cartoflux.operators import semantic
from cartoflux.sources import bibliographic as bib
from cartoflux.sources import matrices
from cartoflux.sources.scan import counted_before, lines, ranked


@pytest.fixture
def cut(spark):
    """Splits of some hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k in keys:
        spark.conf.unset(k)


def whole(spark, path):
    """All lines of a file in one row, as one block."""
    return bib.split_lines(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"), "file", "value")


def plain(df):
    return sorted(repr(tuple(r)[1:]) for r in df.collect())  # without the file


def ris(n, end, rng):
    out = []
    for i in range(n):
        out += [f"TY  - T{i}", f"TI  - Title {i}", *[f"KW  - k{rng.randrange(9)}" for _ in range(rng.randrange(12))], "", f"AU  - A{i}", f"PY  - {1990 + i % 30}/x"]
        out += [rng.choice(["ER  - ", "ER  -", "  ER - ", "ERRATA"])]
    return end.join(out)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_ris(cut, tmp_path, end):
    path = str(tmp_path / "a.ris")
    open(path, "w", newline="").write(ris(120, end, random.Random(1)))
    read = lines(cut, path)
    assert read.rdd.getNumPartitions() > 5 and read.filter("line <> ''").select("block").distinct().count() > 5
    for strict in (False, True):
        got = plain(bib.parse_ris(read, strict))
        assert got == plain(bib.parse_ris(whole(cut, path), strict)) and len(got) > 60
    assert bib.detect_file(cut, path) == "ris"


@pytest.mark.parametrize("kind", ["two", "four"])
def test_tagged(cut, tmp_path, kind):
    rng, out = random.Random(2), []
    for i in range(90):
        authors, rest = [f"Author {i}-{j}" for j in range(rng.randrange(1, 30))], f"Title of {i} that goes"
        if kind == "two":
            out += ["PT J", f"AU {authors[0]}", *[f"   {a}" for a in authors[1:]], f"TI {rest}", "   on", f"UT {i}", "ER", ""]
        else:
            out += [f"PMID- {i}", f"TI  - {rest}", "      on", *[f"AU  - {a}" for a in authors], ""]
    path = str(tmp_path / "b.txt")
    open(path, "w").write("\n".join(out))
    entries = lambda df: df.select("file", "rec", F.sort_array(F.map_entries("tags")))
    got, want = bib.parse_tagged(lines(cut, path)), bib.parse_tagged(whole(cut, path))
    assert plain(entries(got)) == plain(entries(want)) and got.count() == 90
    assert lines(cut, path).rdd.getNumPartitions() > 5
    numbers = sorted(r["row_id"] for r in semantic.semantic_records(got).collect())
    assert numbers == list(range(90))


def test_matrices(cut, tmp_path):
    path = str(tmp_path / "c.csv")
    rows = [f"row {i},{i / 4},{-i}kg" for i in range(400)]
    open(path, "w").write("\n".join(["name,a,b", *rows[:200], "", *rows[200:]]) + "\n")
    assert lines(cut, path).rdd.getNumPartitions() > 5
    made, names = matrices.read_profile(cut, path)
    got = made.orderBy("row_id").collect()
    assert names == ["a", "b"] and [r["label"] for r in got] == [f"row {i}" for i in range(400)] and [r["features"] for r in got] == [[i / 4, -float(i)] for i in range(400)]
    assert [r["row_id"] for r in got] == [*range(1, 201), *range(202, 402)]
    numbers = str(tmp_path / "d.csv")
    open(numbers, "w").write("x;y\n" + "\n".join(f"{i};{i * 2}" for i in range(500)))
    found = matrices.read_numbers(cut, numbers, ";").orderBy("row_id").collect()
    assert [r["features"] for r in found] == [[float(i), 2.0 * i] for i in range(500)] and found[0]["row_id"] == 1


def test_counts_before(cut, tmp_path):
    for name in ("x", "y"):
        (tmp_path / name).write_text("\n".join(f"{name}{i}" for i in range(300)))
    got = counted_before(lines(cut, f"{tmp_path}/*"), F.col("line").endswith("7"), "n").collect()
    assert len(got) == 600 and all(r["n"] == sum(str(i).endswith("7") for i in range(int(r["line"][1:]))) for r in got)
    assert len({(r["file"], r["block"]) for r in got}) == 4


def test_ranks_of_records(spark, monkeypatch):
    monkeypatch.setattr("cartoflux.sources.scan.RUN", 5)
    rows = [(f, n) for f in "ab" for n in range(0, 60, 3 if f == "a" else 7)]
    got = ranked(spark.createDataFrame(rows, "file string, rec long"), "rec", "at").collect()
    assert all(r["at"] == r["rec"] // (3 if r["file"] == "a" else 7) for r in got)


def test_formats_far_down_the_file(cut, tmp_path):
    texts = {"ris": "\n" * 3000 + " \n  TY  - JOUR\n", "scopus": "﻿" + ",".join(f"c{i}" for i in range(2000)) + ",Authors,Title\nx\n", "tagged": " \n\nPT J\n", "blank": "\n \n"}
    for name, body in texts.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
        assert bib.detect_file(cut, str(tmp_path / name)) == ("tagged" if name == "blank" else name)
    (tmp_path / "none").write_text("")
    assert bib.detect_file(cut, str(tmp_path / "none")) == "tagged"
