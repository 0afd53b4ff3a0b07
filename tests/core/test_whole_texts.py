import duckdb
import pytest

from cartoflux.plans.registry import ORACLE_SQL, QUERIES


def documents(spark, folder):
    """Texts of which the last words stand after character 300."""
    rows = [(i, "the of and " * 40 + f"zebra quagga{i % 3} end. Second part", "en", f"s{i % 2}", 9) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["tfidf_keywords", "ris_roundtrip", "tagged_roundtrip"])
def test_queries_take_whole_texts(spark, tmp_path, name):
    found = QUERIES[name](spark, documents(spark, tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL[name]).fetchall()
    columns = con.sql(ORACLE_SQL[name]).columns
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == sorted(want, key=repr) and "quagga" in repr(want)


def test_labels_take_whole_texts(spark, tmp_path):
    folder = documents(spark, tmp_path)
    assert "Quagga" in repr(QUERIES["top_keywords"](spark, folder).collect())
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    assert "End Second" in repr(QUERIES["semantic_topics"](spark, folder).collect())
