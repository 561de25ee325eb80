"""The catalogue against its SQL twins, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name, tmp_path):
    QUERIES[name](spark, DATA).write.parquet(f"{tmp_path}/out")
    if name not in ORACLES:
        assert spark.read.parquet(f"{tmp_path}/out").count() > 0
        return
    columns = sorted(con.sql(ORACLES[name]).columns)
    assert columns == sorted(spark.read.parquet(f"{tmp_path}/out").columns)
    if not glob.glob(f"{tmp_path}/out/*.parquet"):
        assert con.sql(f"SELECT count(*) FROM ({ORACLES[name]})").fetchall() == [(0,)]
        return
    listed = ", ".join(f'"{c}"' for c in columns)
    a, b = f"SELECT {listed} FROM ({ORACLES[name]})", f"SELECT {listed} FROM '{tmp_path}/out/*.parquet'"
    for x, y in ((a, b), (b, a)):
        assert con.sql(f"({x}) EXCEPT ALL ({y})").fetchall() == []


@pytest.mark.parametrize("name", ["engine_lifecycle", "ingest_documents"])
def test_ingest_of_odd_texts(spark, tmp_path, name):
    """The two words of some texts have the same component with opposite signs."""
    lines = ["er thouat", "Er, er thouat thouat.", "thouat er\n" + "word " * 99, " ".join(["los"] * 50 + ["óñra"] * 50) + " and more", "er thouat er thouat. Another sentence of words.", "!!! ???", "", None, "_", "4"]
    rows = [(10 * n + k, text, "en") for n, text in enumerate(lines) for k in (1, 3, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/in/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/in/documents.parquet/*.parquet'")
    expected = con.sql(ORACLES[name])
    got = QUERIES[name](spark, f"{tmp_path}/in").select(*expected.columns).collect()
    assert sorted(map(tuple, got)) == sorted(expected.fetchall())


@pytest.mark.parametrize("name", ["ingest_documents", "sentences_min4", "sentence_token_counts", "first_two_sentences", "sentence_window_ranks", "chunk_paragraph_lines", "passages_distinct_min32"])
def test_texts_that_end_in_another_line_end(spark, tmp_path, name):
    """U+0085, U+2028 and U+2029 aren't white space here, so what comes before them stays."""
    lines = [f"{start}{white}{end}" for start in ("One two three", "A first sentence of six words. One two three") for white in (" ", "\t\n", "") for end in ("\u0085", "\u2028", "\u2029", "\u0085 ", "\u2028\n", " \r\n")]
    spark.createDataFrame([(n, text, "en") for n, text in enumerate(lines)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/in/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/in/documents.parquet/*.parquet'")
    expected = con.sql(ORACLES[name])
    got = QUERIES[name](spark, f"{tmp_path}/in").select(*expected.columns).collect()
    assert sorted(map(tuple, got)) == sorted(expected.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
