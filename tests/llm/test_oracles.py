"""Queries against their SQL twins, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name, tmp_path):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    QUERIES[name](spark, DATA).write.parquet(f"{tmp_path}/out")
    columns = ", ".join(f'"{c}"' for c in sorted(con.sql(ORACLES[name]).columns))
    a, b = f"SELECT {columns} FROM ({ORACLES[name]})", f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'"
    for x, y in ((a, b), (b, a)):
        assert con.sql(f"({x}) EXCEPT ALL ({y})").fetchall() == []


def test_every_operator_has_a_query():
    assert [f"op{n}" for n in range(1, 11)] == sorted((q.split("_")[0] for q in QUERIES if q.startswith("op")), key=lambda q: int(q[2:])) and "pipeline" in QUERIES
