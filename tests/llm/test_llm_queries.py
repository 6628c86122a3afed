"""The queries that SQL can express, or some columns of, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from strandweave.llm import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows(spark, name):
    oracle = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        oracle.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    cursor = oracle.execute(Q.SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(str(r[names.index(c)]) for c in cols) for r in cursor.fetchall()) and got
