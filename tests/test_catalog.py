import glob
import os

import duckdb
import pytest

from walflow.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=str)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    assert got == sorted(rel.select(", ".join(f'"{c}"' for c in columns)).fetchall(), key=str)
