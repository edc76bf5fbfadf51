"""The queries that SQL can express equal their DuckDB SQL."""

import os

import duckdb
import pytest

from medledger.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels", "embeddings", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda rows: sorted(rows, key=repr)
    place = [want.columns.index(c) for c in columns]
    assert order(tuple(x) for x in got.select(columns).collect()) == order(tuple(r[i] for i in place) for r in want.fetchall())
