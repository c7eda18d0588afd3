"""The numbered queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

from lodestone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, data, name):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    mine = queries.QUERIES[name](spark, data)
    theirs = con.execute(queries.SQL[name])
    names, cols = [d[0] for d in theirs.description], sorted(mine.columns)
    assert cols == sorted(names)
    flat = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted(tuple(str(flat(row[names.index(c)])) for c in cols) for row in theirs.fetchall())
    assert sorted(tuple(str(flat(row[c])) for c in cols) for row in mine.collect()) == want
