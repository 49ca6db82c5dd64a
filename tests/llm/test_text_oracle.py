"""Text queries with a SQL twin."""

from __future__ import annotations

import os

import duckdb
import pytest

from ripecast.llm import oracle, queries

TESTDATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle.STATEMENTS))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for file in sorted(os.listdir(TESTDATA)):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{TESTDATA}/{file}'")
    want = db.execute(oracle.STATEMENTS[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    expected = sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
    got = queries.QUERIES[name](spark, TESTDATA)
    assert sorted(got.columns) == columns
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == expected
    if name == "op10_url_filter":
        assert 0 < sum(r[columns.index("blocked")] == "True" for r in expected) < len(expected)
