"""Every report with a SQL twin, on the smallest data set."""

from __future__ import annotations

import os

import duckdb
import pytest
from conftest import TESTDATA

import __spark_entry__ as contract
from ripecast.plans import catalog, oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in sorted(os.listdir(TESTDATA)):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{TESTDATA}/{file}'")
    yield con
    con.close()


def sorted_rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_matches_sql(spark, db, name):
    got = contract.queries()[name](spark, TESTDATA)
    want = db.execute(contract.oracle_sql()[name])
    want_columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(want_columns)
    expected = sorted_rows(want_columns, want.fetchall())
    assert expected
    assert sorted_rows(got.columns, [tuple(r) for r in got.collect()]) == expected


def test_only_learned_models_lack_sql():
    assert set(catalog.reports()) - set(oracle.statements()) == {"model_save_load"}


def test_entry(spark):
    plan = contract.entry(spark)
    assert plan.columns == [
        "product_id", "product_name", "suggested_reorder_date", "suggested_quantity",
        "current_stock", "reorder_level", "shelf_life_days",
    ]
    assert plan.limit(1).count() == 1
