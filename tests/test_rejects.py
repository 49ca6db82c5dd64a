"""Rejected rows with their reasons; accepted and rejected together are what was read."""

from __future__ import annotations

import pytest
from conftest import rows

from ripecast.sources import contracts, rejects

COLUMNS = "date string, product_id string, product_name string, category string, quantity_sold string, unit_price string, revenue string, profit string"
GOOD = ("2024-01-05", "A", "Mangues", "Fruits", "3", "10.50", "31.50", "6.25")


def changed(**values):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return tuple(values.get(n, v) for n, v in zip(names, GOOD, strict=True))


CASES = [
    ({}, []), ({"date": "05/01/2024"}, [("date", "not a date")]), ({"date": "2024-02-30"}, [("date", "not a date")]),
    ({"date": None}, [("date", "missing")]), ({"product_id": "  "}, [("product_id", "missing")]),
    ({"quantity_sold": "3x"}, [("quantity_sold", "not a number")]), ({"quantity_sold": "2.5"}, [("quantity_sold", "not a whole number")]),
    ({"quantity_sold": "-1"}, [("quantity_sold", "negative")]), ({"quantity_sold": ""}, [("quantity_sold", "missing")]),
    ({"quantity_sold": "99999999999999999999"}, [("quantity_sold", "out of range")]), ({"quantity_sold": " 4 "}, []),
    ({"unit_price": "12345678901.5"}, [("unit_price", "out of range")]), ({"unit_price": "NaN"}, [("unit_price", "not a number")]),
    ({"unit_price": None}, []), ({"unit_price": " "}, []), ({"profit": "-4.5"}, []), ({"category": None}, []),
    ({"date": "x", "revenue": "y", "quantity_sold": None}, [("date", "not a date"), ("quantity_sold", "missing"), ("revenue", "not a number")]),
]


@pytest.mark.parametrize("values, reasons", CASES)
def test_reasons(spark, values, reasons):
    got = rejects.sort_out(spark.createDataFrame([changed(**values)], COLUMNS))
    assert sorted((r["column"], r["reason"]) for r in rows(got.rejected)) == sorted(reasons)
    assert tuple(got.counts().first()) == (1, int(not reasons), int(bool(reasons)))
    if not reasons:
        assert contracts.canonical_sales(got.accepted).count() == 1


def test_accepted_and_rejected_are_what_was_read(spark):
    table = spark.createDataFrame([changed(**v) for v, _ in CASES] * 3, COLUMNS).selectExpr("*", "'k' AS problems", "'k' AS row", "'k' AS `my.note`")
    got = rejects.sort_out(table.repartition(4))
    bad = {r["row"] for r in rows(got.rejected)}
    assert got.accepted.count() + len(bad) == len(CASES) * 3 == got.counts().first().n_read
    assert len(bad) == 3 * sum(bool(r) for _, r in CASES)
    assert got.accepted.columns == table.columns
    sales = contracts.canonical_sales(got.accepted)
    assert sales.count() == got.accepted.count() and sales.filter("quantity_sold IS NULL").count() == 0
    assert all('"product_id"' in r["record"] for r in rows(got.rejected))


def test_typed_and_empty_tables(spark, make_sales, make_inventory):
    typed = make_inventory([("2024-01-01", "A", -5, 7), ("2024-01-01", "B", 5, 7)])
    got = rejects.sort_out_inventory(typed)
    assert [(r["column"], r["reason"], r["value"]) for r in rows(got.rejected)] == [("current_stock", "negative", "-5")]
    assert [r["product_id"] for r in rows(got.accepted)] == ["B"]
    none = rejects.sort_out(make_sales([]))
    assert tuple(none.counts().first()) == (0, 0, 0) and none.accepted.count() == none.rejected.count() == 0
    with pytest.raises(ValueError, match="missing required"):
        rejects.sort_out(spark.sql("SELECT 1 AS date"))
