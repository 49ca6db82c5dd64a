from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ripecast.session import build_session  # noqa: E402
from ripecast.sources import contracts  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]", "ripecast-tests",
        spark__sql__shuffle__partitions=4,
        spark__driver__memory="4g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def sale(date, product_id="A", name="Mangues", category="Fruits", quantity=1, price="10.00", profit=None,
         shelf=7, season="Saison Sèche", order=0):
    price = Decimal(price)
    revenue = price * quantity
    return (day(date), product_id, name, category, quantity, price, revenue,
            revenue / 2 if profit is None else Decimal(profit), season, 0, shelf,
            ((day(date) - dt.date(1970, 1, 1)).days << 46) + order)


@pytest.fixture(scope="session")
def make_sales(spark):
    return lambda rows: spark.createDataFrame(rows, contracts.SALES_SCHEMA)


@pytest.fixture(scope="session")
def make_inventory(spark):
    def make(rows):
        full = [
            (day(d), p, stock, 30, shelf, ((day(d) - dt.date(1970, 1, 1)).days << 46) + i)
            for i, (d, p, stock, shelf) in enumerate(rows)
        ]
        return spark.createDataFrame(full, contracts.INVENTORY_SCHEMA)
    return make


def rows(df):
    return [r.asDict() for r in df.collect()]


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
