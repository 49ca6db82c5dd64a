"""Reports on sales of which a third belong to one product, with joins too large to broadcast."""

from __future__ import annotations

import os
import shutil

import duckdb
import pytest
from conftest import TESTDATA
from test_oracle import sorted_rows

import __spark_entry__ as contract

pytestmark = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables")


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """The test tables with every third order line moved to product 7."""
    root = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()
    con.execute(f"""
        COPY (SELECT * REPLACE (CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 7 ELSE l_partkey END AS l_partkey)
              FROM '{TESTDATA}/lineitem.parquet') TO '{root}/lineitem.parquet'""")
    for name in ("part", "customer"):
        shutil.copyfile(f"{TESTDATA}/{name}.parquet", f"{root}/{name}.parquet")
    for name in ("lineitem", "part", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    top, total = con.execute(
        "SELECT max(n), sum(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)").fetchone()
    assert top > total * 0.3
    yield root, con
    con.close()


@pytest.fixture
def skew_joins(spark):
    """Sort-merge joins whose hot partitions AQE splits even at this size."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", [
    "canonical_sales", "kpi_overview", "top_products", "category_metrics", "product_kpis", "product_first_attrs",
    "stock_latest", "product_daily", "label_encode", "feature_matrix", "train_test_split", "forecast_trend",
    "forecast_trend_train_part", "history_plus_forecast", "eval_holdout", "reorder_plan", "price_optimization",
    "trend_save_load",
])
def test_matches_sql_under_skew(spark, skewed, skew_joins, name):
    root, con = skewed
    got = contract.queries()[name](spark, root)
    want = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted_rows(got.columns, [tuple(r) for r in got.collect()]) == sorted_rows(columns, want.fetchall())
