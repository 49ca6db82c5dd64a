from __future__ import annotations

import pytest
from conftest import by, day, rows, sale
from pyspark.sql import functions as F

from ripecast.sources import contracts, files
from ripecast.sources.star import product_id, product_key

EXPORT = [
    ("2024-05-04", "F1", "Mangues", "Fruits Exotiques", 4, 500, 2000, 1200, 800),
    ("2024-01-01", "F1", "Mangues", "Fruits Exotiques", 0, 500, 0, 0, 0),
    ("2024-01-02", "V1", "Gombo", "Légumes Bio", 3, 300, 900, 500, 400),
]
EXPORT_COLUMNS = ("date string, product_id string, product_name string, category string, quantite_vendue int, "
                  "prix_unitaire_xof int, chiffre_affaires_xof int, cout_total_xof int, profit_xof int")


def test_export_names_types_and_defaults(spark):
    got = contracts.canonical_sales(spark.createDataFrame(EXPORT, EXPORT_COLUMNS))
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in contracts.SALES_SCHEMA]
    first, = [r for r in rows(got) if r["date"] == day("2024-05-04")]
    assert first["season"] == "Saison des Pluies" and first["is_weekend"] == 1
    assert first["shelf_life_days"] == 7 and first["quantity_sold"] == 4


def test_shelf_life_comes_from_the_latest_stock_row(spark, make_inventory):
    stock = make_inventory([("2024-01-01", "F1", 80, 4), ("2024-02-01", "F1", 60, 5)])
    got = contracts.canonical_sales(spark.createDataFrame(EXPORT, EXPORT_COLUMNS), stock)
    assert {(r["product_id"], r["shelf_life_days"]) for r in rows(got)} == {("F1", 5), ("V1", 7)}


def test_missing_required_column(spark):
    with pytest.raises(ValueError, match="quantity_sold"):
        contracts.canonical_sales(spark.createDataFrame(EXPORT, EXPORT_COLUMNS).drop("quantite_vendue"))
    with pytest.raises(ValueError, match="current_stock"):
        contracts.canonical_inventory(spark.createDataFrame([("2024-01-01", "A")], "date string, product_id string"))


def test_bad_dates_fail_or_become_null(spark):
    bad = spark.createDataFrame([("2024-13-01",), ("2024-01-05",)], "date string")
    with pytest.raises(Exception, match="(?i)date|parse"):
        contracts.parse_day(bad).collect()
    assert [r["date"] for r in rows(contracts.parse_day(bad, strict=False))] == [None, day("2024-01-05")]


def test_row_order_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(EXPORT, EXPORT_COLUMNS)
    one = by(contracts.canonical_sales(df.coalesce(1)), "date")
    many = by(contracts.canonical_sales(df.repartition(7)), "date")
    assert one == many
    assert sorted(one, key=lambda d: one[d]["row_order"]) == sorted(one)


def test_inventory_defaults(spark):
    df = spark.createDataFrame([("2024-01-01", "A", 12)], "date string, product_id string, stock_actuel int")
    got, = rows(contracts.canonical_inventory(df))
    assert (got["current_stock"], got["reorder_level"], got["shelf_life_days"]) == (12, 30, 7)


def test_stock_default(spark):
    df = spark.createDataFrame([("A", None), ("B", 5)], "product_id string, current_stock int")
    assert [r["current_stock"] for r in rows(contracts.with_stock_default(df))] == [100, 5]
    assert [r["current_stock"] for r in rows(contracts.with_stock_default(df.drop("current_stock")))] == [100, 100]


def test_csv_in_any_column_order_with_accents(spark, tmp_path):
    df = spark.createDataFrame(EXPORT, EXPORT_COLUMNS)
    files.write_csv(df.select(*reversed(df.columns)), str(tmp_path / "sales"))
    files.require_paths(spark, str(tmp_path / "sales"))
    got = files.read_sales(spark, str(tmp_path / "sales"))
    assert sorted(map(str, got.collect())) == sorted(map(str, contracts.canonical_sales(df).collect()))
    assert {r["category"] for r in rows(got)} == {"Fruits Exotiques", "Légumes Bio"}


def test_dataset_round_trip(spark, tmp_path, make_sales, make_inventory):
    sales = make_sales([sale("2024-01-01", quantity=3), sale("2024-01-02", category="Légumes d'Été, \"bio\"")])
    stock = make_inventory([("2024-01-01", "A", 80, 4)])
    files.save_dataset(sales, stock, str(tmp_path / "out"))
    assert sorted(map(str, files.read_sales(spark, f"{tmp_path}/out/sales").collect())) == sorted(map(str, sales.collect()))
    assert files.read_inventory(spark, f"{tmp_path}/out/inventory").collect() == stock.collect()


def test_monthly_parquet(spark, tmp_path, make_sales):
    sales = make_sales([sale(f"2024-0{m}-0{d}", quantity=d) for m in (1, 2, 3) for d in (1, 2)])
    files.write_parquet(sales, str(tmp_path / "p"), by_month=True)
    back = files.read_sales(spark, str(tmp_path / "p"), "parquet")
    assert sorted(map(str, back.collect())) == sorted(map(str, sales.collect()))
    plan = files.read_table(spark, str(tmp_path / "p"), "parquet").filter(F.col("month") == "2024-02")
    assert plan.count() == 2


def test_missing_path_and_format(spark, tmp_path):
    with pytest.raises(ValueError, match="nowhere"):
        files.require_paths(spark, str(tmp_path), str(tmp_path / "nowhere"))
    with pytest.raises(ValueError, match="xlsx"):
        files.read_table(spark, str(tmp_path), "xlsx")


def test_customers_pass_through(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("c1", "2024-01-01")], "id string, date string"), str(tmp_path / "c"))
    got, = rows(files.read_customers(spark, str(tmp_path / "c")))
    assert got == {"id": "c1", "date": day("2024-01-01")}


def test_three_inputs_or_none(spark, tmp_path, make_sales, make_inventory):
    root = str(tmp_path)
    files.save_dataset(make_sales([sale("2024-01-01")]).drop("shelf_life_days"),
                       make_inventory([("2024-01-01", "A", 80, 4)]), root)
    with pytest.raises(ValueError, match="customers"):
        files.read_dataset(spark, f"{root}/sales", f"{root}/inventory", f"{root}/customers")
    files.write_csv(spark.createDataFrame([("c1",)], "id string"), f"{root}/customers")
    got = files.read_dataset(spark, f"{root}/sales", f"{root}/inventory", f"{root}/customers")
    assert rows(got.sales)[0]["shelf_life_days"] == 4
    assert rows(got.inventory)[0]["current_stock"] == 80 and got.customers.count() == 1


def test_sale_measures(spark):
    df = spark.createDataFrame([(3, "500.00", "300.50")], "quantity_sold bigint, p string, c string").select(
        "quantity_sold", F.col("p").cast("decimal(12,2)").alias("unit_price"),
        F.col("c").cast("decimal(18,4)").alias("unit_cost"),
    )
    got, = rows(contracts.with_sale_measures(df))
    assert (float(got["revenue"]), float(got["cost"]), float(got["profit"])) == (1500.0, 901.5, 598.5)


def test_product_ids_beyond_nine_digits(spark):
    keys = [(0,), (42,), (999_999_999,), (30_000_000_123,)]
    got = [r["id"] for r in rows(spark.createDataFrame(keys, "k bigint").select(product_id(F.col("k")).alias("id")))]
    assert got == ["P000000000", "P000000042", "P999999999", "P30000000123"]
    assert [product_key(i) for i in got] == [k for k, in keys]
