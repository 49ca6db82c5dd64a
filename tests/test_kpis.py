from __future__ import annotations

from conftest import by, day, rows, sale

from ripecast.operators import explore, kpis, products


def test_null_keys_do_not_form_groups(make_sales):
    sales = make_sales([sale("2024-01-01"), sale("2024-01-01", category=None, season=None, name=None)])
    assert [r["category"] for r in rows(explore.category_metrics(sales))] == ["Fruits"]
    assert [r["season"] for r in rows(explore.season_metrics(sales))] == ["Saison Sèche"]
    assert [r["product_name"] for r in rows(kpis.top_products(sales))] == ["Mangues"]


def test_ties_go_to_the_first_in_order(make_sales):
    sales = make_sales([
        sale("2024-01-01", "A", "b", "Y", season="s2"), sale("2024-01-01", "B", "a", "X", season="s1"),
        sale("2024-01-02", "C", "c", "Z", quantity=0, season="s3"),
    ])
    assert rows(kpis.top_category(sales)) == [{"top_category": "X"}]
    assert rows(kpis.peak_season(sales)) == [{"peak_season": "s1"}]
    assert [r["product_name"] for r in rows(kpis.top_products(sales, 2))] == ["a", "b"]


def test_top_category_counts_rows_not_revenue(make_sales):
    sales = make_sales([sale("2024-01-01", category="big", quantity=99), sale("2024-01-01", category="often"),
                        sale("2024-01-02", category="often")])
    assert rows(kpis.top_category(sales)) == [{"top_category": "often"}]


def test_margin_is_a_mean_of_ratios_without_zero_revenue(make_sales):
    sales = make_sales([sale("2024-01-01", quantity=1, profit="5"), sale("2024-01-02", quantity=10, profit="10"),
                        sale("2024-01-03", quantity=0, profit="0")])
    assert rows(kpis.avg_margin(sales)) == [{"avg_profit_margin": 30.0}]
    nothing = make_sales([sale("2024-01-03", quantity=0, profit="0")])
    assert rows(kpis.avg_margin(nothing)) == [{"avg_profit_margin": 0.0}]


def test_daily_mean_skips_days_without_sales(make_sales):
    sales = make_sales([sale("2024-01-01", quantity=2), sale("2024-01-01", "B", quantity=4), sale("2024-01-31")])
    assert rows(kpis.avg_daily_sales(sales)) == [{"avg_daily_sales": 3.5}]


def test_overview_of_nothing(make_sales):
    got, = rows(kpis.overview(make_sales([])))
    assert got == {
        "total_revenue": 0.0, "total_profit": 0.0, "avg_daily_sales": None, "top_category": "N/A",
        "avg_order_value": None, "avg_profit_margin": 0.0, "peak_season": "N/A", "total_products": 0,
    }
    assert rows(kpis.peak_season(make_sales([]).drop("season"))) == [{"peak_season": "N/A"}]


def test_overview_agrees_with_single_figures(make_sales):
    sales = make_sales([sale(f"2024-0{1 + i % 9}-1{i % 7}", f"P{i % 5}", category=f"C{i % 3}" if i % 7 else None,
                             quantity=i % 4, season=f"S{i % 2}") for i in range(60)])
    want = {}
    for figure in (kpis.totals, kpis.avg_daily_sales, kpis.top_category, kpis.avg_margin, kpis.peak_season):
        want |= rows(figure(sales))[0]
    assert rows(kpis.overview(sales)) == [want]


def test_weighted_figures_equal_row_figures(make_sales):
    sales = make_sales([sale(f"2024-01-1{i % 7}", f"P{i % 5}", category=f"C{i % 3}", quantity=i % 4) for i in range(40)])
    summed = sales.groupBy("product_id", "category").agg({"revenue": "sum", "profit": "sum", "*": "count"}).toDF(
        "product_id", "category", *_names(sales))
    assert rows(kpis.totals(summed, "n")) == rows(kpis.totals(sales))
    assert rows(kpis.top_category(summed, "n")) == rows(kpis.top_category(sales))


def _names(sales):
    made = sales.groupBy("product_id").agg({"revenue": "sum", "profit": "sum", "*": "count"}).columns[1:]
    return [{"sum(revenue)": "revenue", "sum(profit)": "profit"}.get(c, "n") for c in made]


def test_date_range_needs_both_ends_and_includes_them(make_sales):
    sales = make_sales([sale(f"2024-01-0{d}") for d in range(1, 6)])
    assert explore.date_range(sales, day("2024-01-02"), day("2024-01-04")).count() == 3
    assert explore.date_range(sales, day("2024-01-02")).count() == 5
    assert rows(explore.category_metrics(sales, day("2024-01-05"), day("2024-01-05")))[0]["quantity_sold"] == 1


def test_profile_of_any_table(make_sales, make_inventory, spark):
    sales = make_sales([sale("2024-01-01"), sale("2024-03-01", "B", category=None)])
    assert rows(explore.profile(sales, "sales")) == [{
        "table_name": "sales", "total_records": 2, "date_range": "2024-01-01 au 2024-03-01",
        "unique_products": 2, "unique_categories": 1,
    }]
    got, = rows(explore.profile(spark.createDataFrame([(1,), (2,)], "id int"), "customer"))
    assert (got["total_records"], got["date_range"], got["unique_products"]) == (2, None, None)


def test_names_shared_by_several_ids(make_sales):
    sales = make_sales([
        sale("2024-01-01", "B", quantity=4, shelf=9, price="20.00"), sale("2024-01-05", "A", quantity=2, shelf=3),
        sale("2024-01-06", "A", quantity=3, shelf=4),
    ])
    assert rows(explore.product_lookup(sales)) == [{"product_name": "Mangues", "product_id": "A"}]
    got, = rows(explore.product_kpis(sales))
    assert got["avg_historical_sales"] == 3.0 and got["total_historical_revenue"] == 130.0
    assert got["shelf_life_days"] == 3 and abs(got["avg_price"] - 40 / 3) < 1e-12
    assert explore.product_list(sales).count() == 1


def test_first_attributes_and_prices(make_sales):
    sales = make_sales([
        sale("2024-01-02", price="12.00", name="late", shelf=4, order=1),
        sale("2024-01-01", price="11.00", name="second", shelf=5, order=2),
        sale("2024-01-01", price="10.00", name="first", shelf=6, order=1),
    ]).repartition(3)
    got, = rows(products.profile(sales))
    assert (got["product_name"], got["shelf_life_days"], got["base_price"], got["mean_price"]) == ("first", 6, 10.0, 11.0)
    assert (got["first_date"], got["last_date"]) == (day("2024-01-01"), day("2024-01-02"))


def test_stock_is_the_last_row_or_the_default(spark, make_inventory):
    stock = make_inventory([("2024-01-02", "A", 7, 3), ("2024-01-02", "A", 8, 3), ("2024-01-01", "A", 9, 3)])
    ids = spark.createDataFrame([("A",), ("B",)], "product_id string")
    got = by(products.with_stock(ids, products.latest_stock(stock)), "product_id")
    assert got["A"]["current_stock"] == 8 and got["B"]["current_stock"] == 100


def test_calendar_spine_includes_both_ends(spark):
    ids = spark.createDataFrame([("A",), ("B",)], "product_id string")
    got = rows(products.calendar_spine(ids, day("2024-02-27"), day("2024-03-01")))
    assert len(got) == 8 and max(r["date"] for r in got) == day("2024-03-01")
