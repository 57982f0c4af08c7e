"""Golden values on the seed rows (FIXTURES.md section 2)."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import filters, inventory, lists, metrics, rankings


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("as_of,sales,orders,week7", [
    ("2026-05-14", "380.00", 3, "1697.00"),
    ("2026-05-16", "315.00", 1, "2012.00"),
    ("2026-05-01", "669.00", 4, "1092.00"),
])
def test_dashboard_kpis(seed, as_of, sales, orders, week7):
    r = one(metrics.dashboard_kpis(seed.sales, as_of))
    assert r.daily_sales == D(sales)
    assert r.today_orders == orders
    assert r.weekly_sales == D(week7)
    assert r.monthly_sales == D("2681.00") if as_of.startswith("2026-05") else True
    assert r.monthly_estimate == D("2949.100")


@pytest.mark.parametrize("as_of,sales,orders", [
    ("2026-05-14", "2012.00", 7), ("2026-05-16", "2012.00", 7), ("2026-05-01", "1092.00", 8)])
def test_iso_week_differs_from_trailing(seed, as_of, sales, orders):
    r = one(metrics.report_summary(seed.sales, "weekly", as_of))
    assert (r.total_sales, r.total_transactions) == (D(sales), orders)


def test_month_and_all_time(seed):
    r = one(metrics.report_summary(seed.sales, "monthly", "2026-05-14"))
    assert (r.total_sales, r.total_transactions) == (D("2681.00"), 11)
    r = one(metrics.sales_page_totals(seed.sales))
    assert (r.total_sales, r.total_transactions) == (D("3104.00"), 15)
    r = one(metrics.report_summary(seed.sales, "anything else", "2026-05-14"))
    assert (r.total_sales, r.total_transactions) == (D("3104.00"), 15)


def test_by_status(seed):
    got = {r.status: (r.n, r.t) for r in seed.sales.groupBy("status")
           .agg(F.count("*").alias("n"), F.sum("total").alias("t")).collect()}
    assert got == {"Completed": (15, D("3104.00")), "Cancelled": (3, D("292.00"))}


def ids(df):
    return [(r.product_id, r.qty_sold, r.revenue) for r in df.collect()]


def test_top_daily(seed):
    got = ids(rankings.top_products(seed.sales, seed.products, "2026-05-14", "daily"))
    assert got == [(27, 2, D("210.00")), (25, 1, D("105.00")), (59, 1, D("65.00"))]
    got = ids(rankings.top_products(seed.sales, seed.products, "2026-05-14", "daily", completed_only=False,
                                    require_image=True))
    assert got == [(26, 2, D("138.00")), (27, 2, D("210.00")), (25, 1, D("105.00")), (59, 1, D("65.00"))]


def test_top_trailing7(seed):
    got = ids(rankings.top_products(seed.sales, seed.products, "2026-05-14", "trailing7"))
    assert got == [(22, 10, D("1050.00")), (26, 3, D("267.00")), (27, 2, D("210.00")), (25, 1, D("105.00")),
                   (59, 1, D("65.00"))]
    got = ids(rankings.top_products(seed.sales, seed.products, "2026-05-14", "trailing7", completed_only=False,
                                    require_image=True))
    assert got == [(22, 10, D("1050.00")), (26, 5, D("405.00")), (27, 2, D("210.00")), (25, 1, D("105.00")),
                   (59, 1, D("65.00"))]


def test_top_month(seed):
    got = ids(rankings.top_products(seed.sales, seed.products, "2026-05-14", "monthly"))
    assert got == [(22, 13, D("1365.00")), (26, 3, D("267.00")), (39, 3, D("297.00")), (25, 2, D("210.00")),
                   (27, 2, D("210.00")), (29, 2, D("178.00")), (42, 1, D("89.00")), (59, 1, D("65.00"))]


def test_category_ranking(seed):
    got = [(r.category_rank, r.category, r.total_quantity, r.total_sales)
           for r in rankings.category_ranking(seed.sales, seed.products).orderBy("category_rank").collect()]
    assert got == [(1, "Hot Coffee", 24, D("2376.00")), (2, "Non-Coffee", 5, D("475.00")),
                   (3, "Iced Coffee", 2, D("164.00")), (4, "Matcha Series", 1, D("89.00"))]


def test_stock_classes(seed):
    got = {r.card_class: r.n for r in inventory.stock_class(seed.ingredients)
           .groupBy("card_class").agg(F.count("*").alias("n")).collect()}
    assert got == {"low": 1, "mid": 6, "high": 15}
    alerts = filters.low_stock_alerts(seed.ingredients).collect()
    assert [(a.label, a.stock) for a in alerts] == [("All Purpose Cream", 5)]
    assert one(inventory.low_stock_count(seed.ingredients)).low_stock_count == 1


def test_ingredients_by_unit(seed):
    got = {r.unit_label: r.n for r in inventory.unit_labels(seed.ingredients)
           .groupBy("unit_label").agg(F.count("*").alias("n")).collect()}
    assert got == {"Bottle-based-based": 13, "Pack-based-based": 4, "Box-based-based": 3,
                   "Can-based-based": 1, "Plastic-based-based": 1}


def test_available_products_by_category(seed):
    got = {r.category: r.n for r in filters.available_products(seed.products)
           .groupBy("category").agg(F.count("*").alias("n")).collect()}
    assert got == {"Hot Coffee": 9, "Iced Coffee": 15, "Matcha Series": 6, "Non-Coffee": 11, "Snacks": 5,
                   "Add Ons": 3}


def test_search_latte_newest_first(seed):
    rows = lists.sales_list(filters.sales_search(seed.sales, "Latte"), seed.products).collect()
    assert [r.sales_id for r in rows] == [43, 39, 38, 35, 30, 29, 26]


def test_total_rule_holds(seed):
    totals = lists.sales_addon_rollup(seed.sales, seed.sale_addons)
    j = totals.join(seed.sales.select("sales_id", "product_id", "total", "quantity"), "sales_id").join(
        seed.products.select("product_id", "price"), "product_id")
    broken = j.filter(F.col("total") != F.col("quantity") * (F.col("price") + F.col("addon_total"))).count()
    assert broken == 0


def test_stock_pct_by_hand(spark):
    import seed as S
    df = S.ingredients_df(spark, [(1, "a", 5, 5, "x"), (2, "b", 20, 10, "x"), (3, "c", 30, 5, "x")])
    got = [r.stock_pct for r in inventory.stock_pct(df).orderBy("ingredient_id").collect()]
    assert got == [33, 67, 100]


def test_stat_strip_all_time_and_daily(seed):
    r = one(metrics.report_stat_strip(seed.sales, "all", "2026-05-14"))
    assert (r.weekly_sales, r.monthly_sales, r.today_orders, r.total_transactions) == (
        D("1697.00"), D("2681.00"), 3, 15)
    r = one(metrics.report_stat_strip(seed.sales, "daily", "2026-05-14"))
    assert r.total_transactions == 3


def test_top_windows_one_scan_equals_separate_lists(seed):
    both = rankings.top_products_windows(seed.sales, seed.products, "2026-05-14", completed_only=False,
                                         require_image=True)
    for w in ("daily", "trailing7", "monthly"):
        sep = ids(rankings.top_products(seed.sales, seed.products, "2026-05-14", w, completed_only=False,
                                        require_image=True))
        got = [(r.product_id, r.qty_sold, r.revenue) for r in
               both.filter(both.top_window == w).orderBy("top_rank").collect()]
        assert got == sep, w
