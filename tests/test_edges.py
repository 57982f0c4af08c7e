"""Edge rows (FIXTURES.md section 4) and the semantic rules D1-D20."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

import seed as S
from ledgerleaf.functions.text import is_empty, money_text, php_intval, unit_label
from ledgerleaf.functions.time import period_bounds, yearweek_iso
from ledgerleaf.operators import filters, inventory, lists, metrics


def _sales(spark, rows):
    return S.sales_df(spark, rows)


def test_half_open_day(spark):
    df = _sales(spark, [(1, 1, "a", 1, "1.00", "2026-05-14 23:59:59", "Completed"),
                        (2, 1, "a", 1, "1.00", "2026-05-15 00:00:00", "Completed")])
    assert [r.sales_id for r in filters.period_filter(df, "daily", "2026-05-14").collect()] == [1]
    assert [r.sales_id for r in filters.day_filter(df, "2026-05-15").collect()] == [2]


def test_iso_year_edge(spark):
    df = _sales(spark, [(1, 1, "a", 1, "1.00", "2027-01-01 10:00:00", "Completed")])
    assert filters.period_filter(df, "weekly", "2026-12-31").count() == 1
    assert period_bounds("weekly", "2026-12-31") == (dt.date(2026, 12, 28), dt.date(2027, 1, 4))
    assert df.select(yearweek_iso("created_at").alias("w")).first().w == 202653


def test_accents_and_case(spark):
    df = S.products_df(spark).limit(0).unionByName(spark.createDataFrame(
        [(1, "Latté", "Hot Coffee", D("1.00"), "Available", "x")], S.products_df(spark).schema))
    assert filters.product_search(df, "LATTE", fold_accents=False).count() == 0
    assert filters.product_search(df, "LATTE", fold_accents=True).count() == 1
    assert filters.product_search(df, "latt").count() == 1


def test_wildcards_and_zero(seed):
    assert filters.product_search(seed.products, "%").count() == seed.products.count()
    assert filters.product_search(seed.products, "_a").count() > 0
    assert filters.product_search(seed.products, "0").count() == seed.products.count()
    assert is_empty("0") and is_empty("") and is_empty(None) and not is_empty("00")


def test_search_params_trimmed_but_sales_search_not(seed):
    assert filters.product_search(seed.products, "  Mocha ").count() == 5
    assert filters.sales_search(seed.sales, " Mocha").count() == 1   # "White Mocha Latte" only


def test_trailing_space_status(spark):
    df = _sales(spark, [(1, 1, "a", 1, "5.00", "2026-05-14 10:00:00", "Completed "),
                        (2, 1, "a", 1, "7.00", "2026-05-14 10:00:00", "Completed")])
    assert metrics.sales_page_totals(df).first().total_sales == D("7.00")


def test_null_threshold_rules(spark):
    df = S.ingredients_df(spark, [(1, "a", 4, None, "x"), (2, "b", 10, None, "x"), (3, "c", 20, None, "x"),
                                  (4, "d", 0, None, "x"), (5, "e", -1, None, "x")])
    rows = {r.ingredient_id: r for r in inventory.stock_class(df).collect()}
    assert [rows[i].report_class for i in (1, 2, 3)] == ["badge-bad", "badge-mid", "badge-good"]
    assert [rows[i].dashboard_label for i in (1, 2, 3)] == ["Low", "Normal", "High"]
    assert [rows[i].card_class for i in (1, 2, 3, 4, 5)] == ["high", "high", "high", "low", "mid"]
    for level in ("low", "mid", "high"):
        assert filters.stock_level_filter(df, level).count() == 0


def test_null_stock(spark):
    df = S.ingredients_df(spark, [(1, "a", None, 5, "x")])
    r = inventory.stock_class(df).first()
    assert (r.card_class, r.report_class, r.dashboard_label) == ("low", "badge-bad", "Low")
    assert filters.stock_level_filter(df, "low").count() == 0
    assert inventory.stock_pct(df).first().stock_pct == 0


def test_zero_threshold(spark):
    df = S.ingredients_df(spark, [(1, "a", 0, 0, "x"), (2, "b", 1, 0, "x")])
    rows = inventory.stock_class(df).orderBy("ingredient_id").collect()
    assert [r.card_class for r in rows] == ["low", "high"]
    assert [r.stock_pct for r in inventory.stock_pct(df).orderBy("ingredient_id").collect()] == [0, 100]


def test_unit_label(spark):
    df = spark.createDataFrame([("pcs",), ("Bottle-based",), (None,), ("",)], "unit string")
    got = [r.l for r in df.select(unit_label("unit").alias("l")).collect()]
    assert got == ["Pcs-based", "Bottle-based-based", "Other-based", "-based"]


def test_money_rounds_half_up(spark):
    df = spark.createDataFrame([(D("2.50"),), (D("1234567.5"),), (D("0.125"),)], "x decimal(12,3)")
    got = [r.m for r in df.select(money_text("x", 0).alias("m")).collect()]
    assert got == ["₱3", "₱1,234,568", "₱0"]
    got = [r.m for r in df.select(money_text("x", 2).alias("m")).collect()]
    assert got == ["₱2.50", "₱1,234,567.50", "₱0.13"]


def test_intval(spark):
    df = spark.createDataFrame([("12abc",), ("  -7",), ("abc",), (None,), ("3.9",)], "s string")
    assert [r.v for r in df.select(php_intval("s").alias("v")).collect()] == [12, -7, 0, 0, 3]


def test_unit_price_and_badges(spark):
    df = _sales(spark, [(1, 1, "a", 3, "100.00", "2026-05-14 10:00:00", "completed"),
                        (2, 1, "a", 0, "5.00", "2026-05-14 10:00:00", "Canceled"),
                        (3, 1, "a", 2, "0.05", "2026-05-14 10:00:00", "weird")])
    up = {r.sales_id: r.unit_price for r in lists.sale_unit_price(df).collect()}
    assert up == {1: D("33.33"), 2: D("5.00"), 3: D("0.03")}
    b = {r.sales_id: r.badge for r in lists.sale_status_badges(df).collect()}
    assert b == {1: "completed", 2: "cancelled", 3: "pending"}


def test_invalid_day_matches_nothing(seed):
    assert filters.sales_search(seed.sales, None, "2026-13-45").count() == 0


def test_unit_options_order(seed):
    rows = inventory.unit_options(seed.ingredients).orderBy("option_rank").collect()
    # By stock ascending: All Purpose Cream (5, Box) first, then Biscoff Sauce (10, Bottle), ...
    assert [r.unit_label for r in rows][:2] == ["Box-based-based", "Bottle-based-based"]
    assert [r.option_rank for r in rows] == list(range(1, len(rows) + 1))


def test_inventory_report_filters(seed):
    assert inventory.inventory_report(seed.ingredients, "badge-bad").count() == 1
    assert inventory.inventory_report(seed.ingredients, "", "Box-based-based").count() == 3
    assert inventory.inventory_report(seed.ingredients, "nonsense").count() == 0


def test_equality_collation(spark):
    df = S.products_df(spark).limit(0).unionByName(spark.createDataFrame(
        [(1, "Latte", "Café", D("1.00"), "Available", "x"), (2, "Tea", "cafe ", D("1.00"), "Available", "x")],
        S.products_df(spark).schema))
    assert [r.product_id for r in filters.product_search(df, category="CAFÉ").collect()] == [1]
    assert [r.product_id for r in filters.product_search(df, category="cafe", fold_accents=True).collect()] == [1]
    assert filters.product_search(df, category="cafe", fold_accents=False).count() == 0     # accents count if asked for
