"""Filters and predicates.

A search form becomes a list of ``Column`` predicates, one per non-empty
parameter, folded with ``&`` into a single ``filter``; Catalyst pushes the
comparable parts (ranges, equalities on raw columns) to the parquet scan.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ci_equals, is_empty, like_contains, php_trim
from ..sources.schemas import TIME_PARTITIONS
from ..functions.time import DAY, as_date, in_range, period_predicate, trailing_bounds

COMPLETED = "Completed"
AVAILABLE = "Available"
# The sales table's collation: case and accents do not make a different status.
TEXT_COLLATION = "UNICODE_CI_AI"


def is_completed(col: str = "status") -> Column:
    """``status = 'Completed'`` as the table's collation compares (trailing spaces make a different status)."""
    c = F.col(col)
    return (c == COMPLETED) | (F.collate(c, TEXT_COLLATION) == F.lit(COMPLETED))


def declared(sales: DataFrame) -> DataFrame:
    """Without the store's own partition column, which serves to prune files only."""
    return sales.drop(*TIME_PARTITIONS.values())


def apply_all(df: DataFrame, preds: list[Column]) -> DataFrame:
    """One ``filter`` with the AND of ``preds``; no predicate means no filter."""
    return df.filter(reduce(and_, preds)) if preds else df


# --------------------------------------------------------------------------- F7 / F11
def completed(df: DataFrame) -> DataFrame:
    """``status = 'Completed'`` (trailing spaces make a different status)."""
    return df.filter(is_completed())


def with_image(df: DataFrame, col: str = "image") -> DataFrame:
    return df.filter(F.col(col).isNotNull() & (F.col(col) != ""))


# --------------------------------------------------------------------------- F4-F6
def period_filter(df: DataFrame, period: str, as_of, col: str = "created_at") -> DataFrame:
    """Same day / ISO week / calendar month as ``as_of``; any other word: no filter."""
    p = period_predicate(df, period, as_of, col)
    return declared(df if p is None else df.filter(p))


def trailing_days(df: DataFrame, as_of, days: int = 7, col: str = "created_at") -> DataFrame:
    """[as_of - (days-1), as_of + 1): the dashboard's "weekly"."""
    return declared(df.filter(in_range(df, col, *trailing_bounds(as_of, days))))


def day_filter(df: DataFrame, day, col: str = "created_at") -> DataFrame:
    d = as_date(day)
    return declared(df.filter(in_range(df, col, d, d + DAY)))


# --------------------------------------------------------------------------- F1
def product_search(products: DataFrame, search: str | None = None, category: str | None = None,
                   status: str | None = None, fold_accents: bool = True) -> DataFrame:
    """Products page filter: name contains, category equals, status equals."""
    search, category, status = php_trim(search), php_trim(category), php_trim(status)
    preds = []
    if not is_empty(search):
        preds.append(like_contains("product_name", search, fold_accents))
    if not is_empty(category):
        preds.append(ci_equals("category", category, fold_accents))
    if not is_empty(status):
        preds.append(ci_equals("status", status, fold_accents))
    return apply_all(products, preds)


# --------------------------------------------------------------------------- F8 / F2
def stock_level_predicate(level: str | None) -> Column | None:
    """Inventory page's SQL stock filter; NULL stock or threshold never matches."""
    s, t = F.col("stock"), F.col("low_stock_threshold")
    if level == "low":
        return s <= t
    if level == "mid":
        return (s > t) & (s <= t.cast("long") * 3)
    if level == "high":
        return s > t.cast("long") * 3
    return None


def stock_level_filter(ingredients: DataFrame, level: str | None) -> DataFrame:
    p = stock_level_predicate(php_trim(level))
    return ingredients if p is None else ingredients.filter(p)


def ingredient_search(ingredients: DataFrame, search: str | None = None, unit: str | None = None,
                      stock_level: str | None = None, fold_accents: bool = True) -> DataFrame:
    """Inventory page filter; the form's "category" selects ``unit``."""
    search, unit, stock_level = php_trim(search), php_trim(unit), php_trim(stock_level)
    preds = []
    if not is_empty(search):
        preds.append(like_contains("ingredient_name", search, fold_accents))
    if not is_empty(unit):
        preds.append(ci_equals("unit", unit, fold_accents))
    p = stock_level_predicate(stock_level)
    if p is not None:
        preds.append(p)
    return apply_all(ingredients, preds)


# --------------------------------------------------------------------------- F9
def low_stock_alerts(ingredients: DataFrame) -> DataFrame:
    """Name, stock and threshold of items at or under their threshold, by name."""
    return (ingredients.filter(F.col("stock") <= F.col("low_stock_threshold"))
            .select(F.col("ingredient_name").alias("label"), "stock", "low_stock_threshold")
            .orderBy(F.col("label").asc_nulls_first(), "stock", "low_stock_threshold"))


# --------------------------------------------------------------------------- F10
def is_available(col: str = "status") -> Column:
    """``status = 'Available'`` as the tables' collation compares."""
    c = F.col(col)
    return (c == AVAILABLE) | (F.collate(c, TEXT_COLLATION) == F.lit(AVAILABLE))


def available_products(products: DataFrame) -> DataFrame:
    return (products.filter(is_available())
            .select("product_id", "product_name", "category", "price")
            .orderBy(F.col("category").asc_nulls_first(), F.col("product_name").asc_nulls_first(), "product_id"))


def available_addons(addons: DataFrame) -> DataFrame:
    return (addons.filter(is_available())
            .select("addon_id", "addon_name", "price")
            .orderBy("addon_name", "addon_id"))


# --------------------------------------------------------------------------- F3
def sales_search(sales: DataFrame, search: str | None = None, date: str | dt.date | None = None,
                 fold_accents: bool = True) -> DataFrame:
    """Sales page filter: name contains (not trimmed), exact calendar day.

    A day that is not a valid date matches nothing, as the database's
    comparison with an invalid date string does.
    """
    preds = []
    if not is_empty(search):
        preds.append(like_contains("product_name", search, fold_accents))
    if not is_empty(date):
        try:
            d = as_date(date)
        except ValueError:
            return declared(sales.filter(F.lit(False)))
        preds.append(in_range(sales, "created_at", d, d + DAY))
    return declared(apply_all(sales, preds))
