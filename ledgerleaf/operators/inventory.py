"""Stock levels.

The pages classify stock three ways. The SQL filters drop rows whose stock or
threshold is NULL; the PHP classifications do not, and compare NULL the way
PHP does (``null <= x`` compares booleans, ``null * 3`` is 0). Each rule is
kept as its own expression so both behaviours are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number
from ..functions.text import unit_label

# The three vocabularies of the stock classes, in the order
# (low, mid, high): inventory cards, report badges, dashboard labels.
VOCABULARIES = {
    "card": ("low", "mid", "high"),
    "report": ("badge-bad", "badge-mid", "badge-good"),
    "dashboard": ("Low", "Normal", "High"),
}
# Fixed value: threshold assumed when an ingredient has none (report, dashboard).
DEFAULT_THRESHOLD = 5



def _S() -> Column:
    return F.col("stock")


def _T() -> Column:
    return F.col("low_stock_threshold")


def _level(low: Column, mid: Column, names) -> Column:
    lo, mi, hi = names
    return F.when(low, lo).when(mid, mi).otherwise(hi)


def stock_class_col(rule: str = "card") -> Column:
    """Class of one ingredient under a page's rule.

    ``card``: the inventory cards (PHP comparisons against a possibly NULL
    threshold: with no threshold, stock 0 is low, negative mid, positive high).
    ``report``/``dashboard``: threshold defaults to 5; NULL stock is low.
    """
    names = VOCABULARIES[rule]
    if rule == "card":
        low = (_S().isNull()
               | (_T().isNull() & (_S() == 0))
               | (_T().isNotNull() & (_S() <= _T())))
        mid = (_T().isNull() & (_S() < 0)) | (_T().isNotNull() & (_S() <= _T().cast("long") * 3))
        return _level(low, mid, names)
    thr = F.coalesce(_T(), F.lit(DEFAULT_THRESHOLD))
    return _level(_S().isNull() | (_S() <= thr), _S() <= thr * 3, names)


def stock_class(ingredients: DataFrame) -> DataFrame:
    """All three vocabularies side by side."""
    return ingredients.select(
        "ingredient_id", "ingredient_name", "stock", "low_stock_threshold",
        stock_class_col("card").alias("card_class"),
        stock_class_col("report").alias("report_class"),
        stock_class_col("dashboard").alias("dashboard_label"),
    )


def stock_pct_col() -> Column:
    """Fill of the stock bar: ``min(100, round(stock / max(3*thr, 1) * 100))``."""
    max_ref = F.greatest(F.coalesce(_T(), F.lit(0)) * 3, F.lit(1))
    return F.least(F.lit(100), F.round(F.coalesce(_S(), F.lit(0)) / max_ref * 100).cast("int"))


def stock_pct(ingredients: DataFrame) -> DataFrame:
    """P4."""
    return ingredients.select("ingredient_id", "stock", "low_stock_threshold", stock_pct_col().alias("stock_pct"))


def unit_labels(ingredients: DataFrame) -> DataFrame:
    """P7."""
    return ingredients.select("ingredient_id", "unit", unit_label("unit").alias("unit_label"))


def low_stock_count(ingredients: DataFrame) -> DataFrame:
    """K7: the navigation badge; rows with NULL stock or threshold are not counted."""
    return ingredients.agg(F.count(F.when(_S() <= _T(), F.lit(1))).alias("low_stock_count"))


def inventory_by_stock(ingredients: DataFrame) -> DataFrame:
    """O1: ingredients by stock ascending with the dashboard label and shown threshold."""
    return (ingredients.select(
        "ingredient_id", "ingredient_name", "unit", "stock",
        F.coalesce(_T(), F.lit(DEFAULT_THRESHOLD)).alias("threshold_shown"),
        stock_class_col("dashboard").alias("dashboard_label"))
        .orderBy(F.col("stock").asc_nulls_first(), "ingredient_id"))


def unit_options(ingredients: DataFrame) -> DataFrame:
    """K8: distinct unit labels in order of first appearance when listed by stock.

    One partial aggregate per label keeps the first (stock, id) position; the
    labels are then numbered in that order.
    """
    # (has stock, stock, id): NULL stock sorts first, as the stock-ascending list does.
    pos = F.struct(_S().isNotNull().alias("a"), F.coalesce(_S(), F.lit(0)).alias("b"), F.col("ingredient_id").alias("c"))
    firsts = (ingredients.groupBy(unit_label("unit").alias("unit_label"))
              .agg(F.min(pos).alias("p"))
              .select("unit_label",
                      F.when(F.col("p.a"), F.col("p.b")).alias("first_stock"),
                      F.col("p.c").alias("first_ingredient_id")))
    return global_row_number(
        firsts, [F.col("first_stock").asc_nulls_first(), F.col("first_ingredient_id").asc()], name="option_rank")


def inventory_report(ingredients: DataFrame, status: str | None = None, unit: str | None = None) -> DataFrame:
    """report's ingredient list with badge class and unit label, filtered.

    A non-empty filter keeps only rows equal to it; an unknown value keeps none.
    """
    out = ingredients.select(
        "ingredient_id", "ingredient_name", "stock",
        F.coalesce(_T(), F.lit(DEFAULT_THRESHOLD)).alias("threshold_shown"),
        stock_class_col("report").alias("report_class"),
        unit_label("unit").alias("unit_label"))
    if status not in (None, ""):
        out = out.filter(F.col("report_class") == status)
    if unit not in (None, ""):
        out = out.filter(F.col("unit_label") == unit)
    return out
