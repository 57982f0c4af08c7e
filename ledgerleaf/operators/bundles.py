"""All figures of the report page from one scan of the ledger (K2, K2b, K3, K5 and W1 together).

Completed sales are added up per product and time window in one pass; the catalogue is joined to these
sums, and grouping sets add them up again per category and in all. So the shuffles carry rows in the number of products,
however long the ledger is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import in_range, period_bounds
from ..sources.schemas import MONEY_SUM
from . import rankings
from .filters import TEXT_COLLATION, is_completed

# The windows of the report, and those that its period selector names (any other word: all time).
WINDOWS = ("daily", "trailing7", "isoweek", "monthly", "all")
PERIODS = {"daily": "daily", "weekly": "isoweek", "monthly": "monthly"}
FIGURES = [f"{w}_{m}" for w in WINDOWS for m in ("qty", "sales", "orders")]


def _inside(sales: DataFrame, window: str, as_of):
    if window == "all":
        return F.lit(True)
    bounds = period_bounds("weekly", as_of) if window == "isoweek" else rankings.window_bounds(window, as_of)
    return in_range(sales, "created_at", *bounds, prune=False)


def report_bundle(sales: DataFrame, products: DataFrame, as_of) -> DataFrame:
    """One row per product sold, per category and in all (``level``: product, category, all): quantity, money and number of
    completed sales in each of ``WINDOWS``. Nothing sold in a window gives 0.

    Sales whose product is not in the catalogue count under their product and in all, but under no category. Categories that
    differ in case or accents only are one, under the smallest spelling.
    """
    sums, again = [], []
    for w in WINDOWS:
        inside = _inside(sales, w, as_of)
        sums += [F.coalesce(F.sum(F.when(inside, F.col("quantity"))), F.lit(0)).alias(f"{w}_qty"),
                 F.coalesce(F.sum(F.when(inside, F.col("total"))), F.lit(0)).cast(MONEY_SUM).alias(f"{w}_sales"),
                 F.count(F.when(inside, F.lit(1))).alias(f"{w}_orders")]
        again += [F.coalesce(F.sum(f"{w}_qty"), F.lit(0)).alias(f"{w}_qty"),
                  F.coalesce(F.sum(f"{w}_sales"), F.lit(0)).cast(MONEY_SUM).alias(f"{w}_sales"),
                  F.coalesce(F.sum(f"{w}_orders"), F.lit(0)).alias(f"{w}_orders")]
    per_product = sales.filter(is_completed()).groupBy("product_id", "product_name").agg(*sums)
    dim = products.select("product_id", "category", F.collate("category", TEXT_COLLATION).alias("_c"), F.lit(True).alias("_known"))
    joined = per_product.join(dim, "product_id", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    # A row of zeros for no product, so that an empty ledger has its "all" row too.
    nothing = sales.sparkSession.range(1).select(*[
        (F.lit(0) if f.name in FIGURES else F.lit(False) if f.name == "_known" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in joined.schema.fields])
    sets = [["product_id", "product_name"], ["_known", "_c"], []]
    grouped = (joined.unionByName(nothing).groupingSets([[F.col(c) for c in s] for s in sets], "product_id", "product_name", "_known", "_c")
               .agg(F.grouping_id().alias("_g"), F.min("category").alias("category"), *again))
    # grouping_id has a bit for each column that a set leaves out.
    level = F.when(F.col("_g") == 0b0011, "product").when(F.col("_g") == 0b1100, "category").otherwise("all")
    return (grouped.withColumn("level", level)
            .filter(F.when(F.col("level") == "category", F.col("_known"))
                    .otherwise((F.col("level") == "all") | (F.col("all_orders") > 0)))
            .withColumn("category", F.when(F.col("level") != "all", F.col("category")))
            .select("level", "product_id", "product_name", "category", *FIGURES))


def summary(bundle: DataFrame, period: str) -> DataFrame:
    """K2 from the bundle."""
    w = PERIODS.get(period, "all")
    return bundle.filter(F.col("level") == "all").select(F.col(f"{w}_sales").alias("total_sales"),
                                                         F.col(f"{w}_orders").alias("total_transactions"))


def stat_strip(bundle: DataFrame, period: str) -> DataFrame:
    """K2b from the bundle."""
    w = PERIODS.get(period, "all")
    return bundle.filter(F.col("level") == "all").select(
        F.col("trailing7_sales").alias("weekly_sales"), F.col("monthly_sales"), F.col("daily_orders").alias("today_orders"),
        F.col(f"{w}_orders").alias("total_transactions"))


def top_sellers(bundle: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """The three K3 lists from the bundle."""
    per_product = bundle.filter(F.col("level") == "product").select("product_id", "product_name", *[
        F.col(f"{w}_{m}").alias(f"{short}_{w}") for w in rankings.TOP_WINDOWS
        for m, short in (("qty", "q"), ("sales", "r"), ("orders", "n"))])
    return rankings.window_lists(per_product, products.select("product_id", "image", "price", "category"), False, k)


def categories(bundle: DataFrame) -> DataFrame:
    """K5 and W1 from the bundle."""
    return rankings.ranked_categories(bundle.filter(F.col("level") == "category").select(
        "category", F.col("all_qty").alias("total_quantity"), F.col("all_sales").alias("total_sales")))
