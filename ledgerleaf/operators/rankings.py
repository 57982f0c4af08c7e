"""Best sellers (K3, K4) and category ranking.

Both aggregate ``sales`` before touching ``products``: the partial hash
aggregate collapses each task's rows to one per product before the shuffle, so
the join that follows is between two frames bounded by the product catalogue,
not by the ledger. Price, image and category depend on ``product_id`` only,
so grouping by the sale's own columns first gives the pages' six-column
``GROUP BY`` result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number
from ..functions.time import as_date, month_start, next_month_start, trailing_bounds, DAY, in_range
from ..sources.schemas import MONEY_SUM
from .filters import TEXT_COLLATION, is_completed

# The time windows of the best-seller lists.
TOP_WINDOWS = ("daily", "trailing7", "monthly")


def window_bounds(window: str, as_of):
    d = as_date(as_of)
    if window == "daily":
        return d, d + DAY
    if window == "trailing7":
        return trailing_bounds(d, 7)
    if window == "monthly":
        return month_start(d), next_month_start(d)
    raise ValueError(f"unknown window {window!r}; expected one of {TOP_WINDOWS}")


def top_order() -> list[Column]:
    """Quantity first; ties broken by product id then name so every engine agrees."""
    return [F.col("qty_sold").desc(), F.col("product_id").asc_nulls_last(),
            F.col("product_name").asc_nulls_first()]


def top_products(sales: DataFrame, products: DataFrame, as_of, window: str = "daily",
                 completed_only: bool = True, require_image: bool = False, k: int = 10) -> DataFrame:
    """Top ``k`` products by quantity sold in the window.

    ``completed_only`` is the report's rule; the dashboard counts every status
    and keeps only products with an image (its LEFT JOIN plus image test is in
    effect an inner join).
    """
    s = sales.filter(in_range(sales, "created_at", *window_bounds(window, as_of)))
    if completed_only:
        s = s.filter(is_completed())
    agg = (s.groupBy("product_id", "product_name")
           .agg(F.sum("quantity").alias("qty_sold"), F.sum("total").cast(MONEY_SUM).alias("revenue")))
    dim = products.select("product_id", "image", "price", "category")
    cols = ["product_id", "product_name", "qty_sold", "revenue", "image", "price", "category"]
    if require_image:
        ranked = agg.join(dim.filter(F.col("image").isNotNull() & (F.col("image") != "")), "product_id")
        return ranked.select(*cols).orderBy(*top_order()).limit(k)
    # LEFT JOIN: cut to k rows first (TakeOrderedAndProject keeps a k-row heap per
    # task), then look the k ids up in the catalogue.
    top = agg.orderBy(*top_order()).limit(k)
    return top.join(_of_few(dim, top), "product_id", "left").select(*cols).orderBy(*top_order())


def _of_few(dim: DataFrame, top: DataFrame) -> DataFrame:
    """The catalogue rows of a top list's ids. The list has at most a few rows by construction, so both it and
    what it selects are broadcast, and the catalogue is streamed once and never shuffled."""
    return F.broadcast(dim.join(F.broadcast(top.select("product_id").distinct()), "product_id", "left_semi"))


def top_products_windows(sales: DataFrame, products: DataFrame, as_of, completed_only: bool = False,
                         require_image: bool = True, k: int = 10) -> DataFrame:
    """The three best-seller lists of a page (daily, trailing 7 days, month) from one scan.

    One range filter covering all three windows is pushed to the scan; one
    partial+final aggregate per product carries a conditional quantity, revenue
    and row count per window. Its rows are unpivoted to (window, product) and
    each window keeps its first ``k`` by ``row_number``; Spark plans that as a
    per-group limit (``WindowGroupLimit``) applied before the shuffle too, so no
    task ever holds a whole window's products.
    """
    bounds = {w: window_bounds(w, as_of) for w in TOP_WINDOWS}
    lo, hi = min(b[0] for b in bounds.values()), max(b[1] for b in bounds.values())
    s = sales.filter(in_range(sales, "created_at", lo, hi))
    if completed_only:
        s = s.filter(is_completed())
    aggs = []
    for w, (a, b) in bounds.items():
        inside = in_range(sales, "created_at", a, b, prune=False)
        aggs += [F.sum(F.when(inside, F.col("quantity"))).alias(f"q_{w}"),
                 F.sum(F.when(inside, F.col("total"))).cast(MONEY_SUM).alias(f"r_{w}"),
                 F.count(F.when(inside, F.lit(1))).alias(f"n_{w}")]
    agg = s.groupBy("product_id", "product_name").agg(*aggs)
    dim = products.select("product_id", "image", "price", "category")
    return window_lists(agg, dim, require_image, k)


def window_lists(agg: DataFrame, dim: DataFrame, require_image: bool, k: int = 10) -> DataFrame:
    """The best-seller lists from one row per product with ``q_``, ``r_`` and ``n_`` (quantity, revenue, sales) of each window."""
    if require_image:
        agg = agg.join(dim.filter(F.col("image").isNotNull() & (F.col("image") != "")), "product_id")
    per_window = F.array(*[F.struct(F.lit(w).alias("top_window"), F.col(f"q_{w}").alias("qty_sold"),
                                    F.col(f"r_{w}").alias("revenue"), F.col(f"n_{w}").alias("n"))
                           for w in TOP_WINDOWS])
    keep = ["product_id", "product_name"] + (["image", "price", "category"] if require_image else [])
    long = (agg.select(*keep, F.inline(per_window))
            .filter(F.col("n") > 0).drop("n"))
    rank = F.row_number().over(Window.partitionBy("top_window").orderBy(*top_order()))
    lists = long.withColumn("top_rank", rank.cast("long")).filter(F.col("top_rank") <= k)
    if not require_image:
        lists = lists.join(_of_few(dim, lists), "product_id", "left")
    return lists.select("top_window", "product_id", "product_name", "qty_sold", "revenue", "image", "price",
                        "category", "top_rank")


def category_ranking(sales: DataFrame, products: DataFrame) -> DataFrame:
    """All-time completed quantity and sales per category, ranked by sales.

    Categories that differ in case or accents only are one, under the smallest
    spelling. Sales whose product was deleted (NULL or unknown id) drop out, as in the
    report's inner join. Ranks are 1, 2, 3... with ties numbered apart.
    """
    per_product = (sales.filter(is_completed() & F.col("product_id").isNotNull())
                   .groupBy("product_id")
                   .agg(F.sum("quantity").alias("q"), F.sum("total").alias("t")))
    per_cat = (per_product.join(products.select("product_id", "category"), "product_id")
               .groupBy(F.collate("category", TEXT_COLLATION).alias("_c"))
               .agg(F.min("category").alias("category"), F.sum("q").alias("total_quantity"), F.sum("t").cast(MONEY_SUM).alias("total_sales")))
    return ranked_categories(per_cat.drop("_c"))


def ranked_categories(per_cat: DataFrame) -> DataFrame:
    return global_row_number(
        per_cat, [F.col("total_sales").desc(), F.col("category").asc_nulls_first()], name="category_rank")
