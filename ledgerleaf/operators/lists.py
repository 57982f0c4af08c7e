"""Row lists of the sales, report and admin pages.

The sales page shows each sale with its list of add-ons. A per-sale array
(``collect_list``) would pull a sale's whole group into one task and one row,
so the detail is kept in long form (one row per sale and add-on, joins that
AQE can split when one sale is hot), and the per-sale summary (count, add-on
total, "incl. add-ons") comes from a partial aggregate joined 1:1.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import money_text, status_badge
from ..functions.time import period_predicate
from ..sources.schemas import LOG_PARTITION, MONEY_SUM
from .filters import is_completed

# Fixed value: what the tables show for a missing category.
MISSING_CATEGORY = "—"

SALE_COLS = ["sales_id", "product_id", "product_name", "quantity", "total", "created_at", "status", "product_image"]


def sales_list(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Every sale with its product's category (NULL if the product is gone), newest first."""
    cat = products.select("product_id", F.col("category").alias("product_category"))
    return (sales.join(cat, "product_id", "left")
            .select(*SALE_COLS, "product_category")
            .orderBy(F.col("created_at").desc_nulls_last(), F.col("sales_id").desc()))


def sale_unit_price(sales: DataFrame) -> DataFrame:
    """Average unit price including add-ons, ``total / max(quantity, 1)`` to cents."""
    unit = F.round(F.col("total") / F.greatest(F.col("quantity"), F.lit(1)), 2).cast("decimal(12,2)")
    return sales.select("sales_id", "quantity", "total", unit.alias("unit_price"))


def sale_status_badges(sales: DataFrame) -> DataFrame:
    """P2."""
    return sales.select("sales_id", "status", status_badge("status").alias("badge"))


def sales_money_text(sales: DataFrame) -> DataFrame:
    """The total as shown on the sales page (2 places) and the dashboard (0 places)."""
    return sales.select("sales_id", "total",
                        money_text("total", 2).alias("total_text"),
                        money_text("total", 0).alias("total_text_whole"))


def addon_summary(sale_addons: DataFrame) -> DataFrame:
    """Per sale: number of add-on lines and their price total (partial aggregate)."""
    return (sale_addons.groupBy("sale_id")
            .agg(F.count(F.lit(1)).alias("addon_count"), F.sum("price").cast(MONEY_SUM).alias("addon_total")))


def sales_with_addons(sales: DataFrame, sale_addons: DataFrame) -> DataFrame:
    """J4 + P6 in long form: one row per (sale, add-on); a sale without add-ons keeps one row with NULLs.

    Written as inner join UNION ALL anti join rather than one LEFT join: AQE can
    split a skewed partition of an inner join on either side, while a LEFT join
    could only split the sales side, and the add-on side is the one a hot sale
    would skew. The anti join reads distinct sale ids, so a hot sale is one row.
    """
    base = sales.select("sales_id", "product_name", "quantity", "total", "created_at", "status")
    lines = sale_addons.select(F.col("sale_id").alias("sales_id"), "addon_id", "addon_name",
                               F.col("price").alias("addon_price"))
    with_lines = base.join(lines, "sales_id").withColumn("incl_addons", F.lit(True))
    has_lines = sale_addons.select(F.col("sale_id").alias("sales_id")).distinct()
    without = (base.join(has_lines, "sales_id", "left_anti")
               .select("*", F.lit(None).cast(lines.schema["addon_id"].dataType).alias("addon_id"),
                       F.lit(None).cast("string").alias("addon_name"),
                       F.lit(None).cast(lines.schema["addon_price"].dataType).alias("addon_price"),
                       F.lit(False).alias("incl_addons")))
    return with_lines.unionByName(without)


def sales_addon_rollup(sales: DataFrame, sale_addons: DataFrame) -> DataFrame:
    """J4 per sale: add-on count and total, "incl. add-ons" flag, unit price."""
    summ = addon_summary(sale_addons).withColumnRenamed("sale_id", "sales_id")
    unit = F.round(F.col("total") / F.greatest(F.col("quantity"), F.lit(1)), 2).cast("decimal(12,2)")
    return (sales.select("sales_id", "quantity", "total").join(summ, "sales_id", "left")
            .select("sales_id",
                    F.coalesce("addon_count", F.lit(0)).alias("addon_count"),
                    F.coalesce("addon_total", F.lit(0)).cast(MONEY_SUM).alias("addon_total"),
                    (F.coalesce("addon_count", F.lit(0)) > 0).alias("incl_addons"),
                    unit.alias("unit_price")))


def top_products_display(top: DataFrame, decimals: int = 0) -> DataFrame:
    """P8 + P9 on a best-seller list: missing category shown as a dash, missing price as 0, money as text.

    A list that carries ``top_rank`` keeps it and is in that order. The dashboard prints whole pesos (``decimals=0``), the report two places.
    """
    keep = ["top_rank"] if "top_rank" in top.columns else []
    shown = top.orderBy("top_rank") if keep else top
    return shown.select(
        *keep, "product_id", "product_name",
        F.coalesce(F.col("category"), F.lit(MISSING_CATEGORY)).alias("category_shown"),
        money_text(F.coalesce(F.col("price"), F.lit(0).cast("decimal(10,2)")), decimals).alias("price_text"),
        "qty_sold", money_text("revenue", decimals).alias("revenue_text"))


def report_transactions(sales: DataFrame, period: str, as_of) -> DataFrame:
    """O2: completed sales of the period, newest first (the export's rows)."""
    s = sales.filter(is_completed())
    p = period_predicate(sales, period, as_of)
    if p is not None:
        s = s.filter(p)
    return (s.select("sales_id", "product_name", "quantity", "total", "created_at", "status")
            .orderBy(F.col("created_at").desc_nulls_last(), F.col("sales_id").desc()))


def audit_recent(audit_logs: DataFrame, n: int = 20) -> DataFrame:
    """O3: the latest ``n`` audit rows (a top-k: a k-row heap per task).

    A log with its month column (``StoredTables.audit_logs_by_month``) is opened newest month first: the names of its
    folders, known from the file listing, give the months, and one, two, four... of them are looked into until they
    hold ``n`` rows. Rows without a time come last, so they are read only if all months together are too few.
    """
    order = [F.col("created_at").desc_nulls_last(), F.col("log_id").desc()]
    if LOG_PARTITION not in audit_logs.columns:
        return audit_logs.orderBy(*order).limit(n)
    folders = {m for f in audit_logs.inputFiles() for m in re.findall(rf"/{LOG_PARTITION}=(\d{{4}}-\d\d-\d\d)/", f)}
    months = sorted(folders, reverse=True)
    opened = 1
    while opened <= len(months):
        newest = audit_logs.filter(F.col(LOG_PARTITION) >= F.lit(dt.date.fromisoformat(months[opened - 1])))
        if newest.limit(n).count() == n:
            return newest.drop(LOG_PARTITION).orderBy(*order).limit(n)
        opened *= 2
    return audit_logs.drop(LOG_PARTITION).orderBy(*order).limit(n)


def user_list(users: DataFrame) -> DataFrame:
    """The staff list, without any credential column."""
    return users.select("user_id", "username", "role", "fullname", "status", "avatar")
