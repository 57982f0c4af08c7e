"""Registered queries: period core, rankings, inventory, lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rankings
from .catalog import register

# ----------------------------------------------------------------------------- K5 + W1
# Add up days per product, look the product up after, and rank each category by how many are ahead of it.
register("category_ranking", "K5/W1", """
SELECT c.category, c.q AS total_quantity, c.t AS total_sales,
       1 + (SELECT COUNT(*) FROM (
              SELECT category AS other, SUM(done_total) AS ot FROM x_days JOIN x_products USING (product_id)
              WHERE done_sales > 0 GROUP BY other) o
            WHERE o.ot > c.t OR (o.ot = c.t AND o.other < c.category)) AS category_rank
FROM (SELECT category, CAST(SUM(q) AS BIGINT) AS q, CAST(SUM(t) AS DECIMAL(20,2)) AS t
      FROM (SELECT product_id, SUM(done_qty) AS q, SUM(done_total) AS t, SUM(done_sales) AS n FROM x_days GROUP BY product_id) d
      JOIN x_products USING (product_id) WHERE n > 0 GROUP BY category) c
""")(lambda t: rankings.category_ranking(t.sales, t.products))

from ..operators import filters, inventory, lists, metrics  # noqa: E402
from .catalog import AS_OF  # noqa: E402

_D = f"DATE '{AS_OF.isoformat()}'"
_TODAY = f"CAST(created_at AS DATE) = {_D}"
_WEEK7 = f"created_at >= {_D} - INTERVAL 6 DAY AND created_at < {_D} + INTERVAL 1 DAY"
_MONTH = f"month(created_at) = month({_D}) AND year(created_at) = year({_D})"
_ISOWEEK = f"yearweek(created_at) = yearweek({_D})"
_SALE = "sales_id, product_id, product_name, quantity, total, created_at, status, product_image"


def _sum_where(cond):
    return f"CAST(COALESCE((SELECT SUM(total) FROM x_sales WHERE status = 'Completed' AND {cond}), 0) AS DECIMAL(20,2))"


def _count_where(cond):
    return f"(SELECT COUNT(*) FROM x_sales WHERE status = 'Completed' AND {cond})"


# ----------------------------------------------------------------------------- F4, F5
register("period_daily", "F4", f"SELECT {_SALE} FROM x_sales WHERE {_TODAY}")(
    lambda t: filters.period_filter(t.sales, "daily", AS_OF))
register("period_iso_week", "F4", f"SELECT {_SALE} FROM x_sales WHERE {_ISOWEEK}")(
    lambda t: filters.period_filter(t.sales, "weekly", AS_OF))
register("period_month", "F4", f"SELECT {_SALE} FROM x_sales WHERE {_MONTH}")(
    lambda t: filters.period_filter(t.sales, "monthly", AS_OF))
register("period_all", "F4", f"SELECT {_SALE} FROM x_sales")(
    lambda t: filters.period_filter(t.sales, "all", AS_OF))
register("trailing_7_days", "F5", f"SELECT {_SALE} FROM x_sales WHERE {_WEEK7}")(
    lambda t: filters.trailing_days(t.sales, AS_OF, 7))

# ----------------------------------------------------------------------------- K1, K2, K2b, K6, P5
register("dashboard_kpis", "K1/F6/F7", f"""
SELECT {_sum_where(_TODAY)} AS daily_sales, {_sum_where(_WEEK7)} AS weekly_sales,
       {_sum_where(_MONTH)} AS monthly_sales, {_count_where(_TODAY)} AS today_orders,
       CAST({_sum_where(_MONTH)} * 1.1 AS DECIMAL(23,3)) AS monthly_estimate
""")(lambda t: metrics.dashboard_kpis(t.sales, AS_OF))

register("monthly_estimate", "P5", f"""
SELECT {_sum_where(_MONTH)} AS monthly_sales, CAST({_sum_where(_MONTH)} * 1.1 AS DECIMAL(23,3)) AS monthly_estimate
""")(lambda t: metrics.monthly_estimate(t.sales, AS_OF))

register("report_summary", "K2", f"""
SELECT CAST(COALESCE(SUM(total), 0) AS DECIMAL(20,2)) AS total_sales, COUNT(*) AS total_transactions
FROM x_sales WHERE status = 'Completed' AND {_MONTH}
""")(lambda t: metrics.report_summary(t.sales, "monthly", AS_OF))

register("report_stat_strip", "K2b", f"""
SELECT {_sum_where(_WEEK7)} AS weekly_sales, {_sum_where(_MONTH)} AS monthly_sales,
       {_count_where(_TODAY)} AS today_orders, {_count_where(_ISOWEEK)} AS total_transactions
""")(lambda t: metrics.report_stat_strip(t.sales, "weekly", AS_OF))

register("sales_page_totals", "K6", """
SELECT CAST(COALESCE(SUM(total), 0) AS DECIMAL(20,2)) AS total_sales, COUNT(*) AS total_transactions
FROM x_sales WHERE status = 'Completed'
""")(lambda t: metrics.sales_page_totals(t.sales))


# ----------------------------------------------------------------------------- K3, K4
_DAY_TODAY = f"day = {_D}"
_DAY_WEEK7 = f"{_D} - day BETWEEN 0 AND 6"
_DAY_MONTH = f"strftime(day, '%Y%m') = strftime({_D}, '%Y%m')"


def _top_sql(days, completed, image):
    """Days added up per product; the ten with the smallest (-quantity, id, name) are kept as a heap of structs,
    and only those are looked up in the catalogue. No id sorts last."""
    kind = "done" if completed else "any"
    shown = "AND product_id IN (SELECT product_id FROM x_products WHERE length(image) > 0)" if image else ""
    return f"""
SELECT k.product_id, k.product_name, -k.less AS qty_sold, k.revenue, p.image, p.price, p.category
FROM (SELECT unnest(min({{'less': -q, 'last': product_id IS NULL, 'product_id': product_id, 'product_name': product_name,
                          'revenue': r}}, 10), recursive := true)
      FROM (SELECT product_id, product_name, CAST(SUM({kind}_qty) AS BIGINT) AS q, CAST(SUM({kind}_total) AS DECIMAL(20,2)) AS r
            FROM x_days WHERE {kind}_sales > 0 AND {days} {shown} GROUP BY product_id, product_name) t) k
LEFT JOIN x_products p USING (product_id)"""


for _name, _win, _cond in (("daily", "daily", _DAY_TODAY), ("trailing7", "trailing7", _DAY_WEEK7),
                           ("month", "monthly", _DAY_MONTH)):
    register(f"top_{_name}", "K3/O4/J3", _top_sql(_cond, True, False))(
        lambda t, w=_win: rankings.top_products(t.sales, t.products, AS_OF, w, completed_only=True))
    register(f"top_{_name}_all_status", "K4/F11/J3", _top_sql(_cond, False, True))(
        lambda t, w=_win: rankings.top_products(t.sales, t.products, AS_OF, w, completed_only=False,
                                                require_image=True))



def _spelled(products):
    """The catalogue with names as people type them: accents on some, a backslash for the blank on others."""
    key, name = F.col("product_id"), F.col("product_name")
    return products.withColumn("product_name", F.when(key % 5 == 0, F.replace(name, F.lit(" "), F.lit("\\")))
                               .when(key % 3 == 0, F.translate(name, "aeioRB", "\u00e1\u00eb\u00ee\u00f4rb")).otherwise(name))


_SPELLED = """(SELECT * REPLACE (CASE WHEN product_id % 5 = 0 THEN replace(product_name, ' ', chr(92))
  WHEN product_id % 3 = 0 THEN translate(product_name, 'aeioRB', '\u00e1\u00eb\u00ee\u00f4rb') ELSE product_name END AS product_name)
FROM x_products)"""

# A backslash before a letter stands for itself.
register("product_search_backslash", "F1", f"SELECT * FROM {_SPELLED} s WHERE contains(product_name, chr(92) || 'w')")(
    lambda t: filters.product_search(_spelled(t.products), "\\w"))
# Accents count on neither side; "%" stands for any run and "_" for one letter.
register("product_search_accents", "F1", f"""
SELECT * FROM {_SPELLED} s WHERE regexp_matches(strip_accents(product_name), 'r.d.*w.dget', 'i')""")(
    lambda t: filters.product_search(_spelled(t.products), "R_d%w_dgêt"))

# ----------------------------------------------------------------------------- inventory
_ING = "ingredient_id, ingredient_name, stock, low_stock_threshold, unit, image"
register("stock_low", "F8", f"SELECT {_ING} FROM x_ingredients WHERE stock <= low_stock_threshold")(
    lambda t: filters.stock_level_filter(t.ingredients, "low"))
register("stock_mid", "F8", f"""SELECT {_ING} FROM x_ingredients
WHERE stock > low_stock_threshold AND stock <= low_stock_threshold * 3""")(
    lambda t: filters.stock_level_filter(t.ingredients, "mid"))
register("stock_high", "F8", f"SELECT {_ING} FROM x_ingredients WHERE stock > low_stock_threshold * 3")(
    lambda t: filters.stock_level_filter(t.ingredients, "high"))
register("low_stock_alerts", "F9", """
SELECT ingredient_name AS label, stock, low_stock_threshold FROM x_shelf WHERE shelf = 'short'""")(
    lambda t: filters.low_stock_alerts(t.ingredients))
register("low_stock_count", "K7", """
SELECT COUNT(*) AS low_stock_count FROM x_ingredients WHERE stock <= low_stock_threshold""")(
    lambda t: inventory.low_stock_count(t.ingredients))

_CARD = """CASE WHEN stock IS NULL THEN 'low'
  WHEN low_stock_threshold IS NULL THEN CASE WHEN stock = 0 THEN 'low' WHEN stock < 0 THEN 'mid' ELSE 'high' END
  WHEN stock <= low_stock_threshold THEN 'low' WHEN stock <= low_stock_threshold * 3 THEN 'mid' ELSE 'high' END"""


def _thr_class(a, b, c):
    return f"""CASE WHEN stock IS NULL OR stock <= COALESCE(low_stock_threshold, 5) THEN '{a}'
  WHEN stock <= COALESCE(low_stock_threshold, 5) * 3 THEN '{b}' ELSE '{c}' END"""


_UNIT_LABEL = "concat(upper(substr(COALESCE(unit, 'Other'), 1, 1)), substr(COALESCE(unit, 'Other'), 2), '-based')"

register("stock_class", "P3", f"""
SELECT ingredient_id, ingredient_name, stock, low_stock_threshold, {_CARD} AS card_class,
       {_thr_class('badge-bad', 'badge-mid', 'badge-good')} AS report_class,
       {_thr_class('Low', 'Normal', 'High')} AS dashboard_label
FROM x_ingredients""")(lambda t: inventory.stock_class(t.ingredients))
register("stock_pct", "P4", """
SELECT ingredient_id, stock, low_stock_threshold,
       CAST(least(100, round(COALESCE(stock, 0) / greatest(COALESCE(low_stock_threshold, 0) * 3, 1) * 100)) AS INT) AS stock_pct
FROM x_ingredients""")(lambda t: inventory.stock_pct(t.ingredients))
register("unit_label", "P7", f"SELECT ingredient_id, unit, {_UNIT_LABEL} AS unit_label FROM x_ingredients")(
    lambda t: inventory.unit_labels(t.ingredients))
register("unit_options", "K8", f"""
SELECT unit_label, stock AS first_stock, ingredient_id AS first_ingredient_id,
       row_number() OVER (ORDER BY stock ASC NULLS FIRST, ingredient_id) AS option_rank
FROM (SELECT {_UNIT_LABEL} AS unit_label, stock, ingredient_id,
             row_number() OVER (PARTITION BY {_UNIT_LABEL} ORDER BY stock ASC NULLS FIRST, ingredient_id) AS rn
      FROM x_ingredients) l
WHERE rn = 1""")(lambda t: inventory.unit_options(t.ingredients))
register("inventory_report_filtered", "F12", f"""
SELECT * FROM (
  SELECT ingredient_id, ingredient_name, stock, COALESCE(low_stock_threshold, 5) AS threshold_shown,
         {_thr_class('badge-bad', 'badge-mid', 'badge-good')} AS report_class, {_UNIT_LABEL} AS unit_label
  FROM x_ingredients) r
WHERE report_class = 'badge-mid' AND unit_label = 'Box-based-based'""")(
    lambda t: inventory.inventory_report(t.ingredients, "badge-mid", "Box-based-based"))
register("inventory_by_stock", "O1", f"""
SELECT ingredient_id, ingredient_name, unit, stock, COALESCE(low_stock_threshold, 5) AS threshold_shown,
       {_thr_class('Low', 'Normal', 'High')} AS dashboard_label
FROM x_ingredients ORDER BY stock ASC NULLS FIRST, ingredient_id""")(
    lambda t: inventory.inventory_by_stock(t.ingredients))

# ----------------------------------------------------------------------------- searches and lists
register("product_search", "F1", """
SELECT * FROM x_products WHERE product_name ILIKE '%Blue%' AND lower(category) = 'small' AND lower(status) = 'available'""")(
    lambda t: filters.product_search(t.products, " Blue ", "small", "available"))
register("ingredient_search", "F2", """
SELECT * FROM x_ingredients WHERE ingredient_name ILIKE '%gear%' AND lower(unit) = 'box-based'
  AND stock > low_stock_threshold AND stock <= low_stock_threshold * 3""")(
    lambda t: filters.ingredient_search(t.ingredients, "gear", "box-based", "mid"))

def _listed(where="TRUE"):
    """Sales whose product is in the catalogue, then those whose product is not."""
    return f"""
SELECT {_SALE}, category AS product_category
FROM (SELECT * FROM x_sales WHERE {where}) JOIN (SELECT product_id, category FROM x_products) USING (product_id)
UNION ALL
SELECT {_SALE}, NULL FROM x_sales WHERE {where} AND (product_id IN (SELECT product_id FROM x_products)) IS NOT TRUE"""


register("sales_list", "J1", _listed())(
    lambda t: lists.sales_list(t.sales, t.products))
register("sales_search", "F3", _listed("contains(lower(product_name), 'red')"))(
    lambda t: lists.sales_list(filters.sales_search(t.sales, "red", None), t.products))
register("sales_search_day", "F3", _listed(_TODAY))(
    lambda t: lists.sales_list(filters.sales_search(t.sales, None, AS_OF.isoformat()), t.products))
register("available_products", "F10", """
SELECT id AS product_id, name AS product_name, category, price FROM x_menu WHERE kind = 'product'""")(
    lambda t: filters.available_products(t.products))
register("available_addons", "F10", """
SELECT id AS addon_id, name AS addon_name, price FROM x_menu WHERE kind = 'addon'""")(
    lambda t: filters.available_addons(t.addons))

register("sales_with_addons", "J4/P6", """
SELECT s.sales_id, s.product_name, s.quantity, s.total, s.created_at, s.status, a.addon_id, a.addon_name,
       a.price AS addon_price, (a.sale_id IS NOT NULL) AS incl_addons
FROM x_sales s LEFT JOIN x_sale_addons a ON a.sale_id = s.sales_id""")(
    lambda t: lists.sales_with_addons(t.sales, t.sale_addons))

_UNIT_PRICE = """CAST(CAST((CAST(s.total * 100 AS BIGINT) * 2 + greatest(s.quantity, 1)) // (2 * greatest(s.quantity, 1))
  AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2))"""
register("sales_addon_rollup", "J4/K9/P6", f"""
SELECT s.sales_id, COALESCE(a.n, 0) AS addon_count, CAST(COALESCE(a.t, 0) AS DECIMAL(20,2)) AS addon_total,
       COALESCE(a.n, 0) > 0 AS incl_addons, {_UNIT_PRICE} AS unit_price
FROM x_sales s LEFT JOIN (SELECT sale_id, COUNT(*) AS n, SUM(price) AS t FROM x_sale_addons GROUP BY sale_id) a
  ON a.sale_id = s.sales_id""")(lambda t: lists.sales_addon_rollup(t.sales, t.sale_addons))
register("sale_unit_price", "P1", f"SELECT s.sales_id, s.quantity, s.total, {_UNIT_PRICE} AS unit_price FROM x_sales s")(
    lambda t: lists.sale_unit_price(t.sales))
register("status_badge", "P2", """
SELECT sales_id, status, CASE lower(status) WHEN 'completed' THEN 'completed' WHEN 'void' THEN 'void'
  WHEN 'cancelled' THEN 'cancelled' WHEN 'canceled' THEN 'cancelled' ELSE 'pending' END AS badge FROM x_sales""")(
    lambda t: lists.sale_status_badges(t.sales))
register("money_text", "P8", """
SELECT sales_id, total, '₱' || format('{:,.2f}', CAST(round(total, 2) AS DOUBLE)) AS total_text,
       '₱' || format('{:,.0f}', CAST(round(total, 0) AS DOUBLE)) AS total_text_whole FROM x_sales""")(
    lambda t: lists.sales_money_text(t.sales))
register("report_transactions", "O2", f"""
SELECT sales_id, product_name, quantity, total, created_at, status FROM x_sales
WHERE status = 'Completed' AND {_MONTH} ORDER BY created_at DESC""")(
    lambda t: lists.report_transactions(t.sales, "monthly", AS_OF))
register("audit_recent", "O3", """
SELECT * FROM x_audit ORDER BY created_at DESC, log_id DESC LIMIT 20""")(
    lambda t: lists.audit_recent(getattr(t, "audit_logs_by_month", t.audit_logs), 20))
register("user_list", "S1", "SELECT user_id, username, role, fullname, status, avatar FROM x_users")(
    lambda t: lists.user_list(t.users))

register("top_month_display", "K3/P8/P9", f"""
SELECT product_id, product_name, COALESCE(category, '—') AS category_shown,
       '₱' || format('{{:,.0f}}', CAST(round(COALESCE(price, 0), 0) AS DOUBLE)) AS price_text, qty_sold,
       '₱' || format('{{:,.0f}}', CAST(round(revenue, 0) AS DOUBLE)) AS revenue_text
FROM ({_top_sql(_DAY_MONTH, True, False)}) t""")(
    lambda t: lists.top_products_display(rankings.top_products(t.sales, t.products, AS_OF, "monthly")))


def _top_window_sql(label, cond):
    return f"""SELECT '{label}' AS top_window, *, row_number() OVER (ORDER BY qty_sold DESC, product_id ASC NULLS LAST,
       product_name ASC NULLS FIRST) AS top_rank FROM ({_top_sql(cond, False, True)}) x"""


register("dashboard_top_sellers", "K4/O4 (one scan)", "\nUNION ALL\n".join(
    _top_window_sql(w, c) for w, c in (("daily", _DAY_TODAY), ("trailing7", _DAY_WEEK7), ("monthly", _DAY_MONTH))))(
    lambda t: rankings.top_products_windows(t.sales, t.products, AS_OF, completed_only=False, require_image=True))


def _report_top_window_sql(label, cond):
    return f"""SELECT '{label}' AS top_window, *, row_number() OVER (ORDER BY qty_sold DESC, product_id ASC NULLS LAST,
       product_name ASC NULLS FIRST) AS top_rank FROM ({_top_sql(cond, True, False)}) x"""


register("report_top_sellers", "K3/O4/J3 (one scan)", "\nUNION ALL\n".join(
    _report_top_window_sql(w, c) for w, c in (("daily", _DAY_TODAY), ("trailing7", _DAY_WEEK7), ("monthly", _DAY_MONTH))))(
    lambda t: rankings.top_products_windows(t.sales, t.products, AS_OF, completed_only=True, require_image=False))


# ----------------------------------------------------------------------------- the report page from one scan
from ..operators import bundles  # noqa: E402

_WINDOWS = {"daily": _DAY_TODAY, "trailing7": _DAY_WEEK7, "isoweek": f"strftime(day, '%G%V') = strftime({_D}, '%G%V')",
            "monthly": _DAY_MONTH, "all": "TRUE"}
_FIGURES = ", ".join(f"""CAST(COALESCE(SUM(done_qty) FILTER (WHERE {c}), 0) AS BIGINT) AS {w}_qty,
  CAST(COALESCE(SUM(done_total) FILTER (WHERE {c}), 0) AS DECIMAL(20,2)) AS {w}_sales,
  CAST(COALESCE(SUM(done_sales) FILTER (WHERE {c}), 0) AS BIGINT) AS {w}_orders""" for w, c in _WINDOWS.items())
_DONE = "(SELECT * FROM x_days WHERE done_sales > 0)"
register("report_bundle", "K2/K2b/K3/K5 (one scan)", f"""
SELECT 'product' AS level, d.product_id, d.product_name, ANY_VALUE(p.category) AS category, {_FIGURES}
FROM {_DONE} d LEFT JOIN x_products p USING (product_id) GROUP BY d.product_id, d.product_name
UNION ALL SELECT 'category', NULL, NULL, category, {_FIGURES} FROM {_DONE} d JOIN x_products USING (product_id) GROUP BY category
UNION ALL SELECT 'all', NULL, NULL, NULL, {_FIGURES} FROM {_DONE} d""")(
    lambda t: bundles.report_bundle(t.sales, t.products, AS_OF))
