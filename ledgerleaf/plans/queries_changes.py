"""Registered queries: table changes with rejects (M1-M9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, referential, rollup
from ..operators.filters import declared
from .catalog import ACTOR, AS_OF, RUN_TS, register

_RUN = f"TIMESTAMP '{RUN_TS.isoformat(sep=' ')}'"
_SALE = "sales_id, product_id, product_name, quantity, total, created_at, status, product_image"
_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"

# ----------------------------------------------------------------------------- M1
_FOUND = """SELECT r.request_id FROM x_sale_requests r JOIN x_products p ON p.product_id = r.product_id
  WHERE r.product_id > 0 AND r.quantity > 0 AND p.product_name IS NOT NULL AND p.product_name NOT IN ('', '0')"""
_LINES = """(SELECT d.request_id, ad.addon_id, ad.addon_name, ad.price
   FROM (SELECT DISTINCT request_id, addon_id FROM x_request_addons) d
   JOIN x_addons ad ON ad.addon_id = d.addon_id AND ad.status = 'Available')"""


def _m1(t):
    return changes.record_sales(t.sale_requests, t.request_addons, t.products, t.addons, RUN_TS)


_PRICED = f"""(SELECT r.request_id, r.product_id, p.product_name, r.quantity, p.image,
    r.quantity * (COALESCE(p.price, 0) + COALESCE(a.t, 0)) AS wide_total
  FROM x_sale_requests r JOIN x_products p ON p.product_id = r.product_id
  LEFT JOIN (SELECT request_id, SUM(price) AS t FROM {_LINES} l GROUP BY request_id) a ON a.request_id = r.request_id
  WHERE r.product_id > 0 AND r.quantity > 0 AND p.product_name IS NOT NULL AND p.product_name NOT IN ('', '0'))"""
_HELD = f"SELECT request_id FROM {_PRICED} w WHERE wide_total < 100000000"

register("price_sales", "M1/J5/J6/K9", f"""
SELECT request_id AS sales_id, product_id, product_name, quantity, CAST(wide_total AS DECIMAL(10,2)) AS total,
       {_RUN} AS created_at, 'Completed' AS status, image AS product_image
FROM {_PRICED} w WHERE wide_total < 100000000
""")(lambda t: _m1(t)["sales"])
register("price_sale_addons", "M1/J5", f"""
SELECT l.request_id AS sale_id, l.addon_id, l.addon_name, l.price FROM {_LINES} l
WHERE l.request_id IN ({_HELD})
""")(lambda t: _m1(t)["sale_addons"])
register("price_rejects", "M1/J6", f"""
SELECT request_id, CASE WHEN product_id IS NULL OR product_id <= 0 OR quantity IS NULL OR quantity <= 0
                        THEN 'Invalid product or quantity.'
                        WHEN request_id IN ({_FOUND}) THEN 'Total out of range.' ELSE 'Product not found.' END AS reason
FROM x_sale_requests WHERE request_id NOT IN ({_HELD})
""")(lambda t: _m1(t)["rejects"])

# ----------------------------------------------------------------------------- M2, M3
register("cancel_sales", "M2/J7", """
SELECT sales_id, product_id, product_name, quantity, total, created_at,
       CASE WHEN status = 'Completed' AND sales_id IN (SELECT sales_id FROM x_cancel_requests) THEN 'Cancelled'
            ELSE status END AS status, product_image
FROM x_sales""")(lambda t: declared(changes.cancel_sales(t.sales, t.cancel_requests)))


def _m3(t):
    return changes.resolve_voids(t.sales, t.void_requests, t.sales_void, RUN_TS)


register("void_sales", "M3", """
SELECT sales_id, product_id, product_name, quantity, total, created_at,
       CASE WHEN sales_id IN (SELECT sales_id FROM x_void_requests WHERE sales_id > 0) THEN 'VOID' ELSE status END AS status,
       product_image
FROM x_sales""")(lambda t: declared(changes.apply_voids(t.sales, t.void_requests)))
register("void_ledger", "M3", f"""
SELECT request_id AS void_id, sales_id AS sale_id, trim(reason, {_TRIM}) AS reason, {_RUN} AS voided_at
FROM x_void_requests WHERE sales_id > 0 AND sales_id IN (SELECT sales_id FROM x_sales)""")(
    lambda t: _m3(t)["sales_void"])
register("void_rejects", "M3", """
SELECT request_id, CASE WHEN sales_id IS NULL OR sales_id <= 0 THEN 'Invalid sale.' ELSE 'Unknown sale.' END AS reason
FROM x_void_requests WHERE sales_id IS NULL OR sales_id <= 0 OR sales_id NOT IN (SELECT sales_id FROM x_sales)""")(
    lambda t: _m3(t)["rejects"])


# ----------------------------------------------------------------------------- M4, M5, M8
def _latest(feed, key, cond):
    return (f"(SELECT * FROM {feed} WHERE {cond} "
            f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY seq DESC) = 1)")


def _upsert_sql(cur, feed, key, plain, image_col, name_col=None, ok="TRUE"):
    """Latest add/delete per key decides life; a later edit wins per field; an empty image keeps the old."""
    feed_ok = f"(SELECT * FROM {feed} WHERE {ok})"
    cols = []
    for c in plain:
        v_ed, v_ad = f"ed.{c}", f"ad.{c}"
        if c == name_col:
            v_ed, v_ad = f"trim(ed.{c}, {_TRIM})", f"trim(ad.{c}, {_TRIM})"
        cols.append(f"CASE WHEN ed.seq IS NOT NULL AND (ad.seq IS NULL OR ed.seq > ad.seq) THEN {v_ed} "
                    f"WHEN ad.seq IS NOT NULL THEN {v_ad} ELSE c.{c} END AS {c}")
    if image_col:
        cols.append(f"CASE WHEN im.seq IS NOT NULL AND (ad.seq IS NULL OR im.seq > ad.seq) THEN im.{image_col} "
                    f"WHEN ad.seq IS NOT NULL THEN COALESCE(ad.{image_col}, '') ELSE c.{image_col} END AS {image_col}")
    im_join = ""
    if image_col:
        im_join = (f"LEFT JOIN {_latest(feed_ok, key, f"op = 'edit' AND {image_col} IS NOT NULL AND {image_col} NOT IN ('', '0')")} im "
                   f"ON im.{key} = k.{key}")
    return f"""
SELECT k.{key}, {', '.join(cols)}
FROM (SELECT {key} FROM {cur} UNION SELECT {key} FROM {feed_ok}) k
LEFT JOIN {cur} c ON c.{key} = k.{key}
LEFT JOIN {_latest(feed_ok, key, "op IN ('add', 'delete')")} ad ON ad.{key} = k.{key}
LEFT JOIN {_latest(feed_ok, key, "op = 'edit'")} ed ON ed.{key} = k.{key}
{im_join}
WHERE (ad.seq IS NOT NULL AND ad.op = 'add') OR (ad.seq IS NULL AND c.{key} IS NOT NULL)"""


register("upsert_products", "M4", _upsert_sql("x_products", "x_product_changes", "product_id",
                                              ["product_name", "category", "price", "status"], "image", "product_name"))(
    lambda t: changes.upsert_products(t.products, t.product_changes)["products"])
register("delete_products", "M4", """
SELECT sales_id, CASE WHEN product_id IN (SELECT product_id FROM x_product_changes WHERE op = 'delete') THEN NULL
                      ELSE product_id END AS product_id, product_name, quantity, total, created_at, status, product_image
FROM x_sales""")(lambda t: declared(changes.delete_products_cascade(t.sales, t.product_changes)))

_ING_OK = "op = 'delete' OR (stock >= 0 AND low_stock_threshold >= 0)"
register("upsert_ingredients", "M5", _upsert_sql("x_ingredients", "x_ingredient_changes", "ingredient_id",
                                                 ["ingredient_name", "stock", "low_stock_threshold", "unit"], "image",
                                                 "ingredient_name", ok=_ING_OK))(
    lambda t: changes.upsert_ingredients(t.ingredients, t.ingredient_changes)["ingredients"])
register("ingredient_rejects", "M5", """
SELECT seq AS request_id, 'Stock and threshold values must not be negative.' AS reason
FROM x_ingredient_changes WHERE op <> 'delete' AND (stock < 0 OR low_stock_threshold < 0)""")(
    lambda t: changes.upsert_ingredients(t.ingredients, t.ingredient_changes)["rejects"])

register("upsert_users", "M8", f"""
SELECT u.user_id, u.username, s.role, s.fullname, s.status, s.avatar
FROM ({_upsert_sql("x_users", "x_user_changes", "user_id", ["fullname", "role", "status"], "avatar")}) s
JOIN x_users u ON u.user_id = s.user_id""")(lambda t: changes.upsert_users(t.users, t.user_changes)["users"])

# Text prices, and staff adds that meet taken names: what one bad row of a batch does to the others (nothing).
register("upsert_products_text", "M4", """
SELECT p.product_id, c.product_name, c.category, CAST(c.price AS DECIMAL(10,2)) AS price, 'Available' AS status, c.image
FROM x_products p JOIN x_price_changes c ON c.product_id = p.product_id WHERE c.price IS NOT NULL
UNION ALL
SELECT p.* FROM x_products p JOIN x_price_changes c ON c.product_id = p.product_id WHERE c.price IS NULL""")(
    lambda t: changes.upsert_products(t.products, t.price_changes)["products"])
register("upsert_products_rejects", "M4", """
SELECT product_id AS request_id, 'Price out of range.' AS reason FROM x_price_changes WHERE price IS NULL""")(
    lambda t: changes.upsert_products(t.products, t.price_changes)["rejects"])
register("upsert_users_adds", "M8", """
SELECT u.user_id, u.username, COALESCE(e.role, u.role) AS role, COALESCE(e.fullname, u.fullname) AS fullname,
       CASE WHEN e.user_id IS NULL THEN u.status ELSE 'active' END AS status, u.avatar
FROM x_users u LEFT JOIN x_staff_requests e ON e.op = 'edit' AND e.user_id = u.user_id
UNION ALL SELECT user_id, username, role, fullname, 'active', '' FROM x_staff_added""")(
    lambda t: changes.upsert_users(t.users, t.staff_requests)["users"])
register("upsert_users_rejects", "M8", """
SELECT CAST(1 AS BIGINT) AS request_id, 'Username already exists.' AS reason FROM x_staff_requests r
WHERE op = 'add' AND user_id NOT IN (SELECT user_id FROM x_staff_added)""")(
    lambda t: changes.upsert_users(t.users, t.staff_requests)["rejects"])

# ----------------------------------------------------------------------------- M4, S3: what references do
def _sale_deletes(t):
    """Sales deleted by id: their voids go, add-ons refuse, so do ids without a sale."""
    tables = {"sales": t.sales, "sales_void": _m3(t)["sales_void"], "sale_addons": t.sale_addons}
    requests = t.cancel_requests.unionByName(t.void_requests.select("request_id", "sales_id"))
    return referential.delete_rows(tables, "sales", requests, "sales_id")


_DELETES = "(SELECT request_id, sales_id FROM x_cancel_requests UNION ALL SELECT request_id, sales_id FROM x_void_requests)"
_DELETED = f"""(SELECT sales_id FROM {_DELETES} d EXCEPT SELECT sale_id FROM x_sale_addons)"""
register("delete_sales", "M4/S3", f"""
SELECT {_SALE} FROM x_sales WHERE sales_id NOT IN {_DELETED}""")(lambda t: declared(_sale_deletes(t)["tables"]["sales"]))
register("delete_sales_voids", "M4/S3", f"""
SELECT request_id AS void_id, sales_id AS sale_id, trim(reason, {_TRIM}) AS reason, {_RUN} AS voided_at
FROM x_void_requests WHERE sales_id IN (SELECT sales_id FROM x_sales EXCEPT SELECT * FROM {_DELETED})""")(
    lambda t: _sale_deletes(t)["tables"]["sales_void"])
register("delete_sales_rejects", "M4/S3", f"""
SELECT request_id, CASE WHEN s.sales_id IS NULL THEN 'Unknown key.' ELSE 'Row is referred to.' END AS reason
FROM {_DELETES} d LEFT JOIN x_sales s USING (sales_id)
WHERE s.sales_id IS NULL OR s.sales_id IN (SELECT sale_id FROM x_sale_addons)""")(lambda t: _sale_deletes(t)["rejects"])


def _product_keys(t):
    """Every ninth product gets a new key; every 27th asks for one that is taken, every 45th names no product."""
    k = F.col("product_id")
    new = F.when(k % 27 == 0, F.lit(1)).otherwise(k + 5000000).cast("long")
    requests = t.products.filter(k % 9 == 0).select(
        k.alias("request_id"), F.when(k % 45 == 0, -k - 1).otherwise(k).alias("old_id"), new.alias("new_id"))
    return referential.change_keys({"products": t.products, "sales": t.sales}, "products", requests, "old_id", "new_id")


_NEW_KEY = "CASE WHEN product_id % 9 = 0 AND product_id % 27 <> 0 AND product_id % 45 <> 0 THEN product_id + 5000000 ELSE product_id END"
register("change_product_keys", "M4/S3", f"""
SELECT {_NEW_KEY} AS product_id, product_name, category, price, status, image FROM x_products""")(
    lambda t: _product_keys(t)["tables"]["products"])
register("change_product_keys_sales", "M4/S3", f"""
SELECT sales_id, {_NEW_KEY} AS product_id, product_name, quantity, total, created_at, status, product_image FROM x_sales""")(
    lambda t: declared(_product_keys(t)["tables"]["sales"]))
register("change_product_keys_rejects", "M4/S3", """
SELECT product_id AS request_id, CASE WHEN product_id % 45 = 0 THEN 'Unknown key.' ELSE 'Key already exists.' END AS reason
FROM x_products WHERE product_id % 9 = 0 AND (product_id % 27 = 0 OR product_id % 45 = 0)""")(
    lambda t: _product_keys(t)["rejects"])

# ----------------------------------------------------------------------------- M6
register("audit_append", "M6", f"""
SELECT log_id, user_name, action, details, created_at FROM x_audit
UNION ALL
SELECT (SELECT MAX(log_id) FROM x_audit) + row_number() OVER (ORDER BY seq) AS log_id, '{ACTOR}' AS user_name,
       CASE op WHEN 'edit' THEN 'Edit User' ELSE 'Delete User' END AS action,
       CASE op WHEN 'edit' THEN 'Edited user ID: ' ELSE 'Deleted user ID: ' END || CAST(user_id AS VARCHAR) AS details,
       {_RUN} AS created_at
FROM x_user_changes""")(
    lambda t: changes.audit_append(t.audit_logs, changes.audit_entries(t.user_changes), ACTOR, RUN_TS))

# ----------------------------------------------------------------------------- M7
_REQ = f"""(SELECT seq, trim(fullname, {_TRIM}) AS fullname, trim(username, {_TRIM}) AS username FROM x_account_requests)"""
_CHECKED = f"""(SELECT r.*,
   CASE WHEN fullname IS NULL OR fullname = '' OR username IS NULL OR username = '' THEN 'All fields are required.'
        WHEN length(fullname) < 3 THEN 'Full name must be 3+ characters.'
        WHEN NOT regexp_full_match(username, '[a-zA-Z0-9]{{3,20}}') THEN 'Username must be 3-20 characters (letters, numbers only).'
        WHEN lower(username) IN (SELECT lower(username) FROM x_existing_users) THEN 'Username already exists.'
        END AS reason
 FROM {_REQ} r)"""
_RANKED = f"""(SELECT c.*, CASE WHEN reason IS NULL
     THEN row_number() OVER (PARTITION BY lower(username), reason IS NULL ORDER BY seq) END AS k FROM {_CHECKED} c)"""
register("account_intake", "M7/J8", f"""
SELECT (SELECT MAX(user_id) FROM x_existing_users) + row_number() OVER (ORDER BY seq) AS user_id, username,
       'user' AS role, fullname, 'active' AS status, '' AS avatar
FROM {_RANKED} x WHERE k = 1""")(
    lambda t: changes.account_intake(t.account_requests, t.existing_users)["users"])
register("account_rejects", "M7/J8", f"""
SELECT seq AS request_id, COALESCE(reason, 'Username already exists.') AS reason FROM {_RANKED} x
WHERE k IS NULL OR k > 1""")(lambda t: changes.account_checks(t.account_requests, t.existing_users)[1])


# ----------------------------------------------------------------------------- M9
def _reset_counts(t):
    """Row counts of each reset table before and after, as one grouped union (no join)."""
    from functools import reduce

    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F
    tables = {"sale_addons": t.sale_addons, "sales_void": t.sales_void, "sales": t.sales, "audit_logs": t.audit_logs}
    after = changes.reset_tables(tables, ACTOR, RUN_TS)
    parts = []
    for name in ("sale_addons", "sales_void", "sales", "audit_logs"):
        for side, df in (("before", tables[name]), ("after", after[name])):
            parts.append(df.select(F.lit(name).alias("table_name"),
                                   F.lit(1 if side == "before" else 0).alias("b"),
                                   F.lit(1 if side == "after" else 0).alias("a")))
    rows = reduce(DataFrame.unionByName, parts)
    counted = rows.groupBy("table_name").agg(F.sum("b").cast("long").alias("rows_before"),
                                             F.sum("a").cast("long").alias("rows_after"))
    names = t.spark.createDataFrame([(n,) for n in tables], "table_name string")
    # Tables with no rows on either side still get a line (zeros).
    return (names.join(counted, "table_name", "left")
            .select("table_name", F.coalesce("rows_before", F.lit(0).cast("long")).alias("rows_before"),
                    F.coalesce("rows_after", F.lit(0).cast("long")).alias("rows_after")))


register("reset_tables", "M9", """
SELECT 'sale_addons' AS table_name, (SELECT COUNT(*) FROM x_sale_addons) AS rows_before, CAST(0 AS BIGINT) AS rows_after
UNION ALL SELECT 'sales_void', CAST(0 AS BIGINT), CAST(0 AS BIGINT)
UNION ALL SELECT 'sales', (SELECT COUNT(*) FROM x_sales), CAST(0 AS BIGINT)
UNION ALL SELECT 'audit_logs', (SELECT COUNT(*) FROM x_audit), CAST(1 AS BIGINT)""")(_reset_counts)


# ----------------------------------------------------------------------------- K1, K3 from the maintained rollup (M1-M3)
def _rolled(t):
    """The daily rollup after a batch of cancels, voids and new sales, each brought in as signed differences."""
    cancelled = changes.cancel_sales(t.sales, t.cancel_requests)
    voided = changes.apply_voids(cancelled, t.void_requests)
    return rollup.applied(rollup.build(t.sales), rollup.differences(t.sales, cancelled, t.cancel_requests),
                          rollup.differences(cancelled, voided, t.void_requests),
                          rollup.differences(None, _m1(t)["sales"]))


_LATER = f"""(SELECT * FROM x_later UNION ALL
  SELECT product_id, product_name, quantity, CAST(wide_total AS DECIMAL(10,2)), {_RUN}, 'Completed' FROM {_PRICED} w
  WHERE wide_total < 100000000)"""
_DAY = f"DATE '{AS_OF.isoformat()}'"

register("rollup_after_changes", "K1/K3/M1-M3", f"""
SELECT CAST(created_at AS DATE) AS day, product_id, product_name,
       COUNT(*) FILTER (WHERE status = 'Completed') AS done_sales,
       CAST(COALESCE(SUM(quantity) FILTER (WHERE status = 'Completed'), 0) AS BIGINT) AS done_qty,
       CAST(COALESCE(SUM(total) FILTER (WHERE status = 'Completed'), 0) AS DECIMAL(20,2)) AS done_total,
       COUNT(*) AS any_sales, CAST(SUM(quantity) AS BIGINT) AS any_qty, CAST(SUM(total) AS DECIMAL(20,2)) AS any_total
FROM {_LATER} l GROUP BY 1, 2, 3""")(_rolled)
register("rollup_dashboard", "K1/M1-M3", f"""
SELECT *, CAST(monthly_sales * 1.1 AS DECIMAL(23,3)) AS monthly_estimate FROM (
  SELECT CAST(COALESCE(SUM(total) FILTER (WHERE age = 0), 0) AS DECIMAL(20,2)) AS daily_sales,
         CAST(COALESCE(SUM(total) FILTER (WHERE age BETWEEN 0 AND 6), 0) AS DECIMAL(20,2)) AS weekly_sales,
         CAST(COALESCE(SUM(total) FILTER (WHERE same_month), 0) AS DECIMAL(20,2)) AS monthly_sales,
         COUNT(*) FILTER (WHERE age = 0) AS today_orders
  FROM (SELECT total, {_DAY} - CAST(created_at AS DATE) AS age, date_trunc('month', created_at) = date_trunc('month', {_DAY}) AS same_month
        FROM {_LATER} l WHERE status = 'Completed') c) k""")(lambda t: rollup.dashboard_kpis(_rolled(t), AS_OF))
register("rollup_top_month", "K3/M1-M3", f"""
SELECT k.product_id, k.product_name, -k.less AS qty_sold, k.revenue, p.image, p.price, p.category
FROM (SELECT unnest(min({{'less': -q, 'last': product_id IS NULL, 'product_id': product_id, 'product_name': product_name,
                          'revenue': r}}, 10), recursive := true)
      FROM (SELECT product_id, product_name, CAST(SUM(quantity) AS BIGINT) AS q, CAST(SUM(total) AS DECIMAL(20,2)) AS r
            FROM {_LATER} l WHERE status = 'Completed' AND date_trunc('month', created_at) = date_trunc('month', {_DAY})
            GROUP BY product_id, product_name) t) k
LEFT JOIN x_products p USING (product_id)""")(
    lambda t: rollup.top_products(_rolled(t), t.products, AS_OF, "monthly"))
