"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each statement starts with the stand-in ledger views (FIXTURES.md section 3)
in one ``WITH`` clause, then answers the query in plain SQL. Money sums are
cast to DECIMAL(20,2) and integer sums to BIGINT so the result types match
Spark's; NULL ordering is always spelled out (DuckDB sorts NULLs last, Spark
first).
"""

from __future__ import annotations

# Stand-in ledger views over the TPC-H-like tables, in dependency order.
VIEWS = [
    ("x_products", """SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
 CAST(p_retailprice AS DECIMAL(10,2)) AS price,
 CASE WHEN p_partkey % 8 = 0 THEN 'Unavailable' ELSE 'Available' END AS status,
 CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 10 = 1 THEN NULL
      ELSE concat('img_', CAST(p_partkey AS VARCHAR), '.webp') END AS image FROM part"""),
    ("x_lines", """SELECT l_orderkey, l_partkey, l_quantity, l_orderkey * 100 + rn AS line_id,
 l_orderkey * 100 + rn - (rn - 1) % 3 AS sale_id
 FROM (SELECT l_orderkey, l_partkey, l_quantity,
   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem)"""),
    ("x_addons", """SELECT p_partkey AS addon_id, p_name AS addon_name, CAST(10 + p_partkey % 90 AS DECIMAL(10,2)) AS price,
 CASE WHEN p_partkey % 4 = 3 THEN 'Unavailable' ELSE 'Available' END AS status FROM part"""),
    ("x_sale_addons", """SELECT r.line_id AS id, r.sale_id, a.addon_id, a.addon_name, a.price
 FROM x_lines r JOIN x_addons a ON a.addon_id = r.l_partkey WHERE r.line_id <> r.sale_id"""),
    ("x_sales", """SELECT r.sale_id AS sales_id, CASE WHEN o.o_orderkey % 50 = 0 THEN NULL ELSE p.product_id END AS product_id,
 p.product_name, CAST(r.l_quantity AS INT) AS quantity,
 CAST(CAST(r.l_quantity AS INT) * (p.price + COALESCE(a.addon_total, 0)) AS DECIMAL(10,2)) AS total,
 o.o_orderdate AS created_at,
 CASE o.o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Cancelled' ELSE 'VOID' END AS status,
 p.image AS product_image
 FROM orders o JOIN x_lines r ON r.l_orderkey = o.o_orderkey AND r.line_id = r.sale_id
 JOIN x_products p ON p.product_id = r.l_partkey
 LEFT JOIN (SELECT sale_id, SUM(price) AS addon_total FROM x_sale_addons GROUP BY sale_id) a ON a.sale_id = r.sale_id"""),
    ("x_ingredients", """SELECT p_partkey AS ingredient_id, concat(p_name, ' ', CAST(p_partkey AS VARCHAR)) AS ingredient_name,
 p_size AS stock, CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE CAST(5 + p_partkey % 10 AS INT) END AS low_stock_threshold,
 CASE p_partkey % 6 WHEN 0 THEN 'Can-based' WHEN 1 THEN 'Bottle-based' WHEN 2 THEN 'Box-based'
   WHEN 3 THEN 'Plastic-based' WHEN 4 THEN 'Pack-based' ELSE NULL END AS unit,
 CAST(NULL AS VARCHAR) AS image FROM part"""),
    ("x_users", """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE replace(c_name, '#', '') END AS username,
 c_mktsegment AS role, CASE WHEN c_custkey % 11 = 0 THEN 'ab' ELSE c_name END AS fullname,
 CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status, '' AS avatar FROM customer"""),
    ("x_audit", """SELECT event_id AS log_id, concat('user', CAST(user_id AS VARCHAR)) AS user_name, event_type AS action,
 props AS details, ts AS created_at FROM events"""),
    ("x_request_texts", """SELECT sale_id AS request_id,
 CASE WHEN l_orderkey % 40 = 0 THEN '999999999' WHEN l_orderkey % 77 = 0 THEN '0' WHEN l_orderkey % 83 = 0 THEN 'none'
      ELSE CAST(l_partkey AS VARCHAR) END AS product_id,
 CASE l_orderkey % 60 WHEN 1 THEN '0' WHEN 2 THEN '1e6' WHEN 3 THEN '99999999999'
      WHEN 4 THEN concat(' ', CAST(CAST(l_quantity AS INT) AS VARCHAR), 'pcs')
      ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS quantity FROM x_lines WHERE line_id = sale_id"""),
    # The numbers that the request texts stand for, by hand: no number is 0; 99999999999 fits no quantity.
    ("x_sale_requests", """SELECT request_id, CASE product_id WHEN 'none' THEN 0 ELSE CAST(product_id AS BIGINT) END AS product_id,
 CASE quantity WHEN '1e6' THEN 1000000 WHEN '99999999999' THEN NULL
      ELSE CAST(replace(quantity, 'pcs', '') AS INT) END AS quantity FROM x_request_texts"""),
    ("x_request_addons", """SELECT sale_id AS request_id,
 CASE WHEN l_orderkey % 6 = 1 THEN l_partkey + 10000000 ELSE l_partkey END AS addon_id FROM x_lines WHERE line_id <> sale_id"""),
    ("x_cancel_requests", """SELECT o_orderkey AS request_id, o_orderkey * 100 + 1 AS sales_id FROM orders WHERE o_orderkey % 9 = 0"""),
    ("x_void_requests", """SELECT o_orderkey AS request_id,
 CASE WHEN o_orderkey % 130 = 0 THEN -1 - o_orderkey WHEN o_orderkey % 130 = 65 THEN 10000000000000 + o_orderkey
      ELSE o_orderkey * 100 + 1 END AS sales_id,
 concat('  ', o_orderpriority, ' ') AS reason FROM orders WHERE o_orderkey % 13 = 0"""),
    ("x_product_changes", """SELECT p_partkey AS seq,
 CASE WHEN p_partkey % 20 = 0 THEN 'delete' WHEN p_partkey % 25 = 7 THEN 'add' ELSE 'edit' END AS op,
 CASE WHEN p_partkey % 20 <> 0 AND p_partkey % 25 = 7 THEN p_partkey + 1000000 ELSE p_partkey END AS product_id,
 concat(' ', p_name, ' ') AS product_name, CAST(p_retailprice + 1 AS DECIMAL(10,2)) AS price, p_type AS category,
 'Available' AS status,
 CASE WHEN p_partkey % 2 = 0 THEN '' ELSE concat('new_', CAST(p_partkey AS VARCHAR), '.webp') END AS image
 FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 25 = 7"""),
    ("x_ingredient_changes", """SELECT p_partkey AS seq,
 CASE WHEN p_partkey % 30 = 0 THEN 'delete' WHEN p_partkey % 25 = 7 THEN 'add' ELSE 'edit' END AS op,
 CASE WHEN p_partkey % 30 <> 0 AND p_partkey % 25 = 7 THEN p_partkey + 1000000 ELSE p_partkey END AS ingredient_id,
 p_name AS ingredient_name, p_size - 5 AS stock, CAST(p_partkey % 12 AS INT) - 1 AS low_stock_threshold,
 'Box-based' AS unit, CAST(NULL AS VARCHAR) AS image
 FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 25 = 7"""),
    ("x_account_requests", """SELECT user_id AS seq, fullname,
 CASE WHEN user_id % 10 = 3 THEN replace(username, '3', '1') ELSE username END AS username FROM x_users WHERE user_id % 2 = 1"""),
    ("x_existing_users", """SELECT * FROM x_users WHERE user_id % 2 = 0"""),
    ("x_user_changes", """SELECT user_id AS seq, CASE WHEN user_id % 5 = 0 THEN 'edit' ELSE 'delete' END AS op, user_id,
 fullname, role, 'inactive' AS status, CAST(NULL AS VARCHAR) AS avatar FROM x_users WHERE user_id % 5 = 0 OR user_id % 50 = 1"""),
    ("x_price_changes", """SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
 CASE p_partkey % 12 WHEN 0 THEN NULL WHEN 1 THEN 1000.00 WHEN 2 THEN 0.00 WHEN 3 THEN 1.00
   WHEN 4 THEN CAST(p_partkey % 90 AS DOUBLE) + 0.5 ELSE p_partkey % 900 END AS price,
 concat('new_image_', CAST(p_partkey AS VARCHAR), '_1.webp') AS image FROM part"""),
    ("x_staff_requests", """SELECT CASE WHEN user_id % 8 = 0 THEN 'edit' ELSE 'add' END AS op,
 CASE WHEN user_id % 8 = 0 THEN user_id ELSE user_id + 1000000 END AS user_id,
 CASE user_id % 3 WHEN 0 THEN concat('New', CAST(user_id % 60 AS VARCHAR)) WHEN 1 THEN upper(username)
   ELSE concat('solo', CAST(user_id AS VARCHAR)) END AS username, fullname, role FROM x_users WHERE user_id % 4 = 0"""),
    # An add of a name that no user has, first by (op, user_id, ...) among the adds of that name.
    ("x_staff_added", """SELECT * FROM x_staff_requests WHERE op = 'add' AND lower(username) NOT IN (SELECT lower(username) FROM x_users)
 QUALIFY row_number() OVER (PARTITION BY lower(username) ORDER BY user_id) = 1"""),
    # The ledger by day and product, for completed and for all sales: what totals and top lists are added up from.
    ("x_days", """SELECT CAST(created_at AS DATE) AS day, product_id, product_name,
 COUNT(*) FILTER (WHERE status = 'Completed') AS done_sales, SUM(quantity) FILTER (WHERE status = 'Completed') AS done_qty,
 SUM(total) FILTER (WHERE status = 'Completed') AS done_total,
 COUNT(*) AS any_sales, SUM(quantity) AS any_qty, SUM(total) AS any_total FROM x_sales GROUP BY ALL"""),
    # The ledger after a batch: cancels, then voids, then the requests that were priced.
    ("x_later", """SELECT product_id, product_name, quantity, total, created_at,
 CASE WHEN sales_id IN (SELECT sales_id FROM x_void_requests WHERE sales_id > 0) THEN 'VOID'
      WHEN status = 'Completed' AND sales_id IN (SELECT sales_id FROM x_cancel_requests) THEN 'Cancelled' ELSE status END AS status
 FROM x_sales"""),
    # What stands on the menu, products and add-ons alike: everything but what is marked otherwise.
    ("x_menu", """SELECT 'product' AS kind, product_id AS id, product_name AS name, category, price FROM x_products
 UNION ALL SELECT 'addon', addon_id, addon_name, NULL, price FROM x_addons
 EXCEPT ALL (SELECT 'product', product_id, product_name, category, price FROM x_products WHERE status <> 'Available'
  UNION ALL SELECT 'addon', addon_id, addon_name, NULL, price FROM x_addons WHERE status <> 'Available')"""),
    # How far each item is above its threshold, in steps of the threshold.
    ("x_shelf", """SELECT ingredient_name, stock, low_stock_threshold,
 CASE sign(stock - low_stock_threshold) WHEN 1 THEN 'stocked' WHEN 0 THEN 'short' WHEN -1 THEN 'short' END AS shelf
 FROM x_ingredients"""),
    # Tables that break their rules.
    ("x_dirty_addons", """SELECT CASE WHEN addon_id % 15 = 0 THEN concat('x', CAST(addon_id AS VARCHAR)) ELSE CAST(addon_id AS VARCHAR) END AS addon_id,
 CASE WHEN addon_id % 21 <> 0 THEN addon_name END AS addon_name,
 CASE WHEN addon_id % 22 = 0 THEN 'free' ELSE CAST(price AS VARCHAR) END AS price,
 CASE WHEN addon_id % 17 = 0 THEN 'Sold out' ELSE status END AS status FROM x_addons"""),
    ("x_bad_sales", """SELECT * REPLACE (CASE WHEN sales_id % 19 = 0 THEN product_id + 10000000 ELSE product_id END AS product_id)
 FROM (SELECT * FROM x_sales UNION ALL SELECT * FROM x_sales WHERE sales_id % 33 = 0)"""),
    ("x_bad_lines", """SELECT * REPLACE (CASE WHEN id % 23 = 0 THEN sale_id + 1000000000000 ELSE sale_id END AS sale_id)
 FROM (SELECT * FROM x_sale_addons UNION ALL SELECT * FROM x_sale_addons WHERE id % 29 = 0)"""),
]

_WITH = "WITH " + ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in VIEWS)


def with_views(body: str) -> str:
    """Prefix ``body`` with the ledger views."""
    return _WITH + "\n" + body.strip()
