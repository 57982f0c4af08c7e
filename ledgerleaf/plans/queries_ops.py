"""Registered queries: conformance, integrity, export, streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..operators import integrity
from ..session import scratch_path
from ..sources.export import export_report, read_export
from ..sources.schemas import TABLES
from ..streaming.daily_sales import read_daily_sales, sale_file_stream, sales_events, start_daily_sales
from ..streaming.live import (read_live_alerts, read_live_totals, sale_landed, sale_withdrawn, start_live_alerts,
                              start_live_totals)
from ..streaming.low_stock import start_low_stock
from .catalog import AS_OF, RUN_TS, register

_LEDGER = ("addons", "ingredients", "products", "sales", "sales_void", "sale_addons", "audit_logs", "users")
_VIEW = {"addons": "x_addons", "ingredients": "x_ingredients", "products": "x_products", "sales": "x_sales",
         "sale_addons": "x_sale_addons", "audit_logs": "x_audit", "users": "x_users"}


def _ledger(t):
    return {name: getattr(t, name) for name in _LEDGER}


# ----------------------------------------------------------------------------- S2
_NN = {"addons": ["addon_id", "addon_name", "price"], "ingredients": ["ingredient_id"], "products": ["product_id"],
       "sales": ["sales_id"], "sale_addons": ["id", "sale_id"], "audit_logs": ["log_id"], "users": ["user_id", "username"]}


def _schema_sql():
    parts = []
    for name in _LEDGER:
        if name == "sales_void":
            parts.append("SELECT 'sales_void' AS table_name, CAST(0 AS BIGINT) AS rows_read, CAST(0 AS BIGINT) AS rows_ok, "
                         "CAST(0 AS BIGINT) AS not_null_violations, CAST(0 AS BIGINT) AS enum_violations, "
                         "CAST(0 AS BIGINT) AS type_failures")
            continue
        nn = " OR ".join(f"{c} IS NULL" for c in _NN[name])
        enum = "status IS NOT NULL AND status NOT IN ('Available', 'Unavailable')" if name == "addons" else "FALSE"
        parts.append(f"""SELECT '{name}' AS table_name, COUNT(*) AS rows_read,
  COUNT(*) FILTER (WHERE NOT ({nn}) AND NOT ({enum})) AS rows_ok,
  COUNT(*) FILTER (WHERE {nn}) AS not_null_violations,
  COUNT(*) FILTER (WHERE NOT ({nn}) AND ({enum})) AS enum_violations, CAST(0 AS BIGINT) AS type_failures
FROM {_VIEW[name]}""")
    return "\nUNION ALL\n".join(parts)


register("schema_check", "S2", _schema_sql())(lambda t: integrity.schema_check(_ledger(t)))


# ----------------------------------------------------------------------------- S3
def _dup_sql(name, table, cols, exprs):
    keys = ", ".join(f"{e} AS k{i}" for i, e in enumerate(exprs))
    null = " OR ".join(f"k{i} IS NULL" for i in range(len(exprs)))
    return (f"SELECT '{name}' AS constraint_name, '{table}' AS table_name, '{cols}' AS columns, "
            f"CAST(COALESCE(SUM(n) FILTER (WHERE n > 1 OR {null}), 0) AS BIGINT) AS violations "
            f"FROM (SELECT {', '.join(f'k{i}' for i in range(len(exprs)))}, COUNT(*) AS n FROM (SELECT {keys} FROM {{src}}) "
            f"GROUP BY ALL)")


def _constraint_sql():
    keys = {"addons": ["addon_id"], "ingredients": ["ingredient_id"], "products": ["product_id"], "sales": ["sales_id"],
            "sales_void": ["void_id"], "sale_addons": ["id"], "audit_logs": ["log_id"],
            "users": ["user_id"]}
    parts = []
    for t in _LEDGER:
        src = _VIEW.get(t, "(SELECT CAST(NULL AS BIGINT) AS void_id, CAST(NULL AS BIGINT) AS sale_id WHERE FALSE)")
        parts.append(_dup_sql(f"pk_{t}", t, ",".join(keys[t]), keys[t]).format(src=src))
        if t == "users":
            parts.append(_dup_sql("uq_users_username", t, "username", ["lower(username)"]).format(src=src))
        if t == "addons":
            parts.append("SELECT 'enum_addons_status', 'addons', 'status', COUNT(*) FROM x_addons "
                         "WHERE status IS NOT NULL AND status NOT IN ('Available', 'Unavailable')")
    parts.append("SELECT 'fk_sales_product_id', 'sales', 'product_id', COUNT(*) FROM x_sales s "
                 "WHERE s.product_id IS NOT NULL AND s.product_id NOT IN (SELECT product_id FROM x_products)")
    parts.append("SELECT 'fk_sales_void_sale_id', 'sales_void', 'sale_id', CAST(0 AS BIGINT)")
    parts.append("SELECT 'fk_sale_addons_sale_id', 'sale_addons', 'sale_id', COUNT(*) FROM x_sale_addons a "
                 "WHERE a.sale_id IS NOT NULL AND a.sale_id NOT IN (SELECT sales_id FROM x_sales)")
    return "\nUNION ALL\n".join(parts)


register("constraint_audit", "S3", _constraint_sql())(lambda t: integrity.constraint_audit(_ledger(t)))

# ----------------------------------------------------------------------------- S2, S3 on tables that break their rules
_REASON = """(SELECT try_cast(addon_id AS BIGINT) AS addon_id, addon_name, try_cast(price AS DECIMAL(10,2)) AS price, status,
   CASE WHEN try_cast(addon_id AS BIGINT) IS NULL THEN 'TYPE addon_id'
        WHEN try_cast(price AS DECIMAL(10,2)) IS NULL THEN 'TYPE price'
        WHEN addon_name IS NULL THEN 'NOT NULL addon_name'
        WHEN status NOT IN ('Available', 'Unavailable') THEN 'ENUM status' END AS reason FROM x_dirty_addons)"""
register("conform_addons", "S2", f"SELECT addon_id, addon_name, price, status FROM {_REASON} r WHERE reason IS NULL")(
    lambda t: integrity.conform(t.dirty_addons, TABLES["addons"])[0])
register("conform_addons_rejects", "S2", f"SELECT * FROM {_REASON} r WHERE reason IS NOT NULL")(
    lambda t: integrity.conform(t.dirty_addons, TABLES["addons"])[1].withColumnRenamed("_reason", "reason"))
register("schema_check_dirty", "S2", f"""
SELECT 'addons' AS table_name, COUNT(*) AS rows_read, COUNT(*) FILTER (WHERE reason IS NULL) AS rows_ok,
       COUNT(*) FILTER (WHERE reason LIKE 'NOT NULL%') AS not_null_violations,
       COUNT(*) FILTER (WHERE reason LIKE 'ENUM%') AS enum_violations,
       COUNT(*) FILTER (WHERE reason LIKE 'TYPE%') AS type_failures FROM {_REASON} r""")(
    lambda t: integrity.schema_check({"addons": t.dirty_addons}))


def _rows(name, table, columns, sql):
    return f"SELECT '{name}' AS constraint_name, '{table}' AS table_name, '{columns}' AS columns, CAST(({sql}) AS BIGINT) AS violations"


def _repeats(view, key):
    return f"SELECT COALESCE(SUM(n), 0) FROM (SELECT COUNT(*) AS n FROM {view} GROUP BY {key} HAVING COUNT(*) > 1)"


register("constraint_audit_dirty", "S3", " UNION ALL ".join([
    _rows("pk_addons", "addons", "addon_id", _repeats("x_addons", "addon_id")),
    _rows("enum_addons_status", "addons", "status", "SELECT COUNT(*) FROM x_addons WHERE addon_id % 17 = 0"),
    _rows("pk_products", "products", "product_id", "SELECT COUNT(*) FROM x_products WHERE product_id % 41 = 0"),
    _rows("pk_sales", "sales", "sales_id", _repeats("x_bad_sales", "sales_id")),
    _rows("pk_sales_void", "sales_void", "void_id", _repeats("x_void_requests", "request_id")),
    _rows("pk_sale_addons", "sale_addons", "id", _repeats("x_bad_lines", "id")),
    _rows("pk_users", "users", "user_id", "SELECT 0"),
    _rows("uq_users_username", "users", "username", _repeats(
        "(SELECT username FROM x_users UNION ALL SELECT username FROM x_users WHERE user_id % 12 = 0)", "lower(username)")),
    _rows("fk_sales_product_id", "sales", "product_id",
          "SELECT COUNT(*) FROM x_bad_sales WHERE product_id >= 10000000 OR product_id % 41 = 0"),
    _rows("fk_sales_void_sale_id", "sales_void", "sale_id",
          "SELECT COUNT(*) FROM x_void_requests v LEFT JOIN (SELECT DISTINCT sales_id AS s FROM x_sales) x ON s = sales_id WHERE s IS NULL"),
    _rows("fk_sale_addons_sale_id", "sale_addons", "sale_id", "SELECT COUNT(*) FROM x_bad_lines WHERE sale_id > 1000000000000"),
]))(lambda t: integrity.constraint_audit(t.dirty_tables))

# ----------------------------------------------------------------------------- S4
_MONTH = f"month(created_at) = {AS_OF.month} AND year(created_at) = {AS_OF.year}"


def _export(t, block):
    folder = export_report(t.sales, "monthly", AS_OF, scratch_path(t.spark, "export"), generated_at=RUN_TS, blocks=(block,))
    return read_export(t.spark, folder, (block,))[block]


register("export_summary", "S4", f"""
SELECT 'Monthly' AS period_label, '{RUN_TS.strftime('%Y-%m-%d %H:%M:%S')}' AS generated_at,
       'Report_Monthly_{RUN_TS.date().isoformat()}' AS file_name,
       CAST(COALESCE(SUM(total), 0) AS DECIMAL(20,2)) AS total_sales,
       '₱' || format('{{:,.2f}}', CAST(COALESCE(SUM(total), 0) AS DOUBLE)) AS total_sales_text,
       COUNT(*) AS total_transactions,
       CASE WHEN COUNT(*) = 0 THEN 'No transactions for this period.' END AS note
FROM x_sales WHERE status = 'Completed' AND {_MONTH}""")(lambda t: _export(t, "summary"))
register("export_transactions", "S4", f"""
SELECT product_name, quantity, total, '₱' || format('{{:,.2f}}', CAST(total AS DOUBLE)) AS total_text,
       strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, status
FROM x_sales WHERE status = 'Completed' AND {_MONTH}""")(lambda t: _export(t, "transactions"))


# ----------------------------------------------------------------------------- T1, T2
def _t1(t, mode="complete"):
    spark = t.spark
    events = t.raw("events")
    stream = sale_file_stream(spark, t.sf_dir, events.schema, glob="events.parquet")
    purchases = sales_events(stream.filter(stream.event_type == "purchase"), ts_col="ts", amount_col="value",
                             status_col=None)
    out, ckpt = scratch_path(spark, "t1-out"), scratch_path(spark, "t1-ckpt")
    q = start_daily_sales(spark, purchases, out, ckpt, mode=mode)
    q.awaitTermination()
    return read_daily_sales(spark, out, mode)


_T1_SQL = """
SELECT CAST(ts AS DATE) AS sale_day, CAST(SUM(CAST(value AS DECIMAL(10,2))) AS DECIMAL(20,2)) AS total_sales,
       COUNT(*) AS order_count
FROM events WHERE event_type = 'purchase' GROUP BY 1"""
register("stream_daily_sales", "T1", _T1_SQL)(_t1)
# Watermarked form: one availableNow run over files already present sees every
# row in its first micro-batch, so nothing is late and it equals the batch totals.
register("stream_daily_sales_watermarked", "T1", _T1_SQL)(lambda t: _t1(t, "update"))


def _sale_files(t):
    """Where the ledger's sales lie as parquet files: the store's own folder, else files of the stand-in rows."""
    if hasattr(t, "root"):
        return f"{t.root}/sales"
    src = scratch_path(t.spark, "t1-ledger-feed")
    t.sales.write.parquet(src)
    return src


def _t1_ledger(t, mode="complete", files=64):
    """T1 over the ledger's own shape: sale rows land as parquet files; Completed ones are summed per day."""
    spark = t.spark
    stream = sale_file_stream(spark, _sale_files(t), t.sales.schema, max_files_per_trigger=files)
    out, ckpt = scratch_path(spark, "t1l-out"), scratch_path(spark, "t1l-ckpt")
    start_daily_sales(spark, sales_events(stream), out, ckpt, mode=mode).awaitTermination()
    return read_daily_sales(spark, out, mode)


_T1_LEDGER_SQL = """
SELECT CAST(created_at AS DATE) AS sale_day, CAST(SUM(total) AS DECIMAL(20,2)) AS total_sales, COUNT(*) AS order_count
FROM x_sales WHERE status = 'Completed' GROUP BY 1"""
register("stream_daily_sales_ledger", "T1", _T1_LEDGER_SQL)(_t1_ledger)
# A few files a micro-batch, in no order of days: rows that come late for their day count all the same.
register("stream_daily_sales_late", "T1", _T1_LEDGER_SQL)(lambda t: _t1_ledger(t, "partial", 32 if hasattr(t, "root") else 2))


def _t2(t):
    spark = t.spark
    feed = t.ingredient_changes
    src = scratch_path(spark, "t2-feed")
    feed.write.parquet(src)   # the change feed lands as files in a directory
    stream = spark.readStream.schema(feed.schema).parquet(src)
    out, ckpt = scratch_path(spark, "t2-out"), scratch_path(spark, "t2-ckpt")
    start_low_stock(spark, stream, out, ckpt).awaitTermination()
    return spark.read.parquet(out)


register("stream_low_stock", "T2", """
SELECT seq, ingredient_id, ingredient_name AS label, stock, low_stock_threshold FROM x_ingredient_changes
WHERE op IN ('add', 'edit') AND stock >= 0 AND low_stock_threshold >= 0 AND stock <= low_stock_threshold""")(_t2)


# Live figures that follow later changes. Feeds land as files in no order, so a withdrawal may come before its sale.
def _landed(t, frame, name, batches, times=1):
    """``frame``, delivered so many times, as files, and how many of them make one of ``batches`` micro-batches.

    The rows are written as Spark makes them and dealt out to as many files (two a batch at least), so there are more
    files of a larger feed, and no task takes a fixed share of it.
    """
    spark, made, path = t.spark, scratch_path(t.spark, f"{name}-rows"), scratch_path(t.spark, name)
    frame.write.parquet(made)
    rows = spark.read.schema(frame.schema).parquet(made)
    files = max(2 * batches, times * len(rows.inputFiles()))
    reduce(DataFrame.unionByName, [rows] * times).repartition(files).write.parquet(path)
    return path, -(-files // batches)


def _live_totals(t):
    spark = t.spark
    events = (sale_landed(t.sales).unionByName(sale_withdrawn(t.cancel_requests))
              .unionByName(sale_withdrawn(t.void_requests.filter("sales_id > 0"))))
    src, files = _landed(t, events, "t1-live-feed", 3)
    stream = sale_file_stream(spark, src, events.schema, max_files_per_trigger=files)
    out, ckpt = scratch_path(spark, "t1-live-out"), scratch_path(spark, "t1-live-ckpt")
    start_live_totals(spark, stream, out, ckpt).awaitTermination()
    return read_live_totals(spark, out)


register("stream_live_totals", "T1", """
SELECT CAST(created_at AS DATE) AS sale_day, CAST(SUM(total) AS DECIMAL(20,2)) AS total_sales, COUNT(*) AS order_count
FROM x_sales s WHERE status = 'Completed'
  AND NOT EXISTS (SELECT 1 FROM x_cancel_requests c WHERE c.sales_id = s.sales_id)
  AND NOT EXISTS (SELECT 1 FROM x_void_requests v WHERE v.sales_id = s.sales_id) GROUP BY 1""")(_live_totals)


def _distinct_sales(t):
    """Every sale file is delivered twice."""
    spark = t.spark
    src, files = _landed(t, t.sales, "t1-twice-feed", 2, times=2)
    stream = sale_file_stream(spark, src, t.sales.schema, max_files_per_trigger=files)
    out, ckpt = scratch_path(spark, "t1-twice-out"), scratch_path(spark, "t1-twice-ckpt")
    events = sales_events(stream, id_col="sales_id")
    start_daily_sales(spark, events, out, ckpt, mode="distinct", lateness="10000 days").awaitTermination()
    return read_daily_sales(spark, out, "distinct")


register("stream_daily_sales_redelivered", "T1", _T1_LEDGER_SQL)(_distinct_sales)


def _live_alerts(t):
    spark, feed = t.spark, t.ingredient_changes
    src, files = _landed(t, feed, "t2-live-feed", 2)
    changes = sale_file_stream(spark, src, feed.schema, max_files_per_trigger=files)
    before = sale_file_stream(spark, _landed(t, t.ingredients, "t2-live-table", 1)[0], t.ingredients.schema)
    out, ckpt = scratch_path(spark, "t2-live-out"), scratch_path(spark, "t2-live-ckpt")
    start_live_alerts(spark, changes, before, out, ckpt).awaitTermination()
    return read_live_alerts(spark, out)


# The last request of each item, on top of the table; items that end at or under their threshold.
register("stream_live_alerts", "T2", """
SELECT ingredient_id, label, stock, low_stock_threshold FROM (
  SELECT c.ingredient_id, trim(c.ingredient_name) AS label, c.stock, c.low_stock_threshold FROM x_ingredient_changes c
  LEFT JOIN x_ingredients i USING (ingredient_id)
  WHERE c.stock >= 0 AND c.low_stock_threshold >= 0 AND (c.op = 'add' OR (c.op = 'edit' AND i.ingredient_id IS NOT NULL))
  UNION ALL SELECT ingredient_id, ingredient_name, stock, low_stock_threshold FROM x_ingredients i
  WHERE NOT EXISTS (SELECT 1 FROM x_ingredient_changes c WHERE c.ingredient_id = i.ingredient_id
                    AND (c.op = 'delete' OR (c.stock >= 0 AND c.low_stock_threshold >= 0)))) r
WHERE stock <= low_stock_threshold""")(_live_alerts)
