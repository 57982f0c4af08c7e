"""Ledger sources: parquet store round trip (with month partitions) and CSV read with the declared schema."""

from __future__ import annotations

import tempfile

from ledgerleaf.sources.schemas import PRODUCTS, SALES, TABLES
from ledgerleaf.sources.tables import read_table, write_store


def test_csv_read_with_declared_schema(spark, seed):
    root = tempfile.mkdtemp(prefix="ll-csv-")
    seed.products.write.option("header", True).csv(f"{root}/products")
    back = read_table(spark, f"{root}/products", PRODUCTS, fmt="csv")
    assert [f.dataType for f in back.schema] == [f.dataType for f in PRODUCTS.schema]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, seed.products.collect()))


def test_store_round_trip_partitioned(spark, seed):
    root = tempfile.mkdtemp(prefix="ll-store-")
    write_store({"sales": seed.sales, "products": seed.products}, root, sales_files=2)
    sales = read_table(spark, f"{root}/sales", TABLES["sales"])
    assert sales.columns == SALES.schema.names + ["sale_month"]
    got = sorted(tuple(r)[:-1] for r in sales.collect())
    assert got == sorted(map(tuple, seed.sales.collect()))
    months = {(r.created_at.year, r.created_at.month, r.sale_month) for r in sales.collect()}
    assert all(m.year == y and m.month == mo and m.day == 1 for y, mo, m in months)


def test_commit_rewrites_only_changed_months(spark, seed):
    import os

    from pyspark.sql import functions as F

    from ledgerleaf.operators import changes
    root = tempfile.mkdtemp(prefix="ll-commit-")
    write_store({"sales": seed.sales}, root, sales_files=2)
    april = f"{root}/sales/sale_month=2026-04-01"
    before = {f: os.path.getmtime(os.path.join(april, f)) for f in os.listdir(april)}
    stored = read_table(spark, f"{root}/sales", TABLES["sales"])
    req = spark.createDataFrame([(1, 38), (2, 43)], "request_id long, sales_id long")     # two May sales
    new = changes.cancel_sales(stored, req)
    from ledgerleaf.sources.tables import commit_sales_changes
    months = commit_sales_changes(spark, root, new, req.select("sales_id"))
    assert [m.isoformat() for m in months] == ["2026-05-01"]
    after = {f: os.path.getmtime(os.path.join(april, f)) for f in os.listdir(april)}
    assert after == before                                   # April files untouched
    back = read_table(spark, f"{root}/sales", TABLES["sales"])
    st = {r.sales_id: r.status for r in back.collect()}
    assert st[38] == "Cancelled" and st[43] == "Cancelled" and st[39] == "Completed" and back.count() == 18
    assert back.filter(F.col("status") == "Cancelled").count() == 5


def test_newest_audit_rows_open_the_newest_months(spark):
    import datetime as dt
    import io
    from contextlib import redirect_stdout

    from ledgerleaf.operators import lists
    from ledgerleaf.sources.schemas import AUDIT_LOGS
    from ledgerleaf.sources.tables import StoredTables
    rows = [(i, "u", "Login", None, dt.datetime(2024, 1, 1) + dt.timedelta(days=40 * i)) for i in range(8)]     # a row a month
    rows += [(100 + i, "u", "Login", None, dt.datetime(2025, 6, 1, 0, i % 3)) for i in range(30)]                # a full month
    rows += [(200 + i, "u", "Login", None, dt.datetime(2025, 9, 30, 23)) for i in range(2)] + [(300, "u", "x", None, None)]
    log = spark.createDataFrame(rows, AUDIT_LOGS.schema)
    root = tempfile.mkdtemp(prefix="ll-audit-")
    write_store({"audit_logs": log}, root)
    t = StoredTables(spark, root)
    assert t.audit_logs.columns == AUDIT_LOGS.schema.names and t.audit_logs.count() == len(rows)
    for n in (1, 2, 3, 20, 33, 40, 41, 60):
        assert lists.audit_recent(t.audit_logs_by_month, n).collect() == lists.audit_recent(log, n).collect()
    buf = io.StringIO()
    with redirect_stdout(buf):
        lists.audit_recent(t.audit_logs_by_month, 2).explain("formatted")
    assert "PartitionFilters: [isnotnull(log_month" in buf.getvalue() and "(log_month#" in buf.getvalue() and "2025-09-01" in buf.getvalue()
    with redirect_stdout(buf):
        lists.audit_recent(t.audit_logs_by_month, 20).explain("formatted")
    assert "2025-06-01" in buf.getvalue()
    write_store({"audit_logs": log.limit(0)}, root)
    assert lists.audit_recent(read_table(spark, f"{root}/audit_logs", AUDIT_LOGS), 5).count() == 0
