"""Conformance (S2), constraint audit (S3) and report export (S4) on rows that break the rules."""

from __future__ import annotations

import datetime as dt
import tempfile
from decimal import Decimal as D

from ledgerleaf.operators import integrity
from ledgerleaf.sources.export import EMPTY_NOTE, export_report, read_export
from ledgerleaf.sources.schemas import ADDONS, INGREDIENTS, SALES


def test_conform_defaults_types_and_rejects(spark):
    raw = spark.createDataFrame([("1", "Extra Shot", "Available"), ("x", "Bad Id", "Available"),
                                 ("3", None, "Available"), ("4", "Foam", "Gone"), ("5", "Syrup", None)],
                                "addon_id string, addon_name string, status string")
    ok, bad = integrity.conform(raw, ADDONS)
    assert [f.dataType for f in ok.schema] == [f.dataType for f in ADDONS.schema]
    got = {r.addon_id: (r.price, r.status) for r in ok.collect()}
    assert got == {1: (D("0.00"), "Available"), 5: (D("0.00"), None)}     # default price; NULL status allowed
    reasons = sorted(r._reason for r in bad.collect())
    assert reasons == ["ENUM status", "NOT NULL addon_name", "TYPE addon_id"]


def test_conform_missing_column_default(spark):
    raw = spark.createDataFrame([(1, "Milk", 3, 5)], "ingredient_id long, ingredient_name string, stock int, "
                                                      "low_stock_threshold int")
    ok, bad = integrity.conform(raw, INGREDIENTS)
    r = ok.first()
    assert (r.unit, r.image) == ("pcs", None) and bad.count() == 0
    now = dt.datetime(2026, 1, 2, 3, 4, 5)
    ok, _ = integrity.conform(spark.createDataFrame([(7,)], "sales_id long"), SALES, now)
    r = ok.first()
    assert (r.status, r.created_at) == ("Completed", now)


def test_schema_check_counts(spark):
    raw = spark.createDataFrame([(1, "a", D("1.00"), "Available"), (1, "b", D("1.00"), "Nope")],
                                ADDONS.schema)
    r = integrity.schema_check({"addons": raw}).first()
    assert (r.rows_read, r.rows_ok, r.enum_violations, r.not_null_violations) == (2, 1, 1, 0)


def test_constraint_audit_finds_violations(spark, seed):
    dup_sales = seed.sales.unionByName(seed.sales.limit(1))
    orphan_addons = spark.createDataFrame([(99, 9999, 1, "Extra Shot", D("20.00"))], seed.sale_addons.schema)
    users = spark.createDataFrame([(1, "Bob", "a", "x", "active", ""), (2, "bob", "a", "y", "active", "")],
                                  "user_id long, username string, role string, fullname string, status string, "
                                  "avatar string")
    tables = {"sales": dup_sales, "products": seed.products.filter("product_id <> 22"),
              "sale_addons": seed.sale_addons.unionByName(orphan_addons), "users": users, "addons": seed.addons}
    got = {r.constraint_name: r.violations for r in integrity.constraint_audit(tables).collect()}
    assert got["pk_sales"] == 2                 # the repeated row and its twin
    assert got["fk_sales_product_id"] == 3      # three Matcha Latte (22) sales lose their product
    assert got["fk_sale_addons_sale_id"] == 1
    assert got["uq_users_username"] == 2        # Bob and bob collide under the case-insensitive collation
    assert got["pk_products"] == 0 and got["enum_addons_status"] == 0


def test_export_blocks_and_empty_note(spark, seed):
    out = tempfile.mkdtemp(prefix="ll-export-")
    gen = dt.datetime(2026, 5, 14, 18, 0, 0)
    folder = export_report(seed.sales, "monthly", "2026-05-14", out, gen)
    assert folder.endswith("Report_Monthly_2026-05-14")
    blocks = read_export(spark, folder)
    s = blocks["summary"].first()
    assert (s.total_sales, s.total_transactions, s.note, s.total_sales_text) == (D("2681.00"), 11, None, "₱2,681.00")
    rows = blocks["transactions"].collect()
    assert len(rows) == 11 and rows[0].created_at == "2026-05-16 03:26:23"   # newest first
    folder = export_report(seed.sales, "daily", "2026-06-01", out, gen)
    s = read_export(spark, folder)["summary"].first()
    assert (s.total_transactions, s.note) == (0, EMPTY_NOTE)
