"""Table changes (M1-M9): rules, repeats in one batch, invariants."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

import seed as S
from ledgerleaf.operators import changes

RUN = dt.datetime(2026, 5, 20, 9, 0, 0)


def test_record_sales_rules(spark, seed):
    req = spark.createDataFrame([(1, 22, 2), (2, 999, 1), (3, 22, 0), (4, 30, 1), (5, 0, 1)],
                                "request_id long, product_id long, quantity int")
    # ids [1, 1, 99, unavailable 4]: add-on 1 counts once.
    addons = seed.addons.unionByName(spark.createDataFrame([(4, "Gone", D("5.00"), "Unavailable")], seed.addons.schema))
    ra = spark.createDataFrame([(1, 1), (1, 1), (1, 99), (1, 4)], "request_id long, addon_id long")
    out = changes.record_sales(req, ra, seed.products, addons, RUN)
    sales = {r.sales_id: r for r in out["sales"].collect()}
    assert set(sales) == {1, 4}                       # unavailable product 30 is accepted
    assert sales[1].total == D("210.00")              # 2 * (85 + 20)
    assert sales[1].status == "Completed" and sales[1].created_at == RUN
    assert [(r.sale_id, r.addon_id) for r in out["sale_addons"].collect()] == [(1, 1)]
    rej = {r.request_id: r.reason for r in out["rejects"].collect()}
    assert rej == {2: changes.MSG_PRODUCT_NOT_FOUND, 3: changes.MSG_INVALID_SALE_REQUEST,
                   5: changes.MSG_INVALID_SALE_REQUEST}


def test_cancel_only_completed_and_idempotent(spark, seed):
    req = spark.createDataFrame([(1, 25), (2, 26), (3, 26), (4, 9999)], "request_id long, sales_id long")
    once = changes.cancel_sales(seed.sales, req)
    twice = changes.cancel_sales(once, req)
    st = {r.sales_id: r.status for r in once.collect()}
    assert st[25] == "Cancelled" and st[26] == "Cancelled" and st[27] == "Completed"
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.count() == seed.sales.count()


def test_void_any_status_and_rejects(spark, seed):
    req = spark.createDataFrame([(1, 25, "  wrong order \t"), (2, 26, "x"), (3, 26, "again"), (4, -3, "neg"),
                                 (5, 777, "unknown")], "request_id long, sales_id long, reason string")
    out = changes.void_sales(seed.sales, req, None, RUN)
    st = {r.sales_id: r.status for r in out["sales"].collect()}
    assert st[25] == "VOID" and st[26] == "VOID" and st[27] == "Completed"
    ledger = sorted((r.void_id, r.sale_id, r.reason) for r in out["sales_void"].collect())
    assert ledger == [(1, 25, "wrong order"), (2, 26, "x"), (3, 26, "again")]
    assert {r.request_id: r.reason for r in out["rejects"].collect()} == {
        4: changes.MSG_INVALID_SALE, 5: changes.MSG_UNKNOWN_SALE}


CH = "seq long, op string, product_id long, product_name string, price string, category string, status string, image string"


def test_product_changes_in_sequence(spark, seed):
    ch = spark.createDataFrame([
        (1, "edit", 22, " Matcha Latte XL ", "95.5abc", "Hot Coffee", "Available", "new22.webp"),
        (2, "edit", 22, "Matcha Latte XXL", "99", "Hot Coffee", "Available", ""),     # keeps new22.webp
        (3, "add", 500, " New Thing ", "10", "Snacks", "Available", None),
        (4, "edit", 500, "New Thing 2", "11", "Snacks", "Unavailable", ""),
        (5, "delete", 17, None, None, None, None, None),
        (6, "edit", 17, "ghost", "1", "x", "x", "x"),                                  # no row: no-op
        (7, "edit", 9999, "ghost", "1", "x", "x", "x"),                                # no row: no-op
        (8, "delete", 600, None, None, None, None, None),
        (9, "add", 600, "Back", "5", "Snacks", "Available", "b.webp"),                 # delete then add: lives
    ], CH)
    new = {r.product_id: r for r in changes.upsert_products(seed.products, ch)["products"].collect()}
    assert new[22].product_name == "Matcha Latte XXL" and new[22].price == D("99.00")
    assert new[22].image == "new22.webp"
    assert new[500].product_name == "New Thing 2" and new[500].image == "" and new[500].price == D("11.00")
    assert 17 not in new and 9999 not in new
    assert new[600].product_name == "Back"
    assert len(new) == seed.products.count() - 1 + 2
    sales = changes.delete_products_cascade(seed.sales, ch)
    assert sales.count() == seed.sales.count()
    assert sales.filter(F.col("product_id").isNull()).count() == 2     # the two Americano (17) sales
    assert sales.filter(F.col("product_name") == "Americano").count() == 3


def test_upsert_then_delete_restores(spark, seed):
    add = spark.createDataFrame([(1, "add", 900, "Tmp", "1", "Snacks", "Available", "")], CH)
    added = changes.upsert_products(seed.products, add)["products"]
    dele = spark.createDataFrame([(2, "delete", 900, None, None, None, None, None)], CH)
    back = changes.upsert_products(added, dele)["products"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, seed.products.collect()))


def test_ingredient_rejects_and_text_numbers(spark, seed):
    ch = spark.createDataFrame([
        (1, "edit", 15, " All Purpose Cream ", "12 packs", "4", "Box-based", None),
        (2, "add", 100, "Oat Milk", "-1", "5", "Box-based", None),
        (3, "edit", 14, "Milk", "20", "-2", "Box-based", None),
        (4, "delete", 16, None, None, None, None, None),
    ], "seq long, op string, ingredient_id long, ingredient_name string, stock string, "
       "low_stock_threshold string, unit string, image string")
    out = changes.upsert_ingredients(seed.ingredients, ch)
    new = {r.ingredient_id: r for r in out["ingredients"].collect()}
    assert new[15].stock == 12 and new[15].low_stock_threshold == 4 and new[15].ingredient_name == "All Purpose Cream"
    assert 100 not in new and 16 not in new and new[14].low_stock_threshold == 5
    assert sorted(r.request_id for r in out["rejects"].collect()) == [2, 3]


def test_account_intake(spark):
    users = spark.createDataFrame([(1, "Alice01", "admin", "Alice A", "active", "")],
                                  "user_id long, username string, role string, fullname string, status string, avatar string")
    req = spark.createDataFrame([(1, "ab", "bobby"), (2, "a b", "bob_by"), (3, "Bob B", "alice01"),
                                 (4, "Carl C", "carl"), (5, "Carl D", "CARL"), (6, "  ", "dave"),
                                 (7, "Eve E", "  eve  ")], "seq long, fullname string, username string")
    out = changes.account_intake(req, users)
    acc = {r.username: r for r in out["users"].collect()}
    assert set(acc) == {"carl", "eve"}
    assert acc["carl"].user_id == 2 and acc["eve"].user_id == 3 and acc["carl"].role == "user"
    rej = {r.request_id: r.reason for r in out["rejects"].collect()}
    assert rej == {1: changes.MSG_FULLNAME_SHORT, 2: changes.MSG_USERNAME_INVALID, 3: changes.MSG_USERNAME_TAKEN,
                   5: changes.MSG_USERNAME_TAKEN, 6: changes.MSG_FIELDS_REQUIRED}


def test_users_and_audit(spark):
    users = spark.createDataFrame([(1, "a1", "staff", "A One", "active", "x.png"), (2, "b2", "staff", "B Two", "active", "")],
                                  "user_id long, username string, role string, fullname string, status string, avatar string")
    ch = spark.createDataFrame([(10, "edit", 1, "A Uno", "admin", "inactive", None), (11, "delete", 2, None, None, None, None)],
                               "seq long, op string, user_id long, fullname string, role string, status string, avatar string")
    new = changes.upsert_users(users, ch)["users"].collect()
    assert [(r.user_id, r.username, r.fullname, r.role, r.status, r.avatar) for r in new] == [
        (1, "a1", "A Uno", "admin", "inactive", "x.png")]
    audit = spark.createDataFrame([(5, "root", "Reset Logs", "All audit logs cleared", RUN)],
                                  "log_id long, user_name string, action string, details string, created_at timestamp_ntz")
    log = changes.audit_append(audit, changes.audit_entries(ch), "boss", RUN).orderBy("log_id").collect()
    assert [(r.log_id, r.action, r.details) for r in log] == [
        (5, "Reset Logs", "All audit logs cleared"), (6, "Edit User", "Edited user ID: 1"),
        (7, "Delete User", "Deleted user ID: 2")]


def test_reset(spark, seed):
    audit = spark.createDataFrame([(5, "root", "x", "y", RUN)],
                                  "log_id long, user_name string, action string, details string, created_at timestamp_ntz")
    out = changes.reset_tables({"sales": seed.sales, "sale_addons": seed.sale_addons,
                                "sales_void": seed.sale_addons.limit(0), "audit_logs": audit}, "boss", RUN)
    assert out["sales"].count() == 0 and out["sale_addons"].count() == 0
    r = out["audit_logs"].collect()
    assert [(x.log_id, x.action) for x in r] == [(6, "Reset Logs")]


def test_record_sales_array_form(spark, seed):
    req = spark.createDataFrame([(1, 22, 2, [1, 1, 99, 3]), (2, 25, 1, None)],
                                "request_id long, product_id long, quantity int, addon_ids array<long>")
    out = changes.record_sales(req, None, seed.products, seed.addons, RUN)
    totals = {r.sales_id: r.total for r in out["sales"].collect()}
    assert totals == {1: D("230.00"), 2: D("85.00")}      # 2 * (85 + 20 + 10)
    assert sorted((r.sale_id, r.addon_id) for r in out["sale_addons"].collect()) == [(1, 1), (1, 3)]
