"""Page bundles compose the operators and run on seed rows."""

from __future__ import annotations

import seed as S
from ledgerleaf.plans import pages


class _Tables:
    def __init__(self, spark, seed):
        self.sales, self.products, self.addons = seed.sales, seed.products, seed.addons
        self.sale_addons, self.ingredients = seed.sale_addons, seed.ingredients
        self.users = spark.createDataFrame([(1, "a1", "staff", "A One", "active", "")],
                                           "user_id long, username string, role string, fullname string, "
                                           "status string, avatar string")
        self.audit_logs = spark.createDataFrame([], "log_id long, user_name string, action string, details string, "
                                                    "created_at timestamp_ntz")


def test_bundles(spark, seed):
    t = _Tables(spark, seed)
    d = pages.dashboard(t, "2026-05-14")
    assert d["kpis"].first().today_orders == 3 and d["top_daily"].count() == 4
    r = pages.reports(t, "2026-05-14", "weekly")
    assert r["summary"].first().total_transactions == 7 and r["categories"].count() == 4
    s = pages.sales_page(t, "Latte")
    assert s["sales"].count() == 7 and s["per_sale"].filter("incl_addons").count() == 6
    i = pages.inventory_page(t, stock_level="low")
    assert [x.ingredient_id for x in i["ingredients"].collect()] == [15]
    assert pages.products_page(t, "latte", "hot coffee")["products"].count() == 5
    assert pages.admin_page(t)["users"].count() == 1


def test_report_bundle_with_export(spark, seed):
    import tempfile

    from ledgerleaf.sources.export import read_export
    t = _Tables(spark, seed)
    r = pages.reports(t, "2026-05-14", "monthly", export_dir=tempfile.mkdtemp(prefix="ll-rep-"))
    import re
    assert re.search(r"/Report_Monthly_\d{4}-\d{2}-\d{2}$", r["export_folder"])
    assert read_export(spark, r["export_folder"])["transactions"].count() == 11
    assert r["top_sellers"].filter("top_window = 'monthly'").count() == 8
