"""The report page's figures from one scan against the single queries."""

from __future__ import annotations

import re
from decimal import Decimal as D

import seed as S
from ledgerleaf.operators import bundles, metrics, rankings
from test_plans import plan, stored  # noqa: F401


def test_equal_to_the_single_queries(spark, seed):
    for day in ("2026-05-14", "2026-05-01", "2030-01-01"):
        b = bundles.report_bundle(seed.sales, seed.products, day).checkpoint(eager=True)
        for period in ("daily", "weekly", "monthly", "all", "nonsense"):
            assert bundles.summary(b, period).collect() == metrics.report_summary(seed.sales, period, day).collect()
            assert bundles.stat_strip(b, period).collect() == metrics.report_stat_strip(seed.sales, period, day).collect()
        key = lambda r: (r.top_window, r.top_rank)
        want = rankings.top_products_windows(seed.sales, seed.products, day, True, False)
        assert sorted(bundles.top_sellers(b, seed.products).collect(), key=key) == sorted(want.collect(), key=key)
        by_rank = lambda r: r.category_rank
        assert (sorted(bundles.categories(b).collect(), key=by_rank)
                == sorted(rankings.category_ranking(seed.sales, seed.products).collect(), key=by_rank))


def test_one_scan_of_the_ledger(stored):  # noqa: F811
    sales, products = stored
    p = plan(bundles.report_bundle(sales, products, "2026-05-14"))
    assert len(re.findall(r"Scan parquet", p.split("\n\n")[0])) == 2     # the ledger and the catalogue, once each
    assert "sales_id" not in re.search(r"ReadSchema: struct<[^>]*total[^>]*>", p).group(0)


def test_unknown_products_and_spellings(spark, seed):
    sales = seed.sales.limit(0).unionByName(spark.createDataFrame(
        [(1, 1, "a", 1, D("1.00"), S.dt.datetime(2026, 5, 1), "Completed", None), (2, None, "gone", 2, D("2.00"), None, "COMPLETED", None),
         (3, 2, "b", None, D("4.00"), S.dt.datetime(2026, 5, 1), "Completed", None), (4, 1, "a", 1, D("8.00"), None, "VOID", None)],
        seed.sales.schema))
    products = spark.createDataFrame([(1, "a", "Caf\u00e9", D("1.00"), "Available", None), (2, "b", "CAFE", D("1.00"), "Available", None)],
                                     seed.products.schema)
    rows = {(r.level, r.product_name, r.category): (r.all_qty, r.all_sales, r.all_orders, r.daily_orders)
            for r in bundles.report_bundle(sales, products, "2026-05-01").collect()}
    assert rows == {("product", "a", "Caf\u00e9"): (1, D("1.00"), 1, 1), ("product", "gone", None): (2, D("2.00"), 1, 0),
                    ("product", "b", "CAFE"): (0, D("4.00"), 1, 1), ("category", None, "CAFE"): (1, D("5.00"), 2, 2),
                    ("all", None, None): (3, D("7.00"), 3, 2)}
    empty = bundles.report_bundle(sales.limit(0), products, "2026-05-01").collect()
    assert [(r.level, r.all_qty, r.all_orders) for r in empty] == [("all", 0, 0)]
