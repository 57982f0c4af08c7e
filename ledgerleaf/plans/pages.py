"""Page bundles: what each screen of the shop shows.

Each function returns a dict of lazy DataFrames; nothing runs until the
caller acts on one. Where the screen asked the database several questions
about ``sales``, the bundle uses the single-scan conditional aggregates.
"""

from __future__ import annotations

from ..operators import bundles, filters, inventory, lists, metrics, rankings
from ..session import ensure_checkpoint_dir
from ..sources.export import export_report


def dashboard(t, as_of) -> dict:
    # The three best-seller lists come from one scan and one aggregate.
    top = rankings.top_products_windows(t.sales, t.products, as_of, completed_only=False, require_image=True)
    return {
        "kpis": metrics.dashboard_kpis(t.sales, as_of),
        "inventory": inventory.inventory_by_stock(t.ingredients),
        "top_sellers": top,
        **{f"top_{w}": lists.top_products_display(top.filter(top.top_window == w), 0) for w in rankings.TOP_WINDOWS},
        "low_stock_count": inventory.low_stock_count(t.ingredients),
    }


def reports(t, as_of, period: str = "daily", inv_status: str | None = None, inv_unit: str | None = None,
            export_dir: str | None = None) -> dict:
    # Every figure but the list of transactions comes from one scan, kept once (its rows are in the number of products).
    ensure_checkpoint_dir(t.sales.sparkSession)
    figures = bundles.report_bundle(t.sales, t.products, as_of).checkpoint(eager=True)
    out = {
        "summary": bundles.summary(figures, period),
        "stat_strip": bundles.stat_strip(figures, period),
        "transactions": lists.report_transactions(t.sales, period, as_of),
        "top_sellers": bundles.top_sellers(figures, t.products),
        "categories": bundles.categories(figures),
        "inventory": inventory.inventory_report(t.ingredients, inv_status, inv_unit),
        "unit_options": inventory.unit_options(t.ingredients),
        "low_stock_count": inventory.low_stock_count(t.ingredients),
    }
    if export_dir:
        out["export_folder"] = export_report(t.sales, period, as_of, export_dir)
    return out


def sales_page(t, search: str | None = None, date: str | None = None) -> dict:
    listed = lists.sales_list(filters.sales_search(t.sales, search, date), t.products)
    return {
        "sales": listed,
        "addon_lines": lists.sales_with_addons(listed.drop("product_category"), t.sale_addons),
        "per_sale": lists.sales_addon_rollup(listed, t.sale_addons),
        "badges": lists.sale_status_badges(listed),
        "totals": metrics.sales_page_totals(t.sales),
        "menu_products": filters.available_products(t.products),
        "menu_addons": filters.available_addons(t.addons),
    }


def inventory_page(t, search: str | None = None, unit: str | None = None, stock_level: str | None = None) -> dict:
    found = filters.ingredient_search(t.ingredients, search, unit, stock_level)
    return {
        "ingredients": found.select("*", inventory.stock_class_col("card").alias("card_class"),
                                    inventory.stock_pct_col().alias("stock_pct")),
        "alerts": filters.low_stock_alerts(t.ingredients),
        "low_stock_count": inventory.low_stock_count(t.ingredients),
    }


def products_page(t, search: str | None = None, category: str | None = None, status: str | None = None) -> dict:
    return {"products": filters.product_search(t.products, search, category, status),
            "low_stock_count": inventory.low_stock_count(t.ingredients)}


def admin_page(t) -> dict:
    return {"users": lists.user_list(t.users), "audit": lists.audit_recent(getattr(t, "audit_logs_by_month", t.audit_logs), 20),
            "low_stock_count": inventory.low_stock_count(t.ingredients)}
