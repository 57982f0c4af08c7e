"""Status words under the tables' collation, and audit rows without a name."""

from __future__ import annotations

from ledgerleaf.operators import changes, filters


def test_available_in_any_case_or_accent(spark):
    rows = [(1, "a", "Available"), (2, "b", "AVAILABLE"), (3, "c", "Av\u00e1ilable"), (4, "d", "Available "), (5, "e", None),
            (6, "f", "Unavailable")]
    addons = spark.createDataFrame([(i, n, None, s) for i, n, s in rows], "addon_id long, addon_name string, price decimal(10,2), status string")
    assert [r.addon_id for r in filters.available_addons(addons).collect()] == [1, 2, 3]
    products = spark.createDataFrame([(i, n, "c", None, s) for i, n, s in rows],
                                     "product_id long, product_name string, category string, price decimal(10,2), status string")
    assert [r.product_id for r in filters.available_products(products).collect()] == [1, 2, 3]


def test_an_add_without_a_username_is_logged(spark):
    feed = spark.createDataFrame([(1, "add", 7, None), (2, "add", 8, "ann")], "seq long, op string, user_id long, username string")
    assert [r.details for r in changes.audit_entries(feed).orderBy("seq").collect()] == ["Added user: ", "Added user: ann"]


def test_searches_ignore_accents_and_keep_wildcards(spark):
    names = ["Caf\u00e9 Latte", "CAFE\u0301 au lait, latte", "cafe-latte", "latte cafe", "Cafx Latte", "100% caf\u00e9", "a\\b", None]
    df = spark.createDataFrame(list(enumerate(names)), "product_id int, product_name string")

    def found(word, **kw):
        return sorted(r.product_id for r in filters.product_search(df, word, **kw).collect())
    assert found("cafe%latte") == [0, 1, 2]
    assert found("CAF\u00c9%l\u00e2tte") == [0, 1, 2]
    assert found("caf_ latte") == [0, 4]      # one wildcard is one letter, with or without its accent
    assert found("100\\% caf") == [5]
    assert found("a\\b") == [6]
    assert found("cafe%latte", fold_accents=False) == [1, 2]  # a mark of its own stands after the plain letter
    sales = df.selectExpr("product_id as sales_id", "product_name", "timestamp'2024-01-01' as created_at")
    assert sorted(r.sales_id for r in filters.sales_search(sales, "cafe%latte").collect()) == [0, 1, 2]


def test_folding_keeps_letters_that_are_no_accents(spark):
    from ledgerleaf.functions.text import fold_text, folded
    words = ["\u00df", "\u00f8", "\u00c5ngstr\u00f6m", "\u1ebf", "\u0439", "\u4e2d", "na\u00efve"]
    out = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(folded("w")).collect()]
    assert out == ["\u00df", "\u00f8", "Angstrom", "e", "\u0439", "\u4e2d", "naive"]
    assert out == [fold_text(w) for w in words]
