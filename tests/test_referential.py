"""Deletes and key changes over the foreign-key graph, against a plain walk."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import referential

SALES = "sales_id long, product_id long, product_name string"
VOIDS = "void_id long, sale_id long, reason string"
LINES = "id long, sale_id long, addon_id long"
PRODUCTS = "product_id long, product_name string"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    return {"products": spark.createDataFrame([(i, f"p{i}") for i in range(20)], PRODUCTS),
            "sales": spark.createDataFrame([(i, rng.choice([None, *range(20)]), "x") for i in range(60)], SALES),
            "sales_void": spark.createDataFrame([(i, rng.choice([None, *range(60)]), "r") for i in range(40)], VOIDS),
            "sale_addons": spark.createDataFrame([(i, rng.randrange(30), 1) for i in range(40)], LINES)}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_delete_sales_cascades_or_is_refused(spark, tables):
    asked = [(1, 3), (2, 40), (3, 40), (4, 45), (5, 99), (6, 7), (7, None)]
    out = referential.delete_rows(tables, "sales", spark.createDataFrame(asked, "request_id long, sales_id long"), "sales_id")
    have, held = {r.sales_id for r in tables["sales"].collect()}, {r.sale_id for r in tables["sale_addons"].collect()}
    gone = {k for _, k in asked if k in have and k not in held}
    assert gone and rows(out["tables"]["sales"]) == [r for r in rows(tables["sales"]) if r[0] not in gone]
    assert rows(out["tables"]["sales_void"]) == [r for r in rows(tables["sales_void"]) if r[1] not in gone]
    assert rows(out["tables"]["sale_addons"]) == rows(tables["sale_addons"])
    assert rows(out["rejects"]) == sorted([(i, referential.MSG_UNKNOWN_KEY if k not in have else referential.MSG_REFERENCED)
                                           for i, k in asked if k not in gone], key=str)


def test_delete_products_clears_references(spark, tables):
    out = referential.delete_rows(tables, "products", spark.createDataFrame([(1, 4), (2, 5)], "request_id long, pid long"), "pid")
    assert rows(out["tables"]["products"]) == [r for r in rows(tables["products"]) if r[0] not in (4, 5)]
    assert rows(out["tables"]["sales"]) == sorted(((s, None if p in (4, 5) else p, n) for s, p, n in rows(tables["sales"])), key=str)
    assert out["rejects"].count() == 0


def test_a_refusal_below_a_cascade_refuses_the_top(spark, tables, monkeypatch):
    links = [("sales", "product_id", "products", "product_id", "cascade"), ("sales_void", "sale_id", "sales", "sales_id", "cascade"),
             ("sale_addons", "sale_id", "sales", "sales_id", "restrict")]
    monkeypatch.setattr(referential, "FOREIGN_KEYS", links)
    out = referential.delete_rows(tables, "products", spark.createDataFrame([(i, i) for i in range(20)], "request_id long, k long"), "k")
    held = {r.sale_id for r in tables["sale_addons"].collect()}
    sales = rows(tables["sales"])
    stuck = {p for s, p, _ in sales if s in held and p is not None}
    assert {r[0] for r in rows(out["rejects"])} == stuck and len(stuck) < 20
    left = [r for r in sales if r[1] is None or r[1] in stuck]
    assert rows(out["tables"]["sales"]) == left
    kept = {s for s, _, _ in left}
    assert rows(out["tables"]["sales_void"]) == [r for r in rows(tables["sales_void"]) if r[1] is None or r[1] in kept]


def test_key_changes(spark, tables):
    asked = [(1, 3, 103), (2, 4, 5), (3, 6, 106), (4, 7, 106), (5, 77, 177), (6, 8, 8), (7, 3, 203), (8, 9, None)]
    out = referential.change_keys(tables, "products", spark.createDataFrame(asked, "request_id long, old long, new long"), "old", "new")
    names = {3: 103, 6: 106}
    assert rows(out["tables"]["products"]) == sorted(((names.get(k, k), n) for k, n in rows(tables["products"])), key=str)
    assert rows(out["tables"]["sales"]) == sorted(((s, names.get(p, p), n) for s, p, n in rows(tables["sales"])), key=str)
    taken, unknown = referential.MSG_KEY_TAKEN, referential.MSG_UNKNOWN_KEY
    assert rows(out["rejects"]) == [(2, taken), (4, taken), (5, unknown), (7, unknown), (8, taken)]
    sales = referential.change_keys(tables, "sales", spark.createDataFrame([(1, 3, 900), (2, 40, 901)], "request_id long, old long, new long"),
                                    "old", "new")
    held = {r.sale_id for r in tables["sale_addons"].collect()}
    assert 3 in held and 40 not in held and rows(sales["rejects"]) == [(1, referential.MSG_REFERENCED)]
    assert {r[1] for r in rows(sales["tables"]["sales_void"])} == {901 if r[1] == 40 else r[1] for r in rows(tables["sales_void"])}


def test_a_delete_passes_over_the_tables_once(spark, tables):
    """The lists of keys are found by one pass over each table that is asked, not by one for each size check and join."""
    passes = {}

    def counted(name, key):
        seen = passes[name] = spark.sparkContext.accumulator(0)

        def count(k):
            seen.add(1)
            return k
        read = F.udf(count, "long").asNondeterministic()
        return tables[name].withColumn(key, read(key))

    asked = spark.createDataFrame([(1, 3), (2, 40), (3, 40), (4, 45), (5, 99)], "request_id long, sales_id long")
    watched = {"sales": counted("sales", "sales_id"), "sales_void": counted("sales_void", "sale_id"),
               "sale_addons": counted("sale_addons", "sale_id")}
    out = referential.delete_rows(watched, "sales", asked, "sales_id")
    assert {k: v.value for k, v in passes.items()} == {"sales": 60, "sales_void": 0, "sale_addons": 40}
    assert rows(out["tables"]["sales"]) == [r for r in rows(tables["sales"]) if r[0] not in (40, 45)]
    assert passes["sales"].value == 120
    assert {r[0] for r in rows(out["rejects"])} == {1, 5}
    assert {k: v.value for k, v in passes.items()} == {"sales": 120, "sales_void": 0, "sale_addons": 40}


def test_a_key_change_finds_the_new_keys_once(spark, tables):
    seen = spark.sparkContext.accumulator(0)

    def count(k):
        seen.add(1)
        return k
    asked = spark.createDataFrame([(1, 3, 103), (2, 4, 104)], "request_id long, old long, new long")
    watched = asked.withColumn("old", F.udf(count, "long").asNondeterministic()("old"))
    out = referential.change_keys(tables, "products", watched, "old", "new")
    before = seen.value
    assert {r[0] for r in rows(out["tables"]["products"])} >= {103, 104}
    assert {r[1] for r in rows(out["tables"]["sales"])} >= {103, 104} and seen.value == before


def test_empty_batches_change_nothing(spark, tables):
    none = spark.createDataFrame([], "request_id long, old long, new long")
    for asked in (none, spark.createDataFrame([(1, 99, 199)], none.schema)):
        for out in (referential.delete_rows(tables, "sales", asked, "old"),
                    referential.change_keys(tables, "sales", asked, "old", "new")):
            assert {k: rows(v) for k, v in out["tables"].items()} == {k: rows(v) for k, v in tables.items()}
            assert out["rejects"].count() == asked.count()
