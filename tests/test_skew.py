"""A hot key (a third of all rows on one sale / one product) stays correct and gets split."""

from __future__ import annotations

import io
from contextlib import contextmanager, redirect_stdout

from pyspark.sql import functions as F

from ledgerleaf.operators import lists, rankings

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _hot_tables(spark):
    n = 6000
    sales = spark.range(n).select(
        F.col("id").alias("sales_id"),
        F.when(F.col("id") % 3 == 0, F.lit(22)).otherwise(F.col("id") % 40 + 100).alias("product_id"),
        F.lit("p").alias("product_name"), F.lit(1).alias("quantity"),
        F.lit(5).cast("decimal(10,2)").alias("total"),
        F.lit("2026-05-14 10:00:00").cast("timestamp_ntz").alias("created_at"),
        F.lit("Completed").alias("status"), F.lit("i").alias("product_image"))
    # 4000 add-on lines on sale 0 (a third of all lines), 2 on every odd sale.
    hot = spark.range(4000).select(F.lit(0).cast("long").alias("sale_id"), F.col("id").alias("addon_id"))
    rest = spark.range(1, n, 2).select(F.col("id").alias("sale_id"), F.lit(1).cast("long").alias("addon_id")) \
        .unionByName(spark.range(1, n, 2).select(F.col("id").alias("sale_id"), F.lit(2).cast("long").alias("addon_id")))
    sale_addons = hot.unionByName(rest).select("sale_id", "addon_id", F.lit("x").alias("addon_name"),
                                               F.lit(1).cast("decimal(10,2)").alias("price"))
    return sales, sale_addons


def test_hot_sale_is_split_and_exact(spark):
    sales, sale_addons = _hot_tables(spark)
    with conf(spark, SKEW_CONF):
        df = lists.sales_with_addons(sales, sale_addons)
        rows = df.groupBy("incl_addons").agg(F.count("*").alias("n")).collect()
        got = {r.incl_addons: r.n for r in rows}
        assert got == {True: 4000 + 2 * 3000, False: 6000 - 1 - 3000}
        df.collect()      # run this frame's own plan, so explain shows the final adaptive plan
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain()
        assert "skew=true" in buf.getvalue()


def test_hot_product_rankings_exact(spark):
    sales, _ = _hot_tables(spark)
    products = spark.range(200).select(F.col("id").alias("product_id"), F.lit("C").alias("category"),
                                       F.lit("n").alias("product_name"), F.lit(1).cast("decimal(10,2)").alias("price"),
                                       F.lit("Available").alias("status"), F.lit("i").alias("image"))
    with conf(spark, SKEW_CONF):
        top = rankings.top_products(sales, products, "2026-05-14", "daily", k=2).collect()
        assert [(r.product_id, r.qty_sold) for r in top] == [(22, 2000), (100, 100)]
        cat = rankings.category_ranking(sales, products).collect()
        assert [(r.category, r.total_quantity, r.category_rank) for r in cat] == [("C", 6000, 1)]
