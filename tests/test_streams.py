"""Streams (T1, T2) equal their batch forms on the same files."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

import seed as S
from ledgerleaf.operators import filters
from ledgerleaf.streaming.daily_sales import read_daily_sales, sales_events, start_daily_sales
from ledgerleaf.streaming.low_stock import start_low_stock


def _batch_daily(sales):
    return {r.d: (r.t, r.n) for r in filters.completed(sales).groupBy(F.to_date("created_at").alias("d"))
            .agg(F.sum("total").alias("t"), F.count("*").alias("n")).collect()}


def test_daily_sales_stream_equals_batch(spark, seed):
    root = tempfile.mkdtemp(prefix="ll-t1-")
    seed.sales.repartition(3).write.parquet(f"{root}/in")
    for mode in ("complete", "update"):
        stream = spark.readStream.schema(seed.sales.schema).parquet(f"{root}/in")
        q = start_daily_sales(spark, sales_events(stream), f"{root}/out-{mode}", f"{root}/ckpt-{mode}", mode=mode)
        q.awaitTermination()
        got = {r.sale_day: (r.total_sales, r.order_count) for r in read_daily_sales(spark, f"{root}/out-{mode}", mode).collect()}
        assert got == _batch_daily(seed.sales), mode


def test_daily_sales_stream_picks_up_new_files(spark, seed):
    root = tempfile.mkdtemp(prefix="ll-t1b-")
    first, second = seed.sales.filter(F.col("sales_id") < 35), seed.sales.filter(F.col("sales_id") >= 35)
    first.write.parquet(f"{root}/in/a")
    stream = spark.readStream.schema(seed.sales.schema).option("recursiveFileLookup", True).parquet(f"{root}/in")
    start_daily_sales(spark, sales_events(stream), f"{root}/out", f"{root}/ckpt").awaitTermination()
    second.write.parquet(f"{root}/in/b")
    stream = spark.readStream.schema(seed.sales.schema).option("recursiveFileLookup", True).parquet(f"{root}/in")
    start_daily_sales(spark, sales_events(stream), f"{root}/out", f"{root}/ckpt").awaitTermination()
    got = {r.sale_day: (r.total_sales, r.order_count) for r in read_daily_sales(spark, f"{root}/out").collect()}
    assert got == _batch_daily(seed.sales)


def test_low_stock_stream(spark):
    root = tempfile.mkdtemp(prefix="ll-t2-")
    feed = spark.createDataFrame([(1, "edit", 15, "Cream", 4, 5), (2, "edit", 16, "Cups", 30, 5),
                                  (3, "add", 99, "Oat", -1, 5), (4, "delete", 14, None, None, None)],
                                 "seq long, op string, ingredient_id long, ingredient_name string, stock int, "
                                 "low_stock_threshold int")
    feed.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(feed.schema).parquet(f"{root}/in")
    start_low_stock(spark, stream, f"{root}/out", f"{root}/ckpt").awaitTermination()
    assert [(r.ingredient_id, r.label) for r in spark.read.parquet(f"{root}/out").collect()] == [(15, "Cream")]


def test_update_mode_days_in_any_session_zone(spark, seed):
    root = tempfile.mkdtemp(prefix="ll-t1z-")
    seed.sales.write.parquet(f"{root}/in")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Manila")
        stream = spark.readStream.schema(seed.sales.schema).parquet(f"{root}/in")
        start_daily_sales(spark, sales_events(stream), f"{root}/out", f"{root}/ckpt", mode="update").awaitTermination()
        got = {r.sale_day: (r.total_sales, r.order_count) for r in read_daily_sales(spark, f"{root}/out", "update").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == _batch_daily(seed.sales)


def test_empty_stream_reads_empty(spark, seed):
    root = tempfile.mkdtemp(prefix="ll-t1e-")
    seed.sales.limit(0).write.parquet(f"{root}/in")
    for mode in ("complete", "update"):
        stream = spark.readStream.schema(seed.sales.schema).parquet(f"{root}/in")
        start_daily_sales(spark, sales_events(stream), f"{root}/out-{mode}", f"{root}/ck-{mode}", mode=mode).awaitTermination()
        assert read_daily_sales(spark, f"{root}/out-{mode}", mode).count() == 0
