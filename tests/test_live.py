"""Live totals and alerts that follow cancels, voids, deletes and restocking, whatever the order of the feed."""

from __future__ import annotations

import datetime as dt
import random
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerleaf.operators import changes, filters
from ledgerleaf.streaming import live
from ledgerleaf.streaming.daily_sales import (dropped_rows, read_daily_sales, sale_file_stream, sales_events,
                                              start_daily_sales)

SALES = ("sales_id long, product_id long, product_name string, quantity int, total decimal(10,2), created_at timestamp_ntz, "
         "status string, product_image string")


def _sales(n, seed=1):
    rng = random.Random(seed)
    return [(i, 1, "Latte", 1, Decimal(rng.randint(1, 900)) / 4, dt.datetime(2024, 1, 1 + rng.randint(0, 5), 9), "Completed", None)
            for i in range(n)]


def _totals(rows):
    return {r.sale_day: (r.total_sales, r.order_count) for r in rows.collect()}


def _feed(spark, root, events, name):
    """One more file of the feed, and a run over what is new."""
    spark.createDataFrame(events, live.EVENTS).coalesce(1).write.parquet(f"{root}/in/{name}")
    stream = spark.readStream.schema(live.EVENTS).option("recursiveFileLookup", True).parquet(f"{root}/in")
    live.start_live_totals(spark, stream, f"{root}/out", f"{root}/ckpt").awaitTermination()
    return _totals(live.read_live_totals(spark, f"{root}/out"))


def test_totals_step_by_step(spark):
    root = tempfile.mkdtemp(prefix="ll-live-")
    day, other = dt.date(2024, 1, 1), dt.date(2024, 1, 2)

    def sale(i, d=day):
        return ("sale", i, d, Decimal("10.00"))

    def gone(i):
        return ("withdraw", i, None, None)

    assert _feed(spark, root, [sale(1), sale(2), gone(9)], "a") == {day: (Decimal(20), 2)}
    assert _feed(spark, root, [gone(1), sale(9), sale(2), sale(3, other)], "b") == {day: (Decimal(10), 1), other: (Decimal(10), 1)}
    assert _feed(spark, root, [gone(1), gone(3), sale(1), sale(4), gone(4)], "c") == {day: (Decimal(10), 1)}
    assert _feed(spark, root, [gone(2)], "d") == {}


def test_totals_equal_the_final_table(spark):
    root, rng = tempfile.mkdtemp(prefix="ll-live-"), random.Random(3)
    sales = spark.createDataFrame(_sales(400), SALES)
    cancels = spark.createDataFrame([(i, rng.randrange(500)) for i in range(120)], "request_id long, sales_id long")
    voids = spark.createDataFrame([(i, rng.randrange(500)) for i in range(60)], "request_id long, sales_id long")
    events = live.sale_landed(sales).unionByName(live.sale_withdrawn(cancels)).unionByName(live.sale_withdrawn(voids))
    events.unionByName(events).repartition(7).write.parquet(f"{root}/in")  # in no order, and twice
    stream = sale_file_stream(spark, f"{root}/in", events.schema, max_files_per_trigger=1)
    live.start_live_totals(spark, stream, f"{root}/out", f"{root}/ckpt").awaitTermination()
    final = changes.apply_voids(changes.cancel_sales(sales, cancels), voids)
    want = _totals(filters.completed(final).groupBy(F.to_date("created_at").alias("sale_day"))
                   .agg(F.sum("total").alias("total_sales"), F.count("*").alias("order_count")))
    assert _totals(live.read_live_totals(spark, f"{root}/out")) == want


FEED = ("seq long, op string, ingredient_id long, ingredient_name string, stock int, low_stock_threshold int, unit string, "
        "image string")


def test_alerts_are_withdrawn(spark):
    root = tempfile.mkdtemp(prefix="ll-live-")

    def run(rows, name):
        spark.createDataFrame([(*r, "Box", None) for r in rows], FEED).coalesce(1).write.parquet(f"{root}/in/{name}")
        stream = spark.readStream.schema(FEED).option("recursiveFileLookup", True).parquet(f"{root}/in")
        live.start_live_alerts(spark, stream, None, f"{root}/out", f"{root}/ckpt").awaitTermination()
        return {(r.ingredient_id, r.label, r.stock) for r in live.read_live_alerts(spark, f"{root}/out").collect()}

    assert run([(1, "add", 1, " Milk ", 2, 5), (2, "add", 2, "Cups", 50, 5), (9, "edit", 7, "Ghost", 1, 5)], "a") == {(1, "Milk", 2)}
    assert run([(4, "edit", 1, "Milk", 40, 5), (5, "edit", 2, "Cups", 5, 5)], "b") == {(2, "Cups", 5)}
    assert run([(3, "edit", 1, "Milk", 1, 5), (6, "edit", 2, "Cups", -1, 5)], "c") == {(2, "Cups", 5)}  # late; not accepted
    assert run([(7, "delete", 2, None, None, None)], "d") == set()


def test_alerts_equal_the_final_table(spark, seed):
    root, rng = tempfile.mkdtemp(prefix="ll-live-"), random.Random(5)
    table = seed.ingredients
    ids = [r.ingredient_id for r in table.collect()] + [901, 902, 903]
    rows = [(k, rng.choice(["add", "edit", "edit", "edit", "delete"]), rng.choice(ids), f"Item {k}", rng.randint(-1, 12),
             rng.randint(-1, 9), "Box", None) for k in range(200)]
    feed = spark.createDataFrame(rows, FEED)
    feed.repartition(6).write.parquet(f"{root}/in")
    table.write.parquet(f"{root}/table")
    live.start_live_alerts(spark, sale_file_stream(spark, f"{root}/in", feed.schema, max_files_per_trigger=1),
                           sale_file_stream(spark, f"{root}/table", table.schema), f"{root}/out", f"{root}/ckpt").awaitTermination()
    final = filters.low_stock_alerts(changes.upsert_ingredients(table, feed)["ingredients"])
    got = live.read_live_alerts(spark, f"{root}/out").select("label", "stock", "low_stock_threshold")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, final.collect()))


def test_files_delivered_twice_count_once(spark):
    root = tempfile.mkdtemp(prefix="ll-live-")
    sales = spark.createDataFrame(_sales(300), SALES)
    for name in ("a", "b"):
        sales.repartition(2).write.parquet(f"{root}/in/{name}")
    stream = (spark.readStream.schema(sales.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
              .parquet(f"{root}/in"))
    query = start_daily_sales(spark, sales_events(stream, id_col="sales_id"), f"{root}/out", f"{root}/ckpt", mode="distinct",
                              lateness="30 days")
    query.awaitTermination()
    want = _totals(sales.groupBy(F.to_date("created_at").alias("sale_day"))
                   .agg(F.sum("total").alias("total_sales"), F.count("*").alias("order_count")))
    assert _totals(read_daily_sales(spark, f"{root}/out", "distinct")) == want
    assert dropped_rows(query) == {"late": 0, "repeated": 300}


def test_rows_behind_the_watermark_are_lost_and_reported(spark):
    """What ``update`` and ``distinct`` lose where ``partial`` does not."""
    old = [(900 + i, 1, "Latte", 1, Decimal(5), dt.datetime(2023, 6, 1), "Completed", None) for i in range(4)]
    for mode in ("update", "distinct"):
        root = tempfile.mkdtemp(prefix="ll-live-")

        def run(rows, name):
            spark.createDataFrame(rows, SALES).coalesce(1).write.parquet(f"{root}/in/{name}")
            stream = spark.readStream.schema(SALES).option("recursiveFileLookup", True).parquet(f"{root}/in")
            q = start_daily_sales(spark, sales_events(stream, id_col="sales_id"), f"{root}/out", f"{root}/ckpt", mode=mode,
                                  lateness="1 day")
            q.awaitTermination()
            return dropped_rows(q)["late"]

        assert run(_sales(20), "a") == 0
        assert run(old, "b") in (1, 4)  # counted by day in update mode, by row in distinct mode
        days = _totals(read_daily_sales(spark, f"{root}/out", mode))
        assert dt.date(2023, 6, 1) not in days and sum(n for _, n in days.values()) == 20


def test_feed_files_grow_in_number(spark, monkeypatch):
    """A landed feed is no fixed number of files, which would each be a task's share; the micro-batches stay as many."""
    from types import SimpleNamespace
    from ledgerleaf.plans import queries_ops
    sales = spark.createDataFrame(_sales(20000), SALES)
    paths, fresh = {}, queries_ops.scratch_path
    monkeypatch.setattr(queries_ops, "scratch_path", lambda s, name: paths.setdefault(name, []).append(fresh(s, name)) or paths[name][-1])
    want = _totals(sales.groupBy(F.to_date("created_at").alias("sale_day"))
                   .agg(F.sum("total").alias("total_sales"), F.count("*").alias("order_count")))

    def run(rows):
        paths.clear()
        got = _totals(queries_ops._distinct_sales(SimpleNamespace(spark=spark, sales=rows)))
        feed = spark.read.parquet(paths["t1-twice-feed"][-1])
        per_file = [r["count"] for r in feed.groupBy(F.input_file_name()).count().collect()]
        assert sum(per_file) == 2 * rows.count()
        return got, per_file, spark.read.parquet(paths["t1-twice-out"][-1]).select("batch_id").distinct().count()

    got, per_file, batches = run(sales.repartition(24))
    assert got == want and batches == 2
    assert len(per_file) == 48 and max(per_file) <= sum(per_file) / 24
    got, per_file, batches = run(sales.coalesce(1).limit(40))
    assert len(per_file) == 4 and batches == 2 and sum(n for _, n in got.values()) == 40
