"""Live figures that follow later changes: daily totals (T1) and stock alerts.

A page that is loaded again shows a cancelled sale no more and a restocked item no more. Here the same
holds for the stream, with Spark's own aggregates as keyed state:

* ``live_totals``: one state row per sale id with the batch in which the sale first came and the batch in which
  it was first withdrawn (cancelled or voided). A row's batch time is the micro-batch's own, written to the
  offset log, so a retried batch sees the same. Each micro-batch turns the sales it touched into signed amounts per
  day: plus when a sale begins to count, minus when it stops. Events may come in any order and any number of times.
* ``live_alerts``: one state row per ingredient with its last add or delete and its last edit, by request number.
  Each micro-batch hands on the items it touched with their present stock; the newest row of an item decides
  whether it is on the alert list.

State grows by one row per sale and ingredient; for many sales set the RocksDB state store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import ingredient_requests
from ..operators.filters import is_completed
from ..sources.schemas import MONEY, MONEY_SUM

EVENTS = "kind string, sale_id bigint, sale_day date, amount decimal(10,2)"
ALERTS = "ingredient_id bigint, label string, stock int, low_stock_threshold int"
LIVE_TOTALS = "sale_day date, total_sales decimal(20,2), order_count bigint"


# =========================================================================== T1
def sale_landed(sales: DataFrame) -> DataFrame:
    """Sale rows as events; a sale that lands with another status than Completed never counts."""
    return sales.filter(is_completed()).select(
        F.lit("sale").alias("kind"), F.col("sales_id").alias("sale_id"), F.to_date("created_at").alias("sale_day"),
        F.col("total").cast(MONEY).alias("amount"))


def sale_withdrawn(requests: DataFrame, id_col: str = "sales_id") -> DataFrame:
    """Cancel or void requests as events."""
    return requests.filter(F.col(id_col).isNotNull()).select(
        F.lit("withdraw").alias("kind"), F.col(id_col).cast("long").alias("sale_id"),
        F.lit(None).cast("date").alias("sale_day"), F.lit(None).cast(MONEY).alias("amount"))


def signed_sales(events: DataFrame) -> DataFrame:
    """Streaming state per sale and, for each sale that a micro-batch touches, the change it makes to its day:
    sale_day, amount, sign (1, 0 or -1). Of rows that repeat a sale id the first to come counts."""
    now = F.current_timestamp()  # the micro-batch's time
    is_sale = F.col("kind") == "sale"
    state = events.withColumn("seen", now).groupBy("sale_id").agg(
        F.min(F.when(is_sale, F.struct("seen", "sale_day", "amount"))).alias("came"),
        F.min(F.when(~is_sale, F.col("seen"))).alias("gone"))

    def counts(came: Column, gone: Column) -> Column:
        return (came & ~gone).cast("int")

    after = counts(F.col("came").isNotNull(), F.col("gone").isNotNull())
    before = counts(F.coalesce(F.col("came.seen") < now, F.lit(False)), F.coalesce(F.col("gone") < now, F.lit(False)))
    return state.select("came.sale_day", "came.amount", (after - before).alias("sign"))


def start_live_totals(spark: SparkSession, events: DataFrame, out_path: str, checkpoint: str,
                      available_now: bool = True) -> StreamingQuery:
    """Each micro-batch writes its change per day to a folder of its own; a retried batch replaces it."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        amount, sign = F.col("amount") * F.col("sign"), F.col("sign")
        (batch.filter(sign != 0).groupBy("sale_day")
         .agg(F.sum(amount).cast(MONEY_SUM).alias("total_sales"), F.sum(sign.cast("long")).alias("order_count"))
         .write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}"))

    writer = (signed_sales(events).writeStream.outputMode("update").foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_live_totals(spark: SparkSession, out_path: str) -> DataFrame:
    """Totals per day so far; a day whose sales were all withdrawn is gone. Reads one row per day and micro-batch."""
    return (spark.read.schema(LIVE_TOTALS).parquet(out_path).groupBy("sale_day")
            .agg(F.sum("total_sales").cast(MONEY_SUM).alias("total_sales"), F.sum("order_count").alias("order_count"))
            .filter("order_count <> 0"))


# =========================================================================== T2
def stock_rows(ingredients: DataFrame) -> DataFrame:
    """The table before the feed begins, as add requests that precede all others."""
    return ingredients.select(F.lit(-1).cast("long").alias("seq"), F.lit("add").alias("op"), "ingredient_id",
                              "ingredient_name", "stock", "low_stock_threshold")


def present_stock(feed: DataFrame) -> DataFrame:
    """Streaming latest row per ingredient over accepted requests: ingredient_id, label, stock, low_stock_threshold,
    alert. An edit counts if it comes after the last add; after a delete, or without an add, there is no item."""
    row = F.struct("seq", F.col("op").alias("op"), "ingredient_name", "stock", "low_stock_threshold")
    latest = feed.groupBy("ingredient_id").agg(
        F.max(F.when(F.col("op").isin("add", "delete"), row)).alias("base"),
        F.max(F.when(F.col("op") == "edit", row)).alias("edit"))
    edited = F.coalesce(F.col("edit.seq") > F.col("base.seq"), F.lit(False))
    now = F.when(edited, F.col("edit")).otherwise(F.col("base"))
    return (latest.withColumn("now", now).select(
        "ingredient_id", F.col("now.ingredient_name").alias("label"), "now.stock", "now.low_stock_threshold",
        F.coalesce((F.col("base.op") == "add") & (F.col("now.stock") <= F.col("now.low_stock_threshold")),
                   F.lit(False)).alias("alert")))


def start_live_alerts(spark: SparkSession, changes: DataFrame, ingredients: DataFrame | None, out_path: str,
                      checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """``changes`` is the stream of inventory requests; ``ingredients`` a stream of the rows that were there before."""
    accepted = ingredient_requests(changes)[0].select(
        "seq", "op", "ingredient_id", "ingredient_name", "stock", "low_stock_threshold")
    feed = accepted if ingredients is None else accepted.unionByName(stock_rows(ingredients))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = (present_stock(feed).writeStream.outputMode("update").foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_live_alerts(spark: SparkSession, out_path: str) -> DataFrame:
    """Items at or under their threshold now; one that was restocked or deleted since is not among them."""
    rows = spark.read.schema(f"{ALERTS}, alert boolean, batch_id bigint").parquet(out_path)
    newest = rows.groupBy("ingredient_id").agg(
        F.max_by(F.struct("label", "stock", "low_stock_threshold", "alert"), "batch_id").alias("now"))
    return newest.filter("now.alert").select("ingredient_id", "now.label", "now.stock", "now.low_stock_threshold")
