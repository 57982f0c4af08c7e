"""Live daily sales (T1): completed sales per calendar day from a file stream.

The dashboard re-runs its queries on every page load; here the same totals
are kept by a Structured Streaming query over the directory new sale files
land in. Two output modes:

* ``complete`` (default): state is one row per day; every trigger rewrites the
  whole (small) day table through ``foreachBatch``. Late rows of any age still
  land in their day, so the result always equals the batch totals.
* ``partial``: no state at all. Every micro-batch adds its own sums per day in a
  folder of its own (a retried batch overwrites it), and the reader adds them
  up, so late rows of any age land in their day at any number of days.
* ``update``: event-time watermark of ``lateness``; state for days older than
  the watermark is dropped (bounded state) and rows arriving later than that
  for them are lost: use it only where lateness is bounded. Each trigger appends its changed day rows with the batch id; the
  reader keeps the latest row per day.
* ``distinct``: as ``partial``, for feeds that deliver files twice: a sale id counts once
  (``dropDuplicatesWithinWatermark``). State holds the ids of the last ``lateness``; rows that come later than the watermark
  are dropped, and ``dropped_rows`` tells how many were, and how many repeated an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.schemas import MONEY, MONEY_SUM
from ..operators.filters import is_completed


def sale_file_stream(spark: SparkSession, path: str, schema, glob: str | None = None,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files landing under ``path`` as a stream, with a declared schema.

    ``max_files_per_trigger`` bounds each micro-batch, so a backlog (or an
    ``availableNow`` catch-up) is processed in slices instead of one huge batch.
    """
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.parquet(path)


def sales_events(stream: DataFrame, ts_col: str = "created_at", amount_col: str = "total",
                 status_col: str | None = "status", id_col: str | None = None) -> DataFrame:
    """Normalise a stream of sale rows: event time, calendar day, amount.

    ``event_time`` is a TIMESTAMP (watermarks reject TIMESTAMP_NTZ) whose UTC
    instant is the row's wall-clock time, so one-day windows line up with
    calendar days in any session time zone. ``id_col`` is carried along as ``event_id`` (for ``distinct`` mode).
    """
    s = stream
    if status_col is not None:
        s = s.filter(is_completed(status_col))
    wall = F.col(ts_col).cast("timestamp_ntz")
    event_time = F.make_timestamp(F.year(wall), F.month(wall), F.dayofmonth(wall), F.hour(wall), F.minute(wall),
                                  F.date_part(F.lit("SECOND"), wall), F.lit("UTC"))
    return s.select(
        event_time.alias("event_time"),
        F.to_date(F.col(ts_col)).alias("sale_day"),
        F.col(amount_col).cast(MONEY).alias("amount"),
        *([F.col(id_col).alias("event_id")] if id_col else []))


def daily_totals(events: DataFrame, mode: str = "complete", lateness: str = "1 day") -> DataFrame:
    """Streaming aggregate: per day, sum of amounts and order count.

    ``update`` mode groups by a one-day event-time window so the watermark can
    evict old days; the window start (a UTC midnight) names the day.
    """
    aggs = [F.sum("amount").cast(MONEY_SUM).alias("total_sales"), F.count(F.lit(1)).alias("order_count")]
    if mode == "update":
        day = F.date_from_unix_date((F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
        return (events.withWatermark("event_time", lateness)
                .groupBy(F.window("event_time", "1 day").alias("w")).agg(*aggs)
                .select(day.alias("sale_day"), "total_sales", "order_count"))
    return day_totals(events)


def day_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("sale_day").agg(F.sum("amount").cast(MONEY_SUM).alias("total_sales"),
                                          F.count(F.lit(1)).alias("order_count"))


def start_daily_sales(spark: SparkSession, events: DataFrame, out_path: str, checkpoint: str,
                      mode: str = "complete", lateness: str = "1 day", available_now: bool = True) -> StreamingQuery:
    """Run the daily totals stream into a parquet table at ``out_path``."""
    if mode == "distinct":
        totals = events.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["event_id"])
    else:
        totals = events if mode == "partial" else daily_totals(events, mode, lateness)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if mode == "update":
            if batch.isEmpty():      # e.g. the closing no-data batch that only moves the watermark
                return
            (batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
             .write.mode("append").parquet(out_path))
        elif mode in ("partial", "distinct"):
            day_totals(batch).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        else:
            # A version of its own, so a reader never meets a table that is being replaced.
            batch.write.mode("overwrite").parquet(f"{out_path}/version={batch_id}")

    writer = (totals.writeStream.outputMode("append" if mode in ("partial", "distinct") else mode).foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def dropped_rows(query: StreamingQuery) -> dict[str, int]:
    """Rows that a stopped query left out, over the micro-batches Spark keeps the progress of
    (``spark.sql.streaming.numRecentProgressUpdates``): later than the watermark, and repeated ids."""
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    return {"late": sum(s["numRowsDroppedByWatermark"] for s in states),
            "repeated": sum(s["customMetrics"].get("numDroppedDuplicateRows", 0) for s in states)}


DAILY_SCHEMA = "sale_day date, total_sales decimal(20,2), order_count bigint"


def read_daily_sales(spark: SparkSession, out_path: str, mode: str = "complete") -> DataFrame:
    """The day table written by ``start_daily_sales`` (empty if no batch has written yet)."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(out_path)
    except AnalysisException:
        return spark.createDataFrame([], DAILY_SCHEMA)
    if mode in ("partial", "distinct"):
        return df.groupBy("sale_day").agg(F.sum("total_sales").cast(MONEY_SUM).alias("total_sales"),
                                          F.sum("order_count").alias("order_count"))
    if mode != "update":
        newest = df.agg(F.max("version")).first()[0]
        return df.where(F.col("version") == newest).select("sale_day", "total_sales", "order_count")
    latest = df.groupBy("sale_day").agg(F.max(F.struct("batch_id", "total_sales", "order_count")).alias("r"))
    return latest.select("sale_day", F.col("r.total_sales").alias("total_sales"),
                         F.col("r.order_count").alias("order_count"))
