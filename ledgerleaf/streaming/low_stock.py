"""Live low-stock alerts (T2): a stateless filter over a feed of stock changes.

Each accepted add or edit of an ingredient that leaves it at or under its
threshold raises an alert row; the sink is an append-only parquet table
(exactly-once through the file sink's commit log).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def low_stock_alerts_stream(changes: DataFrame) -> DataFrame:
    """Alerts for accepted (non-negative) adds and edits at or under the threshold."""
    s, t = F.col("stock"), F.col("low_stock_threshold")
    accepted = F.col("op").isin("add", "edit") & (s >= 0) & (t >= 0)
    return (changes.filter(accepted & (s <= t))
            .select("seq", "ingredient_id", F.col("ingredient_name").alias("label"), "stock",
                    "low_stock_threshold"))


def start_low_stock(spark: SparkSession, changes: DataFrame, out_path: str, checkpoint: str,
                    available_now: bool = True) -> StreamingQuery:
    writer = (low_stock_alerts_stream(changes).writeStream.outputMode("append").format("parquet")
              .option("path", out_path).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
