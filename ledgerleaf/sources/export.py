"""Report export (S4): the period's summary block and its transactions as CSV.

The page prints an HTML table with an .xls name; here the same two blocks go
out as header-ed CSV datasets under ``<out_dir>/Report_<Period>_<yyyy-mm-dd>/``,
written by the executors (no rows pass through the driver).
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import money_text
from ..functions.time import as_date
from ..operators.lists import report_transactions
from ..operators.metrics import report_summary

# Fixed value: the note printed when a period has no transactions.
EMPTY_NOTE = "No transactions for this period."

SUMMARY_SCHEMA = T.StructType([
    T.StructField("period_label", T.StringType()), T.StructField("generated_at", T.StringType()),
    T.StructField("file_name", T.StringType()), T.StructField("total_sales", T.DecimalType(20, 2)),
    T.StructField("total_sales_text", T.StringType()), T.StructField("total_transactions", T.LongType()),
    T.StructField("note", T.StringType())])
TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("product_name", T.StringType()), T.StructField("quantity", T.IntegerType()),
    T.StructField("total", T.DecimalType(10, 2)), T.StructField("total_text", T.StringType()),
    T.StructField("created_at", T.StringType()), T.StructField("status", T.StringType())])


def report_file_name(period: str, run_date) -> str:
    """The report's folder name; characters other than letters, digits, dot, dash and underscore become _."""
    label = re.sub(r"[^a-zA-Z0-9.\-_]", "_", period[:1].upper() + period[1:])
    return f"Report_{label}_{as_date(run_date).isoformat()}"


def export_report(sales: DataFrame, period: str, as_of, out_dir: str,
                  generated_at: dt.datetime | None = None, blocks: tuple = ("summary", "transactions")) -> str:
    """Write the blocks for ``period`` at ``as_of``; return the report folder."""
    generated_at = generated_at or dt.datetime.now().replace(microsecond=0)
    name = report_file_name(period, generated_at)
    folder = f"{out_dir.rstrip('/')}/{name}"
    label = period[:1].upper() + period[1:]
    summary = report_summary(sales, period, as_of).select(
        F.lit(label).alias("period_label"),
        F.lit(generated_at.strftime("%Y-%m-%d %H:%M:%S")).alias("generated_at"),
        F.lit(name).alias("file_name"),
        "total_sales", money_text("total_sales", 2).alias("total_sales_text"),
        "total_transactions",
        F.when(F.col("total_transactions") == 0, F.lit(EMPTY_NOTE)).alias("note"))
    if "summary" in blocks:
        summary.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/summary")
    rows = report_transactions(sales, period, as_of).select(
        "product_name", "quantity", "total", money_text("total", 2).alias("total_text"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "status")
    # orderBy is a range partitioning: part files are written in order, newest first.
    if "transactions" in blocks:
        rows.write.mode("overwrite").option("header", True).csv(f"{folder}/transactions")
    return folder


def read_export(spark: SparkSession, folder: str, blocks: tuple = ("summary", "transactions")) -> dict[str, DataFrame]:
    opts = {"header": True, "enforceSchema": False}
    schemas = {"summary": SUMMARY_SCHEMA, "transactions": TRANSACTIONS_SCHEMA}
    return {b: spark.read.options(**opts).schema(schemas[b]).csv(f"{folder}/{b}") for b in blocks}
