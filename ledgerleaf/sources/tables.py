"""Reading and writing the ledger tables.

Parquet is the native store. Reads always pass the declared schema, so no
inference job runs and a missing column fails loudly. ``write_store`` lays out
the big ``sales`` table in month partitions (``sale_month``), range-sorted by
``created_at`` inside: period filters prune whole months (``PartitionFilters``)
and skip row groups by min/max statistics (``PushedFilters``) instead of
scanning the ledger.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import LOG_PARTITION, SALES, TABLES, TIME_PARTITIONS, TableSpec

SALES_COLUMNS = SALES.schema.names


def read_table(spark: SparkSession, path: str, spec: TableSpec, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(spec.schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def load_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Scan every ledger table under ``root/<table>`` with its declared schema."""
    root = root.rstrip("/")
    return {name: read_table(spark, f"{root}/{name}", spec, fmt) for name, spec in TABLES.items()}


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int = 64) -> DataFrame:
    """Scan one table of a live SQL database in parallel ranges of its key.

    Needs the JDBC driver jar on the classpath; it is not exercised by the tests
    (no database is available to them).
    """
    spec = TABLES[table]
    col = partition_column or spec.key[0]
    if lower is None or upper is None:
        return declared_columns(spark.read.jdbc(url, table, properties=properties), spec)
    df = spark.read.jdbc(url, table, column=col, lowerBound=lower, upperBound=upper,
                         numPartitions=num_partitions, properties=properties)
    return declared_columns(df, spec)


# Database columns that have another name there: (table, declared column) -> database column.
DATABASE_NAMES = {("audit_logs", "user_name"): "user"}


def declared_columns(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The declared columns of a database table under their declared names and types, and no other (so no
    password)."""
    return df.select([F.col(DATABASE_NAMES.get((spec.name, f.name), f.name)).cast(f.dataType).alias(f.name)
                      for f in spec.schema.fields])


def write_store(tables: dict[str, DataFrame], root: str, sales_files: int | None = None) -> None:
    """Write ledger tables as parquet under ``root/<table>``.

    ``sales`` is partitioned by month of ``created_at`` (``sale_month=...``
    directories, so period queries prune whole months before listing files)
    and, inside, range-partitioned on ``created_at`` (sampled bounds: a hot day
    is split across files, not piled into one) and sorted, so row-group
    statistics skip the rest of the month. ``audit_logs`` is laid out likewise under ``log_month``.
    """
    root = root.rstrip("/")
    for name, df in tables.items():
        spec = TABLES[name]
        out = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema.fields])
        writer_parts: list[str] = []
        if name == "sales":
            n = sales_files or int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            part = TIME_PARTITIONS["created_at"]
            out = (out.repartitionByRange(n, "created_at", "sales_id").sortWithinPartitions("created_at")
                   .withColumn(part, F.trunc(F.to_date("created_at"), "month")))
            writer_parts = [part]
        elif name == "audit_logs":
            out = (out.repartitionByRange("created_at", "log_id").sortWithinPartitions("created_at")
                   .withColumn(LOG_PARTITION, F.trunc(F.to_date("created_at"), "month")))
            writer_parts = [LOG_PARTITION]
        out.write.mode("overwrite").partitionBy(*writer_parts).parquet(f"{root}/{name}")


FEEDS = ("sale_requests", "request_addons", "cancel_requests", "void_requests", "product_changes",
         "ingredient_changes", "account_requests", "existing_users", "user_changes")


def materialize(fixtures, root: str, sales_files: int | None = None) -> None:
    """Write the ledger tables and change feeds of ``fixtures`` as a parquet store.

    Frames that several outputs derive from (``shared_inputs``, e.g. the ranked
    order lines behind sales, add-ons and sale requests) are persisted for the
    duration of the writes so they are computed once.
    """
    from pyspark import StorageLevel

    shared = [getattr(fixtures, n) for n in getattr(fixtures, "shared_inputs", ())]
    for df in shared:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        write_store({name: getattr(fixtures, name) for name in TABLES}, root, sales_files)
        for name in FEEDS:
            getattr(fixtures, name).write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")
    finally:
        for df in shared:
            df.unpersist()


class StoredTables:
    """Ledger tables read back from a parquet store (same attributes as fixtures)."""

    def __init__(self, spark: SparkSession, root: str, feeds=None):
        self.spark = spark
        self.root = root.rstrip("/")
        self._feeds = feeds

    def _t(self, name):
        return read_table(self.spark, f"{self.root}/{name}", TABLES[name])

    @cached_property
    def sales(self):
        return self._t("sales")

    @cached_property
    def products(self):
        return self._t("products")

    @cached_property
    def ingredients(self):
        return self._t("ingredients")

    @cached_property
    def addons(self):
        return self._t("addons")

    @cached_property
    def sale_addons(self):
        return self._t("sale_addons")

    @cached_property
    def sales_void(self):
        return self._t("sales_void")

    @cached_property
    def audit_logs_by_month(self):
        """The audit log with its month column, by which the newest rows are found without reading the older months."""
        return self._t("audit_logs")

    @cached_property
    def audit_logs(self):
        return self.audit_logs_by_month.drop(LOG_PARTITION)

    @cached_property
    def users(self):
        return self._t("users")

    def __getattr__(self, name):
        # Stored change feeds first, then raw inputs from the fixture object, if given.
        if name.startswith("_"):
            raise AttributeError(name)
        if name in FEEDS:
            df = self.spark.read.parquet(f"{self.root}/{name}")
            self.__dict__[name] = df
            return df
        if self._feeds is None:
            raise AttributeError(name)
        return getattr(self._feeds, name)


def commit_sales_changes(spark: SparkSession, root: str, new_sales: DataFrame, changed_ids: DataFrame) -> list:
    """Write a changed ledger back to the store, rewriting only the months that changed.

    ``new_sales`` is the new state read from the store (it carries the month
    partition column); ``changed_ids`` holds the ``sales_id`` of every row a
    batch touched. The months those rows live in are found (a short list: one
    entry per month), the new rows of just those months are written once to the
    shared checkpoint folder (cutting the lineage that reads the target path),
    and those month directories alone are overwritten (dynamic partition
    overwrite). Other months' files are not touched. Returns the months
    rewritten. DataFrames read from the store before the commit list the old
    files: read the table again afterwards.
    """
    from ..functions.sizing import keys_present

    part = TIME_PARTITIONS["created_at"]
    touched = keys_present(new_sales.select("sales_id", part), changed_ids, "sales_id")
    months = [r[part] for r in new_sales.select("sales_id", part)
              .join(touched, "sales_id", "left_semi").select(part).distinct().collect()]
    if not months:
        return []
    cols = SALES_COLUMNS + [part]
    known = [m for m in months if m is not None]
    month_filter = F.col(part).isin(*known) if known else F.lit(False)
    if len(known) < len(months):          # rows without a time live in the NULL partition
        month_filter = month_filter | F.col(part).isNull()
    staged = new_sales.filter(month_filter).select(*cols).checkpoint(eager=True)
    (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(part).parquet(f"{root.rstrip('/')}/sales"))
    return months
