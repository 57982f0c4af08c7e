"""Daily totals kept up to date: a day x product rollup of the ledger (K1, K2, K3, K6 without reading the ledger).

The rollup has one row per day, product id and product name, with counts, quantities and money of the completed sales
(``done_*``) and of all sales (``any_*``). A change batch (M1 to M4) is turned into signed differences: what its
sales counted for before, negative, and what they count for after, positive. Adding the differences to the rollup gives
what a rebuild from the changed ledger gives, so only the batch's own sales are read, and the pages' totals and
top lists read rows in the number of products and days, not of sales.

In the store the rollup lies in month folders. Rows whose sales are all gone stay there with zero counts, so that a month
that becomes empty is overwritten too; readers leave them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizing import broadcast_if_small
from ..functions.time import DAY, as_date, in_range, month_start, next_month_start, period_bounds, trailing_bounds
from ..session import ensure_checkpoint_dir
from ..sources.schemas import MONEY_SUM, TIME_PARTITIONS
from . import rankings
from .filters import COMPLETED, is_completed
from .metrics import forecast

KEYS = ["day", "product_id", "product_name"]
MEASURES = {"done_sales": "long", "done_qty": "long", "done_total": MONEY_SUM,
            "any_sales": "long", "any_qty": "long", "any_total": MONEY_SUM}
PART = TIME_PARTITIONS["day"]
TABLE = "daily_rollup"


def _signed(sales: DataFrame, sign: int) -> DataFrame:
    """Each sale as the row of the rollup that it alone would make, times ``sign``. A missing quantity or total is 0."""
    amounts = {"sales": F.lit(1).cast("long"), "qty": F.coalesce(F.col("quantity").cast("long"), F.lit(0).cast("long")),
               "total": F.coalesce(F.col("total").cast(MONEY_SUM), F.lit(0).cast(MONEY_SUM))}
    done = F.coalesce(is_completed(), F.lit(False))
    cols = [F.when(done, a * F.lit(sign)).otherwise(F.lit(0)).cast(MEASURES[f"done_{m}"]).alias(f"done_{m}")
            for m, a in amounts.items()]
    cols += [(a * F.lit(sign)).cast(MEASURES[f"any_{m}"]).alias(f"any_{m}") for m, a in amounts.items()]
    return sales.select(F.to_date("created_at").alias("day"), "product_id", "product_name", *cols)


def _added(rows: DataFrame, *more) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(m).cast(t).alias(m) for m, t in MEASURES.items()], *more)


def build(sales: DataFrame) -> DataFrame:
    """The rollup of a whole ledger: one scan, one partial and final aggregate."""
    return _added(_signed(sales, 1))


def differences(before: DataFrame | None, after: DataFrame | None, ids: DataFrame | None = None) -> DataFrame:
    """Signed differences of a change batch; rows that come to nothing are left out.

    ``before`` and ``after`` are the ledger's two states (None: no sales); ``ids`` (sales_id) names the sales that the
    batch touched, else all are compared. An id list of checked size is broadcast and the ledger streamed against it.
    """
    wanted = None if ids is None else broadcast_if_small(ids.select("sales_id").where(F.col("sales_id").isNotNull()).distinct())
    parts = [_signed(state if wanted is None else state.join(wanted, "sales_id", "left_semi"), sign)
             for state, sign in ((before, -1), (after, 1)) if state is not None]
    if not parts:
        raise ValueError("differences needs a state before or after")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    changed = F.lit(False)
    for m in MEASURES:
        changed = changed | (F.col(m) != 0)
    return _added(rows).filter(changed)


def applied(rollup: DataFrame, *diffs: DataFrame) -> DataFrame:
    """The rollup after the batches whose differences are given, in any order."""
    rows = rollup.select(*KEYS, *MEASURES)
    for d in diffs:
        rows = rows.unionByName(d.select(*KEYS, *MEASURES))
    return _added(rows).filter(F.col("any_sales") > 0)


# --------------------------------------------------------------------------- what the pages show
def _sum(measure: str, cond=None):
    value = F.col(measure) if cond is None else F.when(cond, F.col(measure))
    return F.coalesce(F.sum(value), F.lit(0)).cast(MEASURES[measure]).alias(measure)


def dashboard_kpis(rollup: DataFrame, as_of) -> DataFrame:
    """K1 from the rollup: the columns of ``metrics.dashboard_kpis``."""
    d = as_date(as_of)
    windows = {"daily": (d, d + DAY), "weekly": trailing_bounds(d, 7), "monthly": (month_start(d), next_month_start(d))}
    lo, hi = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
    inside = {w: in_range(rollup, "day", *b, prune=False) for w, b in windows.items()}
    return (rollup.filter(in_range(rollup, "day", lo, hi))
            .agg(*[_sum("done_total", c).alias(f"{w}_sales") for w, c in inside.items()],
                 _sum("done_sales", inside["daily"]).alias("today_orders"))
            .withColumn("monthly_estimate", forecast(F.col("monthly_sales"))))


def report_summary(rollup: DataFrame, period: str, as_of) -> DataFrame:
    """K2 (and, over all time, K6) from the rollup."""
    b = period_bounds(period, as_of)
    rows = rollup if b is None else rollup.filter(in_range(rollup, "day", *b))
    return rows.agg(_sum("done_total").alias("total_sales"), _sum("done_sales").alias("total_transactions"))


def top_products(rollup: DataFrame, products: DataFrame, as_of, window: str = "daily", completed_only: bool = True,
                 require_image: bool = False, k: int = 10) -> DataFrame:
    """K3, K4 from the rollup: its rows stand for the sales of a day, so the list is made as from the ledger."""
    kind = "done" if completed_only else "any"
    bounds = rankings.window_bounds(window, as_of)
    as_sales = (rollup.filter(in_range(rollup, "day", *bounds) & (F.col(f"{kind}_sales") > 0))
                .select(F.col("day").alias("created_at"), "product_id", "product_name", F.col(f"{kind}_qty").alias("quantity"),
                        F.col(f"{kind}_total").alias("total"), F.lit(COMPLETED).alias("status")))
    return rankings.top_products(as_sales, products, as_of, window, completed_only, require_image, k)


# --------------------------------------------------------------------------- the stored rollup
def write_rollup(rollup: DataFrame, root: str, batch: int = 0) -> None:
    """Write the rollup in month folders. ``batch`` numbers the last change batch that it holds."""
    (rollup.select(*KEYS, *MEASURES, F.lit(batch).cast("long").alias("batch"), F.trunc("day", "month").alias(PART))
     .repartitionByRange(PART, "day", "product_id").write.mode("overwrite").partitionBy(PART).parquet(f"{root.rstrip('/')}/{TABLE}"))


def _stored(spark: SparkSession, root: str) -> DataFrame:
    fields = [T.StructField("day", T.DateType()), T.StructField("product_id", T.LongType()),
              T.StructField("product_name", T.StringType())]
    fields += [T.StructField(m, T.LongType() if t == "long" else t) for m, t in MEASURES.items()]
    fields += [T.StructField("batch", T.LongType()), T.StructField(PART, T.DateType())]
    return spark.read.schema(T.StructType(fields)).parquet(f"{root.rstrip('/')}/{TABLE}")


def read_rollup(spark: SparkSession, root: str) -> DataFrame:
    """The stored rollup (with its month column, by which date ranges prune folders)."""
    return _stored(spark, root).filter(F.col("any_sales") > 0).drop("batch")


def commit_rollup(spark: SparkSession, root: str, diffs: DataFrame, batch: int) -> list:
    """Add a batch's differences to the stored rollup, rewriting only the months that they touch.

    ``batch`` rises from batch to batch. A month that already holds this batch is left as it is, so a commit
    that was cut short can be run again. Returns the months of the batch (a short list: one entry a month).
    """
    ensure_checkpoint_dir(spark)
    staged = diffs.select(*KEYS, *MEASURES).withColumn(PART, F.trunc("day", "month")).checkpoint(eager=True)
    months = [r[PART] for r in staged.select(PART).distinct().collect()]
    if not months:
        return []
    known = [m for m in months if m is not None]
    of_batch = F.col(PART).isin(*known) if known else F.lit(False)
    if len(known) < len(months):
        of_batch = of_batch | F.col(PART).isNull()
    current = _stored(spark, root).filter(of_batch)
    held = current.groupBy(F.col(PART).alias("_month")).agg(F.max("batch").alias("_held"))
    fresh = (staged.join(held, staged[PART].eqNullSafe(held["_month"]), "left")
             .filter(F.coalesce(F.col("_held"), F.lit(-1)) < F.lit(batch))
             .select(*KEYS, *MEASURES, F.lit(batch).cast("long").alias("batch")))
    new = (_added(current.select(*KEYS, *MEASURES, "batch").unionByName(fresh), F.max("batch").alias("batch"))
           .withColumn(PART, F.trunc("day", "month")).checkpoint(eager=True))   # read before its folders are overwritten
    (new.repartitionByRange(PART, "day", "product_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART)
     .parquet(f"{root.rstrip('/')}/{TABLE}"))
    return months
