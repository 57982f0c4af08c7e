"""Sales totals.

The pages ask the database up to seven separate questions about ``sales``.
Here each bundle is one scan: the union of the needed time windows is pushed
to the scan as one range, and every figure is a conditional aggregate
(``sum(when(...))``) in a single partial+final hash aggregation, so the
shuffle carries one row per task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import (DAY, as_date, in_range, month_start, next_month_start, period_bounds,
                              trailing_bounds)
from ..sources.schemas import MONEY_SUM
from .filters import is_completed

# Fixed value: the dashboard's forecast is the month's sales plus 10%.
FORECAST_FACTOR = Decimal("1.1")


def _money_sum(cond: Column) -> Column:
    """SUM(total) over rows meeting ``cond``; no rows gives 0 (the pages' ``?? 0``)."""
    return F.coalesce(F.sum(F.when(cond, F.col("total"))), F.lit(0)).cast(MONEY_SUM)


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def forecast(month_sales: Column) -> Column:
    """Exact decimal forecast, decimal(23,3) (no float rounding)."""
    return (month_sales * F.lit(FORECAST_FACTOR)).cast("decimal(23,3)")


def _windowed(sales: DataFrame, windows: list[tuple]) -> tuple[DataFrame, list[Column]]:
    """Completed sales inside the union of ``windows`` plus one predicate per window."""
    preds = [in_range(sales, "created_at", s, e, prune=False) for s, e in windows]
    lo = min(s for s, _ in windows)
    hi = max(e for _, e in windows)
    scoped = sales.filter(is_completed() & in_range(sales, "created_at", lo, hi))
    return scoped, preds


def dashboard_kpis(sales: DataFrame, as_of) -> DataFrame:
    """Today's sales, trailing-7-day sales, month's sales, today's orders, forecast."""
    d = as_date(as_of)
    today = (d, d + DAY)
    week7 = trailing_bounds(d, 7)
    month = (month_start(d), next_month_start(d))
    scoped, (p_today, p_week, p_month) = _windowed(sales, [today, week7, month])
    agg = scoped.agg(
        _money_sum(p_today).alias("daily_sales"),
        _money_sum(p_week).alias("weekly_sales"),
        _money_sum(p_month).alias("monthly_sales"),
        _count(p_today).alias("today_orders"),
    )
    return agg.withColumn("monthly_estimate", forecast(F.col("monthly_sales")))


def monthly_estimate(sales: DataFrame, as_of) -> DataFrame:
    """P5: the month's completed sales and the forecast (x 1.1)."""
    d = as_date(as_of)
    scoped, (p_month,) = _windowed(sales, [(month_start(d), next_month_start(d))])
    return (scoped.agg(_money_sum(p_month).alias("monthly_sales"))
            .withColumn("monthly_estimate", forecast(F.col("monthly_sales"))))


def report_summary(sales: DataFrame, period: str, as_of) -> DataFrame:
    """K2: total sales and transaction count of the period, Completed only."""
    b = period_bounds(period, as_of)
    scoped = sales.filter(is_completed())
    if b is not None:
        scoped = scoped.filter(in_range(sales, "created_at", *b))
    return scoped.agg(F.coalesce(F.sum("total"), F.lit(0)).cast(MONEY_SUM).alias("total_sales"),
                      F.count(F.lit(1)).alias("total_transactions"))


def report_stat_strip(sales: DataFrame, period: str, as_of) -> DataFrame:
    """Trailing-7-day sales, month's sales, today's orders, period transactions."""
    d = as_date(as_of)
    windows = [(d, d + DAY), trailing_bounds(d, 7), (month_start(d), next_month_start(d))]
    b = period_bounds(period, d)
    if b is None:
        scoped = sales.filter(is_completed())
        preds = [in_range(sales, "created_at", s, e, prune=False) for s, e in windows]
        p_period = F.lit(True)
    else:
        scoped, preds = _windowed(sales, windows + [b])
        p_period = preds.pop()
    p_today, p_week, p_month = preds
    return scoped.agg(
        _money_sum(p_week).alias("weekly_sales"),
        _money_sum(p_month).alias("monthly_sales"),
        _count(p_today).alias("today_orders"),
        _count(p_period).alias("total_transactions"),
    )


def sales_page_totals(sales: DataFrame) -> DataFrame:
    """K6: all-time completed total and count, in one aggregate."""
    return (sales.filter(is_completed())
            .agg(F.coalesce(F.sum("total"), F.lit(0)).cast(MONEY_SUM).alias("total_sales"),
                 F.count(F.lit(1)).alias("total_transactions")))
