"""Time windows of the reports, as half-open ranges on a timestamp column.

Bounds are computed on the driver from the ``as_of`` parameter and compared
to the raw column, so Catalyst pushes them to the scan (``PushedFilters``)
instead of evaluating ``month(x)``/``year(x)`` per row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = dt.timedelta(days=1)

# The report's period words and what they select.
PERIODS = ("daily", "weekly", "monthly")


def as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))


def month_start(d: dt.date) -> dt.date:
    return d.replace(day=1)


def next_month_start(d: dt.date) -> dt.date:
    return (d.replace(day=28) + dt.timedelta(days=4)).replace(day=1)


def iso_week_start(d: dt.date) -> dt.date:
    """Monday of the ISO week holding ``d`` (``YEARWEEK(x, 1)`` equality)."""
    return d - dt.timedelta(days=d.weekday())


def period_bounds(period: str, as_of) -> tuple[dt.date, dt.date] | None:
    """[start, end) of the report period; None for "all time"."""
    d = as_date(as_of)
    if period == "daily":
        return d, d + DAY
    if period == "weekly":
        s = iso_week_start(d)
        return s, s + 7 * DAY
    if period == "monthly":
        return month_start(d), next_month_start(d)
    return None


def trailing_bounds(as_of, days: int = 7) -> tuple[dt.date, dt.date]:
    """The last ``days`` days including today: [as_of - (days-1), as_of + 1)."""
    d = as_date(as_of)
    return d - (days - 1) * DAY, d + DAY


def _bound(df: DataFrame, col: str, day: dt.date) -> Column:
    dtype = df.schema[col].dataType
    midnight = dt.datetime.combine(day, dt.time())
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(midnight.isoformat(sep=" ")).cast(T.TimestampNTZType())
    if isinstance(dtype, T.DateType):
        return F.lit(day)
    # Session-zone timestamps: midnight of the session's calendar day.
    return F.lit(midnight.isoformat(sep=" ")).cast(T.TimestampType())


def in_range(df: DataFrame, col: str, start: dt.date, end: dt.date, prune: bool = True) -> Column:
    """``start <= col < end`` with literals typed like the column (pushdown-safe).

    When ``df`` carries the month partition column of ``col`` (a partitioned
    store, see ``sources.schemas.TIME_PARTITIONS``), the months the range
    touches are added as a predicate on it, so whole partitions are pruned
    before any file is opened. ``prune=False`` leaves it out (for conditions
    inside aggregates, where the scan is already filtered).
    """
    from ..sources.schemas import TIME_PARTITIONS

    pred = (F.col(col) >= _bound(df, col, start)) & (F.col(col) < _bound(df, col, end))
    part = TIME_PARTITIONS.get(col)
    if prune and part and part in df.columns:
        last_day = end - DAY
        pred = pred & (F.col(part) >= F.lit(month_start(start))) & (F.col(part) <= F.lit(month_start(last_day)))
    return pred


def period_predicate(df: DataFrame, period: str, as_of, col: str = "created_at") -> Column | None:
    b = period_bounds(period, as_of)
    return None if b is None else in_range(df, col, *b)


def yearweek_iso(c: Column | str) -> Column:
    """``YEARWEEK(x, 1)`` as a number: ISO week-year * 100 + ISO week."""
    col = F.col(c) if isinstance(c, str) else c
    return F.extract(F.lit("YEAROFWEEK"), col) * 100 + F.weekofyear(col)
