"""The daily rollup kept by signed differences against a rebuild from the ledger."""

from __future__ import annotations

import datetime as dt
import tempfile
from decimal import Decimal as D

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerleaf.operators import metrics, rankings, rollup
from ledgerleaf.sources.schemas import SALES

SALE = st.tuples(st.sampled_from([None, 1, 2]), st.sampled_from(["a", "b", None]), st.sampled_from([None, 1, 3]),
                 st.sampled_from([None, "1.10", "99999999.99"]), st.sampled_from([None, 0, 1, 40]),
                 st.sampled_from(["Completed", "COMPLETED", "VOID", None]))
LEDGER = st.dictionaries(st.integers(1, 6), SALE, max_size=5)


def _sales(spark, ledger):
    start = dt.datetime(2026, 4, 30, 23, 59)
    rows = [(i, pid, name, q, None if total is None else D(total), None if day is None else start + dt.timedelta(days=day), status, None)
            for i, (pid, name, q, total, day, status) in ledger.items()]
    return spark.createDataFrame(rows, SALES.schema)


def _rows(df):
    return sorted((tuple(r) for r in df.select(*rollup.KEYS, *rollup.MEASURES).collect()), key=repr)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(states=st.lists(LEDGER, min_size=2, max_size=4))
def test_differences_equal_a_rebuild(spark, states):
    frames = [_sales(spark, s) for s in states]
    diffs = [rollup.differences(a, b) for a, b in zip(frames, frames[1:])]
    want = _rows(rollup.build(frames[-1]))
    assert _rows(rollup.applied(rollup.build(frames[0]), *diffs)) == want
    assert _rows(rollup.applied(rollup.build(frames[0]), *reversed(diffs))) == want


def test_only_named_sales_are_compared(spark):
    before = _sales(spark, {1: (1, "a", 1, "1.10", 0, "Completed"), 2: (1, "a", 3, "1.10", 0, "Completed")})
    after = _sales(spark, {1: (1, "a", 1, "1.10", 0, "VOID"), 2: (1, "a", 3, "1.10", 0, "VOID")})
    ids = spark.createDataFrame([(1,), (1,), (None,), (9,)], "sales_id long")
    got = rollup.differences(before, after, ids).collect()
    assert [(r.done_sales, r.done_qty, r.done_total, r.any_sales) for r in got] == [(-1, -1, D("-1.10"), 0)]
    assert rollup.differences(before, before).count() == 0
    with pytest.raises(ValueError):
        rollup.differences(None, None)


def test_stored_rollup_months_and_reruns(spark):
    root = tempfile.mkdtemp(prefix="ll-rollup-")
    states = [{1: (1, "a", 1, "1.10", 0, "Completed"), 2: (2, "b", 3, "1.10", 1, "Completed"), 3: (2, "b", 1, "1.10", None, "VOID")},
              {1: (1, "a", 1, "1.10", 0, "VOID"), 2: (2, "b", 3, "1.10", 1, "Completed"), 3: (2, "b", 2, "1.10", None, "VOID")},
              {2: (2, "b", 3, "1.10", 1, "Completed"), 4: (1, "a", 1, "1.10", 40, "Completed")}]
    frames = [_sales(spark, s) for s in states]
    rollup.write_rollup(rollup.build(frames[0]), root)
    months = []
    for n, (a, b) in enumerate(zip(frames, frames[1:]), 1):
        for _ in range(2):                       # a batch that is committed twice counts once
            months.append(rollup.commit_rollup(spark, root, rollup.differences(a, b), n))
            assert _rows(rollup.read_rollup(spark, root)) == _rows(rollup.build(b))
    april, june = dt.date(2026, 4, 1), dt.date(2026, 6, 1)
    assert set(months[0]) == {april, None} and set(months[2]) == {april, june, None}   # May is not rewritten
    assert rollup.commit_rollup(spark, root, rollup.differences(frames[2], frames[2]), 3) == []


def test_pages_from_the_rollup(spark, seed):
    r = rollup.build(seed.sales)
    for day in ("2026-05-14", "2026-05-01", "2030-01-01"):
        assert rollup.dashboard_kpis(r, day).collect() == metrics.dashboard_kpis(seed.sales, day).collect()
        for period in ("daily", "weekly", "monthly", "all"):
            assert rollup.report_summary(r, period, day).collect() == metrics.report_summary(seed.sales, period, day).collect()
        for window in rankings.TOP_WINDOWS:
            for flags in ((True, False), (False, True)):
                assert (rollup.top_products(r, seed.products, day, window, *flags).collect()
                        == rankings.top_products(seed.sales, seed.products, day, window, *flags).collect())


def test_stored_top_list_reads_one_month(spark, seed):
    from test_plans import plan
    root = tempfile.mkdtemp(prefix="ll-rollup-")
    rollup.write_rollup(rollup.build(seed.sales), root)
    p = plan(rollup.top_products(rollup.read_rollup(spark, root), seed.products, "2026-05-14", "monthly"))
    assert "PartitionFilters: [isnotnull(sale_month" in p and "sale_month" in p and "2026-05-01" in p
