"""Property tests against brute force on small random inputs.

``apply_changes`` resolves a batch with per-key aggregates; here it is checked
against applying the same requests one at a time in plain Python.
The stock classes are checked to partition the table.
"""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerleaf.operators import changes, filters, inventory

KEYS = st.integers(min_value=1, max_value=6)
NAMES = st.sampled_from(["a", "b", "c"])
IMAGES = st.sampled_from(["", "0", None, "x.png", "y.png"])
OPS = st.tuples(st.sampled_from(["add", "edit", "delete"]), KEYS, NAMES, IMAGES)


def _empty(v):
    return v is None or v == "" or v == "0"


def brute_force(current: dict, ops: list) -> dict:
    state = {k: dict(v) for k, v in current.items()}
    for op, key, name, image in ops:
        if op == "delete":
            state.pop(key, None)
        elif op == "add":
            state[key] = {"name": name, "image": "" if image is None else image}
        elif key in state:
            state[key]["name"] = name
            if not _empty(image):
                state[key]["image"] = image
    return state


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(start=st.dictionaries(KEYS, st.tuples(NAMES, IMAGES), max_size=4),
       ops=st.lists(OPS, min_size=1, max_size=12))
def test_apply_changes_equals_sequential(spark, start, ops):
    cur = spark.createDataFrame([(k, n, i) for k, (n, i) in start.items()], "id long, name string, image string")
    ch = spark.createDataFrame([(s, op, k, n, i) for s, (op, k, n, i) in enumerate(ops)],
                               "seq long, op string, id long, name string, image string")
    got = {r.id: {"name": r.name, "image": r.image} for r in
           changes.apply_changes(cur, ch, "id", ["name", "image"], keep_if_empty=("image",),
                                 add_defaults={"image": ""}).collect()}
    want = brute_force({k: {"name": n, "image": i} for k, (n, i) in start.items()}, ops)
    assert got == want


STOCK = st.one_of(st.none(), st.integers(min_value=-3, max_value=40))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(STOCK, STOCK), min_size=1, max_size=20))
def test_stock_levels_partition(spark, rows):
    import seed as S
    df = S.ingredients_df(spark, [(i, f"n{i}", s, t, "u") for i, (s, t) in enumerate(rows)])
    parts = [set(r.ingredient_id for r in filters.stock_level_filter(df, lvl).collect()) for lvl in ("low", "mid", "high")]
    known = {i for i, (s, t) in enumerate(rows) if s is not None and t is not None}
    assert parts[0] | parts[1] | parts[2] == known
    assert not (parts[0] & parts[1]) and not (parts[0] & parts[2]) and not (parts[1] & parts[2])
    classes = {r.ingredient_id: r.report_class for r in inventory.stock_class(df).collect()}
    assert len(classes) == len(rows)


# ----------------------------------------------------------------------------- top-k and KPIs vs brute force
import datetime as dt  # noqa: E402
from decimal import Decimal  # noqa: E402

from ledgerleaf.operators import metrics, rankings  # noqa: E402

AS_OF = dt.date(2026, 5, 14)
# Instants around the window edges: month start, trailing-7 start, today, tomorrow, next month.
EDGES = [dt.datetime(2026, 4, 30, 23, 59, 59), dt.datetime(2026, 5, 1), dt.datetime(2026, 5, 7, 23, 59, 59),
         dt.datetime(2026, 5, 8), dt.datetime(2026, 5, 13, 23, 59, 59), dt.datetime(2026, 5, 14),
         dt.datetime(2026, 5, 14, 23, 59, 59), dt.datetime(2026, 5, 15), dt.datetime(2026, 5, 31, 23, 59, 59),
         dt.datetime(2026, 6, 1)]
SALE = st.tuples(st.integers(1, 5), st.integers(1, 4), st.integers(1, 300), st.sampled_from(EDGES),
                 st.sampled_from(["Completed", "Cancelled", "VOID"]))


def _sales_df(spark, rows):
    import seed as S
    data = [(i, pid, f"p{pid}", q, f"{c}.00", t.isoformat(sep=" "), stt) for i, (pid, q, c, t, stt) in enumerate(rows)]
    return S.sales_df(spark, data)


def _window(w):
    if w == "daily":
        return dt.datetime(2026, 5, 14), dt.datetime(2026, 5, 15)
    if w == "trailing7":
        return dt.datetime(2026, 5, 8), dt.datetime(2026, 5, 15)
    return dt.datetime(2026, 5, 1), dt.datetime(2026, 6, 1)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(SALE, min_size=1, max_size=30), window=st.sampled_from(["daily", "trailing7", "monthly"]),
       completed=st.booleans())
def test_top_products_brute_force(spark, seed, rows, window, completed):
    lo, hi = _window(window)
    agg = {}
    for pid, q, c, t, stt in rows:
        if lo <= t < hi and (stt == "Completed" or not completed):
            a = agg.setdefault(pid, [0, Decimal(0)])
            a[0] += q
            a[1] += Decimal(c)
    want = sorted(((pid, q, r) for pid, (q, r) in agg.items()), key=lambda x: (-x[1], x[0]))[:3]
    df = rankings.top_products(_sales_df(spark, rows), seed.products, AS_OF, window, completed_only=completed, k=3)
    got = [(r.product_id, r.qty_sold, r.revenue) for r in df.collect()]
    assert got == want


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(SALE, min_size=0, max_size=30))
def test_kpis_brute_force(spark, rows):
    def total(lo, hi):
        return sum((Decimal(c) for _, _, c, t, s in rows if s == "Completed" and lo <= t < hi), Decimal("0.00"))
    today = (dt.datetime(2026, 5, 14), dt.datetime(2026, 5, 15))
    r = metrics.dashboard_kpis(_sales_df(spark, rows) if rows else _sales_df(spark, [(1, 1, 1, EDGES[0], "VOID")]),
                               AS_OF).first()
    if not rows:
        rows = [(1, 1, 1, EDGES[0], "VOID")]
    assert r.daily_sales == total(*today)
    assert r.weekly_sales == total(*_window("trailing7"))
    assert r.monthly_sales == total(*_window("monthly"))
    assert r.today_orders == sum(1 for _, _, _, t, s in rows if s == "Completed" and today[0] <= t < today[1])
    assert r.monthly_estimate == (r.monthly_sales * Decimal("1.1")).quantize(Decimal("0.001"))
