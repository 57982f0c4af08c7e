"""Size-checked broadcast: under the bound a broadcast hint, above it a plain shuffle join."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

from ledgerleaf.functions.sizing import broadcast_if_small, keys_present


def _plan(df):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_broadcast_only_under_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(1000).withColumnRenamed("id", "k")
        small = spark.range(0, 1000, 100).withColumnRenamed("id", "k")
        assert "BroadcastHashJoin" in _plan(big.join(broadcast_if_small(small, 500), "k"))
        assert "BroadcastHashJoin" not in _plan(big.join(broadcast_if_small(small, 400), "k"))
        got = sorted(r.k for r in keys_present(big, small.union(small), "k", 500).collect())
        assert got == list(range(0, 1000, 100))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
