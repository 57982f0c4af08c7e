"""Global row number: 1..n in the given total order, computed by the distributed path."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerleaf.functions.ranking import global_row_number


def test_numbers_follow_the_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 13).alias("g"))
    order = [F.col("g").desc(), F.col("k").asc()]
    got = sorted(((r.r, r.k) for r in global_row_number(df, order, "r", num_partitions=7).collect()))
    want = [k for _, k in sorted((-r.g, r.k) for r in df.collect())]
    assert [k for _, k in got] == want
    assert [r for r, _ in got] == list(range(1, 5001))
