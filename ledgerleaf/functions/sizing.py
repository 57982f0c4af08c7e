"""Broadcast behind a measured size.

Spark broadcasts a join side statically when its *estimated* size is under
``spark.sql.autoBroadcastJoinThreshold``; for a filtered or de-duplicated feed
that estimate is the whole input file, so a small request list joined to a
huge ledger would shuffle the ledger. ``broadcast_if_small`` measures the side
with one aggregate (each task sends one row: its bytes) and hints a broadcast
only within ``max_bytes``; above it the join stays a shuffle join (sort-merge,
with AQE's skew handling).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes that may be broadcast: the library's broadcast threshold.
MAX_BYTES = 32 * 1024 * 1024
# What a value costs beside its text: a field of Spark's row format, and a row's own share of a hash table.
FIELD_BYTES, ROW_BYTES = 16, 32


def _row_bytes(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        total = F.lit(FIELD_BYTES)
        for f in dtype.fields:
            total = total + _row_bytes(c.getField(f.name), f.dataType)
        return total
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + F.lit(FIELD_BYTES)
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) * 2 + F.lit(FIELD_BYTES)
    return F.lit(FIELD_BYTES)


def measured_bytes(df: DataFrame) -> int:
    """About the bytes that ``df`` takes in memory; only one number per task is moved."""
    total = F.lit(ROW_BYTES)
    for f in df.schema.fields:
        total = total + _row_bytes(F.col(f"`{f.name}`"), f.dataType)
    return df.agg(F.coalesce(F.sum(total.cast("long")), F.lit(0)).alias("b")).first()["b"]


def is_small(df: DataFrame, max_bytes: int = MAX_BYTES) -> bool:
    return measured_bytes(df) <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    return F.broadcast(df) if is_small(df, max_bytes) else df


def keys_present(big: DataFrame, keys: DataFrame, key: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Distinct values of ``keys[key]`` that occur in ``big[key]``.

    The big table is streamed once against the (size-checked) broadcast of the
    distinct wanted keys, so it is not shuffled when the request side is small.
    """
    wanted = broadcast_if_small(keys.select(key).distinct(), max_bytes)
    return big.select(key).join(wanted, key, "left_semi").distinct()
