"""Helpers shared by the operators: staged tables, hash folds, text blocks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import scratch_path

# Text handled at once inside a task: bytes (a longer single text makes a block of its own) and rows.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 1024


class Stage:
    """Intermediate tables of one operator run, written as parquet in the shared checkpoint folder.

    A written table cuts lineage, survives lost executors and is computed once. ``drop`` frees
    a table that no later step reads; the rest goes when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def table(self, df: DataFrame, key: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.name}-{key}")
        df.write.parquet(path)
        self.paths[key] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keys: str) -> None:
        jvm = self.spark._jvm
        for key in keys:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(key))
            with suppress(Exception):  # a leftover goes at the end of the session
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the fold of a row (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most ``rows`` texts that hold about ``limit`` bytes."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit or i + 1 - start >= rows:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def utf8(column) -> list[bytes]:
    """An Arrow string column as UTF-8 byte strings; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def quoted(column: str) -> str:
    """A column's name as one identifier, dots and all."""
    return "`" + column.replace("`", "``") + "`"


def beside_row(columns: str, docs: DataFrame) -> StructType:
    """The schema of ``columns`` and the struct ``row`` of all columns of ``docs``, whatever their names."""
    return StructType([*StructType.fromDDL(columns).fields, StructField("row", docs.schema)])


def narrow(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so other columns cannot clash."""
    return docs.select(*[docs[old].alias(new) for new, old in columns.items()])


def finite_vectors(column) -> Iterator[tuple]:
    """(row numbers, doubles (n, d)) of an Arrow list column, by length: vectors that are not null or empty and have no
    null or non-finite component."""
    import numpy as np

    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    for d in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == d)
        x = values[starts[at][:, None] + np.arange(d)]
        ok = np.isfinite(x).all(axis=1)
        yield at[ok], x[ok]


def packed_rows(x):
    """Rows of an integer matrix as an Arrow array of little-endian 32-bit integers."""
    import numpy as np
    import pyarrow as pa

    data = np.ascontiguousarray(x, dtype="<i4")
    return pa.array(data.view(f"V{4 * data.shape[1]}").ravel().tolist() if len(data) else [], pa.binary())


def unpacked_rows(cells, dim: int):
    """The integer matrix of packed rows, (n, dim)."""
    import numpy as np

    return np.frombuffer(b"".join(cells), "<i4").reshape(-1, dim)
