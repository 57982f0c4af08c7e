"""Global ranking without funnelling rows through one task.

``row_number()`` over a window with no partition moves every row to a single
task. ``global_row_number`` gives the same 1..n numbering with the work spread
out: the frame is range-partitioned by the order (Spark samples the bounds)
and written once to the shared checkpoint folder (``spark.checkpoint.dir``),
each task numbers its own rows, and a tiny per-partition count table (one row
per partition, so its size is bounded by the partition count, not the data)
turns local numbers into global ones through a broadcast join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PID = "__ll_pid"
_LOCAL = "__ll_local"
_OFFSET = "__ll_offset"


def global_row_number(df: DataFrame, order: list[Column], name: str = "rank",
                      num_partitions: int | None = None) -> DataFrame:
    """Append ``name`` = 1-based position of each row in ``order``.

    ``order`` must be a total order (end it with a unique key) so the numbering
    is deterministic across engines and retries. The input is computed once
    (into the checkpoint); everything after reads the checkpointed files.
    """
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range-partition and sort once, then write that layout to the shared
    # checkpoint folder. Both branches below (per-partition counts and the local
    # numbers) read the same files, so they see the same partitions in the same
    # order; recomputing the range shuffle twice could sample different bounds.
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    # monotonically_increasing_id = (partition id << 33) + position in partition.
    numbered = (ordered
                .withColumn(_PID, F.spark_partition_id())
                .withColumn(_LOCAL, F.monotonically_increasing_id() - (F.col(_PID).cast("long") * (1 << 33))))
    counts = numbered.groupBy(_PID).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        _PID, (F.sum("__n").over(Window.orderBy(_PID)) - F.col("__n")).alias(_OFFSET))
    return (numbered.join(F.broadcast(offsets), _PID)
            .withColumn(name, F.col(_OFFSET) + F.col(_LOCAL) + 1)
            .drop(_PID, _LOCAL, _OFFSET))
