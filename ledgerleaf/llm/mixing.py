"""Mixing sources to target weights by hash-threshold histograms.

Every document has a uniform 64-bit hash. A source whose target is q times its size plus a rest takes
each document q times, and once more those with a hash below the source's threshold. The threshold
comes from sums of sizes by source and leading hash bits: the first histogram finds the bucket in which
the budget runs out, the next one splits only that bucket, until it holds one hash. Nothing is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number
from .common import Stage, blocks, narrow, utf8

WEIGHTS, SHARE, REPEATS = (5.0, 2.0, 1.0), 1.5, 2.0
BITS = 10  # hash bits that one histogram splits


def _count_words(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = utf8(batch.column(0))
        for lo, hi in blocks(texts):
            sizes = [len(x.split()) for x in texts[lo:hi]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes, pa.int64()), *(batch.column(c).slice(lo, hi - lo) for c in (1, 2, 3))],
                names=["size", "doc_id", "source", "h"])


def _water_level(sources: DataFrame, share: float, repeats: float) -> DataFrame:
    """(source, ..., target): the budget by weight; a source over ``repeats`` times its size stops there and
    its excess is shared anew. Each turn is one aggregate over the sources, and only scalars reach the driver."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(repeats)
    level, before = None, -1
    while True:
        full = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        got = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))),
                          F.count(F.when(full, 1))).first()
        if got[2] == before or not got[1]:
            break
        before, level = got[2], (share * total - (got[0] or 0.0)) / got[1]
    return sources.withColumn("target", cap if level is None or not got[1]
                              else F.least(cap, F.col("weight") * F.lit(level)))


def _sized(docs: DataFrame, stage: Stage, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = narrow(docs, text=text_col, doc_id=id_col, source=source_col)
    return stage.table(rows.withColumn("h", F.xxhash64("doc_id", "source", "text"))
                       .mapInArrow(_count_words, "size long, doc_id long, source string, h long"), "sized")


def _thresholds(sized: DataFrame, stage: Stage, weights: tuple, share: float, repeats: float) -> DataFrame:
    """Per source (its): source_size, target, times (whole rounds over all its documents) and the hash threshold
    of one more round: shift, prefix and edge_too. One row per source."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_row_number(sizes, [F.col("source").isNull(), F.col("source")], "nth")
    turn = F.array(*map(F.lit, weights))
    weighed = stage.table(ranked.withColumn(
        "weight", F.element_at(turn, (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))), "weighed")
    targets = stage.table(_water_level(weighed.select("source", "source_size", "weight"), share, repeats), "targets")
    size = F.col("source_size")
    times = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0)
    plan = targets.select("source", "source_size", "target", times.cast("long").alias("times"),
                          (F.col("target") - times * size).alias("budget"))
    # prefix: the leading hash bits of the boundary bucket so far; below it all documents are taken once more.
    bound = plan.select("source", "budget", F.lit(0).cast("long").alias("prefix"))
    for used in range(0, 64, BITS):
        bits = min(BITS, 64 - used)
        now = used + bits
        top = F.shiftrightunsigned("h", 64 - now)
        inside = sized.where("size > 0").withColumn("bucket", top).join(
            bound.withColumnsRenamed({"source": "of"}),
            F.col("source").eqNullSafe(F.col("of"))
            & (F.col("prefix") == (F.shiftrightunsigned("h", 64 - used) if used else F.lit(0).cast("long"))))
        sums = inside.groupBy("of", "prefix", "budget", "bucket").agg(
            F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        ahead = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        run = sums.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
        # The first bucket in which the budget runs out; the last one if it never does.
        edge = run.where("before <= budget").groupBy("of").agg(
            F.max_by(F.struct(F.col("bucket").alias("prefix"), (F.col("budget") - F.col("before")).alias("budget"),
                              "words", (F.col("lo") == F.col("hi")).alias("single")), F.col("bucket")).alias("e"))
        found = stage.table(edge.select(F.col("of").alias("source"), "e.*"), f"edge{used}")
        bound = found.select("source", "budget", "prefix")
        settled = found.where("not single").limit(1).count() == 0
        if settled or now == 64:
            break
    # The boundary hash itself is taken when that comes nearer to the budget than leaving it.
    cut = found.select(F.col("source").alias("of"), "prefix", (F.col("budget") * 2 >= F.col("words")).alias("edge_too"))
    full = plan.withColumnsRenamed({"source": "its"}).join(cut, F.col("its").eqNullSafe(F.col("of")), "left")
    return full.drop("source", "of", "budget").withColumn("shift", F.lit(64 - now))


def copies(repeats: float = REPEATS):
    """How often a row with hash h is taken, beside its source's thresholds."""
    lead = F.expr("shiftrightunsigned(h, shift)")
    extra = F.when((lead < F.col("prefix")) | ((lead == F.col("prefix")) & F.col("edge_too")), 1).otherwise(0)
    return F.least(F.col("times") + F.coalesce(extra, F.lit(0)), F.lit(int(repeats)).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
        weights: tuple = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target (its source's words), taken, source, h.

    Sources by code point, null last, have the weights in turn and share ``share`` times all words. ``taken``
    is a whole multiple of ``size``. Hashes cover id, source and text, so reruns agree in any partitioning;
    rows equal in all three are taken alike. A null text has size 0. Other columns are ignored. An empty table
    gives no rows.
    """
    stage = Stage(docs.sparkSession, "mixing")
    sized = _sized(docs, stage, id_col, text_col, source_col)
    plan = _thresholds(sized, stage, weights, share, repeats)
    return (sized.join(plan, F.col("source").eqNullSafe(F.col("its")))
            .select("doc_id", "size", "source_size", "target",
                    (F.col("size") * copies(repeats)).alias("taken"), "source", "h"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
               weights: tuple = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with their own columns only.

    The thresholds are joined per source, so no text is shuffled.
    """
    stage = Stage(docs.sparkSession, "mixing")
    plan = _thresholds(_sized(docs, stage, id_col, text_col, source_col), stage, weights, share, repeats)
    rows = docs.select(F.struct("*").alias("row"), docs[source_col].alias("source"),
                       F.xxhash64(docs[id_col], docs[source_col], docs[text_col]).alias("h"))
    taken = (rows.join(plan, F.col("source").eqNullSafe(F.col("its"))).select("row", copies(repeats).alias("n"))
             .where("n > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))))
    return taken.select("row.*")
