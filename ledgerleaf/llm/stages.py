"""The stages of the corpus pipeline: an operator's decisions applied to the documents.

All but the last keep every column of the documents, whatever its name; only ``text`` and ``n_chars`` ever change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, minhash, mixing, packing
from . import quality as neighbours
from .common import Stage, quoted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score under 0.3 go. The classifier learns from the labels table, and not from
    the held-out fold (crc32 of the id mod 5 is 0)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = neighbours.fit(docs, labels, "quality", modulus=5, held_out=0)
    return neighbours.scores(docs, model).where("score >= 0.3").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, and documents of which nothing is left by that; n_chars follows the new text."""
    found = line_dedup.drop_recurring_lines(docs)
    left = found.where("n_dropped = 0 or new_text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    new = F.when(F.col("n_dropped") > 0, F.col("new_text")).otherwise(F.col("row.text"))
    size = F.when(F.col("n_dropped") > 0, F.length("new_text").cast("long")).otherwise(F.col("row.n_chars"))
    own = {"text": new, "n_chars": size}
    return left.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts (similarity 0.8 or more) stays, the one with the smallest id. Decided text by text:
    rows that share an id are apart if their texts are, and rows without an id go like others, after those
    with one. Rows without words all stay. Rows travel as structs, so columns may have any name."""
    stage = Stage(spark, "near")
    others = F.to_json(F.struct(*[docs[quoted(c)] for c in docs.columns if c != "text"]), {"ignoreNullFields": "false"})
    keyed = docs.select(F.struct("*").alias("row"), F.md5(docs["text"].cast("binary")).alias("t"), F.md5(others).alias("h"))
    wordy = F.coalesce(F.col("row.text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    # Texts get numbers of their own; a written table keeps them.
    texts = stage.table(keyed.where(wordy).select("t", F.col("row.text").alias("text")).dropDuplicates(["t"])
                        .withColumn("number", F.monotonically_increasing_id()), "texts")
    groups = minhash.near_duplicates(texts, "number", similarity=80).select(F.col("doc_id").alias("number"), "component_id")
    # The first row of each text, then of each group; "n" counts rows that are equal in all columns.
    row = keyed.where(wordy).groupBy(F.col("row.doc_id").alias("doc_id"), "t", "h").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t", "h", "n")
    first = row.groupBy("t").agg(F.min(order).alias("first")).join(texts.select("t", "number"), "t")
    keep = stage.table(first.join(groups, "number").groupBy("component_id").agg(F.min("first").alias("first"))
                       .select("first.t", "first.h", "first.n"), "keep")
    kept = keyed.where(wordy).join(keep, ["t", "h"])
    once = kept.where("n = 1").select("row")
    again = kept.where("n > 1").dropDuplicates(["t", "h"]).select("row")
    return once.union(again).union(keyed.where(~wordy).select("row")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in their sequences: the columns of ``packing.pack``."""
    return packing.pack(docs)
