"""The registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (graph_search, hard_negatives, lattice, line_dedup, minhash, mixing, packing, quality, secrets, toxicity, urls,
               warc, whitening)
from .common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the documents."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), similarity=85)


@_query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, placed in sequences of 1024 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents"))


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without recurring line templates."""
    found = line_dedup.drop_recurring_lines(_read(spark, sf_dir, "documents"))
    return found.select("row.doc_id", F.col("new_text").alias("text"), "n_lines", "n_dropped")


@_query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    found = mixing.mix(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op6_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; the fold with remainder 0 is held out."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"), "quality", modulus=5, held_out=0)
    return quality.scores(docs.withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False))), model).select(
        "row.doc_id", "row.held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op1_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the fold with remainder 1 is held out."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), "toxic", modulus=3, held_out=1)
    return toxicity.scores(docs.withColumn("held_out", F.coalesce(fold("doc_id", 3) == 1, F.lit(False))), model).select(
        "row.doc_id", "row.held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op2_secret_lexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.scan(_read(spark, sf_dir, "documents"))


@_query
def op7_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urls.judge(_read(spark, sf_dir, "pages"))


@_query
def op8_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the embeddings of each label."""
    return lattice.near_duplicates(_read(spark, sf_dir, "embeddings"))


@_query
def op9_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every embedding whose id is divisible by 20."""
    return graph_search.search(_read(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the whitened principal components; deviations beyond 64 bits are null."""
    return whitening.whiten(_read(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as long)"))


@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 100; labels of every seventh id are shifted."""
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", shifted), "vec_id % 100 = 0")


@_query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from deduplicated archives."""
    return warc.archive(_read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
