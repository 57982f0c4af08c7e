"""From raw documents to packed training sequences: five stages, each one operator of the library.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner writes it as Parquet and
reads it back as the next stage's documents. Every stage but the last returns the columns of its
input, in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerleaf.llm import stages
from ledgerleaf.llm.common import Stage

STAGES = [
    ("quality_classifier", stages.quality),
    ("line_dedup", stages.lines),
    ("minhash_near_dedup", stages.near_duplicates),
    ("mix_sources", stages.mix),
    ("best_fit_packing", stages.pack),
]

# The stages train a classifier, cluster templates and tokenise: no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; the packed pieces of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = Stage(spark, "pipeline")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage.table(docs, name)
    return docs
