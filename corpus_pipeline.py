"""The corpus pipeline: quality rules, near-duplicates, decontamination, privacy, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to
the shared checkpoint folder as Parquet and rereads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._util import scratch_table
from quillspark.llm.decontaminate import drop_contaminated
from quillspark.llm.neardup import drop_near_duplicates
from quillspark.llm.packing import pack_documents
from quillspark.llm.privacy import sanitise
from quillspark.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the quality rules reject go. Null, empty and short texts (under 50
    words) are rejected; null ids and other nulls, repeated rows and extra columns do not matter. Very
    long texts are counted whole; a distance equal to the limit is kept. An empty table stays empty."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each SimHash group stays, the one with the least id. Null and empty
    texts are equal; other texts without a word have no near duplicates. Of repeated rows one stays. A row
    with a null id stays only if no row of its group has an id; among several, one stays. Extra columns
    come along. Very long texts are compared whole. An empty table stays empty."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that contain a benchmark item go. Null and empty texts and items never
    match; repeated rows and rows with null ids are each judged. Very long texts are searched whole, a
    containment equal to the threshold counts, extra columns come along. An empty table stays empty."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: personal data and the terms that disclose it are masked; n_chars follows. Every row
    stays, repeated ones and null ids too; a null text stays null, with a null n_chars. Very long texts are
    searched whole, a share equal to a threshold reaches it, extra columns come along. An empty table
    stays empty."""
    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: all that is left, tokenised and packed into sequences. A null or empty text is its
    closing id alone; null ids and repeated rows are packed like any row, very long texts are cut into
    pieces, extra columns are dropped. The result places every piece (its ids' checksum, sequence and
    offset); pack_documents(..., with_ids=True) carries the ids. An empty table gives an empty result."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", privacy),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# Fingerprints, tokens and packing cannot be told in SQL; tests/llm/test_pipeline.py compares run() with a plain
# version of all five stages.
ORACLE_SQL = None
