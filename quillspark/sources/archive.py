"""The archive's tables, as Parquet folders or over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.functions.rtf import spans_of_blob
from quillspark.operators.archive import note_scan

TABLES = ("pages", "notes", "contents", "treenodes")


def read_parquet(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLES}


def read_jdbc(spark: SparkSession, url: str, **options: str) -> dict[str, DataFrame]:
    """Needs the database's driver on the class path."""
    return {t: spark.read.format("jdbc").options(url=url, dbtable=t, **options).load() for t in TABLES}


def decoded_notes(tables: dict[str, DataFrame]) -> DataFrame:
    """Notes with their spans, decoded once; the blob does not travel further."""
    joined = note_scan(tables["notes"], tables["contents"])
    return joined.withColumn("spans", spans_of_blob("data")).drop("data")
