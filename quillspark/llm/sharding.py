"""Sharding by proportional stratified interleaving (operator 5).

Rows of each source are shuffled by a seeded hash and ranked; the fractional rank (rank + 1/2) / n
spreads every source evenly over 0..1, so any stretch of the order by fractional rank holds the
sources in the proportions of the whole. Cutting that order into equal stretches gives shards whose
row counts differ by one at most (law `rows`) and whose mixture is that of the table.

Both orders are range-partitioned sorts: a source with a third of all rows lies over many tasks, and
places follow from one count per task. The sorted rows are checkpointed, so that counts and places
refer to the same partitions even when executors are lost.

Defined results. Null source: a source of its own. Null text: size 16, crc32 0. Null ids and repeated
rows get places like any row (their order among themselves is arbitrary). Fewer rows than shards
leave some shards empty. Ties in the fractional rank go by source, then by the seeded draw. Only the size
and the checksum of a text are carried, however long it is. Other columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm._util import checkpointed, shuffle_partitions

SHARDS = 40
SEED = 17
_PLACE = (1 << 33) - 1  # monotonically_increasing_id is partition << 33 | row


def _in_order(df: DataFrame, *keys: str) -> DataFrame:
    """df sorted by keys over range partitions and checkpointed, with __part and __at (row in it)."""
    n = shuffle_partitions(df.sparkSession)
    ordered = checkpointed(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys))
    at = F.monotonically_increasing_id()
    return ordered.select("*", F.shiftright(at, 33).cast("int").alias("__part"), at.bitwiseAND(F.lit(_PLACE)).alias("__at"))


def stratified_order(df: DataFrame, source_col: str, seed: int = SEED, tie_cols: tuple[str, ...] = ()) -> DataFrame:
    """df with __pos (0..n-1 in interleaved order) and __total."""
    names = df.columns
    drawn = df.select("*", F.col(f"`{source_col}`").alias("__source"), F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in tie_cols)).alias("__draw"))
    first = _in_order(drawn, "__source", "__draw", *tie_cols)
    parts = first.groupBy("__source", "__part").agg(F.count("*").alias("n"), F.min("__at").alias("low"))
    own = Window.partitionBy("__source")
    before = own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("__source").alias("__s"), F.col("__part").alias("__p"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"), F.sum("n").over(own).alias("of")
    )
    joined = first.join(parts, (first["__part"] == parts["__p"]) & first["__source"].eqNullSafe(parts["__s"]))
    share = (F.col("__at") + F.col("shift") + 0.5) / F.col("of")
    second = _in_order(joined.select(*names, "__source", "__draw", share.alias("__share")), "__share", "__source", "__draw", *tie_cols)
    counts = second.groupBy("__part").agg(F.count("*").alias("n"))
    every = Window.orderBy("__part")  # one row per task
    counts = counts.select(
        F.col("__part").alias("__p"), (F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("shift"), F.sum("n").over(Window.partitionBy()).alias("__total")
    )
    return second.join(counts, second["__part"] == counts["__p"]).select(*names, (F.col("__at") + F.col("shift")).alias("__pos"), "__total")


def _measured(text_col: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return (F.octet_length(text) + 16).cast("long").alias("__size"), F.crc32(text.cast("binary")).alias("__crc")


def _placed(rows: DataFrame, id_col: str, source_col: str, shards: int, seed: int) -> DataFrame:
    """rows (with __size and __crc) with __shard and __slot."""
    placed = stratified_order(rows, source_col, seed, (id_col, "__crc", "__size"))
    first = F.expr(f"(__shard * __total + {shards - 1}) div {shards}")  # least place of the shard
    return placed.withColumn("__shard", F.expr(f"(__pos * {shards}) div __total")).withColumn("__slot", F.col("__pos") - first)


def assign_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(id_col, source, size, text_crc32, law, shard, slot, grown_shard) for each row."""
    keys = df.select(F.col(f"`{id_col}`").alias("__key"), F.col(f"`{source_col}`").alias("__from"), *_measured(text_col))
    placed = _placed(keys, "__key", "__from", shards, seed)
    return placed.select(
        F.col("__key").alias(id_col),
        F.col("__from").alias("source"),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED) -> None:
    """Write df's rows, all columns and every row once, in the order of their slots, one folder per shard.
    Rows are placed as a whole, not joined to their places, so null and repeated ids lose nothing."""
    placed = _placed(df.select("*", *_measured(text_col)), id_col, source_col, shards, seed)
    named = placed.select(*(F.col(f"`{c}`") for c in df.columns), F.col("__shard").alias("shard_id"), F.col("__slot").alias("slot_id"))
    named.repartitionByRange("shard_id", "slot_id").sortWithinPartitions("shard_id", "slot_id").write.mode("overwrite").partitionBy("shard_id").parquet(path)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source")
