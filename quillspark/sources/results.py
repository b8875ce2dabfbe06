"""Stored runs and ratings: latest-wins upserts keyed by what identifies a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN_KEY = ("question_id", "regime", "generator")
DIAGNOSTICS = ("correctness", "completeness", "grounding")


def latest(rows: DataFrame, key: tuple[str, ...], *order: str) -> DataFrame:
    """One row per key: the last by order."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("__n", place).where("__n = 1").drop("__n")


def upsert_runs(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored runs with new ones in place of those of the same question, regime and generator; of several new ones
    the greatest run id counts."""
    both = stored.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    return latest(both, RUN_KEY, "__v", "run_id").drop("__v")


def upsert_ratings(stored: DataFrame, new: DataFrame, key: str = "run_id") -> DataFrame:
    """New ratings in place of old ones; one without any diagnostic keeps the old diagnostics."""
    old = stored.select(key, *(F.col(c).alias(f"__{c}") for c in DIAGNOSTICS))
    none = F.coalesce(*DIAGNOSTICS).isNull()
    merged = new.join(old, key, "left").select(*(F.when(none, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in DIAGNOSTICS else c for c in new.columns))
    return stored.join(new.select(key), key, "left_anti").unionByName(merged.select(*stored.columns))


def results_scan(runs: DataFrame, ratings: DataFrame) -> DataFrame:
    return runs.join(ratings, "run_id", "left")
