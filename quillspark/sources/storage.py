"""Writing, rebuilding and cutting lineage in the folders a cluster shares."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.rtf import cp1252_text


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir (beside the warehouse where that is unset)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(where or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return df.checkpoint(eager=True)


def scratch_table(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder as Parquet, and read back."""
    spark = df.sparkSession
    where = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    where = where or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    path = f"{where.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that is handed to Python; one longer row stands alone.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of a table that may be broadcast (short texts, ids and counts); beyond it is joined.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df (stored), marked for broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def rebuild(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replace a table as a whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def not_stored(df: DataFrame, path: str, key: str) -> DataFrame:
    """The rows of df whose key the table at path does not hold; all where there is no table."""
    spark = df.sparkSession
    return df.join(spark.read.parquet(path).select(key), key, "left_anti") if exists(spark, path) else df


def add_missing(df: DataFrame, path: str, key: str, force: bool = False) -> DataFrame:
    """Append only rows whose key is not in the table yet (all with force); returns what was added."""
    new = checkpointed(df if force else not_stored(df, path, key))
    new.write.mode("overwrite" if force else "append").parquet(path)
    return new


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """As CSV files with a header each; single: as one file, through one task."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One JSON value a file, or with lines one a line."""
    return spark.read.json(path, multiLine=not lines)


def read_rtf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of rich-text files, read as cp1252."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", cp1252_text("content").alias("text"))


def write_text_parts(text: str, folder: str, name: str, limit: int = 0) -> list[str]:
    """A bounded export string as one file, or as numbered parts of at most limit characters."""
    parts = [text[i : i + limit] for i in range(0, len(text), limit)] if limit else [text]
    out = []
    for k, part in enumerate(parts, 1):
        target = Path(folder) / (f"{name}.txt" if len(parts) == 1 else f"{name}_part{k}.txt")
        target.write_text(part, encoding="utf-8")
        out.append(str(target))
    return out


def env_config(path: str) -> dict[str, str]:
    """key=value lines of a settings file; comments and quotes go."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, eq, value = line.partition("=")
        if eq and not line.lstrip().startswith("#"):
            out[key.strip()] = value.strip().strip("\"'")
    return out
