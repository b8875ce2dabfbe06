"""Line dedup: lines that many documents share stay in one of them (operator 11).

DataFrame functions only; no Python runs on the executors.

1. One scan cuts each text into lines and writes a narrow table: two hashes of 64 bits of the line's key,
   the document and the line's position. Texts do not leave the scan.
2. That table is range-partitioned by hash, with a secondary sort by document (largest first) and position.
   A window streams over each run of equal hashes: the first row of each document counts it, the first row of
   all names the document that keeps the line. This needs no second shuffle: ranges of the run's own columns
   satisfy the window.
3. A run that a sample shows to be longer than a task's share (hot) is sliced by document over the ranges. Its
   slices' counts are summed and come back as a broadcast table. The sample decides only where rows lie,
   never the result: a key that it misses is one run in one task, with the same outcome.
4. Dropped positions become bitmaps: 64 lines a word, one bit a line, 1 for a line that stays. Words of
   lines that all stay are left out, so a document costs what it loses.

Defined results. A null or empty text is one empty line. A key is the line without ASCII white space at its
ends, A to Z lower-cased; keys under `min_chars` code points never count. Documents are told apart by id:
repeated rows of one id are one document, and each row loses its own lines. Rows with a null id keep all and
do not count. Lines that repeat within the keeping document all stay. Extra columns are ignored, whatever
their names. Very long texts are cut within one expression. Empty tables: no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm._util import WHITESPACE, scratch_table, shuffle_partitions
from quillspark.llm.quality import let

MIN_CHARS, MIN_DOCS = 40, 5
#: Rows of the sample for each shuffle partition, and how many of them make a key hot: about a quarter of a
#: partition's share. At most SAMPLE / HOT keys a partition can be hot, whatever the table holds.
SAMPLE, HOT = 64, 16
BITS = 64


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A to Z (no other letters) lower-cased."""
    bare = F.btrim(line, F.lit(WHITESPACE.decode()))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _narrow(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, text_key, pos) of each line whose key is long enough, of documents with an id."""
    base = df.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.col("doc").isNotNull())
    # White space at the ends only shortens a line: shorter ones are gone before their keys are made.
    cut = base.select("doc", F.xxhash64("text").alias("text_key"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line")).where(F.length("line") >= min_chars)
    keyed = cut.select("doc", "text_key", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(MIN_CHARS), "key").alias("h2"), "doc", "text_key", "pos")


def _sliced(rows: DataFrame, partitions: int) -> DataFrame:
    """rows with hot and slice: hot keys are dealt over `partitions` slices by document."""
    n = rows.count()
    share = max(1, n // (SAMPLE * partitions))
    drawn = rows.where(F.pmod(F.xxhash64("doc", "pos", "h1"), F.lit(share)) == 0)
    hot = drawn.groupBy("h1").count().where(F.col("count") >= HOT).select("h1", F.lit(True).alias("__hot"))
    found = rows.join(F.broadcast(hot), "h1", "left")
    is_hot = F.coalesce("__hot", F.lit(False))
    return found.select(*rows.columns, is_hot.alias("hot"), F.when(is_hot, F.pmod(F.xxhash64("doc"), F.lit(partitions))).otherwise(0).cast("int").alias("slice"))


def streamed(rows: DataFrame, partitions: int) -> DataFrame:
    """rows with docs (how many documents the run of equal hashes has in this slice) and last (the largest)."""
    run = ["h1", "h2", "slice"]
    order = [F.desc("doc"), F.asc("pos")]
    ranged = rows.repartitionByRange(partitions, *run).sortWithinPartitions(*run, *order)
    whole = Window.partitionBy(*run)
    stream = whole.orderBy(*order)
    met = ranged.withColumns({"before": F.lag("doc").over(stream), "last": F.first_value("doc").over(stream)})
    new = F.coalesce(F.col("before") != F.col("doc"), F.lit(True)).cast("long")
    return met.withColumn("docs", F.sum(new).over(whole)).drop("before")


def line_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, text_key, keep, n_dropped) of each document that loses lines. keep: array of (word, bits), where
    bit b of word w is 1 if line 64 w + b stays; words that are not listed keep all their lines."""
    partitions = shuffle_partitions(df.sparkSession)
    rows = _sliced(scratch_table(_narrow(df, id_col, text_col, min_chars)), partitions)
    counted = streamed(rows, partitions)
    late = (F.col("docs") >= min_docs) & (F.col("doc") < F.col("last"))
    # Of ordinary keys only the lines that go are kept; of hot keys all, until their slices are summed.
    kept = scratch_table(counted.where(F.col("hot") | late).select("h1", "h2", "slice", "hot", "doc", "text_key", "pos", "docs", "last"))
    slices = kept.where("hot").groupBy("h1", "h2", "slice").agg(F.first("docs").alias("docs"), F.max("last").alias("last"))
    totals = slices.groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("last").alias("very_last"))
    of_hot = kept.where("hot").join(F.broadcast(totals), ["h1", "h2"]).where((F.col("all_docs") >= min_docs) & (F.col("doc") < F.col("very_last")))
    gone = kept.where("NOT hot").select("doc", "text_key", "pos").unionByName(of_hot.select("doc", "text_key", "pos"))
    words = gone.groupBy("doc", "text_key", F.expr(f"pos div {BITS}").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {BITS})")).alias("dropped"))
    listed = F.sort_array(F.collect_list(F.struct(F.col("word").cast("int").alias("word"), F.bitwise_not("dropped").alias("bits"))))
    return words.groupBy("doc", "text_key").agg(listed.alias("keep"), F.sum(F.bit_count("dropped")).cast("long").alias("n_dropped"))


def _stays(keep: Column, lines: Column) -> Column:
    """The lines whose bit is 1. The listed words are first laid out side by side, missing ones as all ones."""

    def gap(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(keep, i - 1)["word"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(-1).cast("long"), x["word"] - before - 1), F.array(x["bits"]))

    def pick(words: Column) -> Column:
        return F.filter(lines, lambda _, i: F.coalesce(F.getbit(F.get(words, (i / BITS).cast("int")), i % BITS), F.lit(1)) == 1)

    return let(F.flatten(F.transform(keep, gap)), pick)


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id_col, n_lines, n_dropped, kept_text) for each row: each text meets its document's bitmap once."""
    bitmaps = line_bitmaps(df, id_col, text_col, min_chars, min_docs).select(F.col("doc").alias("__doc"), F.col("text_key").alias("__key"), "keep", "n_dropped")
    texts = df.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("__own"))
    found = texts.join(bitmaps, (F.col("__id") == F.col("__doc")) & (F.col("__own") == F.col("__key")), "left")
    lines = text_lines(F.col("__text"))
    kept = F.when(F.col("keep").isNull(), F.col("__text")).otherwise(let(lines, lambda x: F.array_join(_stays(F.col("keep"), x), "\n")))
    return found.select(F.col("__id").alias(id_col), F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), kept.alias("kept_text"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT doc_id, line, pos, coalesce(doc_id < last, FALSE) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id
"""
