"""The archive's concepts over the driver's tables, for queries and tests.

A document is a note, its source a page, each line a span. Colours and boldness follow integer rules
on (document, line), so that any engine can repeat them. Regions, nations, customers and suppliers
form a tree; documents, some with the embedding of their number, form a retrieval corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.columns import effective_weight
from quillspark.operators.units import knowledge_units

CODES = ("u", "p", "b", "g", "g2", "y", "o")
#: Fixed rule: tree node ids of nations, customers and suppliers start here; regions at 1.
NATION, CUSTOMER, SUPPLIER = 100, 1_000, 100_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores where it lies in fewer files than there are cores (one row group is one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


#: Of a document.
PAGE = "cast(substr(source, 4) as int)"


def with_tokens(text: Column) -> Column:
    """text with a line [BR2] behind lines 3, 10, ... and [BR3] behind lines 6, 13, ..."""
    token = lambda i: F.when(i % 7 == 3, "\n[BR2]").when(i % 7 == 6, "\n[BR3]").otherwise("")
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda t, i: F.concat(t, token(i))), "\n")


#: A piece of a line: two words with the spaces behind them, or what is left.
PIECE = "[^ ]+ +[^ ]+ +|[^ ]+ *| +"


def mixed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with several spans a line: pieces of two words, coloured and bold by (document, line, piece)."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")

    def line(text: Column, i: Column) -> Column:
        def span(t: Column, k: Column) -> Column:
            return F.struct(t.alias("text"), code_of((F.col("doc_id") * 7 + i * 3 + k * 5) % 16).alias("highlight"), ((F.col("doc_id") + i + k) % 3 == 0).alias("bold"), F.lit(False).alias("italic"))

        newline = F.struct(F.lit("\n").alias("text"), F.lit(None).cast("string").alias("highlight"), F.lit(False).alias("bold"), F.lit(False).alias("italic"))
        return F.array_append(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), span), newline)

    spans = F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line))
    return docs.select(F.col("doc_id").alias("note_uid"), spans.alias("spans"))


#: Fixed rule: hex colours of stand-in notes by (document x 5) modulo 16; missing ones have none.
HEX = ("FF99CC", "ccffff ", "CCFFCC", "", "CC99FF", "99CC00", "FFFF99", "123456")


def archive_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """An archive's own tables: documents as notes with rich-text contents, each note a node of one tree
    in which node i (from 1) lies under node (i - 1) div 4. Some nodes have no note, some notes no content."""
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    caption = F.when(i % 29 == 7, "=====").when(i % 31 == 9, " ").otherwise(F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 1, 60))
    notes = docs.select(
        i.alias("uid"),
        F.expr(PAGE).cast("long").alias("page_id"),
        caption.alias("caption"),
        F.get(F.array(*(F.lit(h) for h in HEX)), ((i * 5) % 16).cast("int")).alias("bg_color"),
        (F.lit(40000.25) + i % 1000).alias("date_created"),
    )
    contents = docs.where(i % 13 != 5).select(i.alias("id"), F.col("text"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("packed_size"))
    nodes = docs.select(
        F.lit(1).cast("long").alias("page_id"),
        (i + 1).alias("id"),
        F.when(i < 4, -1).otherwise(F.expr("doc_id div 4")).cast("long").alias("parent_id"),
        (i % 4).alias("sort_index"),
        F.when(i % 17 == 3, i + 1_000_000_000).otherwise(i).alias("note_uid"),
        (i % 5).alias("child_count"),
        caption.alias("caption"),
    )
    return {"pages": pages(spark, sf_dir).select(F.col("page_id").cast("long").alias("id"), F.col("page_caption").alias("caption")), "notes": notes, "contents": contents, "treenodes": nodes}


def code_of(k: Column) -> Column:
    return F.get(F.array(*(F.lit(c) for c in CODES)), k.cast("int"))


def notes(spark: SparkSession, sf_dir: str, narrow: bool = False, tokens: bool = False) -> DataFrame:
    """narrow: two words a line. tokens: every seventh line is followed by a line with a break token."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    if narrow:
        docs = docs.withColumn("text", F.regexp_replace("text", r"([^ \n]+ [^ \n]+) ", "$1\n"))
    if tokens:
        docs = docs.withColumn("text", with_tokens(F.col("text")))
    lines = F.split(F.coalesce("text", F.lit("")), r"(?<=\n)", -1)  # each line keeps its newline

    def span(t: Column, i: Column) -> Column:
        color = code_of((F.col("doc_id") * 7 + i * 3) % 16)
        bold = (F.col("doc_id") + i) % 5 == 0
        return F.struct(t.alias("text"), color.alias("highlight"), bold.alias("bold"), F.lit(False).alias("italic"))

    return docs.select(
        F.col("doc_id").alias("note_uid"),
        F.expr(PAGE).alias("page_id"),
        F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 1, 60).alias("caption"),
        code_of((F.col("doc_id") * 5) % 16).alias("node_color"),
        F.concat_ws(" > ", "source", "lang").alias("tree_path"),
        F.timestamp_add("DAY", F.col("doc_id") % 1000, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")).alias("date_created"),
        F.transform(lines, span).alias("spans"),
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge_units(notes(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of all notes, and 0 to 24, so that some have no note."""
    used = table(spark, sf_dir, "documents").select(F.expr(PAGE).cast("long").alias("id")).where("id IS NOT NULL")
    return spark.range(25).union(used).distinct().select(F.col("id").cast("int").alias("page_id"), F.concat(F.lit("page "), F.col("id").cast("string")).alias("page_caption"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")

    def of(df: DataFrame, id_: Column, parent: Column, caption: str, chars: Column) -> DataFrame:
        return df.select(F.lit(1).alias("page_id"), id_.cast("long").alias("id"), parent.cast("long").alias("parent_id"), id_.cast("long").alias("sort_index"), F.col(caption).alias("caption"), chars.cast("long").alias("chars"))

    none = F.lit(0)
    return (
        of(region, F.col("r_regionkey") + 1, F.lit(-1), "r_name", none)
        .unionByName(of(nation, F.col("n_nationkey") + NATION, F.col("n_regionkey") + 1, "n_name", none))
        .unionByName(of(customer, F.col("c_custkey") + CUSTOMER, F.col("c_nationkey") + NATION, "c_name", F.floor(F.abs("c_acctbal"))))
        .unionByName(of(supplier, F.col("s_suppkey") + SUPPLIER, F.col("s_nationkey") + NATION, "s_name", F.floor(F.abs("s_acctbal"))))
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its whole text; ten units a note. Where an embedding has its number, that is the
    plain vector, and turned round the context vector; the other documents have none."""
    vectors, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    joined = docs.join(vectors, vectors["vec_id"] == docs["doc_id"], "left")
    color, bold = code_of((F.col("doc_id") * 7) % 16), F.col("doc_id") % 5 == 0
    return joined.select(
        F.col("doc_id").alias("unit_id"),
        F.expr("doc_id div 10").alias("note_uid"),
        "text",
        color.alias("color"),
        bold.alias("is_bold"),
        effective_weight(color, bold).alias("effective_weight"),
        code_of(F.col("label") % 7).alias("section_color"),
        F.concat_ws(" > ", "source", "lang").alias("tree_path"),
        F.col("embedding").alias("vector_plain"),
        F.reverse("embedding").alias("vector_context"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of the benchmark, its whole text, as a question."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _asked(vectors: DataFrame, turned: bool) -> DataFrame:
    return vectors.select(F.col("vec_id").alias("query_id"), (F.reverse("embedding") if turned else F.col("embedding")).alias("vector"))


def query_vectors(spark: SparkSession, sf_dir: str, turned: bool = False) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100, as embedded questions."""
    return _asked(table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == 0), turned)


def question_vectors(spark: SparkSession, sf_dir: str, turned: bool = False) -> DataFrame:
    """For each question the vector of its id, for retrieval by words and vectors together."""
    vectors, items = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "benchmark")
    return _asked(vectors.join(items, vectors["vec_id"] == items["item_id"], "left_semi"), turned)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rated runs: type = regime, user = question, mean value = score."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("question_id"), F.col("event_type").alias("regime")).agg(F.avg("value").alias("score"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").cast("string").alias("question_id"), F.col("event_type").alias("regime"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three runs are rated, half of them blind; every fourth rating has no diagnostics."""
    rated = table(spark, sf_dir, "events").where(F.col("event_id") % 3 != 0)
    some = F.col("event_id") % 4 != 0
    return rated.select(
        F.col("event_id").alias("run_id"),
        F.round(F.col("value"), 2).alias("overall"),
        F.when(some, F.col("event_id") % 101).alias("correctness"),
        F.when(some, F.col("event_id") % 97).alias("completeness"),
        F.when(some, F.col("event_id") % 89).alias("grounding"),
        (F.col("event_id") % 2 == 0).alias("blind"),
    )
