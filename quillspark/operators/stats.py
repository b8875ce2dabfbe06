"""Aggregates over units, notes, pages and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.columns import ratio
from quillspark.functions.constants import COLOUR_CODES, COLOUR_NAMES, LENGTH_BUCKETS, OLD_TAGS, RANK_WEIGHTS


def count_if(condition: Column | str) -> Column:
    condition = F.col(condition) if isinstance(condition, str) else condition
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def note_stats(units: DataFrame) -> DataFrame:
    """Per note: units, highlighted, captions, average and greatest weight, units per colour as a map."""
    by_colour = units.groupBy("note_uid", "color").agg(F.count("*").alias("n"), F.sum("effective_weight").alias("w"), F.max("effective_weight").alias("m"), count_if(F.col("source_type") == "treenode").alias("c"))
    entries = F.array_sort(F.collect_list(F.struct(F.coalesce("color", F.lit("none")).alias("key"), F.col("n").alias("value"))))
    return by_colour.groupBy("note_uid").agg(
        F.sum("n").alias("total_units"),
        F.coalesce(F.sum(F.when(F.col("color").isNotNull(), F.col("n"))), F.lit(0)).alias("highlighted_units"),
        F.sum("c").alias("caption_units"),
        (F.sum("w") / F.sum("n")).alias("avg_weight"),
        F.max("m").alias("max_weight"),
        F.map_from_entries(entries).alias("weight_distribution"),
    )


def page_stats(pages: DataFrame, notes: DataFrame) -> DataFrame:
    """Every page with its notes' sums, zeros where it has none.

    notes: page_id, chars_total, chars_highlighted, salience, depth, chars_<colour>."""
    colours = [c for c in COLOUR_CODES if f"chars_{c}" in notes.columns]
    sums = notes.groupBy("page_id").agg(
        F.count("*").alias("note_count"),
        F.sum("chars_total").alias("total_chars"),
        F.sum("chars_highlighted").alias("highlighted_chars"),
        F.avg("salience").alias("avg_salience"),
        F.max("depth").alias("max_depth"),
        *(F.sum(f"chars_{c}").alias(f"chars_{c}") for c in colours),
    )
    out = pages.join(sums, "page_id", "left")
    filled = out.fillna(0, ["note_count", "total_chars", "highlighted_chars", "avg_salience", "max_depth", *(f"chars_{c}" for c in colours)])
    return filled.withColumn("highlight_ratio", ratio(F.col("highlighted_chars").cast("double"), F.col("total_chars")))


def unit_summary(units: DataFrame) -> DataFrame:
    """One row of counts over all units."""
    return units.agg(
        F.count("*").alias("total"),
        count_if(F.col("color").isNotNull()).alias("highlighted"),
        count_if("is_bold").alias("bold"),
        count_if("is_separator").alias("separators"),
        count_if("is_trivial").alias("trivial"),
        count_if("is_duplicate").alias("duplicates"),
        F.avg("effective_weight").alias("avg_weight"),
        F.avg(F.when(F.col("color").isNotNull(), F.col("effective_weight"))).alias("avg_highlight_weight"),
    )


def units_by_colour(units: DataFrame) -> DataFrame:
    """Count, average weight and length per colour; no colour is a group of its own."""
    return units.groupBy("color").agg(F.count("*").alias("units"), F.avg("effective_weight").alias("avg_weight"), F.avg(F.length("text")).alias("avg_chars"))


def units_by_page(units: DataFrame, pages: DataFrame) -> DataFrame:
    return units.groupBy("page_id").agg(F.count("*").alias("units"), count_if(F.col("color").isNotNull()).alias("highlighted")).join(pages, "page_id")


def index_summary(units: DataFrame) -> DataFrame:
    return units.groupBy(F.coalesce("color", F.lit("unmarked")).alias("color")).agg(F.count("*").alias("units"))


def corpus_stats(units: DataFrame) -> DataFrame:
    """One row: fragments, highlighted (weight of 1 or more), notes, average characters to one place, and
    for each vector column of units how many have one."""
    vectors = [c for c in units.columns if c.startswith("vector_")]
    return units.agg(
        *(F.count(c).alias(f"embedded_{c.removeprefix('vector_')}") for c in vectors),
        F.count("*").alias("fragments"),
        count_if(F.col("effective_weight") >= 1.0).alias("highlighted"),
        F.countDistinct("note_uid").alias("notes"),
        F.bround(F.avg(F.length("text")), 1).alias("avg_chars"),
    )


def corpus_by_colour(units: DataFrame) -> DataFrame:
    """(color, fragments): the corpus's fragments of each colour, `unmarked` for none."""
    return units.groupBy(F.coalesce("color", F.lit("unmarked")).alias("color")).agg(F.count("*").alias("fragments"))


def colour_stats(units: DataFrame) -> DataFrame:
    """Units and characters of each colour, and of nb and n; colours without rows stay, with zeros."""
    spark = units.sparkSession
    sums = units.groupBy("color", "is_bold").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"))
    virtual = F.when(F.col("is_bold"), F.array(F.lit("n"), F.lit("nb"))).otherwise(F.array(F.lit("n")))
    codes_of = F.when(F.col("color").isNotNull(), F.array("color")).otherwise(virtual)
    counted = sums.select(F.explode(codes_of).alias("code"), "n", "c").groupBy("code").agg(F.sum("n").alias("units"), F.sum("c").alias("chars"))
    names = [(c, COLOUR_NAMES[c], RANK_WEIGHTS[c]) for c in COLOUR_CODES] + [("nb", "bold (uncoloured)", 0.0), ("n", "uncoloured", 0.0)]
    codes = spark.createDataFrame(names, "code string, name string, weight double")
    return codes.join(counted, "code", "left").fillna(0, ["units", "chars"])


def old_colour_stats(units: DataFrame) -> DataFrame:
    """The older report: per tag, with a total row."""
    tags = units.sparkSession.createDataFrame(list(OLD_TAGS.items()), "color string, tag string")
    return units.join(tags, "color").rollup("tag").agg(F.count("*").alias("units"), F.sum(F.length("text")).alias("chars")).withColumn("tag", F.coalesce("tag", F.lit("TOTAL")))


def length_histogram(units: DataFrame) -> DataFrame:
    """Units per half-open length bucket; empty buckets stay."""
    spark = units.sparkSession
    n = F.length("text")
    bucket = F.lit(LENGTH_BUCKETS[0])
    for low in LENGTH_BUCKETS[1:]:
        bucket = F.when(n >= low, low).otherwise(bucket)
    counts = units.groupBy(bucket.alias("low")).agg(F.count("*").alias("units"))
    lows = spark.createDataFrame([(x,) for x in LENGTH_BUCKETS], "low int")
    return lows.join(counts, "low", "left").fillna(0, ["units"])


def index_percentiles(units: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Lengths at place min(n-1, int(n p)) of the sorted lengths, from a histogram of lengths: no row
    is sorted, and the window runs over distinct lengths only."""
    counts = units.groupBy(F.length("text").alias("value")).agg(F.count("*").alias("n"))
    order = Window.orderBy("value")  # one row per distinct length
    upto = counts.select("value", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    at = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("total") * p), F.col("total") - 1), F.col("value"))).alias(f"p{round(100 * p)}") for p in shares]
    return upto.agg(*at)


def dominant_colour(notes: DataFrame) -> DataFrame:
    """Per note the colour with most characters; ties go to p, b, g, y, o, u in this order."""
    order = ("p", "b", "g", "y", "o", "u")
    most = F.greatest(*(F.col(f"chars_{c}") for c in order))
    out = F.lit(None).cast("string")
    for c in reversed(order):
        out = F.when(F.col(f"chars_{c}") == most, c).otherwise(out)
    return notes.withColumn("dominant", F.when(most > 0, out))


def page_note_counts(pages: DataFrame, notes: DataFrame) -> DataFrame:
    return pages.join(notes.groupBy("page_id").agg(F.count("*").alias("notes")), "page_id", "left").fillna(0, ["notes"])


def best_lines(units: DataFrame, n: int = 10) -> DataFrame:
    """The n units of greatest weight, then length."""
    return units.orderBy(F.desc("effective_weight"), F.desc(F.length("text")), "unit_id").limit(n)


def embeddable(units: DataFrame) -> DataFrame:
    return units.where((F.col("effective_weight") >= 1.0) & ~F.col("is_trivial") & ~F.col("is_separator") & ~F.col("is_duplicate"))


def build_counters(spark: SparkSession, **frames: DataFrame) -> DataFrame:
    """Rows per named table."""
    out = None
    for name, df in frames.items():
        row = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "table string, rows long")
