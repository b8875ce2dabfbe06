"""What filters remove in every order in which they can be applied (operator 13).

1. One scan computes which filters each document fails: a narrow table of flags, without texts.
2. Filters form a trie of orders. It is walked depth-first; a node is the set of filters applied so far, so
   orders that begin with the same set share one node, which is entered once (memoised). A node holds the
   documents that survived, a persisted DataFrame made from its parent's; when the walk leaves the node it is
   released, so at most one frame a level is held.
3. At each node one aggregation counts, per part, what each filter not applied yet would find and remove. These
   edges are appended to a table in the shared folder; the driver sees none of them.
4. The report of all orders is a join of the fixed list of (order, step, node, filter) with the edges.

With f filters there are 2^f nodes and f! orders; both are fixed by the filters and do not grow with the table.

Defined results of the query's filters: see `failures` and `table_flags`. A null text is empty; a null or empty part
is ''. A document with a null id has no smaller ids and is never identical to a smaller one. Repeated rows each
count; rows that share id and text are not copies of each other. Labels that repeat for one document count if any
of them says so; labels with a null document are ignored. Very long texts are counted whole. Extra columns are
ignored, whatever their names. Empty tables: no rows.
"""

from __future__ import annotations

import math
import uuid
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._util import scratch_folder, scratch_table, shuffle_partitions
from quillspark.llm.quality import let, word_array

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT = 100, 80, 10


def failures(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter that looks at it alone: A few words, B few distinct words, C many capital
    letters A to Z, D holds any of # $ % & * |."""

    def counts(words: Column) -> Column:
        n = F.size(words)
        return F.struct((n < LEAST_WORDS).alias("A"), (100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT_PERCENT * n.cast("long")).alias("B"))

    words = let(word_array(text), counts)
    upper = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return {"A": words["A"], "B": words["B"], "C": 100 * upper > MOST_UPPER_PERCENT * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def copies_of_smaller(rows: DataFrame, id_col: str, digest: tuple[str, ...]) -> DataFrame:
    """rows with copy: whether a smaller id has the same digest. Digests that hold more than a partition's share
    of the rows (fewer than there are partitions) come back by broadcast, all others by a join on the digest."""
    partitions = shuffle_partitions(rows.sparkSession)
    share = rows.count() // partitions
    groups = rows.groupBy(*digest).agg(F.min(id_col).alias("__least"), F.max(id_col).alias("__most"), F.count("*").alias("__rows"))
    groups = scratch_table(groups.where("__least < __most"))
    named = [F.col(c).alias(f"__of_{c}") for c in digest]
    out = rows
    for part, large in ((groups.where(F.col("__rows") > share), True), (groups.where(F.col("__rows") <= share), False)):
        side = part.select(*named, F.col("__least").alias(f"__least_{large}"))
        on = [F.col(c) == F.col(f"__of_{c}") for c in digest]
        out = out.join(F.broadcast(side) if large else side, on, "left").drop(*(f"__of_{c}" for c in digest))
    least = F.coalesce("__least_True", "__least_False")
    return out.withColumn("copy", F.coalesce(F.col(id_col) > least, F.lit(False))).drop("__least_True", "__least_False")


def table_flags(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, fails_A to fails_E, good, toxic) of each document; E: its text is identical to a smaller id's."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    base = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    # A generator of one row: nothing above it can compute the flags a second time.
    seen = base.select("id", "part", F.inline(F.array(F.struct(*(c.alias(f"fails_{k}") for k, c in failures(text).items()), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")))))
    flagged = copies_of_smaller(scratch_table(seen), "id", ("h1", "h2")).withColumnRenamed("copy", "fails_E")
    judged = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    found = flagged.join(judged, flagged["id"] == judged["labelled"], "left")
    return found.select("part", *(f"fails_{k}" for k in FILTERS), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def walk(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The edges (node, filter, part, found, removed, good_lost, toxic_lost): at the node with these filters
    applied (letters in order), `found` documents of the part survive, of which the filter removes `removed`."""
    spark = flags.sparkSession
    path = f"{scratch_folder(spark)}/edges-{uuid.uuid4().hex}"
    seen: set[str] = set()

    def visit(node: str, survivors: DataFrame) -> None:
        left = [k for k in filters if k not in node]
        if node in seen or not left:
            return
        seen.add(node)
        survivors.persist(StorageLevel.MEMORY_AND_DISK)
        fails = {k: F.col(f"fails_{k}") for k in left}
        counts = [F.struct(F.lit(k).alias("filter"), _count(c).alias("removed"), _count(c & F.col("good")).alias("good_lost"), _count(c & F.col("toxic")).alias("toxic_lost")) for k, c in fails.items()]
        edges = survivors.groupBy("part").agg(F.count("*").alias("found"), F.array(*counts).alias("edges"))
        edges.select(F.lit(node).alias("node"), "part", "found", F.inline("edges")).write.mode("append").parquet(path)
        for k in left:
            visit("".join(sorted(node + k)), survivors.where(~fails[k]))
        survivors.unpersist()

    visit("", flags)
    return spark.read.schema("node string, part string, found long, filter string, removed long, good_lost long, toxic_lost long").parquet(path)


def all_orders(edges: DataFrame, totals: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each
    part of totals (part, fails_<k>, only_<k>), zeros included. Orders are a fixed list, exploded from a literal."""
    n = len(filters)
    steps = []
    for order in permutations(filters):
        for i, k in enumerate(order):
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit("".join(sorted(order[:i]))).alias("node"), F.lit(k).alias("filter")))
    listed = totals.select("part", F.inline(F.array(*steps)))
    whole = F.coalesce(F.col("removed"), F.lit(0).cast("long"))
    found = listed.join(edges, ["part", "node", "filter"], "left")
    # Orders in which the filter comes right after the node's filters.
    weight = F.lit(0).cast("long")
    for size in range(n):
        weight = F.when(F.length("node") == size, math.factorial(size) * math.factorial(n - 1 - size)).otherwise(weight)
    shapley = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).cast("long").alias("shapley"))
    per_filter = totals.select("part", F.inline(F.array(*(F.struct(F.lit(k).alias("filter"), F.col(f"fails_{k}").alias("fails"), F.col(f"only_{k}").alias("unique_fails")) for k in filters))))
    per_filter = per_filter.join(shapley, ["part", "filter"], "left")
    out = found.join(per_filter, ["part", "filter"])
    zero = F.lit(0).cast("long")
    return out.select(
        "part",
        "filter_order",
        "step",
        (F.coalesce("found", zero) - whole).alias("kept"),
        whole.alias("removed"),
        (F.col("fails") - whole).alias("redundant"),
        "unique_fails",
        F.coalesce("good_lost", zero).alias("good_lost"),
        F.coalesce("toxic_lost", zero).alias("toxic_lost"),
        F.coalesce("shapley", zero).alias("shapley"),
    )


def interactions(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The report of all orders over a table of flags (part, fails_<filter>, good, toxic)."""
    stored = scratch_table(flags)
    fails = {k: F.col(f"fails_{k}") for k in filters}

    def only(k: str) -> Column:
        alone = fails[k]
        for other in filters:
            alone = alone & ~fails[other] if other != k else alone
        return alone

    totals = stored.groupBy("part").agg(*(_count(fails[k]).alias(f"fails_{k}") for k in filters), *(_count(only(k)).alias(f"only_{k}") for k in filters))
    return all_orders(walk(stored, filters), scratch_table(totals), filters)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return interactions(table_flags(documents, labels))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
j AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
f AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
 + 4 * (100 * len(regexp_extract_all(d.text, '[A-Z]')) > 10 * length(d.text))::INT + 8 * regexp_matches(d.text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > least, FALSE)::INT AS mask
 FROM d JOIN m ON m.text = d.text LEFT JOIN j ON j.doc_id = d.doc_id),
g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l(k, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step, bits FROM o),
t AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM s),
p AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
 coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
 coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost FROM g, t GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM p
"""
