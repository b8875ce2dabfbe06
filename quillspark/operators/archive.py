"""Queries, checks and changes on the archive's own tables (pages, notes, contents, treenodes)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.columns import lookup, salience, strip
from quillspark.functions.constants import HEX_CODES, LIVE_SALIENCE_WEIGHTS, RANK_WEIGHTS
from quillspark.functions.rtf import inflate, rich_rtf, with_text
from quillspark.functions.spans import char_count, colour_chars
from quillspark.operators.ordered import in_order, place_in_group, running
from quillspark.operators.tree import ROOT, reindexed


def semantic_colour(hex_color: Column) -> Column:
    return lookup(HEX_CODES, F.upper(strip(hex_color)))


def notes_by_colour(notes: DataFrame, hex_color: str, limit: int = 100) -> DataFrame:
    return notes.where(F.col("bg_color") == hex_color).orderBy(F.desc("date_created"), "uid").limit(limit)


def notes_by_semantic_colour(notes: DataFrame, code: str, limit: int = 100) -> DataFrame:
    return notes.where(semantic_colour(F.col("bg_color")) == code).orderBy(F.desc("date_created"), "uid").limit(limit)


def caption_like(notes: DataFrame, query: str, limit: int | None = 50) -> DataFrame:
    """Notes whose caption holds the query: the first `limit` by uid, or with None all of them, unordered."""
    found = notes.where(F.col("caption").ilike(f"%{query}%"))
    return found if limit is None else found.orderBy("uid").limit(limit)


def standout_nodes(nodes: DataFrame, notes: DataFrame, contents: DataFrame, page_id: int, limit: int = 200) -> DataFrame:
    """Coloured nodes with little or no content, in tree order."""
    joined = nodes.where(F.col("page_id") == page_id).join(notes.drop("page_id"), F.col("note_uid") == F.col("uid")).join(contents.select(F.col("id").alias("__content"), "packed_size"), F.col("__content") == F.col("uid"), "left")
    good = (F.coalesce("bg_color", F.lit("")) != "") & (F.col("packed_size").isNull() | (F.col("packed_size") < 2000))
    out = joined.where(good).orderBy("parent_id", "sort_index", F.col("id")).limit(limit)
    return out.select("id", "parent_id", "uid", "caption", "bg_color", semantic_colour(F.col("bg_color")).alias("bg_semantic"), F.coalesce("packed_size", F.lit(0)).alias("size"))


def highlighted_spans(notes: DataFrame, codes: tuple[str, ...] = ("g", "b", "p", "u"), least_salience: float = 0.0, limit: int | None = 500) -> DataFrame:
    """Highlighted spans of three characters or more from the first `limit` notes (by uid; None: from
    all), by salience, colour weight, boldness."""
    first = notes if limit is None else notes.orderBy("uid").limit(limit)
    share = salience(colour_chars(F.col("spans")), char_count(F.col("spans")), LIVE_SALIENCE_WEIGHTS)
    rows = first.withColumn("salience", F.bround(share, 1)).where(F.col("salience") >= least_salience)
    spans = rows.select("uid", "caption", "salience", F.posexplode("spans").alias("place", "span")).where(F.col("span.highlight").isin(*codes) & (F.length(strip(F.col("span.text"))) >= 3))
    out = spans.select("uid", "caption", "salience", "place", F.col("span.highlight").alias("color"), F.col("span.bold").alias("bold"), strip(F.col("span.text")).alias("text"))
    return out.orderBy(F.desc("salience"), F.desc(lookup(RANK_WEIGHTS, F.col("color"), 0.0)), F.desc("bold"), "uid", "place")


def essence(spans: DataFrame, top_n: int = 100) -> DataFrame:
    """At most top_n/4 spans of each colour from the first 3 top_n ranked spans."""
    rank = (F.desc("salience"), F.desc(lookup(RANK_WEIGHTS, F.col("color"), 0.0)), F.desc("bold"), F.asc("uid"), F.asc("place"))
    first = spans.orderBy(*rank).limit(3 * top_n)
    place = F.row_number().over(Window.partitionBy("color").orderBy(*rank))
    return first.withColumn("n", place).where(F.col("n") <= top_n // 4)


def topic_context(notes: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """Found notes (place, caption, body) as long as what came before is within four characters a token. places are
    unique; lengths alone are summed up, over ranges of places."""
    shown = notes.withColumn("shown", F.concat(F.lit("\n### "), "caption", F.lit("\n"), F.substring("body", 1, 2000)))
    size = F.coalesce(F.length("shown"), F.lit(0)).cast("long")
    upto = running(in_order(shown.select("place", size.alias("size")), "place"), F.col("size"), "upto")
    before = upto.select("place", (F.col("upto") - F.col("size")).alias("before")).where(F.col("before") <= 4 * max_tokens)
    return shown.join(before, "place")


def integrity(notes: DataFrame, contents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(problem, rows): orphan notes, contents and nodes, broken parents, wrong child counts."""

    def problem(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.lit(name).alias("problem"), F.count("*").alias("rows"))

    up = nodes.select(F.col("page_id").alias("page_id"), F.col("id").alias("parent_id"))
    kids = nodes.groupBy("page_id", F.col("parent_id").alias("id")).agg(F.count("*").alias("kids"))
    counted = nodes.join(kids, ["page_id", "id"], "left").where(F.coalesce("child_count", F.lit(0)) != F.coalesce("kids", F.lit(0)))
    parts = [
        problem("orphan_notes", notes.join(nodes.select(F.col("note_uid").alias("uid")), "uid", "left_anti")),
        problem("orphan_contents", contents.join(notes.select(F.col("uid").alias("id")), "id", "left_anti")),
        problem("orphan_nodes", nodes.join(notes.select(F.col("uid").alias("note_uid")), "note_uid", "left_anti")),
        problem("broken_parents", nodes.where(F.col("parent_id") != ROOT).join(up, ["page_id", "parent_id"], "left_anti")),
        problem("wrong_child_counts", counted),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def note_scan(notes: DataFrame, contents: DataFrame) -> DataFrame:
    """Notes with their contents, contents or not."""
    return notes.join(contents.select(F.col("id").alias("uid"), "data", "packed_size"), "uid", "left")


def node_scan(nodes: DataFrame, notes: DataFrame) -> DataFrame:
    """Tree nodes with their notes' captions and colours."""
    return nodes.join(notes.select(F.col("uid").alias("note_uid"), "caption", "bg_color"), "note_uid", "left")


def point(df: DataFrame, **keys: object) -> DataFrame:
    """Rows at a key."""
    for name, value in keys.items():
        df = df.where(F.col(name) == value)
    return df


# Changes: the state and a set of changes give the new state; a table is then written anew.


def patched(notes: DataFrame, patch: DataFrame, key: str = "uid", set_null: bool = False) -> DataFrame:
    """notes with the non-null values of patch (key and some of the columns); with set_null with all."""
    names = [c for c in patch.columns if c != key]
    changes = patch.select(key, F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in names))
    joined = notes.join(changes, key, "left")

    def value(c: str) -> Column:
        return F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) if set_null else F.coalesce(f"__{c}", c)

    return joined.select(*(value(c).alias(c) if c in names else c for c in notes.columns))


def appended(contents: DataFrame, uid: int, text: str, code: str | None = None, bold: bool = False) -> DataFrame:
    """contents (id, data, ...) with a formatted piece behind one note's rich text; null data is an empty text.
    Only that note's rows meet Python; the others, and those without an id, pass as they are."""
    fields = contents.columns

    @F.pandas_udf("binary")
    def added(data: pd.Series) -> pd.Series:
        return data.map(lambda b: with_text("" if b is None else inflate(bytes(b)), text, code, bold).encode("cp1252", "replace"))

    its = F.coalesce(F.col("id") == uid, F.lit(False))
    changed = contents.where(its).withColumn("data", added("data"))
    changed = changed.withColumn("packed_size", F.octet_length("data").cast("long")).select(*fields) if "packed_size" in fields else changed.select(*fields)
    return contents.where(~its).unionByName(changed)


def created(notes: DataFrame, contents: DataFrame, nodes: DataFrame, page_id: int, parent_id: int, place: int, caption: str, spans: list[tuple[str, str | None, bool, bool]], bg_color: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A whole new note: its row (other columns as those of the least uid), its rich-text contents and its
    node at a place among its siblings. The archive must have a note to take the other columns from."""
    first = notes.orderBy("uid").limit(1)
    if first.isEmpty():
        raise ValueError("no note to take a new note's columns from")
    uid = notes.agg(F.max("uid")).first()[0] + 1
    new = {"uid": F.lit(uid), "page_id": F.lit(page_id), "caption": F.lit(caption), "bg_color": F.lit(bg_color), "guid": F.expr("uuid()")}
    row = first.select(*((new[c] if c in new else F.col(c)).cast(t).alias(c) for c, t in notes.dtypes))
    data = rich_rtf(spans).encode("cp1252", "replace")
    content = notes.sparkSession.createDataFrame([(uid, bytearray(data), len(data))], "id long, data binary, packed_size long")
    return notes.unionByName(row), contents.unionByName(content, allowMissingColumns=True), inserted(nodes, page_id, parent_id, place, uid)


def inserted(nodes: DataFrame, page_id: int, parent_id: int, place: int, note_uid: int) -> DataFrame:
    """A new last-numbered node at a place among its siblings; the others move up."""
    new_id = (nodes.where(F.col("page_id") == page_id).agg(F.max("id")).first()[0] or 0) + 1
    mine = (F.col("page_id") == page_id) & (F.col("parent_id") == parent_id) & (F.col("sort_index") >= place)
    moved = nodes.withColumn("sort_index", F.when(mine, F.col("sort_index") + 1).otherwise(F.col("sort_index")))
    row = nodes.sparkSession.createDataFrame([(page_id, new_id, parent_id, place, note_uid)], "page_id long, id long, parent_id long, sort_index long, note_uid long")
    return recount(moved.unionByName(row, allowMissingColumns=True))


def deleted(nodes: DataFrame, tree: DataFrame, page_id: int, node_id: int, recursive: bool) -> DataFrame:
    """Without a node and all below it, or without it alone, its children going to its parent."""
    if recursive:
        gone = tree.where((F.col("page_id") == page_id) & F.array_contains("id_path", node_id)).select("page_id", "id")
        return recount(nodes.join(gone, ["page_id", "id"], "left_anti"))
    is_it = (F.col("page_id") == page_id) & (F.col("id") == node_id)
    up = nodes.where(is_it).select(F.col("page_id"), F.col("id").alias("parent_id"), F.col("parent_id").alias("__up"))
    kept = nodes.where(~is_it).join(up, ["page_id", "parent_id"], "left")
    return recount(kept.withColumn("parent_id", F.coalesce("__up", "parent_id")).select(*nodes.columns))


def moved(nodes: DataFrame, tree: DataFrame, page_id: int, node_id: int, to_page: int, to_parent: int) -> DataFrame:
    """A node under another parent, its whole subtree with it across pages (numbered on there)."""
    inside = tree.where((F.col("page_id") == page_id) & F.array_contains("id_path", node_id)).select("page_id", "id", F.lit(True).alias("__in"))
    shift = 0 if to_page == page_id else (nodes.where(F.col("page_id") == to_page).agg(F.max("id")).first()[0] or 0)
    marked = nodes.join(inside, ["page_id", "id"], "left")
    mine = F.coalesce("__in", F.lit(False))
    top = mine & (F.col("id") == node_id)
    out = marked.select(
        *(
            F.when(mine, to_page).otherwise(F.col("page_id")).alias(c)
            if c == "page_id"
            else F.when(mine, F.col("id") + shift).otherwise(F.col("id")).alias(c)
            if c == "id"
            else F.when(top, to_parent).when(mine, F.col("parent_id") + shift).otherwise(F.col("parent_id")).alias(c)
            if c == "parent_id"
            else F.col(c)
            for c in nodes.columns
        )
    )
    return recount(out)


def reordered(nodes: DataFrame, page_id: int, node_id: int, place: int) -> DataFrame:
    """A node at a new place among its siblings, all numbered anew."""
    is_it = (F.col("page_id") == page_id) & (F.col("id") == node_id)
    key = F.when(is_it, F.lit(place) - 0.5).otherwise(F.col("sort_index").cast("double"))
    its = nodes.where(is_it).select("page_id", "parent_id", F.col("sort_index").alias("__old"))  # one row
    keyed = nodes.join(F.broadcast(its), ["page_id", "parent_id"], "left")
    key = F.when(is_it & (F.col("__old") < place), place + 0.5).otherwise(key)
    placed = place_in_group(keyed.withColumn("__key", key), ("page_id", "parent_id"), "__key", "id", name="__n")
    return placed.withColumn("sort_index", F.col("__n") - 1).select(*nodes.columns)


def recount(nodes: DataFrame) -> DataFrame:
    """Child counts and sibling numbers derived anew."""
    kids = nodes.groupBy("page_id", F.col("parent_id").alias("id")).agg(F.count("*").alias("__kids"))
    counted = nodes.drop("child_count").join(kids, ["page_id", "id"], "left").withColumn("child_count", F.coalesce("__kids", F.lit(0))).drop("__kids")
    return reindexed(counted)


def subset(notes: DataFrame, contents: DataFrame, nodes: DataFrame, tree: DataFrame, page_id: int, branches: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes, contents and nodes of some branches of one page (all of it for no branches)."""
    inside = F.col("page_id") == page_id
    if branches:
        inside = inside & F.arrays_overlap("id_path", F.array(*(F.lit(b).cast("long") for b in branches)))
    kept = tree.where(inside).select("page_id", "id")
    nodes = nodes.join(kept, ["page_id", "id"], "left_semi")
    notes = notes.join(nodes.select(F.col("note_uid").alias("uid")), "uid", "left_semi")
    return notes, contents.join(notes.select(F.col("uid").alias("id")), "id", "left_semi"), nodes
