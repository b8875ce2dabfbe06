"""Trees given as adjacency lists (page_id, id, parent_id, sort_index): hierarchy, rollups, subtrees.

Ids are unique per page only, so every step is keyed on the page too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.columns import ratio, salience
from quillspark.operators.ordered import in_order, lookup, place_in_group, previous, running
from quillspark.sources.storage import scratch_table

ROOT = -1


def _doubled(state: DataFrame, rise: Callable[[DataFrame], DataFrame] | None, fall: list[tuple[str, Column]]) -> DataFrame:
    """Pointer doubling. state: (page_id, id, jump, ...), a row a node, jump being the parent (null for none).

    In round r a node's jump is its ancestor 2^r levels up. rise(state), if any, adds what nodes send up to their
    jumps; fall names a node's columns after it has met those of its jump, which carry the prefix up_. Each
    round shuffles a row a node, so a tree of depth d takes about log2(d) rounds of n rows. Each round is stored:
    lineage stays short. Depths are contiguous, so once no node arrives in a round, those that are still under
    way are on or below cycles, and keep their jumps."""
    before = None
    while True:
        if rise is not None:
            state = scratch_table(rise(state))
        going = state.where(F.col("jump").isNotNull())
        count = going.count()
        if count in (0, before):
            return state
        before = count
        up = state.select("page_id", F.col("id").alias("jump"), *(F.col(c).alias(f"up_{c}") for c in state.columns if c not in ("page_id", "id")))
        met = lookup(going, up, ("page_id", "jump"), "left", count)
        moved = met.select("page_id", "id", F.col("up_jump").alias("jump"), *(c.alias(n) for n, c in fall))
        state = scratch_table(state.where(F.col("jump").isNull()).unionByName(moved))


def _linked(nodes: DataFrame) -> DataFrame:
    """(page_id, id, jump, lost): parents as first jumps; lost: the parent does not exist."""
    ids = nodes.select("page_id", F.col("id").alias("parent_id"), F.lit(True).alias("__known")).distinct()
    known = lookup(nodes.select("page_id", "id", "parent_id"), ids, ("page_id", "parent_id"), "left")
    rooted, there = F.col("parent_id") == ROOT, F.coalesce("__known", F.lit(False))
    return known.select("page_id", "id", F.when(~rooted & there, F.col("parent_id")).alias("jump"), F.coalesce(~rooted & ~there, F.lit(True)).alias("lost"))


def paths(nodes: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(page_id, id, reached, lost, depth, <name> ...): per node the arrays of the given expressions over nodes
    from the root down to it. reached is false for nodes on or below a cycle; lost is true below a node whose
    parent does not exist. Node ids must be unique on a page."""
    own = nodes.select("page_id", "id", *(F.array(c).alias(n) for n, c in columns.items()))
    state = scratch_table(_linked(nodes).join(own, ["page_id", "id"]).withColumn("depth", F.when(F.col("jump").isNotNull(), 1).otherwise(0)))
    fall = [("lost", F.col("lost") | F.col("up_lost")), *((n, F.concat(f"up_{n}", n)) for n in columns), ("depth", F.col("depth") + F.col("up_depth"))]
    out = _doubled(state, None, fall)
    return out.select("page_id", "id", F.col("jump").isNull().alias("reached"), "lost", "depth", *columns)


def hierarchy(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """nodes plus depth, id_path (array of ids) and captions (array, the first cut at 50 characters, others at 30);
    nodes that no root reaches drop out (`unreached` lists them). A tree deeper than max_depth is an error."""
    caption = F.when(F.col("parent_id") == ROOT, F.substring("caption", 1, 50)).otherwise(F.substring("caption", 1, 30))
    found = paths(nodes, {"id_path": F.col("id"), "captions": caption}).where("reached AND NOT lost")
    if max_depth is not None and found.where(F.col("depth") > max_depth).limit(1).count():
        raise ValueError(f"the tree is deeper than {max_depth} levels")
    return nodes.join(found.drop("reached", "lost"), ["page_id", "id"]).select(*nodes.columns, "depth", "id_path", "captions")


def unreached(nodes: DataFrame) -> DataFrame:
    """(page_id, id, reason) of the nodes that no root reaches: `cycle` on or below one, else `missing parent`."""
    found = paths(nodes, {}).where("NOT reached OR lost")
    return found.select("page_id", "id", F.when(~F.col("reached"), "cycle").otherwise("missing parent").alias("reason"))


def with_paths(tree: DataFrame) -> DataFrame:
    """path as ids joined by / and caption_path joined by ` > `."""
    return tree.withColumns({"path": F.array_join(F.transform("id_path", lambda x: x.cast("string")), "/"), "caption_path": F.array_join("captions", " > ")})


def _state(tree: DataFrame, *columns: Column | str) -> DataFrame:
    """(page_id, id, jump, ...) of a tree in which every node is reached."""
    return tree.select("page_id", "id", F.when(F.col("parent_id") != ROOT, F.col("parent_id")).alias("jump"), *columns)


def rollup(tree: DataFrame, sums: list[str]) -> DataFrame:
    """For each node, subtree_nodes and subtree_<c> over itself and all nodes below.

    In round r a node holds the sums of all below it within 2^r levels; its own sums go up 2^r levels, where those
    of all senders are added. So n rows are combined a round, not one for each node and ancestor."""
    names = ["subtree_nodes", *(f"subtree_{c}" for c in sums)]
    # As sum() over rows: null where all are null.
    state = scratch_table(_state(tree, F.lit(1).cast("long").alias("subtree_nodes"), *(F.col(c).alias(f"subtree_{c}") for c in sums)))

    def rise(s: DataFrame) -> DataFrame:
        sent = s.where(F.col("jump").isNotNull()).groupBy("page_id", F.col("jump").alias("id")).agg(*(F.sum(c).alias(f"sent_{c}") for c in names))
        both = [F.when(F.col(c).isNotNull() | F.col(f"sent_{c}").isNotNull(), F.coalesce(c, F.lit(0)) + F.coalesce(f"sent_{c}", F.lit(0))).alias(c) for c in names]
        return s.join(sent, ["page_id", "id"], "left").select("page_id", "id", "jump", *both)

    totals = _doubled(state, rise, [(c, F.col(c)) for c in names])
    return tree.join(totals.drop("jump"), ["page_id", "id"])


def numbered(tree: DataFrame) -> DataFrame:
    """tree with pre and post: the first and last place of its subtree in a walk from the roots, siblings by
    (sort_index, id), each page from 0. A node is below another if its pre lies between those two.

    A node's place is its parent's plus one plus the subtrees of the siblings before it: sizes come from the
    rollup, sibling sums from a running sum over ranges, and places from doubling."""
    sized = rollup(tree.select("page_id", "id", "parent_id", "sort_index"), []).select("page_id", "id", "parent_id", "sort_index", "subtree_nodes")
    ahead = running(in_order(sized, "page_id", "parent_id", "sort_index", "id"), F.col("subtree_nodes"), "upto", ("page_id", "parent_id"))
    start = F.col("upto") - F.col("subtree_nodes") + F.when(F.col("parent_id") == ROOT, 0).otherwise(1)
    placed = _doubled(scratch_table(_state(ahead, start.alias("pre"))), None, [("pre", F.col("pre") + F.col("up_pre"))])
    found = placed.select("page_id", "id", "pre").join(sized.select("page_id", "id", "subtree_nodes"), ["page_id", "id"])
    return tree.join(found.select("page_id", "id", "pre", (F.col("pre") + F.col("subtree_nodes") - 1).alias("post")), ["page_id", "id"])


def with_leaf_stats(tree: DataFrame, notes: DataFrame, sums: list[str]) -> DataFrame:
    """tree with n_notes (1 or 0) and the figures `sums` of each node's note (note_uid), zero without one."""
    figures = notes.select("note_uid", F.lit(1).cast("long").alias("n_notes"), *sums)
    return tree.join(figures, "note_uid", "left").fillna(0, ["n_notes", *sums])


def subtree_figures(tree: DataFrame, notes: DataFrame, colours: list[str], weights: dict[str, float]) -> DataFrame:
    """Each node with sums over itself and all below: notes, characters, highlighted ones, those of each
    colour, and from the sums the share highlighted and the salience. notes: note_uid, chars_total,
    chars_highlighted, chars_<colour>."""
    sums = ["chars_total", "chars_highlighted", *(f"chars_{c}" for c in colours)]
    out = rollup(with_leaf_stats(tree, notes, sums), ["n_notes", *sums])
    total, lit = F.col("subtree_chars_total"), F.col("subtree_chars_highlighted").cast("double")
    share = salience({c: F.col(f"subtree_chars_{c}") for c in colours}, total, weights)
    return out.withColumns({"subtree_highlight_ratio": ratio(lit, total), "subtree_salience": share})


def nested(tree: DataFrame, chosen: DataFrame, max_depth: int = 10) -> DataFrame:
    """(page_id, top, id, below): the nodes at or under each of chosen (page_id, id) to max_depth levels,
    with how many levels they lie below it."""
    # Only the nearest max_depth + 1 places of a path can be asked for.
    near = F.slice("id_path", F.greatest(F.size("id_path") - max_depth, F.lit(1)), max_depth + 1)
    spread = tree.select("page_id", "id", F.posexplode(F.reverse(near)).alias("below", "top"))
    want = chosen.select(F.col("page_id").alias("__page"), F.col("id").alias("__top")).distinct()
    found = spread.join(want, (F.col("page_id") == F.col("__page")) & (F.col("top") == F.col("__top")), "left_semi")
    return found.select("page_id", "top", "id", "below")


def subtree(tree: DataFrame, chosen: DataFrame) -> DataFrame:
    """Nodes at or below chosen (page_id, id). A node looks 1, 2, 4, ... levels up for what its ancestors have
    found, so n rows meet a round, however deep the tree."""
    want = chosen.select("page_id", "id", F.lit(True).alias("below")).distinct()
    state = scratch_table(_state(tree).join(want, ["page_id", "id"], "left").withColumn("below", F.coalesce("below", F.lit(False))))
    out = _doubled(state, None, [("below", F.col("below") | F.col("up_below"))])
    return tree.join(out.where("below").select("page_id", "id"), ["page_id", "id"], "left_semi")


def breadcrumbs(tree: DataFrame, width: int = 40) -> DataFrame:
    """(page_id, id, crumbs): captions from the root, each cut at width."""
    found = paths(tree, {"names": F.substring("caption", 1, width)})
    return found.select("page_id", "id", F.array_join("names", " > ").alias("crumbs"))


def children(nodes: DataFrame, page_id: int, parent_id: int = ROOT) -> DataFrame:
    return nodes.where((F.col("page_id") == page_id) & (F.col("parent_id") == parent_id)).orderBy("sort_index", "id")


def reindexed(nodes: DataFrame) -> DataFrame:
    """Siblings numbered 0..n-1 in their order, over ranges: a parent's children may lie in many tasks."""
    placed = place_in_group(nodes, ("page_id", "parent_id"), "sort_index", "id", name="__place")
    return placed.withColumn("sort_index", F.col("__place") - 1).drop("__place")


def nested_children(tree: DataFrame) -> DataFrame:
    """(page_id, parent_id, children): the children of each node in id order, as structs for a JSON sink."""
    kid = F.struct("id", "caption", "depth")
    return tree.groupBy("page_id", "parent_id").agg(F.array_sort(F.collect_list(kid)).alias("children"))


def json_lines(tree: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(page_id, pre, line): the forest as nested JSON, a line a node, in the order of a walk; siblings as `numbered`
    has them. Lines of a page, joined, are its array of roots, each an object with the columns (by output name) and
    `children`, to any depth: a line first closes what the node before left open. So a page of any size is
    written by many tasks."""
    walked = numbered(tree).select("page_id", "pre", "depth", F.struct(*(F.col(c).alias(n) for n, c in columns.items())).alias("o"))
    order = previous(in_order(walked, "page_id", "pre"), "depth", "was")
    first = F.col("pre") == 0
    closed = F.when(first, F.lit("[")).otherwise(F.when(F.col("was") >= F.col("depth"), F.concat(F.repeat(F.lit("]}"), F.col("was") - F.col("depth") + 1), F.lit(","))).otherwise(""))
    own = F.to_json("o", {"ignoreNullFields": "false"})
    line = F.concat(closed, F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"children":['))
    ends = tree.groupBy("page_id").agg(F.count("*").alias("pre"))
    last = order.join(ends.select(F.col("page_id").alias("__page"), (F.col("pre") - 1).alias("__last")), (F.col("page_id") == F.col("__page")) & (F.col("pre") == F.col("__last")))
    closing = last.select("page_id", (F.col("pre") + 1).alias("pre"), F.concat(F.repeat(F.lit("]}"), F.col("depth") + 1), F.lit("]")).alias("line"))
    return order.select("page_id", "pre", line.alias("line")).unionByName(closing)


def top_tiles(tree: DataFrame, size: str, most: int = 27) -> DataFrame:
    """Per parent the `most` largest non-separator children, and the rest summed as `other`."""
    real = tree.where(~F.col("caption").rlike(r"^[=\-_x]{3,}\s*$"))
    label = F.when(F.col("n") <= most, F.col("id").cast("string")).otherwise("other")
    placed = place_in_group(real.select("page_id", "parent_id", "id", size), ("page_id", "parent_id"), F.desc(size), "id")
    return placed.groupBy("page_id", "parent_id", label.alias("tile")).agg(F.sum(size).alias("size"), F.count("*").alias("nodes"))


def branch_key(caption_path: Column, segments: int) -> Column:
    return F.array_join(F.slice(F.split(caption_path, " > "), 1, segments), " > ")


def is_separator_node(caption: Column) -> Column:
    return F.trim(caption).rlike(r"^[=\-_x]{3,}\s*$")


def is_marker_node(caption: Column) -> Column:
    return F.trim(F.coalesce(caption, F.lit(""))) == ""
