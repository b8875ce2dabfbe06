"""From an archive's own tables to the notes that units are made of: decoded, with their place in the tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.columns import from_delphi
from quillspark.operators.archive import semantic_colour
from quillspark.operators.tree import hierarchy, with_paths
from quillspark.operators.units import knowledge_units
from quillspark.sources.archive import decoded_notes

FALLBACK_CHARS = 50


def note_paths(nodes: DataFrame, notes: DataFrame) -> DataFrame:
    """(note_uid, tree_path): the caption path of a note's node (the last by page and id where it has
    several), else the first characters of its caption."""
    tree = with_paths(hierarchy(nodes)).where(F.col("note_uid").isNotNull())
    paths = tree.groupBy("note_uid").agg(F.max_by("caption_path", F.struct("page_id", "id")).alias("path"))
    cut = F.substring(F.coalesce("caption", F.lit("")), 1, FALLBACK_CHARS)
    return notes.select(F.col("uid").alias("note_uid"), cut.alias("cut")).join(paths, "note_uid", "left").select("note_uid", F.coalesce("path", "cut").alias("tree_path"))


def placed_notes(tables: dict[str, DataFrame]) -> DataFrame:
    """Notes as knowledge_units wants them, from the tables pages, notes, contents and treenodes (with captions)."""
    decoded = decoded_notes(tables).select(
        F.col("uid").alias("note_uid"), "page_id", "caption", semantic_colour(F.col("bg_color")).alias("node_color"), from_delphi(F.col("date_created")).alias("date_created"), "spans"
    )
    return decoded.join(note_paths(tables["treenodes"], tables["notes"]), "note_uid")


def build_units(tables: dict[str, DataFrame], as_of=None) -> DataFrame:
    """The corpus of an archive, end to end."""
    return knowledge_units(placed_notes(tables), as_of)

