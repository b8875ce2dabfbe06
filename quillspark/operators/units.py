"""From rich-text notes to line units: shredding, colours, section state, weights, duplicates.

A note is one row with its spans, so its lines follow from one walk over them, note by note and without
a shuffle. The walk carries a state (line, section colour and its run, a waiting break) that no built-in
function expresses over an array without copying the array at each step; it is an Arrow function.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.columns import WHITE, age_days, colour_weight, effective_weight, is_separator, is_trivial, normalise, strip
from quillspark.functions.constants import NODE_BONUS
from quillspark.sources.storage import bounded_batches, scratch_table, small

UNIT_STEP = 1 << 20  # lines a note can have
INNER_CHARS = 100
#: What a task holds of a batch as Python objects at a time: spans and lines, and the lines' characters.
CHUNK_ROWS, CHUNK_CHARS = 8192, 1 << 21
TOKENS = {"[BR2]": "block_start", "[BR3]": "section_start"}
_INNER = pa.list_(pa.struct([("text", pa.string()), ("color", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_LINES = pa.schema(
    [("line_index", pa.int32()), ("text", pa.string()), ("color", pa.string()), ("is_bold", pa.bool_()), ("inner_highlights", _INNER), ("section_color", pa.string()), ("break_context", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64())]
)
_LINES_DDL = "line_index int, text string, color string, is_bold boolean, inner_highlights array<struct<text:string,color:string,start:long,end:long>>, section_color string, break_context string, char_start long, char_end long"


def unit_id(note_uid: Column, line_index: Column) -> Column:
    """An id in insertion order within a page (note, caption first, lines), without a global sort."""
    return note_uid * UNIT_STEP + line_index + 1


def note_lines(spans: Iterable[tuple[str | None, str | None, bool | None]]) -> Iterator[tuple]:
    """The lines with text of one note's spans (text, colour, bold), as rows of _LINES.

    A line's colour is the one with most stripped characters, the first seen on a tie; it is bold if
    over half of them are. The section colour runs on: more of the same colour adds to its run, another
    takes over if there is none yet or its part is longer than the run so far, and [BR3] ends it. A
    break token counts for the next line with text."""
    line, at, section, run, waiting = 0, 0, None, 0, None
    parts: list[tuple[str, str | None, bool]] = []
    begin, state = 0, None
    context = "mid_block"

    def closed() -> Iterator[tuple]:
        n = {k: len(t.strip(WHITE)) for k, (t, _, _) in enumerate(parts)}
        chars = sum(n.values())
        if not chars:
            return
        by_colour: dict[str, int] = {}
        for k, (_, color, _) in enumerate(parts):
            if color is not None and n[k]:
                by_colour[color] = by_colour.get(color, 0) + n[k]
        best = max(by_colour, key=by_colour.__getitem__, default=None)
        inner, to = [], 0
        for k, (text, color, _) in enumerate(parts):
            if n[k] and color is not None and color != best:
                inner.append({"text": text.strip(WHITE)[:INNER_CHARS], "color": color, "start": to, "end": to + n[k]})
            to += len(text)
        bold = sum(n[k] for k, (_, _, b) in enumerate(parts) if b)
        yield line, "".join(t for t, _, _ in parts).strip(WHITE), best, 2 * bold > chars, inner, state, context, begin, end

    end = 0
    for whole, color, bold in spans:
        for k, text in enumerate((whole or "").split("\n")):
            if k:
                if parts:
                    yield from closed()
                    parts, context = [], "mid_block"
                line, at = line + 1, at + 1
            token = text.strip(WHITE)
            if token in TOKENS:
                waiting = TOKENS[token]
                if token == "[BR3]":
                    section, run = None, 0
            elif text:
                if color is not None and color == section:
                    run += len(text)
                elif color is not None and (section is None or len(text) > run):
                    section, run = color, len(text)
                if not parts:
                    begin = at
                if waiting:
                    context, waiting = waiting, None
                parts.append((text, color, bool(bold)))
                state, end = section, at + len(text)
            at += len(text)
    if parts:
        yield from closed()


def _line_batches(notes: pa.RecordBatch, sizes: list[int], spans: pa.StructArray, rows: int = CHUNK_ROWS, chars: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches of the lines of notes, each with its note's columns. sizes: how many of the spans each note has. At
    most `rows` spans and lines, and lines of about `chars` characters, are Python objects at a time."""

    def unpacked() -> Iterator[tuple]:
        for at in range(0, len(spans), rows):
            part = spans.slice(at, rows)
            yield from zip(*(pc.struct_field(part, k).to_pylist() for k in range(3)), strict=True)

    def packed() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * len(_LINES)
        kept = notes.take(pa.array(source, pa.int64())).columns
        return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, f.type) for c, f in zip(columns, _LINES, strict=True))], names=[*notes.schema.names, *_LINES.names])

    stream, source, out, held = unpacked(), [], [], 0
    for row, n in enumerate(sizes):
        for line in note_lines(islice(stream, n)):
            source.append(row)
            out.append(line)
            held += len(line[1])
            if len(out) == rows or held >= chars:
                yield packed()
                source, out, held = [], [], 0
    yield packed()


def content_units(notes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per line with text: text, color, is_bold, inner_highlights, section_color, break_context,
    char_start, char_end, line_index, for each note_uid; further columns of notes in `keep` come along."""
    names = ("note_uid", *keep)
    flat = notes.select(*names, F.transform("spans", lambda s: F.struct(s["text"].alias("text"), s["highlight"].alias("highlight"), s["bold"].alias("bold"))).alias("__spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
            yield from _line_batches(batch.select(list(names)), sizes, lists.flatten())

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.select(*names).schema)
    bounded_batches(notes.sparkSession)
    return flat.mapInArrow(run, f"{schema}, {_LINES_DDL}")


def caption_units(notes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One unit per note whose caption has text and is no separator line; color is the node's."""
    caption = strip(F.col("caption"))
    color = F.col("node_color")
    good = notes.where(F.col("caption").isNotNull() & (caption != "") & ~is_separator(caption))
    return good.select(
        "note_uid",
        *keep,
        F.lit(-1).alias("line_index"),
        caption.alias("text"),
        color.alias("color"),
        F.lit(False).alias("is_bold"),
        F.array().cast("array<struct<text:string,color:string,start:long,end:long>>").alias("inner_highlights"),
        F.lit(None).cast("string").alias("section_color"),
        F.lit("caption").alias("break_context"),
        F.lit(0).cast("long").alias("char_start"),
        F.length(caption).cast("long").alias("char_end"),
    )


NOTE_COLUMNS = ("page_id", "caption", "tree_path", "date_created")


def knowledge_units(notes: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Caption and content units of notes (note_uid, page_id, caption, node_color, tree_path,
    date_created, spans), weighted, flagged and with exact duplicates per page marked. With as_of
    they also have note_age_days. The units are written once to the shared folder and read back, so
    that what counts them reads the columns it needs."""
    content = content_units(notes, NOTE_COLUMNS).withColumn("source_type", F.lit("content"))
    captions = caption_units(notes, NOTE_COLUMNS).withColumn("source_type", F.lit("treenode"))
    units = captions.unionByName(content)
    weight = colour_weight(F.col("color"))
    marked = F.when(F.col("source_type") == "treenode", effective_weight(F.col("color"), F.lit(True), NODE_BONUS)).otherwise(effective_weight(F.col("color"), F.col("is_bold")))
    units = units.select(
        unit_id(F.col("note_uid"), F.col("line_index")).alias("unit_id"),
        "*",
        normalise(F.col("text")).alias("text_normalized"),
        weight.alias("weight"),
        marked.alias("effective_weight"),
        is_separator(F.col("text")).alias("is_separator"),
        is_trivial(F.col("text"), F.col("color")).alias("is_trivial"),
    )
    if as_of is not None:
        units = units.withColumn("note_age_days", age_days(F.col("date_created"), as_of))
    return mark_duplicates(scratch_table(units))


def mark_duplicates(units: DataFrame) -> DataFrame:
    """is_duplicate: a clean unit with a smaller id on the page has the same normalised text.

    units: a stored table, as it is read twice. The least id per (page, text) is combined before the
    shuffle and only texts that occur again are joined back, so a line on a third of all notes is one
    row; no group is gathered."""
    clean = ~F.col("is_trivial") & ~F.col("is_separator")
    first = units.where(clean).groupBy("page_id", "text_normalized").agg(F.min("unit_id").alias("__first"), F.count("*").alias("__n"))
    again = small(scratch_table(first.where("__n > 1").select(F.col("page_id").alias("__page"), F.col("text_normalized").alias("__text"), "__first")))
    out = units.join(again, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("text_normalized") == F.col("__text")), "left")
    return out.withColumn("is_duplicate", F.coalesce(clean & (F.col("unit_id") > F.col("__first")), F.lit(False))).drop("__page", "__text", "__first")


def retrievable(pages: tuple[int, ...] = ()) -> Column:
    """The one predicate of what may be retrieved; no pages means all pages."""
    good = ~F.col("is_trivial") & ~F.col("is_separator") & ~F.col("is_duplicate") & (F.length(F.trim("text")) > 12)
    return good & F.col("page_id").isin(*pages) if pages else good


def colour_filter(codes: tuple[str, ...]) -> Column:
    """Real codes, or n (no colour), or nb (bold without colour) where n is not asked for."""
    real = [c for c in codes if c not in ("n", "nb")]
    out = F.col("color").isin(*real) if real else F.lit(False)
    out = F.coalesce(out, F.lit(False))
    if "n" in codes:
        return out | F.col("color").isNull()
    return out | (F.col("color").isNull() & F.col("is_bold")) if "nb" in codes else out


def is_label(text: Column) -> Column:
    """A short organisational label: under 15 characters and no sentence mark."""
    stripped = strip(text)
    return (F.length(stripped) < 15) & ~stripped.rlike('[.!?"]')


def is_old_label(text: Column, source_type: Column) -> Column:
    """The older exporter's rule: captions under 50 characters without full stop or quote as well."""
    caption = (source_type == "treenode") & (F.length(strip(text)) < 50) & ~strip(text).rlike('[."]')
    return is_label(text) | caption
