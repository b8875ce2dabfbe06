"""Rich text to formatted spans.

A regular expression cuts the source into tokens (group marks, control words with parameter, escapes,
text); a small machine walks the tokens with a stack of formats. Run as an Arrow UDF, since inflating
and a stack of groups have no built-in form.
"""

import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.constants import NEAR_COLOUR, RGB_CODES

SPANS = T.ArrayType(
    T.StructType([T.StructField("text", T.StringType()), T.StructField("highlight", T.StringType()), T.StructField("bold", T.BooleanType()), T.StructField("italic", T.BooleanType())])
)

_UNICODE = r"\\u-?\d++\?"
_TEXT = r"(?:[^{}\\\r\n]++|" + _UNICODE + ")"
#: A group of nothing but formats and characters, as most spans are; characters may be \uN?.
_RUN = r"\{((?=\\)(?:\\highlight\d++)?(?:\\b)?(?:\\i)?) (" + _TEXT + r"*+)\}"
#: Such groups where no escape reaches into them: what lies between is whole tokens.
_RUNS = re.compile(r"(?<!\\)(?<!\\')(?<!\\'[\s\S])" + _RUN)
_TOKEN = re.compile(
    r"(?P<open>\{)|(?P<close>\})|(?P<text>" + _TEXT + r"++)|\\(?P<word>[^\W\d_]+)(?P<num>-?\d*) ?|\\'(?P<hex>[\s\S]{2})|\\(?P<sym>[\s\S])|(?P<eol>[\r\n]+)"
)
_CHARACTERS = re.compile(_UNICODE + r"|[^\\]+")
_COLOUR = re.compile(r"\\(red|green|blue)(\d+)")
# Destinations that hold no text of the note.
_HIDDEN_GROUPS = ("fonttbl", "colortbl", "stylesheet", "pict", "shp", "nonshppict", "object", "objdata")
_HIDDEN_WORDS = {"pict", "shp", "shprslt", "nonshppict", "blipuid", "pngblip", "jpegblip", "emfblip", "wmetafile", "shpinst", "shpgrp", "object", "objdata", "picprop"}
_COLOURS = {code: rgb for rgb, code in reversed(RGB_CODES.items()) if code}
_SYMBOLS = {"\\": "\\", "{": "{", "}": "}", "~": "\u00a0", "_": "\u2011", "\n": "\n", "\r": "\n"}


class Format(NamedTuple):
    highlight: str | None = None
    bold: bool = False
    italic: bool = False


#: A span: text, highlight, bold, italic.
Span = tuple[str | None, str | None, bool | None, bool | None]


def inflate(blob: bytes | None) -> str:
    """zlib or raw bytes as text: UTF-8, else cp1252, else latin-1."""
    if blob is None:
        return ""
    try:
        blob = zlib.decompress(blob)
    except zlib.error:
        pass
    for charset in ("utf-8", "cp1252"):
        try:
            return blob.decode(charset)
        except UnicodeDecodeError:
            continue
    return blob.decode("latin-1")


def nearest_code(rgb: tuple[int, int, int]) -> str | None:
    """The code of a colour: exact, else of the nearest known one if near; black and white have none."""
    if rgb in RGB_CODES:
        return RGB_CODES[rgb]
    if rgb in ((0, 0, 0), (255, 255, 255)):
        return None
    distance, code = min(((sum((a - b) ** 2 for a, b in zip(rgb, known, strict=True)), c) for known, c in RGB_CODES.items() if c), key=lambda x: x[0])
    return code if distance < NEAR_COLOUR else None


def colour_table(source: str) -> list[tuple[int, int, int] | None]:
    """Entries of the first colour table; the automatic colour is None."""
    at = source.find("{\\colortbl")
    if at < 0:
        return []
    body = source[at + len("{\\colortbl") : source.find("}", at)]
    out = []
    for entry in body.split(";")[:-1]:
        parts = {k: int(v) for k, v in _COLOUR.findall(entry)}
        out.append((parts.get("red", 0), parts.get("green", 0), parts.get("blue", 0)) if parts else None)
    return out


class _Reader:
    def __init__(self, source: str) -> None:
        self.colours = colour_table(source)
        self.texts: list[str] = []  # of the spans
        self.formats: list[Format] = []
        self.text: list[str] = []
        self.format, self.stack = Format(), []
        self.marked: dict[tuple[str, Format], Format] = {}
        self.high = 0
        self.skip, self.fallback = 0, 1
        self.depth, self.hidden = 0, 0

    def turn(self, new: Format) -> None:
        if new != self.format:
            self.flush()
            self.format = new

    def flush(self) -> None:
        text = "".join(self.text)
        self.text = []
        if text:
            self.texts.append(_clean(text))
            self.formats.append(self.format)

    def colour(self, index: int | None) -> str | None:
        rgb = self.colours[index] if index and 0 < index < len(self.colours) else None
        return nearest_code(rgb) if rgb else None

    def highlight(self, index: int | None) -> None:
        self.turn(Format(self.colour(index), self.format.bold, self.format.italic))

    def run(self, marks: str, piece: str) -> None:
        """A group of format words and characters."""
        before = self.format
        new = self.marked.get((marks, before))
        if new is None:
            _, *words = marks.split("\\")
            colour = self.colour(int(words[0].removeprefix("highlight"))) if words[0][0] == "h" else before.highlight
            new = self.marked[marks, before] = Format(colour, before.bold or "b" in words, before.italic or "i" in words)
        known = self.known(piece) if "\\" in piece else piece
        if new == before or self.skip or known is None:
            self.turn(new)
            self.plain(piece)
            self.turn(before)
            return
        if self.text:
            self.flush()
        if known:
            self.texts.append(_clean(known))
            self.formats.append(new)

    def tokens(self, source: str) -> None:
        for m in _TOKEN.finditer(source):
            kind = m.lastgroup if m.lastgroup != "num" else "word"
            if kind == "text":
                if not self.hidden:
                    self.plain(m[0])
            elif kind == "open":
                self.depth += 1
                if not self.hidden:
                    ahead = source[m.end() : m.end() + 40].lstrip("\r\n\t ")
                    if ahead.startswith("\\*\\") or ahead.startswith(tuple("\\" + g for g in _HIDDEN_GROUPS)):
                        self.hidden = self.depth
                    else:
                        self.stack.append(self.format)
            elif kind == "close":
                self.depth -= 1
                if self.hidden:
                    self.hidden = 0 if self.depth < self.hidden else self.hidden
                elif self.stack:
                    self.turn(self.stack.pop())
            elif self.hidden or kind == "eol":
                continue
            elif kind == "word":
                if m["word"] in _HIDDEN_WORDS:
                    self.hidden = self.depth
                else:
                    self.word(m["word"], int(m["num"]) if m["num"] not in ("", "-") else None)
            elif kind == "hex":
                try:
                    self.text.append(bytes([int(m["hex"], 16)]).decode("cp1252", "replace"))
                except ValueError:
                    pass
            elif m["sym"] in _SYMBOLS:
                self.text.append(_SYMBOLS[m["sym"]])

    def unicode(self, code: int) -> None:
        code %= 65536
        if 0xD800 <= code < 0xDC00:
            self.high = code
        elif 0xDC00 <= code < 0xE000:
            self.text.append(chr(0x10000 + ((self.high - 0xD800) << 10) + code - 0xDC00) if self.high else "\ufffd")
            self.high = 0
        else:
            self.text.append(("\ufffd" if self.high else "") + chr(code))
            self.high = 0
        self.skip = self.fallback

    def word(self, word: str, number: int | None) -> None:
        form = self.format
        if word in ("par", "line"):
            self.text.append("\n")
        elif word == "tab":
            self.text.append("\t")
        elif word == "b":
            self.turn(Format(form.highlight, number != 0, form.italic))
        elif word == "i":
            self.turn(Format(form.highlight, form.bold, number != 0))
        elif word in ("highlight", "cb"):
            self.highlight(number)
        elif word == "plain":
            self.turn(Format())
        elif word == "u" and number is not None:
            self.unicode(number)
        elif word == "u":
            self.skip = self.fallback
        elif word == "uc":
            self.fallback = 1 if number is None else number

    def plain(self, text: str) -> None:
        """Characters, some perhaps as \\uN?."""
        known = self.known(text) if "\\" in text else text
        if self.skip or known is None:
            self.slowly(text)
        else:
            self.text.append(known)

    def known(self, text: str) -> str | None:
        """text with the characters of its \\uN?; None where what came before or halves of pairs matter."""
        if self.skip or self.high or self.fallback != 1:
            return None
        try:
            return "".join([_KNOWN[p] if p[0] == "\\" else p for p in _CHARACTERS.findall(text)])
        except TypeError:
            return None

    def slowly(self, text: str) -> None:
        for part in _CHARACTERS.findall(text):
            if part[0] == "\\":
                self.unicode(int(part[2:-1]))
                part = "?"
            cut = min(self.skip, len(part))
            self.skip -= cut
            self.text.append(part[cut:])


class _Characters(dict):
    """Characters of \\uN?, None for halves of pairs."""

    def __missing__(self, escape: str) -> str | None:
        code = int(escape[2:-1]) % 65536
        self[escape] = out = None if 0xD800 <= code < 0xE000 else chr(code)
        return out


_KNOWN = _Characters()


def _clean(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "surrogatepass").decode("utf-8", "replace")


def rtf_spans(source: str | None) -> list[dict]:
    """Formatted spans of rich text; anything else is one plain span."""
    return [dict(zip(_FIELDS, (text, *form), strict=True)) for text, form in zip(*_read(source), strict=True)]


def _read(source: str | None) -> tuple[list[str], list[Format]]:
    """The texts of the spans, and their formats."""
    source = source or ""
    if not source.strip().startswith("{\\rtf"):
        return ([source], [Format()]) if source else ([], [])
    reader, parts = _Reader(source), _RUNS.split(source)
    for between, marks, piece in zip(parts[::3], parts[1::3], parts[2::3], strict=False):
        if between:
            reader.tokens(between)
        if not reader.hidden:
            reader.run(marks, piece)
    reader.tokens(parts[-1])
    reader.flush()
    return reader.texts, reader.formats


_SPAN = pa.struct([("text", pa.string()), ("highlight", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_())])
_FIELDS = [f.name for f in _SPAN]
#: Contents of a batch that are Python objects at a time; their spans take many times the room of their text.
CHUNK_ROWS = 16


def _chunked(function: Callable[..., pa.Array], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """What function makes of CHUNK_ROWS rows at a time."""
    done = [function(*(c.slice(at, CHUNK_ROWS) for c in columns)) for at in range(0, len(columns[0]), CHUNK_ROWS)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def _each(function: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """function of each row."""
    return _chunked(lambda *parts: pa.array([function(*row) for row in zip(*(p.to_pylist() for p in parts), strict=True)], kind), kind, *columns)


def _each_read(source: Callable[..., str | None], contents: pa.Array) -> pa.Array:
    """The spans of what source makes of each row."""

    def read(part: pa.Array) -> pa.Array:
        texts, formats, ends = [], [], [0]
        for content in part.to_pylist():
            more, forms = _read(source(content))
            texts += more
            formats += forms
            ends.append(len(texts))
        known = {f: k for k, f in enumerate(dict.fromkeys(formats))}
        at = pa.array([known[f] for f in formats], pa.int32())
        columns = [pa.array(texts, pa.string()), *(pa.array([f[k] for f in known], _SPAN[k + 1].type).take(at) for k in range(3))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_SPAN)))

    return _chunked(read, pa.list_(_SPAN), contents)


def _each_written(lists: pa.Array) -> pa.Array:
    """The rich text of each row's spans."""

    def write(part: pa.Array) -> pa.Array:
        text, color, bold, italic = (pc.struct_field(part.flatten(), name) for name in _FIELDS)
        sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy()
        row = np.repeat(np.arange(len(part)), sizes)
        coded = color.dictionary_encode()
        codes = coded.dictionary.to_pylist()
        code = pc.fill_null(coded.indices, -1).to_numpy()
        held = np.zeros((len(part), len(codes) + 1), bool)
        held[row, code] = True
        tables = [sorted(c for c, there in zip(codes, line, strict=False) if there and c) for line in held.tolist()]
        number = np.array([[t.index(c) + 1 if c in t else 0 for c in [*codes, None]] for t in tables], int).reshape(held.shape)[row, code]
        mark = number * 4 + pc.fill_null(bold, False).to_numpy(zero_copy_only=False) * 2 + pc.fill_null(italic, False).to_numpy(zero_copy_only=False)
        words = [_marks(k // 4, k & 2, k & 1) for k in range(4 * len(codes) + 4)]
        first, last = (pa.array(x).take(pa.array(mark)) for x in ([f"{{{w} " if w else "" for w in words], ["}" if w else "" for w in words]))
        text = pc.fill_null(text, "")
        special = pc.match_substring_regex(text, _SPECIAL.pattern)
        text = pc.replace_with_mask(text, special, pa.array(_all_escaped(text.filter(special).to_pylist()), pa.string()))
        pieces = pc.binary_join_element_wise(first, text, last, "")
        bodies = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pieces), "")
        return pc.binary_join_element_wise(pa.array([_head(t) for t in tables], pa.string()), bodies, "}", "")

    return _chunked(write, pa.string(), lists)


@F.arrow_udf(SPANS)
def spans_of_blob(blobs: pa.Array) -> pa.Array:
    """Spans of packed or raw note contents."""
    return _each_read(inflate, blobs)


@F.arrow_udf(T.StringType())
def cp1252_text(blobs: pa.Array) -> pa.Array:
    """Bytes of a rich-text file as text."""
    return _each(lambda b: None if b is None else b.decode("cp1252", "replace"), pa.string(), blobs)


def _packed(text: str, way: int) -> bytes:
    raw = text.encode()
    if way == 1:
        return raw
    if way == 2:
        try:
            other = text.encode("cp1252")
            other.decode()
        except UnicodeDecodeError:
            raw = other
        except UnicodeEncodeError:
            pass
    return zlib.compress(raw)


@F.arrow_udf(T.BinaryType())
def packed(texts: pa.Array, ways: pa.Array) -> pa.Array:
    """Texts as note contents: 0 zlib over UTF-8, 1 bare UTF-8, 2 zlib over cp1252 where that can spell
    them and is no valid UTF-8 (else as 0)."""
    return _each(lambda t, w: _packed(t or "", w), pa.binary(), texts, ways)


@F.arrow_udf(T.StringType())
def inflate_text(blobs: pa.Array) -> pa.Array:
    """Packed or raw note contents as text."""
    return _each(inflate, pa.string(), blobs)


@F.arrow_udf(SPANS)
def spans_of_text(texts: pa.Array) -> pa.Array:
    """Spans of rich text already decoded."""
    return _each_read(lambda t: t, texts)


@F.arrow_udf(T.StringType())
def rtf_of_text(texts: pa.Array) -> pa.Array:
    """Plain texts as rich-text documents."""
    return _each(lambda t: to_rtf(t or ""), pa.string(), texts)


@F.arrow_udf(T.StringType())
def rtf_of_spans(spans: pa.Array) -> pa.Array:
    """Formatted spans as rich-text documents."""
    return _each_written(spans)


#: Behind note_uid: the spans of a format, by their places among all spans of the note.
COLOURED = "color string, bold boolean, places array<int>, texts array<string>"


def coloured_rewritten(notes: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of notes (note_uid, spans) written as rich text and read back; of each note a row for each colour and
    boldness (COLOURED)."""
    for batch in notes:
        yield _by_format(batch.column("note_uid"), _each_read(lambda t: t, _each_written(batch.column("spans"))))


def _by_format(notes: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
    text, color, bold, _ = (pc.struct_field(lists.flatten(), name) for name in _FIELDS)
    row = pc.list_parent_indices(lists).to_numpy()
    place = np.arange(len(row)) - lists.offsets.to_numpy()[row]
    coded = color.dictionary_encode()
    code = pc.fill_null(coded.indices, -1).to_numpy()
    key = (row * len(coded.dictionary) + code) * 2 + bold.to_numpy(zero_copy_only=False)
    lit = np.flatnonzero(code >= 0)
    order = lit[np.argsort(key[lit], kind="stable")]
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    first = order[starts]
    groups = pa.array(np.append(starts, len(order)), pa.int32())
    columns = [notes.take(pa.array(row[first])), color.take(pa.array(first)), bold.take(pa.array(first))]
    columns += [pa.ListArray.from_arrays(groups, pa.array(place[order], pa.int32())), pa.ListArray.from_arrays(groups, text.take(pa.array(order)))]
    return pa.RecordBatch.from_arrays(columns, names=["note_uid", "color", "bold", "places", "texts"])


#: What does not stand for itself in rich text.
_SPECIAL = re.compile(r"[\\{}\n\t\r]|[^\x00-\x7f]")


class _Escapes(dict):
    def __missing__(self, ch: str) -> str:
        units = ch.encode("utf-16-le", "surrogatepass")
        self[ch] = out = "".join(f"\\u{int.from_bytes(units[k : k + 2], 'little', signed=True)}?" for k in range(0, len(units), 2))
        return out


_ESCAPES = _Escapes({"\\": "\\\\", "{": "\\{", "}": "\\}", "\n": "\\par\n", "\t": "\\tab ", "\r": "\\'0d"})


def _escaped(text: str) -> str:
    return _SPECIAL.sub(lambda m: _ESCAPES[m[0]], text)


def _all_escaped(texts: list[str]) -> list[str]:
    """_escaped of each, in one walk if no text has what joins them."""
    joined = "\0".join(texts)
    return _escaped(joined).split("\0") if joined.count("\0") == len(texts) - 1 else [_escaped(t) for t in texts]


def to_rtf(text: str) -> str:
    """Plain text as a small rich-text document."""
    return "{\\rtf1\\ansi\\deff0 " + _escaped(text) + "}"


def _marks(number: int | None, bold: bool | None, italic: bool | None) -> str:
    return (f"\\highlight{number}" if number else "") + ("\\b" if bold else "") + ("\\i" if italic else "")


def _group(text: str, number: int | None, bold: bool, italic: bool) -> str:
    words = _marks(number, bold, italic)
    return f"{{{words} {_escaped(text)}}}" if words else _escaped(text)


def _head(codes: list[str]) -> str:
    """The start of a document with a table of the colours of codes."""
    return "{\\rtf1\\ansi\\deff0{\\colortbl" + "".join(";\\red{}\\green{}\\blue{}".format(*_COLOURS[c]) for c in codes) + ";}"


def rich_rtf(spans: list[Span]) -> str:
    """Formatted spans (text, colour code, bold, italic) as a rich-text document with their colours in its table."""
    codes = sorted({c for _, c, _, _ in spans if c})
    place = {c: k for k, c in enumerate(codes, 1)}
    body = "".join(_group(t or "", place.get(c), bool(b), bool(i)) for t, c, b, i in spans)
    return _head(codes) + body + "}"


def with_text(source: str, text: str, code: str | None = None, bold: bool = False) -> str:
    """Rich text with a formatted piece behind it; the colour joins the table if it is not there yet."""
    number = None
    if code:
        rgb = next(rgb for rgb, known in RGB_CODES.items() if known == code)
        table = colour_table(source)
        if rgb in table:
            number = table.index(rgb)
        else:
            entry, at = "\\red{}\\green{}\\blue{};".format(*rgb), source.find("{\\colortbl")
            if at < 0:
                at = source.index("}") if "{" not in source[1:] else source.index("{", 1)
                head = source.find(" ")
                at = head if 0 < head < at else at
                rest = source[at + 1 :] if source[at] == " " else source[at:]  # a blank closes a control word
                source, number = source[:at] + "{\\colortbl;" + entry + "}" + rest, 1
            else:
                end = source.index("}", at)
                gap = "" if source[end - 1] == ";" else ";"
                number = len(table) + (gap == ";")
                source = source[:end] + gap + entry + source[end:]
    piece = _group(text, number, bold, False)
    return source[:-1] + piece + "}" if source.endswith("}") else source + piece
