"""Column helpers with the archive's text, weight and vector semantics."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.constants import BOLD_BONUS, NEAR_COLOUR, RANK_WEIGHTS, RGB_CODES, TAGS, TOP_WEIGHT


#: White space in the Unicode sense (NBSP counts).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


#: The same as a class of a regular expression: told in full it is far quicker than (?U)\\s.
SPACE = r"[\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

#: What SQL engines on RE2 (DuckDB) take for \\s: no vertical tab, nothing beyond ASCII.
SQL_SPACE = r"[\t\n\f\r ]"


def strip(text: Column) -> Column:
    """Both ends without white space."""
    return F.trim(text, F.lit(WHITE))


def normalise(text: Column) -> Column:
    return strip(F.regexp_replace(F.lower(text), f"{SPACE}+", " "))


def is_separator(text: Column) -> Column:
    stripped = strip(text)
    return stripped.rlike(f"^[{SPACE[1:-1]}=\\-_x*#~]{{3,}}$") | stripped.rlike(r"^\[BR[23]\]$")


def is_trivial(text: Column, color: Column) -> Column:
    stripped = strip(text)
    return (F.length(stripped) == 0) | (color.isNull() & (F.length(stripped) <= 4))


def lookup(values: dict, key: Column, default: object = None) -> Column:
    """A small fixed mapping as an expression; null keys and others give the default."""
    out = F.lit(default)
    for k, v in reversed(list(values.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def colour_weight(color: Column) -> Column:
    return lookup(RANK_WEIGHTS, color, 0.0)


def effective_weight(color: Column, bold: Column, bonus: float = BOLD_BONUS) -> Column:
    """Ranking weight: the bonus needs a colour and the mark."""
    base = colour_weight(color)
    return F.when((base > 0) & bold, base + bonus).otherwise(base)


def tag(color: Column, bold: Column) -> Column:
    """[BLU*] style tag; empty without a colour."""
    name = lookup(TAGS, color)
    return F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("["), name, F.when(bold, "*").otherwise(""), F.lit("]")))


def share_of_top(weight: Column) -> Column:
    return F.least(F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0)), F.lit(TOP_WEIGHT)) / F.lit(TOP_WEIGHT)


def dot(vector: Column, query: Sequence[float]) -> Column:
    """Dot product with a literal vector, in double."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    """Euclidean length; 1 for a zero vector, so that dividing leaves zeros."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(length > 0, length).otherwise(1.0)


def vector_of_blob(blob: Column) -> Column:
    """Vectors stored as bytes, four a place (float32, lowest byte first); null for null and for a length that is
    no multiple of four."""

    @F.pandas_udf("array<float>")
    def read(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(bytes(b), "<f4"))

    return read(blob)


def blob_of_vector(vector: Column) -> Column:
    """The bytes of vectors as vector_of_blob reads them."""

    @F.pandas_udf("binary")
    def write(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return write(vector)


def nearest_colour(red: Column, green: Column, blue: Column) -> Column:
    """The code of an RGB colour: exact, else of the nearest known one if near; black and white have none."""
    known = [(k, rgb, code) for k, (rgb, code) in enumerate(RGB_CODES.items())]

    def far(rgb: tuple[int, int, int]) -> Column:
        return sum(((c - v) * (c - v) for c, v in zip((red, green, blue), rgb, strict=True)), F.lit(0))

    exact = F.lit(None).cast("string")
    for _, rgb, code in reversed(known):
        exact = F.when(far(rgb) == 0, F.lit(code).cast("string")).otherwise(exact)
    plain = F.least(*(far(rgb) for rgb in [(0, 0, 0), *(rgb for _, rgb, _ in known)])) == 0
    best = F.array_min(F.array(*(F.struct(far(rgb).alias("d"), F.lit(k).alias("k"), F.lit(code).alias("code")) for k, rgb, code in known if code)))
    return F.when(plain, exact).when(best["d"] < NEAR_COLOUR, best["code"])


def ratio(part: Column, whole: Column, default: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(default)


def salience(chars: dict[str, Column], total: Column, weights: dict[str, float]) -> Column:
    """Weighted share of highlighted characters in percent of the most possible, at most 100."""
    weighted = sum((chars[c] * w for c, w in weights.items() if c in chars), F.lit(0.0))
    return F.when(total > 0, F.least(weighted / (total * 5.0) * 100.0, F.lit(100.0))).otherwise(0.0)


def from_delphi(days: Column) -> Column:
    """Days since 1899-12-30 as a timestamp without zone; null or not positive gives null."""
    seconds = F.bround(days * 86400.0).cast("long")
    return F.when(days > 0, F.timestamp_add("SECOND", seconds, F.lit("1899-12-30 00:00:00").cast("timestamp_ntz")))


def age_days(date: Column, as_of: Column) -> Column:
    """Whole days from date to as_of, never negative."""
    return F.greatest(F.timestamp_diff("DAY", date, as_of), F.lit(0))


def word_count(text: Column, space: str = SPACE) -> Column:
    """Runs of what is no white space; space is its class of a regular expression."""
    return F.regexp_count(text, F.lit(f"[^{space[1:-1]}]+"))


def line_count(text: Column, empty: int = 0) -> Column:
    """Lines; empty is the count of an empty text."""
    return F.when(F.length(text) == 0, empty).otherwise(F.regexp_count(text, F.lit("\n")) + 1)


def query_terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9']{3,}"), F.lit(0))



def _marked_letters() -> tuple[str, str]:
    """Small Latin letters with one diacritic, and the letters below: full-text engines index both alike."""
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if c.islower()]
    pairs = [(c, d[0]) for c, d in pairs if len(d) == 2 and "a" <= d[0] <= "z"]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


_ACCENTED, _PLAIN = _marked_letters()


def fold(text: Column) -> Column:
    """Lower case without Latin diacritics."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def tokens(text: Column) -> Column:
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
