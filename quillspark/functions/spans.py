"""Columns over an array of formatted spans: statistics, break tokens, renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.columns import lookup, ratio, strip
from quillspark.functions.constants import COLOUR_CODES, TAGS

HIGH_SALIENCE = ("g", "b", "p", "u")


def plain_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: s["text"]), "")


def char_count(spans: Column, keep=lambda s: F.lit(True)) -> Column:
    """Stripped characters of the spans that keep() wants."""
    sizes = F.transform(F.filter(spans, keep), lambda s: F.length(strip(s["text"])))
    return F.aggregate(sizes, F.lit(0), lambda a, n: a + n)


def colour_chars(spans: Column) -> dict[str, Column]:
    return {c: char_count(spans, _is(c)) for c in COLOUR_CODES}


def _is(code: str):
    return lambda s: F.coalesce(s["highlight"] == code, F.lit(False))


def span_stats(spans: Column) -> Column:
    """chars_total, chars_highlighted, highlight_ratio and chars per colour."""
    total, lit = char_count(spans), char_count(spans, lambda s: s["highlight"].isNotNull())
    return F.struct(total.alias("chars_total"), lit.alias("chars_highlighted"), ratio(lit.cast("double"), total).alias("highlight_ratio"), *(n.alias(f"chars_{c}") for c, n in colour_chars(spans).items()))


def encode_breaks(text: Column) -> Column:
    """Rows of =, x and newlines as break tokens; later rules see what earlier ones wrote."""
    # What counts as a break, in order.
    for pattern, token in (("={10,}", "[BR3]"), ("={3,9}", "[BR2]"), ("x{3,}", "[BR2]"), (r"\n{5,}", "[BR3]"), (r"\n{3,4}", "[BR2]")):
        text = F.regexp_replace(text, pattern, f"\n{token}\n")
    return text


def count_breaks(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"={3,}|x{3,}|\n{4,}"))


def internal_format(spans: Column) -> Column:
    """Bracketed text: [code][B][I] around each span; pairs around white space alone go."""

    def one(s: Column) -> Column:
        code, bold, italic = s["highlight"], F.when(s["bold"], "B"), F.when(s["italic"], "I")
        tags = F.array_compact(F.array(code, bold, italic))
        opening = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("["), t, F.lit("]"))), "")
        closing = F.array_join(F.transform(F.reverse(tags), lambda t: F.concat(F.lit("[/"), t, F.lit("]"))), "")
        return F.concat(opening, encode_breaks(s["text"]), closing)

    return F.regexp_replace(F.array_join(F.transform(spans, one), ""), r"(?U)\[(\w+)\](\s*)\[/\1\]", "$2")


def highlights(spans: Column, codes: tuple[str, ...] = HIGH_SALIENCE, tags: bool = True) -> Column:
    """Spans of the given colours, one per line, in brackets if asked."""
    kept = F.filter(spans, lambda s: F.coalesce(s["highlight"].isin(*codes), F.lit(False)) & (strip(s["text"]) != ""))

    def line(s: Column) -> Column:
        text = strip(s["text"])
        return F.concat(F.lit("["), s["highlight"], F.lit("]"), text, F.lit("[/"), s["highlight"], F.lit("]")) if tags else text

    return F.array_join(F.transform(kept, line), "\n")


def _wanted(codes: tuple[str | None, ...], bold_only: bool):
    real = [c for c in codes if c is not None]

    def keep(s: Column) -> Column:
        out = F.coalesce(s["highlight"].isin(*real), F.lit(False)) if real else F.lit(False)
        out = out | s["highlight"].isNull() if None in codes else out
        return out & s["bold"] if bold_only else out

    return keep


def tidy(text: Column) -> Column:
    """Lines without trailing white space; at most one empty line between others."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[^\S\n]+(?=\n|\z)", ""), r"\n{3,}", "\n\n")


def render(spans: Column, codes: tuple[str | None, ...], fmt: str = "inline", bold_only: bool = False, keep_breaks: bool = True) -> Column:
    """Selected spans as tagged text. inline: tags around spans; plain: bare text; line: one line for
    each run of selected spans of the same colour and boldness."""
    kept = F.filter(spans, _wanted(codes, bold_only))
    if fmt == "line":
        shape = "struct<color:string,bold:boolean,text:string>"
        start = F.array().cast(f"array<{shape}>")

        def join(acc: Column, s: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            same = (F.size(acc) > 0) & last["color"].eqNullSafe(s["highlight"]) & (last["bold"] == s["bold"])
            more = F.struct(last["color"].alias("color"), last["bold"].alias("bold"), F.concat(last["text"], s["text"]).alias("text")).cast(shape)
            new = F.struct(s["highlight"].alias("color"), s["bold"].alias("bold"), s["text"].alias("text")).cast(shape)
            return F.when(same, F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), more)).otherwise(F.array_append(acc, new))

        runs = F.aggregate(kept, start, join)

        def line(r: Column) -> Column:
            text = strip(F.regexp_replace(r["text"], r"(?U)\s+", " "))
            head = F.concat(F.lit("["), lookup(TAGS, r["color"], "?"), F.when(r["bold"], "*").otherwise(""), F.lit("] "))
            return F.when(text == "", "").when(r["color"].isNull(), text).otherwise(F.concat(head, text))

        body = F.array_join(F.filter(F.transform(runs, line), lambda t: t != ""), "\n")
    else:

        def one(s: Column) -> Column:
            name = lookup(TAGS, s["highlight"], "?")
            tagged = F.concat(F.lit("["), name, F.when(s["bold"], "*").otherwise(""), F.lit("]"), s["text"], F.lit("[/"), name, F.lit("]"))
            return s["text"] if fmt == "plain" else F.when(s["highlight"].isNull(), s["text"]).otherwise(tagged)

        body = F.array_join(F.transform(kept, one), "")
    if not keep_breaks:
        body = F.regexp_replace(body, r"\[BR[123]\]", "")
    return tidy(body)


def clipboard(spans: Column, codes: tuple[str | None, ...]) -> Column:
    """Selected spans in closing tags; spans of white space alone always stay."""
    keep = _wanted(codes, False)
    kept = F.filter(spans, lambda s: keep(s) | (strip(s["text"]) == ""))

    def one(s: Column) -> Column:
        name = lookup(TAGS, s["highlight"])
        star = F.when(s["bold"], "*").otherwise("")
        tagged = F.concat(F.lit("["), name, star, F.lit("]"), s["text"], F.lit("[/"), name, F.lit("]"))
        return F.when((strip(s["text"]) == "") | name.isNull(), s["text"]).otherwise(tagged)

    return F.array_join(F.transform(kept, one), "")
