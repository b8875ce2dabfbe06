"""Personal data: base detectors and information-theoretic sanitisation (operator 2).

Base detectors find e-mail addresses, IP addresses, card numbers and phone numbers. Protected entities
are each distinct value and the groups it belongs to: its e-mail domain, network (first two parts), card
issuer (six digits) or dialling prefix, and its kind. Words near an entity may give it away; how far is
estimated from co-occurrence counts of the whole corpus: a term t reveals the share PMI(t; c) / IC(c) of
the information content IC(c) = -log2 p(c) of an entity c, where PMI(t; c) = log2 p(t, c) / (p(t) p(c)).
Terms that reveal at least `remove` of an entity are removed around it, those of at least `generalise`
are replaced by their class of frequency (how many documents hold them, as a power of ten); both become
spans of kind `term`. A pair counts only if it is seen in `support` different texts at least, so the
words of a single text never disclose by being rare.

Probabilities are shares of documents (rows): copies count as often as they occur, but are counted
once per distinct text and weighted, so a text with thousands of copies enters no task twice. Only terms
that stand near an entity often enough are counted over the corpus, so no count of all words is shuffled.

Defined results. Null or empty text: no spans, the digest of the empty string. Null ids and repeated
rows are reported per row; equal texts get equal spans. Other columns are ignored. Very long texts are
searched whole, one at a time. A term that reveals exactly a threshold reaches it. An empty table gives
an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._util import BROADCAST_ROWS, checkpointed, rows, shuffle_partitions, small

KINDS = ("email", "ip", "card", "phone", "term")
REMOVED, GENERALISED = 5, 10  # kinds of term spans; a generalised one adds its power of ten
WINDOW_WORDS, WINDOW_CHARS, LEAST_LETTERS = 6, 120, 4
#: Thresholds of the revealed share: half of an entity's information, and four fifths of it.
SUPPORT, GENERALISE, REMOVE = 2, 0.5, 0.8

_AT = re.compile("@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits never helps a later start inside it, so matches may only begin at its first digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
# Letters, as ranges that Python and Java read alike; only A-Z are lowered, for the same reason.
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0370-\u1fff\u2c00-\u2dff\u3040-\ud7ff\uf900-\ufaff"
_TERM = re.compile(f"[{LETTERS}]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each `@` takes the longest run before it that the last match leaves."""
    done = 0
    for at in _AT.finditer(text):
        i = at.start()
        if i < done:
            continue
        start = i
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < i and (domain := _DOMAIN.match(text, i + 1)):
            done = domain.end()
            yield start, done


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, normal form) of all base spans, by start and kind."""
    out = [(a, 0, b, text[a:b].lower()) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), m[0]))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 9 <= len(digits) <= 15:
                out.append((m.start(), 3, m.end(), digits))
    out.sort()
    return out


def entity_keys(kind: int, value: str) -> tuple[int, int, int]:
    """Keys of the value, of its group within the kind and of the kind."""
    group = (value.partition("@")[2], ".".join(value.split(".")[:2]), value[:6], value[:4])[kind]
    names = (f"{KINDS[kind]}:{value}", f"{KINDS[kind]} group:{group}", f"{KINDS[kind]} kind")
    return tuple(xxhash.xxh64_intdigest(n) - (1 << 63) for n in names)


def contexts(text: str, spans: list[tuple[int, int, int, str]]) -> dict[tuple[int, str], set[tuple[int, int]]]:
    """(entity, term) -> places of the term around mentions of the entity, outside base spans."""
    found: dict[tuple[int, str], set[tuple[int, int]]] = {}
    taken = [(a, b) for a, _, b, _ in spans]
    for a, kind, b, value in spans:
        entities = entity_keys(kind, value)
        low = max(0, a - WINDOW_CHARS)
        before = [m for m in _TERM.finditer(text, low, a) if m.start() > low or low == 0][-WINDOW_WORDS:]
        after = []
        for m in _TERM.finditer(text, b, b + WINDOW_CHARS):
            if len(after) == WINDOW_WORDS or m.end() == b + WINDOW_CHARS < len(text):
                break
            after.append(m)
        if before and before[-1].end() == a and _TERM.match(text, a):
            before.pop()  # part of a word that goes on inside the mention
        if after and after[0].start() == b and _TERM.match(text, b - 1):
            del after[0]
        for m in (*before, *after):
            if m.end() - m.start() >= LEAST_LETTERS and not any(x < m.end() and m.start() < y for x, y in taken if x < b + WINDOW_CHARS and y > low):
                for entity in entities:
                    found.setdefault((entity, m[0].translate(_TO_LOWER)), set()).add(m.span())
    return found


_FOUND = pa.schema(
    [
        ("id", pa.int64()),
        ("digest", pa.binary()),
        ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
        ("entities", pa.list_(pa.int64())),
        ("near", pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])))]))),
    ]
)
_SPAN = "struct<start:int,kind:int,end:int>"
_FOUND_DDL = f"id long, digest binary, base array<{_SPAN}>, entities array<long>, near array<struct<entity:long,term:string,spans:array<{_SPAN}>>>"


def detect(docs: DataFrame) -> DataFrame:
    """Base spans, entities and their surroundings for rows (__id, __text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: dict[str, list] = {f.name: [] for f in _FOUND}
                for text in part.column(1).to_pylist():
                    text = text or ""
                    spans = base_spans(text)
                    near = contexts(text, spans) if spans else {}
                    out["digest"].append(xxhash.xxh3_128_digest(text.encode()))
                    out["base"].append([{"start": a, "kind": k, "end": b} for a, k, b, _ in spans])
                    out["entities"].append(sorted({e for _, k, _, v in spans for e in entity_keys(k, v)}))
                    out["near"].append([{"entity": e, "term": t, "spans": [{"start": a, "kind": 4, "end": b} for a, b in sorted(s)]} for (e, t), s in sorted(near.items())])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(out[f.name], f.type) for f in list(_FOUND)[1:])], schema=_FOUND)

    return docs.mapInArrow(run, _FOUND_DDL)


def corpus_counts(docs: DataFrame, terms: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(term, n_t): how many rows of docs (__id, __text) hold each of the terms (checkpointed). Up to
    `most` terms are sent to all tasks, which count them alone; more are joined to counts of all words."""
    if terms.limit(most + 1).count() > most:
        lowered = docs.select(F.array_distinct(F.split(F.translate(F.coalesce("__text", F.lit("")), _UPPER, _LOWER), f"[^{LETTERS}]+")).alias("words"))
        words = lowered.select(F.explode("words").alias("term")).where(F.length("term") >= LEAST_LETTERS)
        return words.groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term", "left_semi")
    wanted = frozenset(r[0] for r in terms.collect())  # at most `most`

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(1):
                text = (value.as_py() or "").encode().lower().decode()  # on bytes, A-Z only
                found = _TERM.findall(text) if len(text) < 1 << 20 else (m[0] for m in _TERM.finditer(text))
                counts.update(wanted.intersection(found))
        yield pa.RecordBatch.from_pydict({"term": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    return docs.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing_pairs(docs: DataFrame, found: DataFrame, support: int, generalise: float, remove: float) -> DataFrame:
    """(entity, term, share, kind) for pairs whose revealed share reaches `generalise`; kind as in spans."""
    total = docs.count()
    texts = found.where(F.size("entities") > 0).groupBy("digest").agg(F.count("*").alias("m"), F.first("entities").alias("entities"), F.first("near").alias("near"))
    texts = checkpointed(texts)
    entities = texts.select("m", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("m").alias("n_c"))
    pairs = texts.select("m", F.explode("near").alias("x")).groupBy(F.col("x.entity").alias("entity"), F.col("x.term").alias("term"))
    pairs = checkpointed(pairs.agg(F.sum("m").alias("n_tc"), F.count("*").alias("texts")).where(F.col("texts") >= support))
    counts = corpus_counts(docs, checkpointed(pairs.select("term").distinct()))
    joint = pairs.join(entities, "entity").join(counts, "term")
    content = F.log2(F.lit(float(total)) / F.col("n_c"))
    pmi = F.log2(F.col("n_tc") * F.lit(float(total)) / (F.col("n_t").cast("double") * F.col("n_c")))
    share = F.when(content > 0, pmi / content).otherwise(0.0)
    kind = F.when(F.col("share") >= remove - 1e-9, REMOVED).otherwise(GENERALISED + F.floor(F.log10("n_t") + 1e-9).cast("int"))
    return checkpointed(joint.select("entity", "term", "n_t", share.alias("share")).where(F.col("share") >= generalise - 1e-9).select("entity", "term", "share", kind.alias("kind")))


def term_spans(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(digest, terms): the spans of disclosing terms of each distinct text."""
    places = texts.select("digest", F.explode("near").alias("x")).select("digest", "x.entity", "x.term", "x.spans").join(small(pairs), ["entity", "term"])
    marked = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("kind").alias("kind"), s["end"].alias("end")))
    return checkpointed(places.groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_list(marked))).alias("terms")))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Per row: (id_col, digest, base, terms): spans as array<struct<start,kind,end>>; kind is the
    place in KINDS, terms have REMOVED or GENERALISED kinds."""
    docs = rows(df, id_col, text_col)
    found = checkpointed(detect(docs))
    near = F.size("near") > 0
    some = found.where(near).select("digest", "near").dropDuplicates(["digest"])
    terms = small(term_spans(some, disclosing_pairs(docs, found, support, generalise, remove)))
    hit = found.where(near).join(terms, "digest", "left").select("id", "digest", "base", "terms")
    rest = found.where(~near).select("id", "digest", "base", F.lit(None).cast(f"array<{_SPAN}>").alias("terms"))
    out = hit.unionByName(rest).withColumn("terms", F.coalesce("terms", F.array().cast(f"array<{_SPAN}>")))
    return out.withColumnRenamed("id", id_col)


def spelled(spans: Column) -> Column:
    """kind:start:end by start and kind, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, F.least(s["kind"], F.lit(4))), s["start"], s["end"])), ",")


def sanitise(df: DataFrame, text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """df with base spans of each text replaced by their kind in brackets, generalised terms by their
    class of frequency ([TERM:100+] is held by 100 to 999 documents), removed terms by nothing; all
    columns stay. Overlapping base spans become one. Base spans are replaced in the scan; only rows
    with terms near an entity are shuffled, to meet their spans."""
    docs = rows(df.select(F.lit(None).cast("long").alias("__no_id"), text_col), "__no_id", text_col)
    found = checkpointed(detect(docs).where(F.size("base") > 0))
    some = found.where(F.size("near") > 0).select("digest", "near").dropDuplicates(["digest"])
    terms = term_spans(some, disclosing_pairs(docs, found, support, generalise, remove))
    terms = small(terms.select(F.col("digest").alias("__digest"), F.col("terms").alias("__terms")))
    names, at = df.columns, df.columns.index(text_col)

    def with_text(batch: pa.RecordBatch, texts: list) -> list[pa.Array]:
        return [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without terms near entities masked; of the others the digest."""
        for batch in batches:
            texts, digests = batch.column(at).to_pylist(), []
            for k, text in enumerate(texts):
                spans = base_spans(text) if text else []
                wait = bool(spans) and bool(contexts(text, spans))
                digests.append(xxhash.xxh3_128_digest(text.encode()) if wait else None)
                if spans and not wait:
                    texts[k] = masked(text, [{"start": a, "kind": kind, "end": b} for a, kind, b, _ in spans])
            yield pa.RecordBatch.from_arrays([*with_text(batch, texts), pa.array(digests, pa.binary())], names=[*names, "__digest"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = [[{"start": a, "kind": kind, "end": b} for a, kind, b, _ in base_spans(text)] for text in batch.column(at).to_pylist()]
            texts = [masked(t, b + (s or [])) for t, b, s in zip(batch.column(at).to_pylist(), base, batch.column(len(names)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(with_text(batch, texts), names=names)

    schema = df.schema
    seen = df.mapInArrow(first, type(schema)([*schema.fields]).add("__digest", "binary"))
    columns = [f"`{c}`" for c in names]
    # An exchange between the two Python steps: in one stage each task would keep two workers.
    waiting = seen.where("__digest is not null").repartition(shuffle_partitions(df.sparkSession))
    waiting = waiting.join(terms, "__digest", "left").select(*columns, "__terms")
    return seen.where("__digest is null").select(*columns).union(waiting.mapInArrow(second, schema))


def masked(text: str, spans: list[dict]) -> str:
    """text with spans replaced; a span that overlaps an earlier one extends it."""
    out, done, last = [], 0, -1
    for s in sorted(spans, key=lambda s: (s["start"], s["kind"], s["end"])):
        if s["start"] < last:
            if s["end"] > last:
                done = last = s["end"]
            continue
        kind = s["kind"]
        out.append(text[done : s["start"]])
        out.append("" if kind == REMOVED else f"[TERM:{10 ** (kind - GENERALISED)}+]" if kind >= GENERALISED else f"[{KINDS[kind].upper()}]")
        done = last = s["end"]
    out.append(text[done:])
    return "".join(out)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    # A span of a term that two entities both disclose is one span.
    terms = F.array_distinct(F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind"), s["end"].alias("end"))))
    return found.select(
        "doc_id", *(count(k) for k in range(4)), F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelled(F.concat("base", terms)).alias("spans")
    )
