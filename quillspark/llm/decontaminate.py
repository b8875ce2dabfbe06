"""Benchmark decontamination: one-sided MinHash containment search (operator 7).

Items are parted by the size of their shingle sets. In a part with at most u shingles an item is
represented by the k = floor((1 - t) u) + 1 least of its shingle hashes (a bottom-k MinHash sketch).
A document that contains a share of at least t of an item's shingles can lack at most k - 1 of them,
so it holds at least one value of the sketch: no item is missed, however long the document is. The
documents' shingle hashes are looked up in the sorted sketch values; each hit is then verified by
counting the item's shingles, as strings, in the document.

The sketch is one-sided: a sketch of the document as well (as an ensemble of hash tables takes) would lose
short items in long documents. An item of 30 shingles, all of them in a document of 2,000, has a Jaccard
similarity of 0.015 with it, and 256 minima of both sides agree somewhere with probability 0.98; in one of
20,000 shingles it is 0.0015 and 0.32.

The benchmark is sent to all tasks in slices of at most `slice_bytes` of text, counted first; a larger
benchmark takes several passes over the documents, each written before the next. No shuffle is needed.

Words are runs of non-white-space, A-Z lowered. An item shorter than a shingle is its whole word
sequence, looked for as it is. Defined results. Null or empty items and null or empty documents never
match. Null ids are reported as null. Repeated rows are each reported. A containment equal to the threshold
counts. Very long texts are cut and hashed alone, whole. Other columns are ignored, whatever their names. An
empty table on either side gives no hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._util import bounded_batches, chunks, cut_words, ngram_hashes, rows, scratch_table, text_view, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
SLICE_BYTES = 32 << 20

_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(words: list[bytes], size: int) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def hashed(text: bytes, size: int) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = cut_words(data, np.array([0, len(data)]))
    return ngram_hashes(word_hashes(data, starts, ends), size)


class Sketches:
    """The sketch values of a slice of items, by shingle length, and the items' words."""

    def __init__(self, items: list[tuple[int | None, str]], size: int, threshold: float) -> None:
        self.threshold = threshold
        self.items = [(i, b" ".join((t or "").encode().lower().split())) for i, t in items]
        self.items = [(i, w) for i, w in self.items if w]
        self.width: list[int] = []
        self.count: list[int] = []  # shingles of each item
        values: dict[int, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(self.items):
            self.width.append(min(size, words.count(b" ") + 1))
            self.count.append(len(self.set_of(k)))
            mine = np.unique(hashed(words, self.width[k]))
            upper = 1 << (self.count[k] - 1).bit_length()  # largest set of its part
            take = int((1 - threshold) * upper + 1e-9) + 1
            values.setdefault(self.width[k], []).extend((int(v), k) for v in mine[:take])
        self.tables = {}
        for width, pairs in values.items():
            pairs.sort()
            key = np.array([p[0] for p in pairs], np.uint64)
            screen = np.zeros(1 << 16, bool)
            screen[key >> np.uint64(48)] = True
            self.tables[width] = (key, np.array([p[1] for p in pairs]), screen)

    def set_of(self, k: int) -> set[bytes]:
        return shingles(self.items[k][1].split(), self.width[k])

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs of rows that hold a sketch value of the item."""
        starts, ends, row = cut_words(data, offsets)
        words = word_hashes(data, starts, ends)
        found = set()
        for width, (key, item, screen) in self.tables.items():
            grams = ngram_hashes(words, width)
            at = np.flatnonzero(screen[grams >> np.uint64(48)])
            at = at[row[at] == row[at + width - 1]]
            low, high = (np.searchsorted(key, grams[at], side=s) for s in ("left", "right"))
            hit = np.flatnonzero(high > low)
            for k in hit.tolist():
                found.update((int(row[at[k]]), int(i)) for i in item[low[k] : high[k]])
        return found

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, shingles of the item, how many the row holds) at or above the threshold."""
        data, offsets = text_view(texts)
        for i, j in chunks(offsets):
            pairs = self.candidates(_LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
            by_row: dict[int, list[int]] = {}
            for r, item in pairs:
                by_row.setdefault(r, []).append(item)
            for r in sorted(by_row):
                words = data[offsets[i + r] : offsets[i + r + 1]].tobytes().lower().split()
                have: dict[int, set[bytes]] = {}
                for item in sorted(by_row[r]):
                    width = self.width[item]
                    if width not in have:
                        have[width] = shingles(words, width)
                    shared = len(self.set_of(item) & have[width])
                    if shared >= self.threshold * self.count[item] - 1e-9:
                        yield i + r, item, self.count[item], shared


def benchmark_slices(benchmark: DataFrame, id_col: str, text_col: str, size: int, threshold: float, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[Sketches, bool]]:
    """Sketches of slices of the benchmark, each of bounded size, and whether there are several. With
    several the caller writes each pass before it asks for the next, so one slice is held at a time."""
    items = rows(benchmark, id_col, text_col)
    total = items.agg(F.sum(F.octet_length("__text") + 16)).first()[0] or 0
    parts = -(-int(total) // slice_bytes)
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("__id", "__text"), F.lit(parts)) == part) if parts > 1 else items
        yield Sketches([tuple(r) for r in mine.collect()], size, threshold), parts > 1


def find_contamination(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    size: int = SHINGLE, threshold: float = THRESHOLD, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row (doc_id, item_id, n_item, n_shared, containment) per document and item it contains."""
    docs, out = rows(df, id_col, text_col), None
    for sketches, several in benchmark_slices(benchmark, item_col, item_text_col, size, threshold, slice_bytes):

        def run(batches: Iterator[pa.RecordBatch], sketches: Sketches = sketches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(sketches.hits(batch.column(1)))
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                shared, whole = [f[3] for f in found], [f[2] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([sketches.items[f[1]][0] for f in found], pa.int64()), pa.array(whole, pa.int64()), pa.array(shared, pa.int64()), pa.array([s / w for s, w in zip(shared, whole, strict=True)], pa.float64())],
                    schema=_HITS,
                )

        part = docs.mapInArrow(run, "doc_id long, item_id long, n_item long, n_shared long, containment double")
        part = scratch_table(part) if several else part
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = df.sparkSession.createDataFrame([], "doc_id long, item_id long, n_item long, n_shared long, containment double")
    return out


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of df, all columns, that contain no benchmark item. Nothing is shuffled."""
    bounded_batches(df.sparkSession)
    at = df.columns.index(text_col)
    for sketches, several in benchmark_slices(benchmark, item_col, item_text_col, size, threshold, slice_bytes):

        def run(batches: Iterator[pa.RecordBatch], sketches: Sketches = sketches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in sketches.hits(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        df = df.mapInArrow(run, df.schema)
        df = scratch_table(df) if several else df
    return df


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_FOLD}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bs AS (SELECT item_id, least(len(w), {SHINGLE}) AS k, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM bs),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
z AS (SELECT DISTINCT k FROM bs),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, z),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM dp),
j AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN s USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item::DOUBLE AS containment FROM j JOIN n USING (item_id)
WHERE n_shared >= {THRESHOLD} * n_item - 1e-9
"""
