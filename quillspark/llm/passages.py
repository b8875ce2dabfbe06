"""Removal of repeated word passages, by difference-cover anchors (operator 4).

A window is `window` consecutive words of one document. Positions are taken modulo `period`; a
difference cover of the period has, for any two alignments, a common shift at which both positions
are cover positions. So two equal windows share at least one seed of `window - period + 1` words
that starts at a cover position in both, and hashing the seeds at cover positions only (3 of 7)
finds every repeat. Windows around seeds that occur in several documents are then compared whole.

Defined results. Null or empty text: no words, nothing removed, empty kept text. A null id is
ordered against nothing: such rows keep all their words and remove none. Rows with the same id (ties)
never remove each other's words (no id is smaller), but each is judged against smaller ids.
Very long texts are cut into words by the batch, whole. Columns other than the id and the text are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._candidates import bucket_of, code_of, codes_by_row, marked, runs, shared_codes
from quillspark.llm._util import (
    batch_of,
    by_bucket,
    chunks,
    cut_words,
    joined,
    ngram_hashes,
    planes,
    rows,
    runs_of,
    shuffle_partitions,
    slide,
    text_view,
    unplanes,
    word_hashes,
)

WINDOW = 13
#: Period -> a difference cover of it (every residue is a difference of two members).
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
PERIOD = 7
#: Windows that a task gathers before it packs them (16 for each bucket if that is more).
RUN_WINDOWS = 1 << 19

_WINDOWS = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("docs", pa.binary()), ("at", pa.binary()), ("hashes", pa.binary())])
_PLACES = pa.schema([("__id", pa.int64()), ("places", pa.binary())])


def cover_seeds(words: np.ndarray, row: np.ndarray, first: np.ndarray, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes at the cover positions of each row, and their word indices.

    first: for each row the index of its first word. Rows of under `window` words have no seed.
    """
    size = window - period + 1
    seeds = ngram_hashes(words, size)
    if not len(seeds):
        return seeds, np.zeros(0, np.int64)
    n = len(seeds)
    place = np.arange(n) - first[row[:n]]
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True
    counts = np.bincount(row, minlength=len(first))
    good = cover[place % period] & (row[size - 1 :] == row[:n]) & (counts[row[:n]] >= window)
    at = np.flatnonzero(good)
    return seeds[at], at


def _cut(data: np.ndarray, offsets: np.ndarray):
    starts, ends, row = cut_words(data, offsets)
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    return starts, ends, row, first


def window_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """16-byte hashes of the windows at the given word indices, their words joined by one space."""
    used = np.zeros(len(starts) + 1, np.int64)
    np.add.at(used, at, 1)
    np.add.at(used, at + window, -1)
    need = np.flatnonzero(np.cumsum(used[:-1]) > 0)
    size = ends[need] - starts[need] + 1
    to = np.cumsum(size) - size
    source = np.repeat(starts[need] - to, size) + np.arange(int(size.sum()))
    text = data[np.minimum(source, len(data) - 1)]
    text[to + size - 1] = 32
    text = text.tobytes()
    place = np.searchsorted(need, at)
    begin, end = to[place], (to + size - 1)[np.searchsorted(need, at + window - 1)]
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(text[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]), "<u8").reshape(-1, 2)


def repeated_windows(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """Rows (__id, places): for documents of docs (__id, __text), the word indices of the windows
    whose words also start somewhere in a document of a smaller id, as packed 32-bit integers.
    Several rows of one id and repeated places are possible."""
    if window - period + 1 < 1 or period not in COVERS:
        raise ValueError(f"no cover of period {period} for windows of {window} words")
    buckets = 4 * shuffle_partitions(docs.sparkSession)

    def anchors(data: np.ndarray, offsets: np.ndarray):
        starts, ends, row, first = _cut(data, offsets)
        seeds, at = cover_seeds(word_hashes(data, starts, ends), row, first, window, period)
        return seeds, row[at]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """Key (two halves), document, place and dealing hash of each window around a shared seed."""
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            data, offsets = text_view(batch.column(1))
            for i, j in chunks(offsets):
                want, want_row = codes_by_row(lists, range(i, j))
                if not len(want):
                    continue
                text, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, row, first = _cut(text, offs)
                words = word_hashes(text, starts, ends)
                seeds, at = cover_seeds(words, row, first, window, period)
                hit = at[marked(code_of(seeds), row[at], want, want_row)]
                if not len(hit):
                    continue
                near = np.zeros(len(row) + 1, np.int64)
                np.add.at(near, np.maximum(hit - (period - 1), first[row[hit]]), 1)
                np.add.at(near, hit + 1, -1)
                begin = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                begin = begin[begin + window <= len(row)]
                begin = begin[row[begin + window - 1] == row[begin]]
                if not len(begin):
                    continue
                keys = window_keys(text, starts, ends, begin, window)
                # Neighbouring windows mostly share their least 4-word hash, and so their bucket.
                least4 = slide(ngram_hashes(words, min(4, window)), max(1, window - 3), np.minimum)[begin]
                yield keys[:, 0], keys[:, 1], ids[i:j][row[begin]], begin - first[row[begin]], least4

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for spread, (high, low, own, place, least4) in enumerate(runs(windows(batches), max(RUN_WINDOWS, 16 * buckets))):
            order = np.lexsort((low, high))
            high, low, own, place, least4 = high[order], low[order], own[order], place[order], least4[order]
            new = np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
            start = np.flatnonzero(new)
            least = np.repeat(np.minimum.reduceat(own, start), np.diff(np.append(start, len(own))))
            late = own > least
            if late.any():
                o, p = own[late], place[late]
                order, present, cut = by_bucket(bucket_of(o.view(np.uint64) ^ np.uint64(spread), buckets))
                spans = list(zip(cut[:-1], cut[1:], strict=True))
                o, p = o[order], p[order]
                yield batch_of(_WINDOWS, bucket=present.astype(np.int32), settled=[True] * len(spans), docs=[planes(o[a:b], 8) for a, b in spans], at=[planes(p[a:b], 4) for a, b in spans], hashes=[b""] * len(spans))
            high, low, own, place, least4 = high[~late], low[~late], own[~late], place[~late], least4[~late]
            order, present, cut = by_bucket(bucket_of(least4, buckets))
            order = np.concatenate([part[np.lexsort((place[part], own[part]))] for part in np.split(order, cut[1:-1])])
            high, low, own, place = high[order], low[order], own[order], place[order]
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            yield batch_of(
                _WINDOWS,
                bucket=present.astype(np.int32),
                settled=[False] * len(spans),
                docs=[planes(own[a:b], 8) for a, b in spans],
                at=[planes(place[a:b], 4) for a, b in spans],
                hashes=[planes(high[a:b], 8) + planes(low[a:b], 4) for a, b in spans],
            )

    def judge(table: pa.Table) -> pa.Table:
        flags = table.column("settled").to_numpy()
        known, new = table.filter(pa.array(flags)), table.filter(pa.array(~flags))
        own, place = joined(new.column("docs"), 8).astype(np.int64), joined(new.column("at"), 4)
        blobs = [b.as_py() for b in new.column("hashes")]
        high = np.concatenate([unplanes(b[: len(b) // 12 * 8], 8) for b in blobs]) if blobs else np.zeros(0, np.uint64)
        low = np.concatenate([unplanes(b[len(b) // 12 * 8 :], 4) for b in blobs]) if blobs else np.zeros(0, np.uint64)
        if len(own):
            order = np.lexsort((low, high))
            high, low, own, place = high[order], low[order], own[order], place[order]
            start = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
            late = own > np.repeat(np.minimum.reduceat(own, start), np.diff(np.append(start, len(own))))
            own, place = own[late], place[late]
        own = np.concatenate([own, joined(known.column("docs"), 8).astype(np.int64)])
        place = np.concatenate([place, joined(known.column("at"), 4)])
        order = np.argsort(own, kind="stable")
        own, place = own[order], place[order].astype("<u4")
        start, end = runs_of(own)
        return pa.Table.from_batches([batch_of(_PLACES, __id=own[start], places=[place[a:b].tobytes() for a, b in zip(start, end, strict=True)])], schema=_PLACES)

    codes = shared_codes(docs, anchors, within=False)
    # Left joins on both ends read the texts through one reused exchange; rows without codes are passed over in extend.
    near = docs.join(codes, "__id", "left").select("__id", "__text", "__codes")
    spread = near.mapInArrow(extend, "bucket int, settled boolean, docs binary, at binary, hashes binary")
    return spread.groupBy("bucket").applyInArrow(judge, "__id long, places binary")


def remove_repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """Each row of df with the words left once every repeated passage is taken out.

    Returns (id_col, n_words, n_removed, kept_text, removed): kept words joined by one space, and
    the removed word ranges as array<struct<start,end>>. See the module docstring for edge cases.
    """
    docs = rows(df, id_col, text_col)
    known = docs.where("__id is not null")  # rows without an id match nothing, and would meet in one task
    places = repeated_windows(known, window, period).groupBy("__id").agg(F.collect_list("places").alias("__places"))
    schema = pa.schema(
        [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists = batch.columns
            sizes = np.diff(text_view(texts)[1])
            for i, j in chunks(np.concatenate(([0], np.cumsum(sizes)))):
                out = {"id": ids.slice(i, j - i), "n_words": [], "n_removed": [], "kept_text": [], "removed": []}
                for k in range(i, j):
                    words = (texts[k].as_py() or "").encode().split()
                    blobs, spans = lists[k].as_py(), []
                    if blobs:
                        at = np.concatenate([np.frombuffer(b, "<u4") for b in blobs]).astype(np.int64)
                        at = at[at + window <= len(words)]
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + window, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        start, end = runs_of(gone)
                        spans = [{"start": int(a), "end": int(b)} for a, b in zip(start, end, strict=True) if gone[a]]
                        kept = list(compress(words, (~gone).tolist()))
                    else:
                        kept = words
                    out["n_words"].append(len(words))
                    out["n_removed"].append(len(words) - len(kept))
                    out["kept_text"].append(b" ".join(kept).decode())
                    out["removed"].append(spans)
                yield batch_of(schema, **out)

    found = known.join(places, "__id", "left").select("__id", "__text", "__places")
    found = found.union(docs.where("__id is null").select("__id", "__text", F.lit(None).cast("array<binary>")))
    out = found.mapInArrow(keep, "id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = remove_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
