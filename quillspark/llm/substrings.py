"""Removal of repeated byte strings by suffix sorting of corpus shards (operator 10).

Every window of `length` bytes has a minimizer: the least hash of its `grain`-byte pieces. Equal
windows have equal minimizers, so windows can be dealt to shards by minimizer and no repeat is ever
split between two shards. Neighbouring windows mostly share their minimizer and travel as one piece
of text. Minimizers that occur once in the corpus are left out first (their windows cannot repeat).
Each shard's pieces stream into a file, are laid end to end and sorted by external induced sorting (`induced.py`);
windows whose common prefix reaches `length` are equal, and all but the earliest are marked.

Pieces that are wholly equal are merged before the sort, within a task already when they are packed,
so a text with thousands of copies enters a shard's sort once.

Defined results. Null or empty text: zero bytes. Texts under `length` bytes are kept whole. A null id
is ordered against nothing: such rows keep all bytes and remove none. Rows that share an id count as
one document: an equal string at an earlier start in any of them goes first, one at the same start
does not count. Very long texts are cut into pieces like any other. Columns other than the id and the text
are ignored, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import chain
from typing import IO

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._candidates import bucket_of, code_of, codes_by_row, marked, shared_codes
from quillspark.llm._util import (
    batch_of,
    by_bucket,
    chunks,
    mix,
    planes,
    powers,
    prefix_sums,
    rows,
    runs_of,
    shuffle_partitions,
    slide,
    text_view,
    unplanes,
)
from quillspark.llm.induced import MEMORY, SEPARATOR, _array, sort_suffixes

LENGTH = 100
GRAIN = 32
#: Bytes of pieces that a task gathers before it packs them (1 KB for each bucket if that is more).
RUN_BYTES = 12 << 20
_SLAB = 1 << 16  # its temporaries stay in cache

_PIECES = pa.schema(
    [("bucket", pa.int32()), ("settled", pa.bool_()), ("docs", pa.binary()), ("at", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("text", pa.binary())]
)
_SPANS = pa.schema([("__id", pa.int64()), ("spans", pa.binary())])


def _grains(data: np.ndarray, grain: int) -> np.ndarray:
    sums = prefix_sums(data)
    _, down = powers(len(data))
    n = len(data) - grain + 1
    return mix((sums[grain:] - sums[:n]) * down[:n])


def _slabs(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Ranges of window starts in flat text; windows over a slab's end belong to it."""
    total = int(offsets[-1])
    for a in range(0, max(0, total - length + 1), _SLAB):
        yield a, min(a + _SLAB, total - length + 1)


def _whole(offsets: np.ndarray, length: int) -> np.ndarray:
    """For each byte of flat text whether a window of one document starts there."""
    edge = np.zeros(int(offsets[-1]) + 1, np.int32)
    long = np.diff(offsets) >= length
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - length + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def minimizer_places(data: np.ndarray, offsets: np.ndarray, length: int, grain: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all minimizer occurrences in all windows."""
    width, valid = length - grain + 1, _whole(offsets, length)
    hashes, places = [], []
    for a, b in _slabs(offsets, length):
        ok = valid[a:b]
        if not ok.any():
            continue
        h = _grains(data[a : b + length - 1], grain)
        least = slide(h, width, np.minimum)
        # The greatest of the minima of the windows around a place equals its hash only if it is one of them.
        padded = np.zeros(len(h) + width - 1, np.uint64)
        padded[width - 1 : width - 1 + len(least)] = np.where(ok, least, np.uint64(0))
        is_min = np.flatnonzero(slide(padded, width, np.maximum) == h)
        hashes.append(h[is_min])
        places.append(is_min + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, at = np.concatenate(hashes), np.concatenate(places)
    at, pick = np.unique(at, return_index=True)  # slabs overlap
    return h[pick], np.searchsorted(offsets, at, side="right") - 1


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int, grain: int, want: np.ndarray, want_row: np.ndarray):
    """Runs of windows with one wanted minimizer: code, row, first window start, number of windows."""
    width, valid = length - grain + 1, _whole(offsets, length)
    starts = np.arange(len(offsets) - 1)
    busy = np.zeros(len(offsets) - 1, bool)
    busy[want_row] = True
    valid &= np.repeat(busy, np.diff(offsets)) if len(starts) else valid
    out = []
    for a, b in _slabs(offsets, length):
        ok = valid[a:b]
        if not ok.any():
            continue
        least = slide(_grains(data[a : b + length - 1], grain), width, np.minimum)
        new = np.concatenate(([True], (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])))
        edges = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        new[edges] = True
        start = np.flatnonzero(new)
        stop = np.append(start[1:], b - a)
        keep = ok[start]
        start, stop = start[keep], stop[keep]
        code = code_of(least[start])
        row = np.searchsorted(offsets, start + a, side="right") - 1
        out.append((code, row, start + a, stop - start))
    if not out:
        return [np.zeros(0, np.int64)] * 4
    found = [np.concatenate(x) for x in zip(*out, strict=True)]
    hit = marked(found[0], found[1], want, want_row)
    return [x[hit] for x in found]


def _earliest(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (key, doc, place), and for each place in it the order index of its key's first."""
    order = np.lexsort((place, doc, *key.T))
    k = key[order]
    start = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1))))
    return order, np.repeat(start, np.diff(np.append(start, len(order))))


def repeated_spans(docs: DataFrame, length: int = LENGTH, grain: int = GRAIN, memory: int = MEMORY) -> DataFrame:
    """Rows (__id, spans): byte ranges, as packed pairs of 32-bit start and length, covered by
    windows that start earlier elsewhere. Several rows of one id and overlaps are possible."""
    buckets = 4 * shuffle_partitions(docs.sparkSession)

    def anchors(data: np.ndarray, offsets: np.ndarray):
        return minimizer_places(data, offsets, length, grain)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        """Key, code, document, place, size and bytes of each piece of a chunk."""
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            data, offsets = text_view(batch.column(1))
            for i, j in chunks(offsets):
                want, want_row = codes_by_row(lists, range(i, j))
                if not len(want):
                    continue
                text, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                code, row, start, windows = _pieces(text, offs, length, grain, want, want_row)
                if not len(code):
                    continue
                raw, stop = text.tobytes(), start + windows + length - 1
                cuts = [raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, cuts)), "<u8").reshape(-1, 2)
                yield keys, code, ids[i:j][row], start - offs[row], stop - start, cuts

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        held, size = [], 0
        for part in pieces(batches):
            held.append(part)
            size += int(part[4].sum())
            if size >= max(RUN_BYTES, 1024 * buckets):
                yield [list(chain.from_iterable(x)) if k == 5 else np.concatenate(x) for k, x in enumerate(zip(*held, strict=True))]
                held, size = [], 0
        if held:
            yield [list(chain.from_iterable(x)) if k == 5 else np.concatenate(x) for k, x in enumerate(zip(*held, strict=True))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for spread, (keys, code, doc, place, size, cuts) in enumerate(gathered(batches)):
            order, least = _earliest(keys, doc, place)
            d, p = doc[order], place[order]
            late = (d != d[least]) | (p != p[least])
            if late.any():
                d, p, n = d[late], p[late], size[order][late]
                to, present, bounds = by_bucket(bucket_of(d.view(np.uint64) ^ np.uint64(spread), buckets))
                d, p, n = d[to], p[to], n[to]
                spans = list(zip(bounds[:-1], bounds[1:], strict=True))
                yield batch_of(
                    _PIECES,
                    bucket=present.astype(np.int32),
                    settled=[True] * len(spans),
                    docs=[planes(d[a:b], 8) for a, b in spans],
                    at=[planes(p[a:b], 4) for a, b in spans],
                    sizes=[planes(n[a:b], 4) for a, b in spans],
                    keys=[b""] * len(spans),
                    text=[b""] * len(spans),
                )
            keep = np.sort(order[least[least == np.arange(len(least))]])
            order, present, bounds = by_bucket(bucket_of(code[keep], buckets))
            keep = keep[order]
            spans = list(zip(bounds[:-1], bounds[1:], strict=True))
            yield batch_of(
                _PIECES,
                bucket=present.astype(np.int32),
                settled=[False] * len(spans),
                docs=[planes(doc[keep[a:b]], 8) for a, b in spans],
                at=[planes(place[keep[a:b]], 4) for a, b in spans],
                sizes=[planes(size[keep[a:b]], 4) for a, b in spans],
                keys=[keys[keep[a:b]].tobytes() for a, b in spans],
                text=[b"".join([cuts[k] for k in keep[a:b].tolist()]) for a, b in spans],
            )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard: its pieces come in batches, their text goes to a file of the task; places stay in memory."""
        known: list[tuple[np.ndarray, ...]] = []
        held: list[tuple[np.ndarray, ...]] = []
        keys: list[np.ndarray] = []
        with tempfile.TemporaryFile() as file:
            for batch in batches:
                for k, settled in enumerate(batch.column("settled").to_pylist()):
                    row = tuple(unplanes(batch.column(c)[k].as_buffer(), w).astype(t) for c, w, t in (("docs", 8, np.int64), ("at", 4, np.int32), ("sizes", 4, np.int32)))
                    (known if settled else held).append(row)
                    if not settled:
                        keys.append(np.frombuffer(batch.column("keys")[k].as_py(), "<u8"))
                        file.write(batch.column("text")[k].as_buffer())
            if held:
                file.flush()
                known += _shard_spans(file, np.concatenate(keys).reshape(-1, 2), *(np.concatenate(c) for c in zip(*held, strict=True)), length, memory)
        docs_, starts_, sizes_ = (np.concatenate(c) for c in zip(*known, strict=True)) if known else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        order = np.lexsort((starts_, docs_))
        docs_, starts_, sizes_ = docs_[order], starts_[order], sizes_[order]
        start, end = runs_of(docs_)
        spans = np.stack([starts_, sizes_], axis=1).astype("<u4")
        yield batch_of(_SPANS, __id=docs_[start], spans=[spans[a:b].tobytes() for a, b in zip(start, end, strict=True)])

    codes = shared_codes(docs, anchors, within=True)
    # Left joins on both ends read the texts through one reused exchange; rows without codes are passed over in cut.
    near = docs.join(codes, "__id", "left").select("__id", "__text", "__codes")
    packed = near.mapInArrow(cut, "bucket int, settled boolean, docs binary, at binary, sizes binary, keys binary, text binary")
    return packed.groupBy("bucket").applyInArrow(judge, "__id long, spans binary")


def _shard_spans(file: IO[bytes], keys: np.ndarray, doc: np.ndarray, place: np.ndarray, size: np.ndarray, length: int, memory: int) -> list[tuple[np.ndarray, ...]]:
    """(doc, start, size) of what goes from a shard whose pieces lie end to end in a file: pieces that equal an
    earlier one, and windows of the others that start earlier elsewhere."""
    order, least = _earliest(keys, doc, place)
    late = (doc[order] != doc[order[least]]) | (place[order] != place[order[least]])
    at = order[late]
    keep = np.sort(order[np.flatnonzero(least == np.arange(len(least)))])
    begins = np.cumsum(size, dtype=np.int64) - size
    text = _laid_out(np.asarray(np.memmap(file, np.uint8, "r")), begins[keep], size[keep].astype(np.int64), memory)
    file.truncate(0)  # nothing reads the pieces as they came any more
    return [(doc[at], place[at], size[at]), _equal_windows(text, doc, place, size, keep, length, memory)]


def _laid_out(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, block: int) -> np.ndarray:
    """Pieces of flat end to end, a separator behind each; in a file of the task beyond `block` bytes."""
    upto = np.cumsum(sizes + 1, dtype=np.int64)
    text, k = _array(int(upto[-1]), np.uint8, block), 0
    while k < len(sizes):
        j = max(k + 1, int(np.searchsorted(upto, upto[k] - sizes[k] + block, side="right")))
        n, low = sizes[k:j] + 1, int(upto[k] - sizes[k] - 1)
        to = np.cumsum(n) - n
        source = np.repeat(begins[k:j] - to, n) + np.arange(int(n.sum()))
        part = flat[np.minimum(source, len(flat) - 1)]
        part[to + n - 1] = SEPARATOR
        text[low : low + len(part)] = part
        k = j
    return text


def _equal_windows(text, doc, place, size, keep, length, memory):
    """Suffix-sort the kept pieces, laid out as text, and return (doc, start, size) of runs of windows that start
    earlier in another place."""
    sizes = size[keep].astype(np.int64)
    to = np.cumsum(sizes + 1) - (sizes + 1)
    order, common = sort_suffixes(text, length, memory)
    mark, a, n = _array(len(text) + 1, bool, memory), 0, len(text)
    while a < n:
        b = min(n, a + memory)
        while b < n and common[b] >= length:  # up to the next group
            more = np.flatnonzero(common[b : b + memory] < length)
            b = b + int(more[0]) if len(more) else min(n, b + memory)
        group = np.flatnonzero(common[a:b] < length)
        bounds = np.append(group if len(group) and group[0] == 0 else np.append(0, group), b - a)
        large = np.flatnonzero(np.diff(bounds) > 1)
        if len(large):
            sizes_of = np.diff(bounds)[large]
            firsts = np.cumsum(sizes_of) - sizes_of
            take = np.repeat(bounds[large] - firsts, sizes_of) + np.arange(int(sizes_of.sum()))
            at = order[a:b][take].astype(np.int64)
            piece = np.searchsorted(to, at, side="right") - 1
            d = doc[keep[piece]]
            p = place[keep[piece]] + at - to[piece]
            inside = at + length <= to[piece] + sizes[piece]  # a group lies inside pieces or over separators as a whole
            # The earliest of each group by (document, start); ids stay whole, so no packing into one key.
            least_doc = np.repeat(np.minimum.reduceat(d, firsts), sizes_of)
            least_place = np.repeat(np.minimum.reduceat(np.where(d == least_doc, p, np.iinfo(np.int64).max), firsts), sizes_of)
            mark[at[inside & ((d != least_doc) | (p != least_place))]] = True
        a = b
    starts, stops = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, n, memory):
        b = min(n, a + memory)
        here = mark[a:b]
        starts.append(np.flatnonzero(here & ~np.append(mark[a - 1] if a else False, here[:-1])) + a)
        stops.append(np.flatnonzero(here & ~mark[a + 1 : b + 1]) + a + 1)
    start, stop = np.concatenate(starts), np.concatenate(stops)
    piece = np.searchsorted(to, start, side="right") - 1
    return doc[keep[piece]], place[keep[piece]] + start - to[piece], stop - start + length - 1


def remove_repeated_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, grain: int = GRAIN, memory: int = MEMORY) -> DataFrame:
    """Each row of df without the bytes that repeat an earlier string of `length` bytes.

    Returns (id_col, n_bytes, n_removed, kept_bytes, removed): the remaining bytes (binary, as cuts
    may fall inside a character) and the maximal removed byte ranges."""
    if not 1 <= grain <= length <= 254:
        raise ValueError("1 <= grain <= length <= 254")
    docs = rows(df, id_col, text_col)
    known = docs.where("__id is not null")  # rows without an id match nothing, and would meet in one task
    spans = repeated_spans(known, length, grain, memory).groupBy("__id").agg(F.collect_list("spans").alias("__spans"))
    schema = pa.schema(
        [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept_bytes", pa.binary()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2)
            data, offsets = text_view(batch.column(1))
            for i, j in chunks(offsets):
                out = {"id": ids.slice(i, j - i), "n_bytes": np.diff(offsets[i : j + 1]), "n_removed": [], "kept_bytes": [], "removed": []}
                for k in range(i, j):
                    text, blobs, spans, kept = data[offsets[k] : offsets[k + 1]], lists[k].as_py(), [], None
                    if blobs:
                        pairs = np.concatenate([np.frombuffer(b, "<u4") for b in blobs]).reshape(-1, 2).astype(np.int64)
                        pairs = pairs[pairs.sum(axis=1) <= len(text)]
                        edge = np.zeros(len(text) + 1, np.int64)
                        np.add.at(edge, pairs[:, 0], 1)
                        np.add.at(edge, pairs.sum(axis=1), -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        start, end = runs_of(gone)
                        spans = [{"start": int(a), "end": int(b)} for a, b in zip(start, end, strict=True) if gone[a]]
                        kept = text[~gone]
                    kept = text if kept is None else kept
                    out["n_removed"].append(len(text) - len(kept))
                    out["kept_bytes"].append(kept.tobytes())
                    out["removed"].append(spans)
                yield batch_of(schema, **out)

    found = known.join(spans, "__id", "left").select("__id", "__text", "__spans")
    found = found.union(docs.where("__id is null").select("__id", "__text", F.lit(None).cast("array<binary>")))
    out = found.mapInArrow(keep, "id long, n_bytes long, n_removed long, kept_bytes binary, removed array<struct<start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = remove_repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return df.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256")
    )
