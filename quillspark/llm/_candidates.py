"""Find anchor codes that occur more than once in a corpus, and tell each document its own.

Anchors are 48-bit codes of short passages. A task gathers the codes of its documents over all its
batches, up to a bound, and packs them into one blob per bucket, so that the shuffle moves a few bytes an
anchor and rows by the thousand, in proportion to the input. A code seen twice in the same run is settled
there and enters its bucket once (map-side combine), which keeps a passage that a third of all documents
share from filling one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._util import batch_of, by_bucket, chunks, joined, mix, planes, runs_of, shuffle_partitions, text_view, unplanes

CODE_BITS = 48
_SHIFT = np.uint64(64 - CODE_BITS)

#: A task's run: this many items, or 64 for each bucket if that is more, are packed at once.
RUN_ITEMS = 1 << 20

_BLOBS = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("codes", pa.binary()), ("docs", pa.binary())])
_FOUND = pa.schema([("__id", pa.int64()), ("codes", pa.binary())])


def code_of(hashes: np.ndarray) -> np.ndarray:
    return hashes >> _SHIFT


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of codes, even where all codes are minima and so small."""
    return ((mix(codes) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def runs(parts: Iterator[tuple[np.ndarray, ...]], items: int) -> Iterator[list[np.ndarray]]:
    """Arrays of equal length, gathered until there are `items` of them at least; the last run may be shorter."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= items:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def shared_codes(docs: DataFrame, anchors: Callable, within: bool, per_partition: int = 4, run_items: int = RUN_ITEMS) -> DataFrame:
    """Rows (__id, codes) of the anchor codes of a document that occur elsewhere too.

    docs: columns __id, __text; rows with a null id are passed over. anchors(data, offsets) gives hashes and their rows.
    within: whether a second place in the same document counts as elsewhere.
    """
    buckets = per_partition * shuffle_partitions(docs.sparkSession)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_view(batch.column(1))
            for i, j in chunks(offsets):
                hashes, row = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if len(hashes):
                    yield code_of(hashes), ids[i:j][row]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for spread, (codes, owner) in enumerate(runs(coded(batches), max(run_items, 64 * buckets))):
            order = np.argsort(codes, kind="stable")
            code, own = codes[order], owner[order]
            start, end = runs_of(code)
            again = (end - start > 1) if within else np.maximum.reduceat(own, start) != np.minimum.reduceat(own, start)
            local = np.repeat(again, end - start)
            if local.any():
                # Settled codes need no bucket of their own: each document's go anywhere, but together.
                c, d = code[local], own[local]
                order_, present, cut = by_bucket(bucket_of(d.view(np.uint64) ^ np.uint64(spread), buckets))
                spans = list(zip(cut[:-1], cut[1:], strict=True))
                c, d = c[order_], d[order_]
                yield batch_of(_BLOBS, bucket=present.astype(np.int32), settled=[True] * len(spans), codes=[planes(c[a:b], 8) for a, b in spans], docs=[planes(d[a:b], 8) for a, b in spans])
            keep = np.sort(order[start])
            code, own = codes[keep], owner[keep]
            order, present, cut = by_bucket(bucket_of(code, buckets))
            code, own = code[order], own[order]
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            yield batch_of(
                _BLOBS,
                bucket=present.astype(np.int32),
                settled=[False] * len(spans),
                codes=[planes(code[a:b], 6) for a, b in spans],
                docs=[planes(own[a:b], 8) for a, b in spans],
            )

    def settle(table: pa.Table) -> pa.Table:
        flags = table.column("settled").to_numpy()
        known, new = table.filter(pa.array(flags)), table.filter(pa.array(~flags))
        code, own = joined(new.column("codes"), 6), joined(new.column("docs"), 8)
        order = np.argsort(code)
        code, own = code[order], own[order]
        start, end = runs_of(code)
        again = np.repeat(end - start > 1, end - start)
        code = np.concatenate([code[again], joined(known.column("codes"), 8)])
        own = np.concatenate([own[again], joined(known.column("docs"), 8)]).astype(np.int64)
        order = np.argsort(own, kind="stable")
        code, own = code[order], own[order]
        start, end = runs_of(own)
        return pa.Table.from_batches(
            [batch_of(_FOUND, __id=own[start], codes=[planes(np.unique(code[a:b]), 6) for a, b in zip(start, end, strict=True)])], schema=_FOUND
        )

    packed = docs.mapInArrow(pack, "bucket int, settled boolean, codes binary, docs binary")
    found = packed.groupBy("bucket").applyInArrow(settle, "__id long, codes binary")
    return found.groupBy("__id").agg(F.collect_list("codes").alias("__codes"))


def codes_by_row(lists: pa.ListArray, rows: range) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the given rows and the row (from 0) of each."""
    code, row = [], []
    for k, at in enumerate(rows):
        for blob in lists[at].as_py() or ():
            code.append(c := np.frombuffer(blob, np.uint8))
            row.append(np.full(len(c) // 6, k, np.int64))
    if not code:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([unplanes(c, 6) for c in code]), np.concatenate(row)


def marked(codes: np.ndarray, row: np.ndarray, want: np.ndarray, want_row: np.ndarray) -> np.ndarray:
    """For each (code, row) whether it is among the wanted ones; rows are under 65536."""
    if not len(codes) or not len(want):
        return np.zeros(len(codes), bool)
    key = codes | (row.astype(np.uint64) << np.uint64(CODE_BITS))
    wanted = np.unique(want | (want_row.astype(np.uint64) << np.uint64(CODE_BITS)))
    at = np.searchsorted(wanted, key)
    at[at == len(wanted)] = 0
    return wanted[at] == key
