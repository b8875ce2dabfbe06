"""Shared pieces of the llm operators: Arrow text access, word cutting, rolling hashes, blob packing.

Everything here works on flat numpy arrays over a run of documents ("chunk"), never on one Python
object per word, and keeps its temporaries near CHUNK_BYTES whatever the size of the input.
"""

from __future__ import annotations

import ctypes
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
CHUNK_ROWS = 60_000
BATCH_BYTES = 8 << 20
U64 = np.uint64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only

# ASCII white space is U+0020 and U+0009 to U+000D.
WHITESPACE = b" \t\n\x0b\x0c\r"
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(WHITESPACE)] = False

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, size=256, dtype=np.uint64) * U64(2) + U64(1)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the cluster's shared folder.

    The folder is the session's spark.checkpoint.dir. Only where none is set (tests, local runs) is
    one beside the warehouse used.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(where or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder; one beside the warehouse only where none is set."""
    where = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return (where or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints").rstrip("/")


def scratch_table(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder as Parquet and read it back."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that may be broadcast (ids, terms and counts, under 100 bytes each); beyond it is joined.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df (checkpointed), marked for broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python in Arrow batches of at most BATCH_BYTES (a longer text stands alone)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_view(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets; null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


_last_trim = 0.0


def give_back() -> None:
    """Hand freed memory of this worker back to the system, at most once a second: workers are kept for
    later tasks, and what one task's arrays took would stay beside the next one's."""
    global _last_trim
    if time.monotonic() - _last_trim > 1:
        pa.default_memory_pool().release_unused()
        if _TRIM is not None:
            _TRIM(0)
        _last_trim = time.monotonic()


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes (a longer text stands alone) and at most rows rows."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j
        i = j
    give_back()


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of non-white-space bytes; runs never cross rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2
_KEEP_POWERS = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the rolling base and of its inverse modulo 2**64; short tables are kept."""
    if n > len(_POWERS[0]):
        size = max(n, min(_KEEP_POWERS, 2 * len(_POWERS[0])), 1 << 16)
        tables = [np.full(size, U64(b)) for b in (_BASE, _INVERSE)]
        for table in tables:
            table[0] = U64(1)
            np.multiply.accumulate(table, out=table)
        if size > _KEEP_POWERS:
            return tables[0][:n], tables[1][:n]
        _POWERS[:] = tables
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place on a fresh array)."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xC2B2AE3D27D4EB4F)
    h ^= h >> U64(32)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_BYTE_VALUES[data], up, out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slab: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of the bytes of each range, in slabs of text that stay in cache; ends must ascend."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + slab, side="right")))
        lo, hi = starts[i], ends[j - 1]
        sums = prefix_sums(data[lo:hi])
        _, down = powers(int(hi - lo))
        out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * down[starts[i:j] - lo]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i..i+n-1] for each i that has n words after it (len(words)-n+1 values)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for t in range(1, n):
        h *= U64(0x9FB21C651E98DF25)
        h += words[t : t + m]
    return mix(h)


def slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best of values[i .. i+width-1] for each i that has them all."""
    out, have = values, 1
    while 2 * have <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = best(out[: len(out) - (width - have)], out[width - have :])
    return out


def planes(values: np.ndarray, width: int) -> bytes:
    """The low width bytes of integers, byte plane by byte plane: equal high bytes compress away."""
    return np.ascontiguousarray(values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").reshape(-1)


def joined(col: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    parts = [unplanes(b.as_py(), width) for b in col]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by bucket, with the buckets present and the bounds of each in that order."""
    kind = bucket.astype(np.uint16) if len(bucket) and int(bucket.max()) < 65536 else bucket
    order = np.argsort(kind, kind="stable")
    in_order = bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], in_order[1:] != in_order[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    return order, in_order[cut], np.append(cut, len(bucket))


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds [start, end) of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return start, np.append(start[1:], len(values))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns that an operator reads, under names nothing else can clash with."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
