"""Packing of tokenised documents into fixed-length sequences, best-fit decreasing (operator 1).

Documents are tokenised in parallel; only lengths matter for packing, and there are at most
`capacity` of them, so the driver sees one count per length whatever the corpus size. Lengths are
taken from the longest down. Open sequences are held by remaining capacity, and a segment tree over
the capacities finds the tightest one that fits in logarithmic time. Equal documents and equal
sequences are placed many at a time with the same outcome as one by one: the tightest sequence for a
length stays the tightest until it no longer fits. The plan is a list of runs (length, ranks ->
sequences and offsets); ranks among equal lengths come from counts per partition.

Defined results. Null or empty text: only the closing id, one piece of length one. Null ids and
repeated rows are packed like any other row. Documents over `capacity` are cut into pieces of
`capacity` ids, the last may be shorter; nothing else is cut. Very long texts are tokenised alone, whole.
Of sequences with equal remaining capacity (ties) the one opened last is filled, of pieces of equal length
the one that comes first in the stored order goes first; neither changes the number of sequences. Other
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm._util import checkpointed, chunks, rows, text_view

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 400_000
CHUNK_BYTES = 1 << 20

_PIECES = pa.schema(
    [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]
)


class _Numbered(dict):
    """Words by number; a new word gets the next number and is noted in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordTokens:
    """Token ids of texts, word by word, with a bounded cache of words seen.

    The tokenizer drops white space and never joins what it separates, so the ids of a text are
    those of its words in order. It lowers case, so texts are lowered first (A-Z only, and not where
    they may hold one of its special tokens). New words are encoded many to a call: a word of letters
    is one unit of the tokenizer, closing punctuation a second one, and the last token of each unit
    is known by its word-end mark. All other words are encoded one by one.
    """

    PUNCTUATION = ".,;:!?"

    def __init__(self, path: str, limit: int = CACHE_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbered()
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while int(numbers.max()) >= len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts[numbers], self.sizes[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _place(self, first: int, block: np.ndarray, units: np.ndarray, ids: np.ndarray, alone: list[int]) -> None:
        """Store the ids of a block of words, cut where their units end."""
        ends, upto = np.flatnonzero(self.closes[ids]) + 1, np.cumsum(units[block])
        if len(ends) == upto[-1] and ends[-1] == len(ids):
            ends = ends[upto - 1]
            self._store(first + block, ids, np.diff(ends, prepend=0))
        else:  # a letter that the tokenizer takes apart
            alone += block.tolist()

    def _learn(self, words: list[bytes]) -> None:
        texts = b" ".join(words).decode().split(" ")
        cores = [t.rstrip(self.PUNCTUATION) for t in texts]
        units = np.fromiter((1 + (len(c) < len(t)) if c.isalpha() else 0 for c, t in zip(cores, texts, strict=True)), np.int64, len(texts))
        first, alone = len(self.known) - len(words), np.flatnonzero(units == 0).tolist()
        plain = np.flatnonzero(units)
        blocks = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for at in range(0, len(blocks), 16):
            group = blocks[at : at + 16]
            lined = [" ".join(cores[k] if units[k] == 1 else f"{cores[k]} {texts[k][len(cores[k]) :]}" for k in block.tolist()) for block in group]
            for block, ids in zip(group, self._encode(lined), strict=True):
                self._place(first, block, units, np.array(ids, np.int64), alone)
        if alone:
            found = self._encode([texts[k] for k in alone])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._store(first + np.array(alone), np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum())), sizes)

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the bounds of each text."""
        if len(self.known) > self.limit:
            self._clear()
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.known.new:
            new, self.known.new = self.known.new, []
            self._learn(new)
        sizes = self.sizes[at]
        to = np.concatenate(([0], np.cumsum(sizes)))
        source = np.repeat(self.starts[at] - to[:-1], sizes) + np.arange(int(to[-1]))
        return self.flat[source], to[np.concatenate(([0], np.cumsum(counts)))]


@functools.lru_cache(maxsize=2)
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: __id, piece, start, length, ids_crc32, and the ids themselves if asked."""
    kept = [f for f in _PIECES if with_ids or f.name != "ids"]
    schema = pa.schema(kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer or default_tokenizer())  # found where the task runs
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            keys = batch.column(0)
            for i, j in chunks(offsets, CHUNK_BYTES):
                raw = data[offsets[i] : offsets[j]].tobytes()
                offs = (offsets[i : j + 1] - offsets[i]).tolist()
                flat, bounds = tokens.ids([raw[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)])
                out: dict[str, list] = {f.name: [] for f in schema}
                source = []
                bounds = bounds.tolist()
                for k in range(j - i):
                    ids = np.append(flat[bounds[k] : bounds[k + 1]], end_id).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        source.append(i + k)
                        out["piece"].append(piece)
                        out["start"].append(start)
                        out["length"].append(len(part))
                        out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            out["ids"].append(part.astype(np.int32))
                out["id"] = keys.take(pa.array(source, pa.int64()))
                yield pa.RecordBatch.from_arrays([out[f.name] if f.name == "id" else pa.array(out[f.name], f.type) for f in schema], schema=schema)

    names = {"id": "id long", "piece": "piece int", "start": "start long", "length": "length long", "ids_crc32": "ids_crc32 long", "ids": "ids array<int>"}
    return rows(df, id_col, text_col).mapInArrow(cut, ", ".join(names[f.name] for f in schema)).withColumnRenamed("id", "__id")


class CapacityTree:
    """Segment tree over remaining capacities: how many groups of open sequences have each."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        i = remaining + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least `least` in use, or -1."""
        i = least + self.size
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i + (not self.count[2 * i])
                return i - self.size
            i >>= 1
        return -1


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over a histogram of lengths.

    Returns runs (length, first rank, first sequence, items a sequence, first offset), ordered by
    length and rank, and the number of sequences."""
    tree, groups = CapacityTree(capacity), {}
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            groups.setdefault(remaining, []).append((first, n))
            tree.add(remaining, 1)

    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} ids does not fit {capacity}")
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining < 0:
                each = capacity // length
                first, n, remaining = opened, -(-left // each), capacity
                opened += n
            else:
                first, n = groups[remaining].pop()
                tree.add(remaining, -1)
                each = remaining // length
            full = min(n, left // each)
            runs.append((length, rank, first, each, capacity - remaining))
            put(remaining - each * length, first, full)
            rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if left and n:  # fewer than `each` are left for the next one
                runs.append((length, rank, first, each, capacity - remaining))
                put(remaining - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            put(remaining, first, n)
    return np.array(sorted(runs), np.int64).reshape(-1, 5), opened


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (any columns, with `length`) plus sequence_id and offset. pieces must have a stable
    partitioning (a checkpoint), as ranks are counted in one job and used in another."""
    names = pieces.columns
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = best_fit_plan(counts, capacity)
    placed = pieces.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("__part", "length").agg(F.count("*").alias("__n"))
    base = base.select("__part", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__part", "length").orderBy("__at"))
    ranked = placed.withColumn("__own", own).join(base, ["__part", "length"]).select(*names, (F.col("__own") - 1 + F.col("__base")).alias("__rank"))
    low = np.iinfo(np.int64).max >> 13  # length and rank in one key: ranks stay below 2**50
    keys = plan[:, 0] * (low + 1) + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank"))
            run = plan[np.searchsorted(keys, length * (low + 1) + rank, side="right") - 1]
            within = rank - run[:, 1]
            kept = [batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(run[:, 2] + within // run[:, 3]), pa.array(run[:, 4] + within % run[:, 3] * length)], names=[*names, "sequence_id", "offset"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack all rows: one row per piece with its sequence and offset."""
    packed = pack(checkpointed(token_pieces(df, id_col, text_col, tokenizer, capacity, end_id, with_ids)), capacity)
    return packed.select(F.col("__id").alias(id_col), *packed.columns[1:])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
