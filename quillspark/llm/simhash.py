"""SimHash near-duplicates, compared exactly in tiles (operator 6).

A text's fingerprint has bit b set if over half of its shingle hashes do. Distinct fingerprints are
sorted by population count, cut into tiles and compared tile against tile with exclusive-or and bit
counts in numpy; two tiles whose population counts differ by more than the radius cannot hold a link
and are skipped.

Where the radius is small against the bits, tiles are formed inside blocks: of radius+1 (or more)
slices of a fingerprint at least one must be equal in a linked pair, so comparing inside the groups
of each slice (or of a part of it) loses no link, and the work no longer grows with the square of the corpus. A
group has about a thousand fingerprints in tiles of 64, of which those beyond the radius are skipped. One of
more than `hot` fingerprints is dealt to many tasks by its tiles: a tile is a population count (and a
share of it, where that alone exceeds `hot`), a task a pair of tiles, and pairs of tiles beyond the
radius are never formed. Where slices would be too short to part anything, all tiles meet all tiles.

Links of a group leave its task as a forest (each member to its group's least member reachable), never
as all pairs. A fingerprint carries the least id of its rows, so components (`components.py`) are named
by their least id without a further join.

Defined results. Null or empty text: no shingle, fingerprint zero, linked like any other. A text of
fewer words than a shingle: its whole word sequence is its one shingle. Null ids: fingerprint and
links as for any row, but never the name of a component while a member has an id; a component of null
ids only has a null name. Repeated rows are equal texts. A bit that exactly half of the hashes have is
0. Very long texts are hashed whole, one at a time. Other columns are ignored, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._util import checkpointed, chunks, rows, shuffle_partitions, small, text_view
from quillspark.llm.components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 64
#: Fingerprints that share a key, about: enough tiles for their population counts to part them.
GROUP = 1024
HOT = 16384


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of the A-Z-lowered text, repeats included."""
    words = text.lower().split()  # on bytes, both are ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - size + 1)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stop = ends[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], seed) for a, b in zip(starts[:n].tolist(), stop.tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64 majority bits of hashes; none for no hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """(__id, f0, f1, ...): one signed 64-bit word of fingerprint per seed."""
    schema = pa.schema([("__id", pa.int64()), *((f"f{k}", pa.int64()) for k in range(len(seeds)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            for i, j in chunks(offsets):
                out = np.zeros((len(seeds), j - i), np.uint64)
                for k in range(i, j):
                    text = data[offsets[k] : offsets[k + 1]].tobytes()
                    for s, seed in enumerate(seeds):
                        out[s, k - i] = fingerprint(shingle_hashes(text, shingle, seed))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(w.view(np.int64)) for w in out)], schema=schema)

    return rows(df, id_col, text_col).mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))


class Forest:
    """Union-find over 0..n-1 that takes links by the array."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.root != np.arange(len(self.root)))
        return child, self.root[child]


def tiles_in_reach(pop_a: np.ndarray, pop_b: np.ndarray, radius: int, same: bool, tile: int) -> Iterator[tuple[int, int]]:
    """Starts of the pairs of tiles, in two sets sorted by population count, that may hold a link."""
    for i in range(0, len(pop_a), tile):
        low, high = pop_a[i] - radius, pop_a[min(i + tile, len(pop_a)) - 1] + radius
        for j in range(i if same else 0, len(pop_b), tile):
            if pop_b[j] > high:
                break
            if pop_b[min(j + tile, len(pop_b)) - 1] >= low:
                yield i, j


def tile_links(words: np.ndarray, radius: int, other: np.ndarray | None = None, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints (n x words) within radius: inside one set, or between two sets.

    Sets must be sorted by population count."""
    same = other is None
    other = words if same else other
    pop_a, pop_b = (np.bitwise_count(x).sum(axis=1).astype(np.int64) for x in (words, other))
    for i, j in tiles_in_reach(pop_a, pop_b, radius, same, tile):
        b = other[j : j + tile]
        x = words[i : i + tile]
        far = np.bitwise_count(x[:, None, 0] ^ b[None, :, 0])
        for w in range(1, words.shape[1]):
            far = far + np.bitwise_count(x[:, None, w] ^ b[None, :, w])
        near = np.flatnonzero(far.reshape(-1) <= radius)
        left, right = i + near // len(b), j + near % len(b)
        if same:
            left, right = left[left < right], right[left < right]
        if len(left):
            yield left, right


def tile_pair_counts(words: np.ndarray, radius: int, tile: int = TILE) -> tuple[int, int]:
    """(pairs of tiles compared, pairs of tiles skipped) in one set of fingerprints (n x words)."""
    pop = np.sort(np.bitwise_count(words).sum(axis=1).astype(np.int64))
    tiles = -(-len(pop) // tile)
    met = sum(1 for _ in tiles_in_reach(pop, pop, radius, True, tile))
    return met, tiles * (tiles + 1) // 2 - met


def block_masks(bits: int, radius: int, n: int, group: int = GROUP) -> list[int]:
    """Masks such that two fingerprints within radius agree on at least one of them whole.

    With s slices, a pair within radius agrees on s-radius slices at least: every choice of s-radius slices is one
    mask. Slices are as many as keep groups under one key near `group` where n asks for long keys, and are cut
    short (a part of an equal slice is equal too) where it does not: a group is many tiles, which their
    population counts part. Up to `group` fingerprints are one group. No masks: parting is not worth it."""
    from itertools import combinations
    from math import comb, log2

    need = max(0, int(np.ceil(log2(max(n, 1) / group))))
    best: list[int] = []
    for s in range(radius + 1, radius + 5):
        keep, width = s - radius, bits / s
        if width * keep < 9 or comb(s, keep) > 150:
            continue
        cuts = [bits * k // s for k in range(s + 1)]
        each = -(-need // keep)
        slices = [((1 << min(b, a + each)) - (1 << a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        best = [sum(c) for c in combinations(slices, keep)] if need else [0]
        if n / 2 ** (width * keep) < group:
            break
    return best


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _by_population(words: np.ndarray) -> np.ndarray:
    return np.argsort(np.bitwise_count(words).sum(axis=1), kind="stable")


_LINKS = pa.schema([("f", pa.int64()), ("least", pa.int64()), ("f_to", pa.int64()), ("least_to", pa.int64())])
_LINKS_DDL = "f long, least long, f_to long, least_to long"


def _links_of(table: pa.Table, sets: list[tuple[np.ndarray, np.ndarray | None]], radius: int) -> pa.Table:
    """A forest of the links inside each set of rows, or between two sets; table has f0 and least."""
    words = table.column("f0").to_numpy().view(np.uint64)[:, None]
    child, root = [], []
    for left, right in sets:
        place = left if right is None else np.concatenate([left, right])
        forest = Forest(len(place))
        for x, y in tile_links(words[left], radius, None if right is None else words[right]):
            forest.link(x, y if right is None else y + len(left))
        x, y = forest.pairs()
        child.append(place[x])
        root.append(place[y])
    a, b = (pa.array(np.concatenate([np.zeros(0, np.int64), *s]), pa.int64()) for s in (child, root))
    at = table.select(["f0", "least"])
    return pa.Table.from_arrays([*at.take(a).columns, *at.take(b).columns], schema=_LINKS)


def tile_numbers(counts: DataFrame, hot: int) -> DataFrame:
    """For each group (mask, key) over `hot` in counts (mask, key, pop, n) how many tiles each
    population count has, as a map."""
    tiles = F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / hot).cast("int"))))
    return counts.groupBy("mask", "key").agg(F.sum("n").alias("all"), tiles.alias("tiles")).where(F.col("all") > hot).drop("all")


def tile_pairs(radius: int) -> F.Column:
    """Of a row with pop and part (its tile) in a group with `tiles`: the pairs of tiles it is in."""
    reach = F.filter(F.map_entries("tiles"), lambda e: F.abs(e["key"] - F.col("pop")) <= radius)
    others = F.flatten(F.transform(reach, lambda e: F.transform(F.sequence(F.lit(0), e["value"] - 1), lambda t: F.struct(e["key"].alias("pop"), t.alias("part")))))
    own = F.struct("pop", "part")
    return F.transform(others, lambda o: F.struct(F.least(own, o).alias("low"), F.greatest(own, o).alias("high")))


def block_links(prints: DataFrame, radius: int, hot: int = HOT) -> DataFrame:
    """Links (f, least, f_to, least_to) between distinct fingerprints within radius, a forest for each
    group of a slice. prints: distinct f0 with the least id of each, checkpointed."""
    masks = block_masks(64, radius, prints.count())
    if not masks:
        raise ValueError(f"no slices for a radius of {radius}: use fingerprint_links")
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("mask"), F.col("f0").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks))))
    keyed = prints.select("f0", "least", F.bit_count("f0").alias("pop"), at.alias("at")).select("f0", "least", "pop", "at.mask", "at.key")
    crowded = checkpointed(tile_numbers(keyed.groupBy("mask", "key", "pop").agg(F.count("*").alias("n")), hot))
    part = F.pmod(F.xxhash64("mask", "key"), F.lit(4 * shuffle_partitions(prints.sparkSession)))

    def compare(table: pa.Table) -> pa.Table:
        mask, key, pop = (table.column(c).to_numpy() for c in ("mask", "key", "pop"))
        order = np.lexsort((pop, key, mask))
        mask, key = mask[order], key[order]
        start = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))))
        stop = np.append(start[1:], len(order))
        several = stop - start > 1
        return _links_of(table, [(order[a:b], None) for a, b in zip(start[several], stop[several], strict=True)], radius)

    usual = keyed
    if (some := crowded.count()) > 0:
        usual = keyed.join(small(crowded.select("mask", "key")), ["mask", "key"], "left_anti")
    links = usual.withColumn("part", part).groupBy("part").applyInArrow(compare, _LINKS_DDL)
    if not some:
        return links

    def meet(table: pa.Table) -> pa.Table:
        words = table.column("f0").to_numpy().view(np.uint64)[:, None]
        order = _by_population(words)
        tile = np.array([(r["pop"], r["part"]) for r in table.column("tile").to_pylist()])[order]
        pair = table.column("pair")[0].as_py()
        if pair["low"] == pair["high"]:
            return _links_of(table, [(order, None)], radius)
        low = (tile == [pair["low"]["pop"], pair["low"]["part"]]).all(axis=1)
        return _links_of(table, [(order[low], order[~low])], radius)

    dealt = keyed.join(small(crowded), ["mask", "key"]).withColumn("part", F.pmod(F.xxhash64("f0"), F.element_at("tiles", F.col("pop"))).cast("int"))
    dealt = dealt.select("f0", "least", "mask", "key", F.struct("pop", "part").alias("tile"), F.explode(tile_pairs(radius)).alias("pair"))
    return links.unionByName(dealt.groupBy("mask", "key", "pair").applyInArrow(meet, _LINKS_DDL))


def fingerprint_links(prints: DataFrame, names: list[str], radius: int) -> DataFrame:
    """Links between distinct fingerprints of any number of words within radius, all tiles against all,
    as (names..., names with suffix _to): a forest for each pair of sets of tiles, with the same
    components as all its links. Sets of fingerprints travel as packed rows, one to every pair of sets
    it is part of; the number of tasks is given, as these small shuffles are much work each.

    prints: distinct rows of the columns in names, checkpointed."""
    n = prints.count()
    fields = [(c, "long") for c in names] + [(f"{c}_to", "long") for c in names]
    schema = pa.schema([(c, pa.int64()) for c, _ in fields])
    ddl = ", ".join(f"{c} {t}" for c, t in fields)
    sets = max(1, -(-n // 16384), min(12, -(-n // 1024)))
    mine = F.pmod(F.xxhash64(*names), F.lit(sets)).cast("int")
    blob = pa.schema([("set", pa.int32()), ("words", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        words = np.stack([table.column(c).to_numpy().view(np.uint64) for c in names], axis=1)
        words = np.ascontiguousarray(words[_by_population(words)])
        return pa.Table.from_arrays([table.column("set").combine_chunks().slice(0, 1).cast(pa.int32()), pa.array([words.tobytes()], pa.binary())], schema=blob)

    packed = prints.select(*names, mine.alias("set")).groupBy("set").applyInArrow(pack, "set int, words binary")
    pairs = packed.select("set", "words", F.explode(F.transform(F.sequence(F.lit(0), F.lit(sets - 1)), lambda o: F.least(o, F.col("set")) * sets + F.greatest(o, F.col("set")))).alias("pair"))
    tasks = min(sets * (sets + 1) // 2, max(2080, 4 * shuffle_partitions(prints.sparkSession)))

    def meet(table: pa.Table) -> pa.Table:
        low, high = divmod(int(table.column("pair")[0].as_py()), sets)
        held = {s: np.frombuffer(w.as_buffer(), np.uint64).reshape(-1, len(names)) for s, w in zip(table.column("set").to_pylist(), table.column("words"), strict=True)}
        none = np.zeros((0, len(names)), np.uint64)
        a, b = held.get(low, none), none if low == high else held.get(high, none)
        both, forest = np.concatenate([a, b]), Forest(len(a) + len(b))
        if low == high:
            for x, y in tile_links(a, radius, tile=512):
                forest.link(x, y)
        elif len(a) and len(b):
            for x, y in tile_links(a, radius, b, tile=512):
                forest.link(x, y + len(a))
        x, y = forest.pairs()
        linked = np.concatenate([both[x], both[y]], axis=1).view(np.int64)
        return pa.Table.from_arrays([pa.array(np.ascontiguousarray(linked[:, k])) for k in range(linked.shape[1])], schema=schema)

    return pairs.repartition(tasks, "pair").groupBy("pair").applyInArrow(meet, ddl)


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """(id_col, fingerprint as 16 hex digits, component_id: the least id reachable over links)."""
    docs = checkpointed(with_fingerprints(df, id_col, text_col, shingle, (seed,)))
    prints = checkpointed(docs.groupBy("f0").agg(F.min("__id").alias("least")))

    def node(f: str, least: str) -> F.Column:
        return F.struct(F.col(least).isNull().alias("none"), F.col(least).alias("least"), F.col(f).alias("f"))

    links = block_links(prints, radius, hot).select(node("f", "least").alias("a"), node("f_to", "least_to").alias("b"))
    parts = connected_components(links).select(F.col("node.f").alias("__f"), F.col("component.least").alias("up"))
    labels = prints.join(parts, prints.f0 == F.col("__f"), "left").select(F.col("f0").alias("__f"), F.coalesce("up", "least").alias("component_id"))
    out = docs.join(small(checkpointed(labels)), docs.f0 == F.col("__f"), "left")
    return out.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
