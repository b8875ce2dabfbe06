"""Near-duplicate groups at a Jaccard threshold on word shingles, found through SimHash.

Used where whole near-duplicates are wanted (five-word shingles, similarity 0.8 or more). Candidates
are pairs of 128-bit SimHash fingerprints (two seeded 64-bit words) within a radius that keeps almost
all pairs at the threshold and almost no others; they are compared exactly, tile against tile. Equal
texts are one candidate, so a text with thousands of copies is compared once.

The tiles only hand on a forest of candidate links. Each candidate component is then taken to one task
with its members' shingle sets (a large one in blocks, each pair of blocks a task): candidate pairs
whose members are not connected yet are verified by the exact Jaccard similarity, and what leaves the
task is again a forest, never the pairs of a group.

Pairs at a Jaccard similarity of 0.8 differ in 19 of 128 bits on average, with a standard deviation of
4; a radius of 30 keeps 99.5 % of them and unrelated pairs only once in about a billion.

Defined results. Null and empty texts are equal; other texts without a word have no near duplicates. A text of
fewer words than a shingle has its whole word sequence as its one shingle. Repeated rows are equal texts. Null
ids name a group only where it has no other. A similarity equal to the threshold is a link. Very long texts are
compared whole, extra columns are not read, whatever their names. Empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._util import bounded_batches, checkpointed, chunks, mix, shuffle_partitions, small, text_view
from quillspark.llm.components import connected_components
from quillspark.llm.simhash import Forest, fingerprint, fingerprint_links, shingle_hashes, tile_links

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 30
SEEDS = (42, 1042)
BLOCK_BYTES = 8 << 20

_EDGES = pa.schema([("a", pa.string()), ("b", pa.string())])


def text_key(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"))


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, seeds: tuple[int, ...] = SEEDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, id, group): one row per distinct text (by digest) with the least id of the text and the
    least text digest of its near-duplicate group. Texts without a word are groups of their own."""
    bounded_batches(df.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("key", pa.string()), ("n", pa.int64()), *((f"f{k}", pa.int64()) for k in range(len(seeds)))])
    names = [f"f{k}" for k in range(len(seeds))]
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_key(text_col).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(2))
            for i, j in chunks(offsets):
                out, sizes = np.zeros((len(seeds), j - i), np.uint64), np.zeros(j - i, np.int64)
                for k in range(i, j):
                    hashes = np.unique(shingle_hashes(data[offsets[k] : offsets[k + 1]].tobytes(), shingle, seeds[0]))
                    sizes[k - i] = len(hashes)
                    for s, seed in enumerate(seeds):
                        out[s, k - i] = fingerprint(mix(hashes * np.uint64(2 * seed + 1)) if s else hashes)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 1)), pa.array(sizes), *(pa.array(w.view(np.int64)) for w in out)], schema=schema)

    marked = docs.mapInArrow(prints, "id long, key string, n long, " + ", ".join(f"{n} long" for n in names))
    texts = checkpointed(marked.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in names)))
    prints_of = checkpointed(texts.where("n > 0").groupBy(*names).agg(F.min("key").alias("rep")))
    links = fingerprint_links(prints_of.select(*names), names, radius)
    to = prints_of.select(*(F.col(c).alias(f"{c}_to") for c in names), F.col("rep").alias("b"))
    edges = links.join(prints_of.withColumnRenamed("rep", "a"), names).join(to, [f"{c}_to" for c in names]).select("a", "b")
    parts = connected_components(edges, "a", "b").withColumnRenamed("node", "rep")
    known = prints_of.join(parts, "rep", "left").select(*names, F.coalesce("component", "rep").alias("component"))
    members = checkpointed(texts.where("n > 0").join(known, names).select("key", "id", "n", "component", *names))
    sizes = members.groupBy("component").agg(F.count("*").alias("texts"), F.ceil(F.sum("n") * 8 / block_bytes).cast("int").alias("blocks")).where("texts > 1").drop("texts")
    wanted = members.join(small(checkpointed(sizes)), "component")
    near = verified_links(docs, wanted, names, shingle, similarity, radius)
    groups = connected_components(near, "a", "b")
    out = texts.join(groups, texts["key"] == groups["node"], "left")
    return out.select("key", "id", F.coalesce("component", "key").alias("group"))


def verified_links(docs: DataFrame, wanted: DataFrame, names: list[str], shingle: int, similarity: float, radius: int) -> DataFrame:
    """A forest (a, b) of text keys over the pairs of each component that are within the radius and
    whose shingle sets have the given Jaccard similarity.

    wanted: key, id, component, blocks and the fingerprint words of the texts in question."""
    width = len(names)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(batch.num_columns - 1))
            for i, j in chunks(offsets):
                found = [np.unique(shingle_hashes(data[offsets[k] : offsets[k + 1]].tobytes(), shingle, 7)).tobytes() for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)), pa.array(found, pa.binary())], names=[*batch.schema.names[:-1], "grams"])

    # One row of each text: joined on id and key, so that the copies of one text do not meet in one task.
    one = docs.join(wanted.select(F.col("id").alias("__id"), F.col("key").alias("__key"), "component", "blocks", *names), (F.col("key") == F.col("__key")) & F.col("id").eqNullSafe(F.col("__id")))
    one = one.dropDuplicates(["key", "id"]).select("key", "component", "blocks", *names, "text")
    grams = one.mapInArrow(sets, "key string, component string, blocks int, " + ", ".join(f"{c} long" for c in names) + ", grams binary")
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    spread = grams.withColumn("block", mine).select(
        "key", "component", *names, "grams", "block", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("low"), F.greatest(o, F.col("block")).alias("high")))).alias("pair")
    )
    spread = spread.select("key", "component", *names, "grams", "pair.low", "pair.high", "block")
    part = F.pmod(F.xxhash64("component", "low", "high"), F.lit(4 * shuffle_partitions(docs.sparkSession)))

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        small, large = sorted((len(x), len(y)))
        if small < similarity * large:
            return False
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return shared >= similarity * (len(x) + len(y) - shared) - 1e-9

    def judge(table: pa.Table) -> pa.Table:
        keys, owner = table.column("key").to_pylist(), table.column("component").to_pylist()
        low, high, block = (table.column(c).to_numpy() for c in ("low", "high", "block"))
        words = np.stack([table.column(c).to_numpy().view(np.uint64) for c in names], axis=1).reshape(-1, width)
        grams = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("grams")]
        groups: dict[tuple, list[int]] = {}
        for k, (c, i, j) in enumerate(zip(owner, low.tolist(), high.tolist(), strict=True)):
            groups.setdefault((c, i, j), []).append(k)
        a, b = [], []
        pop = np.bitwise_count(words).sum(axis=1)
        for (_, i, j), rows in groups.items():
            rows = np.array(rows)
            rows = rows[np.argsort(pop[rows], kind="stable")]
            left, right = (rows[block[rows] == i], rows[block[rows] == j]) if i != j else (rows, None)
            place = np.concatenate([left, right]) if right is not None else left
            if len(place) < 2 or (right is not None and not (len(left) and len(right))):
                continue
            forest = Forest(len(place))
            for x, y in tile_links(words[left], radius, None if right is None else words[right], 256):
                y = y if right is None else y + len(left)
                while len(x):
                    open_ = forest.root[x] != forest.root[y]
                    x, y = x[open_], y[open_]
                    for p, q in zip(x[:256].tolist(), y[:256].tolist(), strict=True):
                        if forest.root[p] != forest.root[q] and similar(grams[place[p]], grams[place[q]]):
                            forest.link(np.array([p]), np.array([q]))
                    x, y = x[256:], y[256:]
            child, root = forest.pairs()
            a += [keys[place[k]] for k in child]
            b += [keys[place[k]] for k in root]
        return pa.Table.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], schema=_EDGES)

    return spread.withColumn("part", part).groupBy("part").applyInArrow(judge, "a string, b string")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """df with one row of each near-duplicate group: the one with the least id (of several rows of that
    id, one of the least text digest). Rows with a null id stay only in groups without any id."""
    names = df.columns
    groups = near_duplicate_groups(df, id_col, text_col, shingle, similarity, radius)
    # The least (has no id, id, key) of each group.
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("x"))
    kept = first.select(F.col("x.id").alias("__id"), F.col("x.key").alias("__key"))
    # Inner names that no column of df has.
    inner = "__"
    while any(c.startswith(inner) for c in names):
        inner += "_"
    key, doc = f"{inner}text_key", f"{inner}doc"
    mine = df.withColumn(key, text_key(text_col)).withColumn(doc, F.col(f"`{id_col}`").cast("long"))
    out = mine.join(kept, (mine[key] == kept["__key"]) & mine[doc].eqNullSafe(kept["__id"]), "left_semi")
    return out.dropDuplicates([key, doc]).select(*(f"`{c}`" for c in names))
