"""Exact nearest units of many query vectors, both sides distributed.

Units are dealt to cells around centres that are fitted on a bounded sample, and packed into blocks in the order
of their angle to the centre. A query meets first the cells that hold its likeliest k units; the k-th score
found there is a floor. A cell (and inside it a block) is met after that only if the triangle inequality of
angles leaves room for a score at or above the floor. What is skipped cannot change the result, so the centres
only decide how much is skipped.

No query, unit or result passes through the driver: it sees the sample and one row of bounds a cell. A cell's
blocks are dealt over salts, so a cell with a third of all units is many tasks' work; units with equal vectors
are parted by id. Rows of queries are packed per cell too, and only scores at or above the floor leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.storage import bounded_batches, scratch_table, shuffle_partitions

#: The sample that centres are fitted on, the most centres, rounds of fitting.
SAMPLE, CENTRES, ROUNDS = 4096, 256, 4
#: Rows of a block of units and of queries, and blocks of units that share a salt.
UNITS, QUERIES, BLOCKS = 1024, 256, 32
#: Room for rounding in bounds.
SLACK = 1e-9

_BLOCK = "cell int, first long, nearest double, furthest double, least double, most double, n int, ids binary, notes binary, factors binary, vectors binary"
_ROUTE = "cell int, query_id long, floor double, vector binary"
_ASKED = "cell int, salt int, ids binary, floors binary, vectors binary"
_FOUND = "query_id long, unit_id long, note_uid long, cosine double, score double"


@dataclass(frozen=True)
class Cells:
    """Units in cells. The last cell holds zero vectors, which have no direction. bounds: per cell nearest and
    furthest angle to its centre, least and greatest factor; sizes: units; salts: over how many it is dealt."""

    dims: int
    centres: np.ndarray
    blocks: DataFrame
    bounds: np.ndarray
    sizes: np.ndarray
    salts: list[int]


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split(" ") for f in ddl.split(", "))])


def _rows(batch: pa.RecordBatch, name: str = "vector") -> np.ndarray:
    """Vectors of a batch as float64 rows; vectors of several lengths are an error."""
    col = batch.column(name)
    sizes = set(np.asarray(col.value_lengths()).tolist())
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _matrix(blob: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(-1, dims)


def _unit_length(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(norms > 0, norms, 1.0)[:, None], norms


def fit_centres(vectors: np.ndarray, most: int = CENTRES, rounds: int = ROUNDS) -> np.ndarray:
    """Unit vectors around which the sample lies: spherical k-means from its first rows."""
    rows, norms = _unit_length(vectors)
    rows = rows[norms > 0]
    centres = rows[: max(1, min(most, int(len(rows) ** 0.5)))]
    for _ in range(rounds if len(rows) else 0):
        home = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        moved, norms = _unit_length(sums)
        centres = np.where((norms > 0)[:, None], moved, centres)
    return centres


def angles(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ centres.T, -1.0, 1.0))


def highest(angle: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per query (row) and group (column) the highest score that the bounds allow. angle: query to centre;
    bounds: columns nearest, furthest, least, most."""
    near, far, least, most = bounds.T
    close = np.cos(np.maximum(np.maximum(angle - far, near - angle), 0.0))
    away = np.cos(np.minimum(angle + far, np.pi))
    return np.maximum.reduce([close * most, close * least, away * most, away * least]) + SLACK


def build_cells(units: DataFrame, dims: int | None = None) -> Cells:
    """Cells of units (unit_id, note_uid, factor, vector); units without a vector stay out."""
    spark = units.sparkSession
    bounded_batches(spark)
    plain = units.where(F.col("vector").isNotNull()).select(F.col("unit_id").cast("long"), F.col("note_uid").cast("long"), F.col("factor").cast("double"), F.col("vector").cast("array<double>"))
    drawn = [r[0] for r in plain.orderBy(F.xxhash64("unit_id"), "unit_id").limit(SAMPLE).select("vector").collect()]  # at most SAMPLE rows
    if drawn and len({len(v) for v in drawn}) > 1:
        raise ValueError(f"vectors of different lengths: {sorted({len(v) for v in drawn})}")
    dims = len(drawn[0]) if drawn else dims or 1
    centres = fit_centres(np.array(drawn, dtype=np.float64).reshape(-1, dims))
    if not len(centres):
        centres = np.eye(1, dims)
    last = len(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, norms = _unit_length(_rows(batch))
            if rows.shape[1] != dims:
                raise ValueError(f"vectors of different lengths: {sorted({rows.shape[1], dims})}")
            away = angles(rows, centres)
            cell = away.argmin(axis=1)
            angle = away[np.arange(len(rows)), cell]
            none = norms == 0
            vectors = [r.tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(none, last, cell).astype(np.int32)), pa.array(np.where(none, 0.0, angle)), batch.column("unit_id"), batch.column("note_uid"), batch.column("factor"), pa.array(vectors, pa.binary())],
                names=["cell", "angle", "unit_id", "note_uid", "factor", "vector"],
            )

    homed = plain.mapInArrow(assign, "cell int, angle double, unit_id long, note_uid long, factor double, vector binary")
    order = ["cell", "angle", "unit_id"]
    ranged = homed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(_BLOCK)
        for cell, rows in _runs(batches, UNITS):
            angle, ids, notes, factors = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in rows]) for c in ("angle", "unit_id", "note_uid", "factor"))
            vectors = b"".join(v for p in rows for v in p.column("vector").to_pylist())
            ends = (0.0, np.pi) if cell == last else (float(angle.min()), float(angle.max()))
            values = [cell, int(ids[0]), *ends, float(factors.min()), float(factors.max()), len(ids), ids.astype(np.int64).tobytes(), notes.astype(np.int64).tobytes(), factors.tobytes(), vectors]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    blocks = scratch_table(ranged.mapInArrow(pack, _BLOCK))
    bounds, sizes, salts = np.tile([0.0, 0.0, 0.0, 0.0], (last + 1, 1)), np.zeros(last + 1, np.int64), [1] * (last + 1)
    per_cell = blocks.groupBy("cell").agg(F.min("nearest").alias("nearest"), F.max("furthest").alias("furthest"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"), F.count("*").alias("blocks"))
    for r in per_cell.collect():  # a row a cell
        bounds[r["cell"]] = (r["nearest"], r["furthest"], r["least"], r["most"])
        sizes[r["cell"]], salts[r["cell"]] = r["n"], -(-r["blocks"] // BLOCKS)
    # The cell of zero vectors takes any direction for its centre: its angles span everything.
    return Cells(dims, np.vstack([centres, np.eye(1, dims)]), blocks, bounds, sizes, salts)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of at most `most` rows of one cell from rows sorted by cell, as slices of the batches."""
    now, held, have = None, [], 0
    for batch in batches:
        cells = batch.column("cell").to_numpy(zero_copy_only=False)
        at = 0
        while at < len(cells):
            if held and (cells[at] != now or have == most):
                yield now, held
                held, have = [], 0
            now = int(cells[at])
            end = min(int(np.searchsorted(cells, now, side="right")), at + most - have)
            held.append(batch.slice(at, end - at))
            have += end - at
            at = end
    if held:
        yield now, held


def _homes(high: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Per query the cells with the highest bounds that together hold k units, as a mask."""
    order = np.argsort(-high, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    out = np.zeros(high.shape, bool)
    np.put_along_axis(out, order, before < k, axis=1)
    return out & (sizes > 0)


def routes(queries: DataFrame, cells: Cells, k: int, floors: bool) -> DataFrame:
    """(cell, query_id, floor, vector): without floors each query's home cells; with a column floor all other
    cells that could hold a score at or above it. Zero query vectors are an error."""
    dims, centres, bounds, sizes = cells.dims, cells.centres, cells.bounds, cells.sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, raw = batch.column("query_id").to_numpy(zero_copy_only=False), _rows(batch)
            if raw.shape[1] != dims:
                raise ValueError(f"vectors of {dims} places against queries of {raw.shape[1]}")
            rows, norms = _unit_length(raw)
            if not norms.all():
                raise ValueError(f"zero query vectors: {ids[norms == 0].tolist()}")
            high = highest(angles(rows, centres), bounds)
            home = _homes(high, sizes, k)
            floor = batch.column("floor").to_numpy(zero_copy_only=False) if floors else np.full(len(ids), -np.inf)
            q, cell = np.nonzero(~home & (sizes > 0) & (high >= floor[:, None]) if floors else home)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(ids[q]), pa.array(floor[q]), pa.array([rows[i].tobytes() for i in q], pa.binary())], schema=_schema(_ROUTE))

    return queries.mapInArrow(run, _ROUTE)


def search(routed: DataFrame, cells: Cells, k: int, tally: Accumulator | None = None) -> DataFrame:
    """(query_id, unit_id, note_uid, cosine, score): of the cells each query is routed to, its k best units at or
    above its floor, once for each salt. tally counts the pairs that were scored."""
    dims, centres, salts = cells.dims, cells.centres, cells.salts
    order = ["cell", "query_id"]
    ranged = routed.repartitionByRange(shuffle_partitions(routed.sparkSession), *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in _runs(batches, QUERIES):
            ids, floors = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in rows]).tobytes() for c in ("query_id", "floor"))
            vectors = b"".join(v for p in rows for v in p.column("vector").to_pylist())
            for salt in range(salts[cell]):
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([salt], pa.int32()), *(pa.array([b], pa.binary()) for b in (ids, floors, vectors))], schema=_schema(_ASKED))

    asked = ranged.mapInArrow(pack, _ASKED).select("cell", "salt", F.col("ids").alias("asked"), "floors", F.col("vectors").alias("asked_vectors"))
    salt = F.pmod(F.xxhash64("first"), F.get(F.array(*(F.lit(s) for s in salts)), F.col("cell"))).cast("int")
    pairs = asked.join(cells.blocks.withColumn("salt", salt), ["cell", "salt"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["asked"] != now:
                    if best is not None:
                        yield best.result()
                    now, best = row["asked"], _Best(np.frombuffer(row["asked"], np.int64), np.frombuffer(row["floors"], np.float64), _matrix(row["asked_vectors"], dims), k)
                done = best.meet(row, centres[row["cell"]], dims)
                if tally is not None:
                    tally.add(done)
        if best is not None:
            yield best.result()

    return pairs.mapInArrow(score, _FOUND)


class _Best:
    """The k best units so far of each query of a block; ties by unit id."""

    def __init__(self, ids: np.ndarray, floors: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.floors, self.vectors, self.k = ids, floors.copy(), vectors, k
        self.held: list[list[tuple[np.ndarray, ...]]] = [[] for _ in ids]
        self.count = np.zeros(len(ids), np.int64)

    def meet(self, block: dict, centre: np.ndarray, dims: int) -> int:
        bounds = np.array([[block["nearest"], block["furthest"], block["least"], block["most"]]])
        ask = np.flatnonzero(highest(angles(self.vectors, centre[None, :]), bounds)[:, 0] >= self.floors)
        if not len(ask):
            return 0
        units, notes, factors = (np.frombuffer(block[c], t) for c, t in (("ids", np.int64), ("notes", np.int64), ("factors", np.float64)))
        cosine = np.round(self.vectors[ask] @ _matrix(block["vectors"], dims).T, 12)
        scores = np.round(cosine * factors, 12)
        for at, q in enumerate(ask.tolist()):
            found = np.flatnonzero(scores[at] >= self.floors[q])
            if len(found):
                self.held[q].append((units[found], notes[found], cosine[at][found], scores[at][found]))
                self.count[q] += len(found)
                if self.count[q] > 4 * self.k:
                    self._cut(q)
        return len(ask) * len(units)

    def _cut(self, q: int) -> tuple[np.ndarray, ...]:
        units, notes, cosine, scores = (np.concatenate(c) for c in zip(*self.held[q], strict=True))
        keep = np.lexsort((units, -scores))[: self.k]
        self.held[q], self.count[q] = [(units[keep], notes[keep], cosine[keep], scores[keep])], len(keep)
        if len(keep) == self.k:
            self.floors[q] = max(self.floors[q], scores[keep[-1]])
        return self.held[q][0]

    def result(self) -> pa.RecordBatch:
        asked = [(q, self._cut(q)) for q in range(len(self.ids)) if self.held[q]]
        columns = [np.concatenate([np.full(len(c[0]), self.ids[q]) for q, c in asked]) if asked else np.zeros(0, np.int64)]
        columns += [np.concatenate([c[i] for _, c in asked]) if asked else np.zeros(0, np.int64 if i < 2 else np.float64) for i in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_schema(_FOUND))


def _floors(found: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): the k-th best score found so far; minus infinity where there are fewer."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id"))
    kth: Column = F.max(F.when(F.col("place") == k, F.col("score")))
    return found.select("query_id", "score", place.alias("place")).groupBy("query_id").agg(F.coalesce(kth, F.lit(float("-inf"))).alias("floor"))


def nearest(units: DataFrame | Cells, queries: DataFrame, k: int, tally: Accumulator | None = None) -> DataFrame:
    """(query_id, unit_id, note_uid, cosine, score): for each query at least its k best units, score being
    cosine x factor. units: (unit_id, note_uid, factor, vector), or their cells; queries: (query_id, vector).

    Both figures are rounded to twelve places, so that equal vectors score equally in any block. Vectors of
    different lengths and zero query vectors are errors. Queries without a vector have no row; repeated query
    ids are one query only if their vectors are equal, so ids must be unique."""
    cells = units if isinstance(units, Cells) else build_cells(units)
    asked = queries.where(F.col("vector").isNotNull()).select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"))
    first = scratch_table(search(routes(asked, cells, k, False), cells, k, tally))
    rest = asked.join(_floors(first, k), "query_id")
    return first.unionByName(search(routes(rest, cells, k, True), cells, k, tally))
