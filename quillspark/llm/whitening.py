"""Embedding whitening with exact sums (operator 12).

Entries become integers x = floor(1024 c) + 100000, so every sum can be exact:

1. n and the sums S per dimension are added by Spark (decimal).
2. With the whole-number centre c = floor(S / n) and remainder R = S - n c, each vector is y = x - c, and
   n x - S = n y - R. The Gram matrix of y is what the covariance needs, centred before multiplying:
   V = sum(y y') / n - R R' / n^2.
3. Digit-slice GEMM: a task splits y into limbs of 20 bits (the highest one signed) and multiplies limbs in
   blocks of 4096 rows with float64 BLAS: products below 2^40, sums below 2^52, so nothing is rounded. Limb
   products are recombined as big integers, one d x d matrix a task, and handed on as two decimals an entry.
4. Spark adds the tasks' matrices. The driver sees d (d + 1) / 2 entries, however many rows there are, divides
   big integers into correctly rounded doubles and decomposes the matrix.
5. Rows are projected in a second pass; a third one measures the covariance of what came out.

Defined results. A vector that is null, empty, or holds null or non-finite entries, or entries beyond 2^62 / 1024
in size (no long holds their x with room to subtract), is dropped. Vectors of different lengths are an error.
Null and repeated ids and extra columns do not matter; repeated rows count each time. Components whose
variance is nothing but rounding (at most 1e-12 of the largest) have null in `whitened` and do not count for the
identity error. With no variance at all `explained` is null. Each component's sign makes its entry of greatest size
positive (the first of equals). The deviation is exact, decimal(38,0), null beyond 38 digits. Empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._util import scratch_table

SCALE, SHIFT = 1024, 100_000
LIMB, BLOCK = 20, 4096
COMPONENTS = 8
#: A component is nothing but rounding if its variance is at most this share of the largest.
RANK = 1e-12
_HALF = 1 << 64
_DIGITS = 10**38


def entries(vector: Column) -> Column:
    """x of each entry; null for a vector that cannot be used."""
    doubles = vector.cast("array<double>")
    fit = F.exists(doubles, lambda v: F.isnull(v) | F.isnan(v) | (F.abs(v) >= float(2**62 // SCALE)))
    usable = (F.size(doubles) > 0) & ~F.coalesce(fit, F.lit(True))
    return F.when(usable, F.transform(doubles, lambda v: F.floor(v * SCALE).cast("long") + SHIFT))


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as float64 digits to base 2^20, lowest first, until nothing is left; the last is signed."""
    out, rest = [], y
    while True:
        high = rest >> LIMB
        if ((high == 0) | (high == -1)).all():
            return [*out, rest.astype(np.float64)]
        out.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = high


def gram(y: np.ndarray) -> np.ndarray:
    """The exact d x d matrix of sums y_i y_j, as Python integers (object array)."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for at in range(0, len(y), BLOCK):
        digits = limbs(y[at : at + BLOCK])
        for i, a in enumerate(digits):
            for j, b in enumerate(digits[: i + 1]):
                product = (a.T @ b).astype(np.int64).astype(object)  # exact: below 2^53
                total += (product if i == j else product + product.T) << (LIMB * (i + j))
    return total


def _shifted(batch: pa.RecordBatch, centre: np.ndarray) -> np.ndarray:
    """y of a batch's vectors as int64 rows."""
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) - centre if batch.num_rows else np.zeros((0, len(centre)), np.int64)


def exact_sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """n and the sum of each dimension. Pairs (dimension, sum) are combined in the tasks: dims rows each."""
    sums = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    by_place = {r["j"]: (r["n"], int(r["s"])) for r in sums}
    return by_place[0][0], [by_place[j][1] for j in range(dims)]


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """V in correctly rounded doubles, from exact integers."""
    dims = len(sums)
    centre = np.array([s // n for s in sums], dtype=np.int64)
    rest = [s - n * int(c) for s, c in zip(sums, centre.tolist(), strict=True)]
    upper = np.triu_indices(dims)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                mine = gram(_shifted(batch, centre))
                total = mine if total is None else total + mine
        if total is not None:
            whole = total[upper].tolist()
            high, low = [v >> 64 for v in whole], [v & (_HALF - 1) for v in whole]
            wide = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(whole)), pa.int32()), _decimals(high), _decimals(low)], schema=pa.schema([("entry", pa.int32()), ("high", wide), ("low", wide)]))

    parts = rows.select("x").mapInArrow(multiply, "entry int, high decimal(38,0), low decimal(38,0)")
    added = parts.groupBy("entry").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # dims (dims + 1) / 2 rows
    out = np.zeros((dims, dims))
    for r in added:
        i, j = int(upper[0][r["entry"]]), int(upper[1][r["entry"]])
        # n^2 V = n sum(y y') - R R', both whole numbers; Python divides them correctly rounded.
        out[i, j] = out[j, i] = (n * ((int(r["high"]) << 64) + int(r["low"])) - rest[i] * rest[j]) / (n * n)
    return out


def _decimals(values: list[int]) -> pa.Array:
    from decimal import Decimal

    return pa.array([None if abs(v) >= _DIGITS else Decimal(v) for v in values], pa.decimal128(38, 0))


def components(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(variances, unit vectors as columns, trace): the `most` largest, by falling variance."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    largest = np.abs(vectors).argmax(axis=0)
    signs = np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return values, vectors * signs, float(np.trace(matrix))


def squared_deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int]:
    """Per row the exact sum of (n y - R)^2; in 64 bits where they are proven to hold it, else in big integers."""
    size = n * int(np.abs(y).max(initial=0)) + max((abs(r) for r in rest), default=0)
    wide = size * size * max(1, y.shape[1]) < 1 << 63
    away = (y if wide else y.astype(object)) * n - np.array(rest, dtype=np.int64 if wide else object)
    return (away * away).sum(axis=1).tolist()


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(id_col, n, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error): a
    row for each usable vector, places 0 to most - 1 of the arrays being components 1 to most."""
    spark = df.sparkSession
    usable = df.select(F.col(f"`{id_col}`").alias("__id"), entries(F.col(f"`{vector_col}`")).alias("x")).where(F.col("x").isNotNull())
    rows = scratch_table(usable)
    id_type = rows.schema["__id"].dataType.simpleString()
    sizes = rows.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if sizes["least"] is None:
        return spark.createDataFrame([], f"`{id_col}` {id_type}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    if sizes["least"] != sizes["most"]:
        raise ValueError(f"vectors of {sizes['least']} to {sizes['most']} places")
    n, sums = exact_sums(rows, sizes["least"])
    centre = np.array([s // n for s in sums], dtype=np.int64)
    rest = [s - n * int(c) for s, c in zip(sums, centre.tolist(), strict=True)]
    values, vectors, trace = components(covariance(rows, n, sums), most)
    real = values > RANK * max(float(values[0]), 0.0)
    scale = vectors / np.sqrt(np.where(real, values, 1.0))
    mean = np.array([r / n for r in rest])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _shifted(batch, centre)
            placed = (y - mean) @ scale
            mask = np.broadcast_to(~real, placed.shape)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(placed.reshape(-1), mask=mask.reshape(-1)), len(values)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), _decimals(squared_deviations(y, n, rest)), lists], names=["__id", "deviation", "whitened"])

    out = scratch_table(rows.mapInArrow(project, f"__id {id_type}, deviation decimal(38,0), whitened array<double>"))
    kept = [k for k in range(len(values)) if real[k]]
    place = lambda k: F.get("whitened", F.lit(k))
    shares = F.array(*(F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values))
    if kept:
        # Spark's covariance centres before it multiplies, and merges tasks' figures.
        off = [F.abs(F.covar_pop(place(i), place(j)) - (1.0 if i == j else 0.0)) for i in kept for j in kept if j <= i]
        worst = F.lit(float(max(out.agg(*off).first())))
    else:
        worst = F.lit(None).cast("double")
    return out.select(F.col("__id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), worst.alias("identity_error"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vector and component. The deviation is a long; null where a long cannot hold it."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = out.select("vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("k")).alias("explained"), "identity_error")
