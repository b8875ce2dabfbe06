"""Language identification by error-correcting output codes (operator 3).

Each language gets a codeword of bits; for each bit a binary classifier over hashed byte n-grams says
which half the text's language is in. Decoding sums the logistic losses of the bits against each
codeword, weighted by how well each bit classifier does on its training texts, and takes the codeword
with the least loss; a small margin to the second marks the prediction as ambiguous.

Features of a text are counts over the whole text, never a prefix. Every language of the labelled rows
is learned, from a bounded sample: at most `per_language` texts of each (parameter). The classifiers of
all bits are fitted on the executors, on blocks of at most `block_rows` feature vectors, and averaged
over the blocks bit by bit; the driver sees the language names and the averaged weights only.

Learning: rows whose crc32 of the id as text is not 2 modulo 4, with language and text. Defined
results. Null text or text without a letter: `und`, score 0, not ambiguous. Null ids are never
learned from and count as not held out. With no rows to learn from (as in an empty table) every text is
`und`; with one language every text with a letter is of it. Repeated rows get equal predictions. Of
equal losses the first language by name is taken, marked ambiguous. Very long texts are counted in
slices, whole. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm._util import bounded_batches, checkpointed, chunks, small, text_view

ORDERS = (2, 3)
BUCKETS = 8192
PER_LANGUAGE = 300
BLOCK_ROWS = 2400
AMBIGUOUS_MARGIN = 0.5

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[9:14] = 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def features(text: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams of one text, as a unit vector."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), 1 << 18):
        part = _FOLD[text[at : at + (1 << 18) + max(ORDERS) - 1]]
        for order in ORDERS:
            n = min(len(part) - order + 1, 1 << 18)
            if n > 0:
                gram = part[:n].copy()
                for k in range(1, order):
                    gram <<= np.uint32(8)
                    gram |= part[k : k + n]
                gram *= np.uint32(2654435761)
                gram >>= np.uint32(19)
                counts += np.bincount(gram, minlength=BUCKETS)
    total = counts.sum()
    return np.sqrt(counts / max(total, 1)).astype(np.float32)


def has_letter(text: np.ndarray) -> bool:
    return bool(_LETTER[text].any()) or any(c.isalpha() for c in text.tobytes().decode())


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of -1/+1 bits: all different splits for up to five languages, else the seeded random
    code of 10 log2 k bits with the greatest least distance among 200."""
    if k <= 1:
        return np.ones((k, 0), np.float32)
    if k <= 5:
        bits = np.arange(1, 1 << (k - 1))
        return np.array([[1 if (b << 1 | 0) >> c & 1 else -1 for b in bits] for c in range(k)], np.float32)
    rng, n, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), None
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), size=(k, n))
        apart = (n - code @ code.T) / 2
        np.fill_diagonal(apart, n)
        worth = (apart.min(), -abs(code.sum(axis=0)).max())
        if abs(code.sum(axis=0)).max() < k and (best is None or worth > best[0]):
            best = (worth, code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Logistic losses of all bits against each codeword, weighted by trust."""
        margins = x @ self.weights + self.bias
        one, zero = self.code.T > 0, self.code.T < 0
        return (np.logaddexp(0, -margins) * self.trust) @ one + (np.logaddexp(0, margins) * self.trust) @ zero

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its score in 0..1, and whether the second is close."""
        loss = self.losses(x)
        best = loss.argmin(axis=1)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        score = 1 / share.sum(axis=1)
        if loss.shape[1] > 1:
            two = np.partition(loss, 1, axis=1)
            return best, score, two[:, 1] - two[:, 0] < AMBIGUOUS_MARGIN
        return best, score, np.zeros(len(best), bool)


def fit_bits(x: np.ndarray, row: np.ndarray, code: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge-penalised logistic regressions for all bits at once, by accelerated gradient steps.

    row: the language of each vector, a row of code. Returns weights, bias and the share of each bit
    that comes out right on x. Languages count alike, whatever their number of vectors."""
    bits = code[row]
    balance = (1 / np.bincount(row, minlength=len(code))[row])[:, None].astype(np.float32)
    balance /= max(balance.sum(), 1e-9)
    w = np.zeros((BUCKETS, code.shape[1]), np.float32)
    b = np.zeros(code.shape[1], np.float32)
    vw, vb, rate, decay = np.zeros_like(w), np.zeros_like(b), np.float32(30.0), np.float32(1e-5)
    for _ in range(rounds if code.shape[1] else 0):
        margin = bits * (x @ w + b)
        slope = -bits * balance / (1 + np.exp(np.clip(margin, -30, 30)))
        vw = 0.9 * vw - rate * (x.T @ slope + decay * w)
        vb = 0.9 * vb - rate * slope.sum(axis=0)
        w, b = w + vw, b + vb
    return w, b, ((x @ w + b) * bits > 0).mean(axis=0)


def model_of(languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, right: np.ndarray) -> Model:
    trust = np.log((right + 0.01) / (1.01 - right)).clip(0.05)
    return Model(languages, code, weights, bias, (trust / max(trust.sum(), 1e-9) * max(1, len(trust))).astype(np.float32))


def held_out(id_column: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, block_rows: int = BLOCK_ROWS) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    bounded_batches(df.sparkSession)
    known = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), F.col(f"`{lang_col}`").cast("string").alias("__lang"))
    known = known.where("__id is not null and __lang is not null and __text is not null").where(~held_out("__id"))
    counts = checkpointed(known.groupBy("__lang").agg(F.count("*").alias("__rows")))
    languages = sorted(r[0] for r in counts.select("__lang").collect())  # names only
    code = codewords(len(languages))
    if not code.shape[1]:
        return model_of(languages, code, np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), np.ones(0))
    # A seeded share of each language that leaves a few times the bound, then the bound itself.
    draw = F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.join(small(counts), "__lang").where(draw * F.col("__rows") < 3.0 * per_language).drop("__rows")
    first = Window.partitionBy("__lang").orderBy(F.xxhash64("__id", F.lit(11)), "__id")
    chosen = drawn.select("__id", "__lang").withColumn("__n", F.row_number().over(first)).where(f"__n <= {per_language}").select("__id").distinct()
    sample = drawn.join(small(checkpointed(chosen)), "__id", "left_semi").select("__text", "__lang")
    blocks = -(-per_language * len(languages) // block_rows)
    schema = pa.schema([("block", pa.int32()), ("row", pa.int64()), ("vector", pa.binary())])
    place = {name: k for k, name in enumerate(languages)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(0))
            out: tuple[list, list, list] = [], [], []
            for a, b, lang in zip(offsets[:-1], offsets[1:], batch.column(1).to_pylist(), strict=True):
                if has_letter(data[a:b]):
                    vector = features(data[a:b]).astype(np.float16).tobytes()
                    for column, value in zip(out, (zlib.crc32(vector) % blocks, place[lang], vector), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    def fit_block(table: pa.Table) -> pa.Table:
        x = np.stack([np.frombuffer(v.as_buffer(), np.float16) for v in table.column("vector")]).astype(np.float32)
        order = np.lexsort((*x[:, :8].T, table.column("row").to_numpy()))  # as the rows arrive in any order
        w, b, right = fit_bits(x[order], table.column("row").to_numpy()[order], code)
        bits = np.arange(code.shape[1], dtype=np.int32)
        packed = [np.append(w[:, k], (b[k], right[k])).astype(np.float32).tobytes() for k in bits]
        return pa.table({"bit": bits, "n": np.full(len(bits), len(x)), "weights": pa.array(packed, pa.binary())})

    def average(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        parts = np.stack([np.frombuffer(v.as_buffer(), np.float32) for v in table.column("weights")])
        return pa.table({"bit": table.column("bit").combine_chunks().slice(0, 1), "weights": pa.array([np.average(parts, axis=0, weights=n).astype(np.float32).tobytes()], pa.binary())})

    fitted = sample.mapInArrow(vectors, "block int, row long, vector binary").groupBy("block").applyInArrow(fit_block, "bit int, n long, weights binary")
    found = {r["bit"]: np.frombuffer(r["weights"], np.float32) for r in fitted.groupBy("bit").applyInArrow(average, "bit int, weights binary").collect()}  # 32 KB a bit
    none = np.zeros(BUCKETS + 2, np.float32)
    flat = np.stack([found.get(k, none) for k in range(code.shape[1])], axis=1)
    return model_of(languages, code, flat[:-2], flat[-2], flat[-1].astype(np.float64))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score, ambiguous) for each row; reads only id and text."""
    bounded_batches(df.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            for i, j in chunks(offsets, rows=2000):
                texts = [data[a:b] for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)]
                known = np.array([bool(model.languages) and has_letter(t) for t in texts])
                best, score, close = np.full(j - i, len(names) - 1), np.zeros(j - i), np.zeros(j - i, bool)
                at = np.flatnonzero(known)
                if len(at):
                    best[at], score[at], close[at] = model.predict(np.stack([features(texts[k]) for k in at]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names[best], pa.string()), pa.array(score.astype(float)), pa.array(close)], schema=schema)

    out = docs.mapInArrow(run, "id long, lang_pred string, score double, ambiguous boolean")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs, "doc_id", "text", "lang"))
