"""Calls of language-model servers as a Spark job, and the grid of questions and regimes that asks them.

Every cell (question, regime) is asked until its answer is stored once: the ledger is a table that each batch of
answers is appended to, and a run asks only what the ledger lacks. Executors call the server, `at_once` tasks at
a time, with waits that double between tries; a cell that still fails is stored with its error and asked again
by the next run. A task that Spark repeats asks its batch's cells again, as a call cannot be taken back.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import retrieve, service
from quillspark.plans.regimes import resolve
from quillspark.sources.storage import exists, scratch_table

LEDGER = "question_id string, regime string, answer string, error string, tries int, seconds double"


@dataclass(frozen=True)
class ChatServer:
    """A server with one of two public protocols: `ollama` (/api/chat) or `openai` (/chat/completions with a key)."""

    url: str
    model: str
    kind: str = "ollama"
    key: str = ""
    temperature: float = 0.2
    max_tokens: int = 1500
    window: int = 8192
    timeout: float = 300.0

    def _post(self, messages: list[dict], stream: bool):
        asked: dict = {"model": self.model, "messages": messages, "stream": stream}
        if self.kind == "openai":
            if not self.key:
                raise ValueError(f"{self.model} needs a key")
            where, asked = "/chat/completions", asked | {"temperature": self.temperature, "max_tokens": self.max_tokens}
        elif self.kind == "ollama":
            where, asked = "/api/chat", asked | {"options": {"temperature": self.temperature, "num_predict": self.max_tokens, "num_ctx": self.window}}
        else:
            raise ValueError(f"unknown kind of server {self.kind!r}")
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url.rstrip("/") + where, json.dumps(asked).encode(), head)
        try:
            return urllib.request.urlopen(request, timeout=self.timeout)
        except urllib.error.HTTPError as e:
            raise ConnectionError(f"{self.model} at {self.url} answered {e.code}: {e.read(200).decode(errors='replace')}") from e
        except urllib.error.URLError as e:
            raise ConnectionError(f"{self.url} cannot be reached: {e.reason}") from e

    def __call__(self, messages: list[dict]) -> str:
        """The whole answer."""
        with self._post(messages, False) as reply:
            told = json.load(reply)
        return told["choices"][0]["message"]["content"] if self.kind == "openai" else told["message"]["content"]

    def stream(self, messages: list[dict]) -> Iterator[str]:
        """The answer in pieces as they come; lines that are no JSON are passed over."""
        with self._post(messages, True) as reply:
            for raw in reply:
                line = raw.decode(errors="replace").strip()
                line = line.removeprefix("data: ") if self.kind == "openai" else line
                if line == "[DONE]":
                    return
                try:
                    told = json.loads(line)
                    piece = told["choices"][0]["delta"].get("content") if self.kind == "openai" else told.get("message", {}).get("content")
                except (ValueError, KeyError, IndexError, TypeError, AttributeError):
                    continue
                if piece:
                    yield piece
                if self.kind != "openai" and told.get("done"):
                    return


def asked(call: Callable[[list[dict]], str], messages: list[dict], tries: int, wait: float) -> tuple[str | None, str | None, int]:
    """(answer, error, tries taken): connection faults are tried again after waits that double, others are not."""
    error = None
    for k in range(1, tries + 1):
        try:
            return call(messages), None, k
        except OSError as e:  # of which connection and timeout errors are
            error = f"{type(e).__name__}: {e}"
            if k < tries:
                time.sleep(wait * 2 ** (k - 1))
        except Exception as e:
            return None, f"{type(e).__name__}: {e}", k
    return None, error, tries


def answered(path: str, cells: DataFrame) -> DataFrame:
    """The ledger's answers, each cell once (a repeated task may have stored one twice)."""
    spark = cells.sparkSession
    if not exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    good = spark.read.schema(LEDGER).parquet(path).where(F.col("error").isNull())
    return good.groupBy("question_id", "regime").agg(F.min_by(F.struct("answer", "tries", "seconds"), "answer").alias("a")).select("question_id", "regime", "a.*")


def run_calls(cells: DataFrame, path: str, call: Callable[[list[dict]], str], at_once: int = 8, tries: int = 4, wait: float = 0.5, commit_rows: int = 1000) -> DataFrame:
    """Ask every cell (question_id, regime, system, user) that the ledger at path has no answer for, and append
    what comes, about commit_rows cells a commit. Returns the answers of all cells so far."""
    keys = ["question_id", "regime"]
    named = cells.select(*(F.col(k).cast("string").alias(k) for k in keys), "system", "user").dropDuplicates(keys)
    missing = scratch_table(named.join(answered(path, cells).select(*keys), keys, "left_anti"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                began = time.perf_counter()
                answer, error, taken = asked(call, [{"role": "system", "content": row.system}, {"role": "user", "content": row.user}], tries, wait)
                yield pd.DataFrame([(row.question_id, row.regime, answer, error, taken, round(time.perf_counter() - began, 3))], columns=[f.split(" ")[0] for f in LEDGER.split(", ")])

    batches = -(-missing.count() // commit_rows)
    for k in range(batches):
        part = missing.where(F.pmod(F.xxhash64(*keys), F.lit(batches)) == k)
        part.repartition(at_once).mapInPandas(run, LEDGER).write.mode("append").parquet(path)
    return answered(path, cells)


def failures(path: str, cells: DataFrame) -> DataFrame:
    """(question_id, regime, error): the last error of each cell that still has no answer."""
    spark = cells.sparkSession
    if not exists(spark, path):
        return spark.createDataFrame([], "question_id string, regime string, error string")
    bad = spark.read.schema(LEDGER).parquet(path).where(F.col("error").isNotNull()).groupBy("question_id", "regime").agg(F.max("error").alias("error"))
    return bad.join(answered(path, cells).select("question_id", "regime"), ["question_id", "regime"], "left_anti")


def grid_prompts(archive: service.Archive, questions: DataFrame, regimes: Sequence[str], ledger: str | None = None, window_tokens: int = 8192, dims: int | None = None) -> DataFrame:
    """(question_id, regime, system, user) of all cells of questions (query_id long, query) and regimes that the
    ledger has no answer for. Regimes are walked one by one, as they are a handful; a regime retrieves for all its
    questions at once. Questions whose retrieval finds nothing have an empty context."""
    out = None
    for key in regimes:
        plan = resolve(key)
        left = questions.select(F.col("query_id").cast("long").alias("query_id"), "query")
        if ledger is not None:
            done = answered(ledger, questions).where(F.col("regime") == plan.key).select(F.col("question_id").cast("long").alias("query_id"))
            left = left.join(done, "query_id", "left_anti")
        vectors: DataFrame | tuple = ()
        if plan.retriever in ("vector", "pooled"):
            if archive.embed is None or dims is None:
                raise ValueError(f"{plan.key} needs an embedder and its number of places")
            texts = left.select(F.col("query_id").alias("unit_id"), F.col("query").alias("text"), F.lit(None).cast("string").alias("tree_path"), F.lit(None).cast("string").alias("caption"))
            vectors = scratch_table(service.embedded(texts, archive.embed, dims, context=False).select(F.col("unit_id").alias("query_id"), "vector"))
        hits = retrieve.retrieve(archive.corpus, plan, left, vectors).join(left.select("query_id", F.length("query").alias("asked_chars")), "query_id")
        fixed = sum(len(m["content"]) for m in service.messages("", "", plan))
        contexts = retrieve.context(retrieve.fit(hits, archive.corpus, plan, window_tokens, F.col("asked_chars") + fixed))
        whole = left.select("query_id").join(contexts, "query_id", "left").fillna("", ["context"])
        part = service.prompts(whole, left, plan).select(F.col("query_id").cast("string").alias("question_id"), F.lit(plan.key).alias("regime"), "system", "user")
        out = part if out is None else out.unionByName(part)
    return out
