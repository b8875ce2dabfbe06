"""URL filter over memory-mapped sorted digest arrays (operator 8).

Two lists decide. The first is a short table of strings with an action, given by the caller: `host` + `path
prefix` for rules, and single words of a host (no path: `casino` is a word of `m.casino-win.example.com`).
Spark sorts it by the 64-bit xxhash of the strings and writes it once to the shared folder; the files are
handed to each executor, which lays them out once as flat arrays on its own disk (keys, string ends, actions,
bytes) and maps them into memory. A URL asks for each of its host's suffixes joined with each prefix of its
path that has the length of some listed path, and for each word of its host; all questions of a batch are
answered by one vectorised binary search, and every hit is confirmed against the stored string, so a digest
collision never decides. The longest listed rule wins; on a tie the one with the longer host. Where no rule
fits, a blocked word of the host blocks.

The second is a list of whole URLs (host + path) that grows with the corpus, so no executor gets all of it:
its entries and the URLs that nothing has decided meet in slices of digests. A task's rows come in order,
entries first; they go to flat arrays of the task, which are mapped, and the URLs that follow are looked up
by the same search and confirmed. A URL that a sample shows to be a hot one is dealt over all slices by its
id, and its entry, if it has one, goes to all of them; the sample only places rows. `worthless_urls` learns
this list from pages: URLs of which no page passes the quality rules (operator 9). Everything else gets the
default action.

Defined results. Null URL or one without `://`: empty host and path, no rule, the default. A rule fits
its host and all subdomains if the path starts with the rule's path; an empty path starts with no
rule's `/`. Null ids and repeated rows are judged like any row. Other columns are ignored, whatever
their names. Very long URLs are judged whole. Of listed strings that repeat with different actions
`block` counts; null strings are passed over. An empty table gives an empty result, an empty list the
default for all. A page without html (null) says nothing about its URL; an empty one fails the rules.
"""

from __future__ import annotations

import functools
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import quality
from quillspark.llm._util import scratch_table, shuffle_partitions

# The rules of the query: (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Words of a host that block it: gambling, adult, pharmacy, spam and tracking sites name themselves.
BLOCKED_WORDS = (
    "casino casinos poker roulette slots jackpot betting bet bets lottery gambling adult porn porno xxx sex sexy nude escort escorts camgirls "
    "pills pill viagra cialis pharmacy steroids spam spammer malware phishing warez torrent cracked ads adserver tracker track banner popup clickbait replica"
)
DEFAULT = "allow"
ACTIONS = ("allow", "block")
REASONS = ("default", "rule", "word", "listed")
# What a page's text is without: scripts and styles (to the end, if never closed), then tags.
SCRIPTS = r"<script[^<>]*>.*?(</script>|\z)|<style[^<>]*>.*?(</style>|\z)"
TAGS = "<[^<>]*>"
#: Rows of the sample for each shuffle partition, and how many of them make a URL hot.
SAMPLE, HOT = 64, 16
SEED = 42  # of Spark's xxhash64
ROWS_A_FILE = 2_000_000
_TOP = np.uint64(1 << 63)


def default_list(spark: SparkSession) -> DataFrame:
    words = [("block", w, "") for w in BLOCKED_WORDS.split()]
    return spark.createDataFrame([*RULES, *words], "action string, host string, path string")


def sorted_list(listed: DataFrame, rows_a_file: int = ROWS_A_FILE) -> tuple[list[str], list[int], int]:
    """Sort a list (action, host, path) by digest into files of the shared folder. Returns the files
    in order, the different lengths of rule paths and the most labels of a rule's host."""
    text = F.concat("host", F.coalesce("path", F.lit("")))
    flat = listed.where("host is not null").groupBy(text.alias("text")).agg(F.max(F.when(F.col("action") == ACTIONS[1], 1).otherwise(0)).cast("int").alias("action"))
    # Spark orders signed numbers: the highest bit is turned for the order of unsigned ones.
    keyed = flat.select(F.xxhash64("text").bitwiseXOR(F.lit(-(1 << 63))).alias("key"), F.col("text").cast("binary").alias("text"), "action")
    files = max(1, -(-listed.count() // rows_a_file))
    table = scratch_table(keyed.repartitionByRange(files, "key").sortWithinPartitions("key", "text"))
    slash = F.expr("instr(cast(text as string), '/')")
    rules = table.where(slash > 0)
    paths = [r[0] for r in rules.select((F.octet_length("text") - F.octet_length(F.substring_index(F.col("text").cast("string"), "/", 1))).alias("n")).distinct().collect()]
    labels = rules.agg(F.max(F.size(F.split(F.substring_index(F.col("text").cast("string"), "/", 1), r"\.")))).first()[0]
    return sorted(table.inputFiles(), key=os.path.basename), sorted(paths), labels or 0


class Layout:
    """Flat arrays of a folder, written in the order of the digests."""

    def __init__(self, folder: str) -> None:
        os.makedirs(folder)
        self.files = {name: open(f"{folder}/{name}", "wb") for name in ("keys", "ends", "actions", "text")}
        self.end = 0

    def add(self, turned: np.ndarray, strings: list[bytes], actions: np.ndarray) -> None:
        """Entries by their digests, the highest bit turned."""
        ends = self.end + np.cumsum(np.fromiter(map(len, strings), np.uint64, len(strings)), dtype=np.uint64)
        parts = {"keys": turned.view(np.uint64) ^ _TOP, "ends": ends, "actions": actions.astype(np.uint8)}
        for name, values in parts.items():
            self.files[name].write(values.tobytes())
        self.files["text"].write(b"".join(strings))
        self.end = int(ends[-1]) if len(ends) else self.end

    def close(self) -> None:
        for file in self.files.values():
            file.close()


def lay_out(files: list[str], folder: str) -> None:
    """The sorted files as flat arrays in `folder`, a row group at a time."""
    layout = Layout(folder)
    for name in files:
        for batch in pq.ParquetFile(name).iter_batches(1 << 16):
            layout.add(batch.column("key").to_numpy(), batch.column("text").to_pylist(), batch.column("action").to_numpy())
    layout.close()


class DigestArray:
    """The mapped arrays of a folder."""

    def __init__(self, folder: str, paths: list[int], labels: int, digest=lambda s: xxhash.xxh64_intdigest(s, SEED)) -> None:
        def mapped(name: str, kind: type) -> np.ndarray:
            full = f"{folder}/{name}"
            return np.memmap(full, kind, "r") if os.path.getsize(full) else np.zeros(0, kind)

        self.digest, self.paths, self.labels = digest, paths, labels
        self.keys, self.ends, self.actions, self.text = mapped("keys", np.uint64), mapped("ends", np.uint64), mapped("actions", np.uint8), mapped("text", np.uint8)

    def string(self, k: int) -> bytes:
        return self.text[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])].tobytes()

    def find(self, asked: list[bytes]) -> list[int]:
        """The entry of each asked string, or -1."""
        out = [-1] * len(asked)
        if not len(self.keys) or not asked:
            return out
        digests = np.fromiter(map(self.digest, asked), np.uint64, len(asked))
        low, high = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        for q in np.flatnonzero(high > low).tolist():
            out[q] = next((k for k in range(low[q], high[q]) if self.string(k) == asked[q]), -1)
        return out

    def questions(self, host: bytes, path: bytes) -> list[tuple[bytes, int]]:
        """(string, length of its host) of every rule that would fit."""
        suffixes, end = [], len(host)
        for _ in range(self.labels):  # no listed host has more labels
            dot = host.rfind(b".", 0, end)
            suffixes.append(host[dot + 1 :])
            if dot < 0:
                break
            end = dot
        return [(s + path[:n], len(s)) for n in self.paths if n <= len(path) for s in suffixes]

    def judge(self, hosts: list[bytes], paths: list[bytes]) -> list[tuple[int, bool]]:
        """The winning rule for each URL, or -1, and whether a word of its host is blocked."""
        asked, of, width = [], [], []
        for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            mine = self.questions(host, path)
            words = {w for label in host.split(b".") for w in label.split(b"-") if w}
            asked += [s for s, _ in mine] + sorted(words)
            width += [n for _, n in mine] + [-1] * len(words)
            of += [k] * (len(mine) + len(words))
        best: list[tuple[int, int, int]] = [(-1, -1, -1)] * len(hosts)
        blocked = [False] * len(hosts)
        for k, entry, text, n in zip(of, self.find(asked), asked, width, strict=True):
            if entry >= 0 and n >= 0:
                best[k] = max(best[k], (len(text), n, entry))
            elif entry >= 0:
                blocked[k] |= bool(self.actions[entry])
        return [(b[2], w) for b, w in zip(best, blocked, strict=True)]


@functools.lru_cache(maxsize=4)
def _shipped(name: str, files: tuple[str, ...], paths: tuple[int, ...], labels: int) -> DigestArray:
    """The executor's arrays of a list, laid out beside the files that it was handed."""
    folder = os.path.join(SparkFiles.getRootDirectory(), name)
    if not os.path.isdir(folder):
        mine = f"{folder}-{uuid.uuid4().hex}"
        lay_out([SparkFiles.get(f) for f in files], mine)
        try:
            os.rename(mine, folder)
        except OSError:  # another worker was first
            shutil.rmtree(mine, ignore_errors=True)
    return DigestArray(folder, list(paths), labels)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as the contract cuts them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def plain_text(html: Column) -> Column:
    """A page's text: no scripts, no styles, no tags; entities stay as they are."""
    return F.regexp_replace(F.regexp_replace(html, "(?is)" + SCRIPTS, " "), TAGS, " ")


def worthless_urls(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path) of the URLs of which no page passes the quality rules."""
    host, path = split_url(F.col(f"`{url_col}`").cast("string"))
    html = F.col(f"`{html_col}`").cast("string")
    seen = pages.where(html.isNotNull()).select(F.struct(host.alias("host"), path.alias("path")).alias("at"), plain_text(html).alias("text"))
    judged = quality.quality_rules(seen, "at", "text")
    by_url = judged.groupBy("at.host", "at.path").agg(F.max("kept").alias("some_kept"))
    return by_url.where("host <> '' AND NOT some_kept").select("host", "path")


def _turned(text: Column) -> Column:
    return F.xxhash64(text).bitwiseXOR(F.lit(-(1 << 63)))


def refuse_listed(judged: DataFrame, listed: DataFrame, default: str = DEFAULT) -> DataFrame:
    """judged (__id, host, path, rule, verdict, reason), with `block` where the default decided and listed
    (host, path) holds the URL."""
    partitions = shuffle_partitions(judged.sparkSession)
    rows = scratch_table(judged.withColumn("key", _turned(F.concat("host", "path"))))
    undecided = rows.where((F.col("reason") == REASONS[0]) & (F.col("host") != ""))
    share = max(1, undecided.count() // (SAMPLE * partitions))
    drawn = undecided.where(F.pmod(F.xxhash64("__id", "key"), F.lit(share)) == 0)
    hot = F.broadcast(scratch_table(drawn.groupBy("key").count().where(F.col("count") >= HOT).select("key", F.lit(True).alias("hot"))))
    is_hot, by_key = F.coalesce("hot", F.lit(False)), F.pmod("key", F.lit(partitions)).cast("int")
    by_id = F.pmod(F.xxhash64("__id"), F.lit(partitions)).cast("int")
    asking = undecided.join(hot, "key", "left").select(F.when(is_hot, by_id).otherwise(by_key).alias("slice"), F.lit(1).alias("kind"), "key", F.lit(None).cast("binary").alias("text"), "__id", "host", "path")
    text = F.concat("host", "path")
    slices = F.when(is_hot, F.sequence(F.lit(0), F.lit(partitions - 1))).otherwise(F.array(by_key))
    entries = listed.where("host IS NOT NULL AND path IS NOT NULL").select(_turned(text).alias("key"), text.cast("binary").alias("text")).distinct().join(hot, "key", "left")
    entries = entries.select(F.explode(slices).alias("slice"), F.lit(0).alias("kind"), "key", "text", F.lit(None).cast("long").alias("__id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    met = entries.unionByName(asking).repartition(partitions, "slice").sortWithinPartitions("kind", "key").drop("slice")
    schema = pa.schema([("__id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("found", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = os.path.join(SparkFiles.getRootDirectory(), f"slice-{uuid.uuid4().hex}")
        layout, array = Layout(folder), None
        try:
            for batch in batches:
                n = batch.num_rows - int(batch.column("kind").to_numpy().sum())
                first, rest = batch.slice(0, n), batch.slice(n)
                if n:
                    layout.add(first.column("key").to_numpy(), first.column("text").to_pylist(), np.ones(n))
                if not rest.num_rows:
                    continue
                if array is None:
                    layout.close()
                    array = DigestArray(folder, [], 0)
                asked = [(h + p).encode() for h, p in zip(rest.column("host").to_pylist(), rest.column("path").to_pylist(), strict=True)]
                found = pa.array([k >= 0 for k in array.find(asked)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in ("__id", "host", "path")), found], schema=schema)
        finally:
            layout.close()
            shutil.rmtree(folder, ignore_errors=True)

    answers = met.mapInArrow(run, "__id long, host string, path string, found boolean")
    settled = rows.where((F.col("reason") != REASONS[0]) | (F.col("host") == "")).drop("key")
    verdict = F.when(F.col("found"), ACTIONS[1]).otherwise(default)
    reason = F.when(F.col("found"), REASONS[3]).otherwise(REASONS[0])
    return settled.unionByName(answers.select("__id", "host", "path", F.lit(None).cast("string").alias("rule"), verdict.alias("verdict"), reason.alias("reason")))


def filter_urls(df: DataFrame, listed: DataFrame | Iterable[tuple[str, str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, refused: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, reason) for each row, the id under its own name. listed: a short table
    (action, host, path), or a few such entries; none for the default list. refused: a table (host, path) of
    whole URLs of any size, which are blocked where no rule and no word decides."""
    spark = df.sparkSession
    if listed is None:
        listed = default_list(spark)
    elif not isinstance(listed, DataFrame):
        listed = spark.createDataFrame(list(listed), "action string, host string, path string")
    sources, paths, labels = sorted_list(listed)
    for f in sources:
        spark.sparkContext.addFile(f)  # each executor fetches one copy
    name, files = f"digests-{uuid.uuid4().hex}", tuple(os.path.basename(f) for f in sources)
    schema = pa.schema([("__id", pa.int64()), *((c, pa.string()) for c in ("host", "path", "rule", "verdict", "reason"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _shipped(name, files, tuple(paths), labels)
        for batch in batches:
            hosts, parts = ([s.encode() for s in c.to_pylist()] for c in (batch.column(1), batch.column(2)))
            won = array.judge(hosts, parts)
            rule = [array.string(k).decode() if k >= 0 else None for k, _ in won]
            verdict = [ACTIONS[array.actions[k]] if k >= 0 else ACTIONS[1] if word else default for k, word in won]
            reason = [REASONS[1] if k >= 0 else REASONS[2] if word else REASONS[0] for k, word in won]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in (rule, verdict, reason))], schema=schema)

    host, path = split_url(F.col(f"`{url_col}`").cast("string"))
    parts = df.select(F.col(f"`{id_col}`").cast("long").alias("__id"), host.alias("host"), path.alias("path"))
    out = parts.mapInArrow(run, "__id long, host string, path string, rule string, verdict string, reason string")
    if refused is not None:
        out = refuse_listed(out, refused, default)
    return out.select(F.col("__id").alias(id_col), "host", "path", "rule", "verdict", "reason")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, refused=worthless_urls(pages))


SQL = rf"""
WITH documents AS (SELECT page_id AS doc_id, regexp_replace(regexp_replace(html, '{SCRIPTS}', ' ', 'gis'), '{TAGS}', ' ', 'g') AS text FROM pages WHERE html IS NOT NULL),
q AS ({quality.oracle()}),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS host, coalesce(rest, '') AS rest FROM r),
p AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h),
u AS (SELECT host, path, NOT bool_or(kept) AND host <> '' AS listed FROM p JOIN q ON doc_id = page_id GROUP BY host, path),
l(rule, rhost, rpath, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN l ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
w AS (SELECT page_id, p.host, p.path, rule, verdict, CASE WHEN rule IS NOT NULL THEN 'rule'
  WHEN list_has_any(string_split_regex(p.host, '[.-]'), string_split('{BLOCKED_WORDS}', ' ')) THEN 'word' WHEN listed THEN 'listed' ELSE 'default' END AS reason
  FROM p LEFT JOIN m USING (page_id) LEFT JOIN u ON p.host = u.host AND p.path = u.path)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN reason = 'default' THEN 'allow' ELSE 'block' END) AS verdict, reason FROM w
"""
