"""Operators that work over ranges, blocks, rounds and segments, against plain Python."""

from __future__ import annotations

import cProfile
import json
import math
import random
import threading
import tracemalloc
import zlib
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions import rtf
from quillspark.functions.rtf import inflate, rtf_spans, to_rtf
from quillspark.operators import archive, calls, evaluate, export, lexical, neighbours, ordered, retrieve, segments, service, tree, treemap, units
from quillspark.plans.regimes import resolve
from quillspark.sources import storage

NODES = "page_id int, id long, parent_id long, sort_index int, caption string, chars long"


# Nearest units


def best(units, queries, k):
    out = {}
    for q, v in queries:
        v = np.array(v) / np.linalg.norm(v)
        scored = []
        for u, note, factor, w in units:
            w = np.array(w)
            length = np.linalg.norm(w)
            cosine = round(float(v @ (w / (length or 1))), 12)
            scored.append((-round(cosine * factor, 12), u))
        out[q] = [u for _, u in sorted(scored)[:k]]
    return out


def vectors(kind, n=400, dims=8):
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(12, dims))
    rows = [(i, i // 3, float(rng.choice([1.0, 1.5, 0.5])), (heads[i % 12] + rng.normal(size=dims) * 0.05).tolist()) for i in range(n)]
    if kind == "equal":
        rows = [(i, n_, 1.0, [1.0] * dims) if i % 3 else (i, n_, f, v) for i, n_, f, v in rows]
    if kind == "zeros":
        rows = [(i, n_, f, [0.0] * dims) if i % 3 == 0 else (i, n_, -f, v) for i, n_, f, v in rows]
    return rows, [(q * 100, (heads[q % 12] + 0.01).tolist()) for q in range(15)]


@pytest.mark.parametrize(("kind", "k"), [("clusters", 5), ("equal", 7), ("zeros", 300), ("clusters", 1000)])
def test_nearest_like_brute_force(spark, monkeypatch, kind, k):
    """Small blocks, so that cells have several and are dealt over salts."""
    monkeypatch.setattr(neighbours, "UNITS", 16)
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    monkeypatch.setattr(neighbours, "BLOCKS", 1)
    units, queries = vectors(kind)
    df = spark.createDataFrame([*units, (9999, 1, 1.0, None)], "unit_id long, note_uid long, factor double, vector array<float>")
    df = df.withColumn("vector", F.col("vector").cast("array<double>"))
    units = [(r.unit_id, r.note_uid, r.factor, r.vector) for r in df.collect() if r.vector]
    asked = spark.createDataFrame([*queries, (77, None)], "query_id long, vector array<double>")
    tally = spark.sparkContext.accumulator(0)
    top = lexical.top_per_query(neighbours.nearest(df, asked, k, tally), k).collect()
    got = {q: [r.unit_id for r in sorted(top, key=lambda r: r["rank"]) if r.query_id == q] for q, _ in queries}
    assert got == best(units, queries, k)
    assert {r.query_id for r in top} == {q for q, _ in queries}
    if k < 10 and kind == "clusters":
        assert 0 < tally.value < len(units) * len(queries) / 3


def test_nearest_of_nothing(spark):
    units = spark.createDataFrame([], "unit_id long, note_uid long, factor double, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")
    assert neighbours.nearest(units, asked, 3).collect() == [] and neighbours.nearest(units, asked.limit(0), 3).collect() == []


def test_zero_queries_are_an_error(spark):
    units = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0])], "unit_id long, note_uid long, factor double, vector array<double>")
    with pytest.raises(Exception, match="zero query vectors"):
        neighbours.nearest(units, spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, vector array<double>"), 3).collect()


# Keyword retrieval


def word_corpus(spark, n=300):
    rng = random.Random(8)
    frequent, rare = ["the", "and", "for"], [f"rare{k}" for k in range(150)]
    rows = [(i, " ".join(rng.choices(frequent, k=20) + rng.choices(rare, k=3) + (["it's"] if i % 5 == 0 else []))) for i in range(n)]
    asked = [(q, f"the and {rare[q]} for the rare{q + 20} it's") for q in range(10)] + [(50, "the and"), (51, "nothing at all here"), (52, "")]
    return spark.createDataFrame(rows, "unit_id long, text string"), spark.createDataFrame(asked, "query_id long, query string")


def test_bm25_top_like_exhaustive_scores(spark):
    units, asked = word_corpus(spark)
    index, size = lexical.build_index(units), lexical.corpus_size(units)
    key = ["query_id", "rank"]
    for k in (1, 7, 1000):
        want = lexical.top_per_query(lexical.bm25(index, size, asked), k).orderBy(*key).select("query_id", "unit_id", "rank", "score").collect()
        assert lexical.bm25_top(index, size, asked, k).orderBy(*key).select("query_id", "unit_id", "rank", "score").collect() == want


def test_units_scored_where_they_lie_like_exhaustive_scores(spark, monkeypatch):
    """Without an index: the rows of bm25(), ties of equal texts included, and no unit's words in a shuffle."""
    units, asked = word_corpus(spark)
    units = units.unionByName(units.select((F.col("unit_id") + 1000).alias("unit_id"), "text")).unionByName(spark.createDataFrame([(5000, None), (5001, "")], units.schema)).repartition(5)
    index, size = lexical.build_index(units), lexical.corpus_size(units)
    rows = lambda df: df.select("query_id", "unit_id", "rank", "score").orderBy("query_id", "rank").collect()
    for k in (1, 7, 1000):
        want = rows(lexical.top_per_query(lexical.bm25(index, size, asked), k))
        assert rows(lexical.bm25_where_they_lie(units, asked, k)) == want
    monkeypatch.setattr(lexical, "GAINS", 40)
    assert rows(lexical.bm25_where_they_lie(units, asked, 7)) == rows(lexical.bm25_top(index, size, asked, 7))
    monkeypatch.setattr(lexical, "BEST_ROWS", 1)
    assert rows(lexical.bm25_where_they_lie(units, asked, 7)) == rows(lexical.bm25_top(index, size, asked, 7))
    assert lexical.bm25_where_they_lie(units, asked.limit(0), 7).collect() == [] == lexical.bm25_where_they_lie(units.limit(0), asked, 7).collect()
    assert "Exchange" not in lexical.unit_phrases(spark.range(9).selectExpr("id AS unit_id", "'a b' AS text"), ["a", "a b"])._jdf.queryExecution().executedPlan().toString()


def test_frequent_words_open_no_candidate(spark):
    units, asked = word_corpus(spark)
    asked = asked.where("query_id < 10")
    index, size = lexical.build_index(units), lexical.corpus_size(units)
    phrases, postings = lexical.ranked_phrases(index, size, asked)
    found, judged = lexical.candidates(phrases, postings, 2)
    every = lexical.bm25(index, size, asked).count()
    assert every == 3000 and found.count() < every / 10
    assert {r.phrase for r in judged.where("NOT essential").collect()} >= {"the", "and", "for"}


def test_index_under_change(spark, tmp_path):
    path = str(tmp_path / "index")
    notes = {i: f"alpha w{i} w{i % 7}" for i in range(40)}
    df = lambda d: spark.createDataFrame(list(d.items()), "unit_id long, text string")

    def check():
        got = Counter({(r.term, r.unit_id): len(r.places) for r in segments.postings(spark, path).collect()})
        assert got == Counter((w, i) for i, t in notes.items() for w in (t or "").split())
        size = segments.size(spark, path).first()
        assert size.n_units == len(notes) and size.avg_length == pytest.approx(sum(len((t or "").split()) for t in notes.values()) / len(notes))

    assert segments.postings(spark, path).collect() == []
    assert segments.change(df(notes), path) == 1
    check()
    for step in range(3):
        changed = {i: f"beta v{step} w{i % 3}" for i in range(step, 40, 10)} | {100 + step: "new words", 200 + step: None}
        gone = [i for i in notes if i % 10 == 5 + step]
        notes = {i: t for i, t in notes.items() if i not in gone} | changed
        segments.change(df(changed), path, spark.createDataFrame([(i,) for i in gone], "unit_id long"), batch=step)
        assert segments.change(df({1: "ignored"}), path, batch=step) == step + 2  # a batch that came before
        check()
    assert segments.merge(spark, path) == 5
    check()
    assert segments.manifest(spark, path)["segments"] == [5]
    notes[1] = "behind the merge"
    segments.change(df({1: notes[1]}), path)
    check()
    text = spark.createDataFrame([(i, 1 + i % 2, f"c{i}", t) for i, t in notes.items()], "note_uid long, page_id int, caption string, text string")
    index = segments.postings(spark, path)
    assert [r.note_uid for r in lexical.search_all_words(text, "w2 beta", index=index).collect()] == sorted(i for i, t in notes.items() if {"w2", "beta"} <= set((t or "").split()))
    assert [r.note_uid for r in lexical.search_all_words(text, "w2 beta", pages=(1,)).collect()] == sorted(i for i, t in notes.items() if {"w2", "beta"} <= set((t or "").split()) and i % 2 == 0)


def test_search_without_an_index_matches_as_it_stands(spark, tmp_path):
    path = str(tmp_path / "index")
    notes = spark.createDataFrame([(1, 1, "Cap Beta", "alpha gamma"), (2, 2, "other", "gamma, Alpha"), (3, 1, None, None)], "note_uid long, page_id int, caption string, text string")
    found = lambda q, **k: [r.note_uid for r in segments.search(notes, q, path, **k).collect()]
    assert found("CAP b") == [1] and found("THE") == [2] and found("gamma") == [] and found("", limit=1) == [1]
    segments.change(notes.select(F.col("note_uid").alias("unit_id"), F.concat_ws(" ", "caption", "text").alias("text")), path)
    assert found("gamma ALPHA") == [1, 2] and found("gamma alpha", pages=(2,)) == [2] and found("cap b") == []
    import shutil

    shutil.rmtree(f"{path}/segment/n=1")
    assert found("cap b") == [1]


def test_a_change_that_fails_leaves_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    segments.change(spark.createDataFrame([(1, "alpha")], "unit_id long, text string"), path)
    bad = spark.createDataFrame([(1, "beta")], "unit_id long, text string").withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        segments.change(bad, path)
    assert [r.term for r in segments.postings(spark, path).collect()] == ["alpha"]


def test_streamed_changes(spark, tmp_path):
    from quillspark.streaming.incremental import index_stream

    rows = [(1, "alpha", False, 1), (1, "beta", False, 2), (2, "alpha", False, 3), (2, None, True, 4), (3, "gamma", False, 5)]
    schema = "unit_id long, text string, deleted boolean, seq long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    run = lambda: index_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination(120)
    run()
    spark.createDataFrame([(3, None, True, 6), (4, "delta", False, 7)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted((r.term, r.unit_id) for r in segments.postings(spark, str(tmp_path / "index")).collect()) == [("beta", 1), ("delta", 4)]


# Trees


def chain(n):
    return [(1, k, k - 1, 0, f"c{k}", k % 3) for k in range(n)]


def test_a_chain_in_logarithmic_rounds(spark, monkeypatch):
    """5,000 levels: 13 rounds, each of a row a node."""
    met = []
    monkeypatch.setattr(tree, "lookup", lambda rows, *a, **k: met.append(rows.count()) or ordered.lookup(rows, *a, **k))
    df = spark.createDataFrame(chain(5000), NODES)
    out = tree.paths(df, {}).agg(F.max("depth"), F.count("*")).first()
    assert tuple(out) == (4999, 5000) and len(met) - 1 <= 13 and max(met) <= 5000
    t = df.withColumn("depth", F.col("id").cast("int"))
    met.clear()
    sums = {r.id: (r.subtree_nodes, r.subtree_chars) for r in tree.rollup(t, ["chars"]).collect()}
    assert all(sums[k] == (5000 - k, sum(x % 3 for x in range(k, 5000))) for k in range(0, 5000, 611))
    assert sum(met) <= 5000 * 13
    assert tree.subtree(t, spark.createDataFrame([(1, 4000)], "page_id int, id long")).count() == 1000


def test_unreached_nodes_are_named(spark):
    rows = [*chain(4), (1, 50, 99, 0, "orphan", 1), (1, 51, 50, 0, "below", 1), (2, 10, 11, 0, "a", 1), (2, 11, 10, 0, "b", 1), (2, 12, 11, 0, "c", 1), (2, 13, 13, 0, "self", 1)]
    df = spark.createDataFrame(rows, NODES)
    assert {(r.page_id, r.id): r.reason for r in tree.unreached(df).collect()} == {(1, 50): "missing parent", (1, 51): "missing parent", **dict.fromkeys([(2, 10), (2, 11), (2, 12), (2, 13)], "cycle")}
    assert {r.id for r in tree.hierarchy(df).collect()} == {0, 1, 2, 3}


def random_tree(n=120, seed=2):
    rng = random.Random(seed)
    return [(1, k, rng.choice([-1, *range(k)]) if rng.random() < 0.9 or not k else -1, rng.randint(0, 3), f"c{k}", k) for k in range(n)] + [(1, 1000 + k, 5, k % 7, "many", 1) for k in range(60)]


def test_walk_numbers(spark):
    rows = random_tree()
    below = {}
    for _, i, p, s, *_ in rows:
        below.setdefault(p, []).append((s, i))
    want, place = {}, 0

    def walk(i):
        nonlocal place
        first, place = place, place + 1
        for _, c in sorted(below.get(i, [])):
            walk(c)
        want[i] = (first, place - 1)

    for _, i in sorted(below[-1]):
        walk(i)
    out = tree.numbered(spark.createDataFrame(rows, NODES)).collect()
    assert {r.id: (r.pre, r.post) for r in out} == want


def test_siblings_and_tiles_over_ranges(spark):
    rows = random_tree()
    df = spark.createDataFrame(rows, NODES)
    want = {}
    for p in {r[2] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[2] == p), key=lambda r: (r[3], r[1]))):
            want[r[1]] = n
    assert {r.id: r.sort_index for r in tree.reindexed(df).collect()} == want
    tiles = {(r.parent_id, r.tile): (r["size"], r.nodes) for r in tree.top_tiles(df, "chars", 4).collect()}
    mine = sorted((r for r in rows if r[2] == 5), key=lambda r: (-r[5], r[1]))
    assert tiles[5, "other"] == (sum(r[5] for r in mine[4:]), len(mine) - 4) and tiles[5, str(mine[0][1])] == (mine[0][5], 1)


def test_treemap(spark):
    """Tiles fill their parent without overlap, areas are in proportion, and rows follow the plain rule."""
    rows = [r for r in random_tree() if r[5]]
    sized = tree.rollup(spark.createDataFrame(rows, NODES), ["chars"])
    reached = {r.id for r in sized.collect()}
    out = treemap.treemap(sized, "subtree_chars", 4.0, 3.0, levels=3, most=5).collect()
    frames = {-1: (0.0, 0.0, 4.0, 3.0)} | {int(r.tile): (r.x, r.y, r.w, r.h) for r in out if r.tile != "other"}
    assert {r.level for r in out} == {1, 2, 3} and {int(r.tile) for r in out if r.tile != "other"} <= reached
    for parent in {r.parent_id for r in out}:
        mine, (x, y, w, h) = [r for r in out if r.parent_id == parent], frames[parent]
        total = sum(r["size"] for r in mine)
        assert len(mine) <= 6 and sum(r.w * r.h for r in mine) == pytest.approx(w * h)
        for i, r in enumerate(mine):
            assert r.w * r.h == pytest.approx(w * h * r["size"] / total)
            assert x - 1e-9 <= r.x and r.x + r.w <= x + w + 1e-9 and y - 1e-9 <= r.y and r.y + r.h <= y + h + 1e-9
            for s in mine[:i]:
                assert min(r.x + r.w, s.x + s.w) - max(r.x, s.x) < 1e-9 or min(r.y + r.h, s.y + s.h) - max(r.y, s.y) < 1e-9


def test_squarified_rows_of_the_published_example():
    """Sizes 6 6 4 3 2 2 1 in a rectangle of 6 by 4: two left, then rows as in the paper of Bruls and others."""
    got = [tuple(round(v, 3) for v in r) for r in treemap.squarify([6, 6, 4, 3, 2, 2, 1], 0, 0, 6, 4)]
    assert got[:4] == [(0, 0, 3, 2), (0, 2, 3, 2), (3, 0, 1.714, 2.333), (4.714, 0, 1.286, 2.333)]
    assert sum(w * h for _, _, w, h in got) == pytest.approx(24, abs=0.01) and got[4][:2] == (3, 2.333)
    assert treemap.squarify([0, 0], 0, 0, 1, 1) == [(0, 0, 0, 0)] * 2 and treemap.squarify([5], 1, 2, 3, 4) == [(1, 2, 3, 4)]


# Orders


def test_outline_and_parts_of_one_segment(spark, tmp_path):
    """All notes under one top segment, over several ranges: blocks, starts, parts and files as of one text."""
    rng = random.Random(1)
    paths = {n: " > ".join(["top", *(rng.choice("abc") for _ in range(n % 4))]) if n % 11 else "" for n in range(90)}
    lines = [(n, 0, k, f"line {k} of note {n}, long enough", "u", False, f"cap {n}", paths[n], None) for n in paths for k in range(2)]
    df = spark.createDataFrame(lines, "note_uid long, tier int, line_index int, text string, color string, is_bold boolean, caption string, tree_path string, date_created timestamp_ntz")
    blocks = export.outline(df)
    text = export.text_of(blocks)
    last, want = [], []
    for n in sorted(paths, key=lambda n: (paths[n].split(" > "), n)):
        seg = (paths[n] or "(root)").split(" > ")
        common = next((i for i, (a, b) in enumerate(zip(seg, last)) if a != b), min(len(seg), len(last)))
        want += [f"{chr(9) * d}== {s} ==" for d, s in enumerate(seg) if d >= common]
        want += ["", f"{chr(9) * len(seg)}[{n}] cap {n}", *(f"{chr(9) * len(seg)}  [PUR] line {k} of note {n}, long enough" for k in range(2))]
        last = seg
    assert text == "\n".join(["# 180 highlighted units from 90 notes", *want])
    for chars in (0, 500):
        folder = tmp_path / f"out{chars}"
        laid = export.write_text(blocks, str(folder), part_chars=chars).collect()
        parts = sorted(folder.glob("part=*"), key=lambda p: int(p.name[5:]))
        whole = "".join(f.read_text() for p in parts for f in sorted(p.glob("part-*")))
        assert whole == text + "\n" and len(parts) == (1 if not chars else 2)
        assert all(text[r.start : r.start + r.chars].count("[") and text[r.start - 1] == "\n" for r in laid)
        assert max(r.start + r.chars for r in laid) == len(text)


def test_an_export_without_a_budget(spark, tmp_path):
    from tests.test_engine import export_units

    units = export_units(spark)
    as_text = export.export(units, ("u", "b", "n"), 0, front=("intro",))
    written = export.export(units, ("u", "b", "n"), 0, front=("intro",), path=str(tmp_path / "x"))
    assert written["chars"] == as_text["chars"] and written["unit_count"] == as_text["unit_count"] == 4
    files = sorted(Path(tmp_path / "x/part=0").glob("part-*"))
    assert "".join(f.read_text() for f in files) == as_text["text"] + "\n"


def test_running_places_and_neighbours_over_ranges(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), rng.randint(0, 5), k) for k in range(200)] + [(None, 1, 999)]
    df = spark.createDataFrame(rows, "g string, v int, id long")
    out = ordered.running(ordered.in_order(df, "g", "v", "id"), F.col("v").cast("long"), "upto", ("g",)).collect()
    for g in ("a", "b", None):
        total = 0
        for r in sorted((r for r in out if r.g == g), key=lambda r: (r.v, r.id)):
            total += r.v
            assert r.upto == total
    before = {r.id: r.last for r in ordered.previous(ordered.in_order(df, "v", "id"), "id", "last").collect()}
    line = [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert before == dict(zip(line, [None, *line]))
    table = spark.createDataFrame([("a", 1), ("c", 2)], "g string, x int")
    assert sorted(map(str, ordered.lookup(df, table, ("g",), "left").select("id", "x").collect())) == sorted(map(str, df.join(table, "g", "left").select("id", "x").collect()))


def test_exact_quantiles(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.random(), 0.5, 7.0])) for g in "xxy" for _ in range(101)] + [("z", 3.0), ("w", None), (None, 1.0)]
    out = {r.g: r for r in ordered.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"low": 0.0, "q": 0.3, "m": 0.5, "high": 1.0}).collect()}
    assert set(out) == {"x", "y", "z"}
    for g, r in out.items():
        mine = [v for k, v in rows if k == g]
        assert r.n == len(mine) and (r.low, r.q, r.m, r.high) == pytest.approx(tuple(np.quantile(mine, [0, 0.3, 0.5, 1])))


def test_resampled_intervals(spark):
    """The same draws in plain Python; groups at once as each alone; no dependence on partitions."""
    rows = [(f"q{i}", "ab"[i % 2], float(i % 13) if i % 10 else None) for i in range(60)] + [("q1", "c", 4.0)]
    df = spark.createDataFrame(rows, "question_id string, regime string, score double")
    out = {r.regime: (r.low, r.high) for r in evaluate.bootstrap_intervals(df.repartition(5), ("regime",), rounds=300, key="question_id").collect()}

    def mixed(x):
        for _ in range(2):
            x = ((x >> 16) ^ x) * 0x45D9F3B % 2**32
        return (x >> 16) ^ x

    import hashlib

    for g in "ab":
        keys = [((int(hashlib.md5(q.encode()).hexdigest()[:8], 16) + 1) % 2**32, v) for q, k, v in rows if k == g and v is not None]
        means = []
        for r in range(300):
            times = []
            for key, v in keys:
                u, n, p = mixed((mixed(key) + r * 2654435769) % 2**32) / 2**32, 0, math.exp(-1)
                while u >= p and n < 12:
                    n += 1
                    p += math.exp(-1) / math.factorial(n)
                times.append((n, v))
            if sum(n for n, _ in times):
                means.append(sum(n * v for n, v in times) / sum(n for n, _ in times))
        means.sort()
        assert out[g] == pytest.approx((means[int(len(means) * 0.025)], means[int(len(means) * 0.975)]))
        alone = evaluate.bootstrap_interval(df.where(F.col("regime") == g), rounds=300, key="question_id").first()
        assert tuple(alone) == pytest.approx(out[g])
    assert all(math.isnan(x) for x in out["c"])


# Stored results


def test_embedding_resumes_after_a_failure(spark, tmp_path):
    """Batches before the failure stay; the next run embeds each of the rest once."""
    path, log, fail = str(tmp_path / "vectors"), tmp_path / "log", tmp_path / "fail"
    units = spark.createDataFrame([(i, f"text {i}", "p", "c") for i in range(60)], "unit_id long, text string, tree_path string, caption string").coalesce(1)

    def embed(texts):
        with log.open("a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        if fail.exists() and len(log.read_text().splitlines()) > 30:
            raise RuntimeError("the embedder is gone")
        return [[float(len(t)), 1.0] for t in texts]

    fail.touch()
    with pytest.raises(Exception, match="the embedder is gone"):
        service.embed_missing(units, path, embed, 2, context=False, commit_rows=10)
    kept = {r.unit_id for r in spark.read.parquet(path).collect()}
    assert 0 < len(kept) < 60
    fail.unlink()
    log.unlink()
    added = {r.unit_id for r in service.embed_missing(units, path, embed, 2, context=False, commit_rows=10).collect()}
    assert sorted(log.read_text().splitlines()) == sorted(f"text {i}" for i in range(60) if i not in kept)
    assert added == set(range(60)) - kept and spark.read.parquet(path).count() == 60
    assert service.embed_missing(units, path, embed, 2, context=False).count() == 0


def test_appended_passes_null_data(spark):
    old = zlib.compress(to_rtf("before").encode("cp1252"))
    rows = [(1, old, len(old)), (2, None, 0), (3, b"raw", 3), (None, None, 0)]
    df = spark.createDataFrame(rows, "id long, data binary, packed_size long")
    out = {r.id: r for r in archive.appended(df, 1, " and behind", "p", True).collect()}
    assert len(out) == 4 and out[2].data is None and bytes(out[3].data) == b"raw" and out[2].packed_size == 0
    spans = rtf_spans(inflate(bytes(out[1].data)))
    assert "".join(s["text"] for s in spans) == "before and behind" and spans[-1]["highlight"] == "p" and out[1].packed_size == len(out[1].data)
    assert "".join(s["text"] for s in rtf_spans(inflate(bytes(next(r for r in archive.appended(df, 2, "new").collect() if r.id == 2).data)))).strip() == "new"


def test_tables_that_are_missing(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "k long")
    assert not storage.exists(spark, str(tmp_path / "none"))
    assert storage.add_missing(df, str(tmp_path / "t"), "k").count() == 2 and storage.add_missing(df, str(tmp_path / "t"), "k").count() == 0


def test_nested_json_of_any_depth(spark):
    """Two pages, one of them a chain of 60 levels; the lines of a page are one JSON value."""
    rows = [*random_tree(), *((2, k, k - 1, 0, f'say "{k}"', None) for k in range(60))]
    df = spark.createDataFrame(rows, NODES)
    lines = tree.json_lines(tree.hierarchy(df), {"node": "id", "name": "caption", "chars": "chars"}).orderBy("page_id", "pre").collect()

    def below(page, parent):
        mine = sorted((r for r in rows if r[0] == page and r[2] == parent), key=lambda r: (r[3], r[1]))
        return [{"node": r[1], "name": r[4], "chars": r[5], "children": below(page, r[1])} for r in mine]

    for page in (1, 2):
        assert json.loads("".join(r.line for r in lines if r.page_id == page)) == below(page, -1)


def test_vectors_as_bytes(spark):
    rows = [(1, [1.5, -2.0]), (2, None), (3, [])]
    df = spark.createDataFrame(rows, "id long, v array<float>").withColumn("b", C.blob_of_vector(F.col("v")))
    got = {r.id: (None if r.b is None else bytes(r.b), r.back) for r in df.select("id", "b", C.vector_of_blob(F.col("b")).alias("back")).collect()}
    assert got == {1: (np.array([1.5, -2.0], "<f4").tobytes(), [1.5, -2.0]), 2: (None, None), 3: (b"", [])}
    odd = spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(C.vector_of_blob(F.col("b")).alias("v")).first()
    assert odd.v is None


# Model calls


@pytest.fixture
def model():
    """A chat server of both protocols that refuses every third call, and some questions until it is told not to."""
    seen: list[dict] = []
    state = {"refuse": "question 3", "lock": threading.Lock()}

    class Chat(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            last = asked["messages"][-1]["content"]
            with state["lock"]:
                seen.append(asked | {"path": self.path, "key": self.headers.get("Authorization")})
                refuse = len(seen) % 3 == 0 or bool(state["refuse"] and state["refuse"] in last)
            if refuse:
                self.send_response(503)
                self.end_headers()
                self.wfile.write(b"busy")
                return
            text = f"answer to {last.rsplit(': ', 1)[-1]}"
            openai = self.path.endswith("/chat/completions")
            if asked["stream"]:
                pieces = [{"choices": [{"delta": {"content": p}}]} if openai else {"message": {"content": p}, "done": False} for p in (text[:4], text[4:])]
                lines = [("data: " if openai else "") + json.dumps(p) for p in pieces]
                body = "\n".join([*lines[:1], "noise", *lines[1:], "data: [DONE]" if openai else json.dumps({"done": True})])
            else:
                body = json.dumps({"choices": [{"message": {"content": text}}]} if openai else {"message": {"content": text}})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}", seen, state
    server.shutdown()


def test_both_protocols(model):
    url, seen, state = model
    state["refuse"] = None
    messages = [{"role": "user", "content": "The question: a"}]
    ollama, openai = calls.ChatServer(url, "m"), calls.ChatServer(url, "m", kind="openai", key="k")
    assert ollama(messages) == "answer to a" and openai(messages) == "answer to a"
    assert (seen[0]["path"], seen[0]["options"]["num_ctx"]) == ("/api/chat", 8192) and (seen[1]["path"], seen[1]["key"]) == ("/chat/completions", "Bearer k")
    with pytest.raises(ConnectionError, match="503: busy"):
        ollama(messages)
    assert list(ollama.stream(messages)) == ["answ", "er to a"] == list(openai.stream(messages))
    for bad, error in ((calls.ChatServer(url, "m", kind="openai"), ValueError), (calls.ChatServer("http://127.0.0.1:9", "m", timeout=2), ConnectionError), (calls.ChatServer(url, "m", kind="other"), ValueError)):
        with pytest.raises(error):
            bad(messages)


def test_each_cell_is_called_until_stored_once(spark, tmp_path, model):
    from tests.test_engine import small_archive

    url, seen, state = model
    path, a = str(tmp_path / "ledger"), small_archive(spark)
    questions = spark.createDataFrame([(k, f"alpha question {k}") for k in range(6)], "query_id long, query string")
    regimes = ("R0_baseline_fts", "R7_long_context", "R1_baseline_vector")
    cells = calls.grid_prompts(a, questions, regimes, path, dims=3)
    call = calls.ChatServer(url, "m")
    got = calls.run_calls(cells, path, call, at_once=3, tries=5, wait=0.01, commit_rows=7).collect()
    assert {(r.question_id, r.regime): r.answer for r in got} == {(str(q), k): f"answer to alpha question {q}" for q in range(6) for k in regimes if q != 3}
    assert {(r.question_id, r.regime) for r in calls.failures(path, cells).collect()} == {("3", k) for k in regimes}
    first, state["refuse"] = len(seen), None
    rest = calls.grid_prompts(a, questions, regimes, path, dims=3)
    assert {r.question_id for r in rest.collect()} == {"3"}
    again = calls.run_calls(rest, path, call, at_once=2, tries=5, wait=0.01)
    assert again.count() == 18 and all("question 3" in s["messages"][-1]["content"] for s in seen[first:]) and calls.failures(path, cells).count() == 0
    assert any("alpha text number" in s["messages"][-1]["content"] for s in seen)
    told = len(seen)
    assert calls.run_calls(cells, path, call).count() == 18 and len(seen) == told
    stored = spark.read.parquet(path).where("error IS NULL").groupBy("question_id", "regime").count()
    assert stored.where("count > 1").count() == 0


def test_lines_are_handed_on_in_small_batches():
    """A batch of notes, however many lines they have, is unpacked and handed back in pieces, with the lines of a plain walk."""
    notes = [[(f"line {k} of {i}\n" if k % 3 else "two ", "u" if k % 5 else None, k % 2 == 0) for k in range(i * 40)] for i in range(12)]
    flat = [s for n in notes for s in n]
    spans = pa.StructArray.from_arrays([pa.array(c) for c in zip(*flat, strict=True)], names=["text", "highlight", "bold"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(notes)))], names=["note_uid"])
    expected = [{"note_uid": i, **dict(zip(units._LINES.names, line, strict=True))} for i, n in enumerate(notes) for line in units.note_lines(n)]
    for rows, chars, least in ((64, 1 << 20, 10), (1 << 20, 500, 10), (1 << 20, 1 << 20, 1)):
        got = list(units._line_batches(batch, [len(n) for n in notes], spans, rows, chars))
        assert [r for b in got for r in b.to_pylist()] == expected
        assert len(got) >= least and all(b.num_rows <= rows for b in got)


def test_rich_text_is_decoded_a_few_rows_at_a_time():
    """What a batch's spans take as Python objects does not grow with its rows."""
    text = rtf.rich_rtf([(f"word {k} ", "u" if k % 2 else "p", k % 3 == 0, False) for k in range(400)])

    def peak(n: int) -> int:
        texts = pa.array([text] * n)
        tracemalloc.start()
        out = rtf.rtf_of_spans.func(rtf.spans_of_text.func(texts))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(out) == n and set(out.to_pylist()) == {text}
        return top

    peak(8)
    assert peak(8 * rtf.CHUNK_ROWS) < 2 * peak(rtf.CHUNK_ROWS)


SPAN_LISTS = pa.list_(pa.struct([("text", pa.string()), ("highlight", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_())]))


def test_rich_text_takes_few_calls_a_span():
    """Coding and decoding go by whole spans, not by characters and single words of rich text."""
    lists = [[{"text": f"w\xf6rd {k} and more ", "highlight": ("u", "p", None)[k % 3], "bold": k % 4 == 0, "italic": k % 5 == 0} for k in range(1000)] for _ in range(4)]
    spans = pa.array(lists, SPAN_LISTS)
    rtf.spans_of_text.func(rtf.rtf_of_spans.func(spans))
    calls = cProfile.Profile()
    calls.enable()
    back = rtf.spans_of_text.func(rtf.rtf_of_spans.func(spans))
    calls.disable()
    assert ["".join(s["text"] for s in row) for row in back.to_pylist()] == ["".join(s["text"] for s in row) for row in lists]
    assert sum(entry.callcount for entry in calls.getstats()) < 40 * 4000


def test_rich_text_of_batches_is_that_of_single_notes():
    """Groups that are one token, nested and cut ones, escapes that reach into groups, hidden groups."""
    rng = random.Random(7)
    pieces = ["a ", "b", "\\", "{", "}", "\n", "\t", "\r", "\xe9", "\U0001f600", "\0", "\u3000", " "]
    one = lambda: ("".join(rng.choices(pieces, k=rng.randint(0, 6))), rng.choice([None, "u", "p", "g2"]), rng.random() < 0.5, rng.random() < 0.3)
    notes = [[one() for _ in range(rng.randint(0, 8))] for _ in range(50)]
    written = rtf.rtf_of_spans.func(pa.array([None, *([dict(zip(("text", "highlight", "bold", "italic"), s, strict=True)) for s in n] for n in notes)], SPAN_LISTS)).to_pylist()
    assert written == [rtf.rich_rtf(n) for n in [[], *notes]]
    assert ["".join(s["text"] for s in rtf_spans(w)) for w in written[1:]] == ["".join(s[0] for s in n) for n in notes]
    head = r"{\rtf1{\colortbl;\red255\green255\blue0;}"
    shown = lambda body: [(s["text"], s["bold"]) for s in rtf_spans(head + body + "}")]
    assert shown(r"a{\b x}\{\b y\}{\b z}") == [("a", False), ("x", True), ("{", False), ("y}z", True)]
    assert shown(r"{\b \u233?\u-10179?\u-8703?}{\pict{\b no}}\uc2\u233 ??{\b \u233?-c}") == [("\xe9\U0001f601", True), ("\xe9", False), ("\xe9c", True)]


def test_paired_tests_read_each_score_once(spark):
    """The baseline differs from itself by nothing, though a second reading would give other scores."""
    read = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()
    scores = spark.createDataFrame([(f"q{i}", r) for i in range(30) for r in ("r0", "r1")], "question_id string, regime string").withColumn("score", read())
    own = evaluate.paired_tests(scores, "r0").where("regime = 'r0'").first()
    assert (own.n, own.mean_diff, own.t, own.df, own.significant) == (30, 0.0, 0.0, 29, False)


def test_a_kept_index_cuts_words_without_a_shuffle(spark):
    """Postings of units that are each one row equal those of build_index, and their plan has no exchange."""
    texts = ["b a b c", None, "", "...", "a a a", " ".join(f"w{k % 300}" for k in range(5000)), "\u00e9t\u00e9 ete A-b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "unit_id long, text string")
    rows = lambda x: sorted((r.term, r.unit_id, r.places, r.length) for r in x.collect())
    out = lexical.row_postings(df)
    assert rows(out) == rows(lexical.build_index(df)) and rows(lexical.row_postings(df.limit(0))) == []
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_hits_are_computed_once_for_expansion(spark):
    """Expansion reads its hits four times, but retrieval runs once."""
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "query_id long, rank int, unit_id long, note_uid long, score double, cosine double, source string"
    hits = spark.createDataFrame([(q, r, 10 * q + r, q, 1.0 / r, None, "retrieved") for q in (1, 2) for r in (1, 2, 3)], schema).mapInArrow(told, schema)
    corpus = spark.createDataFrame([(10 * q + r, q, float(r % 4)) for q in (1, 2, 3) for r in range(9)], "unit_id long, note_uid long, effective_weight double")
    out = retrieve.expand(hits, corpus, 4).collect()
    assert seen.value == 6 and Counter(r.source for r in out) == {"retrieved": 6, "expanded": 4}


def test_fitting_moves_only_found_texts(spark):
    """A corpus that is itself a join is cut to the units that were found before its texts are moved for that join."""
    fragments = spark.createDataFrame([(q, 1, q) for q in (1, 2, 3)], "query_id long, rank int, unit_id long")
    texts = spark.range(500).select(F.col("id").alias("unit_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("u").alias("color"), F.lit(True).alias("is_bold"), F.lit("a > b").alias("tree_path"))
    corpus = texts.join(spark.range(0, 900, 2).withColumnRenamed("id", "vec_id"), F.col("unit_id") == F.col("vec_id"), "left")
    out = retrieve.fit(fragments, corpus, resolve("R1_baseline_vector"), 4096, 100)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.shown for r in out.collect()) == ["[1] text 1", "[1] text 2", "[1] text 3"]
    assert -1 < plan.find("LeftOuter") < plan.find("LeftSemi")
