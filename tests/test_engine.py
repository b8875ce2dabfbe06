"""Fixtures and properties of the engine's operators."""

from __future__ import annotations

import math
import random
import sqlite3
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions import spans as S
from quillspark.functions.rtf import colour_table, inflate, nearest_code, rtf_spans, spans_of_blob, to_rtf
from quillspark.operators import archive, evaluate, export, lexical, retrieve, segments, service, stats, tree, units
from quillspark.plans.regimes import REGIMES, estimated_tokens, resolve, top_k_for_context
from quillspark.sources import results, storage

SPANS = "array<struct<text:string,highlight:string,bold:boolean,italic:boolean>>"
TABLE = r"{\colortbl ;\red255\green153\blue204;\red204\green255\blue255;\red0\green0\blue0;\red250\green250\blue160;\red10\green10\blue120;}"


def rich(body: str) -> str:
    return r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}" + TABLE + body + "}"


def shown(source):
    return [(s["text"], s["highlight"], s["bold"], s["italic"]) for s in rtf_spans(source)]


def test_rtf_formats():
    assert shown(rich(r"\pard one \b two\b0  {\highlight1 three \i four}\highlight0 five\par six\line\tab x")) == [
        ("one ", None, False, False), ("two", None, True, False), (" ", None, False, False), ("three ", "p", False, False), ("four", "p", False, True), ("five\nsix\n\tx", None, False, False),
    ]


def test_rtf_characters():
    assert shown(rich(r"\uc1\u-10179?\u-8703?!")) == [("\U0001f601!", None, False, False)]
    assert shown(rich(r"\u-10179?x"))[0][0] == "x" or "�" in shown(rich(r"\u-10179?\u65?"))[0][0]
    assert shown(rich(r"caf\'e9\~\_\{\}\\"))[0][0] == "café ‑{}\\"


def test_rtf_hidden_groups():
    assert shown(rich(r"a{\pict 0102ff}b{\*\unknown secret {deep}}c{" + "\n" + r"\*\x y}d")) == [("abcd", None, False, False)]


def test_rtf_colours():
    assert colour_table(rich(""))[:3] == [None, (255, 153, 204), (204, 255, 255)]
    assert nearest_code((250, 250, 160)) == "y" and nearest_code((10, 10, 120)) is None and nearest_code((255, 255, 255)) is None and nearest_code((0, 0, 0)) is None
    assert shown(rich(r"\highlight4 near\highlight5 far\highlight3 black")) == [("near", "y", False, False), ("farblack", None, False, False)]


def test_rtf_other_content():
    assert shown("plain text") == [("plain text", None, False, False)] and shown("") == [] and shown(None) == []
    assert inflate(zlib.compress("é".encode())) == "é" and inflate("é".encode("cp1252")) == "é" and inflate(None) == ""


@pytest.mark.parametrize("text", ["plain", "a\nb\tc", "{braces} \\ back", "é \U0001f600 ‑", "  lead"])
def test_rtf_round_trip(text):
    assert "".join(s["text"] for s in rtf_spans(to_rtf(text))) == text


def test_blobs(spark):
    df = spark.createDataFrame([(1, zlib.compress(rich(r"\b x").encode())), (2, b"raw"), (3, None)], "id int, data binary")
    out = {r.id: r.s for r in df.select("id", spans_of_blob("data").alias("s")).collect()}
    assert out[1][0].bold and out[2][0].text == "raw" and out[3] == []


def spans_row(spark, spans):
    return spark.createDataFrame([([(t, h, b, i) for t, h, b, i in spans],)], f"spans {SPANS}")


def test_span_texts(spark):
    df = spans_row(spark, [("a ", "p", True, False), ("\n\n", "b", False, False), (" plain ", None, True, True), ("c", "g", False, False)])
    r = df.select(S.internal_format(F.col("spans")).alias("i"), S.highlights(F.col("spans")).alias("h"), S.render(F.col("spans"), ("p", "g", None)).alias("r"), S.render(F.col("spans"), ("p", "b", "g"), "line").alias("l"), S.clipboard(F.col("spans"), ("p",)).alias("c"), S.span_stats(F.col("spans")).alias("s")).first()
    assert r.i == "[p][B]a [/B][/p]\n\n[B][I] plain [/I][/B][g]c[/g]"
    assert r.h == "[p]a[/p]\n[g]c[/g]"
    assert r.r == "[PNK*]a [/PNK] plain [GRN]c[/GRN]"
    assert r.l == "[PNK*] a\n[GRN] c"
    assert r.c == "[PNK*]a [/PNK]\n\n"
    assert (r.s.chars_total, r.s.chars_highlighted, r.s.chars_p, r.s.chars_b) == (7, 2, 1, 0)


def test_breaks(spark):
    texts = ["===", "=" * 9, "=" * 10, "xxx", "a\n\n\nb", "\n" * 4, "\n" * 5, "\n\n====\n\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.encode_breaks(F.col("t")).alias("e"), S.count_breaks(F.col("t")).alias("n")).collect()
    got = {r.t: (r.e, r.n) for r in rows}
    assert got["==="] == ("\n[BR2]\n", 1) and got["=" * 10][0] == "\n[BR3]\n" and got["a\n\n\nb"] == ("a\n[BR2]\nb", 0)
    assert got["\n" * 5] == ("\n[BR3]\n", 1) and got["\n\n====\n\n"][0] == "\n[BR2]\n[BR2]\n[BR2]\n"


def loop_sections(spans):
    """The section colour after each line, by a plain loop."""
    section, run, line, out = None, 0, 0, {}
    for text, color, _ in spans:
        for k, part in enumerate(text.split("\n")):
            line += k > 0
            if part and color:
                if color == section:
                    run += len(part)
                elif section is None or len(part) > run:
                    section, run = color, len(part)
            if part:
                out[line] = section
    return out


def test_sections_like_a_loop(spark):
    rng = random.Random(6)
    notes = []
    for k in range(60):
        notes.append((k, [("".join(rng.choices("ab \n", k=rng.randint(0, 12))), rng.choice(["p", "b", "g", None]), rng.random() < 0.5, False) for _ in range(rng.randint(1, 9))]))
    df = spark.createDataFrame([(k, s) for k, s in notes], f"note_uid long, spans {SPANS}")
    got = {(r.note_uid, r.line_index): r for r in units.content_units(df).collect()}
    for uid, spans in notes:
        want = loop_sections([s[:3] for s in spans])
        whole = "".join(s[0] for s in spans)
        for line, text in enumerate(whole.split("\n")):
            if text.strip():
                r = got.pop((uid, line))
                assert r.text == text.strip() and r.section_color == want[line]
                assert whole[r.char_start : r.char_end] == text
    assert not got


def test_line_rules(spark):
    notes = spark.createDataFrame(
        [(1, [("ab", "p", True, False), ("cd", "b", False, False), ("\n tie \nabc", "g", False, False), ("def", None, True, False), ("\n[BR3]\nz" + "y" * 120, "y", False, False), ("w" * 200, "o", True, False)])],
        f"note_uid long, spans {SPANS}",
    )
    out = {r.line_index: r for r in units.content_units(notes).collect()}
    assert out[0].color == "p" and not out[0].is_bold and [tuple(h) for h in out[0].inner_highlights] == [("cd", "b", 2, 4)]
    assert out[1].text == "tie" and out[2].color == "g" and not out[2].is_bold
    assert 3 not in out and out[4].break_context == "section_start" and out[4].section_color == "o"
    assert out[4].color == "o" and out[4].is_bold and len(out[4].inner_highlights[0].text) == 100


def test_duplicates_and_flags(spark):
    notes = [(1, 1, "Caption text", None, [("Same  Text here\n====\nabcd\nabcde", None, False, False)]), (2, 1, "====", "p", [("same text HERE", "p", True, False)]), (3, 2, " ", None, [("same text here", None, False, False)])]
    df = spark.createDataFrame([(u, p, c, n, "path", None, s) for u, p, c, n, s in notes], f"note_uid long, page_id int, caption string, node_color string, tree_path string, date_created timestamp_ntz, spans {SPANS}")
    out = {(r.note_uid, r.line_index): r for r in units.knowledge_units(df).collect()}
    assert not out[1, 0].is_duplicate and out[2, 0].is_duplicate and not out[3, 0].is_duplicate
    assert out[1, 1].is_separator and out[1, 2].is_trivial and not out[1, 3].is_trivial
    assert (2, -1) not in out and (3, -1) not in out and out[1, -1].source_type == "treenode"
    assert out[2, 0].effective_weight == 4.5


def forest(seed, n=200):
    rng = random.Random(seed)
    return [(1, k, -1 if k < 3 else rng.randrange(k), k, f"caption {k} " + "x" * 50, rng.randint(0, 9)) for k in range(n)]


NODES = "page_id int, id long, parent_id long, sort_index long, caption string, chars long"


def test_tree(spark):
    rows = [*forest(1), (2, 5, -1, 0, "other page", 7), (2, 9, 77, 0, "orphan", 1), (2, 10, 11, 0, "cycle", 1), (2, 11, 10, 0, "cycle", 1)]
    t = tree.hierarchy(spark.createDataFrame(rows, NODES))
    got = {(r.page_id, r.id): r for r in tree.rollup(t, ["chars"]).collect()}
    up = {(p, i): (p, q) for p, i, q, *_ in rows}
    assert (2, 9) not in got and (2, 10) not in got and got[2, 5].subtree_chars == 7
    total = {}
    for p, i, _, _, _, chars in rows[:-3]:
        at = (p, i)
        while at in up:
            n, c = total.get(at, (0, 0))
            total[at] = (n + 1, c + chars)
            at = up[at]
    assert {k: (r.subtree_nodes, r.subtree_chars) for k, r in got.items()} == total
    below = {r.id for r in tree.subtree(t, spark.createDataFrame([(1, 0)], "page_id int, id long")).collect()}
    assert below == {i for (p, i), r in got.items() if p == 1 and 0 in r.id_path}


def test_a_tree_too_deep_is_an_error(spark):
    nodes = spark.createDataFrame([(1, k, k - 1, 0, f"c{k}", 1) for k in range(6)], NODES)
    with pytest.raises(ValueError, match="deeper than 4"):
        tree.hierarchy(nodes, max_depth=4)
    assert tree.hierarchy(nodes, max_depth=6).count() == 6


def test_deep_tree(spark):
    rows = [(1, k, k - 1, 0, f"c{k}", 1) for k in range(25)]
    out = tree.with_paths(tree.hierarchy(spark.createDataFrame(rows, NODES)))
    assert out.where("id = 24").first().depth == 24


def archive_tables(spark):
    nodes = spark.createDataFrame([(1, 1, -1, 0, 10, 2), (1, 2, 1, 0, 11, 0), (1, 3, 1, 1, 12, 1), (1, 4, 3, 0, 13, 0), (2, 1, -1, 0, 14, 5), (2, 7, 99, 0, 15, 0)], "page_id long, id long, parent_id long, sort_index long, note_uid long, child_count long")
    notes = spark.createDataFrame([(u, f"n{u}", c, u * 1.0) for u, c in ((10, "ff99cc "), (11, None), (12, "CCFFFF"), (13, ""), (14, "FF99CC"), (20, None))], "uid long, caption string, bg_color string, date_created double")
    contents = spark.createDataFrame([(10, 5), (11, 3000), (99, 1)], "id long, packed_size long")
    return nodes, notes, contents


def test_integrity(spark):
    nodes, notes, contents = archive_tables(spark)
    assert {r.problem: r.rows for r in archive.integrity(notes, contents, nodes).collect()} == {"orphan_notes": 1, "orphan_contents": 1, "orphan_nodes": 1, "broken_parents": 1, "wrong_child_counts": 1}


def test_archive_queries(spark):
    nodes, notes, contents = archive_tables(spark)
    assert [r.uid for r in archive.notes_by_semantic_colour(notes, "p").collect()] == [14, 10]
    assert [r.uid for r in archive.notes_by_colour(notes, "FF99CC").collect()] == [14]
    assert [r.uid for r in archive.standout_nodes(nodes, notes, contents, 1).collect()] == [10, 12]
    assert archive.point(notes, uid=12).count() == 1
    assert archive.note_scan(notes, contents.withColumn("data", F.lit(None).cast("binary"))).count() == 6 and archive.node_scan(nodes, notes).count() == 6


def test_changes(spark):
    nodes, notes, contents = archive_tables(spark)
    patch = spark.createDataFrame([(11, "new", None)], "uid long, caption string, bg_color string")
    assert archive.patched(notes, patch).where("uid = 11").first().caption == "new"
    t = tree.hierarchy(nodes.withColumn("caption", F.lit("c")).withColumn("chars", F.lit(1)))
    new = {r.id: r for r in archive.inserted(nodes, 1, 1, 1, 50).where("page_id = 1").collect()}
    assert new[5].sort_index == 1 and new[3].sort_index == 2 and new[1].child_count == 3
    assert {r.id for r in archive.deleted(nodes, t, 1, 3, True).where("page_id = 1").collect()} == {1, 2}
    single = {r.id: r for r in archive.deleted(nodes, t, 1, 3, False).where("page_id = 1").collect()}
    assert single[4].parent_id == 1 and single[1].child_count == 2
    there = {(r.page_id, r.id): r for r in archive.moved(nodes, t, 1, 3, 2, 1).collect()}
    assert there[2, 10].parent_id == 1 and there[2, 11].parent_id == 10 and (1, 3) not in there
    order = {r.id: r.sort_index for r in archive.reordered(nodes, 1, 2, 1).where("page_id = 1 and parent_id = 1").collect()}
    assert order == {3: 0, 2: 1}
    kept = archive.subset(notes, contents, nodes, t, 1, [3])
    assert sorted(r.uid for r in kept[0].collect()) == [12, 13] and kept[1].count() == 0 and kept[2].count() == 2


def test_bm25_like_sqlite(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "it's", "it", "was", "s", "Café", "naive", "Čeština", "őszi", "başka", "žena", "ångström", "ḥadd"]
    texts = [(k, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for k in range(200)]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(text)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", [(k + 1, t) for k, t in texts])
    df = spark.createDataFrame(texts, "unit_id long, text string")
    index, size = lexical.build_index(df), lexical.corpus_size(df)
    for query in ("alpha gamma", "it's alpha", "cafe beta beta", "ab", "cestina oszi", "baska zena angstrom hadd"):
        terms = C.query_terms(F.lit(query))
        parts = spark.range(1).select(terms.alias("t")).first().t
        asked = spark.createDataFrame([(0, query)], "query_id long, query string")
        got = {r.unit_id: r.score for r in lexical.bm25(index, size, asked).collect()}
        assert got == {r.unit_id: r.score for r in lexical.bm25(lexical.build_index(df, lexical.parse_queries(asked)), size, asked).collect()}
        if not parts:
            assert got == {}
            continue
        match = " OR ".join('"' + p.replace('"', '""') + '"' for p in parts)
        want = {i - 1: -s for i, s in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=1e-8) for k in want)


def test_retrieval_properties(spark):
    rng = random.Random(3)
    rows = [(k, k // 4, f"text number {k} alpha", rng.choice(["u", "p", None]), k % 2 == 0, rng.choice([0.0, 1.0, 4.5]), rng.choice(["b", None]), "a > b", [rng.uniform(-1, 1) for _ in range(4)]) for k in range(60)]
    corpus = spark.createDataFrame(rows, "unit_id long, note_uid long, text string, color string, is_bold boolean, effective_weight double, section_color string, tree_path string, vector_plain array<float>").withColumn("vector_context", F.col("vector_plain"))
    asked = spark.createDataFrame([(0, "alpha text")], "query_id long, query string")
    vectors = [(0, [1.0, 0.5, -0.2, 0.1])]
    for key in REGIMES:
        out = retrieve.retrieve(corpus, resolve(key), asked, vectors).orderBy("rank").collect()
        assert [r.rank for r in out] == list(range(1, len(out) + 1)) and len({r.unit_id for r in out}) == len(out)
        assert sum(r.source == "retrieved" for r in out) <= resolve(key).top_k
    with pytest.raises(KeyError):
        resolve("R9")
    with pytest.raises(ValueError):
        retrieve.cosines(corpus, "vector_plain", [(0, [0.0] * 4)])
    # Vectors of another length are an error, whether the queries are a few or a table.
    with pytest.raises(Exception, match="has not the queries' 3 places"):
        retrieve.cosines(corpus, "vector_plain", [(0, [1.0] * 3)]).collect()
    short = spark.createDataFrame([(0, [1.0] * 3)], "query_id long, vector array<double>")
    with pytest.raises(Exception, match="against queries of 3"):
        retrieve.dense(corpus, resolve("R1_baseline_vector"), short, "vector_plain").collect()
    assert resolve("R1_baseline_vector", {"top_k": 3, "alpha": 9, "min_weight": None}).alpha == 0.0
    hits = retrieve.retrieve(corpus, resolve("R6_full_metadata"), asked, vectors)
    fitted = retrieve.fit(hits, corpus, resolve("R6_full_metadata"), 300, 500).orderBy("rank").collect()
    size, keep = 500, 0
    for r in retrieve.fit(hits, corpus, resolve("R6_full_metadata"), 10**6, 0).orderBy("rank").collect():
        size += len(r.shown) + (2 if keep else 0)
        if size / 4 > 256:
            break
        keep += 1
    assert len(fitted) == keep
    assert top_k_for_context(8192, 0.5, 100) == 116 and top_k_for_context(10, 0.1, 100) == 1 and estimated_tokens(4, 10) == 10


def loop_prefix(sizes, budget):
    used, n = 0, 0
    for s in sizes:
        if used + s > budget and n:
            break
        used, n = used + s, n + 1
    return n


def test_budget_prefix_like_a_loop(spark):
    rng = random.Random(2)
    for budget in (1, 50, 400, 10**6):
        sizes = [rng.randint(1, 60) for _ in range(30)]
        notes = spark.createDataFrame([(k, s, 1, None) for k, s in enumerate(sizes)], "note_uid long, size long, units long, latest timestamp_ntz")
        assert sorted(r.note_uid for r in export.within_budget(notes, budget).collect()) == list(range(loop_prefix(sizes, budget)))


def export_units(spark):
    rows = [
        (1, 1, "A", "x > y", 0, "purple line that is long enough", "u", True), (2, 1, "A", "x > y", 1, "bold line without any colour", None, True), (3, 2, "B", "x > z", 0, "blue line that is long enough", "b", False),
        (4, 3, "plain line without any colour", "x > z", 0, "plain line without any colour", None, False),
    ]
    df = spark.createDataFrame([(*r, "2024-01-0" + str(r[1])) for r in rows], "unit_id long, note_uid long, caption string, tree_path string, line_index int, text string, color string, is_bold boolean, d string")
    return df.select("*", F.col("d").cast("timestamp_ntz").alias("date_created"), F.lit(1).alias("page_id"), *(F.lit(False).alias(c) for c in ("is_trivial", "is_separator", "is_duplicate")), F.lit(1.0).alias("effective_weight"), F.lit("content").alias("source_type"))


def test_tiers(spark):
    u = export_units(spark)
    chosen, report = export.tiered(u, ("u", "b", "nb", "n"), 130)
    assert [(t["name"], t["notes"]) for t in report] == [("purple+pink", 1), ("blue", 1), ("bold (uncoloured)", 1), ("uncoloured", 1)]
    both, _ = export.tiered(u, ("nb", "n"))
    assert sorted(r.unit_id for r in both.collect()) == [2, 2, 4]
    three = spark.createDataFrame([(3,)], "note_uid long")
    none, _ = export.tiered(u, ("u",), notes=three)
    back, names = export.tiered(u, ("u",), notes=three, fallback=True)
    assert none.count() == 0 and [r.unit_id for r in back.collect()] == [4] and names[-1]["name"].startswith("uncoloured")


def test_export_texts(spark):
    out = export.export(export_units(spark), ("u", "b", "n"), 10_000, front=("intro",))
    assert out["text"] == (
        "intro\n\n# 4 highlighted units from 3 notes\n== x ==\n\t== y ==\n\n\t\t[1] A\n\t\t  [PUR*] purple line that is long enough\n\t\t  [BLD] bold line without any colour\n"
        "\t== z ==\n\n\t\t[2] B\n\t\t  [BLU] blue line that is long enough\n\n\t\t[3] [?] plain line without any colour"
    )
    recent = export.export(export_units(spark), ("u", "b"), 10_000, recent_first=True)["text"]
    assert recent.index("[2] B  (2024-01-02 · x > z)") < recent.index("[1] A  (2024-01-01 · x > y)")
    seen = export.preview(export_units(spark), spark.createDataFrame([(1,)], "note_uid long"))
    assert seen["unit_count"] >= 2 and not seen["truncated"]


def test_paired_tests(spark):
    rows = [(f"A{k}", "r0", float(k)) for k in range(10)] + [(f"A{k}", "r1", k + 1.0) for k in range(10)] + [(f"A{k}", "r2", float(k + k % 3)) for k in range(10)] + [("A1", "r3", 1.0)]
    out = {r.regime: r for r in evaluate.paired_tests(spark.createDataFrame(rows, "question_id string, regime string, score double"), "r0").collect()}
    assert out["r0"].t == 0 and not out["r0"].significant and math.isinf(out["r1"].t) and out["r1"].significant
    d = [k % 3 for k in range(10)]
    mean = sum(d) / 10
    sd = (sum((x - mean) ** 2 for x in d) / 9) ** 0.5
    assert math.isclose(out["r2"].t, mean / (sd / 10**0.5)) and out["r2"].significant and math.isnan(out["r3"].t)
    points = spark.createDataFrame([(k,) for k in (0, 1, 11, 61)], "df long").select("df", evaluate.t_critical(F.col("df")).alias("t")).collect()
    assert math.isnan(points[0].t) and [p.t for p in points[1:]] == [12.71, 2.18, 1.96]
    with pytest.raises(ValueError):
        evaluate.report(spark.createDataFrame([], "run_id long, question_id string, regime string"), spark.createDataFrame([], "run_id long, overall double"), "r0")


def test_bootstrap_and_overlap(spark):
    values = spark.createDataFrame([(float(k),) for k in range(30)], "score double")
    low, high = evaluate.bootstrap_interval(values, rounds=400).first()
    assert 8 < low < 14.5 < high < 21 and evaluate.bootstrap_interval(values, rounds=400).first() == (low, high)
    assert math.isnan(evaluate.bootstrap_interval(values.limit(1)).first()[0])
    # Values that repeat are drawn each for itself, in any partitioning.
    many = spark.createDataFrame([(float(k % 50),) for k in range(2000)], "score double")
    got = [tuple(evaluate.bootstrap_interval(many.repartition(k), rounds=1000).first()) for k in (1, 5)]
    half = 1.96 * math.sqrt((50**2 - 1) / 12 / 2000)
    assert got[0] == pytest.approx(got[1]) and got[0] == pytest.approx((24.5 - half, 24.5 + half), abs=0.15)
    runs = spark.createDataFrame([("q1", "a", 1), ("q1", "a", 2), ("q1", "b", 2), ("q2", "a", 5), ("q2", "b", 5)], "question_id string, regime string, unit_id long")
    got = {(r.regime_a, r.regime_b): r.jaccard for r in evaluate.overlap(runs).collect()}
    assert got == {("a", "a"): 1.0, ("b", "b"): 1.0, ("a", "b"): 0.75, ("b", "a"): 0.75}


def test_upserts(spark, tmp_path):
    runs = "run_id long, question_id string, regime string, generator string, answer string"
    merged = results.upsert_runs(spark.createDataFrame([(1, "q", "r", "g", "old"), (2, "q", "r", "h", "kept")], runs), spark.createDataFrame([(3, "q", "r", "g", "new")], runs))
    assert sorted((r.run_id, r.answer) for r in merged.collect()) == [(2, "kept"), (3, "new")]
    twice = results.upsert_runs(merged, spark.createDataFrame([(5, "q", "r", "g", "last"), (4, "q", "r", "g", "before")], runs).repartition(2))
    assert sorted((r.run_id, r.answer) for r in twice.collect()) == [(2, "kept"), (5, "last")]
    ratings = "run_id long, overall double, correctness double, completeness double, grounding double"
    out = results.upsert_ratings(spark.createDataFrame([(1, 5.0, 1.0, 2.0, None), (2, 6.0, 3.0, None, None)], ratings), spark.createDataFrame([(1, 9.0, None, None, None), (2, 7.0, None, 8.0, None)], ratings))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 9.0, 1.0, 2.0, None), (2, 7.0, None, 8.0, None)]
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert storage.add_missing(first, path, "id").count() == 2
    assert storage.add_missing(spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), path, "id").count() == 1
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_small_sinks(spark, tmp_path):
    (tmp_path / "a.env").write_text("# c\nKEY = 'v'\nbroken\n")
    assert storage.env_config(str(tmp_path / "a.env")) == {"KEY": "v"}
    assert len(storage.write_text_parts("abcdef", str(tmp_path), "x", 4)) == 2
    storage.write_csv(spark.range(3), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    (tmp_path / "n.rtf").write_bytes(rich(r"caf\'e9").encode("cp1252"))
    assert storage.read_rtf_files(spark, str(tmp_path / "*.rtf")).count() == 1


def test_index_stream(spark, tmp_path):
    from quillspark.streaming.incremental import index_stream

    spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "unit_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("unit_id long, text string").parquet(str(tmp_path / "in"))
    index_stream(stream, str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination(120)
    assert segments.postings(spark, str(tmp_path / "index")).where("term = 'alpha'").count() == 2


def test_small_columns(spark):
    df = spark.createDataFrame([("  A  b ", "p"), ("", None)], "t string, c string")
    out = df.select(C.normalise(F.col("t")).alias("n"), C.word_count(F.col("t")).alias("w"), C.line_count(F.col("t")).alias("l"), C.tag(F.col("c"), F.lit(True)).alias("g")).collect()
    assert [tuple(r) for r in out] == [("a b", 2, 1, "[PNK*]"), ("", 0, 0, "")]
    assert stats.build_counters(spark, x=df).first().rows == 2


def small_archive(spark):
    rows = [(k, k // 3, f"alpha text number {k} of the corpus", "u" if k % 4 == 0 else None, k % 2 == 0, 5.5 if k % 4 == 0 else 0.0, None, "a > b", [1.0, float(k % 5), 0.0]) for k in range(30)]
    corpus = spark.createDataFrame(rows, "unit_id long, note_uid long, text string, color string, is_bold boolean, effective_weight double, section_color string, tree_path string, vector_plain array<float>")
    corpus = corpus.select("*", F.col("vector_plain").alias("vector_context"), F.lit("cap").alias("caption"), F.col("unit_id").cast("int").alias("line_index"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("date_created"), F.lit(1).alias("page_id"), F.lit("content").alias("source_type"), *(F.lit(False).alias(c) for c in ("is_trivial", "is_separator", "is_duplicate")))
    return service.Archive(corpus, embed=lambda texts: [[1.0, 2.0, 0.5] for _ in texts])


def test_service(spark, tmp_path):
    a = small_archive(spark)
    seen = []
    out = a.answer("alpha corpus", "R6_full_metadata", lambda m: seen.append(m) or "said", window_tokens=4000)
    assert out["answer"] == "said" and out["n_fragments"] > 0 and "[1] [PUR" in seen[0][1]["content"] and "[PUR] weight 5" in seen[0][0]["content"]
    assert a.answer("zz", "R0_baseline_fts", lambda m: "no")["answer"] == service.NOTHING
    with pytest.raises(ValueError):
        service.Archive(a.corpus).search("alpha", "R1_baseline_vector")
    same = {(r.regime_a, r.regime_b): r.jaccard for r in a.compare_regimes("alpha", ("R2_weight_boost", "R5_prompt_meta")).collect()}
    assert set(same.values()) == {1.0}
    runs, errors = a.run_grid({"q1": "alpha", "q2": "corpus"}, ("R0_baseline_fts", "missing"))
    assert runs.select("question_id", "regime").distinct().count() == 2 and len(errors) == 2
    assert a.curate("alpha", codes=("u",), budget=5000)["unit_count"] > 0
    notes = spark.createDataFrame([(0,)], "note_uid long")
    assert a.summarise(notes, ("u",), lambda m: "sum")["summary"] == "sum"
    assert a.summarise(spark.createDataFrame([(999,)], "note_uid long"), ("u",), lambda m: "sum")["unit_count"] == 0
    path = str(tmp_path / "vectors")
    assert service.embed_missing(a.corpus, path, lambda t: [[1.0, 2.0]] * len(t), 2, True, sample=4).count() == 4
    assert service.embed_missing(a.corpus, path, lambda t: [[1.0, 2.0]] * len(t), 2, True).count() == 26
    context = service.copied_context(a.search("alpha", "R7_long_context"), a.corpus).first().context
    assert context.startswith("[U*] (a > b)\nalpha text")


def test_old_export_texts(spark):
    u = export_units(spark).withColumn("tier", F.lit(0))
    blocks = {r.note_uid: (r.branch, r.block) for r in export.compact(u).collect()}
    assert blocks[1] == ("x", "\n  [1] y\n  # A\n    [PUR*] purple line that is long enough\n    [?*] bold line without any colour")
    assert blocks[3] == ("x", "\n  [3] z\n  # plain line without any colour")
    text = export.compact_text(export.compact(u), "# head")
    assert text.startswith("# head\n\n== x ==\n\n  [1] y")
    long = "# head\n" + "".join(f"\n== b{k} ==" + "x" * 150 for k in range(4))
    chunks = export.split_at_branches(long, 400)
    assert len(chunks) > 1 and all(c.startswith("# head") for c in chunks) and sum(c.count("== b") for c in chunks) == 4
    assert export.preset(export_units(spark), "compact").count() == 1


def test_rich_text_is_written_and_read_back():
    spans = [("plain {\\} ", None, False, False), ("pink é\n", "p", False, False), ("both\t", "g2", True, True), ("bold \U0001f601", None, True, False)]
    from quillspark.functions.rtf import rich_rtf, with_text

    assert shown(rich_rtf(spans)) == spans
    for source in (rich_rtf(spans), rich_rtf([]), to_rtf("old"), rich("old")):
        more = shown(with_text(source, "new {text}", "u", True))
        assert more[-1] == ("new {text}", "u", True, False) and more[:-1] == shown(source)
        again = shown(with_text(with_text(source, "one", "b"), "two", "b"))
        assert [s[:2] for s in again[-2:]] in ([("one", "b"), ("two", "b")],) or again[-1][:2] == ("onetwo", "b")
    assert shown(with_text(to_rtf("old"), " plain"))[-1][0] == "old plain"


def test_nearest_colours_alike(spark):
    rng = random.Random(4)
    rgb = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(300)] + [(0, 0, 0), (255, 255, 255), (255, 153, 204), (250, 250, 160), (10, 10, 120)]
    df = spark.createDataFrame(rgb, "r int, g int, b int")
    got = {(x.r, x.g, x.b): x.c for x in df.select("*", C.nearest_colour(F.col("r"), F.col("g"), F.col("b")).alias("c")).collect()}
    assert got == {c: nearest_code(c) for c in rgb}


def test_notes_are_created_and_appended(spark):
    nodes, notes, contents = archive_tables(spark)
    data = contents.select("id", F.lit(to_rtf("old").encode()).alias("data"), "packed_size")
    n, c, t = archive.created(notes, data, nodes, 1, 1, 0, "fresh", [("hello", "p", True, False)])
    new = n.where("caption = 'fresh'").first()
    assert new.uid == 21 and t.where("note_uid = 21").first().sort_index == 0
    assert shown(inflate(bytes(c.where("id = 21").first().data))) == [("hello", "p", True, False)]
    more = archive.appended(c, 10, " and new", "b").where("id = 10").first()
    assert shown(inflate(bytes(more.data)))[-1] == (" and new", "b", False, False) and more.packed_size == len(more.data)
    cleared = archive.patched(notes, spark.createDataFrame([(10, None)], "uid long, bg_color string"), set_null=True)
    assert cleared.where("uid = 10").first().bg_color is None and cleared.where("uid = 12").first().bg_color == "CCFFFF"


def test_report(spark):
    rng = random.Random(5)
    runs = [(k, f"{'AB'[k // 3 % 2]}{k // 3}", f"r{k % 3}", k) for k in range(60)]
    ratings = [(k, rng.uniform(0, 100), float(k % 7), None, 1.0, k % 2 == 0) for k in range(50)]
    r = spark.createDataFrame(runs, "run_id long, question_id string, regime string, n_fragments long")
    s = spark.createDataFrame(ratings, "run_id long, overall double, correctness double, completeness double, grounding double, blind boolean")
    out = evaluate.report(r, s, "r0", rounds=200)
    assert set(out) == {"table_overall", "table_correctness", "table_completeness", "table_grounding", "retrieval", "groups", "blind"}
    for row in out["table_overall"].collect():
        assert row.low <= row["mean"] <= row.high and row.n > 10
    assert {x.grp for x in out["groups"].collect()} == {"A", "B"} and out["blind"].count() == 3
    box = evaluate.box_plots(spark.createDataFrame([("r", float(k)) for k in range(5)], "regime string, score double")).first()
    assert (box.n, box.low, box.q1, box.median, box.q3, box.high) == (5, 0.0, 1.0, 2.0, 3.0, 4.0)


def test_answers_come_in_pieces(spark):
    a = small_archive(spark)
    out = list(a.stream("alpha corpus", "R6_full_metadata", lambda m: iter(["so ", m[0]["role"]]), window_tokens=4000))
    assert out[0]["n_fragments"] > 0 and [x["delta"] for x in out[1:]] == ["so ", "system"]
    assert [x["answer"] for x in a.stream("zz", "R0_baseline_fts", lambda m: iter(["no"]))] == [service.NOTHING]
    assert len(a.regimes()) == len(REGIMES) and a.regimes()[0]["key"] == "R0_baseline_fts"
    vectors = stats.corpus_stats(a.corpus.withColumn("vector_context", F.when(F.col("unit_id") < 10, F.col("vector_context")))).first()
    assert (vectors.embedded_plain, vectors.embedded_context) == (30, 10)
