"""Line dedup, embedding whitening and the filter audit against brute-force versions."""

from __future__ import annotations

import random
from itertools import permutations

import numpy as np
import pytest

from quillspark.llm import audit, lines, whitening
from tests.llm.test_operators import EDGE, WORD, table

ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_lines(rows, min_chars, min_docs):
    holders = {}
    cut = [(i, (t or "").split("\n")) for i, t, *_ in rows]
    key = lambda x: x.strip(ASCII_SPACE).translate(UPPER)
    for i, ls in cut:
        for x in ls:
            if i is not None and len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, ls in cut:
        stay = [x for x in ls if i is None or len(holders.get(key(x), ())) < min_docs or i == max(holders[key(x)])]
        out.append((i, len(ls), len(ls) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def line_rows(seed=5, n=80):
    rng = random.Random(seed)
    common = ["Shared LINE Été number %d of all" % k for k in range(6)] + ["short", "", "  "]
    rows = []
    for i in range(n):
        ls = [rng.choice(common) if rng.random() < 0.6 else f"own line {i} {k}" for k in range(rng.randint(0, 9))]
        ls = [rng.choice([x, x.upper(), f" \t{x}\r", x + " ", x.lower()]) for x in ls]
        rows.append((i, "\n".join([*ls, *(["the one line that every text holds"] * (i % 3))]), "x", "s", 1))
    rows += [(3, rows[3][1], "x", "s", 1), (3, "another text\n" + rows[4][1], "x", "s", 1), (None, rows[5][1], "x", "s", 1), (None, rows[5][1], "x", "s", 1)]
    long = [rng.choice(common[:6]) if k % 3 else f"part {k}" for k in range(5000)]
    return [*rows, (n, "\n".join(long), "x", "s", 1), (n + 1, "\n".join(long[::-1]), "x", "s", 1)]


@pytest.mark.parametrize("hot", [lines.HOT, 1])
def test_line_dedup(spark, monkeypatch, hot):
    """With HOT = 1 every key is sliced; the outcome is the same."""
    monkeypatch.setattr(lines, "HOT", hot)
    for rows in (line_rows(), EDGE):
        out = lines.drop_lines(table(spark, rows), min_chars=12, min_docs=5).collect()
        assert sorted((tuple(r) for r in out), key=str) == brute_lines(rows, 12, 5)
    assert lines.drop_lines(table(spark, [])).collect() == []


def test_line_bitmaps_name_only_words_that_lose_lines(spark):
    shared = "a line of a licence that many texts repeat"
    rows = [(i, "\n".join(f"{i} own line {k}" for k in range(200)) + f"\n{shared}\n" + "tail\n" * 200, "x", "s", 1) for i in range(7)]
    out = {r.doc: r for r in lines.line_bitmaps(table(spark, rows), min_chars=len(shared), min_docs=7).collect()}
    assert sorted(out) == list(range(6))
    assert all(r.n_dropped == 1 and [(w.word, w.bits) for w in r.keep] == [(3, ~(1 << (200 % 64)))] for r in out.values())


def test_the_ranges_serve_the_window_without_a_second_shuffle(spark):
    rows = lines._sliced(lines._narrow(table(spark, line_rows()), "doc_id", "text", 12), 3)
    plan = lines.streamed(rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1
    assert "hashpartitioning(h1" not in plan.split("Exchange rangepartitioning")[0]


def vector_rows(seed=2, n=300, dims=9):
    rng = np.random.default_rng(seed)
    spread = rng.normal(size=(dims, dims))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate((rng.normal(size=(n, dims)) @ spread).tolist())]
    bad = [(1, None), (2, []), (3, [0.0] * (dims - 1) + [None]), (4, [float("nan")] * dims), (5, [float("inf")] + [0.0] * (dims - 1)), (6, [1e300] * dims)]
    return [*rows, *bad, (None, rows[0][1]), (7, rows[0][1]), (7, rows[0][1])]


def exact_x(rows):
    import math

    usable = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) and abs(c) < 2**62 // 1024 for c in v)]
    return [i for i, _ in usable], [[math.floor(1024 * c) + 100_000 for c in v] for _, v in usable]


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_whitening(spark, scale):
    """Deviations equal those of Python's integers; figures those of numpy on centred vectors."""
    rows = [(i, v and [c if c is None else c * scale for c in v]) for i, v in vector_rows()]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, n int, x int").repartition(5)
    out = whitening.whiten(df, most=4).collect()
    ids, x = exact_x(rows)
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    assert sorted((str(r.vec_id), int(r.deviation)) for r in out) == sorted((str(i), d) for i, d in zip(ids, deviations, strict=True))
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:4]
    assert np.allclose([r for r in out[0].explained], values[order] / values.sum(), rtol=1e-9)
    assert out[0].n == n and out[0].identity_error < 1e-9
    want = dict(zip(ids, centred @ vectors[:, order] / np.sqrt(values[order]), strict=True))
    got = {r.vec_id: np.array(r.whitened) for r in out}
    signs = np.sign(sum(got[i] * want[i] for i in want))
    assert all(np.allclose(got[i] * signs, want[i], atol=1e-8) for i in want)


@pytest.mark.parametrize("size", [1, 1 << 10, 1 << 21, 1 << 45, 1 << 61])
def test_digit_slices_are_exact(size):
    rng = random.Random(size)
    y = [[rng.randint(-size, size) for _ in range(5)] for _ in range(whitening.BLOCK + 77)]
    y[0] = [size] * 5
    y[1] = [-size] * 5
    want = [[sum(r[i] * r[j] for r in y) for j in range(5)] for i in range(5)]
    assert whitening.gram(np.array(y, np.int64)).tolist() == want


def test_whitening_of_few_dimensions_and_no_spread(spark):
    df = spark.createDataFrame([(i, [1.0, float(i), 2.0 * i]) for i in range(6)], "vec_id long, embedding array<double>")
    out = whitening.whiten(df).collect()
    assert all(r.whitened[0] is not None and r.whitened[1] is None and r.whitened[2] is None and len(r.whitened) == 3 for r in out)
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert all(r.whitened == [None, None] and r.identity_error is None and r.deviation == 0 for r in flat)
    assert whitening.whiten(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="places"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def audit_rows():
    rng = random.Random(9)
    rows = []
    for i in range(60):
        words = rng.choices([f"w{k}" for k in range(rng.choice([3, 400]))], k=rng.choice([5, 99, 100, 130]))
        text = " ".join(words)
        text = text.upper() if rng.random() < 0.3 else text
        text += rng.choice(["", "", " # ", " $ "])
        rows.append((i, rng.choice(rows)[1] if rows and rng.random() < 0.3 else text, rng.choice(["x", "y", None, ""]), "s", 1))
    return rows


def brute_audit(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        upper = sum("A" <= c <= "Z" for c in t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * upper > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        mine = [x for x in labels if i is not None and x[0] == i]
        docs.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in mine)
                out[part, "".join(order), k] = [len(left), len(gone), sum(d[1][f] for d in mine) - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[f] += len(gone)
        for (p, order, k), figures in out.items():
            if p == part:
                figures.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark):
    labels = [(i, i % 2, (i + 1) % 3) for i in range(0, 60, 2)] + [(4, 1, 1), (6, None, None), (None, 1, 1)]
    marked = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, text int")
    for rows in (audit_rows(), EDGE):
        out = audit.interactions(audit.table_flags(table(spark, rows), marked)).collect()
        assert {tuple(r[:3]): tuple(r[3:]) for r in out} == brute_audit(rows, labels)
        assert len(out) == 600 * len({r[2] or "" for r in rows})
    assert audit.interactions(audit.table_flags(table(spark, []), marked)).collect() == []


def test_each_set_of_filters_is_entered_once(spark):
    """Eight sets of three filters, of which the last has nothing left to ask."""
    flags = spark.createDataFrame([("p", k % 2 == 0, k % 3 == 0, k % 5 == 0, True, False) for k in range(30)], "part string, fails_A boolean, fails_B boolean, fails_C boolean, good boolean, toxic boolean")
    edges = audit.walk(flags, "ABC").collect()
    assert sorted((r.node, r["filter"]) for r in edges) == sorted(("".join(n), f) for n in ((), *permutations("ABC", 1), ("A", "B"), ("A", "C"), ("B", "C")) for f in "ABC" if f not in n)
    assert {(r.node, r["filter"]): r.removed for r in edges}["AB", "C"] == sum(k % 5 == 0 and k % 2 and k % 3 > 0 for k in range(30))
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_copies_by_broadcast_and_by_join(spark):
    rows = [(k, 1, 1) for k in range(50)] + [(k, k // 2, 7) for k in range(100, 140)] + [(None, 1, 1)]
    out = audit.copies_of_smaller(spark.createDataFrame(rows, "id long, h1 long, h2 long"), "id", ("h1", "h2")).collect()
    assert sorted(r.id for r in out if r.copy) == [*range(1, 50), *range(101, 140, 2)]
    assert len(out) == len(rows)
