"""The corpus pipeline, stage by stage, on the smallest data."""

from __future__ import annotations

import math
import os
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import decontaminate, packing, privacy, quality
from quillspark.llm._util import scratch_table
from tests.llm.test_operators import EDGE, WORD, brute_components, brute_terms, jaccard, plain_quality, table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts, sizes = {r.doc_id: r.text for r in docs.collect()}, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, SF))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    left = {r.doc_id: r for r in docs.collect()}
    items = [r.text.lower().encode().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = set()
    for i, r in left.items():
        original = texts[i]
        assert len(original.split()) >= 50 and original not in seen
        seen.add(original)
        have = decontaminate.shingles(original.lower().encode().split(), 5)
        assert all(len(decontaminate.shingles(w, 5) & have) < 0.8 * len(decontaminate.shingles(w, 5)) for w in items)
        assert not privacy.base_spans(r.text) and r.n_chars == len(r.text)
        if not privacy.base_spans(original):
            assert r.text == original
    packed = corpus_pipeline.run(spark, SF).collect()
    tokens = packing.WordTokens(packing.default_tokenizer())
    flat, _ = tokens.ids([r.text.encode() for r in left.values()])
    assert sum(p.length for p in packed) == len(flat) + len(left)
    assert {p.doc_id for p in packed} == set(left)
    assert re.fullmatch(r"(\w+,?)+", ",".join(n for n, _ in corpus_pipeline.STAGES))


def plain_distance(shares, reference):
    terms = [(p, q, (p + q) / 2) for p, q in zip(shares, reference, strict=True)]
    return math.sqrt(max(0.0, sum((p * math.log2(p / m) if p > 0 else 0) + (q * math.log2(q / m) if q > 0 else 0) for p, q, m in terms) / 2))


def plain_kept(text):
    """The quality verdict by plain counting."""
    n, chars, symbols, _, repeated = plain_quality(text)
    if n < 50 or 100 * repeated > 50 * n:
        return False
    if len(text) < quality.LEAST_CHARS:
        return True
    counts = [len(text) - chars, *(sum(a <= c <= b for c in text) for a, b in ("AZ", "09")), symbols, sum(c in ".,;:!?'\"()-" for c in text)]
    in_chars = [c / len(text) for c in counts]
    owned = quality.owned_words()
    in_words = [sum(w in set(owned[k]) for w in WORD.findall(text)) / n for k in quality.WORD_CLASSES[:-1]]
    in_chars.append(1 - sum(in_chars))
    in_words.append(1 - sum(in_words))
    by_chars = [plain_distance(in_chars, r) for r in quality.CHAR_REFERENCES.values()]
    if in_words[-1] >= 1 - quality.FOREIGN_SHARE and min(by_chars) <= quality.ORDINARY_CHARS:
        return True
    return min((c + plain_distance(in_words, quality.WORD_REFERENCES[k])) / 2 for c, k in zip(by_chars, quality.CHAR_REFERENCES, strict=True)) <= quality.LIMIT


def test_run_against_a_plain_pipeline(spark, tmp_path):
    """All five stages of run() over prose with junk, copies, near copies, benchmark passages and personal
    data, against plain Python: documents kept, their texts by token count, and the number of sequences."""
    rng = random.Random(17)
    little = "the of and to in is that for it as was with be by on not he his but at are this have from".split()
    vocabulary = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(3, 8))) for _ in range(1500)]

    def prose(n):
        return [("" if k % 9 else "The ") + (rng.choice(little) if rng.random() < 0.3 else rng.choice(vocabulary)) + ("" if k % 8 else ".") for k in range(n)]

    items = [(k, " ".join(prose(25))) for k in range(3)] + [(9, None)]
    rows = []
    for i in range(110):
        words = prose(rng.randint(60, 300))
        if i % 11 == 3:
            words = [w + "#%&$"[k % 4] * 3 for k, w in enumerate(words)]
        elif i % 11 == 5 and rows:
            words = rows[-2][1].split()
        elif i % 11 == 7 and rows:
            words = rows[-3][1].split()
            words[rng.randrange(len(words))] = "changed"
        elif i % 11 == 9:
            words[30:30] = items[i % 3][1].split()
        elif i % 4 == 0:
            words[20:20] = ["zyzzyva", rng.choice(["kasimir@example.org", "+1 (234) 567-8901", "1.2.3.4"]), "queb"]
        rows.append((i, " ".join(words) if i != 50 else None, "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {i: t for i, t, *_ in rows if t and plain_kept(t)}
    sets = {i: decontaminate.shingles(t.lower().encode().split(), 5) for i, t in kept.items()}
    group = brute_components(sorted(kept), lambda a, b: kept[a] == kept[b] or jaccard(sets[a], sets[b]) >= 0.8)
    kept = {i: t for i, t in kept.items() if group[i] == i}
    wanted = [decontaminate.shingles(t.lower().encode().split(), 5) for _, t in items if t]
    kept = {i: t for i, t in kept.items() if all(len(w & sets[i]) < 0.8 * len(w) for w in wanted)}
    spans = brute_terms(list(kept.items()), privacy.SUPPORT, privacy.GENERALISE, privacy.REMOVE)
    clean = {}
    for i, t in kept.items():
        mine = [{"start": a, "kind": k, "end": b} for a, k, b, _ in privacy.base_spans(t)] + [{"start": a, "kind": k, "end": b} for a, b, k in spans[i]]
        clean[i] = privacy.masked(t, mine)
    assert 0 < len(clean) < 90 and any(spans.values())
    tokens = packing.WordTokens(packing.default_tokenizer())
    lengths = {i: len(tokens.ids([t.encode()])[0]) + 1 for i, t in clean.items()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.length for r in out} == lengths and {r.piece for r in out} == {0}
    crc = {i: zlib.crc32(np.append(tokens.ids([t.encode()])[0], 1).astype("<u4").tobytes()) for i, t in clean.items()}
    assert {r.doc_id: r.ids_crc32 for r in out} == crc
    assert len({r.sequence_id for r in out}) == packing.best_fit_plan({n: list(lengths.values()).count(n) for n in lengths.values()})[1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edge_cases(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = table(spark, EDGE)
    out = stage(spark, docs, SF).collect()
    assert stage(spark, docs.limit(0), SF).collect() == []
    ids = sorted(str(r.doc_id) for r in out)
    every = sorted(str(r[0]) for r in EDGE)
    if name == "quality_rules":
        assert not out  # short, or one passage again and again
    elif name == "simhash_near_dedup":
        assert ids == ["1", "3", "4", "5", "6", "7", "8", "9"]
    elif name == "best_fit_packing":
        assert sum(r.piece == 0 for r in out) == len(EDGE) and sum(r.length for r in out if r.doc_id == 1) == 1
    else:
        assert ids == every
    if name == "pii":
        text = {r.doc_id: r.text for r in out}
        assert text[1] is None and text[7] == "[EMAIL] tel [PHONE]; [IP], card [CARD]" and text[9] == EDGE[-1][1]
    if name != "best_fit_packing":
        assert stage(spark, docs, SF).columns == docs.columns
