"""The training-data operators against brute-force versions on small tables."""

from __future__ import annotations

import bisect
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import decontaminate, language, neardup, packing, passages, privacy, quality, sharding, simhash, substrings, urls
from quillspark.llm._util import checkpointed
from quillspark.llm.components import connected_components
from quillspark.llm.induced import SuffixQueue, sort_suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, bucket int, length string, f0 string, key int, component string"
SF01 = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(*r, *([None] * (5 - len(r))), 1, 2, "x", "y", 3, "z") for r in rows], SCHEMA)


def corpus(seed=3, n=60):
    """Small texts with copies, near copies, shared passages and repeats inside a text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(80)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(0, 120))
        if i % 7 == 3 and rows:
            text = rng.choice(rows)[1]
        elif i % 7 == 5 and rows:
            words = rng.choice(rows)[1].split()
            if words:
                words[rng.randrange(len(words))] = "zz"
            text = " ".join(words)
        elif i % 7 == 6:
            text = " ".join(words[:20]) + "  " + passage + "\n" + " ".join(words[20:]) + " " + passage[30:180]
        else:
            text = " ".join(words)
        rows.append((i * 3 + 1, text, "xy"[i % 2], f"s{i % 4}" if i % 9 else None, len(text)))
    return rows


EDGE = [
    (1, None, None, None, None),
    (None, "alpha beta gamma " * 30, "x", "s", 1),
    (None, "alpha beta gamma " * 30, "x", "s", 1),
    (2, "", "x", "s", 0),
    (3, " \t\n\x0b ", "y", "s", 5),
    (4, "alpha beta gamma " * 30, "x", None, 1),
    (4, "alpha beta gamma " * 30, "x", None, 1),
    (5, "word", "y", "t", 4),
    (6, "long " * 60_000 + "x" * 70_000, "y", "t", 1),
    (7, "a@b.c tel +1 (234) 567-8901; 1.2.3.4, card 4111 1111 1111 1111", "x", "t", 1),
    (8, "=" * 5000, "y", "t", 1),
    (9, "ünï\u00a0cödé \U0001f600 tail", "y", "t", 1),
]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


def brute_passages(rows, window):
    first = {}
    words = {i: (t or "").encode().split() for i, t, *_ in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize(("window", "period"), [(13, 7), (5, 3), (14, 13)])
def test_passages(docs, rows, window, period):
    out = passages.remove_repeated_passages(docs, window=window, period=period).collect()
    want = brute_passages(rows, window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out} == want
    for r in out:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_covers():
    for period, cover in passages.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def brute_substrings(rows, length):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows):
        b = (t or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                edge[k] += 1
                edge[k + length] -= 1
            seen.add(b[k : k + length])
        gone = np.cumsum(edge[:-1]) > 0
        out[i] = (len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize(("length", "grain", "memory"), [(100, 32, 1 << 20), (30, 10, 200), (12, 12, 64)])
def test_substrings(docs, rows, length, grain, memory):
    out = substrings.remove_repeated_substrings(docs, length=length, grain=grain, memory=memory).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept_bytes)) for r in out} == brute_substrings(rows, length)


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=0, max_size=120).map(lambda b: bytes(97 + x % 3 for x in b)), st.sampled_from([2, 5, 100]), st.sampled_from([3, 1 << 20]))
def test_suffix_order(raw, limit, memory):
    order, common = sort_suffixes(np.frombuffer(raw, np.uint8), limit, memory)
    cut = [raw[i : i + limit] for i in order]
    assert sorted(order.tolist()) == list(range(len(raw)))
    assert cut == sorted(cut)
    for k in range(1, len(cut)):
        same = next((n for n, (a, b) in enumerate(zip(cut[k - 1], cut[k])) if a != b), min(len(cut[k - 1]), len(cut[k])))
        assert common[k] == same


def test_suffix_queue_spills_in_order():
    queue = SuffixQueue(4)
    for k in range(5):
        queue.push(7, np.arange(k * 3, k * 3 + 3, dtype=np.int32), np.full(3, k, np.uint8))
    assert queue.spilled
    got = list(queue.take(7))
    assert np.concatenate([g[0] for g in got]).tolist() == list(range(15))
    assert list(queue.take(7)) == [] and not queue.has(7)
    queue.close()


@pytest.mark.parametrize("kind", ["prose", "period"])
def test_sorting_far_beyond_memory(kind):
    """A shard of sixty times `memory`: the same order, and what is held stays near the text's own size."""
    import tracemalloc

    rng = random.Random(13)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(3000)]
    raw = " ".join(rng.choices(vocabulary, k=160_000)).encode() if kind == "prose" else (b"abcab" * 1000 + b"z") * 200
    text, memory = np.frombuffer(raw, np.uint8), len(raw) // 60
    want = sort_suffixes(text, 100, 1 << 30)
    tracemalloc.start()
    order, common = sort_suffixes(text, 100, memory)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (order == want[0]).all() and (common == want[1]).all()
    # One flag a byte, blocks of `memory` entries, and for a text of one period its one tied group.
    assert peak < 8 * len(raw) if kind == "prose" else peak < 60 * len(raw)


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows):
    prints = {i: plain_fingerprint(t) for i, t, *_ in rows}
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert out == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("n", [10, 10**6, 10**9])
def test_block_masks_lose_no_pair(n):
    rng = random.Random(5)
    masks = simhash.block_masks(64, 4, n)
    assert masks
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), 4):
            b ^= 1 << k
        assert any(a & m == b & m for m in masks)


def test_tiles_between_sets():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    words = np.concatenate([base, base ^ np.uint64(5), rng.integers(0, 1 << 63, 30, np.uint64)])[:, None]
    words = words[np.argsort(np.bitwise_count(words[:, 0]), kind="stable")]
    got = {(int(a), int(b)) for x, y in simhash.tile_links(words, 4, tile=7) for a, b in zip(x, y)}
    assert got == {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if int(words[i, 0] ^ words[j, 0]).bit_count() <= 4}


def test_tiles_beyond_the_radius_are_skipped():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, 3000, np.uint64)[:, None]
    words = np.concatenate([words, words[:500] ^ np.uint64(9)])
    words = words[np.argsort(np.bitwise_count(words[:, 0]), kind="stable")]
    pop = np.bitwise_count(words[:, 0]).astype(np.int64)
    tiles = -(-len(words) // 64)
    taken = set(simhash.tiles_in_reach(pop, pop, 4, True, 64))
    assert len(taken) < 0.8 * tiles * (tiles + 1) / 2
    for i in range(0, len(words), 64):
        for j in range(i, len(words), 64):
            near = np.abs(pop[i : i + 64, None] - pop[None, j : j + 64]).min() <= 4
            assert near == ((i, j) in taken)


def test_tiles_carry_the_result_on_the_test_table(spark):
    """The links of sf0.1 come out of groups of many tiles, of which many pairs are skipped; they equal brute force."""
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    docs = simhash.with_fingerprints(spark.read.parquet(path).repartition(8), "doc_id", "text")
    prints = checkpointed(docs.groupBy("f0").agg({"__id": "min"}).toDF("f0", "least"))
    words = np.array(sorted(r.f0 for r in prints.collect()), np.int64).view(np.uint64)
    masks = simhash.block_masks(64, 4, len(words))
    met = skipped = 0
    for mask in masks:
        keys = words & np.uint64(mask)
        for key in np.unique(keys):
            a, b = simhash.tile_pair_counts(words[keys == key][:, None], 4)
            met, skipped = met + a, skipped + b
    assert len(words) > 9000 and len(masks) == 5 and skipped > 500 and met > 1000
    at = {int(w): k for k, w in enumerate(words.view(np.int64))}
    forest, plain = simhash.Forest(len(words)), simhash.Forest(len(words))
    links = simhash.block_links(prints, 4).collect()
    forest.link(np.array([at[r.f] for r in links]), np.array([at[r.f_to] for r in links]))
    for k in range(0, len(words), 256):
        x, y = np.nonzero(np.bitwise_count(words[k : k + 256, None] ^ words[None, :]) <= 4)
        plain.link(x + k, y)
    assert (forest.root == plain.root).all() and len(links) > 40


@pytest.mark.parametrize("hot", [40, 10**6])
def test_hot_slices_are_dealt_by_population_tiles(spark, hot):
    """Hundreds of fingerprints that share 52 bits, so that slices hold them all: dealt by tiles, linked as by brute force."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    base = np.uint64(0x0F0F_3C3C_A5A5_F000)
    words = np.unique(np.concatenate([base ^ rng.integers(0, 1 << 12, 300, np.uint64), rng.integers(0, 1 << 63, 60, np.uint64)]))
    rows = [(int(np.int64(w.view(np.int64))), None if k % 11 == 0 else k) for k, w in enumerate(words)]
    prints = spark.createDataFrame(rows, "f0 long, least long").repartition(3)
    links = simhash.block_links(prints, 4, hot=hot).collect()
    held = dict(rows)
    forest = simhash.Forest(len(words))
    at = {f: k for k, (f, _) in enumerate(rows)}
    for r in links:
        assert (held[r.f], held[r.f_to]) == (r.least, r.least_to)
        forest.link(np.array([at[r.f]]), np.array([at[r.f_to]]))
    want = brute_components(range(len(words)), lambda a, b: int(words[a] ^ words[b]).bit_count() <= 4)
    assert {k: int(c) for k, c in enumerate(forest.root)} == want and len(set(want.values())) < len(words) - 250
    # Pairs of tiles farther apart than the radius are never formed.
    counts = spark.createDataFrame([(0, 1, p, 45) for p in (10, 12, 30)], "mask int, key long, pop int, n long")
    tiles = simhash.tile_numbers(counts, 40)
    pairs = tiles.withColumn("pop", F.explode(F.array(F.lit(10), F.lit(12), F.lit(30)))).withColumn("part", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.explode(simhash.tile_pairs(4)).alias("p")).distinct().collect()
    assert {((r.p.low.pop, r.p.low.part), (r.p.high.pop, r.p.high.part)) for r in pairs} == {
        (a, b) for a in [(p, k) for p in (10, 12, 30) for k in (0, 1)] for b in [(p, k) for p in (10, 12, 30) for k in (0, 1)] if a <= b and abs(a[0] - b[0]) <= 4
    }


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (102, 102)], "a long, b long")
    out = {r.node: r.component for r in connected_components(edges).collect()}
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.mark.parametrize("block_bytes", [1 << 25, 2000])
def test_near_duplicates(spark, block_bytes):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, base = [], rng.choices(vocabulary, k=150)
    for i in range(40):
        words = list(base) if i % 2 else rng.choices(vocabulary, k=120)
        for _ in range(rng.randint(0, 4) if i % 2 else 0):
            words[rng.randrange(len(words))] = f"n{rng.random()}"
        rows.append((i, " ".join(words)))
    rows += [(50, rows[1][1]), (51, ""), (52, None), (53, rows[1][1])]
    sets = {i: decontaminate.shingles((t or "").encode().split(), 5) for i, t in rows}
    texts = {i: t or "" for i, t in rows}
    want = brute_components(sorted(sets), lambda a, b: texts[a] == texts[b] or jaccard(sets[a], sets[b]) >= 0.8)
    groups = neardup.near_duplicate_groups(table(spark, rows), radius=128, block_bytes=block_bytes)
    found = {hashlib.md5(texts[i].encode()).hexdigest(): i for i in sorted(texts, reverse=True)}
    by_group = {}
    for r in groups.collect():
        by_group.setdefault(r.group, set()).update(i for i in texts if hashlib.md5(texts[i].encode()).hexdigest() == r.key)
        assert found[r.key] == r.id
    assert {frozenset(g) for g in by_group.values()} == {frozenset(i for i in want if want[i] == c) for c in set(want.values())}
    kept = sorted(r.doc_id for r in neardup.drop_near_duplicates(table(spark, rows)).collect())
    assert set(kept) >= {c for c in set(want.values())}
    assert 50 not in kept and 53 not in kept


def test_contamination(spark):
    rng = random.Random(2)
    vocabulary = [f"t{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([3, 5, 8, 20, 31, 64])] + [(90, None), (91, ""), (92, "two words")]
    rows = []
    for i in range(50):
        words = rng.choices(vocabulary, k=rng.randint(0, 300))
        item = (items[i % len(items)][1] or "").split()
        if item and i % 2:
            for k in rng.sample(range(len(item)), min(len(item) // 20, 1)):
                item[k] = "changed"
            words = words[:50] + [w.upper() for w in item] + words[50:]
        rows.append((i, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in rows:
        w = t.lower().encode().split()
        for i, u in items:
            x = (u or "").lower().encode().split()
            s = decontaminate.shingles(x, 5)
            if s:
                shared = len(s & decontaminate.shingles(w, min(5, len(x))))
                if shared >= 0.8 * len(s):
                    want.add((d, i, len(s), shared))
    assert want
    for slice_bytes in (1 << 20, 100):
        out = decontaminate.find_contamination(table(spark, rows), bench, slice_bytes=slice_bytes).collect()
        assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in out} == want
        kept = decontaminate.drop_contaminated(table(spark, rows), bench, slice_bytes=slice_bytes).collect()
        assert sorted(r.doc_id for r in kept) == sorted({d for d, _ in rows} - {w[0] for w in want})


def plain_quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in (k, k + 1, k + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, rows):
    junk = [(900, "one | two # three\n" * 40), (901, "a b a b a b a b c"), (902, None), (903, "x\n\nx\n \ny\nx")]
    out = quality.quality_rules(table(spark, [*rows, *junk])).collect()
    for r in out:
        text = dict((i, t) for i, t, *_ in [*rows, *junk])[r.doc_id]
        n, chars, symbols, dup, rep = plain_quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.kept and r.base_failed)


def test_quality_verdict(spark):
    rng = random.Random(9)
    little = "the of and to in is that for it as was with be by on".split()
    prose = " ".join(("" if k % 9 else "The ") + (rng.choice(little) if rng.random() < 0.28 else "".join(rng.choices("abcdefghilmnoprstu", k=5))) + ("" if k % 8 else ".") for k in range(400))
    table_ = " | ".join(f"cell{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(90))
    kept = {r.doc_id: r.kept for r in quality.quality_rules(table(spark, [(1, prose), (2, table_)])).collect()}
    assert kept == {1: True, 2: False}
    good = quality.keep_good(table(spark, [(1, prose), (2, table_)]))
    assert [r.doc_id for r in good.collect()] == [1] and good.columns == table(spark, []).columns


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(packing.default_tokenizer())
    out = packing.pack_documents(docs, capacity=64, with_ids=True).collect()
    ids = {}
    for r in sorted(out, key=lambda r: r.piece):
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.start == len(ids.get(r.doc_id, [])) and len(r.ids) == r.length
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert ids == {i: tokens.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in rows}
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


@pytest.mark.parametrize("text", ["<|endoftext|> A<|startoftext|>B", "It's we'll the.,; X1y2 ... !?", "İstanbul ﬁne Å é 東京 ab\u0301", "\u00a0a\u2028b\x1cc\x85d", "", "THE the The. the"])
def test_words_tokenise_like_texts(text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer()).encode(text, add_special_tokens=False).ids
    flat, bounds = packing.WordTokens(packing.default_tokenizer(), limit=2).ids([text.encode(), text.encode()])
    assert flat.tolist() == plain + plain and bounds.tolist() == [0, len(plain), 2 * len(plain)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    runs, sequences = packing.best_fit_plan(counts, 50)
    left: list[int] = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(left, n)
        room = left.pop(k) if k < len(left) else 50
        bisect.insort(left, room - n)
    assert sequences == len(left)
    places = {(n, r): (first + (r - rank) // each, offset + (r - rank) % each * n) for k, (n, rank, first, each, offset) in enumerate(runs.tolist()) for r in range(rank, next((x[1] for x in runs[k + 1 :].tolist() if x[0] == n), counts[n]))}
    assert len(places) == len(lengths)
    filled = [0] * sequences
    for (n, _), (sequence, offset) in sorted(places.items(), key=lambda x: (x[1][0], x[1][1])):
        assert filled[sequence] == offset
        filled[sequence] += n
    assert all(f <= 50 for f in filled)


LUHN_TEXT = st.text(alphabet="0123456789 -+().@abcX_.%\n", max_size=60)


@settings(max_examples=300, deadline=None)
@given(LUHN_TEXT)
def test_base_spans(text):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    want = []
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 12 <= len(digits) <= 19 and privacy.luhn(digits), 9 <= len(digits) <= 15)[kind]
            if good:
                want.append((m.start(), kind, m.end()))
    assert [s[:3] for s in privacy.base_spans(text)] == sorted(want)


def test_disclosing_terms(spark):
    rows = [(k, f"Mail kasimir{k % 2}@example.org asks about zyzzyva number {k} again") for k in range(6)]
    rows += [(100 + k, f"again and again people asks about number things mail {k}") for k in range(200)]
    out = {r.doc_id: r for r in privacy.find_personal_data(table(spark, rows), support=2, generalise=0.3, remove=0.95).collect()}
    found = {rows[0][1][s.start : s.end] for s in out[0].terms}
    assert "zyzzyva" in found and "again" not in found
    assert not out[100].terms
    clean = {r.doc_id: r.text for r in privacy.sanitise(table(spark, rows), support=2, generalise=0.3, remove=0.95).collect()}
    assert "kasimir" not in clean[0] and "[EMAIL]" in clean[0] and "zyzzyva" not in clean[0]
    assert clean[100] == rows[6][1]
    alone = privacy.find_personal_data(table(spark, rows[:1] * 50 + rows[6:])).where("doc_id = 0").first()
    assert not alone.terms  # copies of one text are no support


def brute_terms(rows, support, generalise, remove):
    """{doc: {(start, end, kind)}} of disclosing terms, by counting documents in plain Python."""
    term = re.compile(f"[{privacy.LETTERS}]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    near, entities = {}, {}
    for i, t, *_ in rows:
        spans = privacy.base_spans(t or "")
        near[i] = privacy.contexts(t or "", spans)
        entities[i] = {e for _, k, _, v in spans for e in privacy.entity_keys(k, v)}
    words = {i: {w.translate(lower) for w in term.findall(t or "")} for i, t, *_ in rows}
    texts = {i: t or "" for i, t, *_ in rows}
    kinds = {}
    for e, t in {pair for found in near.values() for pair in found}:
        both = [i for i in near if (e, t) in near[i]]
        if len({texts[i] for i in both}) < support:
            continue
        n, n_c, n_t = len(rows), sum(e in x for x in entities.values()), sum(t in w for w in words.values())
        content = np.log2(n / n_c)
        share = np.log2(len(both) * n / (n_c * n_t)) / content if content > 0 else 0.0
        if share >= generalise - 1e-9:
            kinds[e, t] = privacy.REMOVED if share >= remove - 1e-9 else privacy.GENERALISED + len(str(n_t)) - 1
    return {i: {(a, b, kinds[p]) for p, places in near[i].items() if p in kinds for a, b in places} for i in near}


@pytest.mark.parametrize("most", [0, 1000])
def test_disclosure_against_counting(spark, monkeypatch, most):
    """Values, groups and kinds as entities, copies, near copies; with and without broadcasts."""
    monkeypatch.setattr(privacy.small, "__defaults__", (most,))
    monkeypatch.setattr(privacy.corpus_counts, "__defaults__", (most,))
    rng = random.Random(8)
    vocabulary = [c + "".join(rng.choices("abcdéÉßжŽ", k=6)) for c in "ABcdeжéß" for _ in range(12)]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = []
    for i in range(300):
        words = rng.choices(vocabulary, weights, k=30)
        if i % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(vocabulary[-20:]), rng.choice([f"ab{rng.randrange(4)}@m{rng.randrange(3)}.org", f"10.{rng.randrange(3)}.2.3", "+1 (234) 567-89" + str(rng.randrange(10, 13)), "4111 1111 1111 1111"]), rng.choice(vocabulary[-20:])]
        rows.append((i, " ".join(words)))
    rows += [(500 + k, rows[3 * k][1]) for k in range(20)] + [(600, None), (601, "")]
    want = brute_terms(rows, 2, 0.3, 0.45)
    out = privacy.find_personal_data(table(spark, rows), support=2, generalise=0.3, remove=0.45).collect()
    assert {r.doc_id: {(s.start, s.end, s.kind) for s in r.terms} for r in out} == want
    assert {k for spans in want.values() for *_, k in spans} >= {privacy.REMOVED, privacy.GENERALISED + 1}
    clean = {r.doc_id: r.text for r in privacy.sanitise(table(spark, rows), support=2, generalise=0.3, remove=0.45).collect()}
    for i, text in rows:
        spans = [{"start": a, "kind": k, "end": b} for a, k, b, _ in privacy.base_spans(text or "")] + [{"start": a, "kind": k, "end": b} for a, b, k in want[i]]
        assert clean[i] == (privacy.masked(text, spans) if spans else text)


def test_language(spark):
    rng = random.Random(4)
    sounds = {"aa": "aeio", "bb": "bdgk", "cc": "mnrl", "dd": "stfh", "ee": "vwxz", "ff": "cjqp"}
    rows = [(i, " ".join("".join(rng.choices(sounds[lang] + "u", k=6)) for _ in range(30)), lang) for i, lang in enumerate(sorted(sounds) * 40)]
    rows += [(1000, None, "aa"), (1001, "123 -- !!", "bb"), (None, rows[0][1], "aa"), (1002, rows[0][1], None)]
    docs = table(spark, rows)
    model = language.learn(docs, "doc_id", "text", "lang", per_language=20)
    assert model.languages == sorted(sounds)
    out = {r.doc_id: r for r in language.identify(docs, model).collect()}
    for i, _, lang in rows[:240]:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= out[i].score <= 1
    wrong = [i for i, _, lang in rows[:240] if out[i].held_out and out[i].lang_pred != lang]
    assert not wrong
    assert out[1000].lang_pred == out[1001].lang_pred == "und" and out[1000].score == 0
    assert out[1002].lang_pred == out[None].lang_pred == "aa" and out[None].held_out is False
    none = language.learn(docs.where("lang is null"), "doc_id", "text", "lang")
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def test_many_languages_in_blocks(spark):
    """More languages than one block of vectors can hold, each learned; every prediction as a plain decoder makes it."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    sounds = {f"l{k:03d}": rng.sample([a + b for a in letters for b in letters], 8) for k in range(60)}
    texts = [(lang, " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(40))) for lang in sounds for _ in range(24)]
    docs = table(spark, [(i, text, lang) for i, (lang, text) in enumerate(texts)])
    model = language.learn(docs, "doc_id", "text", "lang", per_language=12, block_rows=300)
    assert model.languages == sorted(sounds) and model.weights.shape == (language.BUCKETS, model.code.shape[1])
    out = {r.doc_id: r for r in language.identify(docs, model).collect()}
    wrong = sum(out[i].lang_pred != lang for i, (lang, _) in enumerate(texts) if out[i].held_out)
    assert wrong <= 0.02 * len(texts)
    for i in range(0, len(texts), 7):
        x = language.features(np.frombuffer(texts[i][1].encode(), np.uint8)).astype(np.float64)
        loss = [sum(model.trust[b] * np.log1p(np.exp(-word[b] * (x @ model.weights[:, b] + model.bias[b]))) for b in range(len(word))) for word in model.code]
        two = np.sort(loss)[:2]
        if two[1] - two[0] > 1e-3:
            assert out[i].lang_pred == model.languages[int(np.argmin(loss))]
        assert out[i].score == pytest.approx(1 / sum(np.exp(min(loss) - v) for v in loss), rel=1e-2)
        if abs(two[1] - two[0] - language.AMBIGUOUS_MARGIN) > 1e-3:
            assert out[i].ambiguous == (two[1] - two[0] < language.AMBIGUOUS_MARGIN)


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 6, 20):
        code = language.codewords(k)
        assert len({tuple(c) for c in code}) == k
        assert all(len(set(code[:, b])) == 2 for b in range(code.shape[1]))


def test_sharding(spark, rows):
    more = [(*r[:3], r[3]) for r in rows] + [(1000 + k, f"hot {k}", "x", "hot") for k in range(300)]
    out = sharding.assign_shards(table(spark, more), shards=7).collect()
    assert len(out) == len(more)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
        text = {m[0]: m[1] for m in more}[r.doc_id]
        assert (r.size, r.text_crc32) == (len(text.encode()) + 16, zlib.crc32(text.encode()))
    assert sorted(by) == list(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    sources = {}
    for m in more:
        sources[m[3]] = sources.get(m[3], 0) + 1
    for shard in by.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
        for source, n in sources.items():
            assert abs(sum(r.source == source for r in shard) - n * len(shard) / len(more)) <= 1 + len(sources) / 2


def test_shards_in_order_of_fractional_rank(spark, tmp_path):
    """Places recomputed from the law: sources ranked by the seeded draw, all rows by fractional rank."""
    from pyspark.sql import functions as F

    rng = random.Random(21)
    rows = [(None if k % 23 == 0 else k // 2, f"text {k}", "x", rng.choice(["a", "b", "b", "b", None])) for k in range(120)]
    df = table(spark, rows)
    drawn = df.select("doc_id", "text", "source", F.xxhash64(F.lit(sharding.SEED), "doc_id", F.crc32(F.col("text").cast("binary")), (F.octet_length("text") + 16).cast("long")).alias("draw")).collect()
    order = []
    for source in {r.source for r in drawn}:
        mine = sorted(r.draw for r in drawn if r.source == source)
        order += [((k + 0.5) / len(mine), source is not None, source or "", draw) for k, draw in enumerate(mine)]
    place = {draw: k for k, (*_, draw) in enumerate(sorted(order))}
    assert len(place) == len(rows)
    cut = [-(-s * len(rows) // 7) for s in range(8)]
    out = sharding.assign_shards(df, shards=7).collect()
    want = sorted((str(r.doc_id), zlib.crc32(r.text.encode()), next(s for s in range(7) if place[r.draw] < cut[s + 1])) for r in drawn)
    assert sorted((str(r.doc_id), r.text_crc32, r.shard) for r in out) == want
    sharding.write_shards(df, str(tmp_path / "shards"), shards=7)
    stored = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, stored.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert sorted((str(r.doc_id), zlib.crc32(r.text.encode()), r.shard_id) for r in stored.collect()) == want


def test_near_duplicates_are_found_at_the_default_radius(spark):
    """Pairs at a similarity of 0.8 to 0.95 at the radius in use, against all pairs: nine of ten at least."""
    rng = random.Random(31)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    rows, wanted = [], set()
    for k in range(150):
        words = rng.choices(vocabulary, k=rng.randint(80, 400))
        other = list(words)
        sets = [decontaminate.shingles([w.encode() for w in words], 5)] * 2
        target = rng.uniform(0.8, 0.95)
        while True:
            trial = list(other)
            trial[rng.randrange(len(trial))] = rng.choice(vocabulary)
            new = decontaminate.shingles([w.encode() for w in trial], 5)
            if jaccard(sets[0], new) < target:
                break
            other, sets = trial, [sets[0], new]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        wanted.add(k)
    groups = {}
    key = {hashlib.md5(t.encode()).hexdigest(): i for i, t in rows}
    for r in neardup.near_duplicate_groups(table(spark, rows)).collect():
        groups.setdefault(r.group, set()).add(key[r.key])
    assert all(len({i // 2 for i in g}) == 1 for g in groups.values())
    assert sum(len(g) == 2 for g in groups.values()) >= 0.9 * len(wanted)


URLS = [
    None, "", "no scheme", "http://net/", "http://net", "https://A.Net/x?y#z", "ftp://u@example.net/en/a/b?c", "http://EXAMPLE.net/en", "http://notexample.net/en/", "http://x.example.com/de/?q",
    "http://example.com/de", "http://org/fr/", "http://a.b.org/fr/x/#f", "http://org.fr/fr/", "x://y://net/z", "http://.net/", "http://net:80/", "http://ex.org?/fr/", "://net/a", "http://ünet.net/é",
    "http://m.CASINO-win.org/a", "http://casino.example.net/en/", "http://casinos-.org/fr/x", "http://org/casino/", "http://a-bet.c.d.e.f/" + "x" * 100_000, "http://mybets.com/",
]


def plain_verdict(url, entries):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, a) for a, h, p in entries if p and (host == h or host.endswith("." + h)) and path.startswith(p)]
    word = {a for a, h, p in entries if not p and h in re.split("[.-]", host)}
    rule, verdict = max(fit)[2:] if fit else (None, "block" if "block" in word else "allow")
    return host, path, rule, verdict


def test_urls(spark):
    entries = [*urls.RULES, *(("block", w, "") for w in urls.BLOCKED_WORDS.split())]
    df = spark.createDataFrame([(k, u, "<p>", "h", "p") for k, u in enumerate(URLS)], "page_id long, url string, html string, host string, path string")
    for r in urls.filter_urls(df).collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(URLS[r.page_id], entries), URLS[r.page_id]
    assert {r.verdict for r in urls.filter_urls(df, []).collect()} == {"allow"}
    renamed = df.withColumnRenamed("page_id", "__k").drop("host").withColumnRenamed("__k", "host")
    assert urls.filter_urls(renamed, id_col="host").select("verdict").count() == len(URLS)


def test_a_listed_table_in_several_files(spark, monkeypatch):
    """A list of thousands of full URLs and hosts, sorted by Spark into several files."""
    monkeypatch.setattr(urls.sorted_list, "__defaults__", (700,))
    rng = random.Random(6)
    hosts = [f"h{k % 97}.{'x' * (k % 5)}site{k % 53}.org" for k in range(900)]
    entries = [(rng.choice(urls.ACTIONS), h, f"/p{k % 41}/" + "q" * (k % 7)) for k, h in enumerate(hosts)] + [("block", f"word{k}", "") for k in range(900)]
    merged = {}
    for a, h, p in entries:
        merged[h, p] = max(a, merged.get((h, p), a))
    asked = [f"https://sub.{rng.choice(hosts)}/p{rng.randrange(50)}/{'q' * rng.randrange(9)}?x" for _ in range(400)] + [f"http://a.word{k * 3}-b.com/" for k in range(200, 400)]
    listed = spark.createDataFrame(entries, "action string, host string, path string")
    df = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, listed).collect()}
    want = {k: plain_verdict(u, [(a, h, p) for (h, p), a in merged.items()]) for k, u in enumerate(asked)}
    assert out == want
    assert len(urls.sorted_list(listed)[0]) > 1 and {v[3] for v in want.values()} == set(urls.ACTIONS)


def test_refused_urls(spark):
    """A list of thousands of whole URLs, one of them asked by a third of the rows, one hot URL not listed."""
    rng = random.Random(8)
    listed = [(f"h{k % 61}.org", f"/{k}") for k in range(5000)] + [("hot.org", "/x"), ("hot.org", "/x"), (None, "/n"), ("h0.org", None), ("casino.org", "/fine")]
    asked = [f"http://h{rng.randrange(61)}.org/{rng.randrange(9000)}?q" for _ in range(1500)] + ["https://HOT.org/x#a"] * 900 + ["http://cold.org/y"] * 900
    asked += ["http://h3.net/3", "http://casino.org/fine", None, "h0.org/0", "http://", "http://h0.org", "http://h0.org/" + "z" * 50_000]
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(asked)], "page_id long, url string, key string, slice string")
    refused = spark.createDataFrame(listed, "host string, path string")
    out = {r.page_id: r for r in urls.filter_urls(df, refused=refused).collect()}
    assert len(out) == len(asked)
    entries = [*urls.RULES, *(("block", w, "") for w in urls.BLOCKED_WORDS.split())]
    whole = {(h, p) for h, p in listed if h is not None and p is not None}
    seen = set()
    for k, url in enumerate(asked):
        host, path, rule, verdict = plain_verdict(url, entries)
        reason = "rule" if rule else "word" if verdict == "block" else "listed" if host and (host, path) in whole else "default"
        assert out[k][1:] == (host, path, rule, "block" if reason == "listed" else verdict, reason), url
        seen.add(reason)
    assert seen == set(urls.REASONS)
    for nothing in (df.limit(0), df):
        assert nothing.count() == urls.filter_urls(nothing, refused=refused.limit(0)).where("reason <> 'listed'").count()


def test_worthless_urls(spark):
    """A URL is listed if no page of it passes: thin, repeating and symbol-laden pages, but none without html."""
    good = (
        "Late in the evening we walked along the river, and the wind carried the smell of wet leaves. An old fisherman sat by the water and silently "
        "watched his float. None of us wanted to go home, although it was getting dark and rather cold. Then my sister told a funny story about the "
        "neighbour's cat, which had once climbed onto the roof of a school. Everybody laughed loudly, even the fisherman smiled and offered us hot tea."
    )
    pages = [
        ("http://a.com/good", f"<p>{good}</p>"), ("http://a.com/thin", "<p>few words</p>"), ("http://a.com/again", "<p>" + "buy this now " * 80 + "</p>"),
        ("http://a.com/both?x", f"<div>{good}"), ("http://A.com/both#y", "<p>thin"), ("http://a.com/none", None), ("http://a.com/empty", ""), (None, "<p>"), ("no scheme", "<p>"),
        ("http://a.com/script", f"<SCRIPT>{good}</script>few"), ("http://a.com/open", f"few<style>{good}"), ("http://a.com/tags", "<b " + good.replace(" ", "=") + ">few"),
    ]
    df = spark.createDataFrame([(*p, "t", "t") for p in pages], "url string, html string, text string, at string")
    found = {r.path for r in urls.worthless_urls(df).collect()}
    assert found == {"/thin", "/again", "/empty", "/script", "/open", "/tags"}


@pytest.mark.skipif(not os.path.isdir(SF01), reason="no test data")
def test_the_list_of_the_query_decides(spark):
    """On whole tables the list learned from the pages decides hundreds of rows."""
    reasons = {r.reason: r["count"] for r in urls.op8(spark, SF01).groupBy("reason").count().collect()}
    assert reasons["listed"] > 200 and set(reasons) == set(urls.REASONS)


def test_digest_collisions_are_confirmed(spark, tmp_path):
    """Every string under one of three digests, in the file's order."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    strings = sorted((len(s) % 3, s) for s in (f"h{k}.org/".encode() for k in range(120)))
    keys = np.array([k for k, _ in strings], np.uint64) ^ np.uint64(1 << 63)
    pq.write_table(pa.table({"key": keys.view(np.int64), "text": pa.array([s for _, s in strings], pa.binary()), "action": pa.array([1] * len(strings), pa.int32())}), tmp_path / "a.parquet")
    urls.lay_out([str(tmp_path / "a.parquet")], str(tmp_path / "array"))
    array = urls.DigestArray(str(tmp_path / "array"), [1], 2, digest=lambda s: len(s) % 3)
    assert [array.string(k) for k in array.find([b"h7.org/", b"h49.org/", b"h119.org/"])] == [b"h7.org/", b"h49.org/", b"h119.org/"]
    assert array.find([b"h777.org/", b""]) == [-1, -1]


OPERATORS = {
    "packing": lambda df: packing.pack_documents(df),
    "privacy": lambda df: privacy.find_personal_data(df),
    "sanitise": lambda df: privacy.sanitise(df),
    "language": lambda df: language.identify(df, language.learn(df, "doc_id", "text", "lang")),
    "passages": lambda df: passages.remove_repeated_passages(df),
    "sharding": lambda df: sharding.assign_shards(df),
    "simhash": lambda df: simhash.simhash_components(df),
    "contamination": lambda df: decontaminate.find_contamination(df, df, item_col="doc_id"),
    "decontaminated": lambda df: decontaminate.drop_contaminated(df, df.limit(0), item_col="doc_id"),
    "urls": lambda df: urls.filter_urls(df, id_col="doc_id", url_col="text"),
    "quality": lambda df: quality.quality_rules(df),
    "keep_good": lambda df: quality.keep_good(df),
    "substrings": lambda df: substrings.remove_repeated_substrings(df),
    "near_duplicates": lambda df: neardup.drop_near_duplicates(df),
}
#: The same with an id column named like an output or an inner column of the operator.
RENAMED = {
    "length": lambda df: packing.pack_documents(df, id_col="length").select("piece", "sequence_id"),
    "f0": lambda df: simhash.simhash_components(df, id_col="f0").select("fingerprint"),
    "id": lambda df: passages.remove_repeated_passages(df, id_col="id").select("n_words"),
    "kept_bytes": lambda df: substrings.remove_repeated_substrings(df, id_col="kept_bytes").select("n_bytes"),
    "base": lambda df: privacy.find_personal_data(df, id_col="base").select("terms"),
    "shard": lambda df: sharding.assign_shards(df, id_col="shard").select("slot"),
    "n_words": lambda df: quality.quality_rules(df, id_col="n_words").select("kept"),
    "score": lambda df: language.identify(df, language.learn(df, "score", "text", "lang"), id_col="score").select("lang_pred"),
}


@pytest.mark.parametrize("name", sorted(RENAMED))
def test_ids_named_like_outputs(spark, name):
    df = table(spark, EDGE).drop("id", "length", "f0").withColumnRenamed("doc_id", name)
    assert RENAMED[name](df).count() == len(EDGE) + (name == "length") * (RENAMED[name](df).where("piece > 0").count() if name == "length" else 0)


#: Operators that return every row once.
WHOLE = ("privacy", "sanitise", "language", "passages", "sharding", "simhash", "decontaminated", "urls", "quality", "substrings")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edge_cases(spark, name):
    out = OPERATORS[name](table(spark, EDGE)).collect()
    if name in WHOLE:
        assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in EDGE)
    assert OPERATORS[name](table(spark, [])).collect() == []
    if name == "passages":
        assert {r.doc_id: r.n_removed for r in out if r.doc_id in (1, 2, 3, 4, 5)} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
    if name == "simhash":
        zero = {r.doc_id: r for r in out}
        assert zero[1].fingerprint == zero[2].fingerprint == "0" * 16 and zero[1].component_id == zero[2].component_id == zero[3].component_id == 1
        assert {r.component_id for r in out if r.doc_id in (None, 4)} == {4}
    if name == "packing":
        assert sum(r.length for r in out if r.doc_id == 1) == 1
    if name == "near_duplicates":
        assert sum(r.doc_id == 4 for r in out) == 1 and sum(r.doc_id is None for r in out) == 0
    if name == "substrings":
        assert next(r for r in out if r.doc_id == 8).n_removed == 4999


def test_a_shard_far_larger_than_memory(tmp_path):
    """The traced peak of a whole shard is a fraction of its text; what is found does not depend on memory."""
    import tracemalloc

    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(3000)]
    passage = " ".join(rng.choices(vocabulary, k=60)).encode()
    pieces = []
    for k in range(450):
        body = " ".join(rng.choices(vocabulary, k=400)).encode()
        pieces.append(body[: k * 2] + passage + body[k * 2 :] if k % 9 == 0 else body)
    pieces += pieces[:5]
    doc, place = np.arange(len(pieces), dtype=np.int64), np.zeros(len(pieces), np.int32)
    size = np.array([len(p) for p in pieces], np.int32)
    keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), "<u8").reshape(-1, 2)
    raw = b"".join(pieces)

    def found(memory):
        with open(tmp_path / "shard", "wb+") as f:
            f.write(raw)
            f.flush()
            tracemalloc.start()
            spans = substrings._shard_spans(f, keys, doc, place, size, 100, memory)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
        return {tuple(map(int, x)) for s in spans for x in zip(*s, strict=True)}, peak

    want, _ = found(1 << 30)
    got, peak = found(len(raw) // 1000)
    assert got == want and len(got) == 5 + 49
    assert peak < len(raw) / 2  # about 350 bytes for each entry that memory allows


def test_near_duplicates_beside_inner_names(spark):
    """Columns named like those that the operator makes come through as they were."""
    df = table(spark, EDGE).withColumnRenamed("bucket", "__text_key").withColumnRenamed("key", "__doc").withColumnRenamed("f0", "__id").withColumnRenamed("length", "__key")
    out = neardup.drop_near_duplicates(df).collect()
    assert out[0].__fields__ == df.columns and {(r["__text_key"], r["__doc"], r["__id"], r["__key"]) for r in out} == {(2, 3, "y", "x")}
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in neardup.drop_near_duplicates(table(spark, EDGE)).collect())


def test_components_pass_over_loops_and_nulls(spark):
    edges = spark.createDataFrame([(1, 1), (3, 2), (2, 3), (None, 5), (6, None), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {2: 2, 3: 2}
    assert connected_components(edges.limit(0)).collect() == []
