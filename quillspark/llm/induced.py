"""External induced sorting of suffixes, with common-prefix values (for operator 10).

The order of all suffixes follows from that of the few suffixes at left-most S positions: a suffix
one place to the left of a known one is put behind the suffixes of its first character that are
already there. The queue of each character receives its entries in final order, so a priority queue
keyed by (character, arrival) is one first-in-first-out run per character; queues that outgrow
`memory` items are appended to a file and read back in order, block by block, when their character is
reached. Entries are tuples (suffix, common prefix with the entry before). Blocks of entries are handled
at once in numpy: entries of one character that induce their own character form the next round.

The reduced string of left-most S substrings is ranked by one more induction (which names the
substrings, equal ones confirmed byte by byte) and by doubling over the names; ranks of each doubling
also give the common-prefix values of neighbours. Values and order are exact up to `limit` bytes and
cut off there.

Memory: whatever has more than `memory` entries (queues, flags, order, names, ranks, result; the text too, if the
caller maps it) lies in unnamed files of the task, mapped and handled in blocks of `memory` entries. A group of
suffixes that is still tied is sorted as a whole.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import IO

import numpy as np

from quillspark.llm._util import word_hashes

SEPARATOR = 0xFF  # never part of UTF-8
MEMORY = 1 << 18  # entries that are held at once; a shard of this many bytes or fewer never touches the disk

Block = tuple[np.ndarray, np.ndarray]


def _array(n: int, kind: type, memory: int) -> np.ndarray:
    """An array of n zeros, in a file of the task if there are more than `memory`."""
    if n <= memory:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * np.dtype(kind).itemsize)
        return np.asarray(np.memmap(f, kind, "r+", shape=(n,)))


def _blocks(n: int, size: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, size):
        yield a, min(n, a + size)


class SuffixQueue:
    """One ordered run of (suffix, common prefix) per character, in memory up to a bound, then on disk."""

    def __init__(self, memory: int) -> None:
        self.memory, self.held, self.file = memory, 0, None
        self.runs: list[list[tuple]] = [[] for _ in range(256)]
        self.spilled = 0

    def push(self, char: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        self.runs[char].append((suffixes, common))
        self.held += len(suffixes)
        if self.held > self.memory:
            self._spill()

    def push_sorted(self, chars: np.ndarray, suffixes: np.ndarray, common: np.ndarray) -> None:
        """A block of entries whose first characters ascend."""
        cut = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1]))) if len(chars) else np.zeros(0, np.int64)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(chars)], strict=True) if len(cut) else ():
            self.push(int(chars[a]), suffixes[a:b], common[a:b])

    def _spill(self) -> None:
        if self.file is None:
            self.file: IO[bytes] = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for run in self.runs:
            fresh = [entry for entry in run if isinstance(entry[0], np.ndarray)]  # behind what was spilled before
            if fresh:
                at, n = self.file.tell(), sum(len(e[0]) for e in fresh)
                for part, kind in ((0, np.int32), (1, np.uint8)):
                    for entry in fresh:
                        self.file.write(np.ascontiguousarray(entry[part], kind).tobytes())
                run[len(run) - len(fresh) :] = [(at, n)]
                self.spilled += n
        self.held = 0

    def has(self, char: int) -> bool:
        return bool(self.runs[char])

    def take(self, char: int, backwards: bool = False) -> Iterator[Block]:
        """The blocks of a character, read one by one, in order or from the last; the run is then empty."""
        run, self.runs[char] = self.runs[char], []
        # What is in memory leaves the count now, as a spill no longer sees it.
        self.held -= sum(len(e[0]) for e in run if isinstance(e[0], np.ndarray))
        for entry in reversed(run) if backwards else run:
            if isinstance(entry[0], np.ndarray):
                yield entry
            else:
                self.file.seek(entry[0])
                yield np.frombuffer(self.file.read(4 * entry[1]), np.int32), np.frombuffer(self.file.read(entry[1]), np.uint8)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(text: np.ndarray, block: int) -> np.ndarray:
    """True where a suffix is smaller than the next one (S type); the last one is not."""
    n = len(text)
    out = _array(n, bool, block)
    later, kind = -1, False  # the character and type behind the block
    for a, b in reversed(list(_blocks(n, block))):
        part = text[a:b].astype(np.int16)
        step = np.sign(np.append(part[1:], later) - part)
        known = np.flatnonzero(step)
        types = np.repeat(step[known] > 0, np.diff(known, prepend=-1))
        out[a:b] = np.append(types, np.full(b - a - len(types), kind))
        later, kind = part[0], out[a]
    return out


def _direct(text: np.ndarray, a: int, b: int, limit: int) -> int:
    k, most = 0, min(limit, len(text) - max(a, b))
    while k < most and text[a + k] == text[b + k]:
        k += 1
    return k


def _induce(text: np.ndarray, small: np.ndarray, seeds: SuffixQueue, limit: int, memory: int) -> Block:
    """All suffixes in order, and the common prefix of each with the one before, from sorted seeds.

    seeds: for each character the left-most S suffixes that begin with it, in order, with their common
    prefixes. Seeds are used up."""
    least = np.zeros(256, np.int16)  # smallest common prefix since the last push to each character

    def derive(queue: SuffixQueue, suffixes: np.ndarray, common: np.ndarray, want: bool) -> None:
        before = suffixes - 1
        fit = before >= 0
        fit &= small[before] == want
        keep = np.flatnonzero(fit)
        if not len(keep):
            np.minimum(least, int(common.min()), out=least)
            return
        char = text[before[keep]]
        order = np.argsort(char, kind="stable")
        keep, char = keep[order], char[order]
        cut = np.flatnonzero(np.concatenate(([True], char[1:] != char[:-1])))
        bounds = np.append(cut, len(char))
        present = char[cut]
        whole = int(common.min())
        tail = np.minimum.accumulate(common[::-1])[::-1]
        head = np.minimum.accumulate(common)
        # Smallest value over (previous kept place, this kept place], within each character.
        between = _range_min(common, np.concatenate(([0], keep[:-1])), keep)
        between[cut] = np.minimum(least[present], head[keep[cut]])
        pushed = np.minimum(between.astype(np.int16) + 1, limit).astype(np.uint8)
        last = keep[bounds[1:] - 1]
        after = np.where(last + 1 < len(common), tail[np.minimum(last + 1, len(common) - 1)], limit)
        np.minimum(least, whole, out=least)
        least[present] = after
        moved = before[keep]
        for k, c in enumerate(present.tolist()):
            queue.push(c, moved[bounds[k] : bounds[k + 1]], pushed[bounds[k] : bounds[k + 1]])

    def drain(queue: SuffixQueue, c: int, seen: SuffixQueue, want: bool) -> int:
        """Take the entries of c, with those they bring to c, keep them in `seen`, and tell the last one."""
        last = -1
        while queue.has(c):
            for blocks in _joined(queue.take(c), memory):
                suffixes, common = blocks
                if last < 0:
                    common = common.copy()
                    common[0] = 0
                seen.push(c, suffixes, common)
                last = int(suffixes[-1])
                derive(queue, suffixes, common, want)
        return last

    n = len(text)
    falling, rising, large, down = (SuffixQueue(memory) for _ in range(4))
    order, values, end = _array(n, np.int32, memory), _array(n, np.uint8, memory), n
    last_large = [-1] * 256
    try:
        falling.push(int(text[-1]), np.array([n - 1], np.int32), np.zeros(1, np.uint8))
        for c in range(256):
            least[:] = 0
            last_large[c] = drain(falling, c, large, False)
            first = True
            for suffixes, common in _joined(seeds.take(c), memory):
                if first:
                    common, first = common.copy(), False
                    common[0] = _direct(text, last_large[c], int(suffixes[0]), limit) if last_large[c] >= 0 else 0
                derive(falling, suffixes, common, False)
        for c in range(255, -1, -1):
            least[:] = 0
            last_small = drain(rising, c, down, True)
            seam = _direct(text, last_large[c], last_small, limit) if last_large[c] >= 0 and last_small >= 0 else 0
            open_ = -1  # the place that gets the common prefix with the next block
            for suffixes, common in down.take(c):  # from the greatest
                k = len(suffixes)
                if open_ >= 0:
                    values[open_] = common[0]
                order[end - k : end] = suffixes[::-1]
                values[end - k + 1 : end] = common[:0:-1]
                end -= k
                open_ = end
            if open_ >= 0:
                values[open_] = seam
            for suffixes, common in large.take(c, backwards=True):
                back = np.empty_like(common)
                back[0], back[1:] = seam, common[:0:-1]
                seam = int(common[0])
                derive(rising, suffixes[::-1], back, True)
                order[end - len(suffixes) : end], values[end - len(suffixes) : end] = suffixes, common
                end -= len(suffixes)
        return order, values
    finally:
        for queue in (falling, rising, large, down):
            queue.close()


def _joined(blocks: Iterator[Block], most: int) -> Iterator[Block]:
    """Small blocks as larger ones of about `most` entries at most."""
    held, n = [], 0
    for block in blocks:
        if held and n + len(block[0]) > most:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
        held.append(block)
        n += len(block[0])
    if held:
        yield held[0] if len(held) == 1 else tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _equal_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """For each pair of places whether the size bytes from both on are equal, some pairs at a time."""
    out, upto, k = np.ones(len(a), bool), np.cumsum(size), 0
    while k < len(a):
        j = max(k + 1, int(np.searchsorted(upto, upto[k] - size[k] + block, side="right")))
        n = size[k:j]
        to = np.cumsum(n) - n
        place = np.arange(int(n.sum()))
        differ = text[np.repeat(a[k:j] - to, n) + place] != text[np.repeat(b[k:j] - to, n) + place]
        out[k:j] = np.add.reduceat(differ, to) == 0
        k = j
    return out


def _range_min(values: np.ndarray, after: np.ndarray, to: np.ndarray) -> np.ndarray:
    """min(values[after+1 .. to]) for each pair with after < to; other pairs get any value."""
    if not len(to):
        return np.zeros(0, values.dtype)
    lo, hi = after + 1, to + 1
    good = lo < hi
    out = np.full(len(to), 255, values.dtype)
    span = np.where(good, hi - lo, 1)
    level, step, table = 0, 1, values
    most = int(span.max())
    while True:
        pick = np.flatnonzero(good & (span >= step) & (span < 2 * step))
        if len(pick):
            out[pick] = np.minimum(table[lo[pick]], table[hi[pick] - step])
        if 2 * step > most:
            return out
        table = np.minimum(table[: len(table) - step], table[step:])
        level, step = level + 1, 2 * step


def sort_suffixes(text: np.ndarray, limit: int = 100, memory: int = MEMORY) -> Block:
    """Suffixes of text in the order of their first `limit` bytes, and common prefixes up to `limit`.

    memory: entries that are held at once (see above). An empty text gives empty arrays. limit is at most
    254, a text under 2 GB (positions are 32-bit)."""
    n = len(text)
    if n >= 1 << 31:
        raise ValueError("a shard of 2 GB or more: raise the number of partitions")
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.uint8)
    block = max(16, memory)
    small = _types(text, block)

    def leftmost(a: int, b: int) -> np.ndarray:
        return np.flatnonzero(small[max(a, 1) : b] & ~small[max(a, 1) - 1 : b - 1]).astype(np.int32) + max(a, 1)

    m = sum(len(leftmost(a, b)) for a, b in _blocks(n, block))
    first = _array(m, np.int32, memory)
    at = 0
    seeds = SuffixQueue(memory)
    for a, b in _blocks(n, block):
        part = leftmost(a, b)
        first[at : at + len(part)] = part
        at += len(part)
        # To name the substrings between these places, induce from their first characters alone.
        by_char = part[np.argsort(text[part], kind="stable")]
        seeds.push_sorted(text[by_char], by_char, np.zeros(len(part), np.uint8))
    rough, values = _induce(text, small, seeds, limit, memory)
    seeds.close()
    if not m:
        return rough, values
    del values
    order = _array(m, np.int32, memory)
    at = 0
    for a, b in _blocks(n, block):
        place = rough[a:b]
        place = place[small[place] & (place > 0) & ~small[np.maximum(place, 1) - 1]]
        order[at : at + len(place)] = np.searchsorted(first, place)
        at += len(place)
    del rough

    def ends(a: int, b: int) -> np.ndarray:
        """Ends of the substrings a..b-1, each with the first character of the next."""
        return np.append(first[a + 1 : b], first[b] if b < m else n).astype(np.int64) + (np.arange(a, b) < m - 1)

    names = _array(m, np.uint64, memory)
    for a, b in _blocks(m, block):
        names[a:b] = word_hashes(text, first[a:b].astype(np.int64), np.minimum(ends(a, b), n))
    names[m - 1] ^= np.uint64(1)
    length = _array(m, np.int32, memory)
    for a, b in _blocks(m, block):
        length[a:b] = np.minimum(ends(a, b), n) - first[a:b]
    start, rank, level = _array(m, bool, memory), _array(m, np.int32, memory), 0
    for a, b in _blocks(m, block):
        item = order[max(0, a - 1) : b].astype(np.int64)
        name = names[item]
        new = name[1:] != name[:-1]
        # Equal substrings are neighbours in the induced order; a hash only spares the comparison of the others.
        alike = np.flatnonzero(~new)
        one, two = item[alike], item[alike + 1]
        new[alike] = (length[one] != length[two]) | ~_equal_bytes(text, first[one].astype(np.int64), first[two].astype(np.int64), np.minimum(length[one], length[two]).astype(np.int64))
        start[a:b] = np.append(True, new) if a == 0 else new
        here = np.maximum.accumulate(np.where(start[a:b], np.arange(a, b), 0))
        here = np.maximum(here, level)
        rank[order[a:b]] = here
        level = int(here[-1])
    del names

    # Double until names cover `limit` bytes or tell all suffixes apart. A rank is the place of the
    # first suffix of its group, so that only suffixes that are still tied are sorted again.
    def copy() -> np.ndarray:
        out = _array(m, np.int32, memory)
        for a, b in _blocks(m, block):
            out[a:b] = rank[a:b]
        return out

    ranks, reach, open_ = [copy()], 1, True
    while open_ and 2 * reach <= limit:  # a substring has two bytes at least
        old, open_, a = ranks[-1], False, 0
        while a < m:
            b = min(m, a + block)
            while b < m and not start[b]:  # up to the next group
                more = np.flatnonzero(start[b : b + block])
                b = b + int(more[0]) if len(more) else min(m, b + block)
            begins = start[a:b]
            tied = np.flatnonzero(~begins | ~np.append(begins[1:], True)) + a
            if len(tied):
                item = order[tied].astype(np.int64)
                key = old[item].astype(np.int64) * (m + 1)
                after = item + reach
                key += np.where(after < m, old[np.minimum(after, m - 1)].astype(np.int64) + 1, 0)
                sort = np.argsort(key, kind="stable")
                item, key = item[sort], key[sort]
                order[tied] = item
                new = np.concatenate(([True], key[1:] != key[:-1]))
                rank[item] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
                start[tied] = new
                open_ |= not new.all()
            a = b
        ranks.append(copy())
        reach *= 2

    def begin(item: np.ndarray) -> np.ndarray:
        return np.where(item < m, first[np.minimum(item, m - 1)], n).astype(np.int64)

    seeds = SuffixQueue(memory)
    for at, to in _blocks(m, block):
        item = order[max(0, at - 1) : to].astype(np.int64)
        covered = np.zeros(len(item) - 1, np.int64)
        equal = np.flatnonzero(ranks[0][item[:-1]] == ranks[0][item[1:]])
        if len(equal):
            one, two = item[equal], item[equal + 1]
            a, b = one.copy(), two.copy()
            for k in range(len(ranks) - 1, -1, -1):
                fit = np.flatnonzero((a < m) & (b < m))
                fit = fit[ranks[k][a[fit]] == ranks[k][b[fit]]]
                a[fit] = np.minimum(a[fit] + (1 << k), m)
                b[fit] = np.minimum(b[fit] + (1 << k), m)
            covered[equal] = np.minimum(begin(a) - begin(one), begin(b) - begin(two))
        places = first[item].astype(np.int64)
        x, y = places[:-1] + covered, places[1:] + covered
        # Pairs that part in their first eight bytes, most of them, by one comparison of big-endian words.
        heads = text[np.minimum(places[:, None] + np.arange(8), n - 1)].view(">u8").reshape(-1).astype(np.uint64)
        apart = heads[1:] ^ heads[:-1]
        early = (covered == 0) & (apart != 0) & (np.maximum(x, y) + 8 <= n)
        for k in range(1, 8):
            covered += early & (apart < np.uint64(1 << (64 - 8 * k)))
        live = np.flatnonzero(~early & (covered < limit) & (x < n) & (y < n))
        while len(live):
            live = live[text[x[live]] == text[y[live]]]
            covered[live] += 1
            x[live] += 1
            y[live] += 1
            live = live[(covered[live] < limit) & (x[live] < n) & (y[live] < n)]
        common = np.minimum(covered, limit).astype(np.uint8)
        if at == 0:
            common = np.append(np.uint8(0), common)
        mine = first[order[at:to]]
        seeds.push_sorted(text[mine], np.asarray(mine), common)
    result = _induce(text, small, seeds, limit, memory)
    seeds.close()
    return result
