"""Periodic runs of words, by a suffix automaton.

The automaton of a text has a state for each set of end positions that some string of words has; its links form a tree,
in which a state's set is the union of its children's. Sets are merged from the small into the large one. A
position that enters a set gets new neighbours: where such a distance d is at most the length of the state's longest
string, two equal strings of d words stand side by side, a square, and this seeds the run of period d around it. Each
run's squares are found so: the ends of its period's neighbours meet in some state for the first time.

Only stretches that can hold a run get an automaton: all words of a run of length >= 24 and >= 3 periods stand in windows
of WINDOW words that are found again at a distance of a period, which is a third of the stretch at most.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushtext.llm._common import map_arrow, word_hashes

#: Least length and least number of periods of a run, and words of the windows that a run repeats: 2 / 3 of LEAST.
LEAST, PERIODS = 24, 3
WINDOW = LEAST - LEAST // PERIODS
#: Positions of a block of a large set.
BLOCK = 2048
RESULTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Automaton:
    """The suffix automaton of a list of small whole numbers.

    Most states have one transition: it stands in two arrays, and only the others have a dict.
    """

    def __init__(self, words: list[int]):
        most = 2 * len(words) + 2
        self.length, self.link = array("i", bytes(4 * most)), array("i", bytes(4 * most))
        self.word, self.to = array("i", [-1]) * most, array("i", bytes(4 * most))
        self.more: dict[int, dict[int, int]] = {}
        self.end = array("i", [-1]) * most  # the position at which a state's prefix of the text ends; -1 for a clone
        self.link[0], self.size, self.last = -1, 1, 0
        for i, w in enumerate(words):
            self._add(i, w)

    def _add(self, i: int, w: int) -> None:
        length, link, word, to, more = self.length, self.link, self.word, self.to, self.more
        new = self.size
        self.size += 1
        length[new], self.end[new] = i + 1, i
        p = self.last
        while p >= 0:
            if word[p] == w:
                q = to[p]
                break
            held = more.get(p)
            if held is not None and w in held:
                q = held[w]
                break
            if word[p] < 0:
                word[p], to[p] = w, new
            elif held is None:
                more[p] = {w: new}
            else:
                held[w] = new
            p = link[p]
        else:
            link[new], self.last = 0, new
            return
        self.last = new
        if length[q] == length[p] + 1:
            link[new] = q
            return
        clone = self.size
        self.size += 1
        length[clone], link[clone], word[clone], to[clone] = length[p] + 1, link[q], word[q], to[q]
        if q in more:
            more[clone] = dict(more[q])
        link[q] = link[new] = clone
        while p >= 0:
            if word[p] == w:
                if to[p] != q:
                    return
                to[p] = clone
            else:
                held = more.get(p)
                if held is None or held.get(w) != q:
                    return
                held[w] = clone
            p = link[p]


class Positions:
    """An ordered set too large for one list: blocks of at most 2 * BLOCK positions."""

    def __init__(self, ordered: list[int]):
        self.blocks = [ordered[i : i + BLOCK] for i in range(0, len(ordered), BLOCK)]
        self.first = [b[0] for b in self.blocks]
        self.n = len(ordered)

    def __len__(self) -> int:
        return self.n

    def __iter__(self):
        for b in self.blocks:
            yield from b

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Takes x in; its neighbours."""
        k = max(bisect_right(self.first, x) - 1, 0)
        block = self.blocks[k]
        j = bisect_left(block, x)
        below = block[j - 1] if j else (self.blocks[k - 1][-1] if k else None)
        above = block[j] if j < len(block) else (self.first[k + 1] if k + 1 < len(self.blocks) else None)
        block.insert(j, x)
        self.first[k] = block[0]
        self.n += 1
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.first[k : k + 1] = [block[0], block[BLOCK]]
        return below, above


class Runs:
    """Maximal stretches around seeds, each found once: by period, their starts and ends in order."""

    def __init__(self, words: np.ndarray):
        self.words, self.known = words, {}

    def seed(self, end: int, period: int) -> None:
        """Two equal strings of period words side by side, the last of which ends at end."""
        starts, ends = self.known.setdefault(period, ([], []))
        k = bisect_right(starts, end) - 1
        if k >= 0 and end < ends[k]:
            return
        low, high = end - 2 * period + 1, end + 1
        w, n, step = self.words, len(self.words), 32
        while high < n:
            size = min(step, n - high)
            apart = np.flatnonzero(w[high : high + size] != w[high - period : high - period + size])
            if len(apart):
                high += int(apart[0])
                break
            high, step = high + size, 2 * step
        step = 32
        while low > 0:
            size = min(step, low)
            apart = np.flatnonzero(w[low - size : low] != w[low - size + period : low + period])
            if len(apart):
                low -= size - 1 - int(apart[-1])
                break
            low, step = low - size, 2 * step
        k = bisect_left(starts, low)
        starts.insert(k, low)
        ends.insert(k, high)

    def found(self) -> list[tuple[int, int, int]]:
        """start, length, period of the stretches that are runs: long enough, and of no smaller period."""
        out = []
        for q, (starts, ends) in self.known.items():
            for a, b in zip(starts, ends):
                if b - a >= max(LEAST, PERIODS * q) and not any(np.array_equal(self.words[a : b - q // p], self.words[a + q // p : b]) for p in _primes(q)):
                    out.append((a, b - a, q))
        return out


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length, period of all runs of an array of small whole numbers."""
    tree, runs, most = Automaton(words.tolist()), Runs(words), len(words) // PERIODS
    n = tree.size
    length = np.frombuffer(tree.length, np.int32)[:n]
    order = np.argsort(-length[1:], kind="stable") + 1
    # sets hold positions with their sign changed: what a state adds to its children's is mostly their greatest then
    held: list = [None] * n
    link, lengths, ends, seed = tree.link, tree.length, tree.end, runs.seed
    for v in order.tolist():
        own = held[v]
        reach = min(lengths[v], most)
        if (e := ends[v]) >= 0:
            if own is None:
                own = [-e]
            else:
                _enter(own, -e, reach, seed)
                own = _grown(own)
        held[v] = None
        parent = link[v]
        if not parent:
            continue
        other = held[parent]
        if other is None:
            held[parent] = own
            continue
        small, large = (own, other) if len(own) < len(other) else (other, own)
        reach = min(lengths[parent], most)
        for x in small:
            _enter(large, x, reach, seed)
        held[parent] = _grown(large)
    return runs.found()


def _grown(positions):
    return Positions(positions) if type(positions) is list and len(positions) > 2 * BLOCK else positions


def _enter(positions, x: int, reach: int, seed) -> None:
    """Takes x into an ordered set; its new neighbours seed squares if they are near enough."""
    if type(positions) is list:
        if positions[-1] < x:
            below, above = positions[-1], None
            positions.append(x)
        else:
            j = bisect_left(positions, x)
            below, above = (positions[j - 1] if j else None), positions[j]
            positions.insert(j, x)
    else:
        below, above = positions.add(x)
    if below is not None and x - below <= reach:
        seed(-below, x - below)
    if above is not None and above - x <= reach:
        seed(-x, above - x)


def windows(hashes: np.ndarray) -> np.ndarray:
    """A hash of each WINDOW words; equal windows have equal ones."""
    out, width = hashes, 1
    with np.errstate(over="ignore"):
        while width < WINDOW:
            step = min(width, WINDOW - width)
            mixed = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            out, width = mixed[: len(out) - step] + np.roll(out, -step)[: len(out) - step], width + step
    return out


def stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches, from and up to which words, that hold all runs."""
    if len(hashes) < LEAST:
        return []
    marks = windows(hashes)
    ordered = np.sort(marks)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    out, todo = [], [(0, len(hashes))]
    while todo:
        a, b = todo.pop()
        some = marks[a : b - WINDOW + 1]
        order = np.argsort(some, kind="stable")
        gap = np.diff(order)
        gap[some[order[1:]] != some[order[:-1]]] = b - a  # to the next window that is equal
        near = np.full(len(some), b - a)
        near[order[:-1]] = gap
        near[order[1:]] = np.minimum(near[order[1:]], gap)
        cover = np.zeros(b - a + 1, np.int32)
        hits = np.flatnonzero(near <= (b - a) // PERIODS)
        cover[hits] += 1
        cover[hits + WINDOW] -= 1
        inside = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8)]))
        parts = [(a + int(x), a + int(y)) for x, y in zip(np.flatnonzero(inside > 0), np.flatnonzero(inside < 0)) if y - x >= LEAST]
        # as long as a stretch gets shorter by a tenth, its parts may hold less
        for x, y in parts:
            (todo if y - x < 0.9 * (b - a) else out).append((x, y))
    return out


def words_of(doc_id: int | None, text: str | None) -> list[bytes]:
    """The words of a text; of every tenth document by checksum, those from some word on repeat with a period."""
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]
    return words


def document_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """start, length, period of all runs of a list of words, by start and period."""
    out = []
    for a, b in stretches(word_hashes().of(words)):
        number: dict = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words[a:b]), np.int32, b - a)
        out += [(a + s, n, q) for s, n, q in runs_of(ids)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that stand in a run after its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        cover[s + q] += 1
        cover[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the most periods (start, length, period, exponent_milli), and digests of all runs and of
    the words that collapsed() leaves: a row for each row of docs.

    A run is a stretch of words with smallest period q and length >= max(24, 3 * q) that can't be extended. Of
    runs with equal length/period that with the smallest start is named, then that with the smallest period. Null texts count as empty and
    have no runs: four nulls, and digests of no bytes. A null doc_id is left as it is, with the text's own words. Repeated
    rows fare alike. A very long text is worked on whole: memory is some 100 bytes for each word of a stretch, time
    n log n. An empty table gives no rows; columns other than doc_id and text don't matter.
    """

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            words = words_of(i, t.as_py())
            runs = document_runs(words)
            best = (None,) * 4
            if runs:
                top = runs[0]
                for r in runs[1:]:  # by start and period: the first of equals stays
                    if r[1] * top[2] > top[1] * r[2]:
                        top = r
                best = (*top, 1000 * top[1] // top[2])
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            out.append((i, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()))
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in RESULTS.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), f, RESULTS)
