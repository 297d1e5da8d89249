"""Maximal periodic runs of words, found by uniting suffix classes in order of decreasing LCP.

Each text is a sequence of words. Two suffixes with a common prefix (LCP) of L words that start q <= L
words apart spell a stretch of period q. For every run (s, length, q) the suffixes at s and s + q have an
LCP of exactly length - q and, once all suffixes that agree on that many words are in one class,
are neighbours in the ordered set of its positions. So:

1. Words of a batch get numbers; suffixes are ranked by prefix doubling, all texts of the batch at once.
   Suffixes that share no prefix long enough to seed a run leave after the first rounds.
2. LCPs of neighbours in suffix order follow from the ranks of the rounds.
3. Kruskal: neighbours are united by decreasing LCP (union-find, the smaller position set into the
   larger). Positions that become neighbours at distance q within the LCP seed a run of period q; the
   seed at its left end is the run, and q is its smallest period. (Were a smaller one possible, a
   position between the two would already be in their class.)

Exact: words are compared as bytes, nothing is hashed. A text's memory is proportional to its words
times the rounds it needs (the binary logarithm of its longest repeat); batches are bounded in
bytes, a longer text is taken alone. No shuffle.

Defined cases: a null or blank text has no words and no runs, its collapsed text is empty; repeated
rows and null ids are rows like others; an empty table gives no rows. Only the id and the text column are
read; other columns may have any name.
"""
from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytehash import texts_of
from .common import text_or_empty

BATCH = 2 << 20
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Words:
    """The words of several texts: codes (equal words of the batch, equal codes), places in the bytes, first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        count = len(offsets) - 1
        # A blank after every text keeps words apart.
        self.data = np.full(len(data) + count, 0x20, np.uint8)
        self.data[np.arange(len(data)) + np.repeat(np.arange(count), np.diff(offsets))] = data
        self.offsets = offsets + np.arange(count + 1)
        blank = BLANK[self.data]
        edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        self.start, self.end = edge[::2], edge[1::2]
        if len(edge):
            # Words and the gaps between them, as one Arrow column over the same bytes.
            cuts = pa.py_buffer(edge.astype(np.int64).tobytes())
            both = pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, cuts, pa.py_buffer(self.data)])
            self.code = np.asarray(both.dictionary_encode().indices)[::2].astype(np.int64)
        else:
            self.code = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.text = np.repeat(np.arange(count), np.diff(self.first))

    def joined(self, kept: np.ndarray) -> pa.Array:
        """The kept words of each text with one space between them."""
        start, end = self.start[kept], self.end[kept]
        self.data[end] = 0x20
        step = np.zeros(len(self.data) + 1, np.int8)
        step[start] += 1
        step[end + 1] -= 1
        # A text's last space goes, so that texts lie side by side.
        last = np.searchsorted(start, self.offsets[1:]) - 1
        filled = np.diff(np.concatenate([[-1], last])) > 0
        step[end[last[filled]]] -= 1
        step[end[last[filled]] + 1] += 1
        out = self.data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
        cut = np.zeros(len(self.offsets), np.int32)
        size = np.concatenate([[0], np.cumsum(end - start + 1)])
        cut[1:] = size[last + 1] - np.cumsum(filled)
        return pa.Array.from_buffers(pa.string(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(out))])


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and for each place in it the place where its group of equals begins."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def suffix_neighbours(code: np.ndarray, first: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in suffix order within a text that share at least ``least`` words: two positions and their LCP."""
    n = len(code)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none
    stop = first[1:][text]  # end of each position's text
    order, begin = _groups(text * (int(code.max()) + 1) + code)
    kind = np.int32 if n < 1 << 31 else np.int64
    rank = np.empty(n, kind)
    rank[order] = begin  # a class is named by the place of its first member
    rounds, width, matter = [rank], 1, None
    active = np.flatnonzero(np.bincount(begin, minlength=n)[rank] > 1)
    while True:
        if matter is None and 2 * width > least:
            matter = active  # all others share fewer than ``least`` words with any suffix
        if not len(active):
            break
        beyond = active + width
        second = np.where(beyond < stop[active], rank[np.minimum(beyond, n - 1)].astype(np.int64) + 1, 0)
        order, begin = _groups(rank[active].astype(np.int64) * (n + 1) + second)
        here = active[order]
        old = rank[here]
        lead = np.ones(len(here), bool)
        lead[1:] = old[1:] != old[:-1]
        lead = np.maximum.accumulate(np.where(lead, np.arange(len(here)), 0))
        rank = rank.copy()
        rank[here] = old + (begin - lead).astype(kind)
        rounds.append(rank)
        width *= 2
        active = np.sort(here[np.bincount(begin, minlength=len(here))[begin] > 1])
    if matter is None or not len(matter):
        return none, none, none
    ordered = matter[np.argsort(rank[matter])]
    a, b = ordered[:-1], ordered[1:]
    same = text[a] == text[b]
    a, b = a[same], b[same]
    lcp = np.zeros(len(a), np.int64)
    for level in range(len(rounds) - 2, -1, -1):
        left, right = a + lcp, b + lcp
        equal = rounds[level][np.minimum(left, n - 1)] == rounds[level][np.minimum(right, n - 1)]
        lcp[equal & (left < stop[a]) & (right < stop[b])] += 1 << level
    enough = lcp >= least
    return a[enough], b[enough], lcp[enough]


class Positions:
    """An ordered set of positions, in blocks so that very large sets stay cheap to extend."""

    SHIFT = 12
    __slots__ = ("blocks", "keys", "size")

    def __init__(self, at: int):
        self.blocks, self.keys, self.size = {at >> self.SHIFT: [at]}, [at >> self.SHIFT], 1

    def __iter__(self) -> Iterator[int]:
        for key in self.keys:
            yield from self.blocks[key]

    def around(self, at: int) -> tuple[int, int]:
        """The member before and the member after a position that is none; -1 where there is none."""
        key = at >> self.SHIFT
        block = self.blocks.get(key)
        k = bisect_left(self.keys, key)
        if block is None:
            return (self.blocks[self.keys[k - 1]][-1] if k else -1), (self.blocks[self.keys[k]][0] if k < len(self.keys) else -1)
        i = bisect_left(block, at)
        before = block[i - 1] if i else (self.blocks[self.keys[k - 1]][-1] if k else -1)
        after = block[i] if i < len(block) else (self.blocks[self.keys[k + 1]][0] if k + 1 < len(self.keys) else -1)
        return before, after

    def add(self, at: int) -> None:
        key = at >> self.SHIFT
        block = self.blocks.get(key)
        if block is None:
            self.blocks[key] = [at]
            insort(self.keys, key)
        else:
            insort(block, at)
        self.size += 1


def kruskal(a: np.ndarray, b: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(position, next position, LCP) of positions that become neighbours in their class, by decreasing LCP."""
    up: dict[int, int] = {}
    sets: dict[int, Positions] = {}

    def root(x: int) -> int:
        top = x
        while (parent := up.get(top, top)) != top:
            top = parent
        while x != top:
            up[x], x = top, up.get(x, top)
        return top

    order = np.argsort(-lcp, kind="stable")
    for x, y, common in zip(a[order].tolist(), b[order].tolist(), lcp[order].tolist()):
        x, y = root(x), root(y)
        large = sets.pop(x, None) or Positions(x)
        small = sets.pop(y, None) or Positions(y)
        if small.size > large.size:
            large, small, x, y = small, large, y, x
        up[y] = x
        # Neighbours are looked up before anything is added: members of one side were neighbours before.
        found = [(at, *large.around(at)) for at in small]
        last = -1
        for i, (at, before, after) in enumerate(found):
            if before > last:
                yield before, at, common
            if after >= 0 and (i + 1 == len(found) or found[i + 1][0] > after):
                yield at, after, common
            last = at
        for at, _, _ in found:
            large.add(at)
        sets[x] = large


def find_runs(words: Words, min_length: int, min_exponent: int) -> np.ndarray:
    """Runs of all texts as rows of (start within the batch, period, length), by start, then period."""
    # A run's seed has an LCP of length - q >= max(min_length - q, (min_exponent - 1) q).
    least = max(1, -(-min_length * (min_exponent - 1) // min_exponent))
    code, first, text = words.code, words.first, words.text
    out = []
    for before, after, common in kruskal(*suffix_neighbours(code, first, text, least)):
        q = after - before
        if q * (min_exponent - 1) <= common and q + common >= min_length:
            if before == first[text[before]] or code[before - 1] != code[after - 1]:
                out.append((before, q, q + common))
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def _columns(data: np.ndarray, offsets: np.ndarray, min_length: int, min_exponent: int) -> list[pa.Array]:
    words = Words(data, offsets)
    start, period, length = find_runs(words, min_length, min_exponent).T
    text = words.text[start]
    step = np.zeros(len(words.code) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    each = pa.StructArray.from_arrays([pa.array(start - words.first[text]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    cut = np.searchsorted(text, np.arange(len(offsets))).astype(np.int32)
    return [pa.array(np.diff(words.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), each), words.joined(np.cumsum(step[:-1]) == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """One row per input row: id, n_words, runs (start, length, period by start, then period), collapsed.

    A run is a stretch of words of smallest period q and at least max(min_length, min_exponent * q)
    words that no neighbouring word extends. ``collapsed`` keeps of every run its first q words only.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("runs need an exponent of at least 2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH, "right")) - 1)
                found = _columns(data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at], min_length, min_exponent)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, end - at), *found], names=["id", "n_words", "runs", "collapsed"])
                at = end

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)
