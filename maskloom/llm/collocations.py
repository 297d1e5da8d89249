"""Phrase collocations from a suffix tree of words, built in independent parts that fit in memory.

1. Words are counted per language. A phrase of ``least`` occurrences has no rarer word, so rare words end
   suffixes like the end of a piece. Tasks know them by a bit table of word hashes (2 bits a distinct
   word, 16 MB at most), whose bits stand for sums: a word passes if all words of its bit together are not rare.
2. Vertical partitioning. Suffixes are cut into parts by their first words. A prefix that more than
   ``budget`` suffixes share is made longer by a word (up to ``depth``), the others are packed, in order
   of their hash, into groups of at most twice the budget. Only group limits and long-prefix hashes
   reach the driver: at most suffixes / budget numbers each.
3. Every task sorts its suffixes, cut at ``depth`` words, combines equal ones, and sends each group
   its share. A group sorts what it gets: that is its part of the tree, leaves in order with their totals,
   and the count of a node is the total of the leaves below it.
4. Phrases of at least ``least`` occurrences are scored at their weakest cut; a phrase that mostly
   occurs inside a longer one goes.

Hashes only route; words are compared as bytes and counts are whole numbers (products in decimals).

Defined cases: a null text is empty; a null language is ``und``; a piece shorter than a phrase holds
none; repeated rows count each time; an empty table gives no rows. Only the text and the language are
read; other columns may have any name. A text of any length is taken whole, alone in its batch.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bytehash import U, mix, pieces
from .common import shuffle_partitions, stage, text_or_empty

DEPTH, LEAST, BUDGET, FLUSH = 4, 30, 2_000_000, 2_000_000
NODES = "lang string, phrase string, m int, f long"
TAB = "\t"  # no word holds a tab: language and word can be taken apart again

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _CUT.copy()
_GAP[[0x20, 0x09]] = True


class Lexicon:
    """Numbers from 1 on for (language, word) pairs, in order of arrival."""

    def __init__(self):
        self.number: dict[bytes, int] = {}

    def of(self, entries: list[bytes]) -> np.ndarray:
        number = self.number
        return np.fromiter((number.setdefault(e, len(number) + 1) for e in entries), np.int64, len(entries))

    def __len__(self) -> int:
        return len(self.number)

    def hashes(self) -> np.ndarray:
        """Hash by number; 0 for no word."""
        return np.concatenate([np.zeros(1, U), hashed(self.number)])


def hashed(entries) -> np.ndarray:
    """Spark's ``xxhash64`` of language, tab and word."""
    return np.fromiter((xxhash.xxh64_intdigest(e, 42) for e in entries), U, len(entries))


def numbered(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of several texts in order, and the number of the piece each stands in.

    With a bit table ``often``, words whose bit is not set are left out and end a piece.
    """
    count = len(offsets) - 1
    spaced = np.full(len(data) + count, 0x0A, np.uint8)  # a text ends its last piece
    ends = offsets[1:] + np.arange(count)
    own = np.ones(len(spaced), bool)
    own[ends] = False
    spaced[own] = _LOWER[data]
    edge = np.flatnonzero(np.diff(_GAP[spaced], prepend=True, append=True))
    if not len(edge):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = edge[::2]
    both = pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int64).tobytes()), pa.py_buffer(spaced)]).dictionary_encode()
    langs = rows.column("lang").dictionary_encode()
    width = len(both.dictionary)
    # Words of a text lie between two text ends: its language is repeated for them.
    first = np.concatenate([[0], np.searchsorted(start, ends)])
    code = np.asarray(both.indices)[::2] + np.repeat(np.asarray(langs.indices).astype(np.int64) * width, np.diff(first))
    used = np.zeros(width * len(langs.dictionary), bool)
    used[code] = True
    used = np.flatnonzero(used)
    names = [f"{x}{TAB}".encode() for x in langs.dictionary.to_pylist()]
    values = both.dictionary.take(pa.array(used % width)).to_pylist()
    entries = [names[g] + v for g, v in zip((used // width).tolist(), values)]
    piece = np.cumsum(_CUT[spaced], dtype=np.int32)[start]
    number = np.zeros(width * len(langs.dictionary), np.int64)
    if often is None:
        number[used] = lexicon.of(entries)
        return number[code], piece
    bit = hashed(entries) & U(8 * len(often) - 1)
    kept = np.flatnonzero(often[bit >> U(3)] >> (bit & U(7)).astype(np.uint8) & 1)
    number[used[kept]] = lexicon.of([entries[i] for i in kept.tolist()])
    number = number[code]
    kept = number > 0
    return number[kept], (piece + np.cumsum(~kept))[kept]


def often_table(words: DataFrame, least: int) -> np.ndarray:
    """Bits of word hashes whose words occur at least ``least`` times together."""
    distinct = words.count()
    bits = min(27, max(16, (2 * distinct).bit_length()))
    part, place = F.expr(f"shiftright(hash & {(1 << bits) - 1}L, 16)"), F.expr("CAST(hash & 65535L AS INT)")
    sums = words.groupBy(part.alias("part"), place.alias("place")).agg(F.sum("f").alias("f")).filter(F.col("f") >= least)

    def run(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << 16, bool)
        out[np.asarray(table.column("place"))] = True
        return pa.table([table.column("part").slice(0, 1), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    segments = sums.groupBy("part").applyInArrow(run, "part long, bits binary").toArrow()  # at most 2048 rows of 8 KB
    table = np.zeros((1 << bits - 16, 1 << 13), np.uint8)
    for k, raw in zip(segments.column("part").to_pylist(), segments.column("bits").to_pylist()):
        table[k] = np.frombuffer(raw, np.uint8)
    return table.ravel()


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(text_or_empty(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, f): occurrences of every word, per language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, total = Lexicon(), np.zeros(1 << 16, np.int64)

        def out() -> pa.RecordBatch:
            n = total[1:len(lexicon) + 1]
            return pa.RecordBatch.from_arrays([pa.array(list(lexicon.number), pa.binary()).cast(pa.string()), pa.array(n)], names=["entry", "f"])

        for rows, data, offsets in pieces(batches, limit=4 << 20):
            number, _ = numbered(rows, data, offsets, lexicon)
            if len(lexicon) >= len(total):
                total = np.concatenate([total, np.zeros(len(lexicon) + 1, np.int64)])
            seen = np.bincount(number, minlength=1)
            total[:len(seen)] += seen
            if len(lexicon) > 500_000:
                yield out()
                lexicon, total = Lexicon(), np.zeros(1 << 16, np.int64)
        if len(lexicon):
            yield out()

    counted = _rows(docs, text_col, lang_col).mapInArrow(run, "entry string, f long").groupBy("entry").agg(F.sum("f").alias("f"))
    word = F.substring_index("entry", TAB, -1)
    lang = F.substring("entry", F.lit(1), F.length("entry") - F.length(word) - 1)
    return counted.select(lang.alias("lang"), word.alias("word"), "f", F.xxhash64("entry").alias("hash"))


def followed(number: np.ndarray, piece: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes cut at ``depth`` words, one per row; 0 beyond the end of a piece."""
    out = np.zeros((depth, len(number)), np.int64)
    out[0] = number
    for d in range(1, depth):
        out[d, :-d or None] = np.where(piece[d:] == piece[:-d], number[d:], 0) if len(number) > d else 0
    return out


def prefix_hashes(suffixes: np.ndarray, hashes: np.ndarray) -> Iterator[np.ndarray]:
    """Hash of the first one, two, ... words of each suffix."""
    h = hashes[suffixes[0]]
    yield h
    for column in suffixes[1:]:
        h = mix(h * U(0x9E3779B97F4A7C15) + hashes[column])
        yield h


def _within(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


class Partition:
    """Where suffixes go: by level, the prefixes that are made longer and the last hash of each group."""

    def __init__(self):
        self.long: list[np.ndarray] = []
        self.last: list[np.ndarray] = []

    def route(self, suffixes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group of each suffix, and how many of its first words share their node with other groups."""
        group = np.zeros(suffixes.shape[1], np.int64)
        shared = np.zeros(suffixes.shape[1], np.int64)
        left, first = np.arange(suffixes.shape[1]), 0
        for level, h in enumerate(prefix_hashes(suffixes, hashes)):
            if level == len(self.last):
                break
            here = h[left]
            longer = _within(self.long[level], here)
            group[left[~longer]] = first + np.minimum(np.searchsorted(self.last[level], here[~longer]), max(0, len(self.last[level]) - 1))
            left = left[longer]
            shared[left] = level + 1
            first += max(1, len(self.last[level]))
        return group, shared


def _packed(counts: DataFrame, budget: int) -> np.ndarray:
    """Last hash of every group: (hash, f) rows packed in order of hash up to ``budget``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = 0, None
        for batch in batches:
            key, f = np.asarray(batch.column("hash")).view(U), np.asarray(batch.column("f"))
            if not len(key):
                continue
            sums = total + np.cumsum(f)
            cut = np.flatnonzero(sums // budget > np.concatenate([[total], sums[:-1]]) // budget)
            if len(cut):
                yield pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64))], names=["hash"])
            total, at = int(sums[-1]), key[-1]
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.array([at], U).view(np.int64))], names=["hash"])

    # Unsigned order of the hashes: the sign bit is flipped for Spark's ranges.
    order = F.expr("hash ^ (shiftleft(1L, 63))")
    ordered = counts.repartitionByRange(shuffle_partitions(counts.sparkSession), order).sortWithinPartitions(order)
    return np.unique(np.asarray(ordered.select("hash", "f").mapInArrow(run, "hash long").toArrow().column("hash")).view(U))


def _counts_below(rows: DataFrame, partition: Partition, level: int, often: np.ndarray) -> DataFrame:
    """(hash, f) of the prefixes of ``level + 1`` words below the long ones of the level before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, limit=4 << 20):
            lexicon = Lexicon()
            suffixes = followed(*numbered(batch, data, offsets, lexicon, often), level + 1)
            above, here = list(prefix_hashes(suffixes, lexicon.hashes()))[-2:]
            keys, n = np.unique(here[_within(partition.long[level - 1], above)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["hash", "f"])
    return rows.mapInArrow(run, "hash long, f long").groupBy("hash").agg(F.sum("f").alias("f"))


def plan_groups(rows: DataFrame, words: DataFrame, often: np.ndarray, depth: int, budget: int) -> Partition:
    """Vertical partitioning of all suffixes of ``rows``; ``words`` are their counted words."""
    out, counts = Partition(), words.select("hash", "f")
    for level in range(depth):
        last = level == depth - 1  # at full depth a prefix is a leaf: one row however often it occurs
        out.last.append(_packed(counts if last else counts.filter(F.col("f") <= budget), budget))
        long = np.zeros(0, U) if last else np.asarray(counts.filter(F.col("f") > budget).select("hash").toArrow().column("hash")).view(U)
        out.long.append(np.sort(long))
        if not len(long):
            break
        counts = stage(_counts_below(rows, out, level + 1, often), "prefix-counts")
    return out


def combine(suffixes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes in order, and how often each occurs."""
    if not suffixes.shape[1]:
        return suffixes, np.zeros(0, np.int64)
    # Each column by the ranks of its own numbers, in as few bits as they need.
    ranked, numbers = [], []
    for column in suffixes:
        used = np.zeros(int(column.max()) + 1, bool)
        used[column] = True
        ranked.append((np.cumsum(used) - 1)[column])
        numbers.append(np.flatnonzero(used))
    bits = [max(1, (len(x) - 1).bit_length()) for x in numbers]
    if sum(bits) <= 64:
        key = np.zeros(suffixes.shape[1], U)
        for column, b in zip(ranked, bits):
            key = key << U(b) | column.astype(U)
        if n is None:
            key.sort()
        else:
            order = np.argsort(key)
            key, n = key[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out, rest = np.zeros((len(bits), len(new)), np.int64), key[new]
        for d in range(len(bits) - 1, -1, -1):
            out[d] = numbers[d][(rest & U((1 << bits[d]) - 1)).astype(np.int64)]
            rest = rest >> U(bits[d])
        count = len(key)
    else:
        order = np.lexsort(suffixes[::-1])
        suffixes = suffixes[:, order]
        n = None if n is None else n[order]
        count = len(order)
        new = np.flatnonzero(np.concatenate([[True], (suffixes[:, 1:] != suffixes[:, :-1]).any(axis=0)]))
        out = suffixes[:, new]
    return out, np.diff(np.append(new, count)) if n is None else np.add.reduceat(n, new)


def pack(suffixes: np.ndarray, n: np.ndarray, entries: list[bytes]) -> bytes:
    """A group's share of one task: the words it uses, then numbers and counts by column, low and high bytes apart."""
    used = np.zeros(len(entries) + 1, bool)
    used[suffixes] = True
    used[0] = True
    place = np.cumsum(used) - 1
    names = b"\n".join(entries[i - 1] for i in np.flatnonzero(used)[1:].tolist())
    body = b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in place[suffixes])
    body += np.ascontiguousarray(n.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(suffixes), len(n), len(names)], "<u8").tobytes() + names + body)


def unpack(payload: bytes, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    depth, size, text = np.frombuffer(raw, "<u8", 3).tolist()
    number = np.concatenate([[0], lexicon.of(raw[24:24 + text].split(b"\n"))])
    planes = np.frombuffer(raw, np.uint8, depth * size * 4, 24 + text).reshape(depth, 4, size)
    columns = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(depth, size)
    n = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * 8, 24 + text + depth * size * 4).reshape(8, size).T).view("<u8").ravel()
    return number[columns], n.astype(np.int64)


def _send(partition: Partition, often: np.ndarray, depth: int, flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, held, size = Lexicon(), [], 0

        def out() -> pa.RecordBatch:
            suffixes, n = combine(np.concatenate(held, axis=1))
            group, shared = partition.route(suffixes, lexicon.hashes())
            order = np.argsort(group, kind="stable")
            suffixes, n, group, shared = suffixes[:, order], n[order], group[order], shared[order]
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])).tolist()
            entries = list(lexicon.number)
            sent = [pack(suffixes[:, a:b], n[a:b], entries) for a, b in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(group[cuts[:-1]]), pa.array(sent, pa.binary())], names=["group", "payload"])

        for rows, data, offsets in pieces(batches, limit=4 << 20):
            suffixes = followed(*numbered(rows, data, offsets, lexicon, often), depth)
            if suffixes.shape[1]:
                held.append(suffixes.astype(np.int32))
                size += suffixes.shape[1]
            if size >= flush or len(lexicon) > 60_000:
                yield out()
                lexicon, held, size = Lexicon(), [], 0
        if held:
            yield out()
    return run


def _nodes(payloads: list[bytes], partition: Partition, least: int) -> pa.RecordBatch:
    """Nodes of two words or more of one group's part of the tree."""
    lexicon = Lexicon()
    parts = [unpack(p, lexicon) for p in payloads]
    suffixes, n = combine(np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts]))
    del parts
    _, shared = partition.route(suffixes, lexicon.hashes()) if any(map(len, partition.long)) else (None, np.zeros(len(n), np.int64))
    entries = [b"", *lexicon.number]
    found: list[tuple[str, str, int, int]] = []
    new = np.zeros(len(n), bool)
    new[:1] = True
    for d, column in enumerate(suffixes):
        new[1:] |= column[1:] != column[:-1]
        begin = np.flatnonzero(new)
        total = np.add.reduceat(n, begin)
        # A node whose leaves lie in several groups is summed up later.
        keep = (column[begin] > 0) & ((total >= least) | (shared[begin] > d))
        if d == 0:
            continue
        for at, f in zip(begin[keep].tolist(), total[keep].tolist()):
            lang, first = entries[suffixes[0, at]].rsplit(b"\t", 1)
            rest = [entries[i].rsplit(b"\t", 1)[1] for i in suffixes[1:d + 1, at].tolist()]
            found.append((lang.decode(), b" ".join([first, *rest]).decode(), d + 1, f))
    columns = list(zip(*found)) if found else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()))],
                                      names=["lang", "phrase", "m", "f"])


def _subtrees(partition: Partition, least: int):
    """One group after the other, from payloads in order of their group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            for g, payload in zip(batch.column("group").to_pylist(), batch.column("payload")):
                if g != group and held:
                    yield _nodes(held, partition, least)
                    held = []
                group = g
                held.append(payload.as_py())
        if held:
            yield _nodes(held, partition, least)
    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, least: int = LEAST,
                  budget: int = BUDGET, flush: int = FLUSH, words: DataFrame | None = None) -> DataFrame:
    """(lang, phrase, m, f): phrases of 2 to ``depth`` words that occur at least ``least`` times in a language."""
    rows = _rows(docs, text_col, lang_col)
    words = stage(word_counts(docs, text_col, lang_col), "words") if words is None else words
    often = often_table(words, least)
    partition = plan_groups(rows, words, often, depth, budget)
    sent = rows.mapInArrow(_send(partition, often, depth, flush), "group long, payload binary")
    # Groups are alike in size and dealt out by number, not by hash.
    dealt = sent.repartitionById(parts := shuffle_partitions(docs.sparkSession), F.expr(f"CAST(group % {parts} AS INT)"))
    nodes = dealt.sortWithinPartitions("group").mapInArrow(_subtrees(partition, least), NODES)
    if any(map(len, partition.long)):
        nodes = nodes.groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return nodes


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def collocations(docs: DataFrame, top: int = 2000, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, least: int = LEAST,
                 covered: int = 80, budget: int = BUDGET, flush: int = FLUSH) -> DataFrame:
    """The ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and both sides of its weakest cut, n all words of the language;
    score = floor(2000000 a / (l + r)). A phrase goes if a longer one that holds it occurs at least
    ``covered`` percent as often.
    """
    words = stage(word_counts(docs, text_col, lang_col), "words")
    phrases = stage(phrase_counts(docs, text_col, lang_col, depth, least, budget, flush, words), "phrases")
    counts = phrases.select("lang", "phrase", "f").unionByName(words.filter(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), "f"))
    split = phrases.select("lang", "phrase", "m", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    cuts = split.select("lang", "phrase", "a", "m", "w", F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.col("m")), " ").alias("rest"))
    side = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("product", F.lit(2_000_000).cast("decimal(7,0)") * _exact("a")).withColumn("both", _exact("l") + _exact("r"))
    scored = (cuts.select("lang", "phrase", "a", F.struct(F.expr("product div both").alias("score"), "k", "l", "r").alias("cut"))
              .groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")))

    inner = F.expr("flatten(transform(sequence(2, m - 1), k -> transform(sequence(1, m - k + 1), i -> array_join(slice(w, i, k), ' '))))")
    longer = split.filter("m > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("held").isNull() | (100 * _exact("held") < covered * _exact("a")))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # Each language is ranked in shares first, so that no task sees more than a bounded number of its phrases.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    shares = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    shares = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
