"""Exact removal of repeated byte strings by prefix-free parsing.

Every window of ``match`` bytes picks the k-gram of least rolling hash inside it: the trigger. The
windows of one trigger are neighbours; together they span a phrase. Trigger and phrase follow from
content alone, so equal windows always pick equal triggers, and the texts become a parse over a
dictionary of phrases.

1. Parse. Equal phrases of a chunk of texts are combined at once: all but the first are repeats.
2. Dictionary. Phrases meet by trigger. Of equal phrases the first in corpus order is the
   dictionary's; the windows of all later ones are repeats. A trigger with one phrase is done.
3. Suffix array. Where a trigger has several phrases, their bytes are fetched, the suffixes that
   start a window are sorted (cut at ``match`` bytes, all that decides), and equal neighbours put
   in corpus order: the first stays. A window's first place always lies in a dictionary phrase, so
   the dictionary's order and the parse's first places give the order of the whole corpus.
4. The covered bytes of each document are cut out.

Phrases are compared by 128 bits of independent hashes, suffixes by their bytes. All exchanges carry packed
columns. A trigger that many texts share with different surroundings (a very common line) would
fill one group: such triggers are found on a bounded sample, which decides routing only, and their
windows travel one by one, spread by their own hash. Exact for any data.

Defined cases: a null text counts as empty; texts shorter than ``match`` bytes lose nothing; a null
id sorts last; rows that share an id are ordered by a hash of their text; rows alike in id and text
stand at one place, none is earlier than the other; an empty table gives no rows. Only the id and
the text column are read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .bytehash import Rolling, U, mix, pieces, texts_of
from .common import shuffle_partitions, stage

MATCH, GRAM = 100, 32
FLUSH = 400_000
LAST = (1 << 63) - 1
SAMPLE, COMMON = 20_000, 100   # texts looked at for common triggers, and texts that make one common

PHRASE = {"trig": "<u8", "phr": "<u8", "doc": "<i8", "tie": "<i8", "a": "<u4", "n": "<u4", "off": "<u4"}
ASK = {"trig": "<u8", "doc": "<i8", "tie": "<i8", "a": "<u4", "n": "<u4"}
GONE = {"doc": "<i8", "tie": "<i8", "start": "<u4", "end": "<u4"}
PACKED = "kind int, key long, payload binary"


def pack(columns: dict[str, np.ndarray], kind: dict[str, str], extra: bytes = b"") -> bytes:
    size = len(next(iter(columns.values())))
    body = b"".join(np.ascontiguousarray(columns[c], t).tobytes() for c, t in kind.items())
    return zstandard.ZstdCompressor(level=1).compress(size.to_bytes(8, "little") + body + extra)


def unpack(payloads: list[bytes], kind: dict[str, str]) -> tuple[dict[str, np.ndarray], bytes]:
    parts: dict[str, list[np.ndarray]] = {c: [] for c in kind}
    rest = []
    for raw in payloads:
        raw = zstandard.ZstdDecompressor().decompress(raw)
        size, at = int.from_bytes(raw[:8], "little"), 8
        for c, t in kind.items():
            step = size * np.dtype(t).itemsize
            parts[c].append(np.frombuffer(raw, t, size, at))
            at += step
        rest.append(raw[at:])
    return {c: np.concatenate(v) if v else np.zeros(0, kind[c]) for c, v in parts.items()}, b"".join(rest)


def take(columns: dict[str, np.ndarray], rows) -> dict[str, np.ndarray]:
    return {c: v[rows] for c, v in columns.items()}


def spread(columns: dict[str, np.ndarray], key: np.ndarray, kind: dict[str, str], tag: int) -> Iterator[tuple[int, int, bytes]]:
    """(tag, key, payload): the rows of each key packed together."""
    order = np.argsort(key, kind="stable")
    key, columns = key[order], take(columns, order)
    cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, int)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield tag, int(key[lo]), pack(take(columns, slice(lo, hi)), kind)


def packed_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    tags, keys, payloads = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(tags, pa.int32()), pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], names=["kind", "key", "payload"])


def doc_key(columns: dict[str, np.ndarray], buckets: int) -> np.ndarray:
    return (columns["doc"] ^ columns["tie"]) % buckets


def phrases(data: np.ndarray, offsets: np.ndarray, match: int, gram: int) -> dict[str, np.ndarray]:
    """Triggers and phrases of several texts: trig, phr, text, a (start), n (windows), off (of the trigger)."""
    n, reach = len(data) - match + 1, match - gram + 1
    none = {c: np.zeros(0, np.int64) for c in ("text", "a", "n", "off")} | {c: np.zeros(0, U) for c in ("trig", "phr")}
    if n <= 0:
        return none
    grams = Rolling(data).windows(gram)
    bits = int(len(data)).bit_length()
    least = (grams & ~U((1 << bits) - 1)) | np.arange(len(grams), dtype=U)
    width = 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[:-(reach - width)], least[reach - width:])
    pick = (least[:n] & U((1 << bits) - 1)).astype(np.int64)
    inside = np.ones(n, bool)
    for cut in offsets[1:-1].tolist():  # no window crosses texts
        inside[max(0, cut - match + 1):cut] = False
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (pick[1:] != pick[:-1]) | ~inside[:-1]
    begin = np.flatnonzero(new & inside)
    if not len(begin):
        return none
    stop = np.empty(n, bool)
    stop[-1] = True
    stop[:-1] = new[1:] | ~inside[1:]
    end = np.flatnonzero(stop & inside)
    trigger = pick[begin]
    phr = mix(Rolling(data, 1).slices(begin, end + match) + (trigger - begin).astype(U))
    text = np.searchsorted(offsets, begin, "right") - 1
    return {"trig": grams[trigger], "phr": phr, "text": text, "a": begin - offsets[text], "n": end - begin + 1, "off": trigger - begin}


def _single_windows(found: dict[str, np.ndarray], rows: np.ndarray, data: np.ndarray, offsets: np.ndarray, match: int) -> dict[str, np.ndarray]:
    """The phrases ``rows`` as windows of their own, met by the window's hash."""
    part = take(found, rows)
    count = part["n"]
    each = np.repeat(np.arange(len(count)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    a = part["a"][each] + step
    at = offsets[part["text"][each]] + a
    return {"trig": Rolling(data).slices(at, at + match), "phr": Rolling(data, 1).slices(at, at + match), "text": part["text"][each], "a": a,
            "n": np.ones(len(a), np.int64), "off": np.zeros(len(a), np.int64)}


def firsts(columns: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Rows in order of (trig, phr, place), and whether each opens its (trig, phr)."""
    columns = take(columns, np.lexsort((columns["a"], columns["tie"], columns["doc"], columns["phr"], columns["trig"])))
    first = np.ones(len(columns["a"]), bool)
    first[1:] = (columns["trig"][1:] != columns["trig"][:-1]) | (columns["phr"][1:] != columns["phr"][:-1])
    # Rows alike in id and text share their places: one stands for all, none repeats the other.
    lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    other = first | (columns["doc"] != columns["doc"][lead]) | (columns["tie"] != columns["tie"][lead]) | (columns["a"] != columns["a"][lead])
    return take(columns, other), first[other]


def covered(columns: dict[str, np.ndarray], match: int) -> dict[str, np.ndarray]:
    start = columns["a"].astype(np.int64)
    return {"doc": columns["doc"], "tie": columns["tie"], "start": start, "end": start + columns["n"] + match - 1}


def _parse(match: int, gram: int, buckets: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns, first = firsts({c: np.concatenate([h[c] for h in held]) for c in PHRASE})
            rows = [*spread(kept := take(columns, first), (kept["trig"] % U(buckets)).astype(np.int64), PHRASE, 0)]
            gone = covered(take(columns, ~first), match)
            rows += spread(gone, doc_key(gone, buckets), GONE, 1)
            return packed_table(rows).combine_chunks().to_batches()[0]

        for rows, data, offsets in pieces(batches):
            doc, tie = np.asarray(rows.column("doc")), np.asarray(rows.column("tie"))
            found = phrases(data, offsets, match, gram)
            if len(common) and len(found["a"]):
                often = common[np.minimum(np.searchsorted(common, found["trig"]), len(common) - 1)] == found["trig"]
                if often.any():
                    single = _single_windows(found, np.flatnonzero(often), data, offsets, match)
                    rare = take(found, ~often)
                    found = {c: np.concatenate([rare[c], single[c]]) for c in found}
            text = found.pop("text")
            if len(text):
                held.append(found | {"doc": doc[text], "tie": tie[text]})
                size += len(text)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
    return run


def _common_triggers(docs: DataFrame, match: int, gram: int) -> np.ndarray:
    """Triggers of a bounded sample that at least ``COMMON`` texts hold in different phrases; routing only."""
    total = docs.count()
    picked = docs.filter(F.pmod(F.xxhash64("doc", "tie"), F.lit(max(1, -(-total // SAMPLE)))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in pieces(batches):
            found = phrases(data, offsets, match, gram)
            pairs = np.unique(np.stack([found["trig"], found["phr"]]), axis=1) if len(found["a"]) else np.zeros((2, 0), U)
            trig, n = np.unique(pairs[0], return_counts=True)
            often = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(trig[often].view(np.int64)), pa.array(n[often])], names=["trig", "n"])

    # Single sightings in a piece are left out: a trigger this common is seen again and again in most pieces.
    counts = picked.select("text").mapInArrow(run, "trig long, n long").groupBy("trig").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    found = counts.select("trig").toArrow()  # at most the sample's phrases / COMMON
    return np.sort(np.asarray(found.column("trig")).astype(np.int64).view(U))


def _dictionary(match: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        kinds, payloads = np.asarray(table.column("kind")), table.column("payload")
        rows = [(1, int(table.column("key")[i].as_py()), payloads[i].as_py()) for i in np.flatnonzero(kinds == 1).tolist()]
        columns, _ = unpack([payloads[i].as_py() for i in np.flatnonzero(kinds == 0).tolist()], PHRASE)
        if len(columns["a"]):
            columns, first = firsts(columns)
            gone = covered(take(columns, ~first), match)
            rows += spread(gone, doc_key(gone, buckets), GONE, 1)
            kept = take(columns, first)
            opens = np.ones(len(kept["a"]), bool)
            opens[1:] = kept["trig"][1:] != kept["trig"][:-1]
            group = np.cumsum(opens) - 1
            low, high = np.minimum.reduceat(kept["phr"], np.flatnonzero(opens)), np.maximum.reduceat(kept["phr"], np.flatnonzero(opens))
            open_rows = take(kept, (low != high)[group])
            rows += spread(open_rows, doc_key(open_rows, buckets), ASK, 2)
        return packed_table(rows)
    return run


class Texts:
    """The documents of one group by (doc, tie); rows alike share one text."""

    def __init__(self, table: pa.Table):
        self.doc, self.tie = np.asarray(table.column("doc")), np.asarray(table.column("tie"))
        self.data, self.offsets = texts_of(table.column("text"))
        self.order = np.lexsort((self.tie, self.doc))
        self.keys = np.stack([self.doc[self.order], self.tie[self.order]]).T.copy().view([("d", "<i8"), ("t", "<i8")]).ravel()

    def rows(self, columns: dict[str, np.ndarray], side: str = "left") -> np.ndarray:
        wanted = np.stack([columns["doc"], columns["tie"]]).T.astype("<i8").copy().view(self.keys.dtype).ravel()
        return np.searchsorted(self.keys, wanted, side)


def _fetch(match: int, buckets: int):
    def run(texts: pa.Table, asks: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return packed_table([])
        columns, _ = unpack(asks.column("payload").to_pylist(), ASK)
        held = Texts(texts)
        begin = held.offsets[held.order[held.rows(columns)]] + columns["a"]
        key = (columns["trig"] % U(buckets)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        rows = []
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(key)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = order[lo:hi]
            text = b"".join(held.data[b:b + n + match - 1].tobytes() for b, n in zip(begin[own].tolist(), columns["n"][own].tolist()))
            rows.append((0, int(key[own[0]]), pack(take(columns, own), ASK, text)))
        return packed_table(rows)
    return run


def _suffixes(match: int, buckets: int, step: int = 200_000):
    def run(table: pa.Table) -> pa.Table:
        columns, text = unpack(table.column("payload").to_pylist(), ASK)
        sizes = columns["n"].astype(np.int64) + match - 1
        # Bytes lie in the order of the rows: all bytes of a payload after its columns.
        begin = np.cumsum(sizes) - sizes
        order = np.lexsort((columns["a"], columns["tie"], columns["doc"], columns["trig"]))
        columns, begin = take(columns, order), begin[order]
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), match)
        rows = []
        opens = np.flatnonzero(np.concatenate([[True], columns["trig"][1:] != columns["trig"][:-1]]))
        ends = np.append(opens[1:], len(begin))
        done = np.cumsum(columns["n"].astype(np.int64))
        lo = 0
        while lo < len(opens):
            hi = lo + 1  # whole triggers, about `step` windows at a time
            while hi < len(opens) and done[ends[hi] - 1] - done[opens[lo]] < step:
                hi += 1
            part = take(columns, slice(opens[lo], ends[hi - 1]))
            count = part["n"].astype(np.int64)
            each = np.repeat(np.arange(len(count)), count)
            shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place = {"doc": part["doc"][each], "tie": part["tie"][each], "a": part["a"][each].astype(np.int64) + shift}
            at = begin[opens[lo]:ends[hi - 1]][each] + shift
            early = np.lexsort((place["a"], place["tie"], place["doc"]))
            place, at = take(place, early), at[early]
            suffix = np.ascontiguousarray(windows[at]).view(f"S{match}").ravel()
            array = np.argsort(suffix, kind="stable")
            same = np.zeros(len(array), bool)
            same[1:] = suffix[array[1:]] == suffix[array[:-1]]
            # Rows alike in id and text have equal places: the repeat starts after them.
            lead = np.maximum.accumulate(np.where(~same, np.arange(len(same)), 0))
            head, own = take(place, array[lead]), take(place, array)
            same &= (head["doc"] != own["doc"]) | (head["tie"] != own["tie"]) | (head["a"] != own["a"])
            hit = take(own, same)
            gone = {"doc": hit["doc"], "tie": hit["tie"], "start": hit["a"], "end": hit["a"] + match}
            rows += spread(gone, doc_key(gone, buckets), GONE, 1)
            lo = hi
        return packed_table(rows)
    return run


def _cut(keep_bytes: bool, step: int = 8 << 20):
    def run(texts: pa.Table, gone: pa.Table) -> pa.Table:
        held = Texts(texts)
        row, start, end = (np.zeros(0, np.int64),) * 3
        if gone.num_rows:
            columns, _ = unpack(gone.column("payload").to_pylist(), GONE)
            left, right = held.rows(columns), held.rows(columns, "right")
            each = np.repeat(np.arange(len(left)), right - left)  # rows alike in id and text are cut alike
            place = left[each] + np.arange(len(each)) - np.repeat(np.cumsum(right - left) - (right - left), right - left)
            row, start, end = held.order[place], columns["start"][each].astype(np.int64), columns["end"][each].astype(np.int64)
            order = np.argsort(row, kind="stable")
            row, start, end = row[order], start[order], end[order]
        removed, spans, digests, kept = [], [], [], []
        lo = 0
        while lo < texts.num_rows:  # some texts at a time, or one long text
            hi = max(lo + 1, int(np.searchsorted(held.offsets, held.offsets[lo] + step, "right")) - 1)
            own, data = held.offsets[lo:hi + 1] - held.offsets[lo], held.data[held.offsets[lo]:held.offsets[hi]]
            first, last = np.searchsorted(row, [lo, hi])
            base = own[row[first:last] - lo]
            change = np.bincount(base + start[first:last], minlength=len(data) + 1).astype(np.int32)
            change -= np.bincount(base + end[first:last], minlength=len(data) + 1).astype(np.int32)
            out = np.cumsum(change[:-1], out=change[:-1]) > 0
            opens = out.copy()
            opens[1:] &= ~out[:-1]
            heads = own[:-1][own[:-1] < own[1:]]
            opens[heads] = out[heads]
            for x, y in zip(own[:-1].tolist(), own[1:].tolist()):
                rest = data[x:y][~out[x:y]].tobytes()
                removed.append(y - x - len(rest))
                spans.append(int(np.count_nonzero(opens[x:y])))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if keep_bytes else b"")
            lo = hi
        return pa.table({"doc": held.doc, "n_bytes": np.diff(held.offsets), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                         "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept, pa.binary())})
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH, gram: int = GRAM, keep_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one row per row of ``docs``."""
    buckets = shuffle_partitions(docs.sparkSession)  # a bucket sends at most one row to each other bucket
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # `tie` orders rows that share an id: 31 bits of a hash of the text.
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), text.alias("text"))
    rows = rows.select("doc", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).alias("tie"), "text")
    keyed = rows.withColumn("key", F.pmod(F.col("doc").bitwiseXOR(F.col("tie")), F.lit(buckets)))

    common = _common_triggers(rows, match, gram)
    parsed = rows.mapInArrow(_parse(match, gram, buckets, common), PACKED)
    judged = stage(parsed.groupBy("key").applyInArrow(_dictionary(match, buckets), PACKED), "phrases")
    fetched = keyed.groupBy("key").cogroup(judged.filter("kind = 2").groupBy("key")).applyInArrow(_fetch(match, buckets), PACKED)
    sorted_out = stage(fetched.groupBy("key").applyInArrow(_suffixes(match, buckets), PACKED), "suffixes")
    gone = judged.filter("kind = 1").unionByName(sorted_out)
    done = keyed.groupBy("key").cogroup(gone.groupBy("key")).applyInArrow(_cut(keep_bytes), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = done.select(F.when(F.col("doc") != LAST, F.col("doc")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return out if keep_bytes else out.drop("kept")
