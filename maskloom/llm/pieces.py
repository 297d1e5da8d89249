"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that are new to the process are concatenated (white space marks open a word,
and no piece of the model crosses one) and indexed by a suffix array cut at the longest piece.
Every piece is found by binary search as a range of suffixes. The ranges become edges (end, start,
piece), sorted by position, and one pass over the positions relaxes them: the piece that ends the
encoding of a prefix is the one edge whose pair with the encoding of the prefix before it is
stable, that is, which merging by score would leave as it stands. That reproduces byte-pair merging
exactly, without merging. All words advance together, one position at a time; only very long
words are walked alone. Characters without a piece fall back to byte pieces.

Defined cases: a null or empty text has no ids; the characters U+2581 and space share a mark, as in
the public library; ids that are not in the model decode to U+FFFD; repeated rows are encoded alike;
an empty table gives no rows. A model whose normaliser changes characters is refused.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
NEVER = 1 << 40
SLICE = 300_000   # characters indexed at once
ALONE = 512       # words beyond this length are relaxed one by one
KEEP = 300_000    # words remembered by a process


@dataclass
class PieceModel:
    """Tables of a byte-pair model with byte fallback; their size follows the vocabulary."""
    texts: list[str]            # "" for control and byte pieces
    rank: np.ndarray            # merge order, -1 for single characters
    left: np.ndarray            # parts of the last merge
    right: np.ndarray
    stable: np.ndarray          # pieces that their own text encodes to
    pair_keys: np.ndarray       # sorted left << 32 | right
    pair_rank: np.ndarray       # rank of the piece both form
    byte_ids: list[int]
    raw: list[bytes]            # decoded bytes of every piece
    prefix: bool

    @property
    def longest(self) -> int:
        return max(map(len, self.texts))


def load_model(path: str) -> PieceModel:
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "Aä  ﬁ\t é  b\n"
    if sp.decode(sp.encode(probe)) != probe:
        raise ValueError("the model's normaliser changes characters")
    n = sp.vocab_size()
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
    texts = ["" if special[i] else sp.id_to_piece(i) for i in range(n)]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    raw = [b"" if special[i] else texts[i].replace(MARK, " ").encode() for i in range(n)]
    for b, i in enumerate(byte_ids):
        raw[i] = bytes([b])
    score = np.array([sp.get_score(i) for i in range(n)])
    ids = {t: i for i, t in enumerate(texts) if t}
    rank = np.full(n, -1, np.int64)
    merged = sorted((i for i in ids.values() if len(texts[i]) > 1), key=lambda i: (-score[i], i))
    rank[merged] = np.arange(len(merged))
    left, right = np.arange(n), np.arange(n)
    stable = np.array([bool(t) for t in texts])
    pairs = {}
    for t, i in ids.items():
        for cut in range(1, len(t)):
            a, b = ids.get(t[:cut]), ids.get(t[cut:])
            if a is not None and b is not None:
                pairs[a << 32 | b] = int(rank[i])
    by_rank = {int(rank[i]): i for i in merged}
    for i in merged:
        parts = [ids.get(c, -1) for c in texts[i]]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda j: (pairs.get(parts[j] << 32 | parts[j + 1], NEVER) if parts[j] >= 0 <= parts[j + 1] else NEVER, j))
            formed = pairs.get(parts[at] << 32 | parts[at + 1], NEVER) if parts[at] >= 0 <= parts[at + 1] else NEVER
            if formed == NEVER:
                break
            parts[at:at + 2] = [by_rank[formed]]
        stable[i] = len(parts) == 2 and min(parts) >= 0 and pairs.get(parts[0] << 32 | parts[1], NEVER) == rank[i]
        if stable[i]:
            left[i], right[i] = parts
    keys = np.array(sorted(pairs), np.int64)
    return PieceModel(texts, rank, left, right, stable, keys, np.array([pairs[k] for k in keys.tolist()], np.int64), byte_ids, raw,
                      sp.encode("x", out_type=str)[0].startswith(MARK))


class Encoder:
    def __init__(self, model: PieceModel):
        self.m = model
        inner = any(MARK in t.lstrip(MARK) for t in model.texts)
        self.cut = re.compile("(?s).+") if inner else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.known: dict[str, bytes] = {}
        self.at = {t: i for i, t in enumerate(model.texts) if t}
        self.order = [i for i in self.at.values() if model.stable[i]]

    def stable_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves a | b as they are: undo the later merge on either side of the seam, again
        and again; a merge across the seam that would have come earlier breaks the pair."""
        m = self.m
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[live].copy(), b[live].copy()
        limit = np.full(len(live), NEVER)
        while len(live):
            key = a << 32 | b
            place = np.minimum(np.searchsorted(m.pair_keys, key), len(m.pair_keys) - 1)
            across = (m.pair_keys[place] == key) & (m.pair_rank[place] < limit)
            ok[live[across]] = False
            go = ~across & ((m.rank[a] >= 0) | (m.rank[b] >= 0))
            live, a, b, limit = live[go], a[go], b[go], limit[go]
            of_a = m.rank[a] > m.rank[b]
            limit = np.where(of_a, m.rank[a], m.rank[b] + 1)
            a, b = np.where(of_a, m.right[a], a), np.where(of_a, b, m.left[b])
        return ok

    def edges(self, codes: np.ndarray, alphabet: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence of every piece, from the suffix array of ``codes`` (0 parts words)."""
        width = self.m.longest
        kind = np.dtype(np.uint8) if len(alphabet) < 255 else np.dtype(">u2") if len(alphabet) < 65_535 else np.dtype(">u4")
        size = width * kind.itemsize
        step = -size % 8 // kind.itemsize
        padded = np.concatenate([codes, np.zeros(width + step, codes.dtype)]).astype(kind)
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width + step)[:len(codes)])
        suffixes[:, width:] = 0
        words = suffixes.view(">u8").astype(np.uint64)
        array = np.lexsort(words.T[::-1])
        text = np.ascontiguousarray(suffixes[array]).view(f"S{(width + step) * kind.itemsize}").ravel()
        keyed = [(i, [alphabet.get(c, 0) for c in self.m.texts[i]]) for i in self.order if all(c in alphabet for c in self.m.texts[i])]
        if not keyed:
            return (np.zeros(0, np.int64),) * 3
        low = np.zeros((len(keyed), width + step), kind)
        high = np.full((len(keyed), width + step), np.iinfo(kind).max, kind)
        for row, (_, code) in enumerate(keyed):
            low[row, :len(code)] = code
            high[row, :len(code)] = code
        begin = np.searchsorted(text, low.view(text.dtype).ravel(), "left")
        end = np.searchsorted(text, high.view(text.dtype).ravel(), "right")
        count = np.maximum(end - begin, 0)
        which = np.repeat(np.arange(len(keyed)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = array[begin[which] + inside]
        length = np.array([len(code) for _, code in keyed])
        return start, start + length[which], np.array([i for i, _ in keyed])[which]

    def index(self, words: list[str]) -> None:
        """Encode ``words`` together and remember them."""
        joined = "\0".join(words).encode("utf-32-le")
        points = np.frombuffer(joined, np.uint32).astype(np.int64)
        sizes = np.array([len(w) for w in words])
        starts = np.cumsum(sizes + 1) - sizes - 1
        inside = np.ones(len(points), bool)
        inside[starts[1:] - 1] = False
        chars, codes = np.unique(points, return_inverse=True)
        codes = np.where(inside, codes + 1, 0)
        alphabet = {chr(c): i + 1 for i, c in enumerate(chars.tolist())}
        start, end, piece = self.edges(codes, alphabet)
        # A character without a piece is an edge of its own.
        plain = np.array([self.at.get(chr(c), -1) for c in chars.tolist()])
        lone = np.flatnonzero(inside & (plain[np.maximum(codes - 1, 0)] < 0))
        start, end, piece = (np.concatenate([x, y]) for x, y in ((start, lone), (end, lone + 1), (piece, np.full(len(lone), -1))))
        owner = np.searchsorted(starts, start, "right") - 1
        far = sizes[owner] > ALONE
        depth = end - starts[owner]
        order = np.lexsort((start, np.where(far, owner + ALONE + 1, depth)))
        start, end, piece, far, depth, owner = (x[order] for x in (start, end, piece, far, depth, owner))
        last = np.full(len(points) + 1, -2, np.int64)   # the piece that ends at a position
        back = np.zeros(len(points) + 1, np.int64)      # where it starts
        shallow = np.count_nonzero(~far)
        cuts = np.searchsorted(depth[:shallow], np.arange(1, ALONE + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            s, e, p = start[lo:hi], end[lo:hi], piece[lo:hi]
            before = last[s]
            ok = e - s == depth[lo:hi]
            seam = np.flatnonzero(~ok & (before > -2))
            ok[seam] = self.stable_pairs(before[seam], p[seam])
            last[e[ok]], back[e[ok]] = p[ok], s[ok]
        if shallow < len(start):
            self._walk(start[shallow:], end[shallow:], piece[shallow:], starts[owner[shallow:]], last, back)
        ends = starts + sizes
        self._trace(words, starts, ends, last, back)

    def _walk(self, start, end, piece, first, last, back) -> None:
        """Long words: the same relaxation, edge by edge in order of their ends."""
        order = np.lexsort((start, end))
        known: dict[tuple[int, int], bool] = {}
        for s, e, p, f in zip(start[order].tolist(), end[order].tolist(), piece[order].tolist(), first[order].tolist()):
            before = int(last[s]) if s != f else -1
            if before == -2:
                continue
            if before >= 0 and p >= 0:
                if (before, p) not in known:
                    if len(known) > KEEP:
                        known.clear()
                    known[before, p] = bool(self.stable_pairs(np.array([before]), np.array([p]))[0])
                if not known[before, p]:
                    continue
            last[e], back[e] = p, s

    def _trace(self, words, starts, ends, last, back) -> None:
        """Follow the pieces back from the end of every word."""
        at, live, steps = ends.copy(), np.arange(len(words)), []
        while len(live):
            here = at[live]
            steps.append((live, last[here], back[here]))
            at[live] = back[here]
            live = live[at[live] > starts[live]]
        owner = np.concatenate([s[0] for s in steps])
        turn = np.repeat(np.arange(len(steps)), [len(s[0]) for s in steps])
        ids, begin = np.concatenate([s[1] for s in steps]), np.concatenate([s[2] for s in steps])
        order = np.lexsort((-turn, owner))
        ids, begin, owner = ids[order], begin[order], owner[order]
        bounds = np.searchsorted(owner, np.arange(len(words) + 1))
        lone = ids < 0
        flat = ids.astype("<i4").tobytes()
        strange = np.add.reduceat(lone, bounds[:-1]) if len(ids) else np.zeros(0)
        for w, word in enumerate(words):
            lo, hi = int(bounds[w]), int(bounds[w + 1])
            if not strange[w]:
                self.known[word] = flat[4 * lo:4 * hi]
                continue
            out: list[int] = []
            for j in range(lo, hi):
                out += [int(ids[j])] if ids[j] >= 0 else [self.m.byte_ids[b] for b in word[begin[j] - starts[w]].encode()]
            self.known[word] = np.array(out, "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > KEEP:
            self.known.clear()
        split = []
        for text in texts:
            text = text.replace(" ", MARK)
            split.append(self.cut.findall(MARK + text if self.m.prefix and text else text))
        fresh = list({w for words in split for w in words if w not in self.known})
        room, group = SLICE, []
        for word in fresh:
            group.append(word)
            room -= len(word) + 1
            if room <= 0:
                self.index(group)
                room, group = SLICE, []
        if group:
            self.index(group)
        return [np.frombuffer(b"".join([self.known[w] for w in words]), "<i4") for words in split]


class Decoder:
    """Bytes of all pieces in one table; texts are gathered from it."""

    def __init__(self, model: PieceModel):
        raw = [*model.raw, b"\xef\xbf\xbd"]  # the last entry stands for ids that are not in the model
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.length = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.part = np.array([r.decode("utf-8", "ignore").encode() != r for r in raw])  # no text of its own
        self.prefix = model.prefix

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Text of each list of ids."""
        known = np.where((ids >= 0) & (ids < len(self.length) - 1), ids, len(self.length) - 1)
        length = self.length[known]
        ends = np.concatenate([[0], np.cumsum(length)])
        data = self.blob[np.repeat(self.start[known] - ends[:-1], length) + np.arange(ends[-1])]
        cut = ends[offsets]
        if self.part[known].any():
            whole = data.tobytes()
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            return pa.array([t[1:] if self.prefix and t.startswith(" ") else t for t in texts], pa.string())
        if self.prefix and len(data):
            opened = np.flatnonzero((cut[:-1] < cut[1:]) & (data[np.minimum(cut[:-1], len(data) - 1)] == 0x20))
            data = np.delete(data, cut[opened])
            gone = np.zeros(len(cut), np.int64)
            gone[opened + 1] = 1
            cut = cut - np.cumsum(gone)
        return pa.Array.from_buffers(pa.string(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _groups(texts: list[str | None], limit: int = 4 << 20) -> Iterator[slice]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _mapped(rows: DataFrame, work, more: dict[str, str]) -> DataFrame:
    """All columns of ``rows`` and the columns ``more`` (name, type) that ``work`` adds. Columns travel by number; their names may be any."""
    cols = rows.columns
    named = {f"m{i}": kind for i, kind in enumerate(more.values())}
    schema = ", ".join([*(f"c{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(cols)), *(f"{m} {kind}" for m, kind in named.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, arrays in work(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *named])

    done = rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], *[F.col(m).alias(c) for m, c in zip(named, more)])


def _encoded(batches: Iterator[pa.RecordBatch], model: PieceModel, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, offsets) of slices of bounded size."""
    encoder = Encoder(model)
    for batch in batches:
        texts = batch.column(column).to_pylist()
        for part in _groups(texts):
            ids = encoder.encode([t or "" for t in texts[part]])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            yield batch.slice(part.start, part.stop - part.start), np.concatenate(ids) if ids else np.zeros(0, np.int32), offsets


def _id_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "piece_ids") -> DataFrame:
    """All columns of ``docs`` and ``out``, an array of ids."""
    model, column = load_model(model_path), docs.columns.index(text_col)

    def work(batches):
        for rows, ids, offsets in _encoded(batches, model, column):
            yield rows, [_id_lists(ids, offsets)]

    return _mapped(docs, work, {out: "array<int>"})


def decode(rows: DataFrame, model_path: str, ids_col: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and ``out``, the text of the ids."""
    model, place = load_model(model_path), rows.columns.index(ids_col)

    def work(batches):
        decoder = Decoder(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, min(500, batch.num_rows - lo))
                column = part.column(place)
                sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
                yield part, [decoder.texts(np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(sizes)]))]

    return _mapped(rows, work, {out: "string"})


def encode_and_decode(docs: DataFrame, model_path: str, text_col: str = "text", ids_out: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass: one Python worker holds both tables, and texts travel once."""
    model, column = load_model(model_path), docs.columns.index(text_col)

    def work(batches):
        decoder = Decoder(model)
        for rows, ids, offsets in _encoded(batches, model, column):
            for lo in range(0, rows.num_rows, 500):
                hi = min(lo + 500, rows.num_rows)
                own, cut = ids[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                yield rows.slice(lo, hi - lo), [_id_lists(own, cut), decoder.texts(own, cut)]

    return _mapped(docs, work, {ids_out: "array<int>", out: "string"})
