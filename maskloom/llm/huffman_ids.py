"""Token ids in files of canonical length-limited Huffman blocks.

Texts are encoded with the ``tokenizers`` library (each distinct word of the public pre-tokeniser's
pattern goes through it once per process), each document ends with an end id. Global counts of ids,
summed in Spark, give code lengths by the package-merge rule; only the lengths are stored, codes are
canonical. Documents are range-sorted by id and packed into independent blocks of whole documents;
a block stores the bit length of every run of 128 ids, so its decoder starts at all these points
at once and looks each code up in one table.

A file set is two Parquet folders under one path: ``codebook`` (id, length) and ``blocks`` (part,
seq, doc_ids, counts, runs, payload); part and seq give the order of the stream.

Defined cases: a null or empty text is its end id alone; a null doc_id sorts last; rows that share a
doc_id follow each other, ordered by their ids; an empty table gives empty folders and no rows. Only
the id and the text column are read. A document is never split, so a block is as large as its target
or one document.
"""
from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import scratch, shuffle_partitions, text_or_empty

RUN = 128
BLOCK = 1 << 18
KEEP = 900_000
SCHEMA_BLOCKS = "part int, seq int, doc_ids array<bigint>, counts array<bigint>, total bigint, runs binary, payload binary"


class WordTokenizer:
    """The library's ids of whole texts, one encoding for each distinct word; kept by the process over its tasks."""

    _kept: dict[tuple[str, str], WordTokenizer] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> WordTokenizer:
        if (path, pattern) not in cls._kept:
            cls._kept[path, pattern] = cls(path, pattern)
        return cls._kept[path, pattern]

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # words hold no added token, so the search for them is left out
        self.path, self.library = path, None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.words = regex.compile(pattern)
        self.kind = id_type(self.tokenizer.get_vocab_size())
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that begin with a space
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str], ids: list[list[int]]) -> None:
        for w, own in zip(words, ids):
            self.known[w] = np.array(own, self.kind).tobytes()

    def _together(self, words: list[str]) -> bool:
        """A space and letters stay a word of their own in a row of such words: one call encodes them all."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, self.kind)
        cuts = np.flatnonzero(self.opens[ids])
        if len(cuts) != len(words) or (len(cuts) and cuts[0]):
            return False
        raw, ends = ids.tobytes(), [*(cuts[1:] * ids.itemsize).tolist(), ids.nbytes]
        at = 0
        for w, end in zip(words, ends):
            self.known[w] = raw[at:end]
            at = end
        return True

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Texts that hold an added token: the library cuts at such tokens before it splits words."""
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_file(self.path)
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KEEP:
            self.known.clear()
        known = self.known
        marked = sorted({i for a in self.added for i, t in enumerate(texts) if a in t})
        apart = dict(zip(marked, self._whole([texts[i] for i in marked]))) if marked else {}
        split = [[] if i in apart else self.words.findall(t) for i, t in enumerate(texts)]
        fresh = list({w for words in split for w in words if w not in known})
        plain = [w for w in fresh if w[0] == " " and w[1:].isalpha()]
        other = [w for w in fresh if not (w[0] == " " and w[1:].isalpha())]
        for at in range(0, len(plain), 2000):
            if not self._together(plain[at:at + 2000]):
                other += plain[at:at + 2000]
        self._learn(other, [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)])
        return [apart[i] if i in apart else b"".join([known[w] for w in words]) for i, words in enumerate(split)]


def id_type(size: int) -> str:
    """The narrowest little-endian type for ids below ``size``."""
    return "<u2" if size <= 1 << 16 else "<u4"


def token_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """(kind, doc_id, ids). Kind 0: ids of every text as little-endian integers of ``id_type``, the end id last.
    Kind 1: one row per task, the number of its ids by id, as 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(path, pattern)
        end = np.array([end_id], tokenizer.kind).tobytes()
        total = np.zeros(max(len(tokenizer.opens), end_id + 1), np.int64)
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and (size == 0 or size + len(texts[to]) < 4 << 20):
                    size += len(texts[to]) + 1
                    to += 1
                ids = [x + end for x in tokenizer.encode(texts[at:to])]
                total += np.bincount(np.frombuffer(b"".join(ids), tokenizer.kind), minlength=len(total))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(to - at, np.int32)), batch.column("doc_id").slice(at, to - at), pa.array(ids, pa.binary())],
                                                 names=["kind", "doc_id", "ids"])
                at = to
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())],
                                         names=["kind", "doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "kind int, doc_id long, ids binary")


def _summed(totals: DataFrame) -> DataFrame:
    """(id, n) from the rows of kind 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                n = np.frombuffer(row.as_py(), "<i8")
                met = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met])], names=["id", "n"])

    return totals.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def id_counts(ids: DataFrame, kind: str = "<u4") -> DataFrame:
    """(id, n) over all documents; each task sends one row per id it met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.column(0):
                n = np.bincount(np.frombuffer(row.as_py(), kind), minlength=len(total))
                n[:len(total)] += total
                total = n
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["id", "n"])

    return ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge).

    Each level pairs the cheapest entries of the level below and merges the pairs with the symbols;
    what the last 2n - 2 choices contain, counted back level by level, are the lengths.
    """
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    levels, costs = [], leaf
    for _ in range(limit - 1):
        even = len(costs) // 2 * 2
        both = np.concatenate([leaf, costs[:even:2] + costs[1:even:2]])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)  # True: a symbol, False: a pair
        costs = both[rank]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for symbols in reversed(levels):
        own = int(symbols[:take].sum())
        lengths[:own] += 1  # symbols enter in order of their counts
        take = 2 * (take - own)
    lengths[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes of (id, length), ordered by length, then id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.width = int(self.lengths.max(initial=1))
        steps = np.left_shift(1, self.width - self.lengths)
        self.codes = (np.cumsum(steps) - steps) >> (self.width - self.lengths)

    def by_id(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.ids.max(initial=0)) + 1
        code, length = np.zeros(size, np.int64), np.zeros(size, np.int64)
        code[self.ids], length[self.ids] = self.codes, self.lengths
        return code, length

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length for every possible next ``width`` bits."""
        fill = np.left_shift(1, self.width - self.lengths)
        table = np.zeros((2, 1 << self.width), np.int32)
        table[0, :fill.sum()], table[1, :fill.sum()] = np.repeat(self.ids, fill), np.repeat(self.lengths, fill)
        return table[0], table[1]


def pack(ids: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[bytes, bytes]:
    """(payload, bit length of each run) of one block."""
    bits = length[ids]
    ends = np.cumsum(bits)
    begin = ends - bits
    word = np.left_shift(code[ids], 40 - bits - (begin & 7))
    size, at = int(ends[-1] + 7) // 8 if len(ids) else 0, begin >> 3
    out = np.zeros(size + 5)
    for k in range(5):
        out += np.bincount(at + k, weights=(word >> (32 - 8 * k)) & 255, minlength=size + 5)  # codes share no bit
    runs = np.add.reduceat(bits, np.arange(0, len(ids), RUN)) if len(ids) else np.zeros(0, np.int64)
    return out[:size].astype(np.uint8).tobytes(), runs.astype("<u2").tobytes()


def unpack(payload: bytes, runs: bytes, total: int, ids: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Ids of one block: all runs step together, one table look-up a step."""
    bits = np.frombuffer(runs, "<u2").astype(np.int64)
    data = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(8, np.uint8)]).astype(np.int64)
    word = data[:-4] << 32 | data[1:-3] << 24 | data[2:-2] << 16 | data[3:-1] << 8 | data[4:]
    at = np.cumsum(bits) - bits
    out = np.zeros((RUN, len(bits)), np.int32)
    for k in range(min(RUN, total)):
        if k and k == total - (len(bits) - 1) * RUN:
            at = at[:-1]  # the last run is shorter
        next_bits = (word[at >> 3] >> (40 - width - (at & 7))) & ((1 << width) - 1)
        out[k, :len(at)] = ids[next_bits]
        at = at + lengths[next_bits]
    return out.T.ravel()[:total]


def write_ids(ids: DataFrame, path: str, limit: int = 16, kind: str = "<u4", counted: DataFrame | None = None) -> None:
    """Write (doc_id, ids) as a file set in ascending doc_id order; ``kind`` is the type of the ids, ``counted`` (id, n) their counts."""
    spark = ids.sparkSession
    counts = (id_counts(ids, kind) if counted is None else counted).toArrow()  # one row per id of the vocabulary
    symbols, n = np.asarray(counts.column("id")), np.asarray(counts.column("n"))
    limit = max(limit, int(np.ceil(np.log2(max(2, len(symbols))))) + 1)
    if limit > 25:
        raise ValueError("a vocabulary this large needs codes beyond the decoder's table")
    order = np.argsort(symbols)
    symbols, lengths = symbols[order], code_lengths(n[order], limit) if len(symbols) else np.zeros(0, np.int64)
    spark.createDataFrame(list(zip(symbols.tolist(), lengths.tolist())), "id long, length long").coalesce(1).write.parquet(f"{path}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, length = Codebook(symbols, lengths).by_id() if len(symbols) else (None, None)
        part, seq, held, names, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block() -> pa.RecordBatch:
            stream = np.concatenate(held)
            payload, runs = pack(stream, code, length)
            arrays = [[part], [seq], [names], [[len(h) for h in held]], [len(stream)], [runs], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds)], names=["part", "seq", "doc_ids", "counts", "total", "runs", "payload"])

        for batch in batches:
            for name, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                own = np.frombuffer(raw.as_py(), kind).astype(np.int64)
                if size and size + len(own) > BLOCK:
                    yield block()
                    seq, held, names, size = seq + 1, [], [], 0
                held.append(own)
                names.append(name)
                size += len(own)
        if held:
            yield block()

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("ids")]
    sorted_ids = ids.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "ids")
    sorted_ids.select("doc_id", "ids").mapInArrow(run, SCHEMA_BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of a file set; start counts the ids of all documents before."""
    book = spark.read.parquet(f"{path}/codebook").toArrow()  # one row per id of the vocabulary
    symbols, lengths = np.asarray(book.column("id")), np.asarray(book.column("length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codebook(symbols, lengths)
        table = codes.table()
        for batch in batches:
            for row in batch.to_pylist():
                stream = unpack(row["payload"], row["runs"], row["total"], *table, codes.width).astype("<u4")
                ends = np.cumsum(row["counts"])
                raw = [stream[e - n:e].tobytes() for e, n in zip(ends.tolist(), row["counts"])]
                many = len(raw)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * many, pa.int32()), pa.array([row["seq"]] * many, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(ends - row["counts"]), pa.array(row["counts"], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                     pa.array([b"" if digest_only else r for r in raw], pa.binary())],
                    names=["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32", "ids"])

    blocks = spark.read.schema(SCHEMA_BLOCKS).parquet(f"{path}/blocks")
    decoded = blocks.repartition(shuffle_partitions(spark), "part", "seq").mapInArrow(run, "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long, ids binary")
    parts = blocks.groupBy("part").agg(F.sum("total").alias("n"))  # one row per file
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.orderBy("part")).alias("from_part"))
    starts = (blocks.select("part", "seq", F.col("total").alias("n")).withColumn("from_block", before(Window.partitionBy("part").orderBy("seq")))
              .join(parts, "part").select("part", "seq", (F.col("from_part") + F.col("from_block")).alias("first")))
    out = decoded.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out.drop("ids") if digest_only else out


def encode_and_write(docs: DataFrame, path: str, tokenizer: str, pattern: str, **columns) -> None:
    """Ids are made and counted in one pass, kept in the shared folder, then written with the code of their counts."""
    made = scratch(docs.sparkSession, "token-ids")
    token_ids(docs, tokenizer, pattern, **columns).write.partitionBy("kind").option("compression", "zstd").parquet(made)
    read = docs.sparkSession.read.schema("doc_id long, ids binary, kind int").parquet(made)
    write_ids(read.filter("kind = 0").select("doc_id", "ids"), path, kind=WordTokenizer.of(tokenizer, pattern).kind, counted=_summed(read.filter("kind = 1")))
