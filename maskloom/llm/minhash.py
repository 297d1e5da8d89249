"""Near-duplicate documents by circulant MinHash, with every link confirmed on full shingle sets.

Two permutations make all signature coordinates: the first scatters a document's shingles over a
universe of 2^22 places, the second is read at place + k (shifted circularly) for coordinate k.
Groups of four coordinates are the bands. Documents with the same set are one class from the start;
classes that share a band are candidates; a link needs an exact Jaccard of at least ``percent``.

No bucket lists its pairs. Each document is compared with one leader of its buckets, the most central
one, which joins most copies of a group. Only documents left outside the largest component of
their cluster (documents connected through bands) are compared with the cluster, block by block
inside tasks of bounded size; a task returns at most one link of a document with a component. Documents
whose own unique shingles rule out every link take no part. Components, links and candidates stay
distributed. The work left is outsiders times cluster, which an exact answer needs.

Defined cases: a null or empty text has no shingles and is linked with nothing; a text of fewer
words is one shingle; the work is done by text, so rows that share an id, or have none, are linked
each by its own text; a null id sorts last, and texts of one id stand in the order of a hash; an empty table gives
no rows. Only the id and the text column are read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .bytehash import Rolling, U, mix, pieces
from .common import broadcast_if_small, stage

UNIVERSE_BITS = 22
BANDS, ROWS = 24, 4
BLOCK_WEIGHT, DOC_WEIGHT = 500_000, 250  # shingles of a block; what a document counts beside its own
LAST = (1 << 63) - 1
_second: dict[tuple[int, int], np.ndarray] = {}


def _white() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


WHITE = _white()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the offsets of each text in them."""
    n = len(offsets) - 1
    data = LOWER[data]
    solid = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    left = np.empty(len(data), bool)
    left[:1] = True
    left[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (left | edge[:-1]))
    right = np.empty(len(data), bool)
    right[-1:] = True
    right[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (right | edge[1:])) + 1
    words = Rolling(data).slices(starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    take = np.maximum(len(words) - width + 1, 0)
    grams = np.full(take, U(width))
    for k in range(width):
        grams = mix(grams * U(0x2545F4914F6CDD1D) + words[k:take + k])
    whole = np.arange(take) + width <= first[doc[:take] + 1] if take else np.zeros(0, bool)
    keys, owner = [grams[whole]], [doc[:take][whole]]
    for size in range(1, width):
        at = first[:-1][count == size]
        short = np.full(len(at), U(size))
        for k in range(size):
            short = mix(short * U(0x2545F4914F6CDD1D) + words[at + k])
        keys.append(short)
        owner.append(np.flatnonzero(count == size))
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[fresh], owner[fresh]
    return keys, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)


def _permutation(seed: int, width: int) -> np.ndarray:
    """The second permutation, its head repeated behind its end so that a shift is one slice."""
    if (seed, width) not in _second:
        order = np.random.default_rng(seed).permutation(1 << UNIVERSE_BITS).astype(np.int32)
        _second[seed, width] = np.concatenate([order, order[:width]])
    return _second[seed, width]


def signatures(keys: np.ndarray, offsets: np.ndarray, width: int, seed: int, step: int = 1 << 14) -> np.ndarray:
    """Minimum of the shifted second permutation over each text's places: (texts, width)."""
    low = (1 << UNIVERSE_BITS) - 1
    # First permutation: odd multiplications and xor-shifts are one-to-one on the universe.
    place = keys & U(low)
    place = (place * U(0x2C1B3C6D)) & U(low)
    place = place ^ (place >> U(11))
    place = ((place * U(0x297A2D39)) & U(low)).astype(np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(_permutation(seed, width), width)
    out = np.full((len(offsets) - 1, width), 1 << UNIVERSE_BITS, np.int32)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    begins = offsets[:-1][filled]
    for at in range(0, len(place), step):
        end = min(at + step, len(place))
        lo, hi = np.searchsorted(begins, at, "right") - 1, np.searchsorted(begins, end, "left")
        cuts = np.maximum(begins[lo:hi], at) - at
        least = np.minimum.reduceat(rows[place[at:end]], cuts, axis=0)
        out[filled[lo:hi]] = np.minimum(out[filled[lo:hi]], least)
    return out


def _describe(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            keys, at = shingle_sets(data, offsets, width)
            count = np.diff(at)
            sign = signatures(keys, at, BANDS * ROWS, seed)
            bands = np.zeros((len(count), BANDS), U)
            for b in range(BANDS):
                key = np.full(len(count), U(b + 1))
                for r in range(ROWS):
                    key = mix(key * U(0x2545F4914F6CDD1D) + sign[:, b * ROWS + r].astype(U))
                bands[:, b] = key
            sums = [np.concatenate([[U(0)], np.cumsum(v, dtype=U)]) for v in (keys, mix(keys ^ U(0x5851F42D4C957F2D)))]
            s1, s2 = (s[at[1:]] - s[at[:-1]] for s in sums)
            flat = pa.array(bands.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("mark"), pa.array(count), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)],
                names=["id", "mark", "n", "s1", "s2", "bands"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            keys, at = shingle_sets(data, offsets, width)
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys.view(np.int64)))], names=["id", "keys"])
    return run


def overlaps(keys_a: np.ndarray, at_a: np.ndarray, keys_b: np.ndarray, at_b: np.ndarray, common: int = 256) -> np.ndarray:
    """Sizes of all intersections of two lists of sets. Keys that many sets share are counted by a matrix
    product, rare ones pair by pair of their holders."""
    out = np.zeros((len(at_a) - 1, len(at_b) - 1), np.float32)
    own_a, own_b = (np.repeat(np.arange(len(at) - 1), np.diff(at)) for at in (at_a, at_b))
    shared = np.intersect1d(keys_a, keys_b)
    if not len(shared):
        return out
    place_a, place_b = (np.minimum(np.searchsorted(shared, k), len(shared) - 1) for k in (keys_a, keys_b))
    in_a, in_b = shared[place_a] == keys_a, shared[place_b] == keys_b
    place_a, own_a, place_b, own_b = place_a[in_a], own_a[in_a], place_b[in_b], own_b[in_b]
    held_a, held_b = np.bincount(place_a, minlength=len(shared)), np.bincount(place_b, minlength=len(shared))
    often = np.flatnonzero(held_a * held_b > common)
    rank = np.full(len(shared), -1)
    rank[often] = np.arange(len(often))
    for lo in range(0, len(often), 512):
        wide = min(512, len(often) - lo)
        dense = []
        for place, own, many in ((place_a, own_a, out.shape[0]), (place_b, own_b, out.shape[1])):
            hit = (rank[place] >= lo) & (rank[place] < lo + wide)
            side = np.zeros((many, wide), np.float32)
            side[own[hit], rank[place[hit]] - lo] = 1
            dense.append(side)
        out += dense[0] @ dense[1].T
    rare_a, rare_b = rank[place_a] < 0, rank[place_b] < 0
    place_a, own_a, place_b, own_b = place_a[rare_a], own_a[rare_a], place_b[rare_b], own_b[rare_b]
    order = np.argsort(place_b, kind="stable")
    place_b, own_b = place_b[order], own_b[order]
    begin = np.searchsorted(place_b, place_a, "left")
    times = np.searchsorted(place_b, place_a, "right") - begin
    for lo in range(0, len(place_a), 50_000):
        t = times[lo:lo + 50_000]
        each = np.repeat(np.arange(len(t)), t)
        step = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        cell = own_a[lo:lo + 50_000][each] * out.shape[1] + own_b[begin[lo:lo + 50_000][each] + step]
        cell, n = np.unique(cell, return_counts=True)
        out.ravel()[cell] += n
    return out


def _links(percent: int):
    """One link of each left document with each component of right documents that it reaches."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sides = []
        for table in (left, right):
            lists = table.column("keys").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            offsets = np.asarray(lists.offsets).astype(np.int64)
            sides.append((np.asarray(lists.values)[offsets[0]:offsets[-1]], offsets - offsets[0], np.asarray(table.column("id")), np.asarray(table.column("comp"))))
        (keys_a, at_a, id_a, comp_a), (keys_b, at_b, id_b, comp_b) = sides
        both = overlaps(keys_a, at_a, keys_b, at_b).astype(np.int64)
        union = np.diff(at_a)[:, None] + np.diff(at_b)[None, :] - both
        a, b = np.nonzero((both * 100 >= union * percent) & (comp_a[:, None] != comp_b[None, :]))
        _, once = np.unique(np.stack([a, comp_b[b]]), axis=1, return_index=True)
        a, b = id_a[a[once]], id_b[b[once]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})
    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over ``edges`` (a, b); only ids that have an edge.

    Every round takes the least label among neighbours and then the label's own label, so labels
    travel twice as far each time.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("comp")))
    while True:
        near = (both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("near")))
        moved = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("id").alias("up"), F.col("comp").alias("top"))
        moved = cut_lineage(moved.join(up, F.col("comp") == F.col("up")).select("id", F.least("comp", "top").alias("comp"), (F.least("comp", "top") != F.col("old")).alias("changed")))
        labels = moved.select("id", "comp")
        if not moved.filter("changed").limit(1).count():
            return labels


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """id and mark: the place of a row among all rows; rows alike in id and text share it."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark")]


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, seed: int) -> DataFrame:
    """(id, mark, n, first), one row per row of ``docs``; first is the smallest (id, mark) of its component."""
    texts = docs.select(*_keyed(docs, id_col, text_col), F.col(text_col).cast("string").alias("text"))
    told = stage(texts.mapInArrow(_describe(width, seed), "id long, mark long, n long, s1 long, s2 long, bands array<long>"), "minhash")
    same = ["n", "s1", "s2"]
    # From here to the components a class is known by a key of its set, whatever the ids of its rows.
    classes = told.filter("n > 0").groupBy(*same).agg(F.min(F.struct("id", "mark", "bands")).alias("rep"))
    classes = stage(classes.select(F.xxhash64(*same).alias("key"), "n", F.struct("rep.id", "rep.mark").alias("rep"), "rep.bands"), "classes")

    member = classes.select("key", "n", F.explode("bands").alias("band"))
    wide = member.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    member = cut_lineage(member.join(wide, "band").select("band", "size", F.col("key").alias("id"), "n"))
    wanted = classes.join(member.select(F.col("id").alias("key")).distinct(), "key", "left_semi").select("key", F.col("rep.id").alias("id"), F.col("rep.mark").alias("mark"))
    # One text stands for a class; the few places that several rows share give one of them.
    twice = cut_lineage(told.filter("n > 0").groupBy("id", "mark").agg(F.count("*").alias("times")).filter("times > 1").select("id", "mark"))
    wanted = cut_lineage(wanted.join(twice.withColumn("again", F.lit(True)), ["id", "mark"], "left").withColumn("again", F.coalesce("again", F.lit(False))))

    def chosen(again: bool) -> DataFrame:
        part = broadcast_if_small(wanted.filter(F.col("again") == again).drop("again"), 1_000_000)
        return texts.join(part, ["id", "mark"]).select(F.col("key").alias("id"), "text")

    one = chosen(False)
    if twice.limit(1).count():
        one = one.unionByName(chosen(True).groupBy("id").agg(F.min("text").alias("text")))
    sets = stage(one.mapInArrow(_sets(width), "id long, keys array<long>"), "sets")

    # Shingles that no other candidate holds can be in no intersection: u of them bound every link of a document.
    single = sets.select("id", F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("id")).filter("m = 1")
    alone = single.groupBy("id").agg(F.count("*").alias("u"))
    member = member.join(alone, "id", "left").select("band", "size", "id", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("most"))
    member = cut_lineage(member.filter(F.col("most") * 100 >= F.col("n") * percent))

    def may_link() -> Column:
        """The exact upper bound of the Jaccard index reaches the threshold."""
        common = F.least("most", "most_a")
        return common * 100 >= (F.col("n") + F.col("na") - common) * percent

    # Documents that share bands, directly or through others, are one cluster; no link leaves a cluster.
    middle = F.min(F.struct(((F.col("n") - F.col("most")) / F.col("n")).alias("odd"), "id", "n", "most")).alias("mid")
    meets = cut_lineage(member.join(member.groupBy("band").agg(middle), "band").filter(F.col("id") != F.col("mid.id")).select("id", "n", "most", "mid").distinct())
    clusters = components(meets.select("id", F.col("mid.id").alias("other")).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")))

    # Each document first meets one leader, the one with the fewest shingles of its own: most clusters close.
    first = meets.groupBy("id", "n", "most").agg(F.min("mid").alias("mid"))
    pairs = (first.select("id", "n", "most", F.col("mid.id").alias("a"), F.col("mid.n").alias("na"), F.col("mid.most").alias("most_a")).filter(may_link())
             .select("a", F.col("id").alias("b")))
    left, right = sets.select(F.col("id").alias("a"), F.col("keys").alias("ka")), sets.select(F.col("id").alias("b"), F.col("keys").alias("kb"))
    both = F.size(F.array_intersect("ka", "kb"))
    linked = pairs.join(right, "b").join(left, "a").filter(both * 100 >= (F.size("ka") + F.size("kb") - both) * percent)
    edges = cut_lineage(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    comp = components(edges)

    # What is outside the largest component of its cluster meets the whole cluster, in blocks of bounded size.
    placed = member.select("id", "n", "most").distinct().join(clusters.withColumnRenamed("comp", "cluster"), "id").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    placed = cut_lineage(placed)
    parts = placed.groupBy("cluster", "comp").agg(F.count("*").alias("rows"), F.sum(F.col("n") + DOC_WEIGHT).alias("weight"))
    shape = parts.groupBy("cluster").agg(F.max(F.struct("rows", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("weight").alias("weight")).filter("comps > 1")
    shape = shape.select("cluster", F.col("main.comp").alias("main"), F.ceil(F.col("weight") / BLOCK_WEIGHT).alias("blocks"))
    rows = placed.join(shape, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).join(sets, "id")
    rows = stage(rows.select("cluster", "main", "blocks", "block", "id", "comp", "keys"), "blocks")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    outside = rows.filter("comp <> main").withColumn("other", every).select("cluster", F.col("block").alias("l"), F.col("other").alias("r"), "id", "comp", "keys").toDF("cluster", "l", "r", "id", "comp", "keys")
    inside = rows.withColumn("other", every).select("cluster", F.col("other").alias("l"), F.col("block").alias("r"), "id", "comp", "keys").toDF("c", "i", "j", "id", "comp", "keys")
    by = ["cluster", "l", "r"]
    found = outside.groupBy(*by).cogroup(inside.groupBy("c", "i", "j")).applyInArrow(_links(percent), "a long, b long")
    comp = components(edges.unionByName(found))
    joined = cut_lineage(classes.select(F.col("key").alias("id"), "rep").join(comp, "id"))
    heads = joined.join(joined.groupBy("comp").agg(F.min("rep").alias("head")), "comp").select(F.col("id").alias("key"), "head")
    heads = classes.select("key", "rep").join(heads, "key", "left").select("key", F.coalesce("head", "rep").alias("first"))
    key = F.when(F.col("n") > 0, F.xxhash64(*same)).otherwise(F.xxhash64("id", "mark"))
    out = told.select("id", "mark", "n", key.alias("key")).join(heads, "key", "left")
    own = F.struct("id", "mark")
    return out.select("id", "mark", "n", F.when(F.col("n") > 0, F.col("first")).otherwise(own).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80, seed: int = 11) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of ``docs``."""
    out = _linked(docs, id_col, text_col, width, percent, seed)
    plain = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select(plain("id").alias(id_col), F.col("n").alias("n_shingles"), plain("first.id").alias("component_id"), (F.struct("id", "mark") == F.col("first")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80, seed: int = 11) -> DataFrame:
    """Rows of ``docs`` that stay: the first of each component and every text without words, same columns."""
    kept = _linked(docs, id_col, text_col, width, percent, seed).filter(F.struct("id", "mark") == F.col("first"))
    kept = kept.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), (F.col("n") == 0).alias("_bare")).distinct()
    key = _keyed(docs, id_col, text_col)
    rows = docs.select(F.struct(*docs.columns).alias("row"), key[0].alias("_id"), key[1].alias("_mark")).join(kept, ["_id", "_mark"])
    # Of rows alike in id and text one stays; texts without words are dealt out, they are copies of nothing.
    one = Window.partitionBy("_id", "_mark", F.when(F.col("_bare"), F.xxhash64("row"))).orderBy("row")
    rows = rows.withColumn("_place", F.row_number().over(one)).filter("_place = 1 OR _bare")
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
