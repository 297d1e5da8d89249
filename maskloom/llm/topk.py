"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into buckets of similar length. A bounded set of the longest vectors gives every query a
first lower bound on its k-th score. For a query and a bucket, bound / (query length * longest
vector of the bucket) is the cosine that a partner must reach there. No bucket is visited where it
exceeds 1. Where it is high, coordinates prune: a partner's value on the query's largest
coordinates must lie in an interval that follows from the cosine (two sorted lists are cut). Where
it is low, lengths prune: only the vectors long enough are taken. What is left is verified by exact
integer products, and the bound rises as results come in.

Buckets and queries are cut into blocks of bounded size, so a bucket that holds one very common
vector spreads. Every (query block, vector block) pair that a bound allows is one task's group.

Defined cases: rows with a null id, a null vector, or null, NaN or infinite components take no part;
rows alike in id and vector count once; vectors of different lengths are compared as if
padded with zeros; a zero query scores 0 everywhere and takes the smallest ids; scores beyond 64
bits are held at its ends; an empty table gives no rows. Only the id and the vector column are read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage

COORDINATES = 2
STEEP = 0.3  # local cosine from which coordinates prune better than lengths


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    offsets = np.asarray(column.offsets)
    sizes = np.diff(offsets)
    flat = np.asarray(column.values)[offsets[0]:offsets[-1]].astype(np.int64) if len(column) else np.zeros(0, np.int64)
    wide = int(sizes.max(initial=0))
    if len(sizes) and (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, wide - m.shape[1]))) if m.shape[1] < wide else m for m in (a, b))


class Products:
    """Exact integer products of rows of one matrix with a vector, in the narrowest exact type."""

    def __init__(self, q: np.ndarray, v: np.ndarray):
        top = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0)) * max(1, v.shape[1])
        self.kind = np.float64 if top < 2**53 else np.int64 if top < 2**63 else object
        self.q, self.v = q.astype(self.kind), v.astype(self.kind)

    def of(self, i: int, rows=slice(None)) -> np.ndarray:
        out = self.v[rows] @ self.q[i]
        return np.clip(out, -2**63, 2**63 - 1).astype(np.int64) if self.kind is object else out.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(float) ** 2).sum(axis=1))


def search_block(q_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vector place, score): up to k per query that may be among its best."""
    q, v = _same_width(q, v)
    lengths = _lengths(v)
    order = np.argsort(-lengths, kind="stable")
    v, v_ids, lengths = v[order], v_ids[order], lengths[order]
    exact = Products(q, v)
    unit = v / np.maximum(lengths, 1e-300)[:, None]
    q_lengths = _lengths(q)
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(q)):
        bound, rows = bounds[i], slice(None)
        if np.isfinite(bound) and bound > 0:
            cosine = bound / max(q_lengths[i] * lengths[0], 1e-300) * (1 - 1e-12)
            if cosine > 1:
                continue
            if cosine < STEEP:
                rows = np.arange(np.searchsorted(-lengths, -bound / q_lengths[i] * (1 - 1e-12), "right"))
            else:
                own = q[i] / q_lengths[i]
                for f in np.argsort(-np.abs(own))[:COORDINATES]:
                    if f not in lists:
                        place = np.argsort(unit[:, f], kind="stable")
                        lists[f] = place, unit[place, f]
                    place, values = lists[f]
                    reach = np.sqrt(max(0.0, (1 - cosine**2) * (1 - own[f] ** 2))) + 1e-9
                    # A cosine above the bound only narrows the interval on the far side of the query's own value.
                    low = -1.0 if cosine <= -own[f] else own[f] * cosine - reach
                    high = 1.0 if cosine <= own[f] else own[f] * cosine + reach
                    lo, hi = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
                    found = place[lo:hi]
                    rows = np.sort(found) if isinstance(rows, slice) else np.intersect1d(rows, found, assume_unique=True)
        scores = exact.of(i, rows)
        where = np.arange(len(v)) if isinstance(rows, slice) else rows
        ok = v_ids[where] != q_ids[i]
        if np.isfinite(bound):
            ok &= scores >= bound
        where, scores = where[ok], scores[ok]
        top = best(scores, v_ids[where], k)
        out.append((np.full(len(top), i), where[top], scores[top]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, where, scores = (np.concatenate(x) for x in zip(*out))
    return at, order[where], scores


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of rows that take part."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, buckets: int = 32, block: int = 32_768, query_block: int = 4096, seeds: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row of ``queries`` (id, v) against all ``rows`` (id, v) but its own id."""
    spark = rows.sparkSession
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    base = stage(rows.dropDuplicates(["id", "v"]).withColumn("length", length), "vectors")
    asked = queries.dropDuplicates(["id", "v"]).withColumn("length", length)

    head = base.orderBy(F.col("length").desc(), "id").limit(seeds).select("id", "v").toArrow()  # at most `seeds` rows
    seed_ids, seed = np.asarray(head.column("id")), _matrix(head.column("v"))

    def bounds(batches):
        for batch in batches:
            ids, (q, v) = np.asarray(batch.column("id")), _same_width(_matrix(batch.column("v")), seed)
            exact, low = Products(q, v), np.full(len(ids), -np.inf)
            for i in range(len(ids)):
                scores = exact.of(i)[seed_ids != ids[i]]
                if len(scores) >= k:
                    low[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low)], names=[*batch.schema.names, "bound"])

    asked = stage(asked.mapInArrow(bounds, "id long, v array<long>, length double, bound double"), "queries")
    cuts = base.agg(F.percentile_approx("length", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c <= F.col("length"))) if cuts else F.lit(0)
    placed = base.withColumn("bucket", bucket)
    tops = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()  # at most `buckets` rows
    shape = spark.createDataFrame([(r.bucket, -(-r.n // block), r.longest) for r in tops], "bucket int, subs int, longest double")
    q_blocks = max(1, -(-asked.count() // query_block))

    placed = (placed.join(F.broadcast(shape), "bucket").withColumn("sub", F.pmod(F.xxhash64("id", "v"), "subs").cast("int"))
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).select("part", "bucket", "sub", "id", "v"))
    visits = F.filter(F.array(*[F.struct(F.lit(r.bucket).alias("bucket"), F.lit(-(-r.n // block)).alias("subs"), F.lit(float(r.longest)).alias("longest")) for r in tops]),
                      lambda b: (F.col("bound") <= 0) | (F.col("length") * b["longest"] * (1 + 1e-12) >= F.col("bound"))) if tops else F.array()
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(q_blocks)).cast("int"))
    if not tops:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = (asked.withColumn("visit", F.explode(visits)).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("visit.subs") - 1)))
             .select("part", F.col("visit.bucket").alias("bucket"), "sub", "id", "v", "bound", F.xxhash64("id", "v").alias("asked")))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        at, where, scores = (np.zeros(0, np.int64),) * 3
        q_ids, keys, v_ids = (np.asarray(x) for x in (left.column("id"), left.column("asked"), right.column("id")))
        if left.num_rows and right.num_rows:
            at, where, scores = search_block(q_ids, _matrix(left.column("v")), np.asarray(left.column("bound")), v_ids, _matrix(right.column("v")), k)
        return pa.table({"asked": keys[at], "query_id": q_ids[at], "vec_id": v_ids[where], "score": scores})

    by = ["part", "bucket", "sub"]
    found = asked.groupBy(*by).cogroup(placed.groupBy(*by)).applyInArrow(meet, "asked long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "asked").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
