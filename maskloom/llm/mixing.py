"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source gets the expected number of copies target / source size. Its whole part
is taken outright; its fraction is a copy probability. Two fractions are paired and mass, measured
in words, moves from one to the other with the chance that keeps both expectations until one is 0
or 1; so the words taken stay exactly on target but for the one fraction that is left.

Blocks of bounded size (a source of any size is cut into blocks by a hash of its rows) settle in
parallel; the fraction left by each block goes up a reduction tree of the same fan-in. Of a pair the smaller
document settles and the larger stays open. So documents of more than 1 / fan-in of their source (fewer
than fan-in, one group) come first, in classes of halved size: the fraction that a class leaves is rounded and the
rate of all smaller documents is aimed anew at what is left of the target, as long as it then stays between 0
and the limit; the expectation of every document holds. What is left in the end is a small
document, unless a source has too few small ones to make up for a large one. Chance comes from a seeded
hash of ids: reruns agree whatever the partitioning.

Defined cases: a null text has size 0 and nothing is taken from it; sources are ordered by code
point, null is a source of its own and the last; rows alike in every column are one item and share their copies; an empty
table, or one without words, gives targets of 0. Only the named columns are read.
"""
from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.windows import dense_ids
from ..session import cut_lineage
from .common import broadcast_if_small, text_or_empty, word_count

LIMIT = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = LIMIT) -> DataFrame:
    """(source, source_size, source_rows, target) from rows of (source, size).

    Shares by weight, held at ``limit`` times the source; the excess is shared again until no target is above.
    Each round is one aggregate over sources, whatever their number.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("source_rows"))
    per = dense_ids(per, [F.col("source").asc_nulls_last()], "place", base=0)
    cycle = F.array(*[F.lit(w) for w in weights])
    per = cut_lineage(per.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))).drop("place"))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    share, held = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(share) > F.col("source_size") * limit if held >= 0 else F.lit(False)
        now = per.agg(F.count(F.when(full, 1)).alias("held"), F.sum(F.when(full, F.col("source_size") * limit).otherwise(0)).alias("fixed"),
                      F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open")).first()
        if now.held == held or not now.open:
            break
        share, held = (total - now.fixed) / now.open, now.held
    target = F.least(F.col("weight") * F.lit(float(share)), (F.col("source_size") * limit).cast("double"))
    return per.select("source", "source_size", "source_rows", target.alias("target"))


def _chance(seed: int, *keys) -> float:
    return int.from_bytes(hashlib.blake2b(repr((seed, *keys)).encode(), digest_size=8).digest(), "little") / 2**64


def settle(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Sequential pivotal steps over one block; at most one fraction is left."""
    rows = rows.sort_values(["size", "tag"], ascending=[False, True], kind="stable").reset_index(drop=True)
    x, w, tag = rows["x"].tolist(), rows["size"].tolist(), rows["tag"].tolist()
    open_at = -1
    for i in range(len(x)):
        if not 0.0 < x[i] < 1.0:
            continue
        if open_at < 0:
            open_at = i
            continue
        a, b = open_at, i
        ratio = w[a] / w[b]
        up, down = min(1.0 - x[a], x[b] / ratio), min(x[a], (1.0 - x[b]) / ratio)
        step = up if _chance(seed, tag[a], tag[b]) * (up + down) < down else -down
        x[a], x[b] = x[a] + step, x[b] - step * ratio
        x[a], x[b] = (round(v) if abs(v - round(v)) < 1e-9 else v for v in (x[a], x[b]))
        open_at = a if 0.0 < x[a] < 1.0 else b if 0.0 < x[b] < 1.0 else -1
    return rows.assign(x=[float(v) for v in x])


def settle_large(rows: pd.DataFrame, seed: int, limit: int) -> pd.DataFrame:
    """Large documents of one source settled by falling size; ``rate`` is what its other documents are to be taken at."""
    rows = rows.sort_values(["size", "tag"], ascending=[False, True], kind="stable").reset_index(drop=True)
    rest, left = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    rate, done, open_rows = left / rest, [], rows.iloc[:0]
    for _, own in rows.groupby(rows["size"].map(lambda w: -int(w).bit_length())):
        rate = float(round(rate)) if abs(rate - round(rate)) < 1e-9 else rate
        own = own.assign(base=int(rate), x=rate - int(rate))
        words = int(own["size"].sum())
        rest, left = rest - words, left - rate * words
        block = settle(pd.concat([open_rows, own]) if len(open_rows) else own, seed)
        fraction = (block["x"] > 0) & (block["x"] < 1)
        done.append(block[~fraction])
        open_rows = block[fraction]
        if rest and len(open_rows):
            x, w, tag = (open_rows[c].iloc[0] for c in ("x", "size", "tag"))
            # Whichever way the fraction falls, the smaller documents must be able to make up for it.
            if left >= (1 - x) * w and left + x * w <= limit * rest:
                hit = float(_chance(seed, int(tag)) < x)
                done.append(open_rows.assign(x=hit))
                left, open_rows = left - (hit - x) * w, open_rows.iloc[:0]
                rate = left / rest
    return pd.concat([part for part in (*done, open_rows) if len(part)]).assign(rate=rate)


def mix(docs: DataFrame, id_col: str = "doc_id", seed: int = 7, fan_in: int = 4096, weights: tuple[int, ...] = (1, 2, 3), limit: int = LIMIT) -> DataFrame:
    """(id, source, row_hash, rows, size, source_size, target, copies, taken); ``rows`` is 1 but for rows alike in every column."""
    rows = docs.select(F.col(id_col).alias("id"), F.col("source").cast("string").alias("source"), word_count(text_or_empty()).alias("words"),
                       F.xxhash64(*docs.columns).alias("row_hash"))
    # One pass over the texts. Rows alike in every column are one item: all of them get the same copies.
    rows = cut_lineage(rows.groupBy("id", "source", "row_hash", "words").agg(F.count("*").alias("rows"))
                       .withColumn("size", F.col("words") * F.col("rows")))
    goals = source_targets(rows, weights, limit)
    rows = rows.join(broadcast_if_small(goals), rows["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("tag", F.xxhash64("id", "row_hash", F.lit(seed)))
    rows = rows.withColumn("block", F.pmod("tag", F.ceil(F.col("source_rows") / fan_in)).cast("long")).drop("source_rows")
    rows = rows.withColumn("base", F.lit(0)).withColumn("x", F.lit(0.0)).withColumn("rate", rate)
    is_large = F.col("size") * fan_in > F.col("source_size")
    large = rows.filter(is_large)
    large = cut_lineage(large.groupBy("source").applyInPandas(lambda pdf: settle_large(pdf, seed, limit), large.schema))
    aims = large.groupBy(F.col("source").alias("aimed")).agg(F.max("rate").alias("aim"))
    small = rows.filter(~is_large).join(broadcast_if_small(aims), F.col("source").eqNullSafe(F.col("aimed")), "left")
    small = small.withColumn("rate", F.coalesce("aim", "rate")).drop("aimed", "aim").withColumn("base", F.floor("rate").cast("int"))
    small = small.withColumn("x", F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(F.lit(0.0)))
    rows = large.unionByName(small).drop("rate")
    open_rows, done = rows, []
    # Every level cuts the number of fractions per source by the fan-in; the widest source sets the depth.
    blocks = rows.agg(F.max("block")).first()[0] or 0
    while True:
        kind = open_rows.schema
        settled = cut_lineage(open_rows.groupBy("source", "block").applyInPandas(lambda pdf: settle(pdf, seed), kind))
        fraction = (F.col("x") > 0) & (F.col("x") < 1)
        if blocks == 0:
            done.append(settled)
            break
        done.append(settled.filter(~fraction))
        blocks //= fan_in
        open_rows = settled.filter(fraction).withColumn("block", F.floor(F.col("block") / fan_in).cast("long"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    last = F.when((F.col("x") > 0) & (F.col("x") < 1), (F.pmod(F.xxhash64("tag", F.lit(seed)), F.lit(1 << 30)) < F.col("x") * (1 << 30)).cast("int")).otherwise(F.col("x").cast("int"))
    copies = F.col("base") + last
    return out.select(F.col("id").alias(id_col), "source", "row_hash", "rows", F.col("words").alias("size"), "source_size", "target",
                      copies.alias("copies"), (copies * F.col("words")).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the rounding takes it, same columns."""
    chosen = mix(docs, id_col, **settings)
    chosen = chosen.filter("copies > 0").select(F.col(id_col).alias("_id"), F.col("row_hash").alias("_hash"), F.array_repeat(F.lit(1), F.col("copies")).alias("_copies"))
    keyed = docs.withColumn("_hash", F.xxhash64(*docs.columns))
    joined = keyed.join(chosen, (keyed["_hash"] == chosen["_hash"]) & keyed[id_col].eqNullSafe(chosen["_id"]))
    return joined.select(*[keyed[c] for c in docs.columns], F.explode("_copies").alias("_n")).drop("_n")
