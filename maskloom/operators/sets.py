"""Set operations and bounded selections."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..model import MAX_PROPOSALS, MAX_PROPOSALS_LIMIT
from .windows import rank_within


def append_unreviewed(current: DataFrame, rows: DataFrame, status: str = "draft") -> DataFrame:
    """Imported (draft) or generated (proposal) rows join the table without any review state."""
    fresh = rows.withColumns({"status": F.lit(status), "review_actor": F.lit(None).cast("string"),
                              "training_excluded": F.lit(False)})
    return current.unionByName(fresh, allowMissingColumns=True)


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def missing(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(done, keys, "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only; empty means equal multisets."""
    return (a.exceptAll(b).withColumn("side", F.lit("only_left"))
            .unionByName(b.exceptAll(a).withColumn("side", F.lit("only_right"))))


def not_subset(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks; empty means subset."""
    return a.select(key).distinct().join(b, key, "left_anti")


def rank_proposals(rows: DataFrame, key: str) -> DataFrame:
    """Stable score order inside a key of any size: score descending, ties by arrival."""
    return rank_within(rows, [key], [F.desc("score"), F.asc("ordinal")])


def split_best(rows: DataFrame, key: str) -> DataFrame:
    """Best row per key by score, ties by arrival, with the number of alternatives."""
    return (rows.groupBy(key).agg(F.min_by("id", F.struct(-F.col("score"), F.col("ordinal"))).alias("best_id"),
                                  (F.count("*") - 1).alias("alternatives")))


def limit_repairs(seams: DataFrame, key: str, order: str, k: int = 3) -> DataFrame:
    """Mark the first ``k`` seam objects per key; the others are deferred, never dropped.

    The first k per key come from a bounded top-k: a window whose rank is filtered, which Spark
    limits per partition before the shuffle.
    """
    if not 1 <= k <= 20:
        raise ValueError("limit must be 1 to 20")
    ranked = seams.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_rn") <= k)
    chosen = ranked.select(key, order, F.lit(True).alias("_chosen"))
    return seams.join(chosen, [key, order], "left").withColumn("deferred", F.col("_chosen").isNull()).drop("_chosen")


def guard_max(existing: DataFrame, candidates: DataFrame, key: list[str], limit: int = MAX_PROPOSALS) -> DataFrame:
    """Layers whose distinct proposals would exceed the limit; they fail whole, nothing is cut."""
    if not 1 <= limit <= MAX_PROPOSALS_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_PROPOSALS_LIMIT}")
    both = existing.select(*key, "signature").unionByName(candidates.select(*key, "signature")).distinct()
    return both.groupBy(*key).agg(F.count("*").alias("proposals")).filter(F.col("proposals") > limit)
