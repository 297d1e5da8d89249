"""Numbering, allocation and order-dependent operators.

Global numbering never puts a table into one window: rows are range-sorted, made durable, and
numbered by the offset of their sorted partition.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import planes
from ..session import cut_lineage
from .batches import gather_columns, matrix, per_batch
from .masks import PIECES, longest_runs


def dense_ids(df: DataFrame, order: list, out: str = "id", base: int = 1) -> DataFrame:
    """Dense consecutive ids in ``order`` (which must be unique).

    Range sorting samples the whole ordering key, so one hot leading value still spreads out.
    The sorted rows are checkpointed: partition numbers are data from then on and survive lost
    executors. Only one row per partition is needed to compute offsets.
    """
    ranked = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part, offset = F.expr("shiftright(_mid, 33)"), F.expr("_mid & 8589934591L")
    sizes = ranked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(
        F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    # One row per partition of the sort: broadcast, so that the rows themselves are not exchanged again.
    return (ranked.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn(out, F.col("_start") + offset + F.lit(base)).drop("_part", "_start", "_mid"))


def rank_within(df: DataFrame, keys: list[str], order: list, out: str = "rank") -> DataFrame:
    """Position of every row inside its key, in ``order`` (unique per key), for keys of any size.

    One global sort by key and order spreads a hot key over many partitions; the rank is the dense
    position less the first position of the key.
    """
    numbered = dense_ids(df, [*[F.asc_nulls_first(k) for k in keys], *order], "_pos", base=0)
    first = numbered.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    names = [F.col(k).alias(f"_{k}") for k in keys]
    first = first.select(*names, "_first")
    same = [numbered[k].eqNullSafe(first[f"_{k}"]) for k in keys]
    return numbered.join(first, same).withColumn(out, F.expr("_pos - _first + 1")).drop("_pos", "_first", *[f"_{k}" for k in keys])


def class_index(classes: DataFrame, base: int = 0) -> DataFrame:
    """Contiguous index of active classes by their order.

    Classes are a vocabulary, not data: the plane formats allow at most 65 535 of them.
    """
    order = Window.orderBy("ord", "class_id")
    return (classes.filter("NOT archived")
            .select("class_id", "name", (F.row_number().over(order) - 1 + base).cast("bigint").alias("class_index")))


def plan_rounds(pool: DataFrame, rounds: int, order: str = "import", seed: int = 42,
                manual: DataFrame | None = None, first_number: int = 1) -> DataFrame:
    """Split a pool into ``rounds`` near-equal rounds; the first ``n % rounds`` get one more image.

    ``order`` is import, shuffle (hash order of seed and id) or manual (``manual`` is
    image_id, position and must be a permutation of the pool).
    """
    if order == "import":
        keyed = pool.select("image_id", F.col("image_id").alias("_o"))
    elif order == "shuffle":
        keyed = pool.select("image_id", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("image_id").cast("string")), 256).alias("_o"))
    elif order == "manual":
        if permutation_issues(pool, manual).limit(1).count():
            raise ValueError("manual order must contain each eligible image exactly once")
        keyed = manual.select("image_id", F.col("position").alias("_o"))
    else:
        raise ValueError("order must be import, shuffle or manual")
    numbered = dense_ids(keyed, ["_o", "image_id"], "position", base=0)
    total = numbered.agg(F.max("position")).first()[0]
    n = 0 if total is None else total + 1
    if not 1 <= rounds <= n:
        raise ValueError(f"choose 1 to {n} rounds for {n} eligible images")
    q, r = divmod(n, rounds)
    number = f"CASE WHEN position < {r * (q + 1)} THEN position div {q + 1} ELSE {r} + (position - {r * (q + 1)}) div {q} END"
    return numbered.select("image_id", "position", F.expr(f"CAST({number} AS BIGINT) + {first_number}").alias("round_number"))


def permutation_issues(pool: DataFrame, manual: DataFrame) -> DataFrame:
    """Images missing from, foreign to or repeated in a manual order."""
    given = manual.groupBy("image_id").agg(F.count("*").alias("_n"))
    return (pool.select("image_id", F.lit(True).alias("_pool")).join(given, "image_id", "full")
            .withColumn("issue", F.expr("""CASE WHEN _n IS NULL THEN 'missing' WHEN _pool IS NULL THEN 'foreign'
                                           WHEN _n > 1 THEN 'repeated' END"""))
            .filter("issue IS NOT NULL").select("image_id", "issue"))


def replan_rounds(images: DataFrame, rounds: DataFrame, count: int, **order) -> DataFrame:
    """Keep started rounds, allocate the other pool images to new rounds that continue the numbers."""
    locked = rounds.filter("status <> 'planned'")
    pool = images.filter("role = 'pool' AND NOT removed").join(locked.select("image_id"), "image_id", "left_anti")
    kept = locked.select("round_number").distinct().count()
    fresh = plan_rounds(pool, count, first_number=kept + 1, **order)
    return (locked.select("image_id", "round_number", F.lit(True).alias("locked"))
            .unionByName(fresh.select("image_id", "round_number", F.lit(False).alias("locked"))))


def yolo_collisions(rows: DataFrame) -> DataFrame:
    """Label rows a loader would merge: same image, class and float32 centre and size.

    ``rows`` has image_id, class_index, row and float columns minx, miny, maxx, maxy.
    """
    keyed = rows.selectExpr(
        "image_id", "class_index", "row", "(minx + maxx) / CAST(2 AS FLOAT) AS cx", "(miny + maxy) / CAST(2 AS FLOAT) AS cy",
        "maxx - minx AS w", "maxy - miny AS h")
    keyed = keyed.withColumns({c: F.col(c).cast("float") for c in ("cx", "cy", "w", "h")})
    key = ["image_id", "class_index", "cx", "cy", "w", "h"]
    first = keyed.groupBy(*key).agg(F.min("row").alias("first_row"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return keyed.join(first, key).filter("row > first_row").select("image_id", "class_index", "first_row", "row")


def next_review(images: DataFrame, block: int = 65_536) -> DataFrame:
    """Per image the next one to review: the first eligible later image, else the first eligible one.

    Positions are cut into blocks; a window never sees more than one block, and blocks are
    summarised to one row each for the look-ahead.
    """
    eligible = "NOT complete AND missing IS NULL AND role <> 'excluded'"
    rows = (dense_ids(images.select("image_id", F.expr(eligible).alias("_ok")), ["image_id"], "_pos", base=0)
            .withColumn("_block", F.expr(f"_pos div {block}")))
    after = Window.partitionBy("_block").orderBy("_pos").rowsBetween(1, Window.unboundedFollowing)
    target = F.when(F.col("_ok"), F.col("image_id"))
    local = rows.withColumn("_local", F.first(target, ignorenulls=True).over(after))
    heads = rows.groupBy("_block").agg(F.min_by(target, F.when(F.col("_ok"), F.col("_pos"))).alias("_head"))
    later = Window.orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    ahead = heads.withColumn("_ahead", F.first("_head", ignorenulls=True).over(later)).drop("_head")
    start = rows.filter("_ok").agg(F.min_by("image_id", "_pos").alias("_start"))
    # One row per block and one row in all: both are joined by size.
    return (local.join(ahead, "_block", "left").withColumn("_one", F.lit(1))
            .join(start.withColumn("_one", F.lit(1)), "_one", "left")
            .select("image_id", F.coalesce("_local", "_ahead", F.when(F.col("_start") != F.col("image_id"), F.col("_start")))
                    .alias("next_image_id")))


def anchor_point(rles: DataFrame, *keys: str) -> DataFrame:
    """Middle pixel of the longest foreground run of a mask, the first run on ties."""
    runs = longest_runs(rles, *keys)  # one row for each row of counts
    best = runs.groupBy(*keys).agg(F.max("height").alias("height"),
                                   F.max_by(F.struct("_s", "_e"), F.struct(F.expr("_e - _s"), -F.col("_s"))).alias("b"))
    return best.selectExpr(*keys, "((b._s + b._e - 1) div 2) div height AS x", "((b._s + b._e - 1) div 2) % height AS y")


def paint(slabs: DataFrame, policy: str = "first", exact_cover: bool = False) -> DataFrame:
    """Resolve overlapping objects onto one plane by ``ord``; returns the visible pieces.

    ``slabs`` has image_id, x0..y1, ord (unique per object) and any payload in a struct ``obj``. Blocks of columns are
    planes of their own and swept in Arrow batches: the pieces follow what is visible, however many objects lie
    on each other. ``covering`` is 1, or 2 where several objects meet; with ``exact_cover`` it counts them, and pieces
    are cut where the count changes.
    """
    if policy not in ("first", "last"):
        raise ValueError("policy must be first or last; use plane_conflicts for the error policy")
    kinds = {c: slabs.schema[c].dataType.simpleString() for c in ("ord", "obj")}

    def work(owner, flat, table):
        order = pc.array_sort_indices(flat.field(4), order="ascending" if policy == "first" else "descending")
        rank = np.empty(len(owner), np.int64)
        rank[np.asarray(order)] = np.arange(len(owner))
        made = planes.sweep(owner, matrix(flat, 4), rank, most=1 << 60 if exact_cover else 2)
        front = order.take(pa.array(made.front))
        return (made.x0, made.x1, made.y0, made.y1, flat.field(4).take(front), flat.field(5).take(front), made.cover), made.plane

    return per_batch(gather_columns(slabs, ["image_id"], "ord", "obj"), "slabs", ["image_id"],
                     f"{PIECES}, ord {kinds['ord']}, obj {kinds['obj']}, covering bigint", work)


def plane_conflicts(painted: DataFrame) -> DataFrame:
    """Pixels covered more than once; any row means the error policy refuses the plane."""
    return (painted.filter("covering > 1").groupBy("image_id")
            .agg(F.sum(F.expr("(x1 - x0) * (y1 - y0)")).alias("overlap_pixels")))
