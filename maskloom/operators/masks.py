"""Exact mask algebra on slab rows.

A slab is ``[x0, x1) x [y0, y1)``; the slabs of one mask do not overlap. Area, bounds, crop,
translation and overlap work on slabs of any width. Unions and combinations are swept in blocks of
columns, so work follows the number of slabs and not the number of pixel columns.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import planes, shapes
from .batches import gather_columns, matrix, per_batch

OVERLAP_BLOCK = 128


def boxes_to_slabs(boxes: DataFrame, *keys: str) -> DataFrame:
    """An integer box is one slab."""
    return boxes.select(*keys, *[F.col(c).cast("bigint") for c in ("x0", "x1", "y0", "y1")]).filter("x0 < x1 AND y0 < y1")


def to_columns(slabs: DataFrame) -> DataFrame:
    """One row per pixel column: the per-column run form of a mask."""
    return slabs.select(*[c for c in slabs.columns if c not in ("x0", "x1")],
                        F.explode(F.expr("sequence(x0, x1 - 1)")).alias("x"))


def mask_stats(slabs: DataFrame, *keys: str) -> DataFrame:
    """Exact pixel area and exclusive bounds per key (slabs of a key must not overlap)."""
    return slabs.groupBy(*keys).agg(
        F.sum(F.expr("(x1 - x0) * (y1 - y0)")).alias("area"),
        F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"))


def mask_union(slabs: DataFrame, *keys: str) -> DataFrame:
    """Pixel OR of all slabs sharing ``keys``, as non-overlapping slabs.

    Every block of columns of a key is a plane of its own: its slabs are gathered, swept in Arrow batches, and give
    as many rows as the union has pieces.
    """
    def work(owner, flat, table):
        made = planes.sweep(owner, matrix(flat))
        return (made.x0, made.x1, made.y0, made.y1), made.plane

    return per_batch(gather_columns(slabs.select(*keys, "x0", "x1", "y0", "y1"), list(keys)), "slabs", list(keys), PIECES, work)


PIECES = "x0 bigint, x1 bigint, y0 bigint, y1 bigint"


# Which pixels a combination keeps, from how many slabs of either side cover them.
COMBINE = {"or": lambda n, m: (n > 0) | (m > 0), "and": lambda n, m: (n > 0) & (m > 0), "xor": lambda n, m: (n > 0) != (m > 0), "minus": lambda n, m: (n > 0) & (m == 0)}


def mask_combine(left: DataFrame, right: DataFrame, how: str, *keys: str) -> DataFrame:
    """Pixels of ``left`` how ``right`` per key, as non-overlapping slabs; slabs of one side may overlap."""
    keep = COMBINE[how]

    def work(owner, flat, table):
        made = planes.sweep(owner, matrix(flat, 4), side=np.asarray(flat.field(4), np.int64), keep=keep)
        return (made.x0, made.x1, made.y0, made.y1), made.plane

    both = left.select(*keys, "x0", "x1", "y0", "y1", F.lit(0).alias("_side")).unionByName(right.select(*keys, "x0", "x1", "y0", "y1", F.lit(1).alias("_side")))
    return per_batch(gather_columns(both, list(keys), "_side"), "slabs", list(keys), PIECES, work)


def _side_by_side(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (x, y0, y1) of an Arrow batch as slabs: runs alike of neighbouring columns that follow each other are one."""
    import pyarrow as pa
    import pyarrow.compute as pc

    source = columns.select(*keys, *[F.col(c).cast("bigint").alias(c) for c in ("x", "y0", "y1")])
    schema = T.StructType([*[source.schema[k] for k in keys], *T.StructType.fromDDL(PIECES).fields])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y0, y1 = (np.asarray(batch.column(c), np.int64) for c in ("x", "y0", "y1"))
            fresh = np.ones(len(x), bool)
            fresh[1:] = (x[1:] != x[:-1] + 1) | (y0[1:] != y0[:-1]) | (y1[1:] != y1[:-1])
            for k in keys:
                # A null is never known to equal its neighbour, which only leaves a slab in two.
                same = pc.equal(batch.column(k).slice(1), batch.column(k).slice(0, len(x) - 1)).fill_null(False)
                fresh[1:] |= ~np.asarray(same.to_numpy(zero_copy_only=False), bool)
            head = np.flatnonzero(fresh)
            last = np.append(head[1:], len(x)) - 1
            own = pa.Table.from_batches([batch]).select(keys).take(pa.array(head))
            for name, array in zip(("x0", "x1", "y0", "y1"), (x[head], x[last] + 1, y0[head], y1[head])):
                own = own.append_column(name, pa.array(array))
            yield from own.to_batches()

    return source.mapInArrow(run, schema)


def merge_columns(columns: DataFrame, *keys: str) -> DataFrame:
    """Union in the per-column form (x, y0, y1).

    What is shuffled are slabs, put together from neighbouring columns before: their number follows the slabs the columns
    came from. Blocks of columns are united in Arrow batches and fall into columns again.
    """
    return to_columns(mask_union(_side_by_side(columns, list(keys)), *keys)).select(*keys, "x", "y0", "y1")


def _foreground(table):
    """Row, start and stop of every foreground run of the column ``counts``."""
    lists = table.column("counts").combine_chunks()
    sizes = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    runs = np.asarray(lists.flatten(), dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    ends = np.cumsum(runs)
    before = np.concatenate(([0], ends))[first]
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(runs)) - first[row] if len(runs) else np.zeros(0, dtype=np.int64)
    keep = (inside % 2 == 1) & (runs > 0)
    row, stop, length = row[keep], (ends - before[row])[keep], runs[keep]
    return row, stop - length, stop


def _of_runs(rles: DataFrame, keys: tuple[str, ...], made: str, work) -> DataFrame:
    """Keys, height and the columns ``made``: ``work(table, row, start, stop)`` gives the row each result belongs to, and their arrays."""
    import pyarrow as pa

    source = rles.select(*keys, F.col("height").cast("bigint").alias("height"), F.col("counts").cast("array<bigint>").alias("counts"))
    fields = T.StructType.fromDDL(made).fields
    schema = T.StructType([*[f for f in source.schema.fields if f.name != "counts"], *fields])

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            row, *arrays = work(table, *_foreground(table))
            out = table.drop_columns(["counts"]).take(pa.array(row))
            for field, array in zip(fields, arrays):
                out = out.append_column(field.name, pa.array(array))
            yield from out.to_batches()

    return source.mapInArrow(run, schema)


def rle_intervals(rles: DataFrame, *keys: str) -> DataFrame:
    """Half-open foreground intervals [_s, _e) of column-major counts, without a shuffle.

    Prefix sums run per Arrow batch over the flattened count lists.
    """
    return _of_runs(rles, keys, "_s bigint, _e bigint", lambda table, row, start, stop: (row, start, stop))


def longest_runs(rles: DataFrame, *keys: str) -> DataFrame:
    """The longest foreground interval [_s, _e) of every row of counts, the first on ties."""
    def work(table, row, start, stop):
        order = np.lexsort((start, start - stop, row))
        best = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        return row[best], start[best], stop[best]

    return _of_runs(rles, keys, "_s bigint, _e bigint", work)


def _alike(row, x0, x1, y0, y1):
    """Slabs that follow each other and stand side by side with the same run as one."""
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (y0[1:] != y0[:-1]) | (y1[1:] != y1[:-1]) | (x0[1:] != x1[:-1])
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(row))[:len(head)] - 1
    return row[head], x0[head], x1[tail], y0[head], y1[head]


def _cut(heights, row, start, stop):
    """Slabs of foreground intervals, in order of their rows."""
    height = heights[row]
    fx, fy, lx, ly = start // height, start % height, (stop - 1) // height, (stop - 1) % height + 1
    many = lx > fx
    wide = lx > fx + 1
    full = np.zeros(int(wide.sum()), np.int64)
    parts = [(row, fx, fx + 1, fy, np.where(many, height, ly)), (row[wide], fx[wide] + 1, lx[wide], full, height[wide]),
             (row[many], lx[many], lx[many] + 1, np.zeros(int(many.sum()), np.int64), ly[many])]
    # Runs come in the order of their columns: neighbours alike are one slab before anything is sorted.
    row, x0, x1, y0, y1 = (np.concatenate(c) for c in zip(*(_alike(*part) for part in parts)))
    order = np.lexsort((x0, y1, y0, row))
    return _alike(*(c[order] for c in (row, x0, x1, y0, y1)))


def cut_counts(table, counts: str, height: str):
    """The slabs of every row's counts as a list; a row without counts has none."""
    import pyarrow as pa
    row, x0, x1, y0, y1 = _cut(np.asarray(table.column(height).fill_null(1), np.int64), *_foreground(table.select([counts]).rename_columns(["counts"])))
    offsets = np.searchsorted(row, np.arange(len(table) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c) for c in (x0, x1, y0, y1)], names=["x0", "x1", "y0", "y1"]))


def rle_to_slabs(rles: DataFrame, *keys: str) -> DataFrame:
    """Foreground of column-major counts as slabs: runs are cut at column borders, and neighbouring columns with
    the same run are one slab, so a box is one row and not one for each of its columns."""
    def work(table, row, start, stop):
        return _cut(np.asarray(table.column("height"), np.int64), row, start, stop)

    return _of_runs(rles, keys, PIECES, work).select(*keys, "x0", "x1", "y0", "y1")


def slabs_to_rle(slabs: DataFrame, *keys: str, overlapping: bool = False) -> DataFrame:
    """Canonical background-first counts per key; needs width and height columns.

    A key is one mask, bounded by the image size. Only its slabs are shuffled, once; the runs of its
    pixel columns are formed after that, for a whole Arrow batch at once. Pass ``overlapping`` when
    slabs of a key may overlap: they are united as their runs are formed.
    """
    group = [*dict.fromkeys([*keys, "width", "height"])]
    if overlapping:
        slabs = slabs.filter("x0 < x1 AND y0 < y1")
    # A fixed count: the rows are small before the expansion below, which AQE cannot foresee.
    parts = int(slabs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    masks = (slabs.repartition(parts, *keys).groupBy(*group)
             .agg(F.collect_list(F.expr("struct(x0, x1, y0, y1)")).cast("array<struct<x0: bigint, x1: bigint, y0: bigint, y1: bigint>>").alias("_slabs"))
             .select(*keys, F.col("width").cast("bigint").alias("_w"), F.col("height").cast("bigint").alias("_h"), "_slabs"))
    return encode_gathered(masks, overlapping)


def encode_gathered(masks: DataFrame, overlapping: bool = False, text: bool = False) -> DataFrame:
    """Rows of gathered masks (``_slabs``, ``_w``, ``_h``) with ``counts`` in place of these columns, without a shuffle;
    a row without a list of slabs has no counts. Whatever joins the rows need comes before: counts are long.
    ``text`` gives them as compressed run text."""
    keys = [c for c in masks.columns if c not in ("_slabs", "_w", "_h")]
    fields = [masks.schema[k] for k in keys]
    return masks.mapInArrow(_encode_batches(keys, overlapping, text), T.StructType([*fields, T.StructField("counts", T.StringType() if text else T.ArrayType(T.LongType()))]))


ENCODE_COLUMNS = 20_000_000


def _slices(table):
    """Cut a batch so that the pixel columns expanded at once stay bounded (a single mask is never cut)."""
    lists = table.column("_slabs").combine_chunks()
    flat = lists.flatten()
    columns = np.asarray(flat.field(1), np.int64) - np.asarray(flat.field(0), np.int64)
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    total = np.concatenate(([0], np.cumsum(columns)))[np.cumsum(sizes)]
    start = 0
    for stop in [*(np.flatnonzero(np.diff(total // ENCODE_COLUMNS)) + 1).tolist(), len(table)]:
        if stop > start:
            yield table.slice(start, stop - start)
        start = stop


def _encode_batches(keys: list[str], overlapping: bool = False, text: bool = False):
    """Counts of many masks at once: expand columns, sort, merge runs that touch (or overlap), difference."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        for table in (piece for batch in batches for piece in _slices(pa.Table.from_batches([batch]))):
            lists = table.column("_slabs").combine_chunks()
            flat = lists.flatten()
            x0, x1, y0, y1 = (np.asarray(flat.field(i), np.int64) for i in range(4))
            height, width = (np.asarray(table.column(c), np.int64) for c in ("_h", "_w"))
            mask = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0), np.int64))
            times = x1 - x0
            slab = np.repeat(np.arange(len(times)), times)
            x = x0[slab] + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            mask = mask[slab]
            start = x * height[mask] + y0[slab]
            stop = start + (y1 - y0)[slab]
            # The columns of a slab are in order already, and often those of all slabs.
            place = (mask << 40) + start
            if (place[1:] < place[:-1]).any():
                order = np.argsort(place, kind="stable")
                mask, start, stop = mask[order], start[order], stop[order]
            if overlapping and len(mask):
                # How far the runs of a mask reach so far; masks are kept apart by an offset beyond any image.
                apart = mask << 40
                stop = np.maximum.accumulate(np.clip(stop, 0, (1 << 40) - 1) + apart) - apart
            # Else the runs of a mask do not overlap, so only neighbours can touch.
            fresh = np.ones(len(mask), bool)
            fresh[1:] = (mask[1:] != mask[:-1]) | (start[1:] > stop[:-1])
            head = np.flatnonzero(fresh)
            mask, start, stop = mask[head], start[head], stop[np.append(head[1:], len(stop)) - 1]
            first = np.ones(len(mask), bool)
            first[1:] = mask[1:] != mask[:-1]
            gap = start.copy()
            gap[1:] -= np.where(first[1:], 0, stop[:-1])
            last = np.append(first[1:], True)
            total = height * width
            tail = total[mask[last]] - stop[last]
            runs = np.bincount(mask, minlength=len(lists))
            sizes = 2 * runs
            sizes[mask[last]] += tail > 0
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            values = np.empty(offsets[-1], np.int64)
            inside = np.arange(len(mask)) - np.repeat(np.cumsum(runs) - runs, runs)
            place = offsets[mask] + 2 * inside
            values[place], values[place + 1] = gap, stop - start
            ends = offsets[mask[last] + 1] - 1
            values[ends[tail > 0]] = tail[tail > 0]
            if text:
                written, ends = shapes.counts_to_text(values, offsets)
                at = np.concatenate([[0], np.cumsum(np.diff(ends))]).astype(np.int32)
                counts = pa.Array.from_buffers(pa.string(), len(lists), [None, pa.py_buffer(at), pa.py_buffer(written)])
                counts = pc.if_else(lists.is_valid(), counts, pa.scalar(None, pa.string()))
            else:
                counts = pa.LargeListArray.from_arrays(offsets, values).cast(pa.list_(pa.int64()))
            if lists.null_count and not text:
                counts = pa.ListArray.from_arrays(counts.offsets, counts.values, mask=lists.is_null())
            yield from table.select(keys).append_column("counts", counts).to_batches()

    return run


def signature_expr(height: str, width: str, counts: str) -> str:
    """Mask identity: SHA-256 of the sorted-key compact JSON of a canonical mask."""
    return (f"""sha2('{{"rle":{{"counts":[' || array_join(transform({counts}, c -> CAST(c AS STRING)), ',') || '],"size":['"""
            f""" || CAST({height} AS STRING) || ',' || CAST({width} AS STRING) || ']}},"type":"mask"}}', 256)""")


def mask_signatures(slabs: DataFrame, *keys: str, out: str = "signature") -> DataFrame:
    """The identity of every mask, from its canonical runs: how its pixels were cut into slabs, or whether
    the slabs overlap, does not matter. ``slabs`` needs width and height columns."""
    runs = slabs_to_rle(slabs, *dict.fromkeys([*keys, "width", "height"]), overlapping=True)
    return runs.selectExpr(*keys, f"{signature_expr('height', 'width', 'counts')} AS {out}")


def box_signature_text(sha: str = "sha2({}, 256)") -> str:
    """The same identity for an integer box x0..y1 in a width x height image, in closed form and plain SQL."""
    open_, shut = "chr(123)", "chr(125)"  # braces would be read as names of tables
    body = f"""{open_} || '"rle":' || {open_} || '"counts":[' || CAST(x0 * height + y0 AS STRING) || ',' ||
        CASE WHEN y1 - y0 = height THEN CAST((x1 - x0) * height AS STRING)
             ELSE CAST(y1 - y0 AS STRING) || repeat(',' || CAST(height - y1 + y0 AS STRING) || ',' || CAST(y1 - y0 AS STRING), CAST(x1 - x0 - 1 AS INT)) END ||
        CASE WHEN width * height - (x1 - 1) * height - y1 > 0 THEN ',' || CAST(width * height - (x1 - 1) * height - y1 AS STRING) ELSE '' END ||
        '],"size":[' || CAST(height AS STRING) || ',' || CAST(width AS STRING) || ']' || {shut} || ',"type":"mask"' || {shut}"""
    return sha.format(body)


def blocks(slabs: DataFrame, size: int = OVERLAP_BLOCK) -> DataFrame:
    """Cut slabs at a block grid. Every piece lies in exactly one block (bx, by)."""
    cut = slabs.selectExpr("*", f"explode(sequence(x0 div {size}, (x1 - 1) div {size})) AS bx") \
        .selectExpr("*", f"explode(sequence(y0 div {size}, (y1 - 1) div {size})) AS by")
    return cut.withColumns({
        "x0": F.expr(f"greatest(x0, bx * {size})"), "x1": F.expr(f"least(x1, (bx + 1) * {size})"),
        "y0": F.expr(f"greatest(y0, by * {size})"), "y1": F.expr(f"least(y1, (by + 1) * {size})")})


def pair_intersections(left: DataFrame, right: DataFrame, left_id: str, right_id: str,
                       on: list[str], where: Column | None = None, size: int = OVERLAP_BLOCK) -> DataFrame:
    """Intersection pixels of every mask pair that shares at least one pixel.

    An equi-join on ``on`` and the block; since pieces never span blocks, partial sums just add.
    ``left`` and ``right`` are slab tables with different id column names.
    """
    a = blocks(left, size).withColumnsRenamed({"x0": "ax0", "x1": "ax1", "y0": "ay0", "y1": "ay1"})
    b = blocks(right, size).withColumnsRenamed({"x0": "cx0", "x1": "cx1", "y0": "cy0", "y1": "cy1"})
    hit = F.expr("ax0 < cx1 AND cx0 < ax1 AND ay0 < cy1 AND cy0 < ay1")
    pairs = a.join(b, [*on, "bx", "by"]).filter(hit if where is None else hit & where)
    return pairs.groupBy(*on, left_id, right_id).agg(F.sum(F.expr(
        "(least(ax1, cx1) - greatest(ax0, cx0)) * (least(ay1, cy1) - greatest(ay0, cy0))")).alias("intersection"))


def self_intersections(slabs: DataFrame, where: Column | None = None, size: int = OVERLAP_BLOCK) -> DataFrame:
    """Unordered overlapping pairs inside each image: ids a_id < b_id and shared pixels."""
    a = slabs.withColumnRenamed("annotation_id", "a_id")
    b = slabs.withColumnRenamed("annotation_id", "b_id")
    ordered = F.col("a_id") < F.col("b_id")
    return pair_intersections(a, b, "a_id", "b_id", ["image_id"], ordered if where is None else ordered & where, size)


def with_overlap(pairs: DataFrame, areas: DataFrame) -> DataFrame:
    """Attach areas and IoU to intersections; ``areas`` is (annotation_id, area)."""
    a = areas.select(F.col("annotation_id").alias("a_id"), F.col("area").alias("area_a"))
    b = areas.select(F.col("annotation_id").alias("b_id"), F.col("area").alias("area_b"))
    return (pairs.join(a, "a_id").join(b, "b_id")
            .withColumn("iou", F.expr("intersection / greatest(1, area_a + area_b - intersection)")))


def loss_expr(before: str, after: str, inter: str) -> dict[str, Column]:
    """Pixel change of a conversion from the two areas and their intersection."""
    return {
        "changed_pixels": F.expr(f"CAST({before} + {after} - 2 * {inter} AS BIGINT)"),
        "added_pixels": F.expr(f"CAST({after} - {inter} AS BIGINT)"),
        "removed_pixels": F.expr(f"CAST({before} - {inter} AS BIGINT)"),
        "iou": F.expr(f"CASE WHEN {before} + {after} = 0 THEN 1.0D "
                      f"ELSE CAST({inter} AS DOUBLE) / ({before} + {after} - {inter}) END"),
        "lossy": F.expr(f"{before} + {after} <> 2 * {inter}"),
    }


def crop(slabs_with_tile: DataFrame) -> DataFrame:
    """Clip slabs to tile_x0..tile_y1 and move them to tile coordinates; empty pieces vanish."""
    return (slabs_with_tile
            .withColumns({"x0": F.expr("greatest(x0, tile_x0) - tile_x0"), "x1": F.expr("least(x1, tile_x1) - tile_x0"),
                          "y0": F.expr("greatest(y0, tile_y0) - tile_y0"), "y1": F.expr("least(y1, tile_y1) - tile_y0")})
            .filter("x0 < x1 AND y0 < y1"))


def map_to_image(slabs_with_tile: DataFrame, pad_left: str = "0", pad_top: str = "0") -> DataFrame:
    """Drop padding and translate tile slabs to image coordinates."""
    return (slabs_with_tile
            .withColumns({"x0": F.expr(f"greatest(x0 - {pad_left}, 0) + tile_x0"),
                          "x1": F.expr(f"least(x1 - {pad_left} + tile_x0, tile_x1)"),
                          "y0": F.expr(f"greatest(y0 - {pad_top}, 0) + tile_y0"),
                          "y1": F.expr(f"least(y1 - {pad_top} + tile_y0, tile_y1)")})
            .filter("x0 < x1 AND y0 < y1"))


def same_masks(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    """Rows present in one multiset but not in the other; empty means an exact round trip."""
    left, right = a.select(*columns), b.select(*columns)
    return (left.exceptAll(right).withColumn("side", F.lit("only_left"))
            .unionByName(right.exceptAll(left).withColumn("side", F.lit("only_right"))))
