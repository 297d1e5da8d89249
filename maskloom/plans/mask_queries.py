"""Mask algebra (MASK-*, WIN-05, WIN-09, WIN-10, VEC-*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masks as M, windows as W
from .registry import query


def slabs(v, *extra):
    return M.boxes_to_slabs(v.annotations, "image_id", "annotation_id", *extra)


SEGMENTS = """
SELECT image_id, annotation_id, width, height, unnest(range(x0, x1)) AS x, y0, y1 FROM {annotations}"""

# Counts of a box mask, as list text, in DuckDB: gaps and runs over the flat intervals.
RLE_LISTS = f"""
SELECT annotation_id, width, height, flatten(list([gap, run] ORDER BY s)) || CASE WHEN max(e) < width * height THEN [width * height - max(e)] ELSE [] END AS counts
FROM (SELECT annotation_id, width, height, s, e, s - coalesce(lag(e) OVER (PARTITION BY annotation_id ORDER BY s), 0) AS gap, e - s AS run
      FROM (SELECT annotation_id, width, height, x * height + y0 AS s, x * height + y1 AS e FROM ({SEGMENTS}) g) f) h
GROUP BY annotation_id, width, height"""


def box_rles(v):
    return M.slabs_to_rle(slabs(v, "width", "height"), "annotation_id").join(
        v.annotations.select("annotation_id", "image_id", "width", "height", "x0", "y0"), "annotation_id")


@query("mask_01", """SELECT annotation_id, x1 - x0 AS columns, CAST((x1 - x0) * (y1 - y0) AS BIGINT) AS area, x0 AS bx0, y0 AS by0, x1 AS bx1, y1 AS by1 FROM {annotations}""")
def mask_01(v):
    """Counts back to per-column runs, measured per mask."""
    rles = M.slabs_to_rle(slabs(v, "width", "height"), "annotation_id", "height")
    back = M.rle_to_slabs(rles, "annotation_id")
    return back.groupBy("annotation_id").agg(
        F.sum(F.expr("x1 - x0")).alias("columns"), F.sum(F.expr("(x1 - x0) * (y1 - y0)")).alias("area"),
        F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"))


@query("mask_02", f"SELECT annotation_id, array_to_string(counts, ',') AS counts FROM ({RLE_LISTS}) r")
def mask_02(v):
    return (M.slabs_to_rle(slabs(v, "width", "height"), "annotation_id")
            .selectExpr("annotation_id", "array_join(transform(counts, c -> CAST(c AS STRING)), ',') AS counts"))


UNION_RUNS = f"""
SELECT image_id, x, min(y0) AS y0, max(y1) AS y1 FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY image_id, x ORDER BY y0, y1, annotation_id) AS island FROM (
    SELECT *, CASE WHEN y0 <= max(y1) OVER (PARTITION BY image_id, x ORDER BY y0, y1, annotation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
    FROM ({SEGMENTS}) s) t) u GROUP BY image_id, x, island"""


@query("mask_03", f"""
SELECT image_id, CAST(sum(y1 - y0) AS BIGINT) AS area, min(x) AS bx0, min(y0) AS by0, max(x) + 1 AS bx1, max(y1) AS by1
FROM ({UNION_RUNS}) r GROUP BY image_id""")
def mask_03(v):
    """Exact union of all masks of an image, measured."""
    return M.mask_stats(M.mask_union(slabs(v), "image_id"), "image_id")


@query("mask_04", """
SELECT annotation_id, CAST((x1 - x0) * (y1 - y0) AS BIGINT) AS area, x0 AS bx0, y0 AS by0, x1 AS bx1, y1 AS by1 FROM {annotations}""")
def mask_04(v):
    return M.mask_stats(slabs(v), "annotation_id")


PAIRS = """
SELECT a.image_id, a.annotation_id AS a_id, b.annotation_id AS b_id, a.area AS area_a, b.area AS area_b,
       CAST((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS BIGINT) AS intersection
FROM {annotations} a JOIN {annotations} b ON a.image_id = b.image_id AND a.annotation_id < b.annotation_id
 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"""


@query("mask_05", f"SELECT *, round(CAST(intersection AS DOUBLE) / greatest(1, area_a + area_b - intersection), 6) AS iou FROM ({PAIRS}) p")
def mask_05(v):
    masks = slabs(v)
    pairs = M.with_overlap(M.self_intersections(masks), M.mask_stats(masks, "annotation_id"))
    return pairs.select("image_id", "a_id", "b_id", "area_a", "area_b", "intersection", F.round("iou", 6).alias("iou"))


EDITED = ("annotation_id", "x0 + s_key % 3 AS x0", "x1 - line % 2 AS x1",
          "y0 - CASE WHEN y0 > 4 THEN p_key % 4 ELSE 0 END AS y0", "y1 - 2 * (p_key % 2) AS y1")
AFTER = f"SELECT {', '.join(EDITED)} FROM {{annotations}}"


@query("mask_06", f"""
SELECT annotation_id, before_area, after_area, CAST(before_area + after_area - 2 * i AS BIGINT) AS changed_pixels, CAST(after_area - i AS BIGINT) AS added_pixels,
       CAST(before_area - i AS BIGINT) AS removed_pixels, before_area + after_area <> 2 * i AS lossy,
       round(CAST(i AS DOUBLE) / (before_area + after_area - i), 6) AS iou
FROM (SELECT a.annotation_id, a.area AS before_area, (b.x1 - b.x0) * (b.y1 - b.y0) AS after_area,
             greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i
      FROM {{annotations}} a JOIN ({AFTER}) b ON a.annotation_id = b.annotation_id) q""")
def mask_06(v):
    """Loss report between a mask and its edited version."""
    before = M.boxes_to_slabs(v.annotations, "annotation_id")
    after = M.boxes_to_slabs(v.annotations.selectExpr(*EDITED), "annotation_id")
    return loss_between(before, after)


def loss_between(before, after):
    inter = M.pair_intersections(before.withColumnRenamed("annotation_id", "a_id").withColumn("k", F.col("a_id")),
                                 after.withColumnRenamed("annotation_id", "b_id").withColumn("k", F.col("b_id")),
                                 "a_id", "b_id", ["k"]).select(F.col("k").alias("annotation_id"), "intersection")
    areas = (M.mask_stats(before, "annotation_id").select("annotation_id", F.col("area").alias("before_area"))
             .join(M.mask_stats(after, "annotation_id").select("annotation_id", F.col("area").alias("after_area")), "annotation_id"))
    rows = areas.join(inter, "annotation_id", "left").withColumn("_i", F.coalesce("intersection", F.lit(0)))
    out = rows.withColumns(M.loss_expr("before_area", "after_area", "_i")).withColumn("iou", F.round("iou", 6))
    return out.drop("_i", "intersection")


@query("mask_09", """
SELECT annotation_id, CAST((x1 - x0) * (y1 - y0) AS BIGINT) AS area, x1 - x0 AS columns FROM {annotations}""")
def mask_09(v):
    """Integer boxes rasterised to per-column runs."""
    cols = M.to_columns(slabs(v))
    return cols.groupBy("annotation_id").agg(F.sum(F.expr("y1 - y0")).alias("area"), F.count("*").alias("columns"))


@query("mask_12", f"""
SELECT annotation_id, sha256('{{{{"rle":{{{{"counts":[' || array_to_string(counts, ',') || '],"size":[' || CAST(height AS VARCHAR) || ',' || CAST(width AS VARCHAR) || ']}}}},"type":"mask"}}}}') AS signature
FROM ({RLE_LISTS}) r""".replace("{{", "{").replace("}}", "}"))
def mask_12(v):
    return M.slabs_to_rle(slabs(v, "width", "height"), "annotation_id", "width", "height").selectExpr(
        "annotation_id", M.signature_expr("height", "width", "counts") + " AS signature")


@query("mask_13", """
SELECT 'only_left' AS side, image_id, class_id, x0, x1, y0, y1 FROM {annotations} WHERE line % 7 = 6
UNION ALL SELECT 'only_right', image_id, class_id, x0 + 1, x1, y0, y1 FROM {annotations} WHERE line % 7 = 6""")
def mask_13(v):
    """Round trip through counts; every seventh line is shifted on purpose and must be reported."""
    ann = v.annotations.select("annotation_id", "image_id", "class_id", "line")
    masks = slabs(v, "width", "height")
    back = M.rle_to_slabs(M.slabs_to_rle(masks, "annotation_id", "height"), "annotation_id")
    stats = M.mask_stats(back, "annotation_id").selectExpr("annotation_id", "bx0 AS x0", "bx1 AS x1", "by0 AS y0", "by1 AS y1")
    right = stats.join(ann, "annotation_id").withColumn("x0", F.expr("x0 + CASE WHEN line % 7 = 6 THEN 1 ELSE 0 END"))
    left = masks.join(ann.select("annotation_id", "class_id"), "annotation_id")
    return M.same_masks(left, right, "image_id", "class_id", "x0", "x1", "y0", "y1")


@query("win_05", f"SELECT image_id, count(*) AS runs, CAST(sum(y1 - y0) AS BIGINT) AS area FROM ({UNION_RUNS}) r GROUP BY image_id")
def win_05(v):
    """Gaps and islands in the per-column form."""
    runs = M.merge_columns(M.to_columns(slabs(v)).drop("annotation_id"), "image_id")
    return runs.groupBy("image_id").agg(F.count("*").alias("runs"), F.sum(F.expr("y1 - y0")).alias("area"))


@query("win_09", """
SELECT annotation_id, CAST(floor(m / height) AS BIGINT) AS x, m % height AS y
FROM (SELECT annotation_id, height, CAST(floor((2 * (x0 * height + y0) + y1 - y0 - 1) / 2) AS BIGINT) AS m FROM {annotations}) q""")
def win_09(v):
    return W.anchor_point(M.slabs_to_rle(slabs(v, "width", "height"), "annotation_id", "height"), "annotation_id")


def _painted_sql(policy):
    """Visible pixels per object without expanding pixels: strips between all y breakpoints of a column."""
    pick = {"first": "min", "last": "max"}[policy]
    return f"""
SELECT image_id, winner AS annotation_id, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS visible_area, CAST(sum(CASE WHEN covering > 1 THEN (x1 - x0) * (y1 - y0) ELSE 0 END) AS BIGINT) AS contested
FROM (SELECT c.image_id, c.x0, c.x1, c.y0, c.y1, {pick}(a.annotation_id) AS winner, count(*) AS covering
      FROM (SELECT xs.image_id, xs.p AS x0, xs.q AS x1, ys.p AS y0, ys.q AS y1
            FROM (SELECT image_id, p, lead(p) OVER (PARTITION BY image_id ORDER BY p) AS q FROM (SELECT image_id, x0 AS p FROM {{annotations}} UNION SELECT image_id, x1 FROM {{annotations}}) u) xs
            JOIN (SELECT image_id, p, lead(p) OVER (PARTITION BY image_id ORDER BY p) AS q FROM (SELECT image_id, y0 AS p FROM {{annotations}} UNION SELECT image_id, y1 FROM {{annotations}}) u) ys
              ON xs.image_id = ys.image_id WHERE xs.q IS NOT NULL AND ys.q IS NOT NULL) c
      JOIN {{annotations}} a ON a.image_id = c.image_id AND a.x0 <= c.x0 AND a.x1 >= c.x1 AND a.y0 <= c.y0 AND a.y1 >= c.y1
      GROUP BY ALL) w GROUP BY image_id, winner"""


def paint_slabs(v):
    return slabs(v).withColumn("ord", F.col("annotation_id")).withColumn("obj", F.struct("annotation_id"))


def painted_areas(painted):
    size = "(x1 - x0) * (y1 - y0)"
    return painted.groupBy("image_id", F.col("obj.annotation_id").alias("annotation_id")).agg(
        F.sum(F.expr(size)).alias("visible_area"),
        F.sum(F.expr(f"CASE WHEN covering > 1 THEN {size} ELSE 0 END")).alias("contested"))


@query("win_10", _painted_sql("first"))
def win_10(v):
    """Painter sweep with the first object on top."""
    return painted_areas(W.paint(paint_slabs(v), "first"))


@query("win_10_last", _painted_sql("last"))
def win_10_last(v):
    """Painter sweep with the last object on top."""
    return painted_areas(W.paint(paint_slabs(v), "last"))


# ---- masks that are no boxes ------------------------------------------------------------------

SHAPE_SEGMENTS = "SELECT image_id, annotation_id, width, height, unnest(range(x0, x1)) AS x, y0, y1 FROM {shapes}"
SHAPE_RLE = RLE_LISTS.replace(SEGMENTS, SHAPE_SEGMENTS)


@query("mask_02_shapes", f"SELECT annotation_id, array_to_string(counts, ',') AS counts FROM ({SHAPE_RLE}) r")
def mask_02_shapes(v):
    return M.slabs_to_rle(v.shapes, "annotation_id").selectExpr("annotation_id", "array_join(transform(counts, c -> CAST(c AS STRING)), ',') AS counts")


@query("mask_01_shapes", f"SELECT image_id, annotation_id, x, y0, y1 FROM ({SHAPE_SEGMENTS}) s")
def mask_01_shapes(v):
    """Counts back to runs: every pixel column of every shape."""
    back = M.rle_to_slabs(M.slabs_to_rle(v.shapes, "image_id", "annotation_id", "height"), "image_id", "annotation_id")
    return M.to_columns(back).select("image_id", "annotation_id", "x", "y0", "y1")


@query("mask_03_shapes", f"""
SELECT image_id, CAST(sum(y1 - y0) AS BIGINT) AS area, min(x) AS bx0, min(y0) AS by0, max(x) + 1 AS bx1, max(y1) AS by1
FROM ({UNION_RUNS.replace(SEGMENTS, SHAPE_SEGMENTS)}) r GROUP BY image_id""")
def mask_03_shapes(v):
    return M.mask_stats(M.mask_union(v.shapes, "image_id"), "image_id")


@query("mask_04_shapes", f"""
SELECT annotation_id, CAST(sum(y1 - y0) AS BIGINT) AS area, min(x) AS bx0, min(y0) AS by0, max(x) + 1 AS bx1, max(y1) AS by1 FROM ({SHAPE_SEGMENTS}) s GROUP BY annotation_id""")
def mask_04_shapes(v):
    return M.mask_stats(v.shapes, "annotation_id")


@query("mask_05_shapes", f"""
SELECT image_id, a.annotation_id AS a_id, b.annotation_id AS b_id, CAST(sum(least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS BIGINT) AS intersection
FROM ({SHAPE_SEGMENTS}) a JOIN ({SHAPE_SEGMENTS}) b USING (image_id, x) WHERE a.annotation_id < b.annotation_id AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY 1, 2, 3""")
def mask_05_shapes(v):
    return M.self_intersections(v.shapes.select("image_id", "annotation_id", "x0", "x1", "y0", "y1"))


def _union_area(test: str) -> str:
    runs = UNION_RUNS.replace(SEGMENTS, SHAPE_SEGMENTS + f" WHERE {test}")
    return f"SELECT image_id, sum(y1 - y0) AS area FROM ({runs}) r GROUP BY image_id"


ODD = "length(annotation_id) % 2 = 1"


@query("set_06_pixels", f"""
SELECT u.image_id, CAST(u.area AS BIGINT) AS px_or, CAST(coalesce(a.area, 0) + coalesce(b.area, 0) - u.area AS BIGINT) AS px_and,
       CAST(2 * u.area - coalesce(a.area, 0) - coalesce(b.area, 0) AS BIGINT) AS px_xor, CAST(u.area - coalesce(b.area, 0) AS BIGINT) AS px_minus
FROM ({_union_area('true')}) u LEFT JOIN ({_union_area(ODD)}) a ON a.image_id = u.image_id LEFT JOIN ({_union_area('NOT ' + ODD)}) b ON b.image_id = u.image_id""")
def set_06_pixels(v):
    """Masks of two halves of an image's shapes combined pixel by pixel in all four ways."""
    left, right = v.shapes.filter(ODD), v.shapes.filter(f"NOT {ODD}")
    out = v.shapes.select("image_id").distinct()
    for how in M.COMBINE:
        area = M.mask_combine(left, right, how, "image_id").groupBy("image_id").agg(F.sum(F.expr("(x1 - x0) * (y1 - y0)")).alias(f"px_{how}"))
        out = out.join(area, "image_id", "left")
    return out.na.fill(0)


@query("mask_12_shapes", f"""
SELECT annotation_id, sha256(concat(chr(123), '"rle":', chr(123), '"counts":[', array_to_string(counts, ','), '],"size":[', height, ',', width, ']', chr(125), ',"type":"mask"', chr(125))) AS signature
FROM ({SHAPE_RLE}) r""")
def mask_12_shapes(v):
    return M.mask_signatures(v.shapes, "annotation_id")
