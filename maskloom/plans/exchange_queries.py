"""Vectors, format rows, readers, snapshots, predictor and streams (VEC-*, SRC-*, SNK-*, UDF-01, STR-*)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import polygons
from ..operators import curation as CU, masks as M, nms as N, predicates as P, predict as PR, tiling as TL, training as TR, vectors as V, windows as W
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sinks import formats as O, publish as PB, snapshots as SN
from ..sources import formats as I, images as IM
from ..streaming import jobs as ST
from .mask_queries import _painted_sql, slabs
from .registry import query
from .review_queries import DISPOSITION, TRAINING_ROWS, exported_sql, export_images_sql, round_members
from .tiling_queries import HITS, TRAINING_SQL

# ---- polygons and topology --------------------------------------------------------------------

POLYGONS = """
SELECT annotation_id, image_id, class_id, width, height, x0, y0, x1, y1, p_key, CASE p_key % 5
  WHEN 0 THEN {rect} WHEN 1 THEN {bow} WHEN 2 THEN {line} WHEN 3 THEN {penta} ELSE {two} END AS points FROM {{annotations}}"""
CORNERS = {"rect": "x0 y0 x1 y0 x1 y1 x0 y1", "bow": "x0 y0 x1 y1 x1 y0 x0 y1+7", "line": "x0 y0 x1 y1 2*x1-x0 2*y1-y0",
           "penta": "x0 y0 x1 y0+0.5 x1+8.25 (y0+y1)/2.0 x1 y1 x0+0.5 y1", "two": "x0 y0 x1 y1"}


def _points(make, wrap):
    def one(text):
        v = text.split()
        return wrap(", ".join(make(v[i], v[i + 1]) for i in range(0, len(v), 2)))
    return POLYGONS.format(**{k: one(t) for k, t in CORNERS.items()})


SPARK_POLYGONS = _points(lambda x, y: f"struct(CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y)", lambda s: f"array({s})")
DUCK_POLYGONS = _points(lambda x, y: f"struct_pack(x := CAST({x} AS DOUBLE), y := CAST({y} AS DOUBLE))", lambda s: f"[{s}]")

NEXT = "p[CASE WHEN i = len(p) THEN 1 ELSE i + 1 END]"
DUCK_EDGES = f"list_transform(range(1, len(p) + 1), lambda i: struct_pack(i := i, ax := p[i].x, ay := p[i].y, bx := {NEXT}.x, by := {NEXT}.y))"


@query("vec_05", f"""
WITH q AS (SELECT annotation_id, points AS p FROM ({DUCK_POLYGONS}) z), e AS (SELECT annotation_id, len(p) AS n, unnest({DUCK_EDGES}) AS g FROM q),
a AS (SELECT annotation_id, sum(g.ax * g.by - g.bx * g.ay) AS area FROM e GROUP BY 1), x AS (SELECT annotation_id, n, g.i AS i, g.ax AS ax, g.ay AS ay, g.bx AS bx, g.by AS by FROM e),
c AS (SELECT DISTINCT f.annotation_id FROM x f JOIN x g ON f.annotation_id = g.annotation_id AND g.i >= f.i + 2 AND NOT (f.i = 1 AND g.i = f.n) WHERE
   ((f.bx - f.ax) * (g.ay - f.ay) - (f.by - f.ay) * (g.ax - f.ax)) * ((f.bx - f.ax) * (g.by - f.ay) - (f.by - f.ay) * (g.bx - f.ax)) < 0
   AND ((g.bx - g.ax) * (f.ay - g.ay) - (g.by - g.ay) * (f.ax - g.ax)) * ((g.bx - g.ax) * (f.by - g.ay) - (g.by - g.ay) * (f.bx - g.ax)) < 0)
SELECT q.annotation_id, round(abs(a.area), 6) AS doubled_area, CASE WHEN len(q.p) < 3 THEN 'too_few_vertices' WHEN abs(a.area) < 0.01 THEN 'no_area' WHEN c.annotation_id IS NOT NULL THEN 'edges_cross' END AS issue
FROM q JOIN a ON a.annotation_id = q.annotation_id LEFT JOIN c ON c.annotation_id = q.annotation_id""")
def vec_05(v):
    rows = v.sql(SPARK_POLYGONS)
    return rows.selectExpr("annotation_id", f"round(abs({polygons.doubled_area('points')}), 6) AS doubled_area", f"{polygons.issue('points')} AS issue")


TYPED = "CASE p_key % 3 WHEN 0 THEN 'box' WHEN 1 THEN 'polygon' ELSE 'mask' END AS geom_type"


@query("vec_01", f"""
SELECT annotation_id, {TYPED}, CAST(CASE WHEN p_key % 3 = 1 THEN list_min(list_transform(points, lambda p: p.x)) ELSE x0 END AS DOUBLE) AS x0,
  CAST(CASE WHEN p_key % 3 = 1 THEN list_min(list_transform(points, lambda p: p.y)) ELSE y0 END AS DOUBLE) AS y0,
  CAST(CASE WHEN p_key % 3 = 1 THEN list_max(list_transform(points, lambda p: p.x)) ELSE x1 END AS DOUBLE) AS x1,
  CAST(CASE WHEN p_key % 3 = 1 THEN list_max(list_transform(points, lambda p: p.y)) ELSE y1 END AS DOUBLE) AS y1 FROM ({DUCK_POLYGONS}) q""")
def vec_01(v):
    rows = v.sql(SPARK_POLYGONS).withColumn("geom_type", F.expr(TYPED.replace(" AS geom_type", "")))
    return V.geometry_bounds(rows, slabs(v))


# Every third mask is a frame with a 7 x 7 hole; every fourth supplier adds a detached 4 x 5 block.
SHAPES = """
SELECT image_id, annotation_id, width, height, geom_type, x0, x1, y0, y1, p_key % 3 = 0 AS has_hole, s_key % 4 = 0 AND x1 + 9 <= width AS has_block FROM {annotations}"""
_FRAME = """inline(filter(array(
   CASE WHEN NOT has_hole THEN struct(x0 AS x0, x1 AS x1, y0 AS y0, y1 AS y1) END,
   CASE WHEN has_hole THEN struct(x0 AS x0, x0 + 10 AS x1, y0 AS y0, y1 AS y1) END,
   CASE WHEN has_hole THEN struct(x0 + 10 AS x0, x0 + 17 AS x1, y0 AS y0, y0 + 10 AS y1) END,
   CASE WHEN has_hole THEN struct(x0 + 10 AS x0, x0 + 17 AS x1, y0 + 17 AS y0, y1 AS y1) END,
   CASE WHEN has_hole THEN struct(x0 + 17 AS x0, x1 AS x1, y0 AS y0, y1 AS y1) END,
   CASE WHEN has_block THEN struct(x1 + 5 AS x0, x1 + 9 AS x1, y0 AS y0, y0 + 5 AS y1) END), s -> s IS NOT NULL))"""


def shaped_slabs(v):
    return v.sql(SHAPES).selectExpr("image_id", "annotation_id", "width", "height", _FRAME)


COMPONENTS = "CAST(1 + CAST(has_block AS INT) AS BIGINT) AS components, CAST(CAST(has_hole AS INT) AS BIGINT) AS holes"


@query("vec_02", f"SELECT annotation_id, {COMPONENTS} FROM ({SHAPES}) s")
def vec_02(v):
    return V.topology(shaped_slabs(v), "annotation_id")


@query("vec_03", f"""
SELECT annotation_id, CASE WHEN geom_type = 'box' THEN 'box_only' WHEN has_block THEN 'needs_convex_hull' WHEN has_hole THEN 'needs_fill_holes' ELSE 'exact' END AS gate FROM ({SHAPES}) s""")
def vec_03(v):
    """Which masks a YOLO polygon can hold without consent."""
    shape = V.topology(shaped_slabs(v), "annotation_id").join(v.annotations.select("annotation_id", "geom_type"), "annotation_id")
    return V.polygon_gate(shape).select("annotation_id", "gate")


@query("vec_03_lossless", f"""
SELECT annotation_id, CASE WHEN has_block OR has_hole THEN 'topology_needs_consent' END AS error, CASE WHEN NOT has_block AND NOT has_hole THEN 4 END AS vertices,
       CASE WHEN NOT has_block AND NOT has_hole THEN 0 END AS changed_pixels FROM ({SHAPES}) s""")
def vec_03_lossless(v):
    """Strict conversion: the pixel-edge ring must come back as exactly the same pixels."""
    out = V.to_polygon(shaped_slabs(v), "annotation_id")
    return out.selectExpr("annotation_id", "error", "CAST(size(points) AS INT) AS vertices", "CAST(changed_pixels AS INT) AS changed_pixels")


@query("vec_03_lossy", f"""
SELECT annotation_id, 'fill_holes' AS method, CAST(49 AS BIGINT) AS added_pixels, CAST(0 AS BIGINT) AS removed_pixels FROM ({SHAPES}) s WHERE has_hole AND NOT has_block""")
def vec_03_lossy(v):
    """With consent, holes are filled: exactly the hole is added."""
    out = V.to_polygon(shaped_slabs(v), "annotation_id", allow_lossy=True)
    return out.filter("method = 'fill_holes'").select("annotation_id", "method", "added_pixels", "removed_pixels")


@query("vec_03_hull")
def vec_03_hull(v):
    """With consent, several components become the hull of all of them."""
    out = V.to_polygon(shaped_slabs(v), "annotation_id", allow_lossy=True)
    return out.filter("components > 1").selectExpr("annotation_id", "method", "components", "holes", "added_pixels", "removed_pixels", "round(iou, 6) AS iou")


@query("vec_04", f"""
SELECT annotation_id, area, box_area, CAST(box_area - area AS BIGINT) AS added_pixels, true AS lossy FROM (
  SELECT annotation_id, (x1 - x0) * (y1 - y0) - CASE WHEN has_hole THEN 49 ELSE 0 END + CASE WHEN has_block THEN 20 ELSE 0 END AS area,
         (x1 + CASE WHEN has_block THEN 9 ELSE 0 END - x0) * (y1 - y0) AS box_area FROM ({SHAPES}) s) q""")
def vec_04(v):
    return V.to_box(shaped_slabs(v), "annotation_id").select("annotation_id", "area", "box_area", "added_pixels", "lossy")


@query("mask_09_polygons", "SELECT annotation_id, CAST((x1 - x0) * (y1 - y0) AS BIGINT) AS area FROM {annotations}")
def mask_09_polygons(v):
    """The rectangle of every annotation through the general polygon raster."""
    corners = ", ".join(f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))" for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))
    made = V.rasterize(v.annotations.withColumn("points", F.expr(f"array({corners})")), "annotation_id")
    return M.mask_stats(made, "annotation_id").select("annotation_id", "area")


@query("mask_09_every_polygon")
def mask_09_every_polygon(v):
    """All polygons of the view, fractional and crossing ones too; an empty raster has area 0."""
    rows = v.sql(SPARK_POLYGONS)
    area = M.mask_stats(V.rasterize(rows, "annotation_id"), "annotation_id").select("annotation_id", "area")
    return rows.select("annotation_id").join(area, "annotation_id", "left").select("annotation_id", F.coalesce("area", F.lit(0).cast("long")).alias("area"))


# ---- sources ----------------------------------------------------------------------------------


def _hex(value, n, little=False):
    big = f"lpad(hex(CAST({value} AS BIGINT)), {2 * n}, '0')"
    return f"concat({', '.join(f'substring({big}, {2 * i + 1}, 2)' for i in reversed(range(n)))})" if little else big


TURN = "CAST(1 + image_id % 8 AS INT)"
_DIRECTORY = f"'0112', '0003', '00000001', {_hex(TURN, 2)}, '000000000000'"
# Headers of files with the sizes of the images, one kind after another; every sixth is no picture.
HEADERS = f"""SELECT image_id, concat('/in/', image_id, CASE WHEN image_id % 6 < 5 OR image_id % 4 = 1 THEN '.png' ELSE '.txt' END) AS path, unhex(CASE image_id % 6
  WHEN 0 THEN concat('89504E470D0A1A0A0000000D49484452', {_hex('width', 4)}, {_hex('height', 4)}, CASE WHEN image_id % 4 = 2 THEN '10' ELSE '08' END, '0200000000000000', '0000000049454E44AE426082')
  WHEN 1 THEN concat('FFD8FFE1002245786966', '0000', '4D4D002A000000080001', {_DIRECTORY}, 'FFC0001108', {_hex('height', 2)}, {_hex('width', 2)}, repeat('03', 10), 'FFDA0002',
    CASE WHEN image_id % 5 = 0 THEN '00' ELSE 'FFD9' END)
  WHEN 2 THEN concat('424D', repeat('00', 8), '3600000028000000', {_hex('width', 4, True)}, {_hex('CASE WHEN image_id % 4 = 2 THEN 4294967296 - height ELSE height END', 4, True)}, repeat('00', 40))
  WHEN 3 THEN concat('524946461600000057454250565038580A000000', CASE WHEN image_id % 4 = 3 THEN '02' ELSE '00' END, '000000', {_hex('width - 1', 3, True)}, {_hex('height - 1', 3, True)})
  WHEN 4 THEN concat('49492A00080000000300', '0001040001000000', {_hex('width', 4, True)}, '0101040001000000', {_hex('height', 4, True)}, '1201030001000000', {_hex(TURN, 2, True)}, '0000', '00000000')
  ELSE hex('no picture') END) AS content FROM {{images}}"""


@query("src_01", """
SELECT image_id, CASE image_id % 6 WHEN 0 THEN 'PNG' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'BMP' WHEN 3 THEN 'WEBP' WHEN 4 THEN 'TIFF' END AS source_format,
  CAST(CASE WHEN image_id % 6 = 5 THEN NULL WHEN image_id % 6 IN (1, 4) AND image_id % 8 >= 4 THEN height ELSE width END AS INTEGER) AS width,
  CAST(CASE WHEN image_id % 6 = 5 THEN NULL WHEN image_id % 6 IN (1, 4) AND image_id % 8 >= 4 THEN width ELSE height END AS INTEGER) AS height,
  CAST(CASE WHEN image_id % 6 IN (1, 4) THEN 1 + image_id % 8 ELSE 1 END AS INTEGER) AS orientation,
  CASE WHEN image_id % 6 = 0 AND image_id % 4 = 2 THEN 'high_bit_depth' WHEN image_id % 6 = 1 AND image_id % 5 = 0 THEN 'undecodable' WHEN image_id % 6 = 3 AND image_id % 4 = 3 THEN 'several_pictures'
    WHEN image_id % 6 = 5 AND image_id % 4 = 1 THEN 'undecodable' WHEN image_id % 6 = 5 THEN 'unsupported_format' END AS reason FROM {images}""")
def src_01(v):
    files = v.sql(HEADERS).selectExpr("path", "CAST(length(content) AS BIGINT) AS length", "content")
    return IM.judge_files(files).selectExpr("CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) AS image_id", "source_format", "width", "height", "orientation", "reason")


KNOWN_FILES = "SELECT sha256, doc_id % 2 = 0 AS removed FROM {files} WHERE doc_id % 5 = 0"


@query("src_02", f"""
SELECT path, NOT (k.sha256 IS NULL AND path = first) AS duplicate FROM (SELECT *, min(path) OVER (PARTITION BY sha256) AS first FROM {{files}}) f
LEFT JOIN (SELECT DISTINCT sha256 FROM ({KNOWN_FILES}) z WHERE NOT removed) k ON k.sha256 = f.sha256""")
def src_02(v):
    new, old = IM.dedup_by_hash(v.files.select("path", "sha256"), v.sql(KNOWN_FILES))
    return (new.select("path", F.lit(False).alias("duplicate"))
            .unionByName(old.select("path", F.lit(True).alias("duplicate"))))


def exported(v, mode="labeled"):
    return P.exported(*P.export_disposition(v.images, v.annotations, v.classes, mode))


IMPORTED = f"SELECT annotation_id, image_id, class_id, geom_type, x0, y0, x1, y1, area FROM ({exported_sql('labeled')}) o"


@query("src_03", f"""
SELECT image_id, class_id, geom_type, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CASE WHEN geom_type = 'mask' THEN area END AS pixels
FROM ({IMPORTED}) o""")
def src_03(v):
    """COCO records made from the tables, parsed back: compressed runs for masks, bbox for boxes."""
    images, rows = exported(v)
    categories, pictures, records = O.coco_rows(images, rows, v.classes, slabs(v), text=True)
    records = records.withColumn("segmentation", F.when(F.col("geom_type") == "box", F.lit("[]")).otherwise(
        F.to_json(F.struct("size", "counts"))))
    # Made durable once, as the files would be: the parser reads its input several times.
    got = I.parse_coco(categories, pictures, cut_lineage(records).select("id", "image_id", "category_id", "iscrowd", "area", "bbox", "segmentation"), images, v.classes)
    pixels = M.mask_stats(got.slabs, "annotation_id").selectExpr("annotation_id", "area AS pixels")
    return got.annotations.join(pixels, "annotation_id", "left").select("image_id", "class_id", "geom_type", "x0", "y0", "x1", "y1", "pixels")


LABEL_CLASS = "(SELECT class_id, row_number() OVER (ORDER BY ord, class_id) - 1 AS k FROM {classes} WHERE NOT archived)"


def label_names(v):
    return W.class_index(v.classes, 0).selectExpr("class_index", "name", "class_id AS stable_id")


@query("src_04", f"""
SELECT image_id, class_id, CAST(x0 AS BIGINT) AS x0, CAST(y1 AS BIGINT) AS y1, area AS pixels FROM ({IMPORTED}) o WHERE geom_type = 'mask'""")
def src_04(v):
    """YOLO polygon lines made from the tables, parsed back to polygons and pixels."""
    images, rows = exported(v)
    lines, _ = O.yolo_seg_rows(images, rows, v.classes, slabs(v))
    text = lines.selectExpr("concat(image_id, '.txt') AS _file", "annotation_id AS _line",
                            "concat_ws(' ', class_index, array_join(transform(coords, c -> CAST(c AS STRING)), ' ')) AS value")
    got = I.parse_yolo(cut_lineage(text), images, v.classes, label_names(v))
    pixels = M.mask_stats(got.slabs, "annotation_id").selectExpr("annotation_id", "area AS pixels")
    return got.annotations.join(pixels, "annotation_id").selectExpr(
        "image_id", "class_id", "CAST(round(x0) AS BIGINT) AS x0", "CAST(round(y1) AS BIGINT) AS y1", "pixels")


@query("src_05", f"""
SELECT image_id, class_id, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM ({IMPORTED}) o""")
def src_05(v):
    """YOLO box lines made from the tables, parsed back to pixel boxes."""
    images, rows = exported(v)
    text = O.yolo_box_rows(images, rows, v.classes).selectExpr(
        "concat(image_id, '.txt') AS _file", "annotation_id AS _line", "concat_ws(' ', class_index, cx, cy, w, h) AS value")
    got = I.parse_yolo(cut_lineage(text), images, v.classes, label_names(v), kind="box")
    return got.annotations.selectExpr("image_id", "class_id", *[f"round({c}, 6) AS {c}" for c in ("x0", "y0", "x1", "y1")])


@query("src_07", f"""
SELECT image_id, class_id, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM ({IMPORTED}) o""")
def src_07(v):
    """VOC documents, one per image, parsed back to zero-based boxes."""
    images, rows = exported(v)
    objects = O.voc_rows(rows, v.classes).groupBy("image_id").agg(F.collect_list(F.expr(
        """struct(class_name AS name, '0' AS truncated, '1' AS difficult, struct(CAST(xmin AS STRING) AS xmin, CAST(ymin AS STRING) AS ymin,
             CAST(xmax AS STRING) AS xmax, CAST(ymax AS STRING) AS ymax) AS bndbox)""")).alias("object"))
    docs = objects.join(images.select("image_id", "width", "height"), "image_id").selectExpr(
        "CAST(image_id AS STRING) AS _file", "concat(image_id, '.png') AS filename", "struct(width, height) AS size", "object")
    return I.parse_voc(cut_lineage(docs), images, v.classes).annotations.select("image_id", "class_id", "x0", "y0", "x1", "y1")


@query("src_08", f"""
SELECT a.image_id, a.class_id, CASE WHEN g.n > 1 THEN 'mask' ELSE 'box' END AS geom_type, g.n AS shapes FROM (
  SELECT image_id, class_id, line % 2 AS grp, count(*) AS n FROM ({exported_sql('labeled')}) o GROUP BY 1, 2, 3) g JOIN (SELECT DISTINCT image_id, class_id, line % 2 AS grp FROM ({exported_sql('labeled')}) o) a
ON a.image_id = g.image_id AND a.class_id = g.class_id AND a.grp = g.grp""")
def src_08(v):
    """LabelMe rectangles grouped by class and group id: groups of several shapes unite to one mask."""
    images, rows = exported(v)
    shapes = (rows.join(v.classes.selectExpr("class_id", "name AS _label"), "class_id").join(images.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "image_id")
              .selectExpr("concat('doc-', image_id) AS _file", "concat(image_id, '.png') AS imagePath", "CAST(_w AS INT) AS imageWidth", "CAST(_h AS INT) AS imageHeight", "annotation_id AS _i",
                          """struct(_label AS label, 'rectangle' AS shape_type, parse_json(CAST(line % 2 AS STRING)) AS group_id, CAST(map() AS map<string, string>) AS flags,
                             array(array(CAST(x0 AS DOUBLE), CAST(y0 AS DOUBLE)), array(CAST(x1 AS DOUBLE), CAST(y1 AS DOUBLE))) AS points) AS s"""))
    got = I.parse_labelme(shapes, images, v.classes).annotations
    counts = rows.groupBy("image_id", "class_id", F.expr("line % 2").alias("grp")).agg(F.count("*").alias("shapes"), F.min("annotation_id").alias("a"))
    typed = got.groupBy("image_id", "class_id", "geom_type").agg(F.count("*").alias("n"))
    wanted = counts.withColumn("geom_type", F.expr("CASE WHEN shapes > 1 THEN 'mask' ELSE 'box' END"))
    return wanted.join(typed, ["image_id", "class_id", "geom_type"]).select("image_id", "class_id", "geom_type", "shapes")


@query("src_09", _painted_sql("last").replace(", CAST(sum(CASE WHEN covering > 1 THEN (x1 - x0) * (y1 - y0) ELSE 0 END) AS BIGINT) AS contested", ""))
def src_09(v):
    """Painted planes as pixel columns, read back to per-object pixels."""
    from .mask_queries import paint_slabs
    values = W.rank_within(v.annotations.select("image_id", "annotation_id"), ["image_id"], ["annotation_id"], "value")
    painted = W.paint(paint_slabs(v), "last").selectExpr("image_id", "x0", "x1", "y0", "y1", "obj.annotation_id AS annotation_id").join(
        values.select("annotation_id", F.col("value").cast("int").alias("value")), "annotation_id")
    runs = painted.groupBy("image_id", "x0", "x1").agg(F.sort_array(F.collect_list(F.struct("y0", "y1", "value"))).alias("r"))
    # Equal columns of a strip share one row; a pixel column is an array of at most the image height.
    columns = runs.selectExpr("image_id", "x0 AS x", "x1 - x0 AS span", """flatten(transform(r, (q, i) -> concat(
        array_repeat(0, CAST(q.y0 - CASE WHEN i = 0 THEN 0L ELSE r[i - 1].y1 END AS INT)), array_repeat(q.value, CAST(q.y1 - q.y0 AS INT))))) AS values""")
    got, _, _ = I.read_planes(columns, values.selectExpr("image_id", "CAST(value AS INT) AS value", "'c' AS class_id", "annotation_id"))
    return M.mask_stats(got, "image_id", "annotation_id").selectExpr("image_id", "annotation_id", "area AS visible_area")


@query("src_11", "SELECT image_id, action, count(*) AS n, min(seq) AS first_seq FROM {edit_log} GROUP BY 1, 2")
def src_11(v):
    return v.edit_log.groupBy("image_id", "action").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


# ---- sinks ------------------------------------------------------------------------------------

@query("snk_01", f"""
SELECT row_number() OVER (ORDER BY o.image_id, o.annotation_id) AS id, i.k AS image_id, c.k + 1 AS category_id, o.annotation_id AS source_id, CAST(o.area AS DOUBLE) AS area,
       CAST(o.x0 AS DOUBLE) AS bx, CAST(o.y0 AS DOUBLE) AS by, CAST(o.x1 - o.x0 AS DOUBLE) AS bw, CAST(o.y1 - o.y0 AS DOUBLE) AS bh, CASE WHEN o.geom_type = 'mask' THEN 2 * (o.x1 - o.x0) + 1 END AS runs
FROM ({exported_sql('labeled')}) o JOIN (SELECT image_id, row_number() OVER (ORDER BY image_id) AS k FROM ({export_images_sql('labeled')}) q WHERE reason IS NULL) i ON i.image_id = o.image_id
JOIN {LABEL_CLASS} c ON c.class_id = o.class_id""")
def snk_01(v):
    images, rows = exported(v)
    _, _, out = O.coco_rows(images, rows, v.classes, slabs(v))
    return out.selectExpr("id", "image_id", "category_id", "source_id", "area", "bbox[0] AS bx", "bbox[1] AS by", "bbox[2] AS bw", "bbox[3] AS bh",
                          "CAST(CASE WHEN geom_type = 'mask' THEN size(counts) END AS BIGINT) AS runs")


@query("snk_02", f"""
SELECT o.image_id, CASE WHEN i.role = 'validation' THEN 'val' WHEN i.role = 'test' THEN 'test' ELSE 'train' END AS split, count(*) AS lines, CAST(sum(c.k) AS BIGINT) AS class_sum,
       round(sum(2 * (o.x0 + o.x1) / CAST(o.width AS DOUBLE) + 2 * (o.y0 + o.y1) / CAST(o.height AS DOUBLE)), 6) AS coord_sum
FROM ({exported_sql('labeled')}) o JOIN {{images}} i ON i.image_id = o.image_id JOIN {LABEL_CLASS} c ON c.class_id = o.class_id WHERE o.geom_type = 'mask' GROUP BY 1, 2""")
def snk_02(v):
    images, rows = exported(v)
    good, _ = O.yolo_seg_rows(images, rows, v.classes, slabs(v))
    return good.groupBy("image_id", "split").agg(F.count("*").alias("lines"), F.sum("class_index").alias("class_sum"),
                                                 F.round(F.sum(F.expr("aggregate(coords, 0.0D, (s, c) -> s + c)")), 6).alias("coord_sum"))


@query("snk_03", f"""
SELECT o.annotation_id, c.k AS class_index, round((o.x0 + o.x1) / (2.0 * o.width), 9) AS cx, round((o.y1 - o.y0) / CAST(o.height AS DOUBLE), 9) AS h, o.geom_type <> 'box' AS lossy
FROM ({exported_sql('labeled')}) o JOIN {LABEL_CLASS} c ON c.class_id = o.class_id""")
def snk_03(v):
    images, rows = exported(v)
    return O.yolo_box_rows(images, rows, v.classes).select("annotation_id", "class_index", F.round("cx", 9).alias("cx"), F.round("h", 9).alias("h"), "lossy")


@query("snk_04", f"""
SELECT annotation_id, class_id AS class_name, CAST(floor(x0 + 0.25 * (s_key % 2)) AS BIGINT) + 1 AS xmin, y0 + 1 AS ymin, CAST(ceil(x1 - 0.5 * (s_key % 3)) AS BIGINT) AS xmax, y1 AS ymax,
       geom_type <> 'box' OR s_key % 2 <> 0 OR s_key % 3 = 1 AS lossy FROM ({exported_sql('labeled')}) o""")
def snk_04(v):
    _, rows = exported(v)
    moved = rows.withColumns({"x0": F.expr("x0 + 0.25 * (s_key % 2)"), "x1": F.expr("x1 - 0.5 * (s_key % 3)")})
    return O.voc_rows(moved, v.classes).drop("image_id")


@query("snk_05")
def snk_05(v):
    """LabelMe shapes with fresh group ids for masks of several components."""
    images, rows = exported(v)
    used = rows.withColumn("group_id", F.expr("CASE WHEN line = 1 THEN 3L END"))
    shapes, _ = O.labelme_shapes(images, used, v.classes, shaped_slabs(v).drop("width", "height"), allow_lossy=True)
    return shapes.selectExpr("image_id", "annotation_id", "label", "group_id", "shape_type", "part", "CAST(size(points) AS BIGINT) AS vertices")


def plane_sql(policy):
    pick = {"first": "min", "last": "max"}[policy]
    return f"""
SELECT image_id, value, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS pixels FROM (
  SELECT c.image_id, c.x0, c.x1, c.y0, c.y1, arg_{pick}(k.k + 1, o.annotation_id) AS value
  FROM (SELECT xs.image_id, xs.p AS x0, xs.q AS x1, ys.p AS y0, ys.q AS y1
        FROM (SELECT image_id, p, lead(p) OVER (PARTITION BY image_id ORDER BY p) AS q FROM (SELECT image_id, x0 AS p FROM o UNION SELECT image_id, x1 FROM o) u) xs
        JOIN (SELECT image_id, p, lead(p) OVER (PARTITION BY image_id ORDER BY p) AS q FROM (SELECT image_id, y0 AS p FROM o UNION SELECT image_id, y1 FROM o) u) ys
          ON xs.image_id = ys.image_id WHERE xs.q IS NOT NULL AND ys.q IS NOT NULL) c
  JOIN o ON o.image_id = c.image_id AND o.x0 <= c.x0 AND o.x1 >= c.x1 AND o.y0 <= c.y0 AND o.y1 >= c.y1 JOIN {LABEL_CLASS} k ON k.class_id = o.class_id
  GROUP BY ALL) w GROUP BY 1, 2"""


@query("snk_06", f"WITH o AS ({exported_sql('labeled')}) {plane_sql('last')}")
def snk_06(v):
    """Semantic plane, last object on top: pixels per class value."""
    images, rows = exported(v)
    runs, _ = O.label_plane(rows, v.classes, slabs(v), "semantic", "last", allow_lossy=True)
    return runs.groupBy("image_id", "value").agg(F.sum(F.expr("(x1 - x0) * (y1 - y0)")).alias("pixels"))


@query("snk_06_losses")
def snk_06_losses(v):
    """What the semantic plane loses: hidden pixels and merged instances."""
    images, rows = exported(v)
    return O.label_plane(rows, v.classes, slabs(v), "semantic", "last", allow_lossy=True)[1]


@query("snk_07", f"SELECT annotation_id, CAST(255 AS BIGINT) AS value, area AS pixels FROM ({exported_sql('labeled')}) o")
def snk_07(v):
    _, rows = exported(v)
    masks = slabs(v).join(rows.select("annotation_id"), "annotation_id", "left_semi")
    runs, _ = O.label_plane(rows, v.classes, masks, "per_instance")
    return runs.groupBy("annotation_id", "value").agg(F.sum(F.expr("(x1 - x0) * (y1 - y0)")).alias("pixels"))


@query("snk_08", f"""
SELECT image_id, name AS source_name, 'images/' || CAST(image_id AS STRING) || '.png' AS export_file, width, height, role, complete AS review_complete
FROM ({export_images_sql('labeled')}) q WHERE reason IS NULL""")
def snk_08(v):
    images, rows = exported(v)
    losses = O.voc_rows(rows, v.classes).filter("lossy").selectExpr("annotation_id", "lossy", "'box_conversion' AS reason")
    return O.export_manifest(images, rows, v.classes, losses)["image_index"]


@query("snk_08_summary", f"SELECT count(*) AS loss_rows, count(*) > 0 AS lossy FROM ({exported_sql('labeled')}) o WHERE geom_type <> 'box'")
def snk_08_summary(v):
    images, rows = exported(v)
    losses = O.voc_rows(rows, v.classes).filter("lossy").selectExpr("annotation_id", "lossy", "'box_conversion' AS reason")
    return O.export_manifest(images, rows, v.classes, losses)["summary"]


@query("snk_09", f"""
SELECT t.annotation_id, t.image_id, c.k AS class_index, t.revision, t.review_actor, coalesce(t.review_actor = 'human', false) AS human_verified, CASE WHEN t.role = 'validation' THEN 'val' ELSE 'train' END AS split
FROM ({TRAINING_ROWS}) t JOIN {LABEL_CLASS} c ON c.class_id = t.class_id WHERE t.class_ok""")
def snk_09(v):
    return SN.snapshot_rows(v.images, v.annotations, v.classes, round_members(v))[1].drop("class_id")


@query("snk_09_labels", f"""
SELECT t.annotation_id, h.tile_idx, c.k AS class_index, CASE WHEN t.role = 'validation' THEN 'val' ELSE 'train' END AS split,
  CAST((least(h.x1, h.tile_x1) - greatest(h.x0, h.tile_x0)) * (least(h.y1, h.tile_y1) - greatest(h.y0, h.tile_y0)) AS BIGINT) AS area,
  h.x0 < h.tile_x0 OR h.y0 < h.tile_y0 OR h.x1 > h.tile_x1 OR h.y1 > h.tile_y1 AS clipped
FROM ({TRAINING_ROWS}) t JOIN ({HITS % TRAINING_SQL}) h ON h.annotation_id = t.annotation_id JOIN {LABEL_CLASS} c ON c.class_id = t.class_id WHERE t.class_ok AND t.geom_type <> 'box'""")
def snk_09_labels(v):
    rows = P.training_rows(v.images, v.annotations, v.classes, round_members(v))
    out = TR.tile_fragments(rows, slabs(v), v.images, v.classes)
    return out.select("annotation_id", "tile_idx", "class_index", "split", "area", "clipped")


def _scratch(v, name):
    """A folder of this run in the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(v.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("snk_01_files", f"""
SELECT image_id, class_id, geom_type, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CASE WHEN geom_type = 'mask' THEN area END AS pixels
FROM ({IMPORTED}) o""")
def snk_01_files(v):
    """A COCO export with its manifest is published at once, and its text read back through the pointer."""
    images, rows = exported(v)
    path = _scratch(v, "bundle")
    losses = rows.limit(0).selectExpr("annotation_id", "false AS lossy", "'' AS reason")
    O.write_bundle(images, rows, v.classes, slabs(v), path, ("coco",), manifest=O.export_manifest(images, rows, v.classes, losses))
    got = I.read_coco(v.spark, PB.published_folder(v.spark, path, "coco"), images, v.classes, sharded=True)
    pixels = M.mask_stats(got.slabs, "annotation_id").selectExpr("annotation_id", "area AS pixels")
    return got.annotations.join(pixels, "annotation_id", "left").select("image_id", "class_id", "geom_type", "x0", "y0", "x1", "y1", "pixels")


@query("src_10", f"""
SELECT t.annotation_id, t.revision, 'copy' AS project_id FROM ({TRAINING_ROWS}) t WHERE t.class_ok""")
def src_10(v):
    """A snapshot is written, sealed, verified and read back under a new project id."""
    path = _scratch(v, "snapshot")
    SN.build_snapshot(v.images, v.annotations, v.classes, slabs(v), path, round_members(v), require_ready=False)
    SN.seal_snapshot(v.spark, path)
    return SN.read_snapshot(v.spark, path, "copy")["versions"].select("annotation_id", "revision", "project_id")


@query("snk_10")
def snk_10(v):
    """Padded crops of pixel data: the bytes of every text as a picture 48 pixels wide."""
    pictures = v.documents.selectExpr("CAST(doc_id AS STRING) AS path", "encode(text, 'UTF-8') AS raw").selectExpr(
        "path", "48 AS width", "CAST(greatest(1, length(raw) div 48) AS INT) AS height", "1 AS channels",
        "CASE WHEN length(raw) < 48 THEN rpad(raw, 48, X'2e') ELSE substring(raw, 1, (length(raw) div 48) * 48) END AS data")
    return IM.tile_pixels(pictures, size=32).selectExpr("path", "tile_idx", "x0", "y0", "valid_w", "valid_h", "sha2(data, 256) AS pixels")


# ---- predictor --------------------------------------------------------------------------------

@query("udf_01", f"""
SELECT image_id, tile_idx, x0 + 2 AS bx0, y0 + 2 AS by0, x0 + 10 AS bx1, y0 + 10 AS by1, CAST(64 AS BIGINT) AS area FROM ({TRAINING_SQL}) t""")
def udf_01(v):
    """The stand-in predictor over all training tiles, mapped to image coordinates."""
    tiles = TL.all_tiles(v.images, TL.TRAINING)
    local = PR.predict(tiles.select("image_id", "tile_idx", "tile_id"), PR.rectangle_predictor)
    placed = local.join(tiles.selectExpr("image_id", "tile_idx", "x0 AS tile_x0", "y0 AS tile_y0", "x1 AS tile_x1", "y1 AS tile_y1"), ["image_id", "tile_idx"])
    return M.mask_stats(M.map_to_image(placed), "image_id", "tile_idx")


@query("udf_02_regenerate", f"""
SELECT image_id, tile_idx FROM ({TRAINING_SQL}) t WHERE tile_idx % 3 <> 0""")
def udf_02_regenerate(v):
    """Predict, delete some proposals, predict again: deleted masks stay away, by their canonical signature."""
    tiles = TL.all_tiles(v.images, TL.TRAINING)
    none = v.spark.createDataFrame([], "image_id BIGINT, layer_id BIGINT, signature STRING")
    proposals, origins, _ = PR.generate_proposals(tiles, PR.rectangle_predictor, none, 3)
    rows = (proposals.join(origins.selectExpr("annotation_id AS proposal_id", "tile_idx"), "proposal_id").selectExpr(
        "proposal_id AS annotation_id", "tile_idx", "image_id", "layer_id", "signature AS generation_signature", "'proposal' AS status", "0L AS revision",
        "CAST(NULL AS STRING) AS class_id", "'mask' AS geom_type", "'sam2' AS source_kind", "'automatic_mask_generation' AS operation", "CAST(NULL AS STRING) AS review_actor"))
    requests = rows.filter("tile_idx % 3 = 0").selectExpr(
        "image_id AS request_id", "image_id", "annotation_id", "CAST(NULL AS BIGINT) AS expected_revision", "'delete' AS action", "CAST(NULL AS STRING) AS class_id", "true AS confirm", "'human' AS actor")
    gone = CU.apply_selection(rows.drop("tile_idx"), v.images.withColumn("removed", F.lit(False)), v.classes, requests).tombstones
    again, kept, _ = PR.generate_proposals(tiles, PR.rectangle_predictor, gone, 3)
    return again.join(kept.selectExpr("annotation_id AS proposal_id", "tile_idx"), "proposal_id").select("image_id", "tile_idx")


@query("nms_03_cuts", """
SELECT image_id, CAST(2 * count(DISTINCT (x0, y0, x1, y1)) AS BIGINT) AS proposals, CAST(3 * count(*) AS BIGINT) AS origins FROM {annotations} GROUP BY image_id""")
def nms_03_cuts(v):
    """Each box whole, the same box in four slabs, and an L in the same bounds: the first two are one mask, the L is another."""
    base = v.annotations.selectExpr("annotation_id AS a", "image_id", "width", "height", "x0", "y0", "x1", "y1", "(x0 + x1) div 2 AS mx", "(y0 + y1) div 2 AS my")
    whole, cut = "struct(x0 AS x0, x1 AS x1, y0 AS y0, y1 AS y1)", ["struct(x0 AS x0, mx AS x1, y0 AS y0, my AS y1)", "struct(mx AS x0, x1 AS x1, y0 AS y0, my AS y1)",
                                                                       "struct(x0 AS x0, mx AS x1, my AS y0, y1 AS y1)", "struct(mx AS x0, x1 AS x1, my AS y0, y1 AS y1)"]
    made = base.selectExpr("image_id", "width", "height", f"""inline(array(struct(concat(a, '/1') AS annotation_id, array({whole}) AS s),
        struct(concat(a, '/2') AS annotation_id, array({', '.join(cut)}) AS s), struct(concat(a, '/3') AS annotation_id, array({', '.join(cut[:3])}) AS s)))""")
    masks = M.mask_signatures(made.selectExpr("image_id", "width", "height", "annotation_id", "inline(s)"), "image_id", "annotation_id")
    proposals, _ = N.collapse_identical(masks.withColumn("layer_id", F.lit(0)))
    return proposals.groupBy("image_id").agg(F.count("*").alias("proposals"), F.sum("origins").alias("origins"))


# ---- streams ----------------------------------------------------------------------------------

def _stream(v, table):
    """A table as a stream of its files; as a pattern, the path may be one file or a folder of files."""
    return v.spark.readStream.schema(v.spark.read.parquet(f"{v.sf_dir}/{table}.parquet").schema).parquet(f"{v.sf_dir}/{table}[.]parquet")


@query("str_01", """
SELECT i AS image_id, l AS layer_id, s AS signature FROM (SELECT DISTINCT l_orderkey AS i, CAST(l_suppkey % 2 AS BIGINT) AS l, CAST(l_partkey % 50 AS STRING) AS s FROM {lineitem}) q WHERE CAST(s AS BIGINT) % 7 <> 0 OR l <> 0""")
def str_01(v):
    """A stream of candidates: duplicates, tombstones and identical masks are handled per batch."""
    stream = _stream(v, "lineitem").selectExpr("l_orderkey AS image_id", "CAST(l_suppkey % 2 AS BIGINT) AS layer_id", "CAST(l_linenumber AS BIGINT) AS tile_idx",
                                               "l_partkey AS candidate", "concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS annotation_id", "CAST(l_partkey % 50 AS STRING) AS signature")
    rows = v.lineitem.filter("l_partkey % 50 % 7 = 0").selectExpr("l_orderkey AS image_id", "CAST(0 AS BIGINT) AS layer_id", "CAST(l_partkey % 50 AS STRING) AS signature").distinct()
    out = _scratch(v, "stream")
    ST.ingest_tile_results(stream, rows, out, out + "-state")
    return v.spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/proposals").select("image_id", "layer_id", "signature")


@query("str_02", """
WITH RECURSIVE l AS (SELECT CAST(user_id AS BIGINT) AS image_id, event_id AS seq, event_id % 4 AS expected, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {events}),
w AS (SELECT image_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, false AS applied, CAST(0 AS BIGINT) AS revision FROM (SELECT DISTINCT image_id FROM l) q
  UNION ALL SELECT l.image_id, l.k, l.seq, l.expected = w.revision, w.revision + CAST(l.expected = w.revision AS BIGINT) FROM w JOIN l ON l.image_id = w.image_id AND l.k = w.k + 1)
SELECT image_id, seq, applied, revision FROM w WHERE k > 0""")
def str_02(v):
    """Optimistic edits: an edit applies only against the revision it expects."""
    edits = _stream(v, "events").selectExpr("CAST(user_id AS BIGINT) AS image_id", "event_id AS seq", "event_id % 4 AS expected_revision")
    out = _scratch(v, "stream")
    return ST.run_to_folder(ST.apply_edit_stream(edits), out, out + "-state")


@query("str_03", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS action, count(*) AS n FROM {events} GROUP BY 1, 2""")
def str_03(v):
    events = _stream(v, "events").selectExpr("CAST(ts AS TIMESTAMP) AS created_at", "event_type AS action")
    out = _scratch(v, "stream")
    got = ST.run_to_folder(ST.action_windows(events), out, out + "-state", mode="complete")
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "action", "n")


@query("str_03_sessions", """
SELECT image_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS actions FROM (SELECT image_id, s, count(*) AS n FROM (
  SELECT image_id, sum(fresh) OVER (PARTITION BY image_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT image_id, created_at, CASE WHEN created_at <= lag(created_at) OVER (PARTITION BY image_id ORDER BY created_at) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM {edit_log}) a) b GROUP BY 1, 2) c GROUP BY 1""")
def str_03_sessions(v):
    """Sessions of activity per image (batch form of the same plan)."""
    got = ST.action_sessions(v.edit_log, "6 hours")
    return got.groupBy("image_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("actions"))


@query("str_04", """
SELECT image_id, count(*) AS total_tiles, CAST(count(DISTINCT line) FILTER (WHERE done) AS BIGINT) AS completed_tiles FROM (
  SELECT DISTINCT l_orderkey AS image_id, l_linenumber AS line, true AS done FROM {lineitem}) q GROUP BY image_id""")
def str_04(v):
    """Progress of layers from a stream of tile receipts."""
    receipts = _stream(v, "lineitem").selectExpr("l_orderkey AS image_id", "CAST(l_linenumber AS BIGINT) AS tile_idx")
    planned = v.lineitem.groupBy(F.col("l_orderkey").alias("image_id")).agg(F.count_distinct("l_linenumber").alias("total_tiles"))
    out = _scratch(v, "stream")
    return ST.coverage_stream(receipts, planned, out, out + "-state").select("image_id", "total_tiles", "completed_tiles")


@query("str_05", "SELECT DISTINCT SHA<<text>> AS sha256 FROM {documents}")
def str_05(v):
    """New files by content: one row per distinct bytes."""
    files = _stream(v, "documents").selectExpr("concat(source, '/', doc_id) AS path", "sha2(text, 256) AS sha256")
    out = _scratch(v, "stream")
    return ST.run_to_folder(ST.ingest_files(files), out, out + "-state").select("sha256")
