"""Exchange formats: the rows of each format, and their sharded writers.

Row builders return plain DataFrames. Writers publish with Spark's commit protocol into a
destination that must not exist, and refuse the whole export when any row cannot be written.
``ds`` rows: annotations (annotation_id, image_id, class_id, geom_type, x0..y1), slabs for masks.
"""
from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import shapes
from ..model import MAX_PLANE_VALUE
from ..operators.batches import SLABS, spread
from ..operators.masks import encode_gathered, mask_stats
from ..operators.predicates import export_split
from ..operators.vectors import component_polygons, to_polygon
from ..operators.windows import class_index, dense_ids, paint, plane_conflicts
from ..session import cut_lineage
from .publish import publish, publish_parts


class ExportBlocked(ValueError):
    """Raised before anything is written; ``failures`` is the DataFrame of blocking rows."""

    def __init__(self, message: str, failures: DataFrame):
        super().__init__(message)
        self.failures = failures


def _block(failures: DataFrame, what: str) -> None:
    first = failures.limit(5).collect()
    if first:
        raise ExportBlocked(f"{what} blocked, for example: {[r.asDict() for r in first]}", failures)


@F.arrow_udf(T.StringType())
def encode_counts(counts: pa.Array) -> pa.Array:
    """Compressed run text of counts."""
    text, offsets = shapes.counts_to_text(np.asarray(counts.flatten(), np.int64), np.concatenate([[0], np.cumsum(np.asarray(counts.value_lengths().fill_null(0), np.int64))]))
    made = pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text)])
    return pc.if_else(counts.is_valid(), made, pa.scalar(None, pa.string()))


AUTHORED = "array<struct<x: double, y: double>>"


def _carried(annotations: DataFrame) -> DataFrame:
    """Annotations with ``points`` and ``flags``: an authored polygon keeps its vertices through every export."""
    if "points" not in annotations.columns:
        annotations = annotations.withColumn("points", F.expr(f"CAST(NULL AS {AUTHORED})"))
    if "flags" not in annotations.columns:
        annotations = annotations.withColumn("flags", F.expr("CAST(NULL AS map<string, string>)"))
    return annotations.withColumn("points", F.expr("CASE WHEN geom_type = 'polygon' AND size(points) >= 3 THEN points END"))


# ---- COCO -------------------------------------------------------------------------------------

def coco_rows(images: DataFrame, annotations: DataFrame, classes: DataFrame, slabs: DataFrame, text: bool = False):
    """Returns (categories, images, annotations) with dense 1-based ids in document order; ``text`` gives counts as run text.

    Boxes keep bbox and no segmentation; authored polygons keep their vertices; other masks carry
    compressed runs. Area and xywh bounds are those of the pixels.
    """
    annotations = _carried(annotations)
    categories = class_index(classes, 1).selectExpr("class_index AS id", "name", "class_id AS source_id")
    pictures = dense_ids(images.select("image_id", "width", "height"), ["image_id"], "id").selectExpr(
        "id", "concat('images/', image_id, '.png') AS file_name", "width", "height", "CAST(image_id AS STRING) AS source_id", "image_id AS _image")
    numbered = dense_ids(annotations.select("image_id", "annotation_id", "class_id", "geom_type", "x0", "y0", "x1", "y1", "points",
                                            F.expr("coalesce(try_cast(flags['iscrowd'] AS INT), 0)").alias("iscrowd")), ["image_id", "annotation_id"], "id")
    placed = (numbered.join(pictures.selectExpr("_image AS image_id", "id AS coco_image", "CAST(width AS BIGINT) AS _w", "CAST(height AS BIGINT) AS _h"), "image_id")
              .join(F.broadcast(categories.selectExpr("source_id AS class_id", "id AS category_id")), "class_id"))
    # An object meets its gathered slabs; counts are formed after the last exchange.
    held = spread(slabs, "annotation_id").groupBy("annotation_id").agg(
        F.collect_list(F.struct("x0", "x1", "y0", "y1")).cast(SLABS).alias("_held"), F.sum(F.expr("(x1 - x0) * (y1 - y0)")).alias("area"),
        F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"))
    shaped = placed.join(held, "annotation_id", "left").withColumn("_slabs", F.expr("CASE WHEN geom_type <> 'box' THEN _held END"))
    rows = encode_gathered(shaped.selectExpr(
        "id", "coco_image AS image_id", "category_id", "iscrowd", "annotation_id AS source_id", "geom_type",
        "CAST(CASE WHEN geom_type = 'box' THEN (x1 - x0) * (y1 - y0) ELSE area END AS DOUBLE) AS area",
        "CAST(CASE WHEN geom_type = 'box' THEN array(x0, y0, x1 - x0, y1 - y0) ELSE array(bx0, by0, bx1 - bx0, by1 - by0) END AS array<double>) AS bbox",
        "CASE WHEN _slabs IS NOT NULL THEN array(_h, _w) END AS size", "points", "_slabs", "coalesce(_w, 0L) AS _w", "coalesce(_h, 0L) AS _h"), text=text)
    rows = rows.select("id", "image_id", "category_id", "iscrowd", "source_id", "geom_type", "area", "bbox", "counts", "size", "points")
    return categories, pictures.drop("_image"), rows


def write_coco(images: DataFrame, annotations: DataFrame, classes: DataFrame, slabs: DataFrame, path: str) -> None:
    """Three JSON-lines folders: categories, images, annotations."""
    categories, pictures, rows = coco_rows(images, annotations, classes, slabs, text=True)
    rows = rows.withColumn("segmentation", F.when(F.col("geom_type") == "box", F.lit("[]"))
                           .when(F.col("points").isNotNull(), F.to_json(F.array(F.expr("flatten(transform(points, p -> array(p.x, p.y)))")))).otherwise(
        F.to_json(F.struct("size", "counts"))))
    # Made durable once: the check and the text read the same rows, and nothing is written before the check.
    rows = cut_lineage(rows.select("id", "image_id", "category_id", "iscrowd", "source_id", "geom_type", "area", "bbox", "segmentation"))
    _block(rows.filter("geom_type <> 'box' AND coalesce(area, 0) = 0").select("source_id"), "COCO export of empty masks")
    categories.write.mode("errorifexists").json(f"{path}/categories")
    pictures.write.mode("errorifexists").json(f"{path}/images")
    # Segmentation is an object or a list in the format: it is spliced into the row text as JSON.
    head = "to_json(struct(id, image_id, category_id, iscrowd, source_id, area, bbox))"
    rows.selectExpr(f"""concat(substring({head}, 1, length({head}) - 1), ',"segmentation":', segmentation, '}}') AS value""").write.mode(
        "errorifexists").text(f"{path}/annotations")


# ---- YOLO -------------------------------------------------------------------------------------

def yolo_box_rows(images: DataFrame, annotations: DataFrame, classes: DataFrame) -> DataFrame:
    """Normalised cx, cy, w, h per object; masks are flagged as lossy."""
    return (annotations.join(class_index(classes, 0).select("class_id", "class_index"), "class_id")
            .join(images.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h"), F.expr(export_split()).alias("split")), "image_id")
            .selectExpr("image_id", "annotation_id", "split", "class_index", "(x0 + x1) / (2 * _w) AS cx", "(y0 + y1) / (2 * _h) AS cy",
                        "(x1 - x0) / _w AS w", "(y1 - y0) / _h AS h", "geom_type <> 'box' AS lossy"))


def yolo_seg_rows(images: DataFrame, annotations: DataFrame, classes: DataFrame, slabs: DataFrame, allow_lossy: bool = False):
    """Returns (rows, failures): normalised polygons per object, and objects that cannot be written."""
    annotations = _carried(annotations)
    authored = annotations.filter("points IS NOT NULL").selectExpr(
        "annotation_id", "'authored_polygon' AS method", "points", "CAST(0 AS BIGINT) AS changed_pixels", "false AS lossy", "CAST(NULL AS STRING) AS error")
    traced = slabs.join(authored.select("annotation_id"), "annotation_id", "left_anti")
    sized = traced.join(images.select("image_id", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height")), "image_id")
    converted = to_polygon(sized, "annotation_id", allow_lossy=allow_lossy).select(*authored.columns).unionByName(authored)
    rows = (annotations.select("image_id", "annotation_id", "class_id", "geom_type").join(converted, "annotation_id", "left")
            .join(class_index(classes, 0).select("class_id", "class_index"), "class_id")
            .join(images.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h"), F.expr(export_split()).alias("split")), "image_id")
            .withColumn("reason", F.expr("CASE WHEN geom_type = 'box' THEN 'box_only' WHEN method IS NULL THEN 'no_foreground' ELSE error END")))
    failures = rows.filter("reason IS NOT NULL").select("image_id", "annotation_id", "reason")
    good = rows.filter("reason IS NULL").withColumn("coords", F.expr("flatten(transform(points, p -> array(p.x / _w, p.y / _h)))"))
    return good.select("image_id", "annotation_id", "split", "class_index", "coords", "method", "lossy", "changed_pixels"), failures


def label_collisions(rows: DataFrame) -> DataFrame:
    """Rows of one image a loader would merge, from coordinates as written."""
    from ..operators.windows import yolo_collisions
    parts = {"x": "0", "y": "1"}
    boxed = rows.selectExpr("image_id", "class_index", "annotation_id AS row", *[
        f"CAST(array_{f}(transform(filter(coords, (c, i) -> i % 2 = {k}), c -> CAST(c AS FLOAT))) AS FLOAT) AS {f}{axis}"
        for axis, k in parts.items() for f in ("min", "max")])
    return yolo_collisions(boxed)


def _yolo_lines(images: DataFrame, annotations: DataFrame, classes: DataFrame, slabs: DataFrame, kind: str, allow_lossy: bool):
    """Returns (lines, splits, class map): split, image_id, annotation_id and line of every object; blocked if any cannot be written."""
    if kind == "seg":
        rows, failures = yolo_seg_rows(images, annotations, classes, slabs, allow_lossy)
        rows = rows.withColumn("line", F.expr("concat_ws(' ', class_index, array_join(transform(coords, c -> CAST(c AS STRING)), ' '))"))
        clash = label_collisions(rows).selectExpr("image_id", "row AS annotation_id", "'loader_would_merge' AS reason")
        failures = failures.unionByName(clash)
    else:
        rows = yolo_box_rows(images, annotations, classes).withColumn("line", F.expr("concat_ws(' ', class_index, cx, cy, w, h)"))
        failures = rows.filter("lossy" if not allow_lossy else "false").selectExpr("image_id", "annotation_id", "'needs_allow_lossy' AS reason")
    _block(failures, "YOLO export")
    names = class_index(classes, 0).orderBy("class_index").collect()  # a vocabulary of at most 65 535 names
    body = json.dumps({"schema_version": 1, "classes": [{"index": r["class_index"], "class_id": r["class_id"], "name": r["name"]} for r in names]}, ensure_ascii=False)
    return (rows.select("split", "image_id", "annotation_id", "line"), images.select("image_id", F.expr(export_split()).alias("split")),
            images.sparkSession.createDataFrame([(body,)], "value STRING").coalesce(1))


def write_yolo(images: DataFrame, annotations: DataFrame, classes: DataFrame, slabs: DataFrame, path: str, kind: str = "seg", allow_lossy: bool = False) -> None:
    """labels/split=.../image_id=.../part files, split lists and class map; negatives get an empty line.

    An image with very many objects spreads over several part files: its lines never meet in one task. One folder
    per image suits small sets; :func:`write_yolo_packed` writes as many files as tasks.
    """
    rows, splits, names = _yolo_lines(images, annotations, classes, slabs, kind, allow_lossy)
    empty = splits.join(rows.select("image_id"), "image_id", "left_anti").select("split", "image_id", F.lit("").alias("line"))
    lines = rows.select("split", "image_id", "line").unionByName(empty)
    lines.write.mode("errorifexists").partitionBy("split", "image_id").text(f"{path}/labels")
    splits.selectExpr("split", "concat('./images/', image_id, '.png') AS file").write.mode("errorifexists").partitionBy("split").text(f"{path}/splits")
    names.write.mode("errorifexists").text(f"{path}/class_map")


def write_yolo_packed(images: DataFrame, annotations: DataFrame, classes: DataFrame, slabs: DataFrame, path: str, kind: str = "seg",
                      allow_lossy: bool = False, files: int | None = None) -> None:
    """The same labels as rows (split, file, text), packed by image ranges into ``files`` files (one per shuffle task),
    split lists and class map; published together or not at all. A negative's text is empty."""
    rows, splits, names = _yolo_lines(images, annotations, classes, slabs, kind, allow_lossy)
    texts = rows.groupBy("image_id").agg(F.expr("concat(array_join(transform(array_sort(collect_list(struct(annotation_id, line))), r -> r.line), '\n'), '\n')").alias("text"))
    count = files or int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labels = (splits.join(texts, "image_id", "left").repartitionByRange(count, "image_id")
              .selectExpr("split", "concat('labels/', split, '/', image_id, '.txt') AS file", "image_id", "coalesce(text, '') AS text"))
    publish({"labels": labels, "splits": splits.selectExpr("split", "concat('./images/', image_id, '.png') AS file"), "class_map": names}, path, "json")


# ---- VOC --------------------------------------------------------------------------------------

def voc_rows(annotations: DataFrame, classes: DataFrame) -> DataFrame:
    """One-based inclusive integer boxes; lossy unless the geometry is an integer box."""
    return (annotations.join(classes.select("class_id", F.col("name").alias("class_name")), "class_id").selectExpr(
        "image_id", "annotation_id", "class_name", "CAST(floor(x0) AS BIGINT) + 1 AS xmin", "CAST(floor(y0) AS BIGINT) + 1 AS ymin",
        "CAST(ceil(x1) AS BIGINT) AS xmax", "CAST(ceil(y1) AS BIGINT) AS ymax",
        "geom_type <> 'box' OR floor(x0) <> x0 OR floor(y0) <> y0 OR ceil(x1) <> x1 OR ceil(y1) <> y1 AS lossy"))


def write_voc(images: DataFrame, annotations: DataFrame, classes: DataFrame, path: str, allow_lossy: bool = False) -> None:
    """XML documents: one <annotation> per image, whatever its size, many per file."""
    rows = voc_rows(annotations, classes)
    if not allow_lossy:
        _block(rows.filter("lossy").select("annotation_id"), "VOC export without allow_lossy")
    _block(classes.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1"), "VOC export with repeated class names")
    if "flags" in annotations.columns:
        rows = rows.join(annotations.select("annotation_id", "flags"), "annotation_id")
    mark = (lambda name: f"CASE WHEN try_cast(flags['{name}'] AS BOOLEAN) THEN '1' ELSE '0' END") if "flags" in rows.columns else (lambda name: "'0'")
    objects = rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.expr(
        f"struct(annotation_id, class_name AS name, {mark('truncated')} AS truncated, {mark('difficult')} AS difficult, struct(xmin, ymin, xmax, ymax) AS bndbox)"))).alias("o"))
    docs = (images.join(objects, "image_id", "left").selectExpr(
        "'images' AS folder", "concat(image_id, '.png') AS filename", "struct(width, height, 3 AS depth) AS size", "'0' AS segmented",
        "transform(o, x -> struct(x.name AS name, x.truncated AS truncated, x.difficult AS difficult, x.bndbox AS bndbox)) AS object"))
    docs.write.format("xml").option("rootTag", "annotations").option("rowTag", "annotation").mode("errorifexists").save(path)


# ---- LabelMe ----------------------------------------------------------------------------------

def labelme_shapes(images: DataFrame, annotations: DataFrame, classes: DataFrame, slabs: DataFrame, allow_lossy: bool = False):
    """Returns (shapes, failures). A mask of several components becomes polygons that share a fresh
    group id which no existing object of the image uses; holes need consent.

    ``annotations`` may carry a ``group_id`` BIGINT of an earlier import.
    """
    annotations = _carried(annotations)
    if "group_id" not in annotations.columns:
        annotations = annotations.withColumn("group_id", F.lit(None).cast("bigint"))
    rows = annotations.join(classes.select("class_id", F.col("name").alias("label")), "class_id")
    boxes = rows.filter("geom_type = 'box'").selectExpr(
        "image_id", "annotation_id", "label", "group_id", "'rectangle' AS shape_type", "0L AS part",
        "CAST(array(struct(x0 AS x, y0 AS y), struct(x1 AS x, y1 AS y)) AS array<struct<x: double, y: double>>) AS points")
    authored = rows.filter("points IS NOT NULL").selectExpr("image_id", "annotation_id", "label", "group_id", "'polygon' AS shape_type", "0L AS part", "points")
    sized = slabs.join(rows.filter("geom_type <> 'box' AND points IS NULL").select("annotation_id"), "annotation_id", "left_semi")
    # Traced once: numbering, the hole check and the shapes all read it.
    parts = cut_lineage(component_polygons(sized, "annotation_id"))
    made = rows.filter("geom_type <> 'box'").select("image_id", "annotation_id", "label", "group_id").join(parts, "annotation_id")
    failures = made.filter("part = 0 AND holes > 0").selectExpr("image_id", "annotation_id", "'has_holes' AS reason")
    if allow_lossy:
        failures = failures.limit(0)
    # Fresh ids start above every id in use in the image; numbering is dense per image at any size.
    from ..operators.windows import rank_within
    grouped = made.filter("components > 1 AND group_id IS NULL AND part = 0").select("image_id", "annotation_id")
    numbered = rank_within(grouped, ["image_id"], ["annotation_id"])
    used = rows.groupBy("image_id").agg(F.coalesce(F.max("group_id"), F.lit(0)).alias("top"))
    fresh = numbered.join(used, "image_id").selectExpr("annotation_id", "top + rank AS fresh_group")
    polygons = made.join(fresh, "annotation_id", "left").selectExpr(
        "image_id", "annotation_id", "label", "coalesce(group_id, fresh_group) AS group_id", "'polygon' AS shape_type", "part", "points")
    return boxes.unionByName(authored).unionByName(polygons), failures


def write_labelme(images: DataFrame, annotations: DataFrame, classes: DataFrame, slabs: DataFrame, path: str, allow_lossy: bool = False) -> None:
    """One JSON document per image, whatever its size, as JSON lines."""
    _block(classes.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1"), "LabelMe export with repeated class names")
    shapes, failures = labelme_shapes(images, annotations, classes, slabs, allow_lossy)
    _block(failures, "LabelMe export")
    shapes = shapes.join(_carried(annotations).select("annotation_id", F.expr("coalesce(transform_values(flags, (k, f) -> try_cast(f AS BOOLEAN)), map())").alias("flags")), "annotation_id")
    lists = shapes.groupBy("image_id").agg(F.sort_array(F.collect_list(F.expr(
        "struct(annotation_id, part, label, group_id, shape_type, transform(points, p -> array(p.x, p.y)) AS points, to_json(flags) AS flags)"))).alias("s"))
    (images.join(lists, "image_id", "left").selectExpr(
        "'5.0.1' AS version", "concat(image_id, '.png') AS imagePath", "height AS imageHeight", "width AS imageWidth",
        "coalesce(transform(s, x -> struct(x.label AS label, x.points AS points, x.group_id AS group_id, x.shape_type AS shape_type, from_json(x.flags, 'map<string, boolean>') AS flags)), array()) AS shapes")
        .write.mode("errorifexists").json(path))


# ---- label planes -----------------------------------------------------------------------------

def label_plane(annotations: DataFrame, classes: DataFrame, slabs: DataFrame, variant: str = "semantic", conflict: str = "error", allow_lossy: bool = False):
    """Returns (runs, losses). Variants: semantic (class value from 1), instance_id, per_instance (255).

    ``error`` refuses overlapping objects. Losses list hidden pixels, and classes whose instances a
    semantic plane merges, which needs ``allow_lossy``. Pixels of another object with the same value count as visible.
    An object without pixels and a value beyond the plane's largest block the export.
    """
    if variant == "per_instance":
        runs = slabs.join(annotations.select("annotation_id", "class_id"), "annotation_id").withColumn("value", F.lit(255).cast("bigint"))
        return runs.select("image_id", "annotation_id", "class_id", "x0", "x1", "y0", "y1", "value"), annotations.limit(0).selectExpr(
            "annotation_id", "CAST(0 AS BIGINT) AS removed_pixels", "'' AS reason")
    from ..operators.windows import rank_within
    base = annotations.select("annotation_id", "image_id", "class_id")
    if variant == "semantic":
        valued = base.join(F.broadcast(class_index(classes, 1).selectExpr("class_id", "class_index AS value")), "class_id")
    elif variant == "instance_id":
        valued = rank_within(base, ["image_id"], ["annotation_id"], "value")
    else:
        raise ValueError("variant must be semantic, instance_id or per_instance")
    # Made durable once: the checks, the plane and the losses read the same objects and slabs.
    valued = cut_lineage(valued)
    held = cut_lineage(slabs.select("annotation_id", "image_id", "x0", "x1", "y0", "y1").join(valued.select("annotation_id", "value"), "annotation_id"))
    merged = valued.groupBy("image_id", "class_id").agg(F.count("*").alias("n"), F.min("annotation_id").alias("annotation_id")).filter("n > 1")
    failures = (valued.join(held.select("annotation_id"), "annotation_id", "left_anti").select("image_id", "annotation_id", F.lit("no_foreground").alias("reason"))
                .unionByName(valued.filter(F.col("value") > MAX_PLANE_VALUE).select("image_id", "annotation_id", F.lit("value_beyond_plane").alias("reason"))))
    if variant == "semantic" and not allow_lossy:
        failures = failures.unionByName(merged.select("image_id", "annotation_id", F.lit("merging_instances_needs_consent").alias("reason")))
    _block(failures, "plane export")
    rows = held.withColumn("ord", F.col("annotation_id")).withColumn("obj", F.struct("annotation_id", "value"))
    painted = paint(rows, "first" if conflict == "error" else conflict)
    if conflict == "error":
        _block(plane_conflicts(painted), "plane export of overlapping objects")
    runs = painted.selectExpr("image_id", "x0", "x1", "y0", "y1", "obj.value AS value", "obj.annotation_id AS annotation_id")
    # A piece that one row alone covers is visible as it is; only where several meet is it asked who shows the same value.
    alone = painted.filter("covering = 1").selectExpr("obj.annotation_id AS o_id", "(x1 - x0) * (y1 - y0) AS intersection")
    winners = painted.filter("covering > 1").selectExpr("image_id", "obj.value AS k", "obj.annotation_id AS w_id", "x0", "x1", "y0", "y1").withColumn("kk", F.struct("image_id", "k"))
    own = rows.selectExpr("struct(image_id, value AS k) AS kk", "annotation_id AS o_id", "x0", "x1", "y0", "y1")
    from ..operators.masks import pair_intersections
    visible = (pair_intersections(winners.select("kk", "w_id", "x0", "x1", "y0", "y1"), own, "w_id", "o_id", ["kk"])
               .select("o_id", "intersection").unionByName(alone).groupBy("o_id").agg(F.sum("intersection").alias("visible")))
    area = mask_stats(rows, "annotation_id").select("annotation_id", "area")
    hidden = (area.join(visible.withColumnRenamed("o_id", "annotation_id"), "annotation_id", "left")
              .selectExpr("annotation_id", "area - coalesce(visible, 0) AS removed_pixels", "'hidden_by_overlap' AS reason").filter("removed_pixels > 0"))
    if variant == "semantic":
        hidden = hidden.unionByName(merged.selectExpr("annotation_id", "CAST(0 AS BIGINT) AS removed_pixels", "concat('instances_merged:', n) AS reason"))
    return runs, hidden


# ---- manifest ---------------------------------------------------------------------------------

def export_manifest(images: DataFrame, annotations: DataFrame, classes: DataFrame, losses: DataFrame) -> dict[str, DataFrame]:
    """Image index, class map, review scope, loss rows and the overall lossy flag."""
    return {
        "image_index": images.selectExpr("image_id", "name AS source_name", "concat('images/', image_id, '.png') AS export_file", "width", "height",
                                         "role", "complete AS review_complete"),
        "class_map": class_index(classes, 0).selectExpr("class_index AS index", "class_id", "name"),
        "review_scope": annotations.selectExpr("annotation_id", "status", "review_actor", "coalesce(status = 'accepted' AND review_actor = 'human', false) AS human_verified"),
        "loss_report": losses,
        "summary": losses.agg(F.count("*").alias("loss_rows"), F.coalesce(F.max(F.col("lossy").cast("int")), F.lit(0)).alias("_l"))
        .selectExpr("loss_rows", "_l = 1 AS lossy"),
    }


def write_manifest(parts: dict[str, DataFrame], path: str) -> None:
    for name, df in parts.items():
        df.write.mode("errorifexists").json(f"{path}/{name}")


def write_bundle(images: DataFrame, annotations: DataFrame, classes: DataFrame, slabs: DataFrame, path: str,
                 formats: tuple[str, ...] = ("coco",), allow_lossy: bool = False, manifest: dict[str, DataFrame] | None = None) -> None:
    """An export in any of coco, yolo_seg, yolo_box, voc and labelme, with its manifest if given: all of it is published or nothing.

    A format that cannot hold the objects, or a task that fails in the last part, leaves no reader anything to see.
    Parts are found by ``publish.published_folder`` and read by the readers of their format.
    """
    writers = {
        "coco": lambda folder: write_coco(images, annotations, classes, slabs, folder),
        "yolo_seg": lambda folder: write_yolo_packed(images, annotations, classes, slabs, folder, "seg", allow_lossy),
        "yolo_box": lambda folder: write_yolo_packed(images, annotations, classes, slabs, folder, "box", allow_lossy),
        "voc": lambda folder: write_voc(images, annotations, classes, folder, allow_lossy),
        "labelme": lambda folder: write_labelme(images, annotations, classes, slabs, folder, allow_lossy),
    }
    unknown = sorted(set(formats) - set(writers))
    if unknown:
        raise ValueError(f"no writer for {', '.join(unknown)}")
    parts = {name: writers[name] for name in formats}
    if manifest is not None:
        parts["manifest"] = lambda folder: write_manifest(manifest, folder)
    publish_parts(images.sparkSession, parts, path)
