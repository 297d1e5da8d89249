"""Topology, outlines, rasters and box conversion of masks.

SQL settles what it can (a one-slab mask is one component without holes). The rest is done for whole
Arrow batches of masks at once: a mask is bounded by the image limit, and masks spread over all tasks.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import shapes
from .batches import POINTS, SLABS, gather, matrix, per_batch, point_lists, spread
from .masks import loss_expr, mask_stats

def _column(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name), np.int64)


def topology(slabs: DataFrame, *keys: str) -> DataFrame:
    """Components and holes per mask."""
    masks = gather(slabs, *keys)
    one = masks.filter("size(slabs) = 1").selectExpr(*keys, "1L AS components", "0L AS holes")
    more = per_batch(masks.filter("size(slabs) > 1"), "slabs", list(keys), "components bigint, holes bigint",
                     lambda owner, flat, table: (shapes.topology(owner, matrix(flat), len(table)),))
    return one.unionByName(more)


def polygon_gate(shape: DataFrame) -> DataFrame:
    """Which masks a single polygon can hold without loss. ``shape``: geom_type, components, holes."""
    return shape.withColumn("gate", F.expr("""CASE WHEN geom_type = 'box' THEN 'box_only'
        WHEN components = 1 AND holes = 0 THEN 'exact' WHEN components = 1 THEN 'needs_fill_holes' ELSE 'needs_convex_hull' END"""))


_CONVERTED = f"""method string, components bigint, holes bigint, points {POINTS}, original_area bigint,
                converted_area bigint, shared bigint"""
METHODS = ("pixel_edge_polygon", "fill_holes", "all_components_convex_hull")


def _by(owner: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    out = np.zeros(count, np.int64)
    np.add.at(out, owner, values)
    return out


def _convert(allow_lossy: bool):
    def work(owner, flat, table):
        slabs, count, width, height = matrix(flat), len(table), _column(table, "width"), _column(table, "height")
        area = _by(owner, (slabs[:, 1] - slabs[:, 0]) * (slabs[:, 3] - slabs[:, 2]), count)
        # A single slab is its own rectangle, and the raster rule gives back exactly its pixels.
        single = (np.bincount(owner, minlength=count) == 1)[owner]
        x0, x1, y0, y1 = slabs[single].T
        corners = np.stack([x0, y0, x1, y0, x1, y1, x0, y1], axis=1).reshape(-1, 2).astype(float)
        square, owner, slabs = owner[single], owner[~single], slabs[~single]
        components, holes = shapes.topology(owner, slabs, count)
        components[square] = 1
        method = np.where(components > 1, 2, np.where(holes > 0, 1, 0))
        refused = (method > 0) & (not allow_lossy)
        # Rings of single components, their holes filled.
        traced = (components == 1) & ~refused
        part, rows = owner[traced[owner]], slabs[traced[owner]]
        ring, points = part, np.zeros((0, 2), np.int64)
        if len(part):
            hole_owner, hole_rows = shapes.holes(part, rows)
            ring, points = shapes.outlines(np.concatenate([part, hole_owner]), np.concatenate([rows, hole_rows]))
        several = ((components > 1) & ~refused)[owner]
        hull_ring, hull_points = shapes.convex_hulls(owner[several], slabs[several])
        ring, points = np.concatenate([ring, hull_ring]), np.concatenate([points, hull_points]).astype(float)
        order = np.argsort(ring, kind="stable")
        ring, points = ring[order], points[order]
        made_owner, made = shapes.polygon_intervals(ring, points, height, width)
        own_owner, own = shapes.slabs_to_intervals(owner, slabs, height)
        shared = shapes.shared_length(own_owner, own, made_owner, made, count, int((width * height).max()))
        converted = _by(made_owner, made[:, 1] - made[:, 0], count)
        shared[square] = converted[square] = area[square]
        ring, points = np.concatenate([ring, np.repeat(square, 4)]), np.concatenate([points, corners])
        order = np.argsort(ring, kind="stable")
        return ([METHODS[m] for m in method.tolist()], components, holes, point_lists(ring[order], points[order], count, refused), area,
                pa.array(converted, mask=refused), pa.array(shared, mask=refused)),
    return work


def _with_loss(flat: DataFrame, allow_lossy: bool) -> DataFrame:
    return (flat.withColumns(loss_expr("original_area", "converted_area", "shared"))
            .withColumn("error", F.expr(f"""CASE WHEN points IS NULL THEN 'topology_needs_consent'
                WHEN lossy AND NOT {str(allow_lossy).lower()} THEN 'pixels_change' END"""))
            .withColumn("points", F.expr("CASE WHEN error IS NULL THEN points END")).drop("shared"))


def convert_masks(masks: DataFrame, keys: list[str], allow_lossy: bool = False) -> DataFrame:
    """:func:`to_polygon` for masks that are gathered already: ``keys`` (with width and height) and the array ``slabs``."""
    return _with_loss(per_batch(masks.withColumn("slabs", F.col("slabs").cast(SLABS)), "slabs", keys, _CONVERTED, _convert(allow_lossy)), allow_lossy)


def to_polygon(slabs: DataFrame, *keys: str, allow_lossy: bool = False) -> DataFrame:
    """One polygon per mask with a loss report; needs width and height columns.

    A mask with one component and no hole gives its pixel-edge ring. With consent, holes are filled
    or, for several components, the convex hull of all of them is used. Without consent such masks
    come back with ``error`` and no points.
    """
    masks = gather(slabs, *keys, "width", "height")
    # Single slabs need no Python at all.
    one = (masks.filter("size(slabs) = 1").selectExpr(*keys, "slabs[0] AS s").selectExpr(*keys, "(s.x1 - s.x0) * (s.y1 - s.y0) AS a", f"""CAST(array(
        struct(s.x0 AS x, s.y0 AS y), struct(s.x1 AS x, s.y0 AS y), struct(s.x1 AS x, s.y1 AS y), struct(s.x0 AS x, s.y1 AS y)) AS {POINTS}) AS points""")
           .selectExpr(*keys, "'pixel_edge_polygon' AS method", "1L AS components", "0L AS holes", "points", "a AS original_area", "a AS converted_area", "a AS shared"))
    more = per_batch(masks.filter("size(slabs) > 1"), "slabs", list(keys), _CONVERTED, _convert(allow_lossy))
    return _with_loss(one.unionByName(more), allow_lossy)


def rasterize(polygons: DataFrame, *keys: str) -> DataFrame:
    """Slabs of polygons (points, width, height) by the COCO rule, columns alike side by side as one; an empty raster gives no row."""
    source = spread(polygons.select(*keys, "width", "height", F.col("points").cast(POINTS).alias("points")), *keys)

    def work(owner, flat, table):
        height = _column(table, "height")
        columns = shapes.intervals_to_slabs(*shapes.polygon_intervals(owner, matrix(flat), height, _column(table, "width")), height)
        rows, slabs = shapes.side_by_side(*columns)
        return slabs.T, rows

    return per_batch(source, "points", [f.name for f in source.schema.fields if f.name != "points"], "x0 bigint, x1 bigint, y0 bigint, y1 bigint", work)


def to_box(slabs: DataFrame, *keys: str) -> DataFrame:
    """Bounds of every mask with the pixels the box adds; always a geometry-type loss."""
    stats = mask_stats(slabs, *keys).withColumn("box_area", F.expr("(bx1 - bx0) * (by1 - by0)"))
    out = stats.withColumns(loss_expr("area", "box_area", "area"))
    return out.withColumn("lossy", F.lit(True)).withColumn("geometry_type_loss", F.lit(True))


def geometry_bounds(annotations: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Bounds by geometry type: a box itself, polygon vertices, or the raster bounds of a mask.

    ``annotations``: annotation_id, geom_type, x0..y1 for boxes, points for polygons.
    """
    from ..functions.polygons import bbox_columns
    rows = annotations.selectExpr("annotation_id", "geom_type", "struct(x0, x1, y0, y1) AS b", f"struct({', '.join(bbox_columns('points'))}) AS p")
    if masks is not None:
        rows = rows.join(mask_stats(masks, "annotation_id").select("annotation_id", F.struct("bx0", "by0", "bx1", "by1").alias("m")), "annotation_id", "left")
    pick = lambda c: f"CAST(CASE geom_type WHEN 'box' THEN b.{c} WHEN 'polygon' THEN p.{c} " + (f"ELSE m.b{c} " if masks is not None else "") + f"END AS DOUBLE) AS {c}"
    return rows.selectExpr("annotation_id", "geom_type", *[pick(c) for c in ("x0", "y0", "x1", "y1")])


def component_polygons(slabs: DataFrame, *keys: str) -> DataFrame:
    """One filled outline per component: part, points, components and holes of the mask."""
    masks = gather(slabs, *keys)
    box = """CAST(array(struct(s.x0 AS x, s.y0 AS y), struct(s.x1 AS x, s.y0 AS y), struct(s.x1 AS x, s.y1 AS y), struct(s.x0 AS x, s.y1 AS y))
             AS array<struct<x: double, y: double>>) AS points"""
    one = masks.filter("size(slabs) = 1").selectExpr(*keys, "slabs[0] AS s").selectExpr(*keys, "0L AS part", box, "1L AS components", "0L AS holes")

    def work(owner, flat, table):
        components, holes = shapes.topology(owner, matrix(flat), len(table))
        mask, part, rows = shapes.components(owner, matrix(flat))
        first = np.concatenate([[0], np.cumsum(components)])[:-1]
        number = first[mask] + part  # components of the slice, numbered through
        hole_number, hole_rows = shapes.holes(number, rows)
        ring, points = shapes.outlines(np.concatenate([number, hole_number]), np.concatenate([rows, hole_rows]))
        row, part = shapes.spans(np.zeros(len(table), np.int64), components)
        return (part, point_lists(ring, points, len(row)), components[row], holes[row]), row

    more = per_batch(masks.filter("size(slabs) > 1"), "slabs", list(keys), f"part bigint, points {POINTS}, components bigint, holes bigint", work)
    return one.unionByName(more)
