"""Tile plans and label fragments (TILE-*, JOIN-04, JOIN-05, MASK-07, flagship)."""
from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import masks as M, predicates as P, tiling as TL, windows as W
from .registry import query
from .review_queries import DISPOSITION, round_members


def plan_sql(size_x, stride_x, size_y=None, stride_y=None, source="{images}"):
    size_y, stride_y = size_y or size_x, stride_y or stride_x
    return f"""
SELECT image_id, width, height, ix, iy, x0, y0, least(x0 + {size_x}, width) AS x1, least(y0 + {size_y}, height) AS y1,
       CAST(row_number() OVER (PARTITION BY image_id ORDER BY y0, x0) - 1 AS BIGINT) AS tile_idx
FROM (SELECT image_id, width, height, ix, iy, least(ix * {stride_x}, greatest(0, width - {size_x})) AS x0, least(iy * {stride_y}, greatest(0, height - {size_y})) AS y0
      FROM (SELECT image_id, width, height, ix, unnest(range(CAST(floor(greatest(0, height - {size_y}) / {stride_y}) AS BIGINT) + 1
                   + CASE WHEN greatest(0, height - {size_y}) % {stride_y} <> 0 THEN 1 ELSE 0 END)) AS iy
            FROM (SELECT image_id, width, height, unnest(range(CAST(floor(greatest(0, width - {size_x}) / {stride_x}) AS BIGINT) + 1
                         + CASE WHEN greatest(0, width - {size_x}) % {stride_x} <> 0 THEN 1 ELSE 0 END)) AS ix FROM {source}) a) b) c"""


DEFAULT_SQL, TRAINING_SQL = plan_sql(512, 384), plan_sql(512, 512)
BOX = ("image_id", "tile_idx", "x0", "y0", "x1", "y1")


@query("tile_01", f"SELECT image_id, tile_idx, x0, y0, x1, y1 FROM ({DEFAULT_SQL}) t")
def tile_01(v):
    return TL.all_tiles(v.images).select(*BOX)


@query("tile_02", f"""
SELECT '640x384@12.5%' AS plan, count(*) AS tiles, CAST(sum(x1 - x0) AS BIGINT) AS sum_w, CAST(sum(y1 - y0) AS BIGINT) AS sum_h FROM ({plan_sql(640, 560, 384, 336)}) t
UNION ALL SELECT '300x200@7px', count(*), CAST(sum(x1 - x0) AS BIGINT), CAST(sum(y1 - y0) AS BIGINT) FROM ({plan_sql(300, 293, 200, 189)}) t
UNION ALL SELECT 'whole', count(*), CAST(sum(width) AS BIGINT), CAST(sum(height) AS BIGINT) FROM {{images}}""")
def tile_02(v):
    plans = {"640x384@12.5%": TL.resolve_tiling(preset="custom", width=640, height=384, overlap_x=12.5, overlap_y=12.5),
             "300x200@7px": TL.resolve_tiling(preset="custom", width=300, height=200, overlap_mode="pixels",
                                              overlap_x=7, overlap_y=11),
             "whole": TL.resolve_tiling(mode="whole")}
    out = None
    for name, tiling in plans.items():
        part = TL.all_tiles(v.images, tiling).agg(
            F.lit(name).alias("plan"), F.count("*").alias("tiles"),
            F.sum(F.expr("x1 - x0")).alias("sum_w"), F.sum(F.expr("y1 - y0")).alias("sum_h"))
        out = part if out is None else out.unionByName(part)
    return out


@query("tile_03", f"""
SELECT image_id, count(*) AS tile_count, count(*) > 600 AS rejected FROM ({plan_sql(64, 48)}) t GROUP BY image_id""")
def tile_03(v):
    tiling = TL.resolve_tiling(preset="custom", width=64, height=64)
    counted = TL.tile_count(v.images, tiling).select("image_id", "tile_count")
    rejects = TL.plan_tiles(v.images, tiling, max_tiles=600)[1].select("image_id", F.lit(True).alias("r"))
    return counted.join(rejects, "image_id", "left").select("image_id", "tile_count", F.expr("r IS NOT NULL").alias("rejected"))


@query("tile_04", f"SELECT image_id, tile_idx, x0, y0, x1, y1 FROM ({plan_sql(1024, 896)}) t")
def tile_04(v):
    return TL.all_tiles(v.images, TL.square_tiling()).select(*BOX)


@query("tile_05", f"""
SELECT image_id, tile_idx, x0, y0, 512 - (x1 - x0) AS pad_right, 512 - (y1 - y0) AS pad_bottom FROM ({TRAINING_SQL}) t""")
def tile_05(v):
    return TL.all_tiles(v.images, TL.TRAINING, padded=True).select("image_id", "tile_idx", "x0", "y0", "pad_right", "pad_bottom")


_CONFIG = json.dumps(TL.DEFAULT.canonical(), sort_keys=True, separators=(",", ":"))
_PADDED = json.dumps(TL.TRAINING.canonical(), sort_keys=True, separators=(",", ":"))


def _hash_sql(config, tail):
    config = config.replace("{", "<<").replace("}", ">>")
    text = (f"""'<<"config":{config},"image":<<"height":' || CAST(height AS VARCHAR) || ',"sha256":"' || sha256 || '","width":' """
            f"""|| CAST(width AS VARCHAR) || '>>{tail}>>'""")
    return f"sha256({text.replace('<<', chr(123)).replace('>>', chr(125))})"


_PLAN = ',"policy":"edge_aligned_no_padding/v1","schema_version":1'
_PAD = ',"processing_policy":"tiles512_constant_bottom_right/v1"'


@query("tile_06", f"""
SELECT image_id, {_hash_sql(_CONFIG, _PLAN)} AS plan_hash, {_hash_sql(_PADDED, _PAD)} AS padded_hash,
       'tile-' || {_hash_sql(_CONFIG, _PLAN)} || '-00000' AS first_tile FROM {{images}}""")
def tile_06(v):
    return v.images.selectExpr("image_id", TL.plan_hash_expr(TL.DEFAULT, sha256="sha256") + " AS plan_hash",
                               TL.plan_hash_expr(TL.TRAINING, padded=True, sha256="sha256") + " AS padded_hash") \
        .withColumn("first_tile", F.format_string("tile-%s-%05d", "plan_hash", F.lit(0)))


@query("tile_07", f"""
SELECT t.image_id, count(*) AS tile_count,
       CAST(max(width) * max(height) - count(DISTINCT CASE WHEN false THEN 1 END) - max(covered) AS BIGINT) AS uncovered,
       max(x1) FILTER (WHERE tile_idx = last_idx) = max(width) AND max(y1) FILTER (WHERE tile_idx = last_idx) = max(height) AS ends_at_corner
FROM (SELECT *, max(tile_idx) OVER (PARTITION BY image_id) AS last_idx FROM ({DEFAULT_SQL}) q) t
JOIN (SELECT image_id, sum(cx) FILTER (WHERE k = 'x') * sum(cx) FILTER (WHERE k = 'y') AS covered FROM (
        SELECT image_id, 'x' AS k, least(x1, coalesce(lead(x0) OVER (PARTITION BY image_id ORDER BY x0), x1)) - x0 AS cx
        FROM (SELECT DISTINCT image_id, x0, x1 FROM ({DEFAULT_SQL}) q) d
        UNION ALL
        SELECT image_id, 'y', least(y1, coalesce(lead(y0) OVER (PARTITION BY image_id ORDER BY y0), y1)) - y0
        FROM (SELECT DISTINCT image_id, y0, y1 FROM ({DEFAULT_SQL}) q) d) g GROUP BY image_id) c ON c.image_id = t.image_id
GROUP BY t.image_id""")
def tile_07(v):
    return TL.tile_coverage(TL.all_tiles(v.images))


HITS = f"""
SELECT a.annotation_id, a.image_id, a.class_id, t.tile_idx, t.x0 AS tile_x0, t.y0 AS tile_y0, t.x1 AS tile_x1, t.y1 AS tile_y1,
       a.x0, a.y0, a.x1, a.y1, a.width, a.height
FROM {{annotations}} a JOIN (%s) t
  ON a.image_id = t.image_id AND a.x0 < t.x1 AND a.x1 > t.x0 AND a.y0 < t.y1 AND a.y1 > t.y0"""


@query("join_04", f"SELECT annotation_id, tile_idx FROM ({HITS % DEFAULT_SQL}) h")
def join_04(v):
    return TL.tiles_hit(v.annotations).select("annotation_id", "tile_idx")


CLIPPED = f"""
SELECT annotation_id, tile_idx, greatest(x0, tile_x0) - tile_x0 AS x0, least(x1, tile_x1) - tile_x0 AS x1,
       greatest(y0, tile_y0) - tile_y0 AS y0, least(y1, tile_y1) - tile_y0 AS y1 FROM ({HITS % TRAINING_SQL}) h"""


@query("join_05", CLIPPED)
def join_05(v):
    return M.crop(TL.tiles_hit(v.annotations, TL.TRAINING)).select("annotation_id", "tile_idx", "x0", "x1", "y0", "y1")


@query("mask_07", f"""
SELECT annotation_id, tile_idx, CAST((x1 - x0) * (y1 - y0) AS BIGINT) AS area, x0 AS bx0, y0 AS by0, x1 AS bx1, y1 AS by1
FROM ({CLIPPED}) c""")
def mask_07(v):
    """Crop masks to training tiles at slab level, then measure the fragments."""
    ann = v.annotations
    slabs = M.boxes_to_slabs(ann, "image_id", "annotation_id", "width", "height")
    pieces = M.crop(TL.tiles_hit(slabs, TL.TRAINING))
    return M.mask_stats(pieces, "annotation_id", "tile_idx")


@query("mask_08", f"""
SELECT annotation_id, tile_idx, greatest(x0, tile_x0) AS bx0, least(x1, tile_x1) AS bx1, greatest(y0, tile_y0) AS by0, least(y1, tile_y1) AS by1,
       CAST((least(x1, tile_x1) - greatest(x0, tile_x0)) * (least(y1, tile_y1) - greatest(y0, tile_y0)) AS BIGINT) AS area
FROM ({HITS % TRAINING_SQL}) h""")
def mask_08(v):
    """Tile fragments with padding noise mapped back to the image: the padding is dropped."""
    slabs = M.boxes_to_slabs(v.annotations, "image_id", "annotation_id", "width", "height")
    local = M.crop(TL.tiles_hit(slabs, TL.TRAINING))
    noisy = local.withColumn("x1", F.expr("CASE WHEN x1 = tile_x1 - tile_x0 THEN x1 + 25 ELSE x1 END"))
    return M.mask_stats(M.map_to_image(noisy), "annotation_id", "tile_idx")


@query("tile_label_counts", f"""
SELECT CASE WHEN d.role = 'validation' THEN 'val' ELSE 'train' END AS split, h.image_id, h.tile_idx, c.class_index,
       count(*) AS fragments, count(*) FILTER (WHERE h.x0 < h.tile_x0 OR h.y0 < h.tile_y0 OR h.x1 > h.tile_x1 OR h.y1 > h.tile_y1) AS clipped
FROM ({HITS % TRAINING_SQL}) h
JOIN ({DISPOSITION}) d ON h.image_id = d.image_id AND d.reason IS NULL
JOIN (SELECT class_id, CAST(row_number() OVER (ORDER BY ord, class_id) - 1 AS BIGINT) AS class_index FROM {{classes}} WHERE NOT archived) c ON c.class_id = h.class_id
JOIN {{annotations}} a ON a.annotation_id = h.annotation_id AND a.status = 'accepted' AND NOT a.training_excluded AND a.geom_type <> 'box'
GROUP BY 1, 2, 3, 4""")
def tile_label_counts(v):
    """Label fragments per training tile, class and split, and how many are clipped."""
    rows = P.countable_instances(P.training_rows(v.images, v.annotations, v.classes, round_members(v)))
    hits = TL.tiles_hit(rows, TL.TRAINING).join(W.class_index(v.classes, base=0), "class_id")
    clipped = F.count_if(F.expr("x0 < tile_x0 OR y0 < tile_y0 OR x1 > tile_x1 OR y1 > tile_y1"))
    return (hits.groupBy(F.expr(P.training_split()).alias("split"), "image_id", "tile_idx", "class_index")
            .agg(F.count("*").alias("fragments"), clipped.alias("clipped")))
