"""Aggregations, numbering, sets and bounded selections (AGG-*, WIN-*, LIM-*, SET-*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A, masks as M, predicates as P, sets as S, tiling as TL, windows as W
from .mask_queries import slabs
from .registry import query
from .review_queries import (ACTIVE_CLASSES, DISPOSITION, ISSUES, TRAINING_ROWS, export_images_sql, export_objects_sql,
                             exported_sql, round_members)
from .tiling_queries import DEFAULT_SQL, HITS, TRAINING_SQL

SPLIT = "CASE WHEN role = 'validation' THEN 'val' WHEN role = 'test' THEN 'test' ELSE 'train' END"


def summary_sql(mode):
    img, obj, out = export_images_sql(mode), export_objects_sql(mode), exported_sql(mode)
    return f"""
SELECT 'scope_image_count' AS metric, CAST(NULL AS STRING) AS key, count(*) AS value FROM ({img}) i
UNION ALL SELECT 'image_count', NULL, count(*) FILTER (WHERE reason IS NULL) FROM ({img}) i
UNION ALL SELECT 'incomplete_image_count', NULL, count(*) FILTER (WHERE reason IS NULL AND NOT complete) FROM ({img}) i
UNION ALL SELECT 'annotation_count', NULL, count(*) FROM ({out}) o
UNION ALL SELECT 'draft_count', NULL, count(*) FILTER (WHERE status <> 'accepted') FROM ({out}) o
UNION ALL SELECT 'box_count', NULL, count(*) FILTER (WHERE geom_type = 'box') FROM ({out}) o
UNION ALL SELECT 'class_count', c.class_id, count(o.annotation_id) FROM {{classes}} c LEFT JOIN ({out}) o ON o.class_id = c.class_id WHERE NOT c.archived GROUP BY c.class_id
UNION ALL SELECT 'split_count', s.split, count(i.image_id) FROM (SELECT 'train' AS split UNION ALL SELECT 'val' UNION ALL SELECT 'test') s
          LEFT JOIN (SELECT *, {SPLIT} AS split FROM ({img}) q WHERE reason IS NULL) i ON i.split = s.split GROUP BY s.split
UNION ALL SELECT 'excluded', reason, count(*) FROM ({img}) i WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'excluded', object_reason, count(*) FROM ({obj}) o WHERE object_reason IS NOT NULL GROUP BY object_reason
UNION ALL SELECT 'leaking_groups', NULL, count(*) FROM (SELECT group_id FROM ({img}) i WHERE reason IS NULL GROUP BY group_id HAVING count(DISTINCT {SPLIT}) > 1) g"""


@query("agg_01", summary_sql("labeled"))
def agg_01(v):
    return A.export_summary(v.images, v.annotations, v.classes, "labeled")


@query("agg_02", f"""
WITH s AS ({summary_sql('labeled')}),
n AS (SELECT coalesce(sum(value) FILTER (WHERE metric = 'image_count'), 0) AS images, coalesce(sum(value) FILTER (WHERE metric = 'annotation_count'), 0) AS annotations,
        coalesce(sum(value) FILTER (WHERE metric = 'box_count'), 0) AS boxes, coalesce(sum(value) FILTER (WHERE metric = 'split_count' AND key = 'val'), 0) AS val, count(*) FILTER (WHERE metric = 'class_count') AS classes,
        coalesce(sum(value) FILTER (WHERE metric = 'leaking_groups'), 0) AS leaks, coalesce(sum(value) FILTER (WHERE metric = 'excluded' AND key = 'unassigned_or_archived_class_objects'), 0) AS unassigned FROM s),
f AS (SELECT unnest(['coco', 'yolo_seg', 'yolo_box', 'voc', 'labelme', 'png']) AS format)
SELECT format, level, code FROM (
  SELECT format, 'error' AS level, 'no_active_class' AS code, classes = 0 AS holds FROM f, n UNION ALL SELECT format, 'error', 'no_eligible_image', images = 0 FROM f, n
  UNION ALL SELECT format, 'error', 'boxes_are_not_segmentation', format = 'yolo_seg' AND boxes > 0 FROM f, n
  UNION ALL SELECT format, 'error', 'box_conversion_needs_consent', format = 'voc' OR (format = 'yolo_box' AND annotations > boxes) FROM f, n
  UNION ALL SELECT format, 'error', 'semantic_plane_needs_consent', format = 'png' FROM f, n UNION ALL SELECT format, 'warning', 'includes_drafts', true FROM f, n
  UNION ALL SELECT format, 'warning', 'objects_without_class_omitted', unassigned > 0 FROM f, n UNION ALL SELECT format, 'warning', 'images_not_included', true FROM f, n
  UNION ALL SELECT format, 'warning', 'no_validation_images', val = 0 FROM f, n UNION ALL SELECT format, 'warning', 'groups_span_splits', leaks > 0 FROM f, n
  UNION ALL SELECT format, 'warning', 'polygon_conversion_checked_on_write', format IN ('yolo_seg', 'labelme') FROM f, n) q WHERE holds""")
def agg_02(v):
    """All gates of all six formats from one summary, label planes in their semantic form."""
    summary = A.export_summary(v.images, v.annotations, v.classes, "labeled")
    return A.all_gates(summary, "labeled", plane_variant="semantic").select("format", "level", "code")


FRAGMENTS = f"""
SELECT h.image_id, h.tile_idx FROM ({HITS % TRAINING_SQL}) h JOIN ({TRAINING_ROWS}) t ON t.annotation_id = h.annotation_id
WHERE t.class_ok AND t.geom_type <> 'box'"""
TSPLIT = "CASE WHEN role = 'validation' THEN 'val' ELSE 'train' END"

READINESS = f"""
WITH inc AS (SELECT *, {TSPLIT} AS split FROM ({DISPOSITION}) d WHERE reason IS NULL), sp AS (SELECT 'train' AS split UNION ALL SELECT 'val'),
tr AS ({TRAINING_ROWS}), ac AS (SELECT class_id FROM {{classes}} WHERE NOT archived), r AS (
SELECT 'images' AS metric, sp.split AS key, count(inc.image_id) AS value FROM sp LEFT JOIN inc ON inc.split = sp.split GROUP BY sp.split
UNION ALL SELECT 'instances_per_class', ac.class_id, count(tr.annotation_id) FROM ac LEFT JOIN tr ON tr.class_id = ac.class_id AND tr.geom_type <> 'box' GROUP BY ac.class_id
UNION ALL SELECT 'training_instances_per_class', ac.class_id, count(tr.annotation_id) FROM ac LEFT JOIN tr ON tr.class_id = ac.class_id AND tr.role IN ('pool', 'train') GROUP BY ac.class_id
UNION ALL SELECT 'negative_images', NULL, count(*) FROM inc WHERE image_id NOT IN (SELECT image_id FROM {{annotations}} WHERE status = 'accepted')
UNION ALL SELECT 'error', reason, count(*) FROM ({ISSUES}) i GROUP BY reason
UNION ALL SELECT 'excluded', reason, count(*) FROM ({DISPOSITION}) d WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'error', 'related_groups_span_training_and_validation', n FROM (SELECT count(*) AS n FROM (SELECT group_id FROM inc GROUP BY group_id HAVING count(DISTINCT split) > 1) g) q WHERE n > 0
UNION ALL SELECT 'warning_class_without_training_instance', class_id, 1 FROM ac WHERE class_id NOT IN (SELECT class_id FROM tr WHERE role IN ('pool', 'train') AND class_id IS NOT NULL)
UNION ALL SELECT 'excluded_annotations', NULL, count(*) FROM {{annotations}} WHERE training_excluded
UNION ALL SELECT 'tiles', sp.split, count(t.tile_idx) FROM sp LEFT JOIN inc ON inc.split = sp.split LEFT JOIN ({TRAINING_SQL}) t ON t.image_id = inc.image_id GROUP BY sp.split
UNION ALL SELECT 'tile_instances', sp.split, count(f.tile_idx) FROM sp LEFT JOIN inc ON inc.split = sp.split LEFT JOIN ({FRAGMENTS}) f ON f.image_id = inc.image_id GROUP BY sp.split)
SELECT * FROM r UNION ALL SELECT 'ready', NULL, CAST(count(*) FILTER (WHERE metric = 'error') = 0 AS BIGINT) FROM r"""


@query("agg_03", READINESS)
def agg_03(v):
    """Readiness report of a cumulative round, with tile counts."""
    members = round_members(v)
    rows = P.countable_instances(P.training_rows(v.images, v.annotations, v.classes, members))
    fragments = TL.tiles_hit(rows, TL.TRAINING).select("image_id", "tile_idx")
    return A.readiness(v.images, v.annotations, v.classes, members, fragments=fragments)


@query("agg_04", f"""
SELECT image_id FROM ({DISPOSITION}) d WHERE reason IS NULL AND image_id NOT IN (SELECT image_id FROM {{annotations}} WHERE status = 'accepted')""")
def agg_04(v):
    included = P.training_disposition(v.images, v.annotations, round_members(v)).filter("reason IS NULL")
    return included.join(v.annotations.filter("status = 'accepted'"), "image_id", "left_anti").select("image_id")


@query("agg_05", """
SELECT i.image_id, count(*) FILTER (WHERE status = 'draft') AS draft, count(*) FILTER (WHERE status = 'proposal') AS proposal,
  count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'superseded') AS superseded,
  count(*) FILTER (WHERE class_id IS NULL AND status NOT IN ('rejected', 'superseded')) AS unassigned
FROM {images} i LEFT JOIN {annotations} a ON a.image_id = i.image_id GROUP BY i.image_id""")
def agg_05(v):
    return A.status_counts(v.images, v.annotations)


@query("agg_06", f"""
SELECT i.image_id, count(*) FILTER (WHERE status IN ('draft', 'proposal')) AS pending, count(*) FILTER (WHERE status = 'accepted') AS accepted,
  count(*) FILTER (WHERE status NOT IN ('rejected', 'superseded') AND (class_id IS NULL OR class_id NOT IN {ACTIVE_CLASSES})) AS unlabeled,
  count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status NOT IN ('rejected', 'superseded')) = 0 AS negative,
  max(i.role) IN ('pool', 'train', 'validation') AS eligible_role
FROM {{images}} i LEFT JOIN {{annotations}} a ON a.image_id = i.image_id GROUP BY i.image_id""")
def agg_06(v):
    return A.review_plan(v.images, v.annotations, v.classes)


@query("agg_07", "SELECT role, count(*) AS images, count(*) FILTER (WHERE complete) AS reviewed FROM {images} WHERE NOT removed GROUP BY role")
def agg_07(v):
    return A.role_counts(v.images)


@query("agg_08", """
SELECT c.class_id, count(a.annotation_id) AS annotations FROM {classes} c LEFT JOIN (SELECT a.* FROM {annotations} a JOIN {images} i ON a.image_id = i.image_id WHERE NOT i.removed) a
ON a.class_id = c.class_id GROUP BY c.class_id""")
def agg_08(v):
    return A.class_impact(v.images, v.annotations, v.classes)


@query("agg_09", """
SELECT image_id, count(*) AS parents, CASE WHEN count(DISTINCT class_id) = 1 THEN min(class_id) END AS proposed_class_id,
       count(DISTINCT class_id) > 1 AS class_conflict, bool_or(class_id IS NULL) AS has_unassigned_parent
FROM {annotations} WHERE status NOT IN ('rejected', 'superseded') GROUP BY image_id""")
def agg_09(v):
    return A.merge_preview(v.annotations.filter(P.LIVE), "image_id")


@query("agg_11", f"""
SELECT image_id, count(*) AS total_tiles, count(*) FILTER (WHERE done) AS completed_tiles, CASE WHEN bool_and(done) THEN 'complete' WHEN NOT bool_or(done) THEN 'running' ELSE 'partial' END AS status
FROM (SELECT image_id, image_id % 3 <> 0 OR tile_idx % 2 = 0 AS done FROM ({DEFAULT_SQL}) t) q GROUP BY image_id""")
def agg_11(v):
    tiles = TL.all_tiles(v.images)
    return A.layer_coverage(tiles, tiles.filter("image_id % 3 <> 0 OR tile_idx % 2 = 0"))


@query("agg_12", f"""
SELECT timing, CAST(round(sum(seconds), 6) AS DOUBLE) AS seconds, count(*) AS tiles FROM (
  SELECT 'encode_seconds' AS timing, tile_idx * 0.25 AS seconds FROM ({DEFAULT_SQL}) t UNION ALL SELECT 'mask_seconds', (image_id % 8) * 0.5 FROM ({DEFAULT_SQL}) t) q GROUP BY timing""")
def agg_12(v):
    receipts = TL.all_tiles(v.images).select(F.expr(
        "map('encode_seconds', CAST(tile_idx * 0.25 AS DOUBLE), 'mask_seconds', CAST((image_id % 8) * 0.5 AS DOUBLE), 'cold_loads', 1.0D)").alias("timings"))
    return A.timing_rollup(receipts).withColumn("seconds", F.round("seconds", 6))


@query("agg_15", """
SELECT i.p AS project_id, i.n AS images, coalesce(a.n, 0) AS annotations, coalesce(r.n, 0) AS rounds, coalesce(r.active, false) AS blocked
FROM (SELECT image_id % 7 AS p, count(*) AS n FROM {images} GROUP BY 1) i LEFT JOIN (SELECT image_id % 7 AS p, count(*) AS n FROM {annotations} GROUP BY 1) a ON a.p = i.p
LEFT JOIN (SELECT image_id % 7 AS p, count(DISTINCT round_number) AS n, bool_or(status = 'in_progress') AS active FROM {rounds} GROUP BY 1) r ON r.p = i.p""")
def agg_15(v):
    return A.project_footprint(v.images, v.annotations, v.rounds, "image_id % 7")


@query("agg_16", """
SELECT class_id, CASE WHEN count(*) FILTER (WHERE logit > -1) = 0 THEN 0 ELSE round(count(*) FILTER (WHERE logit > 1) / CAST(count(*) FILTER (WHERE logit > -1) AS DOUBLE), 6) END AS stability
FROM (SELECT class_id, score * 8 - 6 AS logit FROM {annotations} WHERE class_id IS NOT NULL) q GROUP BY class_id""")
def agg_16(v):
    logits = v.annotations.filter("class_id IS NOT NULL").selectExpr("class_id", "score * 8 - 6 AS logit")
    return A.stability(logits, "class_id").withColumn("stability", F.round("stability", 6))


AFTER = "SELECT annotation_id, CASE WHEN s_key % 10 = 0 THEN revision + 1 ELSE revision END AS revision FROM {annotations} WHERE line % 5 <> 0"
BEFORE = "SELECT annotation_id, revision FROM {annotations} WHERE p_key % 6 <> 0"


@query("agg_17", f"""
SELECT coalesce(a.annotation_id, b.annotation_id) AS annotation_id, a.revision AS old_revision, b.revision AS new_revision,
       CASE WHEN a.annotation_id IS NULL THEN 'added' WHEN b.annotation_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM ({BEFORE}) a FULL JOIN ({AFTER}) b ON a.annotation_id = b.annotation_id WHERE a.annotation_id IS NULL OR b.annotation_id IS NULL OR a.revision <> b.revision""")
def agg_17(v):
    return A.snapshot_diff(v.sql(BEFORE), v.sql(AFTER))


@query("win_01", """
SELECT class_id, CAST(row_number() OVER (ORDER BY ord, class_id) - 1 AS BIGINT) AS zero_based, CAST(row_number() OVER (ORDER BY ord, class_id) AS BIGINT) AS one_based
FROM {classes} WHERE NOT archived""")
def win_01(v):
    zero = W.class_index(v.classes, 0)
    return zero.selectExpr("class_id", "class_index AS zero_based", "class_index + 1 AS one_based")


POOL = "role = 'pool' AND NOT removed"


@query("win_02", f"""
SELECT image_id, CAST(ntile(7) OVER (ORDER BY image_id) AS BIGINT) AS by_import,
       CAST(ntile(11) OVER (ORDER BY sha256('42:' || CAST(image_id AS VARCHAR)), image_id) AS BIGINT) AS by_shuffle FROM {{images}} WHERE {POOL}""")
def win_02(v):
    pool = v.images.filter(POOL)
    a = W.plan_rounds(pool, 7).selectExpr("image_id", "round_number AS by_import")
    b = W.plan_rounds(pool, 11, order="shuffle").selectExpr("image_id", "round_number AS by_shuffle")
    return a.join(b, "image_id")


@query("win_03", f"""
SELECT image_id, round_number, true AS locked FROM {{rounds}} WHERE status <> 'planned'
UNION ALL SELECT image_id, CAST(ntile(5) OVER (ORDER BY image_id) AS BIGINT) + (SELECT count(DISTINCT round_number) FROM {{rounds}} WHERE status <> 'planned'), false
FROM {{images}} WHERE {POOL} AND image_id NOT IN (SELECT image_id FROM {{rounds}} WHERE status <> 'planned')""")
def win_03(v):
    return W.replan_rounds(v.images, v.rounds, 5)


@query("win_04", f"SELECT image_id, max(tile_idx) AS last_idx, arg_max(x0, tile_idx) AS x0, arg_max(y0, tile_idx) AS y0 FROM ({DEFAULT_SQL}) t GROUP BY image_id")
def win_04(v):
    return TL.all_tiles(v.images).groupBy("image_id").agg(
        F.max("tile_idx").alias("last_idx"), F.max_by("x0", "tile_idx").alias("x0"), F.max_by("y0", "tile_idx").alias("y0"))


LABEL_ROWS = """
SELECT image_id, class_id AS class_index, annotation_id AS row, CAST(CAST(x0 AS DOUBLE) / width AS FLOAT) AS minx, CAST(CAST(x1 AS DOUBLE) / width AS FLOAT) AS maxx,
       CAST(CAST(y0 AS DOUBLE) / height AS FLOAT) AS miny, CAST(CAST(y1 AS DOUBLE) / height AS FLOAT) AS maxy FROM {annotations} WHERE class_id IS NOT NULL"""


@query("win_07", f"""
SELECT image_id, class_index, first_row, row FROM (
  SELECT *, min(row) OVER (PARTITION BY image_id, class_index, cx, cy, w, h) AS first_row FROM (
    SELECT image_id, class_index, row, (minx + maxx) / CAST(2 AS FLOAT) AS cx, (miny + maxy) / CAST(2 AS FLOAT) AS cy, maxx - minx AS w, maxy - miny AS h FROM ({LABEL_ROWS}) l) k) q
WHERE row > first_row""")
def win_07(v):
    return W.yolo_collisions(v.sql(LABEL_ROWS))


@query("win_08", """
WITH e AS (SELECT image_id, CASE WHEN NOT complete AND missing IS NULL AND role <> 'excluded' THEN image_id END AS t FROM {images}), f AS (SELECT min(t) AS first FROM e),
n AS (SELECT image_id, min(t) OVER (ORDER BY image_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM e)
SELECT image_id, coalesce(nxt, CASE WHEN f.first <> image_id THEN f.first END) AS next_image_id FROM n, f""")
def win_08(v):
    return W.next_review(v.images, block=1000)


ROUND_NO = "row_number() OVER (ORDER BY image_id)"


@query("win_11", """
SELECT annotation_id, row_number() OVER (ORDER BY image_id, annotation_id) AS export_id FROM {annotations} WHERE class_id IS NOT NULL""")
def win_11(v):
    rows = v.annotations.filter("class_id IS NOT NULL").select("image_id", "annotation_id")
    return W.dense_ids(rows, ["image_id", "annotation_id"], "export_id").drop("image_id")


@query("lim_01", """
SELECT image_id, annotation_id, CAST(row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, annotation_id) AS BIGINT) AS rank FROM {annotations}""")
def lim_01(v):
    """Rank inside an image and class by counting better rows of sorted order, without one task per hot key."""
    return W.rank_within(v.annotations, ["image_id", "class_id"], [F.desc("score"), F.asc("annotation_id")]).select("image_id", "annotation_id", "rank")


SEAM_ROWS = "annotation_id, image_id, (tx0 > 0 AND x0 <= tx0 + 1) OR (ty0 > 0 AND y0 <= ty0 + 1) OR (tx1 < width AND x1 >= tx1 - 1) OR (ty1 < height AND y1 >= ty1 - 1) AS seam"


@query("lim_02", f"""
SELECT group_id, annotation_id, row_number() OVER (PARTITION BY group_id ORDER BY annotation_id) > 3 AS deferred
FROM (SELECT a.annotation_id, i.group_id FROM (SELECT {SEAM_ROWS} FROM {{annotations}}) a JOIN {{images}} i ON a.image_id = i.image_id WHERE seam) q""")
def lim_02(v):
    seams = v.annotations.filter(P.touches_seam()).join(v.images.select("image_id", "group_id"), "image_id").select("group_id", "annotation_id")
    return S.limit_repairs(seams, "group_id", "annotation_id", 3).select("group_id", "annotation_id", "deferred")


@query("lim_03", """
SELECT image_id, layer_id, count(*) AS proposals FROM (SELECT DISTINCT image_id, layer_id, signature FROM (
  SELECT image_id, layer_id, signature FROM {tombstones} UNION ALL SELECT image_id, layer_id, signature FROM {candidates}) u) q GROUP BY 1, 2 HAVING count(*) > 4""")
def lim_03(v):
    return S.guard_max(v.tombstones, v.candidates, ["image_id", "layer_id"], 4)


MANUAL = "SELECT CASE WHEN image_id % 97 = 0 THEN image_id + 1 ELSE image_id END AS image_id FROM {images} WHERE role = 'pool' AND NOT removed AND image_id % 89 <> 0"


@query("lim_04", f"""
WITH m AS (SELECT image_id, count(*) AS n FROM ({MANUAL}) q GROUP BY 1), p AS (SELECT image_id FROM {{images}} WHERE {POOL})
SELECT coalesce(p.image_id, m.image_id) AS image_id, CASE WHEN m.image_id IS NULL THEN 'missing' WHEN p.image_id IS NULL THEN 'foreign' ELSE 'repeated' END AS issue
FROM p FULL JOIN m ON m.image_id = p.image_id WHERE m.image_id IS NULL OR p.image_id IS NULL OR m.n > 1""")
def lim_04(v):
    return W.permutation_issues(v.images.filter(POOL), v.sql(MANUAL))


@query("lim_05", """
SELECT image_id, arg_min(annotation_id, struct_pack(s := -score, o := annotation_id)) AS best_id, count(*) - 1 AS alternatives FROM {annotations} GROUP BY image_id""")
def lim_05(v):
    rows = v.annotations.selectExpr("image_id", "annotation_id AS id", "score", "annotation_id AS ordinal")
    return S.split_best(rows, "image_id")


@query("set_01", """
SELECT status, review_actor, training_excluded, count(*) AS n FROM (
  SELECT status, review_actor, training_excluded FROM {annotations} UNION ALL SELECT 'draft', NULL, false FROM {annotations} WHERE line = 2) q GROUP BY 1, 2, 3""")
def set_01(v):
    rows = v.annotations.filter("line = 2").select("annotation_id", "image_id", "class_id", "x0", "y0", "x1", "y1")
    out = S.append_unreviewed(v.annotations, rows)
    return out.groupBy("status", "review_actor", "training_excluded").agg(F.count("*").alias("n"))


@query("set_02", """
SELECT 'group' AS kind, group_id AS key FROM {images} WHERE role IN ('pool', 'train') INTERSECT SELECT 'group', group_id FROM {images} WHERE role = 'validation'
UNION ALL (SELECT 'sha256', sha256 FROM {images} WHERE role IN ('pool', 'train') INTERSECT SELECT 'sha256', sha256 FROM {images} WHERE role = 'validation')""")
def set_02(v):
    train, val = v.images.filter("role IN ('pool', 'train')"), v.images.filter("role = 'validation'")
    return (S.common(train, val, "group_id").selectExpr("'group' AS kind", "group_id AS key")
            .unionByName(S.common(train, val, "sha256").selectExpr("'sha256' AS kind", "sha256 AS key")))


@query("set_03", f"SELECT image_id, tile_idx FROM ({DEFAULT_SQL}) t WHERE NOT (image_id % 3 <> 0 OR tile_idx % 2 = 0)")
def set_03(v):
    tiles = TL.all_tiles(v.images).select("image_id", "tile_idx")
    return S.missing(tiles, tiles.filter("image_id % 3 <> 0 OR tile_idx % 2 = 0"), ["image_id", "tile_idx"])


@query("set_04", """
SELECT 'only_left' AS side, image_id, layer_id, signature FROM (SELECT image_id, layer_id, signature FROM {candidates} EXCEPT ALL SELECT image_id, layer_id, signature FROM {candidates} WHERE score > 0.92) q""")
def set_04(v):
    rows = v.candidates.select("image_id", "layer_id", "signature", "score")
    return S.same_rows(rows.drop("score"), rows.filter("score > 0.92").drop("score"))


@query("set_05", "SELECT DISTINCT image_id FROM {annotations} WHERE image_id NOT IN (SELECT image_id FROM {images} WHERE NOT removed)")
def set_05(v):
    return S.not_subset(v.annotations, v.images.filter("NOT removed").select("image_id"), "image_id")


@query("set_06", """
SELECT image_id, CAST(sum(area) AS BIGINT) AS sum_area, CAST(sum(CASE WHEN status = 'accepted' THEN area ELSE 0 END) AS BIGINT) AS accepted_area FROM {annotations} GROUP BY image_id""")
def set_06(v):
    """OR and AND account for each other: |A| + |B| = |A or B| + |A and B| per image """
    union = M.mask_stats(M.mask_union(slabs(v), "image_id"), "image_id").selectExpr("image_id", "area AS either")
    return union.join(covered_depth(v), "image_id").selectExpr("image_id", "either + extra AS sum_area", "accepted_area")


def covered_depth(v):
    """Pixels counted above once per image, from the painter's cover counts."""
    from .mask_queries import paint_slabs
    painted = W.paint(paint_slabs(v), "first", exact_cover=True)
    extra = painted.groupBy("image_id").agg(F.sum(F.expr("(covering - 1) * (x1 - x0) * (y1 - y0)")).alias("extra"))
    accepted = v.annotations.groupBy("image_id").agg(F.sum(F.expr("CASE WHEN status = 'accepted' THEN area ELSE 0 END")).alias("accepted_area"))
    return extra.join(accepted, "image_id")
