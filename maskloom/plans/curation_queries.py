"""Review decisions as batch merges (CUR-*, HIST-01 / WIN-06)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation as C, history as H, joins as J, masks as M
from .mask_queries import SHAPE_RLE, slabs
from .registry import query
from .review_queries import ACTIVE_CLASSES


def sized_slabs(v):
    return slabs(v, "width", "height")


ASSIST = """(geom_type = 'mask' AND source_kind IN ('sam2', 'sam3') AND (coalesce(operation, '') = 'sam_assist' OR (operation IS NULL AND layer_id IS NULL)))"""

VERDICT = f"""
SELECT request_id, image_id, action, class_id, actor, n, CASE WHEN unknown_image THEN 'unknown_image' WHEN repeated THEN 'bad_selection' WHEN inactive THEN 'inactive_object' WHEN stale THEN 'stale_revision'
   WHEN action = 'assist_assign_accept' AND NOT confirm THEN 'confirm_needed' WHEN action = 'assist_assign_accept' AND not_assist THEN 'not_assist_drafts'
   WHEN action IN ('delete', 'reject') AND (n > 1 OR any_accepted) AND NOT confirm THEN 'confirm_needed'
   WHEN action LIKE '%assign%' AND NOT wanted_ok THEN 'inactive_class' WHEN action = 'accept' AND any_unassigned THEN 'class_needed' WHEN action = 'accept' AND any_archived THEN 'inactive_class' END AS reason
FROM (SELECT d.request_id, min(d.image_id) AS image_id, min(d.action) AS action, bool_and(d.confirm) AS confirm, min(d.class_id) AS class_id, min(d.actor) AS actor, count(*) AS n,
        bool_or(i.removed) AS unknown_image, count(*) > count(DISTINCT d.annotation_id) AS repeated, bool_or(d.expected_revision <> a.revision) AS stale,
        bool_or(a.status = 'superseded' OR (a.status = 'rejected' AND d.action <> 'delete')) AS inactive, bool_or(a.status <> 'draft' OR NOT {ASSIST}) AS not_assist,
        bool_or(a.status = 'accepted') AS any_accepted, bool_or(a.class_id IS NULL) AS any_unassigned, bool_or(a.class_id IS NOT NULL AND a.class_id NOT IN {ACTIVE_CLASSES}) AS any_archived,
        bool_and(d.class_id IN {ACTIVE_CLASSES}) AS wanted_ok
      FROM {{decisions}} d JOIN {{annotations}} a ON a.annotation_id = d.annotation_id JOIN {{images}} i ON i.image_id = d.image_id GROUP BY d.request_id) s"""


@query("cur_01", f"""
SELECT a.annotation_id, CASE WHEN d.action LIKE '%assign%' THEN d.class_id ELSE a.class_id END AS class_id,
  CASE WHEN d.action = 'assign' THEN 'draft' WHEN d.action LIKE '%accept' THEN 'accepted' WHEN d.action = 'reject' THEN 'rejected' ELSE a.status END AS status,
  a.revision + CASE WHEN d.action IS NULL THEN 0 ELSE 1 END AS revision, CASE WHEN d.action IS NULL THEN a.review_actor WHEN d.action LIKE '%accept' THEN d.actor END AS review_actor
FROM {{annotations}} a LEFT JOIN (SELECT q.annotation_id, q.action, q.class_id, q.actor FROM {{decisions}} q JOIN ({VERDICT}) w ON w.request_id = q.request_id WHERE w.reason IS NULL) d
  ON d.annotation_id = a.annotation_id WHERE coalesce(d.action, '') <> 'delete'""")
def cur_01(v):
    out = C.apply_selection(v.annotations, v.images, v.classes, v.decisions, sized_slabs(v))
    return out.annotations.select("annotation_id", "class_id", "status", "revision", "review_actor")


@query("cur_01_conflicts", f"SELECT request_id, reason FROM ({VERDICT}) w WHERE reason IS NOT NULL")
def cur_01_conflicts(v):
    return C.apply_selection(v.annotations, v.images, v.classes, v.decisions).conflicts


@query("cur_01_images", f"""
SELECT i.image_id, i.complete AND w.image_id IS NULL AS complete, CASE WHEN w.image_id IS NULL THEN i.review_actor END AS review_actor,
       i.revision + CASE WHEN w.image_id IS NULL THEN 0 ELSE 1 END AS revision
FROM {{images}} i LEFT JOIN (SELECT image_id FROM ({VERDICT}) z WHERE reason IS NULL) w ON w.image_id = i.image_id""")
def cur_01_images(v):
    out = C.apply_selection(v.annotations, v.images, v.classes, v.decisions, sized_slabs(v))
    return out.images.select("image_id", "complete", "review_actor", "revision")


# Every third generated mask of some shape is deleted; then all are generated again, without stored signatures.
REGENERATED = """
SELECT image_id AS request_id, image_id, annotation_id, CAST(NULL AS BIGINT) AS expected_revision, 'delete' AS action, CAST(NULL AS STRING) AS class_id, true AS confirm, 'human' AS actor
FROM {annotations} WHERE layer_id IS NOT NULL AND p_key % 3 = 0 AND status <> 'superseded'"""


@query("cur_01_regenerated", f"""
WITH d AS (SELECT r.annotation_id FROM ({REGENERATED}) r JOIN {{images}} i ON i.image_id = r.image_id WHERE NOT i.removed),
g AS (SELECT a.annotation_id, a.image_id, a.layer_id, array_to_string(r.counts, ',') AS counts FROM {{annotations}} a JOIN ({SHAPE_RLE}) r ON r.annotation_id = a.annotation_id WHERE a.layer_id IS NOT NULL)
SELECT g.annotation_id, NOT EXISTS (SELECT 1 FROM d JOIN g t ON t.annotation_id = d.annotation_id WHERE t.image_id = g.image_id AND t.layer_id = g.layer_id AND t.counts = g.counts) AS kept FROM g""")
def cur_01_regenerated(v):
    """Deleted masks of any shape stay away: their tombstones come from their pixels."""
    rows = v.annotations.withColumn("geom_type", F.lit("mask"))
    tombs = C.apply_selection(rows, v.images, v.classes, v.sql(REGENERATED), v.shapes).tombstones
    made = M.mask_signatures(v.shapes, "annotation_id").join(rows.filter("layer_id IS NOT NULL").select("annotation_id", "image_id", "layer_id"), "annotation_id")
    kept = J.drop_tombstoned(made, tombs)[0].select("annotation_id", F.lit(True).alias("kept"))
    return made.select("annotation_id").join(kept, "annotation_id", "left").select("annotation_id", F.coalesce("kept", F.lit(False)).alias("kept"))


MERGES = """
SELECT image_id AS request_id, image_id, annotation_id, revision AS expected_revision, image_id % 3 = 0 AS class_given,
       CASE WHEN image_id % 6 = 0 THEN 'Brand#2' END AS class_id, image_id % 4 = 0 AS accept, image_id % 11 <> 0 AS confirm, 'human' AS actor
FROM {annotations} WHERE status NOT IN ('rejected', 'superseded') AND line < 5"""

MERGE_VERDICT = f"""
SELECT *, CASE WHEN NOT confirm THEN 'confirm_needed' WHEN removed THEN 'unknown_image' WHEN repeated THEN 'bad_selection' WHEN n < 2 THEN 'parent_count' WHEN any_box THEN 'box_parent'
   WHEN classes > 1 AND NOT class_given THEN 'class_conflict' WHEN to_class IS NOT NULL AND to_class NOT IN {ACTIVE_CLASSES} THEN 'inactive_class' WHEN accept AND to_class IS NULL THEN 'class_needed' END AS reason
FROM (SELECT m.request_id, bool_and(m.confirm) AS confirm, bool_and(m.accept) AS accept, bool_or(i.removed) AS removed, count(*) > count(DISTINCT m.annotation_id) AS repeated, count(*) AS n, bool_or(a.geom_type = 'box') AS any_box,
   count(DISTINCT a.class_id) AS classes, bool_and(m.class_given) AS class_given,
   CASE WHEN bool_and(m.class_given) THEN min(m.class_id) WHEN count(DISTINCT a.class_id) = 1 THEN min(a.class_id) END AS to_class,
   min(a.x0) AS x0, min(a.y0) AS y0, max(a.x1) AS x1, max(a.y1) AS y1
 FROM ({MERGES}) m JOIN {{annotations}} a ON a.annotation_id = m.annotation_id JOIN {{images}} i ON i.image_id = m.image_id GROUP BY m.request_id) s"""


@query("cur_02", f"""
SELECT m.request_id, w.reason, CASE WHEN w.reason IS NULL THEN w.to_class END AS class_id, CASE WHEN w.reason IS NULL THEN CASE WHEN w.accept THEN 'accepted' ELSE 'draft' END END AS status,
       CASE WHEN w.reason IS NULL THEN u.area END AS area, CASE WHEN w.reason IS NULL THEN w.x0 END AS x0, CASE WHEN w.reason IS NULL THEN w.y1 END AS y1
FROM (SELECT DISTINCT request_id FROM ({MERGES}) q) m JOIN ({MERGE_VERDICT}) w ON w.request_id = m.request_id
LEFT JOIN (SELECT image_id, CAST(sum(y1 - y0) AS BIGINT) AS area FROM (
   SELECT image_id, x, island, min(y0) AS y0, max(y1) AS y1 FROM (
     SELECT *, sum(fresh) OVER (PARTITION BY image_id, x ORDER BY y0, y1, annotation_id) AS island FROM (
       SELECT *, CASE WHEN y0 <= max(y1) OVER (PARTITION BY image_id, x ORDER BY y0, y1, annotation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
       FROM (SELECT a.image_id, a.annotation_id, unnest(range(a.x0, a.x1)) AS x, a.y0, a.y1 FROM {{annotations}} a WHERE status NOT IN ('rejected', 'superseded') AND line < 5) s) t) u
   GROUP BY image_id, x, island) r GROUP BY image_id) u ON u.image_id = m.request_id""")
def cur_02(v):
    """Merged children (or the reason for none) per request."""
    requests = v.sql(MERGES)
    out = C.merge_selected(v.annotations, slabs(v), v.images, v.classes, requests)
    made = out.annotations.filter("operation = 'exact_pixel_union'").selectExpr("image_id AS request_id", "class_id", "status", "area", "x0", "y1")
    return (requests.select("request_id").distinct().join(out.conflicts, "request_id", "left")
            .join(made, "request_id", "left"))


CLASS_CHANGES = """
SELECT n_nationkey AS request_id, CASE n_nationkey % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'archive' END AS action,
  CASE WHEN n_nationkey % 3 = 0 THEN 'new-' || CAST(n_nationkey AS STRING) ELSE 'Brand#' || CAST(n_nationkey + 1 AS STRING) END AS class_id,
  CASE WHEN n_nationkey = 6 THEN ' ' WHEN n_nationkey = 9 THEN 'BRAND#4' ELSE n_name END AS name, CAST(n_nationkey % 2 AS BIGINT) AS used, n_nationkey <> 5 AS confirm FROM {nation}"""


SOUND_CHANGES = CLASS_CHANGES.replace("'BRAND#4'", "'Fresh'")


@query("cur_03", f"""
WITH c AS ({SOUND_CHANGES}), j AS (SELECT c.*, CASE WHEN action <> 'create' AND k.class_id IS NULL THEN 'unknown_class' WHEN action <> 'archive' AND trim(c.name) = '' THEN 'bad_name'
     WHEN action = 'archive' AND used > 0 AND NOT confirm THEN 'confirm_needed' END AS reason FROM c LEFT JOIN {{classes}} k ON k.class_id = c.class_id)
SELECT k.class_id, coalesce(CASE WHEN j.action = 'update' THEN j.name END, k.name) AS name, k.ord, k.archived OR coalesce(j.action = 'archive', false) AS archived
FROM {{classes}} k LEFT JOIN (SELECT * FROM j WHERE reason IS NULL AND action <> 'create') j ON j.class_id = k.class_id
UNION ALL SELECT class_id, name, (SELECT max(ord) FROM {{classes}}) + row_number() OVER (ORDER BY request_id), false FROM j WHERE reason IS NULL AND action = 'create'""")
def cur_03(v):
    return C.change_classes(v.classes, v.sql(SOUND_CHANGES)).classes.select("class_id", "name", "ord", "archived")


@query("cur_03_clash", "SELECT class_id, name, ord, archived, true AS refused FROM {classes}")
def cur_03_clash(v):
    """A batch that would leave two active classes with one name changes nothing."""
    out = C.change_classes(v.classes, v.sql(CLASS_CHANGES))
    refused = out.conflicts.filter("reason = 'name_taken'").limit(1).select(F.lit(True).alias("refused"), F.lit(1).alias("one"))
    return out.classes.select("class_id", "name", "ord", "archived", F.lit(1).alias("one")).join(refused, "one", "left").drop("one")


MOVES = "SELECT class_id, 'Brand#' || CAST((1000 - ord) % 25 + 1 AS STRING) AS target_id, ord % 5 <> 0 AS confirm FROM {classes} WHERE ord % 3 = 0"


@query("cur_03_remap", f"""
WITH m AS (SELECT m.* FROM ({MOVES}) m WHERE m.target_id IN {ACTIVE_CLASSES} AND m.target_id <> m.class_id AND m.confirm AND m.target_id NOT IN (SELECT class_id FROM ({MOVES}) z)),
h AS (SELECT a.*, m.target_id AS hit FROM {{annotations}} a LEFT JOIN m ON m.class_id = a.class_id AND a.image_id IN (SELECT image_id FROM {{images}} WHERE NOT removed))
SELECT coalesce(hit, class_id) AS class_id, CASE WHEN hit IS NOT NULL THEN 'draft' ELSE status END AS status, count(*) AS n, CAST(sum(revision + CASE WHEN hit IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS revisions
FROM h GROUP BY 1, 2""")
def cur_03_remap(v):
    out = C.remap_classes(v.annotations, v.images, v.classes, v.sql(MOVES))
    return out.annotations.groupBy("class_id", "status").agg(F.count("*").alias("n"), F.sum("revision").alias("revisions"))


EXCLUSIONS = """
SELECT image_id AS request_id, annotation_id, CASE WHEN image_id % 9 = 0 THEN revision + 1 ELSE revision END AS expected_revision,
       CASE WHEN training_excluded THEN 'restore' ELSE 'exclude' END AS action, image_id % 13 <> 0 AS confirm, 'human' AS actor
FROM {annotations} WHERE status = 'accepted' AND (training_excluded OR p_key % 4 = 0)"""


@query("cur_04", f"""
WITH e AS ({EXCLUSIONS}), w AS (SELECT e.request_id FROM e JOIN {{annotations}} a ON a.annotation_id = e.annotation_id GROUP BY e.request_id
  HAVING bool_and(e.confirm) AND bool_and(e.expected_revision = a.revision) AND count(*) = count(DISTINCT e.annotation_id) AND count(DISTINCT e.action) = 1)
SELECT a.annotation_id, CASE WHEN e.action IS NULL THEN a.training_excluded ELSE e.action = 'exclude' END AS training_excluded, a.revision + CASE WHEN e.action IS NULL THEN 0 ELSE 1 END AS revision
FROM {{annotations}} a LEFT JOIN (SELECT e.* FROM e JOIN w ON w.request_id = e.request_id) e ON e.annotation_id = a.annotation_id""")
def cur_04(v):
    out = C.change_exclusions(v.annotations, v.images, v.sql(EXCLUSIONS))
    return out.annotations.select("annotation_id", "training_excluded", "revision")


REVIEWS = """
SELECT image_id AS request_id, image_id, CASE WHEN image_id % 17 = 0 THEN 'test' ELSE role END AS expected_role, image_id % 3 <> 0 AS accept_pending,
       image_id % 2 = 0 AS confirm_negative, image_id % 19 <> 0 AS attest, 'human' AS actor FROM {images} WHERE NOT complete"""


@query("cur_05", f"""
SELECT i.image_id, r.reason, i.complete OR (r.request_id IS NOT NULL AND r.reason IS NULL) AS complete, CASE WHEN r.request_id IS NOT NULL AND r.reason IS NULL THEN 'human' ELSE i.review_actor END AS review_actor
FROM {{images}} i LEFT JOIN (
 SELECT r.request_id, CASE WHEN NOT r.attest THEN 'attest_needed' WHEN r.expected_role <> i.role THEN 'role_changed' WHEN i.role NOT IN ('pool', 'train', 'validation') THEN 'role_not_trainable' WHEN i.missing IS NOT NULL THEN 'image_missing'
   WHEN coalesce(s.unassigned, 0) > 0 THEN 'unassigned_objects' WHEN coalesce(s.pending, 0) > 0 AND NOT r.accept_pending THEN 'pending_objects' WHEN coalesce(s.live, 0) = 0 AND NOT r.confirm_negative THEN 'negative_not_confirmed' END AS reason
 FROM ({REVIEWS}) r JOIN {{images}} i ON i.image_id = r.image_id LEFT JOIN (SELECT image_id, count(*) FILTER (WHERE status NOT IN ('rejected', 'superseded')) AS live,
   count(*) FILTER (WHERE status NOT IN ('rejected', 'superseded') AND (class_id IS NULL OR class_id NOT IN {ACTIVE_CLASSES})) AS unassigned,
   count(*) FILTER (WHERE status IN ('draft', 'proposal')) AS pending FROM {{annotations}} GROUP BY image_id) s ON s.image_id = i.image_id) r ON r.request_id = i.image_id""")
def cur_05(v):
    out = C.confirm_review(v.annotations, v.images, v.classes, v.sql(REVIEWS))
    return (out.images.join(out.conflicts.withColumnRenamed("request_id", "image_id"), "image_id", "left")
            .select("image_id", "reason", "complete", "review_actor"))


UPDATES = """
SELECT image_id AS request_id, image_id, CASE WHEN image_id % 4 < 2 THEN CASE WHEN image_id % 8 = 0 THEN 'unknown' ELSE 'train' END END AS role,
       CASE WHEN image_id % 4 = 2 THEN 'solo-' || CAST(image_id AS STRING) END AS group_id, CASE WHEN image_id % 4 = 3 THEN true END AS complete, image_id % 3 <> 0 AS attest, 'human' AS actor
FROM {images} WHERE image_id % 5 <> 0"""


@query("cur_06", f"""
WITH u AS ({UPDATES}), r AS (
 SELECT u.request_id, CASE WHEN u.role = 'unknown' THEN 'bad_role' WHEN u.role IS NOT NULL AND u.image_id IN (SELECT image_id FROM {{rounds}}) THEN 'role_fixed_by_plan'
   WHEN u.role IS NOT NULL AND EXISTS (SELECT 1 FROM {{images}} o WHERE o.group_id = i.group_id AND o.image_id <> i.image_id AND o.role <> u.role AND NOT o.removed) THEN 'group_role_conflict'
   WHEN u.complete AND NOT u.attest THEN 'attest_needed' WHEN u.complete AND u.image_id IN (SELECT image_id FROM {{annotations}} WHERE status IN ('draft', 'proposal')) THEN 'pending_objects' END AS reason
 FROM u JOIN {{images}} i ON i.image_id = u.image_id)
SELECT i.image_id, r.reason, CASE WHEN r.reason IS NULL THEN coalesce(u.role, i.role) ELSE i.role END AS role, CASE WHEN r.reason IS NULL THEN coalesce(u.group_id, i.group_id) ELSE i.group_id END AS group_id,
       CASE WHEN r.reason IS NULL THEN coalesce(u.complete, i.complete) ELSE i.complete END AS complete
FROM {{images}} i LEFT JOIN u ON u.image_id = i.image_id LEFT JOIN r ON r.request_id = i.image_id""")
def cur_06(v):
    out = C.update_images(v.images, v.annotations, v.rounds, v.sql(UPDATES))
    return (out.images.join(out.conflicts.withColumnRenamed("request_id", "image_id"), "image_id", "left")
            .select("image_id", "reason", "role", "group_id", "complete"))


REMOVALS = "SELECT image_id AS request_id, image_id, image_id % 5 <> 0 AS confirm FROM {images} WHERE image_id % 7 = 0"


@query("cur_07", f"""
WITH q AS (SELECT r.image_id, CASE WHEN NOT r.confirm THEN 'confirm_needed' WHEN i.removed THEN 'unknown_image'
   WHEN r.image_id IN (SELECT image_id FROM {{rounds}} WHERE status <> 'planned') THEN 'protected_by_round' END AS reason FROM ({REMOVALS}) r JOIN {{images}} i ON i.image_id = r.image_id)
SELECT round_number, count(*) AS images, CAST((SELECT count(*) FROM q WHERE reason IS NOT NULL) AS BIGINT) AS conflicts FROM {{rounds}} o
WHERE status <> 'planned' OR image_id NOT IN (SELECT image_id FROM q WHERE reason IS NULL) GROUP BY round_number""")
def cur_07(v):
    out = C.remove_images(v.images, v.rounds, v.sql(REMOVALS))
    rejected = out.conflicts.agg(F.count("*").alias("conflicts")).withColumn("one", F.lit(1))
    return (out.rounds.groupBy("round_number").agg(F.count("*").alias("images")).withColumn("one", F.lit(1))
            .join(rejected, "one").drop("one"))


EDITS = """
SELECT annotation_id AS seq, annotation_id, image_id % 10 = 0 AS delete, s_key % 3 = 0 AS set_class, CASE WHEN s_key % 3 = 0 THEN 'Brand#' || CAST(1 + p_key % 25 AS STRING) END AS class_id,
       CASE WHEN line = 1 THEN 'accepted' WHEN line = 3 THEN 'rejected' WHEN line = 4 THEN 'superseded' END AS status,
       CASE WHEN p_key % 4 = 0 THEN x0 + 1 END AS nx0, CASE WHEN p_key % 4 = 0 THEN y0 END AS ny0, CASE WHEN p_key % 4 = 0 THEN x1 + s_key * 5 END AS nx1, CASE WHEN p_key % 4 = 0 THEN y1 + 1 END AS ny1, 'human' AS actor
FROM {annotations} WHERE p_key % 3 = 0"""


@query("cur_08", f"""
WITH e AS (SELECT e.*, a.image_id, a.status AS old_status, a.width, a.height, CASE WHEN e.set_class THEN e.class_id ELSE a.class_id END AS to_class,
             coalesce(e.status, CASE WHEN e.set_class OR e.nx0 IS NOT NULL THEN 'draft' ELSE a.status END) AS to_status FROM ({EDITS}) e JOIN {{annotations}} a ON a.annotation_id = e.annotation_id),
r AS (SELECT e.*, CASE WHEN old_status = 'superseded' THEN 'superseded' WHEN NOT "delete" AND to_status NOT IN ('draft', 'proposal', 'accepted', 'rejected') THEN 'bad_status'
   WHEN NOT "delete" AND to_class IS NOT NULL AND to_class NOT IN {ACTIVE_CLASSES} THEN 'inactive_class' WHEN NOT "delete" AND to_status = 'accepted' AND to_class IS NULL THEN 'class_needed'
   WHEN NOT "delete" AND nx0 IS NOT NULL AND NOT (0 <= nx0 AND nx0 < nx1 AND nx1 <= width AND 0 <= ny0 AND ny0 < ny1 AND ny1 <= height) THEN 'bad_geometry' END AS reason FROM e),
w AS (SELECT * FROM r WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY seq) = 1)
SELECT a.annotation_id, CASE WHEN w.seq IS NULL THEN a.class_id ELSE w.to_class END AS class_id, coalesce(w.to_status, a.status) AS status, coalesce(w.nx1, a.x1) AS x1,
       CASE WHEN w.nx0 IS NULL THEN a.area ELSE (w.nx1 - w.nx0) * (w.ny1 - w.ny0) END AS area, a.revision + CASE WHEN w.seq IS NULL THEN 0 ELSE 1 END AS revision
FROM {{annotations}} a LEFT JOIN w ON w.annotation_id = a.annotation_id WHERE NOT coalesce(w."delete", false)""")
def cur_08(v):
    out = C.edit_objects(v.annotations, v.images, v.classes, v.sql(EDITS), sized_slabs(v))
    return out.annotations.select("annotation_id", "class_id", "status", "x1", "area", "revision")


DRAWN = """
SELECT annotation_id AS seq, annotation_id, image_id % 10 = 0 AS delete, false AS set_class, CAST(NULL AS STRING) AS class_id, CAST(NULL AS STRING) AS status,
       CAST(NULL AS BIGINT) AS nx0, CAST(NULL AS BIGINT) AS ny0, CAST(NULL AS BIGINT) AS nx1, CAST(NULL AS BIGINT) AS ny1, 'human' AS actor FROM {annotations} WHERE p_key % 4 = 0 AND status <> 'accepted'"""


@query("cur_08_masks", f"""
WITH b AS (SELECT s.annotation_id, min(s.x0) AS x0, max(s.x1) AS x1, min(s.y0) AS y0, max(s.y1) AS y1, CAST(sum((s.x1 - s.x0) * (s.y1 - s.y0)) AS BIGINT) AS area FROM {{shapes}} s GROUP BY s.annotation_id),
e AS (SELECT e.*, a.image_id, CASE WHEN a.status = 'superseded' THEN 'superseded' WHEN NOT "delete" AND a.class_id IS NOT NULL AND a.class_id NOT IN {ACTIVE_CLASSES} THEN 'inactive_class'
        WHEN NOT "delete" AND NOT (b.x1 <= a.width AND b.y1 <= a.height) THEN 'bad_geometry' END AS reason
      FROM ({DRAWN}) e JOIN {{annotations}} a ON a.annotation_id = e.annotation_id JOIN b ON b.annotation_id = e.annotation_id),
w AS (SELECT * FROM e WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY seq) = 1)
SELECT a.annotation_id, CASE WHEN w.seq IS NULL THEN a.area ELSE b.area END AS area, CASE WHEN w.seq IS NULL THEN a.area ELSE b.area END AS pixels, CASE WHEN w.seq IS NULL THEN a.y1 ELSE b.y1 END AS y1,
  CASE WHEN w.seq IS NULL THEN a.y1 ELSE b.y1 END AS drawn_y1 FROM {{annotations}} a JOIN b ON b.annotation_id = a.annotation_id LEFT JOIN w ON w.annotation_id = a.annotation_id WHERE NOT coalesce(w."delete", false)""")
def cur_08_masks(v):
    """Edits that draw masks: rows and slabs change together."""
    out = C.edit_objects(v.annotations, v.images, v.classes, v.sql(DRAWN), sized_slabs(v), v.shapes.withColumn("seq", F.col("annotation_id")))
    drawn = M.mask_stats(out.slabs, "annotation_id").selectExpr("annotation_id", "area AS pixels", "by1 AS drawn_y1")
    return out.annotations.select("annotation_id", "area", "y1").join(drawn, "annotation_id")


@query("cur_09", """
WITH s AS (SELECT round_number, max(r.status) AS status, count(*) FILTER (WHERE NOT i.complete) AS open FROM {rounds} r JOIN {images} i ON i.image_id = r.image_id GROUP BY 1)
SELECT round_number AS request_id, CASE WHEN round_number % 2 = 0 THEN CASE WHEN status <> 'planned' THEN 'already_started' ELSE 'another_in_progress' END
    ELSE CASE WHEN status <> 'in_progress' THEN 'not_started' ELSE 'images_incomplete' END END AS reason FROM s
WHERE round_number % 2 = 0 OR status <> 'in_progress' OR open > 0""")
def cur_09(v):
    requests = v.rounds.select("round_number").distinct().selectExpr(
        "round_number AS request_id", "round_number", "CASE WHEN round_number % 2 = 0 THEN 'start' ELSE 'finish' END AS action")
    return C.round_actions(v.rounds, v.images, requests).conflicts


@query("cur_10", """
SELECT annotation_id, CASE WHEN layer_id = 1 AND image_id % 2 = 0 AND status = 'proposal' AND revision = 1 THEN 'superseded' ELSE status END AS status,
       CASE WHEN layer_id = 1 AND image_id % 2 = 0 AND status = 'proposal' AND revision = 1 THEN 9 END AS superseded_by_layer FROM {annotations}""")
def cur_10(v):
    swaps = v.images.filter("image_id % 2 = 0").selectExpr("image_id", "CAST(1 AS BIGINT) AS layer_id", "9 AS new_layer_id")
    out = C.replace_layer(v.annotations.withColumn("generated_revision", F.lit(1)), swaps)
    return out.annotations.select("annotation_id", "status", "superseded_by_layer")


REPAIRS = """
SELECT 'p-' || annotation_id AS proposal_id, annotation_id, CASE WHEN s_key % 5 = 0 THEN revision + 1 ELSE revision END AS revision, image_id, 'pending' AS status,
       CASE WHEN line <> 2 THEN x0 END AS nx0, CASE WHEN line <> 2 THEN y0 END AS ny0, CASE WHEN line <> 2 THEN x1 + 2 END AS nx1, CASE WHEN line <> 2 THEN y1 END AS ny1
FROM {annotations} WHERE p_key % 5 = 0"""
REPAIR_DECISIONS = """
SELECT annotation_id AS request_id, 'p-' || annotation_id AS proposal_id, CASE s_key % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'retain' ELSE 'exclude' END AS decision,
       p_key % 35 <> 0 AS attest, 'human' AS actor FROM {annotations} WHERE p_key % 5 = 0"""
MATCHED = """
SELECT 'p-' || a.annotation_id AS proposal_id, b.annotation_id, b.revision FROM {annotations} a JOIN (SELECT image_id, min(annotation_id) AS annotation_id, arg_min(revision, annotation_id) AS revision FROM {annotations}
  WHERE p_key % 5 = 1 GROUP BY image_id) b ON a.image_id = b.image_id WHERE a.p_key % 5 = 0 AND a.line = 1"""


@query("cur_11", f"""
WITH m AS (SELECT m.proposal_id, bool_or(a.revision <> m.revision OR a.status NOT IN ('draft', 'proposal')) AS bad FROM ({MATCHED}) m JOIN {{annotations}} a ON a.annotation_id = m.annotation_id GROUP BY 1),
d AS (SELECT d.*, p.image_id, p.annotation_id, p.nx0, p.nx1, coalesce(m.bad, false) OR a.revision <> p.revision OR a.status IN ('rejected', 'superseded') OR i.removed AS stale
      FROM ({REPAIR_DECISIONS}) d JOIN ({REPAIRS}) p ON p.proposal_id = d.proposal_id JOIN {{annotations}} a ON a.annotation_id = p.annotation_id JOIN {{images}} i ON i.image_id = p.image_id LEFT JOIN m ON m.proposal_id = d.proposal_id),
r AS (SELECT *, CASE WHEN NOT attest THEN 'attest_needed' WHEN stale AND decision <> 'retain' THEN 'stale' WHEN decision = 'accept' AND nx0 IS NULL THEN 'no_replacement' END AS reason FROM d),
w AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY request_id) AS k FROM r WHERE reason IS NULL QUALIFY k = 1)
SELECT p.proposal_id, CASE WHEN w.proposal_id IS NULL THEN 'pending' WHEN w.stale THEN 'dismissed_stale' WHEN w.decision = 'accept' THEN 'accepted' WHEN w.decision = 'retain' THEN 'retained' ELSE 'excluded' END AS status
FROM ({REPAIRS}) p LEFT JOIN w ON w.proposal_id = p.proposal_id""")
def cur_11(v):
    matched = v.spark.sql(MATCHED.replace("arg_min(revision, annotation_id)", "min_by(revision, annotation_id)"), annotations=v.annotations)
    out = C.review_repairs(v.annotations, v.images, v.classes, v.sql(REPAIRS), matched, v.sql(REPAIR_DECISIONS), sized_slabs(v))
    return out.proposals.select("proposal_id", "status")


# A stack machine over the actions of each image: entries done and undone as lists of edits, one action a step.
def _stack_sql(ok):
    return f"""
WITH RECURSIVE l AS (SELECT image_id, seq, action, row_number() OVER (PARTITION BY image_id ORDER BY seq) AS k FROM {{edit_log}}),
w AS (SELECT image_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS action, CAST([] AS BIGINT[]) AS done, CAST([] AS BIGINT[]) AS undone, false AS applied
      FROM (SELECT DISTINCT image_id FROM {{edit_log}}) q
  UNION ALL SELECT image_id, k, seq, action,
    CASE WHEN NOT applied THEN done WHEN action = 'undo' THEN done[:-2] WHEN action = 'redo' THEN list_append(done, undone[-1]) ELSE list_append(done, seq) END,
    CASE WHEN NOT applied THEN undone WHEN action = 'undo' THEN list_append(undone, done[-1]) WHEN action = 'redo' THEN undone[:-2] ELSE CAST([] AS BIGINT[]) END, applied
  FROM (SELECT w.image_id, l.k, l.seq, l.action, w.done, w.undone, CASE l.action WHEN 'edit' THEN true
          WHEN 'undo' THEN len(w.done) > 0 AND {ok('w.done[:-2]')} WHEN 'redo' THEN len(w.undone) > 0 AND {ok('list_append(w.done, w.undone[-1])')} ELSE false END AS applied
        FROM w JOIN l ON l.image_id = w.image_id AND l.k = w.k + 1) n)"""


STACK = _stack_sql(lambda stack: "true")


@query("hist_01", STACK + """
SELECT image_id, arg_max(len(done), k) AS depth, arg_max(len(undone), k) AS redo, count(*) FILTER (WHERE action = 'edit') AS edits,
  count(*) FILTER (WHERE action IN ('undo', 'redo') AND NOT applied) AS ignored, max_by(coalesce(done[-1], -1), k) AS top_seq FROM w GROUP BY image_id""")
def hist_01(v):
    """Undo / redo fold per image: depth, open redo steps and the edit now on top (-1 for none)."""
    return H.fold_history(v.edit_log).withColumn("top_seq", F.coalesce("top_seq", F.lit(-1)))


@query("win_06", STACK + " SELECT image_id, seq, action, len(done) AS depth, len(undone) AS redo, applied FROM w WHERE k > 0")
def win_06(v):
    """Effect of every history action: depth before and after, and whether there was anything to do."""
    return H.trace_history(v.edit_log).select("image_id", "seq", "action", "depth", "redo", "applied")


@query("win_06_pieces", STACK + " SELECT image_id, seq, action, len(done) AS depth, len(undone) AS redo, applied FROM w WHERE k > 0")
def win_06_pieces(v):
    """The same with histories of more than sixteen actions cut into pieces, which are walked at once."""
    return H.trace_history(v.edit_log, chunk_rows=16).select("image_id", "seq", "action", "depth", "redo", "applied")


# Every edit changes one of four rows of its image: it deletes it, or gives it one of three classes, one of them archived.
HISTORY_CHANGES = """
SELECT image_id, seq, CAST(image_id AS STRING) || '-' || CAST(seq % 4 AS STRING) AS annotation_id, seq % 7 = 0 AS deleted,
       CASE seq % 11 WHEN 0 THEN 'old' WHEN 1 THEN CAST(NULL AS STRING) ELSE 'c' || CAST(seq % 2 AS STRING) END AS class_id FROM {edit_log} WHERE action = 'edit'"""
HISTORY_BASE = "SELECT image_id, CAST(image_id AS STRING) || '-0' AS annotation_id, 'c0' AS class_id, CAST(3 AS BIGINT) AS revision FROM (SELECT DISTINCT image_id FROM {edit_log}) q"
# A stack is sound if the last entry of every row is not of the archived class.
SOUND = _stack_sql(lambda stack: f"len(list_filter([0, 1, 2, 3], lambda r: coalesce(list_filter({stack}, lambda s: s % 4 = r)[-1] % 11 = 0 AND list_filter({stack}, lambda s: s % 4 = r)[-1] % 7 <> 0, false))) = 0")


def _restored(v):
    base = v.sql(HISTORY_BASE)
    images = base.select("image_id", F.lit(True).alias("complete"), F.lit("human").alias("review_actor"), F.lit(5).cast("bigint").alias("revision"))
    classes = v.spark.createDataFrame([("c0", False), ("c1", False), ("old", True)], "class_id STRING, archived BOOLEAN")
    return H.restore_history(images, base, v.edit_log, v.sql(HISTORY_CHANGES), classes)


@query("hist_01_restore", SOUND + """,
e AS (SELECT image_id, max(k) AS k FROM w GROUP BY image_id),
s AS (SELECT image_id, seq, k, action, row_number() OVER (PARTITION BY image_id ORDER BY k) AS step FROM w WHERE applied),
t AS (SELECT w.image_id, w.done, coalesce((SELECT max(step) FROM s WHERE s.image_id = w.image_id), 0) AS steps, coalesce((SELECT max(step) FROM s WHERE s.image_id = w.image_id AND s.action <> 'edit'), 0) AS restored
      FROM w JOIN e ON e.image_id = w.image_id AND e.k = w.k),
r AS (SELECT t.*, q.r, list_filter(t.done, lambda x: x % 4 = q.r)[-1] AS last FROM t, (SELECT unnest([0, 1, 2, 3]) AS r) q),
x AS (SELECT r.*, coalesce(s.step, 0) AS step FROM r LEFT JOIN s ON s.image_id = r.image_id AND s.seq = r.last)
SELECT image_id, CAST(image_id AS VARCHAR) || '-' || CAST(r AS VARCHAR) AS annotation_id,
  CASE WHEN last IS NULL THEN 'c0' ELSE CASE last % 11 WHEN 0 THEN 'old' WHEN 1 THEN NULL ELSE 'c' || CAST(last % 2 AS VARCHAR) END END AS class_id,
  CASE WHEN greatest(restored, step) = 0 THEN 3 ELSE 5 + greatest(restored, step) END AS revision, 5 + steps AS image_revision, steps = 0 AS complete
FROM x WHERE (last IS NULL AND r = 0) OR (last IS NOT NULL AND last % 7 <> 0)""")
def hist_01_restore(v):
    """Rows that the history leaves, after undo and redo steps of which those to an archived class are refused."""
    out = _restored(v)
    return out.annotations.join(out.images.selectExpr("image_id", "revision AS image_revision", "complete"), "image_id").select(
        "image_id", "annotation_id", "class_id", "revision", "image_revision", "complete")


@query("hist_01_refused", SOUND + """
SELECT n.image_id, n.seq, CASE WHEN len(CASE n.action WHEN 'undo' THEN p.done ELSE p.undone END) = 0 THEN 'nothing_to_' || n.action ELSE 'archived_class' END AS reason
FROM w n JOIN w p ON p.image_id = n.image_id AND p.k = n.k - 1 WHERE n.action IN ('undo', 'redo') AND NOT n.applied""")
def hist_01_refused(v):
    """Undo and redo steps without effect, and why."""
    return _restored(v).conflicts.select("image_id", "seq", "reason")
