"""Projections, filters and validity checks (PRJ-*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import predicates as P
from .registry import query

ACTIVE_CLASSES = "(SELECT class_id FROM {classes} WHERE NOT archived)"


@query("prj_01", """
SELECT a.annotation_id, a.image_id, a.status FROM {annotations} a JOIN {images} i ON a.image_id = i.image_id
WHERE NOT i.removed AND i.complete AND a.status = 'accepted'""")
def prj_01(v):
    return P.active_document(v.images, v.annotations)[1].select("annotation_id", "image_id", "status")


DISPOSITION = """
SELECT i.image_id, i.role, i.group_id, CASE
    WHEN i.training_excluded THEN 'explicit_training_exclusion'
    WHEN i.role NOT IN ('pool', 'train', 'validation') THEN 'role_excluded'
    WHEN i.role = 'pool' AND i.image_id NOT IN (SELECT image_id FROM {rounds} WHERE round_number <= 4) THEN 'future_round'
    WHEN i.missing = 'linked_original' THEN 'linked_original_missing'
    WHEN i.missing = 'image' THEN 'image_missing'
    WHEN NOT i.complete THEN 'image_incomplete'
    WHEN i.review_actor IS DISTINCT FROM 'human' THEN 'awaiting_human_review'
    WHEN u.usable = 0 THEN 'all_instances_excluded' END AS reason
FROM {images} i LEFT JOIN (SELECT image_id, count(*) FILTER (WHERE NOT training_excluded) AS usable
                           FROM {annotations} WHERE status = 'accepted' GROUP BY image_id) u ON u.image_id = i.image_id
WHERE NOT i.removed"""

TRAINING_ROWS = """
SELECT a.*, d.role, d.group_id, a.class_id IS NOT NULL AND a.class_id IN """ + ACTIVE_CLASSES + """ AS class_ok
FROM {annotations} a JOIN (""" + DISPOSITION + """) d ON a.image_id = d.image_id
WHERE d.reason IS NULL AND a.status = 'accepted' AND NOT a.training_excluded"""


def round_members(v, upto=4):
    return v.rounds.filter(F.col("round_number") <= upto)


@query("prj_02", f"SELECT image_id, reason FROM ({DISPOSITION}) d")
def prj_02(v):
    return P.training_disposition(v.images, v.annotations, round_members(v)).select("image_id", "reason")


ISSUES = f"""
SELECT image_id, annotation_id, reason FROM (
  SELECT image_id, annotation_id, CASE WHEN NOT class_ok THEN 'unassigned_or_archived_class' END AS reason FROM ({TRAINING_ROWS}) t
  UNION ALL
  SELECT image_id, annotation_id, CASE WHEN class_ok AND review_actor IS DISTINCT FROM 'human' THEN 'annotation_not_human_reviewed' END FROM ({TRAINING_ROWS}) t
  UNION ALL
  SELECT image_id, annotation_id, CASE WHEN class_ok AND geom_type = 'box' THEN 'box_only_not_segmentation_ground_truth' END FROM ({TRAINING_ROWS}) t
) q WHERE reason IS NOT NULL"""


@query("prj_03", ISSUES)
def prj_03(v):
    return P.annotation_issues(P.training_rows(v.images, v.annotations, v.classes, round_members(v)))


EXPORT_OBJECTS = """
SELECT a.*, i.role, i.complete, CASE
    WHEN a.status IN ('rejected', 'superseded') THEN 'rejected_or_superseded_objects'
    WHEN a.class_id IS NULL OR a.class_id NOT IN """ + ACTIVE_CLASSES + """ THEN 'unassigned_or_archived_class_objects'
    WHEN %(strict)s AND (NOT i.complete OR a.status <> 'accepted') THEN 'not_reviewed_objects' END AS object_reason
FROM {annotations} a JOIN {images} i ON a.image_id = i.image_id
WHERE NOT i.removed AND i.role <> 'excluded'"""

EXPORT_IMAGES = """
SELECT i.*, coalesce(c.n, 0) AS candidates, CASE
    WHEN i.role = 'excluded' THEN 'excluded_role_images'
    WHEN NOT i.complete AND %(strict)s THEN 'incomplete_images'
    WHEN NOT i.complete AND coalesce(c.n, 0) = 0 THEN 'unlabeled_incomplete_images' END AS reason
FROM {images} i LEFT JOIN (SELECT image_id, count(*) AS n FROM (""" + EXPORT_OBJECTS + """) o
                           WHERE object_reason IS NULL GROUP BY image_id) c ON c.image_id = i.image_id
WHERE NOT i.removed"""


def export_images_sql(mode):
    return EXPORT_IMAGES % {"strict": "TRUE" if mode == "reviewed" else "FALSE"}


def export_objects_sql(mode):
    return EXPORT_OBJECTS % {"strict": "TRUE" if mode == "reviewed" else "FALSE"}


def exported_sql(mode):
    """Candidate objects of included images."""
    return (f"SELECT o.* FROM ({export_objects_sql(mode)}) o JOIN ({export_images_sql(mode)}) i ON o.image_id = i.image_id "
            "WHERE o.object_reason IS NULL AND i.reason IS NULL")


@query("prj_04", f"""
SELECT 'labeled' AS mode, 'image' AS kind, CAST(image_id AS STRING) AS id, reason FROM ({export_images_sql('labeled')}) i
UNION ALL SELECT 'labeled', 'object', annotation_id, object_reason FROM ({export_objects_sql('labeled')}) o
UNION ALL SELECT 'reviewed', 'image', CAST(image_id AS STRING), reason FROM ({export_images_sql('reviewed')}) i
UNION ALL SELECT 'reviewed', 'object', annotation_id, object_reason FROM ({export_objects_sql('reviewed')}) o""")
def prj_04(v):
    out = None
    for mode in ("labeled", "reviewed"):
        images, objects = P.export_disposition(v.images, v.annotations, v.classes, mode)
        part = (images.selectExpr(f"'{mode}' AS mode", "'image' AS kind", "CAST(image_id AS STRING) AS id", "reason")
                .unionByName(objects.selectExpr(f"'{mode}' AS mode", "'object' AS kind", "annotation_id AS id",
                                                "object_reason AS reason")))
        out = part if out is None else out.unionByName(part)
    return out


@query("prj_05", """
SELECT role, CASE WHEN role = 'validation' THEN 'val' WHEN role = 'test' THEN 'test' ELSE 'train' END AS export_split,
       CASE WHEN role = 'validation' THEN 'val' ELSE 'train' END AS training_split, count(*) AS images
FROM {images} GROUP BY 1, 2, 3""")
def prj_05(v):
    return (v.images.groupBy("role").agg(F.count("*").alias("images"))
            .selectExpr("role", f"{P.export_split()} AS export_split", f"{P.training_split()} AS training_split", "images"))


@query("prj_06", """
SELECT 'all' AS scope, image_id FROM {images} WHERE NOT removed
UNION ALL SELECT 'selected', image_id FROM {images} WHERE NOT removed AND image_id IN (SELECT image_id FROM {annotations} WHERE status = 'draft')
UNION ALL SELECT 'round', image_id FROM {images} WHERE NOT removed AND image_id IN (SELECT image_id FROM {rounds} WHERE round_number = 2)
UNION ALL SELECT 'cumulative', image_id FROM {images}
          WHERE NOT removed AND role IN ('pool', 'train') AND complete AND NOT training_excluded""")
def prj_06(v):
    drafts = v.annotations.filter("status = 'draft'")
    parts = {"all": P.scope(v.images), "selected": P.scope(v.images, "selected", selected=drafts),
             "round": P.scope(v.images, "round", rounds=v.rounds, round_number=2),
             "cumulative": P.scope(v.images, "cumulative")}
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("scope"), "image_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("prj_07", """
SELECT annotation_id, 0 <= x0 - 3 AND x0 - 3 < x1 + s_key * 6 AND x1 + s_key * 6 <= width AND 0 <= y0 AND y0 < y1 AND y1 <= height AS valid
FROM {annotations}""")
def prj_07(v):
    return v.annotations.selectExpr("annotation_id", P.valid_box("(x0 - 3)", "y0", "(x1 + s_key * 6)", "y1") + " AS valid")


@query("prj_08", """
SELECT annotation_id,
       len(c) > 0 AND len(c) <= 2 * width * height + 1 AND len(list_filter(c, lambda q: q < 0)) = 0
       AND list_sum(c) = width * height AS valid
FROM (SELECT annotation_id, width, height,
             [x0 * height + y0, y1 - y0 - CAST(line % 3 = 0 AS BIGINT), (width - x0) * height - y1 - CASE WHEN s_key % 7 = 0 THEN width * height ELSE 0 END] AS c
      FROM {annotations}) q""")
def prj_08(v):
    counts = """array(x0 * height + y0, y1 - y0 - CAST(line % 3 = 0 AS BIGINT),
                      (width - x0) * height - y1 - CASE WHEN s_key % 7 = 0 THEN width * height ELSE 0 END)"""
    rows = v.annotations.selectExpr("annotation_id", "width", "height", f"{counts} AS counts")
    return rows.selectExpr("annotation_id", P.valid_rle() + " AS valid")


@query("prj_09", """
SELECT 'class' AS kind, class_id AS id, 'id_not_portable' AS issue FROM {classes} WHERE NOT regexp_full_match(class_id, '[A-Za-z0-9][A-Za-z0-9_.-]{0,127}')
UNION ALL SELECT 'annotation', annotation_id, 'unknown_class' FROM {annotations} a
          WHERE class_id IS NULL OR class_id NOT IN (SELECT class_id FROM {classes} WHERE NOT archived)
UNION ALL SELECT 'annotation', annotation_id, 'unknown_image' FROM {annotations}
          WHERE image_id NOT IN (SELECT image_id FROM {images} WHERE NOT removed)
UNION ALL SELECT 'image', name, 'duplicate_id' FROM (SELECT name FROM {images} WHERE NOT removed GROUP BY name HAVING count(*) > 1) q
""")
def prj_09(v):
    # Names stand in for image ids once, so that the duplicate rule has something to find.
    known = v.images.filter("NOT removed")
    issues = P.document_issues(v.classes.filter("NOT archived"), known, v.annotations)
    names = P.document_issues(v.classes, known.withColumn("image_id", F.col("name")),
                              v.annotations.filter("false").withColumn("image_id", F.col("annotation_id")))
    bad_classes = P.document_issues(v.classes, known.filter("false"), v.annotations.filter("false"))
    return (issues.filter("kind = 'annotation'").unionByName(names.filter("issue = 'duplicate_id'"))
            .unionByName(bad_classes.filter("issue = 'id_not_portable'")))


PATHS = """CASE doc_id % 6 WHEN 0 THEN path WHEN 1 THEN '/' || path WHEN 2 THEN 'C:' || path WHEN 3 THEN '../' || path
           WHEN 4 THEN 'a/../' || path ELSE 'a..b/' || path END"""


@query("prj_10", f"""
SELECT doc_id, NOT (starts_with(p, '/') OR regexp_matches(p, '^[A-Za-z]:') OR regexp_matches(p, '(^|/)[.][.](/|$)') OR p = '') AS safe
FROM (SELECT doc_id, {PATHS} AS p FROM {{files}}) q""")
def prj_10(v):
    return v.files.selectExpr("doc_id", f"{PATHS} AS p").select("doc_id", P.safe_relative("p").alias("safe"))


LINES = """CAST(CASE WHEN line = 7 THEN -1 ELSE model_class_index END AS STRING) || ' ' ||
  CAST(x0 AS STRING) || 'e-4 ' || CAST(y0 AS STRING) || 'e-4 ' || CAST(x1 AS STRING) || 'e-4 ' || CAST(y0 AS STRING) || 'e-4' ||
  CASE WHEN s_key % 9 = 0 THEN '' ELSE ' ' || CAST(x1 AS STRING) || CASE WHEN s_key % 13 = 0 THEN 'e-2' ELSE 'e-4' END || ' ' || CAST(y1 AS STRING) || 'e-4' END"""


@query("prj_11", f"""
SELECT annotation_id, CASE WHEN len(f) < 7 OR len(f) % 2 = 0 THEN 'needs_class_and_three_points'
    WHEN NOT regexp_full_match(f[1], '0|[1-9][0-9]*') THEN 'bad_class_index'
    WHEN len(list_filter(f[2:], lambda q: coalesce(NOT (TRY_CAST(q AS DOUBLE) BETWEEN 0 AND 1), true))) > 0 THEN 'coordinate_not_normalized' END AS issue
FROM (SELECT annotation_id, string_split({LINES}, ' ') AS f FROM {{annotations}}) q""")
def prj_11(v):
    rows = v.annotations.selectExpr("annotation_id", f"{LINES} AS line_text")
    return rows.selectExpr("annotation_id", P.label_row_issue("line_text") + " AS issue")


SEAM = """((tx0 > 0 AND x0 <= tx0 + 1) OR (ty0 > 0 AND y0 <= ty0 + 1) OR (tx1 < width AND x1 >= tx1 - 1) OR (ty1 < height AND y1 >= ty1 - 1))"""


@query("prj_12", f"SELECT annotation_id, {SEAM} AS seam FROM {{annotations}}")
def prj_12(v):
    return v.annotations.selectExpr("annotation_id", P.touches_seam() + " AS seam")


@query("prj_13", """
SELECT annotation_id, CASE WHEN status = 'accepted' AND review_actor = 'automated_qa' THEN 'Accepted · automated QA'
    WHEN status = 'accepted' THEN 'Accepted' WHEN status = 'rejected' THEN 'Rejected' WHEN status = 'superseded' THEN 'Replaced by merge'
    WHEN class_id IS NOT NULL THEN 'Labeled · needs review' ELSE 'Needs label & review' END
    || CASE WHEN training_excluded THEN ' · Excluded from training' ELSE '' END AS label FROM {annotations}""")
def prj_13(v):
    return v.annotations.selectExpr("annotation_id", P.review_label() + " AS label")


@query("prj_14", """
SELECT annotation_id, status, class_id FROM {annotations}
WHERE status IN ('draft', 'proposal') AND class_id IS NOT NULL AND class_id NOT IN ('Brand#3', 'Brand#11')
  AND layer_id IS NULL AND coalesce(operation, '') <> 'automatic_mask_generation'""")
def prj_14(v):
    return P.visible_objects(v.annotations, hidden_classes=("Brand#3", "Brand#11"), show_unassigned=False,
                             hide_generated=True, pending_only=True).select("annotation_id", "status", "class_id")


@query("prj_15", "SELECT image_id, name FROM {images} WHERE contains(lower(name), 'g_12') AND NOT complete")
def prj_15(v):
    return P.find_images(v.images, "G_12", "incomplete").select("image_id", "name")


@query("prj_16", "SELECT annotation_id, predicted_iou, stability_score FROM {annotations} WHERE predicted_iou > 0.8 AND stability_score >= 0.88")
def prj_16(v):
    return P.filter_quality(v.annotations).select("annotation_id", "predicted_iou", "stability_score")


@query("prj_17", """
SELECT annotation_id FROM {annotations} WHERE geom_type = 'mask' AND source_kind IN ('sam2', 'sam3')
AND (coalesce(operation, '') = 'sam_assist' OR (operation IS NULL AND layer_id IS NULL))""")
def prj_17(v):
    return v.annotations.filter(P.is_assist()).select("annotation_id")
