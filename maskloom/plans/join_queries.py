"""Joins and duplicate suppression (JOIN-*, NMS-*, AGG-10, AGG-13)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J, nms as N, predicates as P
from .mask_queries import slabs
from .registry import query
from .review_queries import ACTIVE_CLASSES, SEAM

LIVE = "status NOT IN ('rejected', 'superseded')"


@query("join_01", """
SELECT a.annotation_id, i.role, c.name AS class_name, CASE WHEN i.image_id IS NULL THEN 'unknown_image' WHEN a.class_id IS NULL THEN 'unassigned'
       WHEN c.class_id IS NULL THEN 'unknown_class' WHEN c.archived THEN 'archived_class' END AS issue
FROM {annotations} a LEFT JOIN (SELECT * FROM {images} WHERE NOT removed) i ON a.image_id = i.image_id LEFT JOIN {classes} c ON a.class_id = c.class_id""")
def join_01(v):
    rows = J.with_context(v.annotations, v.images.filter("NOT removed"), v.classes)
    return rows.select("annotation_id", "role", "class_name", "issue")


IMPORT_ROWS = """
SELECT annotation_id AS row_id, CASE WHEN line = 1 THEN image_id WHEN line = 2 THEN -image_id END AS external_id,
       CASE line WHEN 2 THEN 'images/' || CAST(image_id AS STRING) || '.png' WHEN 3 THEN 'deep/er/' || CAST(image_id AS STRING) || '.png'
            WHEN 4 THEN CAST(image_id AS STRING) || '.txt' WHEN 5 THEN 'x/img_' || CAST(image_id % 5000 AS STRING) || '.png'
            WHEN 6 THEN 'img_' || CAST(image_id % 5000 AS STRING) || '.tif' WHEN 7 THEN 'nowhere.png' END AS name,
       CASE WHEN s_key % 10 = 0 THEN width + 1 ELSE width END AS width, height
FROM {annotations}"""
IMAGE_MAP = "SELECT 'nowhere.png' AS key, CAST(7 AS BIGINT) AS image_id UNION ALL SELECT '12', CAST(13 AS BIGINT)"


@query("join_02", f"""
WITH r AS ({IMPORT_ROWS}), m AS ({IMAGE_MAP}),
k AS (SELECT rank, key, min(image_id) AS lo, max(image_id) AS hi, max(width) AS w, max(height) AS h FROM (
    SELECT 1 AS rank, CAST(image_id AS STRING) AS key, image_id, width, height FROM {{images}}
    UNION ALL SELECT 2, name, image_id, width, height FROM {{images}} UNION ALL SELECT 2, 'images/' || CAST(image_id AS STRING) || '.png', image_id, width, height FROM {{images}}
    UNION ALL SELECT 3, name, image_id, width, height FROM {{images}} UNION ALL SELECT 3, CAST(image_id AS STRING) || '.png', image_id, width, height FROM {{images}}
    UNION ALL SELECT 4, CAST(image_id AS STRING), image_id, width, height FROM {{images}} UNION ALL SELECT 4, replace(name, '.png', ''), image_id, width, height FROM {{images}}) q GROUP BY rank, key),
h AS (SELECT r.row_id, k.rank, k.lo, k.hi, k.w, k.h FROM (
        SELECT row_id, 1 AS rank, CAST(external_id AS STRING) AS key FROM r UNION ALL SELECT row_id, 2, name FROM r
        UNION ALL SELECT row_id, 3, regexp_extract(name, '[^/]*$') FROM r
        UNION ALL SELECT row_id, 4, regexp_replace(regexp_extract(name, '[^/]*$'), '[.][^.]*$', '') FROM r) r JOIN k ON k.rank = r.rank AND k.key = r.key
      UNION ALL SELECT r.row_id, CASE WHEN m.key = CAST(r.external_id AS STRING) THEN -1 ELSE 0 END, i.image_id, i.image_id, i.width, i.height
      FROM r JOIN m ON m.key = CAST(r.external_id AS STRING) OR m.key = r.name LEFT JOIN {{images}} i ON i.image_id = m.image_id),
b AS (SELECT row_id, arg_min(struct_pack(lo := lo, hi := hi, w := w, h := h), rank) AS b FROM h GROUP BY row_id),
o AS (SELECT r.row_id, b.b.lo AS lo, CASE WHEN b.b.lo IS NULL THEN 'missing' WHEN b.b.lo <> b.b.hi THEN 'ambiguous'
             WHEN r.width <> b.b.w OR r.height <> b.b.h THEN 'dimensions' END AS reason FROM r LEFT JOIN b ON b.row_id = r.row_id)
SELECT row_id, CASE WHEN reason IS NULL THEN lo END AS image_id, reason FROM o""")
def join_02(v):
    return J.resolve_images(v.sql(IMPORT_ROWS), v.images, v.spark.sql(IMAGE_MAP))


CLASS_ROWS = """
SELECT p_partkey AS row_id, CAST(p_size AS BIGINT) AS external_id, CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS stable_id,
       CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN 'brand ' || p_type WHEN 2 THEN upper(p_brand) ELSE p_name END AS name
FROM {part}"""
CLASS_MAP = "SELECT '3' AS key, 'Brand#1' AS class_id UNION ALL SELECT 'BRAND#12', 'Brand#12' UNION ALL SELECT '4', 'no-such-class'"


@query("join_03", f"""
WITH r AS ({CLASS_ROWS}), m AS ({CLASS_MAP}),
j AS (SELECT r.*, coalesce(m1.class_id, m2.class_id, m3.class_id) AS explicit FROM r LEFT JOIN m m1 ON m1.key = CAST(r.external_id AS STRING)
      LEFT JOIN m m2 ON m2.key = r.stable_id LEFT JOIN m m3 ON m3.key = r.name)
SELECT row_id, CASE WHEN j.explicit IS NOT NULL THEN e.class_id WHEN s.class_id IS NOT NULL THEN s.class_id WHEN n.class_id IS NOT NULL THEN n.class_id END AS known_class,
       CASE WHEN j.explicit IS NOT NULL THEN CASE WHEN e.class_id IS NULL THEN 'invalid_mapping' ELSE 'explicit' END
            WHEN s.class_id IS NOT NULL THEN 'stable_id' WHEN n.class_id IS NOT NULL THEN 'name' ELSE 'created' END AS how
FROM j LEFT JOIN {{classes}} e ON e.class_id = j.explicit LEFT JOIN {{classes}} s ON s.class_id = j.stable_id LEFT JOIN {{classes}} n ON n.name = j.name""")
def join_03(v):
    out = J.resolve_classes(v.sql(CLASS_ROWS), v.classes, v.spark.sql(CLASS_MAP))
    return out.selectExpr("row_id", "CASE WHEN how <> 'created' THEN class_id END AS known_class", "how")


@query("join_06", f"""
SELECT a.image_id, a.annotation_id AS a_id, b.annotation_id AS b_id FROM {{annotations}} a JOIN {{annotations}} b ON a.image_id = b.image_id
 AND a.annotation_id <> b.annotation_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 WHERE a.{LIVE} AND b.{LIVE}""")
def join_06(v):
    return J.neighbours(v.annotations).select("image_id", "a_id", "b_id")


POINTS = """SELECT annotation_id AS point_id, image_id, x0 + s_key % 60 AS px, y0 + p_key % 50 AS py FROM {annotations}"""


@query("join_07", f"""
SELECT p.point_id, max(a.annotation_id) AS top_id, count(*) AS hits FROM ({POINTS}) p JOIN {{annotations}} a ON a.image_id = p.image_id
 AND a.x0 <= p.px AND p.px < a.x1 AND a.y0 <= p.py AND p.py < a.y1 WHERE a.{LIVE} GROUP BY p.point_id""")
def join_07(v):
    live = v.annotations.filter(P.LIVE)
    masks = live.select("image_id", "annotation_id", "x0", "x1", "y0", "y1")
    return J.top_object(J.objects_at(v.sql(POINTS), masks))


@query("join_07_polygons", f"""
SELECT point_id, max(annotation_id) AS top_id, count(*) AS hits FROM (
  SELECT p.point_id, p.px + 0.5 AS x, p.py + 0.5 AS y, a.annotation_id, a.x0, a.y0, a.x1, a.y1 FROM ({POINTS}) p JOIN {{annotations}} a ON a.image_id = p.image_id WHERE a.{LIVE}) q
WHERE x > x0 AND y > y0 AND y < y1 AND x < CAST(x0 - x1 AS DOUBLE) * (y - y0) / (y1 - y0) + x1 GROUP BY point_id""")
def join_07_polygons(v):
    """Pixel centres inside right triangles that fill the upper left half of each box."""
    corners = "CAST(array(struct(x0 AS x, y0 AS y), struct(x1 AS x, y0 AS y), struct(x0 AS x, y1 AS y)) AS array<struct<x: double, y: double>>) AS points"
    shapes = v.annotations.filter(P.LIVE).selectExpr("image_id", "annotation_id", corners)
    centres = v.sql(POINTS).withColumns({"px": F.expr("CAST(px + 0.5 AS DOUBLE)"), "py": F.expr("CAST(py + 0.5 AS DOUBLE)")})
    return J.top_object(J.polygons_at(centres, shapes))


@query("join_08", """
SELECT c.layer_id, count(*) FILTER (WHERE t.signature IS NULL) AS kept, count(*) FILTER (WHERE t.signature IS NOT NULL) AS suppressed
FROM {candidates} c LEFT JOIN {tombstones} t ON c.image_id = t.image_id AND c.layer_id = t.layer_id AND c.signature = t.signature GROUP BY 1""")
def join_08(v):
    kept, dropped = J.drop_tombstoned(v.candidates, v.tombstones)
    return (kept.withColumn("k", F.lit(True)).unionByName(dropped.withColumn("k", F.lit(False)))
            .groupBy("layer_id").agg(F.count_if("k").alias("kept"), F.count_if(~F.col("k")).alias("suppressed")))


PROPOSALS = """
SELECT annotation_id, CASE WHEN s_key % 4 = 0 THEN revision + 1 ELSE revision END AS revision, model_id,
       CASE line % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'retained' ELSE 'dismissed_stale' END AS status
FROM {annotations} WHERE p_key % 2 = 0"""


@query("join_09", f"""
SELECT a.annotation_id, a.revision, a.model_id FROM {{annotations}} a WHERE {SEAM} AND NOT EXISTS (
  SELECT 1 FROM ({PROPOSALS}) p WHERE p.annotation_id = a.annotation_id AND p.revision = a.revision AND p.model_id = a.model_id
   AND p.status IN ('retained', 'excluded', 'accepted', 'pending'))""")
def join_09(v):
    seams = v.annotations.filter(P.touches_seam()).select("annotation_id", "revision", "model_id")
    return J.undecided(seams, v.sql(PROPOSALS))


@query("join_10", """
SELECT d.request_id, count(*) FILTER (WHERE a.annotation_id IS NULL) AS missing,
       count(*) FILTER (WHERE a.revision <> d.expected_revision) AS stale
FROM {decisions} d LEFT JOIN {annotations} a ON a.annotation_id = d.annotation_id
GROUP BY d.request_id HAVING count(*) FILTER (WHERE a.annotation_id IS NULL OR a.revision <> d.expected_revision) > 0""")
def join_10(v):
    return J.split_stale(v.decisions, v.annotations)[1]


@query("join_11", """
SELECT group_id, count(*) AS images FROM {images} WHERE NOT removed AND role <> 'excluded' GROUP BY group_id
HAVING count(DISTINCT CASE WHEN role = 'validation' THEN 'val' WHEN role = 'test' THEN 'test' ELSE 'train' END) > 1""")
def join_11(v):
    return J.leaking_groups(v.images.filter("NOT removed AND role <> 'excluded'"))


@query("join_12", """
SELECT sha256, count(*) FILTER (WHERE role IN ('pool', 'train')) AS train_images, count(*) FILTER (WHERE role = 'validation') AS val_images
FROM {images} WHERE role IN ('pool', 'train', 'validation') GROUP BY sha256
HAVING count(*) FILTER (WHERE role IN ('pool', 'train')) > 0 AND count(*) FILTER (WHERE role = 'validation') > 0""")
def join_12(v):
    return J.leaking_bytes(v.images)


MAPPING = """
SELECT DISTINCT model_id, model_class_index, 'Brand#' || CAST(model_class_index + 1 AS STRING) AS to_class,
       CASE WHEN model_id = 'model-2' THEN 3 ELSE 4 END AS class_version FROM {annotations} WHERE model_class_index < 4"""


@query("join_13", f"""
SELECT a.annotation_id, m.to_class, CASE WHEN a.model_id = 'model-2' THEN 'refused' ELSE 'mapped' END AS outcome
FROM {{annotations}} a LEFT JOIN ({MAPPING}) m ON m.model_id = a.model_id AND m.model_class_index = a.model_class_index AND m.class_version = 4""")
def join_13(v):
    preds = v.annotations.select("annotation_id", "model_id", "model_class_index")
    mapped, refused = J.map_predictions(preds, v.sql(MAPPING), class_version=4)
    return (mapped.selectExpr("annotation_id", "to_class", "'mapped' AS outcome")
            .unionByName(refused.selectExpr("annotation_id", "CAST(NULL AS STRING) AS to_class", "'refused' AS outcome")))


EDGES = """
SELECT a.annotation_id AS parent_id, c.child_id FROM {annotations} a JOIN (
  SELECT image_id, line - 1 AS line, min(annotation_id) AS child_id FROM {annotations} GROUP BY image_id, line) c
  ON c.image_id = a.image_id AND c.line = a.line WHERE a.line % 4 <> 0"""


@query("join_14", f"""
WITH RECURSIVE e AS ({EDGES}), up AS (
  SELECT annotation_id, annotation_id AS root_id, CAST(0 AS BIGINT) AS depth FROM {{annotations}}
  UNION ALL SELECT up.annotation_id, e.child_id, up.depth + 1 FROM up JOIN e ON e.parent_id = up.root_id)
SELECT annotation_id, arg_max(root_id, depth) AS root_id, max(depth) AS depth, false AS cyclic FROM up GROUP BY annotation_id""")
def join_14(v):
    return J.lineage(v.annotations, v.sql(EDGES))


@query("join_14_rules", f"""
SELECT e.child_id, count(*) AS parents, CAST(0 AS BIGINT) AS "foreign", count(*) FILTER (WHERE p.status <> 'superseded') AS live_parents,
  CAST(0 AS BIGINT) AS shared_parents, false AS cyclic
FROM ({EDGES}) e JOIN {{annotations}} p ON p.annotation_id = e.parent_id GROUP BY e.child_id
HAVING count(*) < 2 OR count(*) FILTER (WHERE p.status <> 'superseded') > 0""", stored=("annotations",))
def join_14_rules(v):
    return J.lineage_issues(v.annotations, v.sql(EDGES))


@query("join_15", """
SELECT image_id, role FROM {images} WHERE role IN ('train', 'validation')
   OR (role = 'pool' AND image_id IN (SELECT image_id FROM {rounds} WHERE round_number <= 3))""")
def join_15(v):
    return J.cumulative(v.images, v.rounds, 3).select("image_id", "role")


OTHER = """
SELECT image_id + 1000000 AS image_id, sha256, CASE WHEN image_id % 6 = 0 THEN width + 2 ELSE width END AS width, height,
       CASE WHEN image_id % 9 = 0 THEN 'test' ELSE role END AS role FROM {images} WHERE image_id % 2 = 0"""


@query("join_16", f"""
SELECT a.sha256, a.image_id AS a_image, b.image_id AS b_image, CASE WHEN a.n > 1 OR b.n > 1 THEN 'not_unique'
       WHEN a.width <> b.width OR a.height <> b.height THEN 'dimensions' WHEN a.role <> b.role THEN 'role' ELSE 'matched' END AS result
FROM (SELECT sha256, count(*) AS n, min(image_id) AS image_id, min(width) AS width, min(height) AS height, min(role) AS role FROM {{images}} GROUP BY sha256) a
JOIN (SELECT sha256, count(*) AS n, min(image_id) AS image_id, min(width) AS width, min(height) AS height, min(role) AS role FROM ({OTHER}) o GROUP BY sha256) b ON a.sha256 = b.sha256""")
def join_16(v):
    return J.match_datasets(v.images, v.sql(OTHER))


REQUESTS = """
SELECT image_id AS request_id, 'model-sha' AS model_sha256, sha256 AS image_sha256, '0,0,512,512' AS crop, 'v1' AS settings,
       least(512, width) AS tile_w, least(512, height) AS tile_h FROM {images}"""
RESULTS = """
SELECT a.image_id AS request_id, a.annotation_id AS proposal_id, CASE WHEN a.s_key % 23 = 0 THEN 'other' ELSE 'model-sha' END AS model_sha256, i.sha256 AS image_sha256,
       CASE WHEN a.s_key % 19 = 0 THEN '0,0,256,256' ELSE '0,0,512,512' END AS crop, 'v1' AS settings,
       CASE WHEN a.line = 6 THEN a.class_id END AS class_id, CASE WHEN a.line = 5 THEN a.status ELSE 'proposal' END AS status,
       CASE WHEN a.line = 4 THEN a.review_actor END AS review_actor, least(512, a.width) AS mask_w,
       CASE WHEN a.line = 3 THEN 100 ELSE least(512, a.height) END AS mask_h
FROM {annotations} a JOIN {images} i ON a.image_id = i.image_id"""


@query("join_17", f"""
SELECT request_id, proposal_id, reason FROM (
SELECT r.request_id, r.proposal_id, CASE WHEN q.request_id IS NULL THEN 'unknown_request' WHEN r.model_sha256 <> q.model_sha256 THEN 'model'
  WHEN r.image_sha256 <> q.image_sha256 THEN 'image' WHEN r.crop <> q.crop THEN 'crop' WHEN r.settings <> q.settings THEN 'settings' WHEN r.class_id IS NOT NULL THEN 'class_assigned'
  WHEN r.status <> 'proposal' THEN 'status' WHEN r.review_actor IS NOT NULL THEN 'reviewed' WHEN r.mask_w <> q.tile_w OR r.mask_h <> q.tile_h THEN 'mask_size' END AS reason
FROM ({RESULTS}) r LEFT JOIN ({REQUESTS}) q ON q.request_id = r.request_id) z WHERE reason IS NOT NULL""")
def join_17(v):
    return J.check_receipts(v.sql(RESULTS), v.sql(REQUESTS))


def nms_boxes(v):
    return v.annotations.selectExpr("annotation_id AS id", "image_id", "model_class_index", "score", "annotation_id AS ordinal",
                                    "x0", "y0", "x1", "y1")


def greedy_sql(rows, edges):
    """Greedy suppression over an edge list (better, worse): a row is kept when no kept row beats it.

    The recursion walks rows in priority order inside each group; only rows with edges take part.
    """
    return f"""
WITH RECURSIVE e AS ({edges}), n AS (SELECT DISTINCT id FROM (SELECT better AS id FROM e UNION ALL SELECT worse FROM e) u),
o AS (SELECT n.id, r.g, row_number() OVER (PARTITION BY r.g ORDER BY r.score DESC, n.id) AS k FROM n JOIN ({rows}) r ON r.id = n.id),
b AS (SELECT o.id, o.g, o.k, list(e.better) FILTER (WHERE e.better IS NOT NULL) AS better FROM o LEFT JOIN e ON e.worse = o.id GROUP BY o.id, o.g, o.k),
w AS (SELECT g, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS kept FROM (SELECT DISTINCT g FROM o) q
      UNION ALL SELECT w.g, b.k, CASE WHEN b.better IS NOT NULL AND list_has_any(w.kept, b.better) THEN w.kept ELSE list_append(w.kept, b.id) END FROM w JOIN b ON b.g = w.g AND b.k = w.k + 1),
f AS (SELECT g, arg_max(kept, k) AS kept FROM w GROUP BY g),
v AS (SELECT o.id, list_contains(f.kept, o.id) AS kept FROM o JOIN f ON f.g = o.g)"""


BOX_ROWS = """SELECT annotation_id AS id, CAST(image_id AS STRING) || '/' || CAST(model_class_index AS STRING) AS g, score FROM {annotations}"""
BOX_EDGES = """
SELECT a.annotation_id AS better, b.annotation_id AS worse FROM {annotations} a JOIN {annotations} b ON a.image_id = b.image_id
 AND a.model_class_index = b.model_class_index AND (a.score > b.score OR (a.score = b.score AND a.annotation_id < b.annotation_id))
 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
WHERE CAST((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS DOUBLE)
    / (a.area + b.area - (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) > 0.5"""


@query("nms_01", greedy_sql(BOX_ROWS, BOX_EDGES) + """
SELECT a.annotation_id AS id, coalesce(v.kept, true) AS kept, CASE WHEN NOT v.kept THEN (
    SELECT arg_min(e.better, struct_pack(s := -k.score, i := e.better)) FROM e JOIN v kv ON kv.id = e.better AND kv.kept JOIN {annotations} k ON k.annotation_id = e.better
    WHERE e.worse = a.annotation_id) END AS kept_id
FROM {annotations} a LEFT JOIN v ON v.id = a.annotation_id""")
def nms_01(v):
    return N.box_nms(nms_boxes(v))


# Forty planes hold the boxes of all images: hundreds of rivals per class, more than fold in a row.
CROWDED = """
SELECT annotation_id AS id, CAST(image_id % 40 AS BIGINT) AS image_id, model_class_index, score, annotation_id AS ordinal, x0, y0, x1, y1 FROM {annotations}"""
CROWDED_ROWS = BOX_ROWS.replace("CAST(image_id AS STRING)", "CAST(image_id % 40 AS STRING)")
CROWDED_EDGES = BOX_EDGES.replace("a.image_id = b.image_id", "a.image_id % 40 = b.image_id % 40")
FATE = """
SELECT a.annotation_id AS id, coalesce(v.kept, true) AS kept, CASE WHEN NOT v.kept THEN (
    SELECT arg_min(e.better, struct_pack(s := -k.score, i := e.better)) FROM e JOIN v kv ON kv.id = e.better AND kv.kept JOIN {annotations} k ON k.annotation_id = e.better
    WHERE e.worse = a.annotation_id) END AS kept_id
FROM {annotations} a LEFT JOIN v ON v.id = a.annotation_id"""


@query("nms_01_crowded", greedy_sql(CROWDED_ROWS, CROWDED_EDGES) + FATE)
def nms_01_crowded(v):
    """Crowded planes: cells, thinning and the conflict graph in rounds."""
    return N.box_nms(v.sql(CROWDED), max_local=50)


@query("agg_10", greedy_sql(BOX_ROWS, BOX_EDGES) + """
SELECT a.image_id, count(*) AS input_count, count(*) FILTER (WHERE coalesce(v.kept, true)) AS kept_count, count(*) FILTER (WHERE NOT v.kept) AS suppressed_count
FROM {annotations} a LEFT JOIN v ON v.id = a.annotation_id GROUP BY a.image_id""")
def agg_10(v):
    boxes = nms_boxes(v)
    return N.suppression_report(boxes, N.box_nms(boxes))


KEY = "coalesce(class_id, 'model:' || model_id || ':' || CAST(model_class_index AS STRING))"
MASK_ROWS = f"SELECT annotation_id AS id, CAST(image_id AS STRING) || '/' || {KEY} AS g, score FROM {{annotations}}"
MASK_EDGES = BOX_EDGES.replace("a.model_class_index = b.model_class_index", f"{KEY.replace('class_id', 'a.class_id').replace('model_id', 'a.model_id').replace('model_class_index', 'a.model_class_index')} = {KEY.replace('class_id', 'b.class_id').replace('model_id', 'b.model_id').replace('model_class_index', 'b.model_class_index')}").replace("> 0.5", ">= 0.8")
MASK_EDGES = MASK_EDGES.replace("model_a.", "a.").replace("model_b.", "b.")


@query("nms_02", greedy_sql(MASK_ROWS, MASK_EDGES) + """
SELECT a.annotation_id AS id, coalesce(v.kept, true) AS kept FROM {annotations} a LEFT JOIN v ON v.id = a.annotation_id""", stored=("annotations",))
def nms_02(v):
    rows = v.annotations.withColumn("key", N.class_key()).selectExpr("annotation_id AS id", "image_id", "key", "score", "annotation_id AS ordinal")
    return N.mask_nms(rows, slabs(v).selectExpr("annotation_id AS id", "x0", "x1", "y0", "y1"))


@query("nms_02_crowded", greedy_sql(MASK_ROWS.replace("CAST(image_id AS STRING)", "CAST(image_id % 40 AS STRING)"),
                                    MASK_EDGES.replace("a.image_id = b.image_id", "a.image_id % 40 = b.image_id % 40")) + """
SELECT a.annotation_id AS id, coalesce(v.kept, true) AS kept FROM {annotations} a LEFT JOIN v ON v.id = a.annotation_id""")
def nms_02_crowded(v):
    """Masks of many images on forty planes, through the conflict graph."""
    rows = v.annotations.withColumn("key", N.class_key()).selectExpr("annotation_id AS id", "image_id % 40 AS image_id", "key", "score", "annotation_id AS ordinal")
    return N.mask_nms(rows, slabs(v).selectExpr("annotation_id AS id", "x0", "x1", "y0", "y1"), max_local=20)


@query("nms_03", "SELECT image_id, layer_id, signature, min(annotation_id) AS proposal_id, count(*) AS origins FROM {candidates} GROUP BY 1, 2, 3")
def nms_03(v):
    return N.collapse_identical(v.candidates)[0]


@query("agg_13", """
SELECT annotation_id, min(annotation_id) OVER (PARTITION BY image_id, layer_id, signature) AS proposal_id FROM {candidates}""")
def agg_13(v):
    return N.collapse_identical(v.candidates)[1].select("annotation_id", "proposal_id")
