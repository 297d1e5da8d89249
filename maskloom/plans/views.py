"""Mask-dataset views derived from the star-schema tables.

Each view is one SQL text that Spark and DuckDB read the same way; ``{name}`` stands for an
input table or another view and ``SHA<<x>>`` for the engine's hexadecimal SHA-256 of x.
"""
from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.masks import box_signature_text
from ..session import ensure_checkpoint_dir

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

# The canonical mask signature of a box.
BOX_SIGNATURE = box_signature_text("SHA<<{}>>")

VIEWS["images"] = """
SELECT o_orderkey AS image_id,
       600 + (o_custkey * 37) % 1500 AS width,
       480 + (o_custkey * 53) % 1100 AS height,
       CASE substring(o_orderpriority, 1, 1)
            WHEN '1' THEN 'validation' WHEN '2' THEN 'train' WHEN '3' THEN 'pool'
            WHEN '4' THEN 'test'
            ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'pool' ELSE 'excluded' END END AS role,
       o_orderstatus <> 'O' AS complete,
       CASE WHEN o_orderstatus = 'O' THEN NULL
            WHEN o_orderkey % 5 = 0 THEN 'automated_qa' ELSE 'human' END AS review_actor,
       'g' || CAST(o_custkey AS STRING) AS group_id,
       o_orderkey % 41 = 0 AS removed,
       o_orderkey % 29 = 0 AS training_excluded,
       'img_' || CAST(o_orderkey % 5000 AS STRING) || '.png' AS name,
       CAST(o_custkey % 4 AS BIGINT) AS revision,
       SHA<<'image-' || CAST(o_orderkey - o_orderkey % 97 * CAST(o_orderkey % 50 = 7 AS INT) AS STRING)>> AS sha256,
       CASE WHEN o_orderkey % 53 = 0 THEN 'linked_original' WHEN o_orderkey % 59 = 0 THEN 'image' END AS missing
FROM {orders}
"""

VIEWS["annotations"] = """
SELECT b.*,
       x0 - x0 % 512 AS tx0, y0 - y0 % 512 AS ty0,
       least(x0 - x0 % 512 + 512, width) AS tx1, least(y0 - y0 % 512 + 512, height) AS ty1,
       (x1 - x0) * (y1 - y0) AS area
FROM (
  SELECT a.*, x0 + 40 + s_key % 60 AS x1, y0 + 40 + line * 8 AS y1
  FROM (
    SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||
           CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' ||
           CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) AS annotation_id,
           l_orderkey AS image_id,
           CASE WHEN l_discount < 0.005 THEN NULL ELSE p_brand END AS class_id,
           CASE WHEN l_returnflag = 'A' THEN 'accepted'
                WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'draft'
                WHEN l_returnflag = 'R' THEN 'rejected'
                WHEN l_linestatus = 'F' THEN 'proposal'
                WHEN l_linenumber % 2 = 0 THEN 'superseded' ELSE 'proposal' END AS status,
           CAST(p_size % 5 AS INT) AS model_class_index,
           1 - l_discount - l_tax / 2 AS score,
           (l_partkey % 8) * CAST(floor(i.width / 9) AS BIGINT) AS x0,
           (l_partkey % 5) * CAST(floor(i.height / 7) AS BIGINT) AS y0,
           CAST(l_suppkey AS BIGINT) AS s_key, CAST(l_linenumber AS BIGINT) AS line,
           CAST(l_partkey AS BIGINT) AS p_key,
           i.width, i.height,
           CAST(l_partkey % 3 AS BIGINT) AS revision,
           CASE WHEN l_returnflag = 'A' THEN
                CASE WHEN l_orderkey % 5 = 0 THEN 'automated_qa' WHEN l_partkey % 17 = 0 THEN 'import' ELSE 'human' END
                END AS review_actor,
           l_returnflag = 'A' AND l_partkey % 31 = 0 AS training_excluded,
           CASE WHEN l_linenumber % 5 = 0 THEN 'box' ELSE 'mask' END AS geom_type,
           CASE WHEN l_returnflag = 'N' THEN CAST(l_suppkey % 3 AS BIGINT) END AS layer_id,
           l_suppkey % 11 = 0 AS manually_edited,
           CASE l_suppkey % 4 WHEN 0 THEN 'yolo' WHEN 1 THEN 'sam2' WHEN 2 THEN 'sam3' ELSE 'manual' END AS source_kind,
           CASE l_partkey % 5 WHEN 0 THEN 'sam_assist' WHEN 1 THEN 'automatic_mask_generation' END AS operation,
           'model-' || CAST(l_suppkey % 3 AS STRING) AS model_id,
           round(0.70 + (l_partkey % 30) / 100.0, 2) AS predicted_iou,
           round(0.80 + (l_suppkey % 20) / 100.0, 2) AS stability_score
    FROM {lineitem} l JOIN {images} i ON l.l_orderkey = i.image_id
                      JOIN {part} p ON l.l_partkey = p.p_partkey
  ) a
) b
"""

VIEWS["classes"] = """
SELECT class_id, class_id AS name, 1000 - n AS ord, n % 7 = 0 AS archived
FROM (SELECT p_brand AS class_id, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS n
      FROM {part} GROUP BY p_brand) q
"""

# Masks that are no boxes, as slabs: an L, a frame, a staircase and two parts, by s_key.
VIEWS["shapes"] = """
WITH b AS (SELECT annotation_id, image_id, width, height, s_key % 4 AS kind, x0, y0, x1, y1,
                  CAST(floor((x0 + x1) / 2) AS BIGINT) AS mx, CAST(floor((y0 + y1) / 2) AS BIGINT) AS my FROM {annotations})
SELECT annotation_id, image_id, width, height, x0, mx AS x1, y0, y1 FROM b WHERE kind = 0
UNION ALL SELECT annotation_id, image_id, width, height, mx, x1, y0, my FROM b WHERE kind = 0
UNION ALL SELECT annotation_id, image_id, width, height, x0, x0 + 10, y0, y1 FROM b WHERE kind = 1
UNION ALL SELECT annotation_id, image_id, width, height, x0 + 10, x1 - 10, y0, y0 + 10 FROM b WHERE kind = 1
UNION ALL SELECT annotation_id, image_id, width, height, x0 + 10, x1 - 10, y1 - 10, y1 FROM b WHERE kind = 1
UNION ALL SELECT annotation_id, image_id, width, height, x1 - 10, x1, y0, y1 FROM b WHERE kind = 1
UNION ALL SELECT annotation_id, image_id, width, height, x0, x0 + 12, y0, y0 + 15 FROM b WHERE kind = 2
UNION ALL SELECT annotation_id, image_id, width, height, x0 + 12, x0 + 24, y0 + 9, y0 + 30 FROM b WHERE kind = 2
UNION ALL SELECT annotation_id, image_id, width, height, x0 + 24, x1, y0 + 20, y1 FROM b WHERE kind = 2
UNION ALL SELECT annotation_id, image_id, width, height, x0, x0 + 11, y0, y1 FROM b WHERE kind = 3
UNION ALL SELECT annotation_id, image_id, width, height, x1 - 13, x1, y0 + 5, y1 - 3 FROM b WHERE kind = 3
"""

VIEWS["edit_log"] = """
SELECT event_id AS seq, CAST(user_id AS BIGINT) AS image_id,
       CASE event_type WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'edit' WHEN 'view' THEN 'undo'
                       WHEN 'error' THEN 'redo' ELSE 'review' END AS action,
       ts AS created_at
FROM {events}
"""

VIEWS["files"] = """
SELECT doc_id, source || '/' || CAST(doc_id AS STRING) || '.png' AS path, text AS content,
       SHA<<text>> AS sha256
FROM {documents}
"""

VIEWS["rounds"] = """
SELECT image_id, 1 + image_id % 6 AS round_number,
       CASE WHEN image_id % 6 < 2 THEN 'review_complete' WHEN image_id % 6 = 2 THEN 'in_progress' ELSE 'planned' END AS status
FROM {images} WHERE role = 'pool' AND image_id % 10 < 8
"""

VIEWS["tombstones"] = """
SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS layer_id,
       <<SIGNATURE>> AS signature
FROM {annotations} WHERE status = 'rejected'
""".replace("<<SIGNATURE>>", BOX_SIGNATURE)

VIEWS["candidates"] = """
SELECT annotation_id, image_id, layer_id, score, x0, y0, x1, y1,
       <<SIGNATURE>> AS signature
FROM (SELECT annotation_id, image_id, CAST(s_key % 2 AS BIGINT) AS layer_id, score, x0, y0, x1, y1, width, height
      FROM {annotations} WHERE status <> 'rejected') q
""".replace("<<SIGNATURE>>", BOX_SIGNATURE)

# One request per image: the action and its arguments follow from the image key.
VIEWS["decisions"] = """
SELECT image_id AS request_id, image_id, annotation_id,
       CASE WHEN image_id % 7 = 0 THEN line % 3 ELSE revision END AS expected_revision,
       CASE image_id % 6 WHEN 0 THEN 'assign' WHEN 1 THEN 'accept' WHEN 2 THEN 'assign_accept'
                         WHEN 3 THEN 'reject' WHEN 4 THEN 'delete' ELSE 'assist_assign_accept' END AS action,
       'Brand#' || CAST(1 + image_id % 25 AS STRING) AS class_id,
       image_id % 4 <> 0 AS confirm,
       CASE WHEN image_id % 5 = 0 THEN 'automated_qa' ELSE 'human' END AS actor
FROM {annotations}
WHERE CASE WHEN image_id % 6 = 5 THEN status = 'draft'
           WHEN image_id % 6 = 4 THEN status <> 'superseded'
           WHEN image_id % 3 = 0 THEN status NOT IN ('rejected', 'superseded')
           ELSE status IN ('draft', 'proposal', 'accepted') END
"""

# How Spark builds a view where the common text reads its tables several times or in an order that costs exchanges;
# the rows are the same. Objects meet their part first: the last join leaves them by image, as what follows wants them.
_JOINS = """JOIN {images} i ON l.l_orderkey = i.image_id
                      JOIN {part} p ON l.l_partkey = p.p_partkey"""
SPARK_VIEWS = {
    "annotations": VIEWS["annotations"].replace(_JOINS, "JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {images} i ON l.l_orderkey = i.image_id"),
    "shapes": """
SELECT annotation_id, image_id, width, height, inline(CASE kind
  WHEN 0 THEN array(struct(x0, mx AS x1, y0, y1), struct(mx AS x0, x1, y0, my AS y1))
  WHEN 1 THEN array(struct(x0, x0 + 10 AS x1, y0, y1), struct(x0 + 10 AS x0, x1 - 10 AS x1, y0, y0 + 10 AS y1),
                    struct(x0 + 10 AS x0, x1 - 10 AS x1, y1 - 10 AS y0, y1), struct(x1 - 10 AS x0, x1, y0, y1))
  WHEN 2 THEN array(struct(x0, x0 + 12 AS x1, y0, y0 + 15 AS y1), struct(x0 + 12 AS x0, x0 + 24 AS x1, y0 + 9 AS y0, y0 + 30 AS y1),
                    struct(x0 + 24 AS x0, x1, y0 + 20 AS y0, y1))
  WHEN 3 THEN array(struct(x0, x0 + 11 AS x1, y0, y1), struct(x1 - 13 AS x0, x1, y0 + 5 AS y0, y1 - 3 AS y1)) END)
FROM (SELECT annotation_id, image_id, width, height, s_key % 4 AS kind, x0, y0, x1, y1,
             CAST(floor((x0 + x1) / 2) AS BIGINT) AS mx, CAST(floor((y0 + y1) / 2) AS BIGINT) AS my FROM {annotations}) b
""",
}


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


class Views:
    """Lazy DataFrames over one data directory, built from the view texts."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in TABLES):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                made = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                made = self.sql(SPARK_VIEWS.get(name, VIEWS[name]))
            self._made[name] = made
        return self._made[name]

    def store(self, *names: str) -> None:
        """Keep views as Parquet in the shared checkpoint folder: a query that reads one several times joins its tables once."""
        for name in names:
            path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
            made = getattr(self, name)
            made.write.option("compression", "zstd").parquet(path)
            self._made[name] = self.spark.read.schema(made.schema).parquet(path)

    def sql(self, text: str) -> DataFrame:
        """Run Spark SQL over the named views and tables."""
        text = re.sub(r"SHA<<(.*?)>>", r"sha2(\1, 256)", text, flags=re.S)
        return self.spark.sql(text, **{need: getattr(self, need) for need in _needs(text)})


def oracle(text: str) -> str:
    """Complete a DuckDB query over the views with the view definitions it uses."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for need in _needs(VIEWS[name]):
                visit(need)
            order.append(name)

    for need in _needs(text):
        visit(need)

    def bare(sql: str) -> str:
        sql = re.sub(r"SHA<<(.*?)>>", r"sha256(\1)", sql, flags=re.S)
        return re.sub(r"\{(\w+)\}", r"\1", sql)

    ctes = [f"{name} AS ({bare(VIEWS[name])})" for name in order]
    body = bare(text).strip()
    if not ctes:
        return body
    if body[:4].upper() == "WITH":
        head, rest = body[:4], body[4:].lstrip()
        recursive = rest[:9].upper() == "RECURSIVE"
        if recursive:
            rest = rest[9:]
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + ",\n" + rest
    return "WITH " + ",\n".join(ctes) + "\n" + body
