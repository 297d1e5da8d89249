"""Frozen training snapshots and their verified reading."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.aggregates import readiness, tileable
from ..operators.predicates import training_disposition, training_rows, training_split
from ..operators.tiling import TRAINING, all_tiles
from ..operators.training import WHOLE, compile_labels, label_files
from ..operators.windows import class_index
from ..session import ensure_checkpoint_dir


def snapshot_rows(images: DataFrame, annotations: DataFrame, classes: DataFrame, round_images: DataFrame | None = None, qa_smoke: bool = False):
    """Returns (images, versions): the included images and the annotation versions they freeze."""
    included = training_disposition(images, annotations, round_images, qa_smoke).filter("reason IS NULL").selectExpr(
        "image_id", "group_id", "sha256", f"{training_split()} AS split")
    rows = training_rows(images, annotations, classes, round_images, qa_smoke).filter("class_ok")
    versions = rows.join(class_index(classes, 0).select("class_id", "class_index"), "class_id").selectExpr(
        "annotation_id", "image_id", "class_id", "class_index", "revision", "review_actor", "coalesce(review_actor = 'human', false) AS human_verified",
        f"{training_split()} AS split")
    return included, versions


def content_hash(df: DataFrame, *columns: str) -> DataFrame:
    """Order-free digest of a table: row count, and sum and xor of row hashes, combined before the shuffle."""
    h1 = F.xxhash64(*columns)
    h2 = F.xxhash64(*reversed(columns), F.lit(17))
    return df.agg(F.count("*").alias("rows"), F.bit_xor(h1).alias("xor_hash"), F.sum(h2.cast("decimal(38,0)")).alias("sum_hash")).selectExpr(
        "rows", "sha2(concat_ws(':', rows, xor_hash, sum_hash), 256) AS sha256")


def build_snapshot(images: DataFrame, annotations: DataFrame, classes: DataFrame, slabs: DataFrame, path: str,
                   round_images: DataFrame | None = None, qa_smoke: bool = False, require_ready: bool = True,
                   layout: str = "tiles_512", allow_lossy: bool = False, imgsz: int = 512) -> DataFrame:
    """Write an immutable snapshot: images, versions, label rows, label files by tile, and a receipt with table digests.

    The labels are compiled once, into the shared scratch folder; the readiness report and the snapshot read that table.
    """
    if layout == "tiles_512" and imgsz != 512:
        raise ValueError("training on 512-px tiles needs an image size of 512")
    spark = images.sparkSession
    rows = training_rows(images, annotations, classes, round_images, qa_smoke)
    compiled = f"{ensure_checkpoint_dir(spark).rstrip('/')}/labels-{uuid.uuid4().hex}"
    compile_labels(rows, slabs, images, classes, layout, allow_lossy).write.parquet(compiled)
    labels = spark.read.parquet(compiled)
    # Published first and whole: the exception only names the report.
    readiness(images, annotations, classes, round_images, qa_smoke, labels=labels).write.mode("errorifexists").parquet(f"{path}/readiness")
    errors = spark.read.parquet(f"{path}/readiness").filter("metric = 'error'").count()
    if require_ready and errors:
        raise ValueError(f"training data not ready: {errors} kinds of errors, listed in {path}/readiness")
    included, versions = snapshot_rows(images, annotations, classes, round_images, qa_smoke)
    framed = tileable(images.join(included.select("image_id"), "image_id", "left_semi"))
    tiles = all_tiles(framed, TRAINING if layout == "tiles_512" else WHOLE, padded=layout == "tiles_512").drop("width", "height")
    parts = {"images": included, "versions": versions, "labels": labels, "tiles": label_files(labels, tiles), "classes": class_index(classes, 0)}
    for name, df in parts.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    receipt = None
    for name in parts:
        stored = spark.read.parquet(f"{path}/{name}")
        line = content_hash(stored, *sorted(stored.columns)).withColumn("table", F.lit(name))
        receipt = line if receipt is None else receipt.unionByName(line)
    receipt.write.mode("errorifexists").parquet(f"{path}/receipt")
    return spark.read.parquet(f"{path}/receipt")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every data file below a snapshot."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
            .select(F.regexp_extract("path", "([^/]*/[^/]*)$", 1).alias("file"), "length", F.sha2("content", 256).alias("sha256")))


def seal_snapshot(spark: SparkSession, path: str) -> None:
    """Record the file hashes next to the snapshot tables."""
    file_hashes(spark, path).write.mode("errorifexists").json(f"{path}/files")


def read_snapshot(spark: SparkSession, path: str, project_id: str) -> dict[str, DataFrame]:
    """Verify every recorded file hash, then load the tables under a new project id."""
    listed = spark.read.schema("file STRING, length BIGINT, sha256 STRING").json(f"{path}/files")
    now = file_hashes(spark, path).select("file", F.col("sha256").alias("_now"))
    broken = listed.join(now, "file", "full").filter("sha256 IS NULL OR _now IS NULL OR sha256 <> _now")
    first = broken.limit(5).collect()
    if first:
        raise ValueError(f"snapshot files changed: {[r['file'] for r in first]}")
    return {name: spark.read.parquet(f"{path}/{name}").withColumn("project_id", F.lit(project_id))
            for name in ("images", "versions", "labels", "tiles", "classes", "receipt")}
