"""Image files: manifest, content dedup and tile pixels."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.headers import image_header
from ..model import MAX_FILE_BYTES, MAX_PIXELS

# Fixed value: endings of the image files a manifest takes.
READABLE = r"(?i).*\.(png|jpe?g|mpo|bmp|webp|tiff?)$"
PIXELS = "image_id STRING, width INT, height INT, channels INT, data BINARY"


def judge_files(files: DataFrame) -> DataFrame:
    """``files`` (path, length, content) with sha256, size as seen after the EXIF turn, stored size and ``reason`` to reject.

    Sizes come from headers, nothing is decoded. A file without a known signature is undecodable if its name ends
    like an image and unsupported otherwise; several pictures in a file and more than 8 bits a sample are refused.
    """
    # A generator keeps the optimizer from repeating the walk in every column and filter that reads its result.
    read = files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.expr(f"explode_outer(array({image_header('content')})) AS h"))
    turned = "h.turn BETWEEN 5 AND 8"
    return read.selectExpr(
        "path", "length", "sha256", f"CAST(CASE WHEN {turned} THEN h.height ELSE h.width END AS INT) AS width",
        f"CAST(CASE WHEN {turned} THEN h.width ELSE h.height END AS INT) AS height", "h.format AS source_format",
        "CAST(h.width AS INT) AS source_width", "CAST(h.height AS INT) AS source_height", "CAST(coalesce(h.turn, 1) AS INT) AS orientation",
        f"""CASE WHEN length > {MAX_FILE_BYTES} THEN 'file_too_large' WHEN h IS NULL AND NOT path RLIKE '{READABLE}' THEN 'unsupported_format'
        WHEN coalesce(h.width, 0) <= 0 OR coalesce(h.height, 0) <= 0 OR NOT coalesce(h.whole, false) THEN 'undecodable'
        WHEN h.frames THEN 'several_pictures' WHEN h.bits > 8 THEN 'high_bit_depth'
        WHEN h.width * h.height > {MAX_PIXELS} THEN 'too_many_pixels' END AS reason""")


def image_manifest(spark: SparkSession, path: str, role: str = "pool"):
    """Returns (images, rejects) for a directory of image files.

    Identity is the SHA-256 of the bytes. Files beyond the size limit are rejected by their length and never read;
    empty files are not listed by Spark's reader and appear in neither table.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    judged = judge_files(files.filter(F.col("length") <= MAX_FILE_BYTES))
    large = files.filter(F.col("length") > MAX_FILE_BYTES).select("path", F.lit("file_too_large").alias("reason"))
    images = judged.filter("reason IS NULL").selectExpr(
        "path", "regexp_extract(path, '([^/]*)$', 1) AS name", "sha256", "width", "height", "source_format", "source_width", "source_height", "orientation",
        f"'{role}' AS role", "sha256 AS group_id", "false AS complete", "false AS removed", "CAST(0 AS BIGINT) AS revision")
    return images, judged.filter("reason IS NOT NULL").select("path", "reason").unionByName(large)


def dedup_by_hash(new: DataFrame, existing: DataFrame):
    """Returns (imported, duplicates): bytes known from an active image, or seen earlier in the batch.

    ``new``: path, sha256. The first path of equal bytes is imported; a removed image does not count.
    """
    active = existing.filter("NOT removed").select("sha256").distinct()
    first = new.groupBy("sha256").agg(F.min("path").alias("_first"))
    fresh = first.join(active, "sha256", "left_anti").withColumn("_new", F.lit(True))
    marked = new.join(fresh, "sha256", "left").withColumn("_import", F.expr("_new IS NOT NULL AND path = _first"))
    return marked.filter("_import").drop("_first", "_new", "_import"), marked.filter("NOT _import").drop("_first", "_new", "_import")


def pixel_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images of a directory: path, width, height, channels, data (interleaved rows)."""
    return (spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
            .selectExpr("image.origin AS path", "image.width AS width", "image.height AS height", "image.nChannels AS channels", "image.data AS data"))


def tile_pixels(pictures: DataFrame, size: int = 512, stride: int | None = None) -> DataFrame:
    """Square crops of :func:`pixel_images`, as raw interleaved bytes.

    Short crops are filled on the right and bottom with the bottom-right source pixel. Images spread
    over tasks; one image at a time is cut.
    """
    stride = stride or size
    source = pictures.select("path", "width", "height", "channels", "data")

    def origins(length):
        far = max(0, length - size)
        return [min(i * stride, far) for i in range(far // stride + 1 + (far % stride > 0))]

    def cut(batches):
        for batch in batches:
            for path_, w, h, c, data in zip(batch["path"], batch["width"], batch["height"], batch["channels"], batch["data"]):
                picture = np.frombuffer(data, np.uint8).reshape(h, w, c)
                rows = []
                for y in origins(h):
                    for x in origins(w):
                        crop = picture[y:y + size, x:x + size]
                        tile = np.empty((size, size, c), np.uint8)
                        tile[:] = crop[-1, -1]
                        tile[:crop.shape[0], :crop.shape[1]] = crop
                        rows.append((path_, len(rows), x, y, crop.shape[1], crop.shape[0], c, tile.tobytes()))
                yield _frame(rows)

    return source.mapInPandas(cut, "path STRING, tile_idx BIGINT, x0 INT, y0 INT, valid_w INT, valid_h INT, channels INT, data BINARY")


def _frame(rows):
    import pandas as pd
    return pd.DataFrame(rows, columns=["path", "tile_idx", "x0", "y0", "valid_w", "valid_h", "channels", "data"])


def plane_columns(spark: SparkSession, path: str) -> DataFrame:
    """Single-channel label images as one row per pixel column: name, width, height, x, values."""
    source = (spark.read.format("image").load(path).filter("image.nChannels = 1")
              .selectExpr("regexp_extract(image.origin, '([^/]*)$', 1) AS name", "image.width AS width", "image.height AS height", "image.data AS data"))

    def split(batches):
        import pandas as pd
        for batch in batches:
            for name, w, h, data in zip(batch["name"], batch["width"], batch["height"], batch["data"]):
                plane = np.frombuffer(data, np.uint8).reshape(h, w).T.astype(np.int32)
                yield pd.DataFrame({"name": name, "width": w, "height": h, "x": np.arange(w), "values": list(plane)})

    return source.mapInPandas(split, "name STRING, width INT, height INT, x BIGINT, values ARRAY<INT>")
