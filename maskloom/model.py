"""Table names, fixed value sets and limits of the mask-annotation data model."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

# The vocabulary of the data model.
STATUSES = ("draft", "proposal", "accepted", "rejected", "superseded")
ROLES = ("pool", "train", "validation", "test", "excluded")
SPLITS = ("train", "val", "test")
EXPORT_FORMATS = ("coco", "yolo_seg", "yolo_box", "voc", "labelme", "png")

# Limits of the data model.
MAX_PIXELS = 100_000_000
MAX_FILE_BYTES = 256 * 1024 * 1024
MAX_TILES = 10_000
MAX_VERTICES = 1_000_000
MAX_MERGE_PARENTS = 1_000
MAX_SELECTION = 1_024
MAX_PROPOSALS = 5_000
MAX_PROPOSALS_LIMIT = 20_000
MAX_PLANE_VALUE = 65_535

# The numbers of seam repair, by where they are used.
class RepairCrops(NamedTuple):
    """Sides tried around a seam object, the context left on each side, and how many crops a detector's object or any other gets."""
    sides: tuple[int, ...] = (512, 1024, 1536)
    margin: int = 32
    detector: int = 3
    other: int = 1


class RepairGates(NamedTuple):
    """What a replacement must keep of its target, how its area may change, the quality it needs, and what it may cover of neighbours."""
    keeps: float = 0.90
    shrinks: float = 0.8
    grows: float = 3.0
    quality: float = 0.80
    stability: float = 0.88
    intrudes: float = 0.10


class RepairPartners(NamedTuple):
    """How much of a neighbour a replacement must cover to absorb it, and the least share of the target it must be."""
    covered: float = 0.90
    share: float = 0.03


class RepairAgreement(NamedTuple):
    """When candidates count as the same."""
    iou: float = 0.95
    ratio: float = 1.10


CROPS, GATES, PARTNERS, AGREEMENT = RepairCrops(), RepairGates(), RepairPartners(), RepairAgreement()

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

SLAB_SCHEMA = "image_id BIGINT, annotation_id STRING, x0 BIGINT, x1 BIGINT, y0 BIGINT, y1 BIGINT"
"""A slab is the vertical run [y0, y1) repeated over the pixel columns [x0, x1).

A mask is a set of non-overlapping slabs. A column segment is a slab of width one and an
integer box is a single slab, so area, bounds, crop, translate and overlap are plain row
arithmetic on either form.
"""
