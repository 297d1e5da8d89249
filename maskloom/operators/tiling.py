"""Tile plans over image collections.

Every origin has the closed form ``least(i * stride, far)`` with ``far = max(0, length - size)``,
so a plan is one narrow ``explode`` per image: no sort, no window and no shuffle.
"""
from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal
from numbers import Real

from pyspark.sql import DataFrame, Window, functions as F

from ..model import MAX_PIXELS, MAX_TILES

# Presets and the policy names that enter plan identities.
PRESETS = {"256": 256, "512": 512, "1024": 1024}
PLAN_POLICY = "edge_aligned_no_padding/v1"
PADDED_POLICY = "tiles512_constant_bottom_right/v1"


@dataclass(frozen=True)
class Tiling:
    """Validated tile settings; build with :func:`resolve_tiling`."""

    mode: str
    preset: str
    width: int
    height: int
    overlap_mode: str
    requested: tuple
    overlap_x: int
    overlap_y: int

    @property
    def stride_x(self) -> int:
        return self.width - self.overlap_x

    @property
    def stride_y(self) -> int:
        return self.height - self.overlap_y

    def canonical(self) -> dict:
        return {
            "mode": self.mode, "preset": self.preset, "width": self.width, "height": self.height,
            "overlap": {"mode": self.overlap_mode, "x": self.requested[0], "y": self.requested[1]},
            "overlap_x": self.overlap_x, "overlap_y": self.overlap_y,
            "stride_x": self.stride_x, "stride_y": self.stride_y,
        }


def _is_count(value) -> bool:
    return type(value) is int


def _as_pixels(size: int, overlap: int):
    """A pixel overlap: (requested, pixels), or the complaint about it."""
    return (overlap, overlap) if _is_count(overlap) and 0 <= overlap < size else "must be an integer in [0, tile size)"


def _as_percent(size: int, overlap):
    """A percentage of the tile: (requested, pixels rounded down in decimal), or the complaint about it."""
    if isinstance(overlap, bool) or not isinstance(overlap, Real) or not (0 <= overlap < 100):  # NaN compares false
        return "must be a percentage in [0, 100)"
    requested = int(overlap) if overlap == int(overlap) else float(overlap)
    return requested, int(Decimal(str(requested)) * size // 100)


OVERLAPS = {"percent": (_as_percent, 25), "pixels": (_as_pixels, 0)}


def resolve_tiling(mode="tiled", preset="512", width=None, height=None,
                   overlap_mode="percent", overlap_x=None, overlap_y=None) -> Tiling:
    """Settings with overlaps in pixels; one error that lists every complaint."""
    complaints = []

    def ask(holds: bool, complaint: str) -> None:
        if not holds:
            complaints.append(complaint)

    ask(mode in ("tiled", "whole"), "mode: must be tiled or whole")
    ask(preset == "custom" or preset in PRESETS, "preset: must be 256, 512, 1024 or custom")
    ask(overlap_mode in OVERLAPS, "overlap.mode: must be percent or pixels")
    fixed = PRESETS.get(preset)
    size = {"x": (fixed or 512) if width is None else width, "y": (fixed or 512) if height is None else height}
    for axis, name in (("x", "width"), ("y", "height")):
        ask(_is_count(size[axis]) and size[axis] > 0, f"{name}: must be a positive integer")
        ask(fixed in (None, size[axis]), f"{name}: must match the preset")
    if not complaints:
        ask(size["x"] * size["y"] <= MAX_PIXELS, f"width: tile exceeds {MAX_PIXELS} pixels")
        convert, usual = OVERLAPS[overlap_mode]
        overlaps = {axis: convert(size[axis], usual if given is None else given) for axis, given in (("x", overlap_x), ("y", overlap_y))}
        for axis, found in overlaps.items():
            ask(isinstance(found, tuple), f"overlap.{axis}: {found}")
    if complaints:
        raise ValueError("; ".join(complaints))
    (ask_x, pixels_x), (ask_y, pixels_y) = overlaps["x"], overlaps["y"]
    return Tiling(mode, preset, size["x"], size["y"], overlap_mode, (ask_x, ask_y), pixels_x, pixels_y)


DEFAULT = resolve_tiling()
TRAINING = resolve_tiling(overlap_mode="pixels", overlap_x=0, overlap_y=0)


def square_tiling(size: int = 1024, overlap_px: int = 128) -> Tiling:
    """The older single-size plan with a pixel overlap."""
    return resolve_tiling(preset="custom", width=size, height=size, overlap_mode="pixels",
                          overlap_x=overlap_px, overlap_y=overlap_px)


def _far(length: str, size: int) -> str:
    return f"greatest(0L, CAST({length} AS BIGINT) - {size}L)"


def _axis_count(length: str, size: int, stride: int) -> str:
    return f"(({_far(length, size)} + {stride - 1}) div {stride} + 1)"


def tile_count(images: DataFrame, tiling: Tiling = DEFAULT) -> DataFrame:
    """Per-image tile counts from the closed form; nothing is expanded."""
    if tiling.mode == "whole":
        nx = ny = "1L"
    else:
        nx = _axis_count("width", tiling.width, tiling.stride_x)
        ny = _axis_count("height", tiling.height, tiling.stride_y)
    return (images.withColumns({"tiles_x": F.expr(nx), "tiles_y": F.expr(ny)})
            .withColumn("tile_count", F.expr("CAST(tiles_x * tiles_y AS BIGINT)")))


def _image_identity(sha256: str | None) -> str:
    sha = "'null'" if sha256 is None else f"""coalesce('"' || lower({sha256}) || '"', 'null')"""
    return (f"""'{{"height":' || CAST(height AS STRING) || ',"sha256":' || {sha} || """
            f"""',"width":' || CAST(width AS STRING) || '}}'""")


def plan_hash_expr(tiling: Tiling, padded: bool = False, sha256: str | None = None) -> str:
    """SHA-256 of the sorted-key compact JSON identity of a plan."""
    config = json.dumps(tiling.canonical(), sort_keys=True, separators=(",", ":"))
    head = f"""'{{"config":{config},"image":' || {_image_identity(sha256)}"""
    if padded:
        tail = f""" || ',"processing_policy":"{PADDED_POLICY}"}}'"""
    else:
        tail = f""" || ',"policy":"{PLAN_POLICY}","schema_version":1}}'"""
    return f"sha2({head}{tail}, 256)"


def refusal(max_tiles: int = MAX_TILES) -> str:
    """Why an image with its ``tile_count`` has no plan, or NULL."""
    sized = f"coalesce(width > 0 AND height > 0 AND CAST(width AS BIGINT) * height <= {MAX_PIXELS}L, false)"
    return f"CASE WHEN NOT {sized} THEN 'bad_dimensions' WHEN NOT coalesce(tile_count <= {max_tiles}, false) THEN 'too_many_tiles' END"


def plan_tiles(images: DataFrame, tiling: Tiling = DEFAULT, padded: bool = False,
               sha256: str | None = None, max_tiles: int = MAX_TILES):
    """Row-major edge-aligned tiles of every image.

    Returns ``(tiles, rejects)``; an image whose plan would exceed ``max_tiles`` or whose size
    is out of range goes to ``rejects`` before anything is expanded.
    """
    counted = tile_count(images, tiling)
    fits = f"({refusal(max_tiles)}) IS NULL"
    rejects = counted.filter(f"NOT {fits}").select("image_id", "tile_count", F.expr(refusal(max_tiles)).alias("reason"))
    if tiling.mode == "whole":
        x0 = y0 = "0L"
        x1, y1 = "CAST(width AS BIGINT)", "CAST(height AS BIGINT)"
    else:
        x0 = f"least((tile_idx % tiles_x) * {tiling.stride_x}, {_far('width', tiling.width)})"
        y0 = f"least((tile_idx div tiles_x) * {tiling.stride_y}, {_far('height', tiling.height)})"
        x1, y1 = f"least(x0 + {tiling.width}, width)", f"least(y0 + {tiling.height}, height)"
    tiles = (counted.filter(fits)
             .withColumn("plan_hash", F.expr(plan_hash_expr(tiling, padded, sha256)))
             .select("image_id", "width", "height", "tiles_x", "plan_hash",
                     F.explode(F.expr("sequence(0L, tile_count - 1)")).alias("tile_idx"))
             .withColumns({"x0": F.expr(x0), "y0": F.expr(y0)})
             .withColumns({"x1": F.expr(x1), "y1": F.expr(y1)}))
    pads = {"pad_right": f"{tiling.width}L - (x1 - x0)", "pad_bottom": f"{tiling.height}L - (y1 - y0)"} \
        if padded else {"pad_right": "0L", "pad_bottom": "0L"}
    tiles = (tiles.withColumns({k: F.expr(v) for k, v in pads.items()})
             .withColumn("tile_id", F.format_string("tile-%s-%05d", "plan_hash", "tile_idx"))
             .drop("tiles_x"))
    return tiles, rejects


def all_tiles(images: DataFrame, tiling: Tiling = DEFAULT, padded: bool = False, **settings) -> DataFrame:
    """The tiles of :func:`plan_tiles` for callers that cannot carry rejects: the job fails if there are any."""
    tiles, rejects = plan_tiles(images, tiling, padded, **settings)
    refused = rejects.agg(F.count("*").alias("n"), F.min("image_id").alias("image_id")).filter("n > 0").select(
        F.raise_error(F.format_string("%d images cannot be tiled, the first is %s", "n", F.col("image_id").cast("string"))).alias("image_id"))
    return tiles.unionByName(refused.select(F.col("image_id").cast(tiles.schema["image_id"].dataType)), allowMissingColumns=True)


def tiles_hit(boxes: DataFrame, tiling: Tiling = DEFAULT) -> DataFrame:
    """Every (box, tile) pair that strictly intersects.

    Candidate tile indices are arithmetic in the box coordinates, so neither a join with the
    tile table nor a shuffle is needed. Expects x0, y0, x1, y1, width and height.
    """
    def axis(lo, hi, length, size, stride, p):
        """First and last index of the tiles that meet [lo, hi); they are always consecutive.

        All tiles but the last start at index * stride. The last one starts at ``far``, and a box
        that reaches past ``far`` also reaches the tile before it, unless it starts behind that one.
        """
        n, far = f"{p}_n", f"{p}_far"
        return {
            f"{p}_first": f"least({n} - 1, floor(greatest(0, {lo} - {size - stride}) / {stride}))",
            f"{p}_last": f"CASE WHEN {far} < {hi} AND {far} + {size} > {lo} THEN {n} - 1 "
                         f"ELSE least({n} - 2, ceil({hi} / {stride}) - 1) END"}

    if tiling.mode == "whole":
        return boxes.withColumns({"tile_idx": F.lit(0).cast("bigint"), "tile_x0": F.lit(0).cast("bigint"),
                                  "tile_y0": F.lit(0).cast("bigint"), "tile_x1": F.expr("CAST(width AS BIGINT)"),
                                  "tile_y1": F.expr("CAST(height AS BIGINT)")})
    hits = boxes.withColumns({"_x_far": F.expr(_far("width", tiling.width)), "_y_far": F.expr(_far("height", tiling.height))}).withColumns({
        "_x_n": F.expr(f"(_x_far + {tiling.stride_x - 1}) div {tiling.stride_x} + 1"),
        "_y_n": F.expr(f"(_y_far + {tiling.stride_y - 1}) div {tiling.stride_y} + 1")})
    bounds = {**axis("x0", "x1", "width", tiling.width, tiling.stride_x, "_x"), **axis("y0", "y1", "height", tiling.height, tiling.stride_y, "_y")}
    hits = (hits.withColumns({k: F.expr(e) for k, e in bounds.items()}).filter("_x_first <= _x_last AND _y_first <= _y_last")
            .withColumn("_ix", F.explode(F.expr("sequence(_x_first, _x_last)")))
            .withColumn("_iy", F.explode(F.expr("sequence(_y_first, _y_last)"))))
    return (hits.withColumns({"tile_idx": F.expr("_iy * _x_n + _ix"), "tile_x0": F.expr(f"least(_ix * {tiling.stride_x}, _x_far)"),
                              "tile_y0": F.expr(f"least(_iy * {tiling.stride_y}, _y_far)")})
            .withColumns({"tile_x1": F.expr(f"least(tile_x0 + {tiling.width}, width)"), "tile_y1": F.expr(f"least(tile_y0 + {tiling.height}, height)")})
            .drop("_ix", "_iy", *[f"_{a}_{k}" for a in "xy" for k in ("n", "far", "first", "last")]))


def tile_coverage(tiles: DataFrame) -> DataFrame:
    """Uncovered pixels of a grid plan and whether its last tile ends at the image corner.

    A plan is a cross product of per-axis intervals, so gaps are found on each axis alone; an
    axis has at most as many distinct intervals as the plan has tiles (at most 10 000).
    """
    def axis(lo, hi, length):
        cuts = tiles.groupBy("image_id", lo).agg(F.max(hi).alias(hi), F.max(length).alias("len"))
        before = Window.partitionBy("image_id").orderBy(lo).rowsBetween(Window.unboundedPreceding, -1)
        gaps = cuts.withColumn("gap", F.greatest(F.lit(0), F.col(lo) - F.coalesce(F.max(hi).over(before), F.lit(0))))
        return gaps.groupBy("image_id").agg((F.sum("gap") + F.max("len") - F.max(hi)).alias(f"gap_{lo}"))

    shape = tiles.groupBy("image_id").agg(
        F.max("width").alias("width"), F.max("height").alias("height"),
        F.max_by(F.struct("x1", "y1"), "tile_idx").alias("last"), F.count("*").alias("tile_count"))
    return (shape.join(axis("x0", "x1", "width"), "image_id").join(axis("y0", "y1", "height"), "image_id")
            .selectExpr("image_id", "tile_count",
                        "CAST(width * height - (width - gap_x0) * (height - gap_y0) AS BIGINT) AS uncovered",
                        "last.x1 = width AND last.y1 = height AS ends_at_corner"))
