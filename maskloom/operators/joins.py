"""Joins of the dataset model.

Keys that may match many rows are reduced to one row per key before they are joined, so an
ambiguous or hot key never multiplies rows. No side is broadcast by hint: sizes decide.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import polygons
from ..session import cut_lineage
from .masks import blocks
from .predicates import LIVE, export_split

BOX_CELL = 256


def with_context(annotations: DataFrame, images: DataFrame, classes: DataFrame) -> DataFrame:
    """Annotation with its image and class; ``issue`` says what blocks an exchange."""
    known_images = images.select("image_id", "role", "complete", "group_id", F.lit(True).alias("_image"))
    known_classes = classes.select("class_id", F.col("name").alias("class_name"), "archived", F.lit(True).alias("_class"))
    return (annotations.join(known_images, "image_id", "left").join(known_classes, "class_id", "left")
            .withColumn("issue", F.expr("""CASE WHEN _image IS NULL THEN 'unknown_image'
                WHEN class_id IS NULL THEN 'unassigned' WHEN _class IS NULL THEN 'unknown_class'
                WHEN archived THEN 'archived_class' END"""))
            .drop("_image", "_class"))


def _basename(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)$', 1)"


def _stem(path: str) -> str:
    return f"regexp_replace({_basename(path)}, '(?<=.)[.][^.]*$', '')"


def resolve_images(rows: DataFrame, images: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Find the image meant by each imported row.

    ``rows`` has row_id, external_id, name, width, height; ``mapping`` has key, image_id and wins.
    Later rules apply only when earlier ones found nothing. Result: row_id, image_id, reason.
    """
    keys = (images.selectExpr("image_id", "width", "height", f"""inline(array(
        struct(1 AS rank, CAST(image_id AS STRING) AS key),
        struct(2 AS rank, name AS key), struct(2 AS rank, 'images/' || CAST(image_id AS STRING) || '.png' AS key),
        struct(3 AS rank, {_basename('name')} AS key), struct(3 AS rank, CAST(image_id AS STRING) || '.png' AS key),
        struct(4 AS rank, CAST(image_id AS STRING) AS key), struct(4 AS rank, {_stem('name')} AS key)))""")
        .groupBy("rank", "key").agg(F.min("image_id").alias("found"), F.max("image_id").alias("other"),
                                    F.max("width").alias("w"), F.max("height").alias("h")))
    wanted = rows.selectExpr("row_id", f"""inline(array(
        struct(1 AS rank, CAST(external_id AS STRING) AS key), struct(2 AS rank, name AS key),
        struct(3 AS rank, {_basename('name')} AS key), struct(4 AS rank, {_stem('name')} AS key)))""").filter("key IS NOT NULL")
    hits = wanted.join(keys, ["rank", "key"]).select("row_id", "rank", "found", "other", "w", "h")
    if mapping is not None:
        chosen = mapping.groupBy("key").agg(F.min("image_id").alias("mapped"))
        explicit = rows.selectExpr("row_id", """inline(array(struct(-1 AS rank, CAST(external_id AS STRING) AS key),
                                                             struct(0 AS rank, name AS key)))""")
        sizes = images.groupBy("image_id").agg(F.max("width").alias("w"), F.max("height").alias("h"),
                                               F.lit(True).alias("_known"))
        hits = hits.unionByName(
            explicit.join(chosen, "key").join(sizes, F.col("mapped") == F.col("image_id"), "left")
            .select("row_id", "rank", F.when(F.col("_known"), F.col("mapped")).alias("found"),
                    F.when(F.col("_known"), F.col("mapped")).alias("other"), "w", "h"))
    best = hits.groupBy("row_id").agg(F.min_by(F.struct("found", "other", "w", "h"), "rank").alias("b"))
    return (rows.join(best, "row_id", "left").selectExpr("row_id", """CASE
            WHEN b.found IS NULL THEN 'missing' WHEN b.found <> b.other THEN 'ambiguous'
            WHEN width IS NOT NULL AND (width <> b.w OR height <> b.h) THEN 'dimensions' END AS reason""",
            "b.found AS _found")
            .selectExpr("row_id", "CASE WHEN reason IS NULL THEN _found END AS image_id", "reason"))


# Fixed value: the URL namespace of RFC 4122 name-based UUIDs.
UUID_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5_expr(text: str) -> str:
    digest = f"sha1(concat(unhex('{UUID_URL_NAMESPACE}'), encode({text}, 'UTF-8')))"
    variant = f"lower(hex((conv(substring({digest}, 17, 1), 16, 10) & 3) | 8))"
    return (f"concat(substring({digest}, 1, 8), '-', substring({digest}, 9, 4), '-5', substring({digest}, 14, 3), '-', "
            f"{variant}, substring({digest}, 18, 3), '-', substring({digest}, 21, 12))")


def resolve_classes(rows: DataFrame, classes: DataFrame, mapping: DataFrame | None = None, create: bool = True) -> DataFrame:
    """Class of each imported name: explicit map, then stable id, then exact name, else new.

    ``rows`` has row_id, external_id, stable_id, name; ``mapping`` has key, class_id.
    """
    by_id = classes.groupBy("class_id").agg(F.lit(True).alias("_known"))
    by_name = classes.groupBy("name").agg(F.min("class_id").alias("named"), F.max("class_id").alias("named_other"))
    out = rows
    if mapping is not None:
        one = mapping.groupBy("key").agg(F.min("class_id").alias("to"))
        for column, alias in (("external_id", "m1"), ("stable_id", "m2"), ("name", "m3")):
            step = one.select(F.col("key").alias(f"_{alias}"), F.col("to").alias(alias))
            out = out.join(step, F.col(column).cast("string") == F.col(f"_{alias}"), "left").drop(f"_{alias}")
        out = out.withColumn("explicit", F.coalesce("m1", "m2", "m3"))
    else:
        out = out.withColumn("explicit", F.lit(None).cast("string"))
    known_explicit = by_id.select(F.col("class_id").alias("explicit"), F.col("_known").alias("explicit_ok"))
    known_stable = by_id.select(F.col("class_id").alias("stable_id"), F.col("_known").alias("stable_ok"))
    out = out.join(known_explicit, "explicit", "left").join(known_stable, "stable_id", "left").join(by_name, "name", "left")
    fresh = uuid5_expr("'import-class:' || name")
    return out.selectExpr(
        "row_id",
        f"""CASE WHEN trim(coalesce(name, '')) = '' THEN NULL
             WHEN explicit IS NOT NULL THEN CASE WHEN explicit_ok THEN explicit END
             WHEN stable_ok THEN stable_id WHEN named = named_other THEN named
             WHEN named IS NULL AND {str(create).lower()} THEN {fresh} END AS class_id""",
        f"""CASE WHEN trim(coalesce(name, '')) = '' THEN 'empty_name'
             WHEN explicit IS NOT NULL THEN CASE WHEN explicit_ok THEN 'explicit' ELSE 'invalid_mapping' END
             WHEN stable_ok THEN 'stable_id' WHEN named = named_other THEN 'name'
             WHEN named IS NOT NULL THEN 'ambiguous' WHEN {str(create).lower()} THEN 'created' ELSE 'unknown' END AS how""")


def box_pairs(left: DataFrame, right: DataFrame, where=None, cell: int = BOX_CELL) -> DataFrame:
    """Strictly intersecting box pairs of the same image.

    ``left`` has image_id, a_id, ax0..ay1 and ``right`` image_id, b_id, bx0..by1. Boxes are listed
    under the grid cells they touch; a pair is reported only by the cell that holds the corner of
    its intersection, so no pair repeats and nothing is deduplicated afterwards.
    """
    def cells(df, p):
        return (df.withColumn("cx", F.explode(F.expr(f"sequence(CAST(floor({p}x0 / {cell}) AS BIGINT), CAST(ceil({p}x1 / {cell}) AS BIGINT) - 1)")))
                .withColumn("cy", F.explode(F.expr(f"sequence(CAST(floor({p}y0 / {cell}) AS BIGINT), CAST(ceil({p}y1 / {cell}) AS BIGINT) - 1)"))))

    hit = F.expr(f"""ax0 < bx1 AND bx0 < ax1 AND ay0 < by1 AND by0 < ay1
                     AND cx = floor(greatest(ax0, bx0) / {cell}) AND cy = floor(greatest(ay0, by0) / {cell})""")
    joined = cells(left, "a").join(cells(right, "b"), ["image_id", "cx", "cy"])
    return joined.filter(hit if where is None else hit & where).drop("cx", "cy")


def neighbours(annotations: DataFrame) -> DataFrame:
    """Live objects of one image whose bounds strictly overlap, as ordered pairs a <> b."""
    live = annotations.filter(LIVE)
    a = live.selectExpr("image_id", "annotation_id AS a_id", "x0 AS ax0", "y0 AS ay0", "x1 AS ax1", "y1 AS ay1")
    b = live.selectExpr("image_id", "annotation_id AS b_id", "x0 AS bx0", "y0 AS by0", "x1 AS bx1", "y1 AS by1")
    return box_pairs(a, b, F.col("a_id") != F.col("b_id"))


def objects_at(points: DataFrame, slabs: DataFrame, block: int = 128) -> DataFrame:
    """Objects whose mask holds a point. ``points``: point_id, image_id, px, py (pixel coordinates)."""
    placed = points.withColumns({"bx": F.expr(f"px div {block}"), "by": F.expr(f"py div {block}")})
    return (placed.join(blocks(slabs, block), ["image_id", "bx", "by"])
            .filter("x0 <= px AND px < x1 AND y0 <= py AND py < y1").drop("bx", "by", "x0", "x1", "y0", "y1"))


def polygons_at(points: DataFrame, shapes: DataFrame, block: int = 128) -> DataFrame:
    """Objects whose polygon holds a point, by the even-odd rule. ``points``: point_id, image_id, px, py (any
    numbers); ``shapes``: image_id, annotation_id, points. Candidates come from the blocks of the bounds."""
    placed = points.withColumns({"bx": F.expr(f"CAST(floor(px / {block}) AS BIGINT)"), "by": F.expr(f"CAST(floor(py / {block}) AS BIGINT)")})
    bounds = shapes.selectExpr("image_id", "annotation_id", "points", *polygons.bbox_columns("points"))
    cells = (bounds.withColumn("bx", F.explode(F.expr(f"sequence(CAST(floor(x0 / {block}) AS BIGINT), CAST(floor(x1 / {block}) AS BIGINT))")))
             .withColumn("by", F.explode(F.expr(f"sequence(CAST(floor(y0 / {block}) AS BIGINT), CAST(floor(y1 / {block}) AS BIGINT))"))))
    return placed.join(cells, ["image_id", "bx", "by"]).filter(F.expr(polygons.contains("points", "px", "py"))).select("point_id", "annotation_id")


def top_object(hits: DataFrame) -> DataFrame:
    """Topmost hit per point (latest in drawing order) and how many lie under the point."""
    return hits.groupBy("point_id").agg(F.max("annotation_id").alias("top_id"), F.count("*").alias("hits"))


def drop_tombstoned(candidates: DataFrame, tombstones: DataFrame):
    """Returns (kept, suppressed); scope is (image, layer, signature)."""
    key = ["image_id", "layer_id", "signature"]
    return candidates.join(tombstones, key, "left_anti"), candidates.join(tombstones, key, "left_semi")


def undecided(seams: DataFrame, proposals: DataFrame) -> DataFrame:
    decided = proposals.filter("status IN ('retained', 'excluded', 'accepted', 'pending')")
    return seams.join(decided, ["annotation_id", "revision", "model_id"], "left_anti")


def split_stale(decisions: DataFrame, current: DataFrame):
    """Request-wise revision check; one stale or unknown row makes the whole request a conflict.

    Returns (accepted decision rows, conflicts with stale and missing counts).
    """
    seen = decisions.join(current.select("annotation_id", F.col("revision").alias("_now")), "annotation_id", "left")
    verdict = seen.groupBy("request_id").agg(
        F.count_if(F.expr("_now IS NULL")).alias("missing"),
        F.count_if(F.expr("_now IS NOT NULL AND _now <> expected_revision")).alias("stale"))
    conflicts = verdict.filter("missing + stale > 0")
    return decisions.join(conflicts.select("request_id"), "request_id", "left_anti"), conflicts


def leaking_groups(images: DataFrame, split: str = export_split()) -> DataFrame:
    """Groups whose images fall into more than one split."""
    return (images.withColumn("_split", F.expr(split)).groupBy("group_id")
            .agg(F.min("_split").alias("a"), F.max("_split").alias("b"), F.count("*").alias("images"))
            .filter("a <> b").select("group_id", "images"))


def leaking_bytes(images: DataFrame) -> DataFrame:
    """Image bytes that appear in training and in validation."""
    return (images.filter("role IN ('pool', 'train', 'validation')").groupBy("sha256")
            .agg(F.count_if(F.expr("role <> 'validation'")).alias("train_images"),
                 F.count_if(F.expr("role = 'validation'")).alias("val_images"))
            .filter("train_images > 0 AND val_images > 0"))


def map_predictions(predictions: DataFrame, mapping: DataFrame, class_version: int):
    """Class of a prediction through the active mapping; a mapping of another class version is refused.

    Returns (mapped, refused). ``mapping``: model_id, model_class_index, to_class, class_version.
    """
    versions = mapping.groupBy("model_id").agg(F.max("class_version").alias("_v"), F.min("class_version").alias("_v0"))
    rows = predictions.join(versions, "model_id", "left")
    usable = F.expr(f"_v IS NULL OR (_v = {class_version} AND _v0 = {class_version})")
    mapped = (rows.filter(usable).drop("_v", "_v0")
              .join(mapping.select("model_id", "model_class_index", "to_class"), ["model_id", "model_class_index"], "left"))
    return mapped, rows.filter(~usable).drop("_v0").withColumnRenamed("_v", "mapping_version")


def lineage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Final child, distance and cycle flag of every row, by pointer doubling.

    ``nodes`` has annotation_id; ``edges`` has parent_id, child_id with at most one child per
    parent (a superseded row names the row that replaced it). Rounds grow with the logarithm of
    the longest chain; a round that settles nothing leaves only rows that lead into a cycle.
    """
    jump = edges.groupBy("parent_id").agg(F.min("child_id").alias("ptr"))
    state = cut_lineage(nodes.select("annotation_id").join(jump, F.col("annotation_id") == F.col("parent_id"), "left")
                        .selectExpr("annotation_id", "coalesce(ptr, annotation_id) AS ptr",
                                    "CAST(ptr IS NOT NULL AS BIGINT) AS dist", "ptr IS NULL AS done"))
    open_rows = state.filter("NOT done").count()
    while open_rows:
        ahead = state.selectExpr("annotation_id AS ptr", "ptr AS ptr2", "dist AS dist2", "done AS done2")
        moved = (state.filter("NOT done").join(ahead, "ptr", "left")
                 .selectExpr("annotation_id", "coalesce(ptr2, ptr) AS ptr", "dist + coalesce(dist2, 0) AS dist", "coalesce(done2, true) AS done"))
        state = cut_lineage(state.filter("done").unionByName(moved))
        left = state.filter("NOT done").count()
        if left == open_rows:
            break
        open_rows = left
    return state.selectExpr("annotation_id", "CASE WHEN done THEN ptr END AS root_id", "CASE WHEN done THEN dist END AS depth",
                            "NOT done AS cyclic")


def lineage_issues(nodes: DataFrame, edges: DataFrame, slabs: DataFrame | None = None) -> DataFrame:
    """Merge records that break a rule: fewer than two distinct parents, another image, a live parent, a parent
    that also went into another child, or a child on a cycle. Give ``slabs`` to have unions compared too."""
    parent = nodes.selectExpr("annotation_id AS parent_id", "image_id AS parent_image", "status AS parent_status")
    child = nodes.selectExpr("annotation_id AS child_id", "image_id AS child_image")
    forks = edges.groupBy("parent_id").agg((F.count_distinct("child_id") > 1).alias("_forked"))
    rows = edges.distinct().join(parent, "parent_id", "left").join(child, "child_id", "left").join(forks, "parent_id")
    loops = lineage(nodes, edges).filter("cyclic").select(F.col("annotation_id").alias("child_id"), F.lit(True).alias("cyclic"))
    found = (rows.groupBy("child_id").agg(
        F.count("*").alias("parents"), F.count_if(F.expr("parent_image IS NULL OR parent_image <> child_image")).alias("foreign"),
        F.count_if(F.expr("parent_status IS NULL OR parent_status <> 'superseded'")).alias("live_parents"),
        F.count_if("_forked").alias("shared_parents")).join(loops, "child_id", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False))))
    broken = "parents < 2 OR foreign > 0 OR live_parents > 0 OR shared_parents > 0 OR cyclic"
    if slabs is None:
        return found.filter(broken)
    from .masks import mask_union, pair_intersections
    united = mask_union(slabs.join(edges.selectExpr("parent_id AS annotation_id", "child_id").distinct(), "annotation_id").drop("annotation_id"), "child_id")
    area = lambda df, name: df.groupBy("child_id").agg(F.sum(F.expr("(x1 - x0) * (y1 - y0)")).alias(name))
    own = slabs.withColumnRenamed("annotation_id", "child_id").join(edges.select("child_id").distinct(), "child_id")
    shared = pair_intersections(united.selectExpr("child_id AS k", "child_id AS a_id", "x0", "x1", "y0", "y1"), own.selectExpr("child_id AS k", "child_id AS b_id", "x0", "x1", "y0", "y1"),
                                "a_id", "b_id", ["k"]).selectExpr("k AS child_id", "intersection")
    same = area(united, "_want").join(area(own, "_have"), "child_id", "full").join(shared, "child_id", "left").selectExpr(
        "child_id", "coalesce(_want = _have AND intersection = _have, false) AS union_equal")
    return found.join(same, "child_id", "left").withColumn("union_equal", F.coalesce("union_equal", F.lit(False))).filter(broken + " OR NOT union_equal")


def cumulative(images: DataFrame, rounds: DataFrame, upto: int) -> DataFrame:
    """Train and validation images always; pool images of rounds numbered up to ``upto``."""
    member = rounds.filter(F.col("round_number") <= upto).select("image_id").distinct().withColumn("_in", F.lit(True))
    return images.join(member, "image_id", "left").filter("role IN ('train', 'validation') OR (role = 'pool' AND _in)").drop("_in")


def match_datasets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Images of two datasets with the same bytes: exactly one on each side, same size and role."""
    def side(df, p):
        return df.groupBy("sha256").agg(
            F.count("*").alias(f"{p}_n"), F.min("image_id").alias(f"{p}_image"),
            F.min(F.struct("width", "height", "role")).alias(f"{p}_shape"))
    return (side(a, "a").join(side(b, "b"), "sha256").selectExpr(
        "sha256", "a_image", "b_image", """CASE WHEN a_n > 1 OR b_n > 1 THEN 'not_unique'
            WHEN a_shape.width <> b_shape.width OR a_shape.height <> b_shape.height THEN 'dimensions'
            WHEN a_shape.role <> b_shape.role THEN 'role' ELSE 'matched' END AS result"""))


def check_receipts(results: DataFrame, requests: DataFrame) -> DataFrame:
    """First binding that a predictor result breaks, per (request, proposal); only bad rows remain."""
    asked = requests.selectExpr("request_id", "model_sha256 AS q_model", "image_sha256 AS q_image", "crop AS q_crop",
                                "settings AS q_settings", "tile_w", "tile_h")
    return (results.join(asked, "request_id", "left").withColumn("reason", F.expr("""CASE
            WHEN q_model IS NULL THEN 'unknown_request'
            WHEN NOT model_sha256 <=> q_model THEN 'model' WHEN NOT image_sha256 <=> q_image THEN 'image'
            WHEN NOT crop <=> q_crop THEN 'crop' WHEN NOT settings <=> q_settings THEN 'settings'
            WHEN class_id IS NOT NULL THEN 'class_assigned' WHEN NOT status <=> 'proposal' THEN 'status'
            WHEN review_actor IS NOT NULL THEN 'reviewed'
            WHEN mask_w <> tile_w OR mask_h <> tile_h THEN 'mask_size' END"""))
            .filter("reason IS NOT NULL").select("request_id", "proposal_id", "reason"))
