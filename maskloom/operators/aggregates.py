"""Summaries, gates and readiness of the dataset tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import EXPORT_FORMATS, ROLES, SPLITS, STATUSES
from .joins import leaking_groups
from .predicates import LIVE, export_split, reviewed_by_human, training_split
from .tiling import TRAINING, plan_tiles, refusal, tile_count


def _union(parts):
    return reduce(DataFrame.unionByName, parts)


def fixed_keys(spark: SparkSession, name: str, values) -> DataFrame:
    """A vocabulary as rows, so that counts of zero stay visible."""
    return spark.createDataFrame([(v,) for v in values], f"{name} STRING")


# Reports are (metric, key, value) rows. Images carry their objects as counts per class and state, each image says
# what it adds to which metric, and one aggregate sums that up, most of it before the shuffle.
_ENTRY = "array<struct<metric: string, key: string, value: bigint>>"


def _entry(metric: str, key: str = "NULL", value: str = "1") -> str:
    return f"named_struct('metric', {metric}, 'key', CAST({key} AS STRING), 'value', CAST({value} AS BIGINT))"


def _objects_by_image(annotations: DataFrame, classes: DataFrame, **states: str) -> DataFrame:
    """(image_id, objects): per class and state of an image's annotations their number ``n``; the state names are given."""
    counted = annotations.groupBy("image_id", "class_id", *[F.expr(e).alias(k) for k, e in states.items()]).agg(F.count("*").alias("n"))
    # Classes are a vocabulary of at most 65 535 entries, whatever the data.
    active = F.broadcast(classes.filter("NOT archived").select("class_id", F.lit(True).alias("_ok")))
    return (counted.join(active, "class_id", "left").withColumn("class_ok", F.coalesce("_ok", F.lit(False)))
            .groupBy("image_id").agg(F.collect_list(F.struct("class_id", "class_ok", *states, "n")).alias("objects")))


def _summed(parts: list[DataFrame]) -> DataFrame:
    return _union(parts).groupBy("metric", "key").agg(F.sum("value").alias("value"))


def _entries(df: DataFrame, *arrays: str) -> DataFrame:
    return df.selectExpr(f"inline(concat({', '.join(f'CAST({a} AS {_ENTRY})' for a in arrays)}))")


def _zeros(spark: SparkSession, classes: DataFrame, scalars, splits: dict, per_class) -> DataFrame:
    """Entries of value 0, so that counts of zero stay visible."""
    fixed = [(m, None, 0) for m in scalars] + [(m, k, 0) for m, keys in splits.items() for k in keys]
    rows = spark.createDataFrame(fixed, "metric STRING, key STRING, value BIGINT")
    each = ", ".join(_entry(f"'{m}'", "class_id", "0") for m in per_class)
    return rows.unionByName(_entries(classes.filter("NOT archived"), f"array({each})"))


def _leaks(images: DataFrame, split: str, metric: str) -> DataFrame:
    return leaking_groups(images, split).agg(F.count("*").alias("n")).selectExpr(f"'{metric}' AS metric", "CAST(NULL AS STRING) AS key", "n AS value")


def export_summary(images: DataFrame, annotations: DataFrame, classes: DataFrame, mode: str = "reviewed") -> DataFrame:
    """Counts of an export as (metric, key, value): scope, classes, splits and exclusions."""
    if mode not in ("reviewed", "labeled"):
        raise ValueError("mode must be reviewed or labeled")
    objects = _objects_by_image(annotations, classes, status="status", box="geom_type = 'box'")
    unreviewed = "NOT complete OR o.status <> 'accepted'" if mode == "reviewed" else "false"
    why = f"""CASE WHEN o.status IN ('rejected', 'superseded') THEN 'rejected_or_superseded_objects'
        WHEN NOT o.class_ok THEN 'unassigned_or_archived_class_objects' WHEN {unreviewed} THEN 'not_reviewed_objects' END"""
    judged = (images.filter("NOT removed").join(objects, "image_id", "left")
              .withColumn("objects", F.expr(f"""CASE WHEN role <> 'excluded' THEN transform(objects, o -> named_struct('class_id', o.class_id, 'status', o.status,
                  'box', o.box, 'n', o.n, 'reason', {why})) END"""))
              .withColumn("reason", F.expr(f"""CASE WHEN role = 'excluded' THEN 'excluded_role_images' WHEN NOT complete AND {str(mode == 'reviewed').lower()} THEN 'incomplete_images'
                  WHEN NOT complete AND NOT coalesce(exists(objects, o -> o.reason IS NULL), false) THEN 'unlabeled_incomplete_images' END""")))
    of_image = f"""CASE WHEN reason IS NULL THEN array({_entry("'scope_image_count'")}, {_entry("'image_count'")}, {_entry("'split_count'", export_split())},
        {_entry("'incomplete_image_count'", value="CAST(NOT complete AS INT)")}) ELSE array({_entry("'scope_image_count'")}, {_entry("'excluded'", "reason")}) END"""
    of_objects = f"""coalesce(flatten(transform(objects, o -> CASE WHEN o.reason IS NOT NULL THEN array({_entry("'excluded'", "o.reason", "o.n")})
        WHEN reason IS NULL THEN array({_entry("'annotation_count'", value="o.n")}, {_entry("'class_count'", "o.class_id", "o.n")},
            {_entry("'draft_count'", value="CASE WHEN o.status <> 'accepted' THEN o.n ELSE 0 END")}, {_entry("'box_count'", value="CASE WHEN o.box THEN o.n ELSE 0 END")})
        ELSE CAST(array() AS {_ENTRY}) END)), array())"""
    zeros = _zeros(images.sparkSession, classes, ("scope_image_count", "image_count", "incomplete_image_count", "annotation_count", "draft_count", "box_count"),
                   {"split_count": SPLITS}, ("class_count",))
    return _summed([_entries(judged, of_image, of_objects), zeros, _leaks(judged.filter("reason IS NULL"), export_split(), "leaking_groups")])


def _gate_rules(fmt: str, mode: str, allow_lossy: bool, include_images: bool, plane_variant: str | None) -> str:
    """Array of the (level, code) that a summary's facts give a format; NULL entries where a rule does not hold."""
    if fmt not in EXPORT_FORMATS:
        raise ValueError("unknown export format")
    lossless = not allow_lossy
    rules = [
        ("error", "no_active_class", "classes = 0"),
        ("error", "no_eligible_image", "images = 0"),
        ("error", "boxes_are_not_segmentation", f"{fmt == 'yolo_seg'} AND boxes > 0"),
        ("error", "box_conversion_needs_consent",
         f"{lossless and fmt in ('yolo_box', 'voc')} AND (annotations > boxes OR {fmt == 'voc'})"),
        ("error", "semantic_plane_needs_consent", f"{lossless and fmt == 'png' and plane_variant in ('semantic', 'class')}"),
        ("warning", "includes_drafts", f"{mode == 'labeled'}"),
        ("warning", "objects_without_class_omitted", "unassigned > 0"),
        ("warning", "images_not_included", f"{not include_images}"),
        ("warning", "no_validation_images", "val = 0"),
        ("warning", "groups_span_splits", "leaks > 0"),
        ("warning", "polygon_conversion_checked_on_write", f"{fmt in ('yolo_seg', 'labelme')}"),
    ]
    return ", ".join(f"CASE WHEN {test} THEN struct('{fmt}' AS format, '{level}' AS level, '{code}' AS code) END" for level, code, test in rules)


def _gates(summary: DataFrame, rules: list[str]) -> DataFrame:
    facts = summary.agg(
        F.count_if(F.expr("metric = 'class_count'")).alias("classes"),
        *[F.coalesce(F.sum(F.expr(f"CASE WHEN {test} THEN value END")), F.lit(0)).alias(name) for name, test in {
            "images": "metric = 'image_count'", "annotations": "metric = 'annotation_count'", "boxes": "metric = 'box_count'",
            "val": "metric = 'split_count' AND key = 'val'", "leaks": "metric = 'leaking_groups'",
            "unassigned": "metric = 'excluded' AND key = 'unassigned_or_archived_class_objects'"}.items()])
    return facts.selectExpr(f"inline(filter(array({', '.join(rules)}), r -> r IS NOT NULL))")


def export_gates(summary: DataFrame, fmt: str, mode: str = "reviewed", allow_lossy: bool = False,
                 include_images: bool = False, plane_variant: str | None = None) -> DataFrame:
    """Errors and warnings of an export, from its summary alone (a few hundred rows)."""
    return _gates(summary, [_gate_rules(fmt, mode, allow_lossy, include_images, plane_variant)]).select("level", "code")


def all_gates(summary: DataFrame, mode: str = "reviewed", allow_lossy: bool = False, include_images: bool = False,
              plane_variant: str | None = None) -> DataFrame:
    """(format, level, code): the gates of every format from one reading of the summary."""
    return _gates(summary, [_gate_rules(fmt, mode, allow_lossy, include_images, plane_variant) for fmt in EXPORT_FORMATS])


def tileable(images: DataFrame) -> DataFrame:
    """Images that have a training plan; :func:`readiness` reports the others as errors."""
    return images.join(plan_tiles(images, TRAINING, padded=True)[1].select("image_id"), "image_id", "left_anti")


def readiness(images: DataFrame, annotations: DataFrame, classes: DataFrame, round_images: DataFrame | None = None,
              qa_smoke: bool = False, fragments: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Training readiness as (metric, key, value).

    ``labels`` is the label compile (:func:`~.training.compile_labels`) that the frozen snapshot holds too: its valid
    rows are the tile instances, its refused rows are errors. ``fragments`` (image_id, tile_idx) counts instances alone.
    """
    objects = _objects_by_image(annotations, classes, accepted="status = 'accepted'", skipped="coalesce(training_excluded, false)",
                                human=reviewed_by_human(qa_smoke=qa_smoke), box="geom_type = 'box'")
    rows = images.withColumn("_known", F.lit(True)).join(objects, "image_id", "full")
    rows = rows.withColumn("_in_round", F.lit(True)) if round_images is None else rows.join(
        round_images.select("image_id").distinct().withColumn("_in_round", F.lit(True)), "image_id", "left")
    if fragments is not None:
        rows = rows.join(fragments.groupBy("image_id").agg(F.count("*").alias("_fragments")), "image_id", "left")
    some = lambda test: f"coalesce(exists(objects, o -> o.accepted AND {test}), false)"
    judged = tile_count(rows.filter("NOT coalesce(removed, true)"), TRAINING).withColumns({
        "reason": F.expr(f"""CASE WHEN training_excluded THEN 'explicit_training_exclusion' WHEN role NOT IN ('pool', 'train', 'validation') THEN 'role_excluded'
            WHEN role = 'pool' AND _in_round IS NULL THEN 'future_round' WHEN missing = 'linked_original' THEN 'linked_original_missing' WHEN missing = 'image' THEN 'image_missing'
            WHEN NOT complete THEN 'image_incomplete' WHEN NOT {reviewed_by_human(qa_smoke=qa_smoke)} THEN 'awaiting_human_review'
            WHEN {some("true")} AND NOT {some("NOT o.skipped")} THEN 'all_instances_excluded' END"""),
        "split": F.expr(training_split()), "_refused": F.expr(refusal())})
    of_image = f"""CASE WHEN reason IS NULL THEN array({_entry("'images'", "split")}, {_entry("'negative_images'", value=f"CASE WHEN {some('true')} THEN 0 ELSE 1 END")},
        {_entry("CASE WHEN _refused IS NULL THEN 'tiles' ELSE 'error' END", "coalesce('image_cannot_be_tiled:' || _refused, split)", "CASE WHEN _refused IS NULL THEN tile_count ELSE 1 END")})
        ELSE array({_entry("'excluded'", "reason")}) END"""
    kept = "o.accepted AND NOT o.skipped"
    of_objects = f"""coalesce(flatten(transform(filter(objects, o -> reason IS NULL AND {kept}), o -> concat(
        CASE WHEN NOT o.class_ok THEN array({_entry("'error'", "'unassigned_or_archived_class'", "o.n")}) ELSE concat(
            CASE WHEN NOT o.human THEN array({_entry("'error'", "'annotation_not_human_reviewed'", "o.n")}) ELSE CAST(array() AS {_ENTRY}) END,
            CASE WHEN o.box THEN array({_entry("'error'", "'box_only_not_segmentation_ground_truth'", "o.n")}) ELSE array({_entry("'instances_per_class'", "o.class_id", "o.n")}) END) END,
        CASE WHEN role NOT IN ('pool', 'train') THEN CAST(array() AS {_ENTRY}) WHEN o.class_ok
            THEN array({_entry("'_training_rows'", value="o.n")}, {_entry("'training_instances_per_class'", "o.class_id", "o.n")}) ELSE array({_entry("'_training_rows'", value="o.n")}) END))), array())"""
    parts = [_entries(judged, of_image, of_objects)]
    # Excluded rows count wherever they are.
    parts.append(annotations.filter("coalesce(training_excluded, false)").agg(F.count("*").alias("value")).selectExpr("'excluded_annotations' AS metric", "CAST(NULL AS STRING) AS key", "value"))
    splits = {"images": ("train", "val"), "tiles": ("train", "val")}
    if fragments is not None:
        parts.append(_entries(judged.filter("reason IS NULL AND _fragments IS NOT NULL"), f"array({_entry(chr(39) + 'tile_instances' + chr(39), 'split', '_fragments')})"))
    if labels is not None:
        parts.append(_entries(labels, f"array({_entry('CASE WHEN error IS NULL THEN ' + chr(39) + 'tile_instances' + chr(39) + ' ELSE ' + chr(39) + 'error' + chr(39) + ' END', 'coalesce(error, split)')})"))
    if fragments is not None or labels is not None:
        splits["tile_instances"] = ("train", "val")
    parts.append(_zeros(images.sparkSession, classes, ("negative_images", "excluded_annotations", "_training_rows"), splits, ("instances_per_class", "training_instances_per_class")))
    parts.append(_leaks(judged.filter("reason IS NULL"), training_split(), "_leaks"))
    # A few hundred rows from here on: what follows from the sums is added in one expression.
    got = lambda metric, key="true": f"aggregate(filter(rows, r -> r.metric = '{metric}' AND {key}), 0L, (n, r) -> n + r.value)"
    missing = {"no_training_images": got("images", "r.key = 'train'"), "no_validation_images": got("images", "r.key = 'val'"),
               "no_training_instances": got("_training_rows"), "no_object_class": "CAST(exists(rows, r -> r.metric = 'instances_per_class') AS BIGINT)"}
    derived = [f"CASE WHEN {n} = 0 THEN {_entry(chr(39) + 'error' + chr(39), chr(39) + code + chr(39))} END" for code, n in missing.items()]
    span = _entry("'error'", "'related_groups_span_training_and_validation'", got("_leaks"))
    derived.append(f"CASE WHEN {got('_leaks')} > 0 THEN {span} END")
    unused = f"""transform(filter(rows, r -> r.metric = 'training_instances_per_class' AND r.value = 0), r -> {_entry("'warning_class_without_training_instance'", "r.key")})"""
    one = _summed(parts).agg(F.collect_list(F.struct("metric", "key", "value")).alias("rows"))
    full = one.select(F.expr(f"concat(filter(rows, r -> NOT startswith(r.metric, '_')), filter(array({', '.join(derived)}), r -> r IS NOT NULL), {unused})").alias("rows"))
    ready = _entry("'ready'", value="CAST(NOT exists(rows, r -> r.metric = 'error') AS INT)")
    return full.select(F.expr(f"inline(CAST(concat(rows, array({ready})) AS {_ENTRY}))"))



def status_counts(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Rows per status and live unassigned rows, for every image."""
    counts = annotations.groupBy("image_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.count_if(F.expr(f"class_id IS NULL AND {LIVE}")).alias("unassigned"))
    return images.select("image_id").join(counts, "image_id", "left").na.fill(0)


def review_plan(images: DataFrame, annotations: DataFrame, classes: DataFrame) -> DataFrame:
    active = classes.filter("NOT archived").select("class_id", F.lit(True).alias("_ok"))
    counts = annotations.join(active, "class_id", "left").groupBy("image_id").agg(
        F.count_if(F.expr("status IN ('draft', 'proposal')")).alias("pending"),
        F.count_if(F.expr("status = 'accepted'")).alias("accepted"),
        F.count_if(F.expr(f"{LIVE} AND _ok IS NULL")).alias("unlabeled"),
        F.count_if(F.expr("status = 'rejected'")).alias("rejected"),
        F.count_if(F.expr(LIVE)).alias("_live"))
    return (images.select("image_id", "role").join(counts, "image_id", "left").na.fill(0)
            .selectExpr("image_id", "pending", "accepted", "unlabeled", "rejected", "_live = 0 AS negative",
                        "role IN ('pool', 'train', 'validation') AS eligible_role"))


def role_counts(images: DataFrame) -> DataFrame:
    counts = images.filter("NOT removed").groupBy("role").agg(
        F.count("*").alias("n"), F.count_if("complete").alias("done"))
    return (fixed_keys(images.sparkSession, "role", ROLES).join(counts, "role", "left")
            .selectExpr("role", "coalesce(n, 0) AS images", "coalesce(done, 0) AS reviewed"))


def class_impact(images: DataFrame, annotations: DataFrame, classes: DataFrame) -> DataFrame:
    used = (annotations.join(images.filter("NOT removed").select("image_id"), "image_id", "left_semi")
            .groupBy("class_id").agg(F.count("*").alias("n")))
    return classes.select("class_id").join(used, "class_id", "left").selectExpr("class_id", "coalesce(n, 0) AS annotations")


def merge_preview(parents: DataFrame, key: str = "group_key") -> DataFrame:
    """Class proposed for a merge: the one class of its parents, or a conflict."""
    return parents.groupBy(key).agg(
        F.count("*").alias("parents"), F.min("class_id").alias("_a"), F.max("class_id").alias("_b"),
        F.max(F.col("class_id").isNull()).alias("has_unassigned_parent")).selectExpr(
        key, "parents", "CASE WHEN _a = _b THEN _a END AS proposed_class_id",
        "coalesce(_a <> _b, false) AS class_conflict", "has_unassigned_parent")


def layer_coverage(tiles: DataFrame, receipts: DataFrame, key=("image_id",)) -> DataFrame:
    """Completed against planned tiles; complete, running or partial."""
    done = receipts.select(*key, "tile_idx").distinct().withColumn("_done", F.lit(True))
    return (tiles.join(done, [*key, "tile_idx"], "left").groupBy(*key)
            .agg(F.count("*").alias("total_tiles"), F.count_if("_done").alias("completed_tiles"))
            .withColumn("status", F.expr("""CASE WHEN completed_tiles = total_tiles THEN 'complete'
                                            WHEN completed_tiles = 0 THEN 'running' ELSE 'partial' END""")))


def timing_rollup(receipts: DataFrame) -> DataFrame:
    """Sum of every timing whose name ends in _seconds. ``receipts`` has timings MAP<STRING, DOUBLE>."""
    return (receipts.select(F.explode("timings").alias("timing", "seconds")).filter("timing LIKE '%\\_seconds'")
            .groupBy("timing").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("tiles")))


def project_footprint(images: DataFrame, annotations: DataFrame, rounds: DataFrame, project: str) -> DataFrame:
    """Image, annotation and round counts per project; ``project`` is an expression over image_id."""
    def count(df, name):
        return df.groupBy(F.expr(project).alias("project_id")).agg(F.count("*").alias(name))
    started = rounds.groupBy(F.expr(project).alias("project_id")).agg(
        F.count_distinct("round_number").alias("rounds"), F.count_if(F.expr("status = 'in_progress'")).alias("_active"))
    return (count(images, "images").join(count(annotations, "annotations"), "project_id", "left")
            .join(started, "project_id", "left").na.fill(0)
            .selectExpr("project_id", "images", "annotations", "rounds", "_active > 0 AS blocked"))


def stability(logits: DataFrame, *keys: str, threshold: float = 0.0) -> DataFrame:
    """Pixels above threshold + 1 over pixels above threshold - 1, and 0 when there are none."""
    return (logits.groupBy(*keys).agg(F.count_if(F.col("logit") > threshold + 1.0).alias("high"),
                                      F.count_if(F.col("logit") > threshold - 1.0).alias("low"))
            .selectExpr(*keys, "CASE WHEN low = 0 THEN 0.0D ELSE high / low END AS stability"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Annotation versions added, removed or changed between two snapshots."""
    a = before.select("annotation_id", F.col("revision").alias("old_revision"))
    b = after.select("annotation_id", F.col("revision").alias("new_revision"))
    return (a.join(b, "annotation_id", "full").withColumn("change", F.expr("""CASE
            WHEN old_revision IS NULL THEN 'added' WHEN new_revision IS NULL THEN 'removed'
            WHEN old_revision <> new_revision THEN 'changed' END""")).filter("change IS NOT NULL"))
