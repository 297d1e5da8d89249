"""Projections, filters and validity checks over the dataset tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..model import MAX_PIXELS, ROLES

LIVE = "status NOT IN ('rejected', 'superseded')"

# Reasons and labels shown to users.
TRAINING_REASONS = (
    "explicit_training_exclusion", "role_excluded", "future_round", "linked_original_missing",
    "image_missing", "image_incomplete", "awaiting_human_review", "all_instances_excluded",
)


def active_document(images: DataFrame, annotations: DataFrame, reviewed_only: bool = True):
    """Images that are not removed, and their live rows."""
    kept = images.filter("NOT removed" + (" AND complete" if reviewed_only else ""))
    rows = annotations.filter("status = 'accepted'" if reviewed_only else LIVE)
    return kept, rows.join(kept.select("image_id"), "image_id", "left_semi")


def reviewed_by_human(actor: str = "review_actor", qa_smoke: bool = False) -> str:
    accepted = f"{actor} = 'human'" + (f" OR {actor} = 'automated_qa'" if qa_smoke else "")
    return f"coalesce({accepted}, false)"


def training_disposition(images: DataFrame, annotations: DataFrame, round_images: DataFrame | None = None,
                         qa_smoke: bool = False) -> DataFrame:
    """First reason that keeps an active image out of training; NULL when it is included.

    ``round_images`` holds the image ids of the cumulative rounds; only pool images need it.
    """
    accepted = (annotations.filter("status = 'accepted'").groupBy("image_id")
                .agg(F.count_if(~F.coalesce("training_excluded", F.lit(False))).alias("_usable")))
    rows = images.filter("NOT removed").join(accepted, "image_id", "left")
    if round_images is None:
        rows = rows.withColumn("_in_round", F.lit(True))
    else:
        member = round_images.select("image_id").distinct().withColumn("_in_round", F.lit(True))
        rows = rows.join(member, "image_id", "left")
    reason = f"""CASE
        WHEN training_excluded THEN 'explicit_training_exclusion'
        WHEN role NOT IN ('pool', 'train', 'validation') THEN 'role_excluded'
        WHEN role = 'pool' AND _in_round IS NULL THEN 'future_round'
        WHEN missing = 'linked_original' THEN 'linked_original_missing'
        WHEN missing = 'image' THEN 'image_missing'
        WHEN NOT complete THEN 'image_incomplete'
        WHEN NOT {reviewed_by_human(qa_smoke=qa_smoke)} THEN 'awaiting_human_review'
        WHEN _usable = 0 THEN 'all_instances_excluded' END"""
    return rows.withColumn("reason", F.expr(reason)).drop("_usable", "_in_round")


def training_rows(images: DataFrame, annotations: DataFrame, classes: DataFrame,
                  round_images: DataFrame | None = None, qa_smoke: bool = False) -> DataFrame:
    """Accepted, not excluded rows of included images, with role and an active-class flag."""
    included = training_disposition(images, annotations, round_images, qa_smoke).filter("reason IS NULL")
    active = classes.filter("NOT archived").select("class_id", F.lit(True).alias("class_ok"))
    return (annotations.filter("status = 'accepted' AND NOT coalesce(training_excluded, false)")
            .join(included.select("image_id", "role", "group_id"), "image_id")
            .join(active, "class_id", "left")
            .withColumn("class_ok", F.coalesce("class_ok", F.lit(False))))


def annotation_issues(rows: DataFrame, qa_smoke: bool = False, conversion: DataFrame | None = None) -> DataFrame:
    """Training errors of :func:`training_rows`; one row per (annotation, reason).

    A row without an active class stops there. A row without human review goes on to the
    geometry checks and still counts as an instance.
    """
    unreviewed = f"NOT {reviewed_by_human(qa_smoke=qa_smoke)}"
    reasons = f"""filter(CASE WHEN NOT class_ok THEN array('unassigned_or_archived_class') ELSE array(
        CASE WHEN {unreviewed} THEN 'annotation_not_human_reviewed' END,
        CASE WHEN geom_type = 'box' THEN 'box_only_not_segmentation_ground_truth' END) END, r -> r IS NOT NULL)"""
    issues = rows.select("image_id", "annotation_id", F.explode(F.expr(reasons)).alias("reason"))
    if conversion is not None:
        shaped = rows.filter("class_ok AND geom_type <> 'box'").select("image_id", "annotation_id")
        issues = issues.unionByName(shaped.join(conversion.select("annotation_id", "reason"), "annotation_id"))
    return issues


def countable_instances(rows: DataFrame) -> DataFrame:
    """Rows that add to instances per class: active class and not a box."""
    return rows.filter("class_ok AND geom_type <> 'box'")


def export_disposition(images: DataFrame, annotations: DataFrame, classes: DataFrame, mode: str = "reviewed"):
    """Returns (images, objects), each with a ``reason`` that is NULL for what is exported.

    ``images`` are the scoped active images. Objects of excluded-role images are not judged.
    """
    if mode not in ("reviewed", "labeled"):
        raise ValueError("mode must be reviewed or labeled")
    scoped = images.filter("NOT removed")
    active = classes.filter("NOT archived").select("class_id", F.lit(True).alias("_class_ok"))
    unreviewed = "NOT complete OR status <> 'accepted'" if mode == "reviewed" else "false"
    objects = (annotations.join(scoped.filter("role <> 'excluded'").select("image_id", "role", "complete"), "image_id")
               .join(active, "class_id", "left")
               .withColumn("object_reason", F.expr(f"""CASE
                    WHEN status IN ('rejected', 'superseded') THEN 'rejected_or_superseded_objects'
                    WHEN _class_ok IS NULL THEN 'unassigned_or_archived_class_objects'
                    WHEN {unreviewed} THEN 'not_reviewed_objects' END""")).drop("_class_ok"))
    candidates = objects.filter("object_reason IS NULL").groupBy("image_id").agg(F.count("*").alias("candidates"))
    judged = (scoped.join(candidates, "image_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
              .withColumn("reason", F.expr(f"""CASE
                    WHEN role = 'excluded' THEN 'excluded_role_images'
                    WHEN NOT complete AND {"true" if mode == "reviewed" else "false"} THEN 'incomplete_images'
                    WHEN NOT complete AND candidates = 0 THEN 'unlabeled_incomplete_images' END""")))
    return judged, objects


def exported(judged: DataFrame, objects: DataFrame):
    """The included images and exactly their candidate objects, of one :func:`export_disposition`.

    An object without a reason lies on an included image: its role is not excluded, and an image with a candidate is
    refused neither as unlabeled nor, in reviewed mode, as incomplete. So objects need no join with the judged images.
    """
    return judged.filter("reason IS NULL"), objects.filter("object_reason IS NULL")


def export_split(role: str = "role") -> str:
    return f"CASE WHEN {role} = 'validation' THEN 'val' WHEN {role} = 'test' THEN 'test' ELSE 'train' END"


def training_split(role: str = "role") -> str:
    return f"CASE WHEN {role} = 'validation' THEN 'val' ELSE 'train' END"


def scope(images: DataFrame, kind: str = "all", selected: DataFrame | None = None,
          rounds: DataFrame | None = None, round_number: int | None = None) -> DataFrame:
    """Image scope of an export: all, selected, round or cumulative."""
    active = images.filter("NOT removed")
    if kind == "all":
        return active
    if kind == "selected":
        return active.join(selected.select("image_id").distinct(), "image_id", "left_semi")
    if kind == "round":
        member = rounds.filter(F.col("round_number") == round_number).select("image_id")
        return active.join(member, "image_id", "left_semi")
    if kind == "cumulative":
        return active.filter("role IN ('pool', 'train') AND complete AND NOT coalesce(training_excluded, false)")
    raise ValueError("unknown image scope")


def unknown_scope_ids(selected: DataFrame, images: DataFrame) -> DataFrame:
    """Selected ids that are not active images; must be empty."""
    return selected.select("image_id").distinct().join(images.filter("NOT removed"), "image_id", "left_anti")


def _finite(*names: str) -> str:
    return " AND ".join(f"NOT isnan(CAST({n} AS DOUBLE)) AND abs(CAST({n} AS DOUBLE)) < double('Infinity')" for n in names)


def valid_box(x0="x0", y0="y0", x1="x1", y1="y1", width="width", height="height") -> str:
    return (f"coalesce({_finite(x0, y0, x1, y1)} AND 0 <= {x0} AND {x0} < {x1} AND {x1} <= {width} "
            f"AND 0 <= {y0} AND {y0} < {y1} AND {y1} <= {height}, false)")


def valid_rle(counts="counts", height="height", width="width") -> str:
    total = f"(CAST({width} AS BIGINT) * {height})"
    return (f"coalesce({width} > 0 AND {height} > 0 AND {total} <= {MAX_PIXELS} AND size({counts}) > 0 "
            f"AND size({counts}) <= 2 * {total} + 1 AND forall({counts}, c -> c IS NOT NULL AND c >= 0) "
            f"AND aggregate({counts}, 0L, (s, c) -> s + c) = {total}, false)")


# Id and path rules.
PORTABLE_ID = "^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"


def portable_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string").rlike(PORTABLE_ID), F.lit(False))


def safe_relative(name: str) -> Column:
    """Relative POSIX path without drive, backslash, parent step or NUL."""
    path = F.col(name)
    bad = (path.startswith("/") | path.contains("\\") | path.contains("\x00")
           | path.rlike("^[A-Za-z]:") | path.rlike("(^|/)\\.\\.(/|$)") | (path == ""))
    return F.coalesce(~bad, F.lit(False))


def document_issues(classes: DataFrame, images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Structural problems before an exchange: (kind, id, issue)."""
    def duplicated(df, key, kind):
        return (df.groupBy(F.col(key).cast("string").alias("id")).count().filter("count > 1")
                .select(F.lit(kind).alias("kind"), "id", F.lit("duplicate_id").alias("issue")))

    def unportable(df, key, kind):
        return df.filter(~portable_id(key)).select(
            F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.lit("id_not_portable").alias("issue"))

    def issue(df, key, kind, text):
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.lit(text).alias("issue"))

    parts = [
        duplicated(classes, "class_id", "class"), duplicated(images, "image_id", "image"),
        duplicated(annotations, "annotation_id", "annotation"),
        unportable(classes, "class_id", "class"), unportable(images, "image_id", "image"),
        unportable(annotations, "annotation_id", "annotation"),
        issue(classes.filter("trim(coalesce(name, '')) = ''"), "class_id", "class", "empty_name"),
        issue(images.filter("name IS NULL"), "image_id", "image", "missing_name"),
        issue(images.filter(f"NOT coalesce(width > 0 AND height > 0 AND CAST(width AS BIGINT) * height <= {MAX_PIXELS}, false)"),
              "image_id", "image", "bad_dimensions"),
        issue(annotations.join(images.select("image_id"), "image_id", "left_anti"), "annotation_id", "annotation", "unknown_image"),
        issue(annotations.join(classes.select("class_id"), "class_id", "left_anti"), "annotation_id", "annotation", "unknown_class"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def label_row_issue(line: str = "line") -> str:
    """Issue of one segmentation label row, NULL when it is valid or blank."""
    fields = rf"split(trim({line}), '\\s+')"
    return rf"""CASE
        WHEN trim({line}) = '' THEN NULL
        WHEN size({fields}) < 7 OR size({fields}) % 2 = 0 THEN 'needs_class_and_three_points'
        WHEN NOT element_at({fields}, 1) RLIKE '^(0|[1-9][0-9]*)$' THEN 'bad_class_index'
        WHEN exists(slice({fields}, 2, size({fields})),
                    v -> coalesce(NOT (try_cast(v AS DOUBLE) BETWEEN 0 AND 1), true)) THEN 'coordinate_not_normalized' END"""


def touches_seam(x0="x0", y0="y0", x1="x1", y1="y1", tx0="tx0", ty0="ty0", tx1="tx1", ty1="ty1",
                 width="width", height="height") -> str:
    """Bounds within one pixel of a tile edge that is not an image edge."""
    return (f"coalesce(({tx0} > 0 AND {x0} <= {tx0} + 1) OR ({ty0} > 0 AND {y0} <= {ty0} + 1) "
            f"OR ({tx1} < {width} AND {x1} >= {tx1} - 1) OR ({ty1} < {height} AND {y1} >= {ty1} - 1), false)")


def review_label() -> str:
    # The texts users see.
    return """CASE status
        WHEN 'accepted' THEN CASE WHEN review_actor = 'automated_qa' THEN 'Accepted · automated QA' ELSE 'Accepted' END
        WHEN 'rejected' THEN 'Rejected'
        WHEN 'superseded' THEN 'Replaced by merge'
        ELSE CASE WHEN coalesce(class_id, '') <> '' THEN 'Labeled · needs review' ELSE 'Needs label & review' END END
        || CASE WHEN coalesce(training_excluded, false) THEN ' · Excluded from training' ELSE '' END"""


def visible_objects(annotations: DataFrame, hidden_classes=(), hidden_layers=(), show_proposals=True,
                    show_rejected=False, show_superseded=False, show_unassigned=True, hide_assigned=False,
                    hide_generated=False, pending_only=False) -> DataFrame:
    tests = []
    if hidden_classes:
        tests.append(F.coalesce(~F.col("class_id").isin(*hidden_classes), F.lit(True)))
    if hidden_layers:
        tests.append(F.coalesce(~F.col("layer_id").isin(*hidden_layers), F.lit(True)))
    if not show_proposals:
        tests.append(F.expr("status <> 'proposal'"))
    if not show_rejected:
        tests.append(F.expr("status <> 'rejected'"))
    if not show_superseded:
        tests.append(F.expr("status <> 'superseded'"))
    if not show_unassigned:
        tests.append(F.expr("class_id IS NOT NULL"))
    if hide_assigned:
        tests.append(F.expr("class_id IS NULL"))
    if hide_generated:
        tests.append(F.expr("layer_id IS NULL AND coalesce(operation, '') <> 'automatic_mask_generation'"))
    if pending_only:
        tests.append(F.expr("status IN ('draft', 'proposal')"))
    for test in tests:
        annotations = annotations.filter(test)
    return annotations


def find_images(images: DataFrame, query: str = "", kind: str = "all") -> DataFrame:
    found = images.filter(F.lower("name").contains(query.lower()))
    if kind == "all":
        return found
    if kind in ROLES:
        return found.filter(F.col("role") == kind)
    tests = {"complete": "complete", "incomplete": "NOT complete", "missing": "missing IS NOT NULL"}
    return found.filter(tests[kind])


def filter_quality(proposals: DataFrame, iou: float = 0.8, stability: float = 0.88) -> DataFrame:
    """Predicted IoU strictly above, stability at or above; a threshold of 0 switches a test off."""
    if iou > 0:
        proposals = proposals.filter(F.col("predicted_iou") > iou)
    if stability > 0:
        proposals = proposals.filter(F.col("stability_score") >= stability)
    return proposals


def is_assist() -> str:
    return """coalesce(geom_type = 'mask' AND source_kind IN ('sam2', 'sam3') AND
        (coalesce(operation, '') IN ('sam_assist', 'independent_point_assist')
         OR (coalesce(operation, '') = '' AND layer_id IS NULL)), false)"""
