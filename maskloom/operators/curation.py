"""Review decisions as conflict-checked batch merges.

Every operator takes the current tables and one row per requested change, and returns an
:class:`Outcome`. A request is atomic: one bad row turns the whole request into a conflict. When
several valid requests touch one image, the lowest request id wins and the others conflict, as if
they had been submitted against a state that the first one changed. Writing is the caller's: a new
version directory, never the one being read.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..model import MAX_MERGE_PARENTS, MAX_SELECTION, ROLES
from .aggregates import merge_preview
from .masks import box_signature_text, mask_signatures, mask_stats, mask_union
from .predicates import LIVE, is_assist

ACTIONS = ("assign", "accept", "assign_accept", "assist_assign_accept", "reject", "delete")


@dataclass
class Outcome:
    annotations: DataFrame | None = None
    images: DataFrame | None = None
    conflicts: DataFrame | None = None
    log: DataFrame | None = None
    tombstones: DataFrame | None = None
    rounds: DataFrame | None = None
    classes: DataFrame | None = None
    slabs: DataFrame | None = None
    proposals: DataFrame | None = None
    parents: DataFrame | None = None


def _first_reason(tests: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in tests) + " END"


def _one_per_image(verdict: DataFrame) -> DataFrame:
    """Among valid requests of an image the lowest id stands; ``verdict`` has request_id, image_id, reason."""
    winner = (verdict.filter("reason IS NULL").groupBy("image_id").agg(F.min("request_id").alias("_winner")))
    return (verdict.join(winner, "image_id", "left")
            .withColumn("reason", F.expr("CASE WHEN reason IS NULL AND request_id <> _winner THEN 'image_changed' ELSE reason END"))
            .drop("_winner"))


def _reopen(images: DataFrame, touched: DataFrame) -> DataFrame:
    """An edit resets completeness and bumps the image revision."""
    mark = touched.select("image_id").distinct().withColumn("_touched", F.lit(True))
    return (images.join(mark, "image_id", "left").withColumns({
        "complete": F.expr("complete AND _touched IS NULL"),
        "review_actor": F.expr("CASE WHEN _touched IS NULL THEN review_actor END"),
        "revision": F.expr("revision + CASE WHEN _touched THEN 1 ELSE 0 END")}).drop("_touched"))


def _active(classes: DataFrame, alias: str, flag: str) -> DataFrame:
    return classes.filter("NOT archived").select(F.col("class_id").alias(alias), F.lit(True).alias(flag))


def _conflicts(verdict: DataFrame) -> DataFrame:
    return verdict.filter("reason IS NOT NULL").select("request_id", "reason")


def _tombstones(rows: DataFrame, reason: str, slabs: DataFrame | None = None) -> DataFrame:
    """The signatures under which removed generated rows must not come back.

    A row's own ``generation_signature`` counts first; a box has it in closed form (x0..y1, width, height); any other
    mask has it from its pixels, ``slabs`` (annotation_id, x0..y1, width, height). A generated mask with neither stops
    the job: it would come back.
    """
    layered = rows.filter("layer_id IS NOT NULL")
    if "generation_signature" not in rows.columns:
        layered = layered.withColumn("generation_signature", F.lit(None).cast("string"))
    sized = {"x0", "y0", "x1", "y1", "width", "height"} <= set(rows.columns)
    known = layered.withColumn("_signature", F.expr(f"coalesce(generation_signature, CASE WHEN geom_type = 'box' THEN {box_signature_text()} END)")
                               if sized else F.col("generation_signature"))
    lacking = F.raise_error(F.concat(F.lit("a removed mask needs generation_signature or slabs: "), F.col("annotation_id"))).cast("string")
    if slabs is not None:
        drawn = slabs.select("annotation_id", "x0", "x1", "y0", "y1", "width", "height").join(known.filter("_signature IS NULL").select("annotation_id"), "annotation_id", "left_semi")
        known = known.join(mask_signatures(drawn, "annotation_id", out="_drawn"), "annotation_id", "left").withColumn("_signature", F.coalesce("_signature", "_drawn"))
    return known.select("image_id", "layer_id", F.coalesce("_signature", lacking).alias("signature"), "annotation_id", F.expr(reason).alias("reason"))


def _replaced_slabs(slabs: DataFrame, gone: DataFrame, made: DataFrame) -> DataFrame:
    """The slab table with the rows of ``gone`` (annotation_id) replaced by ``made``, in the columns both have."""
    columns = [c for c in slabs.columns if c in made.columns]
    return slabs.select(*columns).join(gone.select("annotation_id"), "annotation_id", "left_anti").unionByName(made.select(*columns))


def _drawn_edits(edits: DataFrame, shapes: DataFrame | None, key: str):
    """Edits with the bounds of their new pixels as nx0..ny1 and ``_area``; and the pixels, united per edit."""
    if shapes is None:
        return edits.withColumn("_area", F.lit(None).cast("bigint")), None
    united = mask_union(shapes.select(key, "x0", "x1", "y0", "y1"), key)
    bounds = mask_stats(united, key).withColumnsRenamed({"area": "_area", "bx0": "_bx0", "by0": "_by0", "bx1": "_bx1", "by1": "_by1"})
    edits = edits.join(bounds, key, "left").withColumns({f"n{c}": F.coalesce(f"_b{c}", f"n{c}") for c in ("x0", "y0", "x1", "y1")})
    return edits.drop("_bx0", "_by0", "_bx1", "_by1"), united


def _new_slabs(won: DataFrame, united: DataFrame | None, key: str) -> DataFrame:
    """Pixels of accepted geometry changes: those drawn, or the box. ``won``: key, annotation_id, image_id, nx0..ny1, _area, width, height."""
    keep = ["annotation_id", "image_id", "width", "height"]
    boxed = won.filter("nx0 IS NOT NULL AND _area IS NULL").selectExpr(*keep, "CAST(nx0 AS BIGINT) AS x0", "CAST(nx1 AS BIGINT) AS x1", "CAST(ny0 AS BIGINT) AS y0", "CAST(ny1 AS BIGINT) AS y1")
    if united is None:
        return boxed
    return boxed.unionByName(united.join(won.filter("_area IS NOT NULL").select(key, *keep), key).select(*boxed.columns))


def _selection_rows(requests: DataFrame, annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Requested rows with the current row and image beside them."""
    now = annotations.selectExpr("annotation_id", "image_id AS _image", "status AS _status", "revision AS _revision",
                                 "class_id AS _class", f"{is_assist()} AS _assist", "geom_type AS _geom")
    known = images.filter("NOT removed").select("image_id", F.lit(True).alias("_known"))
    repeated = requests.groupBy("request_id", "annotation_id").agg(F.count("*").alias("_times"))
    return (requests.join(repeated, ["request_id", "annotation_id"]).join(now, "annotation_id", "left")
            .join(known, "image_id", "left"))


_SELECTION_SUMS = {
    "n": "count(1)", "repeated": "max(_times) > 1", "unknown_image": "max(_known) IS NULL",
    "missing": "count_if(_image IS NULL OR _image <> image_id) > 0",
    "stale": "count_if(expected_revision IS NOT NULL AND expected_revision <> _revision) > 0",
}


def apply_selection(annotations: DataFrame, images: DataFrame, classes: DataFrame, requests: DataFrame, slabs: DataFrame | None = None) -> Outcome:
    """assign / accept / assign_accept / assist_assign_accept / reject / delete (CUR-01).

    Removed generated masks are tombstoned by ``generation_signature``, or by their pixels in ``slabs``.
    """
    rows = (_selection_rows(requests, annotations, images)
            .join(_active(classes, "class_id", "_wanted_ok"), "class_id", "left")
            .join(_active(classes, "_class", "_class_ok"), "_class", "left"))
    sums = rows.groupBy("request_id", "image_id").agg(
        F.min("action").alias("action"), F.min("confirm").alias("confirm"), F.min("class_id").alias("class_id"),
        F.max("_wanted_ok").alias("wanted_ok"), *[F.expr(e).alias(k) for k, e in _SELECTION_SUMS.items()],
        F.expr("count_if(_status = 'superseded' OR (_status = 'rejected' AND action <> 'delete')) > 0").alias("inactive"),
        F.expr("count_if(_status <> 'draft' OR NOT _assist) > 0").alias("not_assist"),
        F.expr("count_if(_status = 'accepted') > 0").alias("any_accepted"),
        F.expr("count_if(_class IS NULL) > 0").alias("any_unassigned"), F.expr("count_if(_class IS NOT NULL AND _class_ok IS NULL) > 0").alias("any_archived"))
    actions = ", ".join(f"'{a}'" for a in ACTIONS)
    verdict = _one_per_image(sums.withColumn("reason", F.expr(_first_reason([
        ("unknown_action", f"NOT action IN ({actions})"), ("unknown_image", "unknown_image"),
        ("bad_selection", f"repeated OR (n > {MAX_SELECTION} AND action <> 'assist_assign_accept')"),
        ("missing_object", "missing"), ("inactive_object", "inactive"), ("stale_revision", "stale"),
        ("confirm_needed", "action = 'assist_assign_accept' AND NOT confirm"),
        ("not_assist_drafts", "action = 'assist_assign_accept' AND not_assist"),
        ("confirm_needed", "action IN ('delete', 'reject') AND (n > 1 OR any_accepted) AND NOT confirm"),
        ("inactive_class", "action LIKE '%assign%' AND class_id IS NOT NULL AND wanted_ok IS NULL"),
        ("class_needed", "action LIKE '%assign_accept' AND class_id IS NULL"),
        ("class_needed", "action = 'accept' AND any_unassigned"), ("inactive_class", "action = 'accept' AND any_archived"),
    ]))))
    won = verdict.filter("reason IS NULL").select("request_id", "image_id")
    chosen = requests.join(won.select("request_id"), "request_id", "left_semi").select(
        "annotation_id", "request_id", F.col("action").alias("_action"), F.col("class_id").alias("_to"), F.col("actor").alias("_actor"))
    edited = annotations.join(chosen, "annotation_id", "left")
    tombs = _tombstones(edited.filter("_action IN ('delete', 'reject')"), "CASE _action WHEN 'delete' THEN 'deleted' ELSE 'rejected' END", slabs)
    after = (edited.filter("NOT coalesce(_action = 'delete', false)").withColumns({
        "class_id": F.expr("CASE WHEN _action LIKE '%assign%' THEN _to ELSE class_id END"),
        "status": F.expr("""CASE WHEN _action = 'assign' THEN 'draft' WHEN _action LIKE '%accept' THEN 'accepted'
                                 WHEN _action = 'reject' THEN 'rejected' ELSE status END"""),
        "review_actor": F.expr("CASE WHEN _action IS NULL THEN review_actor WHEN _action LIKE '%accept' THEN _actor END"),
        "revision": F.expr("revision + CASE WHEN _action IS NULL THEN 0 ELSE 1 END")})
        .drop("_action", "_to", "_actor", "request_id"))
    log = requests.join(won.select("request_id"), "request_id", "left_semi").groupBy("request_id", "image_id").agg(
        F.min("action").alias("action"), F.min("actor").alias("actor"), F.count("*").alias("objects"))
    return Outcome(after, _reopen(images, won), _conflicts(verdict), log, tombs)


def _supersede(annotations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mark rows named in ``pairs`` (annotation_id, _by); marks of earlier merges and repairs stay."""
    if "superseded_by" not in annotations.columns:
        annotations = annotations.withColumn("superseded_by", F.lit(None).cast("string"))
    return annotations.join(pairs, "annotation_id", "left").withColumns({
        "superseded_by": F.coalesce("_by", "superseded_by"),
        "status": F.expr("CASE WHEN _by IS NULL THEN status ELSE 'superseded' END"),
        "revision": F.expr("revision + CASE WHEN _by IS NULL THEN 0 ELSE 1 END")}).drop("_by")


def merge_selected(annotations: DataFrame, slabs: DataFrame, images: DataFrame, classes: DataFrame, requests: DataFrame) -> Outcome:
    """Exact-union merge (CUR-02). ``requests``: request_id, image_id, annotation_id, expected_revision,
    class_given, class_id, accept, confirm, actor. Parents are superseded by the child."""
    rows = _selection_rows(requests, annotations, images)
    preview = merge_preview(rows.select("request_id", F.col("_class").alias("class_id")), "request_id")
    sums = rows.groupBy("request_id", "image_id").agg(
        F.min("confirm").alias("confirm"), F.min("accept").alias("accept"), F.min("actor").alias("actor"),
        F.min("class_given").alias("class_given"), F.min("class_id").alias("wanted"),
        *[F.expr(e).alias(k) for k, e in _SELECTION_SUMS.items()],
        F.expr("count_if(_status IN ('superseded', 'rejected')) > 0").alias("inactive"),
        F.expr("count_if(_geom = 'box') > 0").alias("any_box"))
    sums = (sums.join(preview, "request_id").withColumn("class_id", F.expr("CASE WHEN class_given THEN wanted ELSE proposed_class_id END"))
            .join(_active(classes, "class_id", "_class_ok"), "class_id", "left"))
    verdict = _one_per_image(sums.withColumn("reason", F.expr(_first_reason([
        ("confirm_needed", "NOT confirm"), ("unknown_image", "unknown_image"),
        ("bad_selection", f"repeated OR n > {MAX_SELECTION}"), ("missing_object", "missing"), ("inactive_object", "inactive"),
        ("stale_revision", "stale"), ("parent_count", f"n < 2 OR n > {MAX_MERGE_PARENTS}"), ("box_parent", "any_box"),
        ("class_conflict", "class_conflict AND NOT class_given"),
        ("inactive_class", "class_id IS NOT NULL AND _class_ok IS NULL"), ("class_needed", "accept AND class_id IS NULL"),
    ]))))
    child_id = "substring(sha2(concat('merge:', request_id), 256), 1, 32)"
    won = verdict.filter("reason IS NULL").withColumn("child_id", F.expr(child_id))
    parents = requests.select("request_id", "annotation_id").join(won.select("request_id", "child_id"), "request_id")
    child_slabs = mask_union(slabs.join(parents.select("annotation_id", "child_id"), "annotation_id").drop("annotation_id"),
                             "image_id", "child_id").withColumnRenamed("child_id", "annotation_id")
    stats = mask_stats(child_slabs, "annotation_id")
    sized = images.select("image_id", "width", "height")
    children = (won.join(stats.withColumnRenamed("annotation_id", "child_id"), "child_id").join(sized, "image_id").selectExpr(
        "child_id AS annotation_id", "image_id", "width", "height", "class_id", "CASE WHEN accept THEN 'accepted' ELSE 'draft' END AS status",
        "CASE WHEN accept THEN actor END AS review_actor", "CAST(1 AS BIGINT) AS revision", "area",
        "bx0 AS x0", "by0 AS y0", "bx1 AS x1", "by1 AS y1", "'mask' AS geom_type", "false AS training_excluded",
        "'manual' AS source_kind", "'exact_pixel_union' AS operation", "false AS manually_edited"))
    # What each child came from, with the parents' class and revision at that time.
    record = parents.join(annotations.select("annotation_id", "image_id", "class_id", "revision"), "annotation_id").selectExpr(
        "child_id", "annotation_id AS parent_id", "image_id", "class_id", "revision", "request_id")
    marked = _supersede(annotations, parents.select("annotation_id", F.col("child_id").alias("_by")))
    log = won.selectExpr("request_id", "image_id", "'merge_instances' AS action", "actor", "n AS objects")
    return Outcome(marked.unionByName(children, allowMissingColumns=True), _reopen(images, won), _conflicts(verdict), log,
                   slabs=slabs.unionByName(child_slabs, allowMissingColumns=True), parents=record)


def class_name_conflicts(classes: DataFrame) -> DataFrame:
    """Active names that are equal when case is ignored."""
    return (classes.filter("NOT archived").groupBy(F.lower("name").alias("folded")).agg(F.count("*").alias("n"))
            .filter("n > 1"))


def change_classes(classes: DataFrame, changes: DataFrame) -> Outcome:
    """Create, rename and archive classes in one batch (CUR-03).

    ``changes``: request_id, action (create / update / archive), class_id, name, used, confirm. The
    batch conflicts as a whole when it would leave two active classes with one name.
    """
    known = classes.select("class_id", F.lit(True).alias("_known"))
    judged = changes.join(known, "class_id", "left").withColumn("reason", F.expr(_first_reason([
        ("unknown_action", "action NOT IN ('create', 'update', 'archive')"),
        ("unknown_class", "action <> 'create' AND _known IS NULL"), ("class_exists", "action = 'create' AND _known"),
        ("bad_name", "action <> 'archive' AND (trim(coalesce(name, '')) = '' OR length(name) > 240 OR name RLIKE '[\\\\x00-\\\\x1f]')"),
        ("confirm_needed", "action = 'archive' AND used > 0 AND NOT confirm")])))
    good = judged.filter("reason IS NULL")
    edits = good.filter("action <> 'create'").groupBy("class_id").agg(
        F.max(F.expr("CASE WHEN action = 'update' THEN trim(name) END")).alias("_name"),
        F.max(F.expr("action = 'archive'")).alias("_archive"))
    start = classes.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("_top")).first()[0]
    # A batch of class changes is a vocabulary edit: its new classes follow each other in request order.
    turn = F.row_number().over(Window.orderBy("request_id"))
    fresh = good.filter("action = 'create'").withColumn("_turn", turn).selectExpr("class_id", "trim(name) AS name", f"CAST({start} AS BIGINT) + _turn AS ord", "false AS archived")
    after = (classes.join(edits, "class_id", "left").selectExpr(
        "class_id", "coalesce(_name, name) AS name", "ord", "archived OR coalesce(_archive, false) AS archived").unionByName(fresh))
    clash = class_name_conflicts(after)
    conflicts = judged.filter("reason IS NOT NULL").select("request_id", "reason").unionByName(
        after.filter("NOT archived").withColumn("folded", F.lower("name")).join(clash, "folded", "left_semi")
        .join(good.select("request_id", "class_id"), "class_id").select("request_id", F.lit("name_taken").alias("reason")))
    # All or nothing: with a clash no change of the batch stands.
    stands = F.lit(clash.limit(1).count() == 0)
    return Outcome(classes=after.filter(stands).unionByName(classes.select(*after.columns).filter(~stands)), conflicts=conflicts)


def remap_classes(annotations: DataFrame, images: DataFrame, classes: DataFrame, moves: DataFrame) -> Outcome:
    """Move objects to another active class and archive the old one. ``moves``: class_id, target_id, confirm."""
    target = _active(classes, "target_id", "_ok")
    judged = moves.join(target, "target_id", "left").withColumn("reason", F.expr(_first_reason([
        ("bad_target", "_ok IS NULL OR target_id = class_id"), ("confirm_needed", "NOT confirm")])))
    # A class that is itself moved in this batch cannot receive objects.
    moved_ids = moves.select(F.col("class_id").alias("target_id"), F.lit(True).alias("_moving"))
    judged = judged.join(moved_ids, "target_id", "left").withColumn(
        "reason", F.expr("coalesce(reason, CASE WHEN _moving THEN 'target_is_moved' END)"))
    good = judged.filter("reason IS NULL").select("class_id", F.col("target_id").alias("_to"))
    here = images.filter("NOT removed").select("image_id", F.lit(True).alias("_here"))
    edited = annotations.join(good, "class_id", "left").join(here, "image_id", "left").withColumn("_hit", F.expr("_to IS NOT NULL AND _here"))
    after = edited.withColumns({
        "class_id": F.expr("CASE WHEN _hit THEN _to ELSE class_id END"), "status": F.expr("CASE WHEN _hit THEN 'draft' ELSE status END"),
        "review_actor": F.expr("CASE WHEN coalesce(_hit, false) THEN NULL ELSE review_actor END"),
        "revision": F.expr("revision + CASE WHEN _hit THEN 1 ELSE 0 END")}).drop("_to", "_here", "_hit")
    touched = edited.filter("_hit").select("image_id").distinct().withColumn("_touched", F.lit(True))
    images2 = images.join(touched, "image_id", "left").withColumn("complete", F.expr("complete AND _touched IS NULL")).drop("_touched")
    classes2 = classes.join(good, "class_id", "left").withColumn("archived", F.expr("archived OR _to IS NOT NULL")).drop("_to")
    return Outcome(after, images2, judged.filter("reason IS NOT NULL").select("class_id", "reason"), classes=classes2)


def reorder_classes(classes: DataFrame, order: DataFrame) -> DataFrame:
    """New order (class_id, position); must list every class once. Raises otherwise."""
    given = order.groupBy("class_id").agg(F.count("*").alias("_n"), F.min("position").alias("_p"))
    joined = classes.join(given, "class_id", "full")
    if joined.filter("_n IS NULL OR _n > 1 OR ord IS NULL").limit(1).count():
        raise ValueError("class order must include every class once")
    return joined.withColumn("ord", F.col("_p").cast("bigint")).drop("_n", "_p")


def change_exclusions(annotations: DataFrame, images: DataFrame, requests: DataFrame) -> Outcome:
    """Exclude accepted objects from training or restore them (CUR-04); review state stays.

    ``requests``: request_id, annotation_id, expected_revision, action, confirm, actor.
    """
    now = annotations.selectExpr("annotation_id", "image_id", "status AS _status", "revision AS _revision",
                                 "coalesce(training_excluded, false) AS _excluded")
    rows = requests.join(now, "annotation_id", "left")
    times = requests.groupBy("request_id", "annotation_id").agg(F.count("*").alias("_t")).groupBy("request_id").agg(F.max("_t").alias("_t"))
    verdict = rows.groupBy("request_id").agg(
        F.min("action").alias("action"), F.min("confirm").alias("confirm"), F.expr("count_if(_status IS NULL) > 0").alias("missing"),
        F.expr("count_if(NOT expected_revision <=> _revision) > 0").alias("stale"),
        F.expr("count_if(_status <> 'accepted' OR _excluded) > 0").alias("not_excludable"),
        F.expr("count_if(NOT _excluded) > 0").alias("not_excluded")).join(times, "request_id").withColumn("reason", F.expr(_first_reason([
            ("unknown_action", "action NOT IN ('exclude', 'restore')"), ("confirm_needed", "NOT confirm"), ("bad_selection", "_t > 1"),
            ("missing_object", "missing"), ("stale_revision", "stale"), ("not_excludable", "action = 'exclude' AND not_excludable"),
            ("not_excluded", "action = 'restore' AND not_excluded")])))
    # Two valid requests for one object: the lower id stands, the other conflicts as a whole.
    good = rows.join(verdict.filter("reason IS NULL").select("request_id"), "request_id", "left_semi")
    first = good.groupBy("annotation_id").agg(F.min("request_id").alias("_first"))
    late = good.join(first, "annotation_id").filter("request_id <> _first").select("request_id").distinct()
    chosen = good.join(late, "request_id", "left_anti").select("annotation_id", F.col("action").alias("_action"), "image_id")
    after = annotations.join(chosen.drop("image_id"), "annotation_id", "left").withColumns({
        "training_excluded": F.expr("CASE WHEN _action IS NULL THEN training_excluded ELSE _action = 'exclude' END"),
        "revision": F.expr("revision + CASE WHEN _action IS NULL THEN 0 ELSE 1 END")}).drop("_action")
    touched = chosen.select("image_id").distinct().withColumn("_t", F.lit(True))
    images2 = images.join(touched, "image_id", "left").withColumn("revision", F.expr("revision + CASE WHEN _t THEN 1 ELSE 0 END")).drop("_t")
    conflicts = _conflicts(verdict).unionByName(late.withColumn("reason", F.lit("object_changed")))
    return Outcome(after, images2, conflicts)


def confirm_review(annotations: DataFrame, images: DataFrame, classes: DataFrame, requests: DataFrame,
                   expected: DataFrame | None = None) -> Outcome:
    """Whole-image review (CUR-05). ``requests``: request_id, image_id, expected_role, accept_pending,
    confirm_negative, attest, actor. ``expected``: request_id, annotation_id, expected_revision must
    list exactly the current rows of the image."""
    wanted = requests.select("request_id", "image_id")
    rows = annotations.join(_active(classes, "class_id", "_ok"), "class_id", "left")
    sums = rows.groupBy("image_id").agg(
        F.count_if(F.expr(LIVE)).alias("live"), F.count_if(F.expr(f"{LIVE} AND _ok IS NULL")).alias("unassigned"),
        F.count_if(F.expr("status IN ('draft', 'proposal')")).alias("pending"))
    judged = (requests.join(images.select("image_id", "role", "missing", F.lit(True).alias("_known")), "image_id", "left")
              .join(sums, "image_id", "left").na.fill(0, ["live", "unassigned", "pending"]))
    if expected is not None:
        seen = (annotations.join(wanted, "image_id").select("request_id", "annotation_id", "revision")
                .join(expected.select("request_id", "annotation_id", "expected_revision"), ["request_id", "annotation_id"], "full"))
        off = seen.groupBy("request_id").agg(F.max(F.expr("NOT revision <=> expected_revision")).alias("_stale"))
        judged = judged.join(off, "request_id", "left")
    else:
        judged = judged.withColumn("_stale", F.lit(False))
    verdict = _one_per_image(judged.withColumn("reason", F.expr(_first_reason([
        ("attest_needed", "NOT attest"), ("unknown_image", "_known IS NULL"), ("role_changed", "NOT expected_role <=> role"),
        ("role_not_trainable", "role NOT IN ('pool', 'train', 'validation')"), ("image_missing", "missing IS NOT NULL"),
        ("stale_revision", "coalesce(_stale, false)"), ("unassigned_objects", "unassigned > 0"),
        ("pending_objects", "pending > 0 AND NOT accept_pending"), ("negative_not_confirmed", "live = 0 AND NOT confirm_negative")]))))
    won = verdict.filter("reason IS NULL").select("image_id", F.col("actor").alias("_actor"))
    pending = "status IN ('draft', 'proposal') AND _actor IS NOT NULL"
    after = annotations.join(won, "image_id", "left").withColumn("_hit", F.expr(pending)).withColumns({
        "status": F.expr("CASE WHEN _hit THEN 'accepted' ELSE status END"),
        "review_actor": F.expr("CASE WHEN _hit THEN _actor ELSE review_actor END"),
        "revision": F.expr("revision + CASE WHEN _hit THEN 1 ELSE 0 END")}).drop("_actor", "_hit")
    images2 = images.join(won, "image_id", "left").withColumns({
        "complete": F.expr("complete OR _actor IS NOT NULL"), "review_actor": F.expr("coalesce(_actor, review_actor)"),
        "revision": F.expr("revision + CASE WHEN _actor IS NULL THEN 0 ELSE 1 END")}).drop("_actor")
    return Outcome(after, images2, _conflicts(verdict))


def update_images(images: DataFrame, annotations: DataFrame, rounds: DataFrame, requests: DataFrame) -> Outcome:
    """Role, group and completeness changes (CUR-06).

    ``requests``: request_id, image_id, role, group_id, complete, attest, actor; NULL leaves a field.
    Related images are compared by their current roles.
    """
    live = images.filter("NOT removed")
    per_group = live.groupBy("group_id").agg(F.count("*").alias("_in_group"))
    per_role = live.groupBy("group_id", "role").agg(F.count("*").alias("_same_role"))
    planned = rounds.select("image_id").distinct().withColumn("_planned", F.lit(True))
    pending = annotations.filter("status IN ('draft', 'proposal')").select("image_id").distinct().withColumn("_pending", F.lit(True))
    now = images.selectExpr("image_id", "role AS _role", "group_id AS _group", "removed AS _removed", "true AS _known")
    joined = (requests.join(now, "image_id", "left").join(planned, "image_id", "left").join(pending, "image_id", "left")
              .withColumns({"_to_role": F.expr("coalesce(role, _role)"), "_to_group": F.expr("coalesce(group_id, _group)")}))
    joined = (joined.join(per_group.withColumnRenamed("group_id", "_to_group"), "_to_group", "left")
              .join(per_role.withColumnsRenamed({"group_id": "_to_group", "role": "_to_role"}), ["_to_group", "_to_role"], "left"))
    others = """coalesce(_in_group, 0) - CASE WHEN _group = _to_group AND NOT _removed THEN 1 ELSE 0 END
        > coalesce(_same_role, 0) - CASE WHEN _group = _to_group AND _role = _to_role AND NOT _removed THEN 1 ELSE 0 END"""
    roles = ", ".join(f"'{r}'" for r in ROLES)
    verdict = _one_per_image(joined.withColumn("reason", F.expr(_first_reason([
        ("unknown_image", "_known IS NULL"), ("bad_role", f"role IS NOT NULL AND role NOT IN ({roles})"),
        ("role_fixed_by_plan", "role IS NOT NULL AND _planned"),
        ("group_role_conflict", f"(role IS NOT NULL OR group_id IS NOT NULL) AND {others}"),
        ("bad_group", "group_id IS NOT NULL AND trim(group_id) = ''"),
        ("attest_needed", "complete AND NOT coalesce(attest, false)"), ("pending_objects", "complete AND _pending")]))))
    # Two changes that meet in one group with different roles cannot both stand.
    good = verdict.filter("reason IS NULL")
    moved = good.filter("role IS NOT NULL OR group_id IS NOT NULL")
    split = moved.groupBy("_to_group").agg(F.min("_to_role").alias("a"), F.max("_to_role").alias("b")).filter("a <> b").select("_to_group")
    clash = moved.join(split, "_to_group", "left_semi").select("request_id")
    won = good.join(clash, "request_id", "left_anti").selectExpr(
        "image_id", "role AS _r", "group_id AS _g", "complete AS _c", "actor AS _actor")
    images2 = images.join(won, "image_id", "left").withColumns({
        "role": F.expr("coalesce(_r, role)"), "group_id": F.expr("coalesce(trim(_g), group_id)"),
        "complete": F.expr("coalesce(_c, complete)"), "review_actor": F.expr("CASE WHEN _c THEN _actor ELSE review_actor END"),
        "revision": F.expr("revision + CASE WHEN _actor IS NULL THEN 0 ELSE 1 END")}).drop("_r", "_g", "_c", "_actor")
    return Outcome(images=images2, conflicts=_conflicts(verdict).unionByName(clash.withColumn("reason", F.lit("group_role_conflict"))))


def remove_images(images: DataFrame, rounds: DataFrame, requests: DataFrame) -> Outcome:
    """Soft removal (CUR-07): started rounds protect an image, planned ones lose it and may vanish."""
    started = rounds.filter("status <> 'planned'").select("image_id").distinct().withColumn("_started", F.lit(True))
    verdict = _one_per_image(requests.join(images.selectExpr("image_id", "true AS _known", "removed"), "image_id", "left")
                             .join(started, "image_id", "left").withColumn("reason", F.expr(_first_reason([
                                 ("confirm_needed", "NOT confirm"), ("unknown_image", "_known IS NULL OR removed"),
                                 ("protected_by_round", "_started")]))))
    gone = verdict.filter("reason IS NULL").select("image_id", F.lit(True).alias("_gone"))
    images2 = images.join(gone, "image_id", "left").withColumn("removed", F.expr("removed OR coalesce(_gone, false)")).drop("_gone")
    rounds2 = rounds.join(gone, "image_id", "left").filter("_gone IS NULL OR status <> 'planned'").drop("_gone")
    return Outcome(images=images2, rounds=rounds2, conflicts=_conflicts(verdict))


def _own_signature(rows: DataFrame) -> DataFrame:
    """A redrawn row is no longer what was generated: its signature goes."""
    if "generation_signature" not in rows.columns:
        return rows
    return rows.withColumn("generation_signature", F.expr("CASE WHEN nx0 IS NULL THEN generation_signature END"))


def edit_objects(annotations: DataFrame, images: DataFrame, classes: DataFrame, edits: DataFrame, slabs: DataFrame | None = None,
                 shapes: DataFrame | None = None) -> Outcome:
    """Single-object edits and deletes (CUR-08).

    ``edits``: seq, annotation_id, delete, set_class, class_id, status, nx0..ny1 (NULL keeps the
    geometry), actor. ``shapes`` (seq, x0..y1) holds the pixels of edits that draw a mask. With ``slabs`` (annotation_id,
    image_id, x0..y1, width, height) the outcome has the slab table with edited and deleted rows replaced. A class or geometry change without a status becomes a draft. The first valid
    edit of an image stands; later ones saw an older state and conflict.
    """
    now = annotations.selectExpr("annotation_id", "image_id", "status AS _status", "class_id AS _class", "width AS _w", "height AS _h")
    edits, united = _drawn_edits(edits, shapes, "seq")
    rows = edits.withColumnRenamed("seq", "request_id").join(now, "annotation_id", "left")
    rows = rows.withColumns({
        "_to_class": F.expr("CASE WHEN set_class THEN class_id ELSE _class END"),
        "_to_status": F.expr("coalesce(status, CASE WHEN set_class OR nx0 IS NOT NULL THEN 'draft' ELSE _status END)")})
    rows = rows.join(_active(classes, "_to_class", "_ok"), "_to_class", "left")
    verdict = _one_per_image(rows.withColumn("reason", F.expr(_first_reason([
        ("missing_object", "_status IS NULL"), ("superseded", "_status = 'superseded'"),
        ("bad_status", "NOT delete AND _to_status NOT IN ('draft', 'proposal', 'accepted', 'rejected')"),
        ("inactive_class", "NOT delete AND _to_class IS NOT NULL AND _ok IS NULL"),
        ("class_needed", "NOT delete AND _to_status = 'accepted' AND _to_class IS NULL"),
        ("bad_geometry", "NOT delete AND nx0 IS NOT NULL AND NOT (0 <= nx0 AND nx0 < nx1 AND nx1 <= _w AND 0 <= ny0 AND ny0 < ny1 AND ny1 <= _h)")]))))
    won = verdict.filter("reason IS NULL").selectExpr("annotation_id", "image_id", "delete AS _delete", "_to_class", "_to_status", "nx0", "ny0", "nx1", "ny1", "actor AS _actor",
                                                      "_area", "request_id AS seq", "_w AS width", "_h AS height")
    hit = annotations.join(won.drop("image_id", "seq", "width", "height"), "annotation_id", "left")
    tombs = _tombstones(hit.filter("_delete OR nx0 IS NOT NULL OR _to_status = 'rejected'"),
                        "CASE WHEN _delete THEN 'deleted' WHEN nx0 IS NOT NULL THEN 'geometry_replaced' ELSE 'rejected' END", slabs)
    after = hit.filter("NOT coalesce(_delete, false)").withColumns({
        "class_id": F.expr("CASE WHEN _actor IS NULL THEN class_id ELSE _to_class END"), "status": F.expr("coalesce(_to_status, status)"),
        "x0": F.expr("coalesce(nx0, x0)"), "y0": F.expr("coalesce(ny0, y0)"), "x1": F.expr("coalesce(nx1, x1)"), "y1": F.expr("coalesce(ny1, y1)"),
        "manually_edited": F.expr("manually_edited OR nx0 IS NOT NULL"),
        "review_actor": F.expr("CASE WHEN _actor IS NULL THEN review_actor WHEN _to_status = 'accepted' THEN _actor END"),
        "revision": F.expr("revision + CASE WHEN _actor IS NULL THEN 0 ELSE 1 END")})
    if shapes is not None:
        after = after.withColumn("geom_type", F.expr("CASE WHEN _area IS NULL THEN geom_type ELSE 'mask' END"))
    after = _own_signature(after.withColumn("area", F.expr("CASE WHEN nx0 IS NULL THEN area ELSE coalesce(_area, (x1 - x0) * (y1 - y0)) END"))).drop(
        "_delete", "_to_class", "_to_status", "nx0", "ny0", "nx1", "ny1", "_actor", "_area")
    pixels = None if slabs is None else _replaced_slabs(slabs, won.filter("_delete OR nx0 IS NOT NULL"), _new_slabs(won.filter("NOT _delete"), united, "seq"))
    return Outcome(after, _reopen(images, won), _conflicts(verdict), tombstones=tombs, slabs=pixels)


def round_actions(rounds: DataFrame, images: DataFrame, requests: DataFrame) -> Outcome:
    """Start or finish rounds (CUR-09). ``requests``: request_id, round_number, action."""
    members = rounds.join(images.select("image_id", "complete"), "image_id", "left")
    state = members.groupBy("round_number").agg(F.max("status").alias("_status"), F.count_if(F.expr("NOT coalesce(complete, false)")).alias("_open"))
    running = state.filter("_status = 'in_progress'").agg(F.count("*").alias("n")).first()[0]
    judged = requests.join(state, "round_number", "left").withColumn("reason", F.expr(_first_reason([
        ("unknown_action", "action NOT IN ('start', 'finish')"), ("unknown_round", "_status IS NULL"),
        ("already_started", "action = 'start' AND _status <> 'planned'"), ("another_in_progress", f"action = 'start' AND {running} > 0"),
        ("not_started", "action = 'finish' AND _status <> 'in_progress'"), ("images_incomplete", "action = 'finish' AND _open > 0")])))
    first = judged.filter("reason IS NULL AND action = 'start'").agg(F.min("request_id").alias("m")).first()[0]
    if first is not None:
        judged = judged.withColumn("reason", F.expr(
            f"CASE WHEN reason IS NULL AND action = 'start' AND request_id <> {first!r} THEN 'another_in_progress' ELSE reason END"))
    won = judged.filter("reason IS NULL").groupBy("round_number").agg(F.min("action").alias("_action"))
    rounds2 = rounds.join(won, "round_number", "left").withColumn("status", F.expr(
        "CASE _action WHEN 'start' THEN 'in_progress' WHEN 'finish' THEN 'review_complete' ELSE status END")).drop("_action")
    return Outcome(rounds=rounds2, conflicts=_conflicts(judged))


def replace_layer(annotations: DataFrame, replacements: DataFrame) -> Outcome:
    """Untouched proposals of an old layer step back for a new one (CUR-10).

    ``replacements``: image_id, layer_id, new_layer_id. Only ``proposal`` rows whose revision is
    still the generated one are superseded.
    """
    hit = annotations.join(replacements, ["image_id", "layer_id"], "left").withColumn(
        "_hit", F.expr("new_layer_id IS NOT NULL AND status = 'proposal' AND revision = generated_revision"))
    after = hit.withColumns({"status": F.expr("CASE WHEN _hit THEN 'superseded' ELSE status END"),
                             "revision": F.expr("revision + CASE WHEN _hit THEN 1 ELSE 0 END"),
                             "superseded_by_layer": F.expr("CASE WHEN _hit THEN new_layer_id END")}).drop("_hit", "new_layer_id")
    return Outcome(after)


def review_repairs(annotations: DataFrame, images: DataFrame, classes: DataFrame, proposals: DataFrame,
                   matched: DataFrame, decisions: DataFrame, slabs: DataFrame | None = None, shapes: DataFrame | None = None) -> Outcome:
    """Decide pending repair suggestions (CUR-11).

    ``shapes`` (proposal_id, x0..y1) holds the pixels of suggestions that are masks; with ``slabs`` the outcome has the
    slab table in which an accepted repair's pixels stand for its target's.

    ``proposals``: proposal_id, annotation_id, revision, image_id, status, nx0..ny1 (NULL = none).
    ``matched``: proposal_id, annotation_id, revision. ``decisions``: request_id, proposal_id,
    decision (accept / retain / exclude), attest, actor. A stale suggestion can only be retained,
    which dismisses it.
    """
    now = annotations.selectExpr("annotation_id", "revision AS _rev", "status AS _status", "class_id AS _class")
    given = proposals
    proposals, united = _drawn_edits(proposals, shapes, "proposal_id")
    stale_match = (matched.join(now, "annotation_id", "left").groupBy("proposal_id").agg(
        F.max(F.expr("_rev IS NULL OR _rev <> revision OR _status NOT IN ('draft', 'proposal')")).alias("_stale_match")))
    rows = (decisions.join(proposals.withColumnRenamed("status", "_pstatus"), "proposal_id", "left").join(now, "annotation_id", "left")
            .join(images.selectExpr("image_id", "removed AS _removed", "true AS _image"), "image_id", "left")
            .join(stale_match, "proposal_id", "left").join(_active(classes, "_class", "_assigned"), "_class", "left")
            .withColumn("_stale", F.expr("""coalesce(_stale_match, false) OR _rev IS NULL OR _rev <> revision
                                            OR _status IN ('rejected', 'superseded') OR coalesce(_removed, false)""")))
    verdict = _one_per_image(rows.withColumn("reason", F.expr(_first_reason([
        ("attest_needed", "NOT attest"), ("unknown_decision", "decision NOT IN ('accept', 'retain', 'exclude')"),
        ("not_pending", "_pstatus IS NULL OR _pstatus <> 'pending'"), ("unknown_image", "_image IS NULL"),
        ("stale", "_stale AND decision <> 'retain'"), ("no_replacement", "decision = 'accept' AND nx0 IS NULL")]))))
    won = verdict.filter("reason IS NULL")
    accepted = won.filter("decision = 'accept' AND NOT _stale")
    target = accepted.selectExpr("annotation_id", "nx0", "ny0", "nx1", "ny1", "_area", "coalesce(_assigned, false) AS _assigned", "actor AS _actor")
    partner = (matched.select("proposal_id", "annotation_id").join(accepted.selectExpr("proposal_id", "annotation_id AS _into"), "proposal_id")
               .groupBy("annotation_id").agg(F.min("_into").alias("_into")))
    if "superseded_by" not in annotations.columns:
        annotations = annotations.withColumn("superseded_by", F.lit(None).cast("string"))
    hit = annotations.join(target, "annotation_id", "left").join(partner, "annotation_id", "left")
    tombs = _tombstones(hit.filter("_actor IS NOT NULL OR _into IS NOT NULL"),
                        "CASE WHEN _actor IS NOT NULL THEN 'repair_accept' ELSE 'repair_merge_accept' END", slabs)
    after = hit.withColumns({
        "status": F.expr("CASE WHEN _actor IS NOT NULL THEN CASE WHEN _assigned THEN 'accepted' ELSE 'draft' END WHEN _into IS NOT NULL THEN 'superseded' ELSE status END"),
        "review_actor": F.expr("CASE WHEN _actor IS NOT NULL THEN CASE WHEN _assigned THEN _actor END ELSE review_actor END"),
        "revision": F.expr("revision + CASE WHEN _actor IS NULL AND _into IS NULL THEN 0 ELSE 1 END"),
        "superseded_by": F.coalesce("_into", "superseded_by"), "manually_edited": F.expr("manually_edited OR _actor IS NOT NULL"),
        "x0": F.expr("coalesce(nx0, x0)"), "y0": F.expr("coalesce(ny0, y0)"), "x1": F.expr("coalesce(nx1, x1)"), "y1": F.expr("coalesce(ny1, y1)")})
    if shapes is not None:
        after = after.withColumn("geom_type", F.expr("CASE WHEN _area IS NULL THEN geom_type ELSE 'mask' END"))
    after = _own_signature(after.withColumn("area", F.expr("CASE WHEN nx0 IS NULL THEN area ELSE coalesce(_area, (x1 - x0) * (y1 - y0)) END"))).drop(
        "nx0", "ny0", "nx1", "ny1", "_assigned", "_actor", "_into", "_area")
    pixels = None
    if slabs is not None:
        sized = accepted.select("proposal_id", "annotation_id", "image_id", "nx0", "ny0", "nx1", "ny1", "_area").join(
            slabs.select("annotation_id", "width", "height").distinct(), "annotation_id")
        pixels = _replaced_slabs(slabs, accepted, _new_slabs(sized, united, "proposal_id"))
    touched = won.selectExpr("image_id", "decision = 'accept' AND NOT _stale AS _reopen", "decision = 'exclude' AS _exclude")
    images2 = images.join(touched, "image_id", "left").withColumns({
        "complete": F.expr("complete AND NOT coalesce(_reopen, false)"), "review_actor": F.expr("CASE WHEN coalesce(_reopen, false) THEN NULL ELSE review_actor END"),
        "training_excluded": F.expr("training_excluded OR coalesce(_exclude, false)"),
        "revision": F.expr("revision + CASE WHEN _reopen IS NULL THEN 0 ELSE 1 END")}).drop("_reopen", "_exclude")
    fate = won.selectExpr("proposal_id", "CASE WHEN _stale THEN 'dismissed_stale' WHEN decision = 'accept' THEN 'accepted' WHEN decision = 'retain' THEN 'retained' ELSE 'excluded' END AS _fate")
    proposals2 = given.join(fate, "proposal_id", "left").withColumn("status", F.coalesce("_fate", "status")).drop("_fate")
    return Outcome(after, images2, _conflicts(verdict), tombstones=tombs, proposals=proposals2, slabs=pixels)
