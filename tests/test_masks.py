"""Mask algebra against numpy pixels on seeded random masks."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.functions import raster, shapes
from maskloom.operators import masks as M, seams as S, vectors as V, windows as W
from maskloom.plans.views import Views


def runs(mask):
    """Per-column slabs of a raster."""
    out = []
    for x in range(mask.shape[1]):
        edge = np.flatnonzero(np.diff(np.r_[0, mask[:, x].astype(int), 0]))
        out += [(x, x + 1, int(a), int(b)) for a, b in edge.reshape(-1, 2)]
    return out


def counts(mask):
    flat = mask.ravel(order="F").astype(int)
    change = np.flatnonzero(np.diff(flat)) + 1
    out = np.diff(np.r_[0, change, flat.size]).tolist()
    return [0, *out] if flat[0] else out


def draw(slabs, shape):
    mask = np.zeros(shape, int)
    for x0, x1, y0, y1 in slabs:
        mask[y0:y1, x0:x1] += 1
    return mask


@pytest.fixture(scope="module")
def scenes():
    rng = np.random.default_rng(601)
    out = []
    for i in range(40):
        h, w = rng.integers(3, 32, 2)
        masks = [(rng.random((h, w)) < rng.choice([0.2, 0.5, 0.9])) for _ in range(3)]
        for m in masks:
            m[rng.integers(h), rng.integers(w)] = True
        out.append((i, int(h), int(w), masks))
    return out


@pytest.fixture(scope="module")
def slabs(spark, scenes):
    rows = [(i, f"{i}-{k}", h, w, *r) for i, h, w, ms in scenes for k, m in enumerate(ms) for r in runs(m)]
    return spark.createDataFrame(rows, "image_id BIGINT, annotation_id STRING, height BIGINT, width BIGINT, x0 BIGINT, x1 BIGINT, y0 BIGINT, y1 BIGINT").cache()


def test_known_rle(spark):
    mask = np.array([[0, 1, 1], [0, 1, 0], [1, 1, 0]])
    rows = [("a", 3, 3, *r) for r in runs(mask)]
    df = spark.createDataFrame(rows, "annotation_id STRING, height BIGINT, width BIGINT, x0 BIGINT, x1 BIGINT, y0 BIGINT, y1 BIGINT")
    assert M.slabs_to_rle(df, "annotation_id").first()["counts"] == [2, 5, 2]


def test_rle_round_trip(spark, scenes, slabs):
    rles = M.slabs_to_rle(slabs, "image_id", "annotation_id", "height").cache()
    got = {r["annotation_id"]: r["counts"] for r in rles.collect()}
    want = {f"{i}-{k}": counts(m) for i, _, _, ms in scenes for k, m in enumerate(ms)}
    assert got == want
    back = {}
    for r in M.rle_to_slabs(rles, "image_id", "annotation_id").collect():
        back.setdefault(r["annotation_id"], []).append((r["x0"], r["x1"], r["y0"], r["y1"]))
    for i, h, w, ms in scenes:
        for k, m in enumerate(ms):
            assert (draw(back[f"{i}-{k}"], (h, w)) == m).all()


def test_overlapping_slabs_to_rle(spark):
    df = spark.createDataFrame([("a", 10, 10, 0, 6, 0, 6), ("a", 10, 10, 3, 9, 2, 10)],
                               "annotation_id STRING, height BIGINT, width BIGINT, x0 BIGINT, x1 BIGINT, y0 BIGINT, y1 BIGINT")
    mask = draw([(0, 6, 0, 6), (3, 9, 2, 10)], (10, 10)) > 0
    assert M.slabs_to_rle(df, "annotation_id", overlapping=True).first()["counts"] == counts(mask)


def test_union_and_stats(spark, scenes, slabs):
    united = {}
    for r in M.mask_union(slabs.drop("annotation_id", "height", "width"), "image_id").collect():
        united.setdefault(r["image_id"], []).append((r["x0"], r["x1"], r["y0"], r["y1"]))
    for i, h, w, ms in scenes:
        assert (draw(united[i], (h, w)) == np.any(ms, axis=0)).all()
    stats = {r["annotation_id"]: tuple(r)[1:] for r in M.mask_stats(slabs, "annotation_id").collect()}
    for i, _, _, ms in scenes:
        for k, m in enumerate(ms):
            ys, xs = np.nonzero(m)
            assert stats[f"{i}-{k}"] == (m.sum(), xs.min(), ys.min(), xs.max() + 1, ys.max() + 1)


@pytest.mark.parametrize("size", [4, 128])
def test_pair_overlap(scenes, slabs, size):
    got = {(r["a_id"], r["b_id"]): r["intersection"] for r in M.self_intersections(slabs.drop("height", "width"), size=size).collect()}
    want = {(f"{i}-{a}", f"{i}-{b}"): int((ms[a] & ms[b]).sum()) for i, _, _, ms in scenes for a in range(3) for b in range(a + 1, 3)}
    assert got == {k: v for k, v in want.items() if v}


def flood(mask, value):
    seen, parts = np.zeros(mask.shape, bool), 0
    for start in zip(*np.nonzero(mask == value)):
        if seen[start]:
            continue
        parts, stack = parts + 1, [start]
        seen[start] = True
        while stack:
            y, x = stack.pop()
            for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] == value and not seen[p]:
                    seen[p] = True
                    stack.append(p)
    return parts


def test_topology(scenes, slabs):
    got = {r["annotation_id"]: (r["components"], r["holes"]) for r in V.topology(slabs, "annotation_id").collect()}
    for i, _, _, ms in scenes:
        for k, m in enumerate(ms):
            padded = np.pad(m, 1).astype(int)
            assert got[f"{i}-{k}"] == (flood(padded, 1), flood(padded, 0) - 1)


def test_diagonal_touch():
    assert raster.topology(np.array(runs(np.eye(3))))[0] == 3


def test_outline_is_exact_on_simple_masks(scenes):
    checked = 0
    for _, h, w, ms in scenes:
        for m in ms:
            for part in raster.component_slabs(np.array(runs(m))):
                filled = np.concatenate([part, raster.hole_slabs(part)])
                ring = raster.outline(filled)
                made = raster.intervals_to_slabs(raster.polygon_intervals(ring, h, w), h)
                assert (draw(made.tolist(), (h, w)) == draw(filled.tolist(), (h, w))).all()
                checked += 1
    assert checked > 500


def test_hole_fill():
    mask = np.zeros((20, 20), int)
    mask[2:15, 3:14] = 1
    mask[5:12, 5:12] = 0
    mask[7:10, 7:10] = 0
    slabs = np.array(runs(mask))
    assert raster.topology(slabs) == (1, 1)
    assert raster.slab_area(raster.hole_slabs(slabs)) == 49


def test_lossy_hull(spark):
    rows = [("a", 30, 30, 2, 6, 2, 6), ("a", 30, 30, 20, 24, 20, 24)]
    df = spark.createDataFrame(rows, "annotation_id STRING, height BIGINT, width BIGINT, x0 BIGINT, x1 BIGINT, y0 BIGINT, y1 BIGINT")
    strict = V.to_polygon(df, "annotation_id").first()
    assert strict["error"] == "topology_needs_consent" and strict["points"] is None
    hull = V.to_polygon(df, "annotation_id", allow_lossy=True).first()
    assert hull["method"] == "all_components_convex_hull" and hull["removed_pixels"] == 0 and hull["added_pixels"] > 0
    made = draw(raster.intervals_to_slabs(raster.polygon_intervals(np.array([(p["x"], p["y"]) for p in hull["points"]]), 30, 30), 30).tolist(), (30, 30))
    assert made.sum() == hull["converted_area"] and hull["original_area"] == 32


def test_counts_text():
    rng = np.random.default_rng(5)
    for _ in range(200):
        c = rng.integers(0, 5000, rng.integers(1, 30)).tolist()
        assert raster.text_to_counts(raster.counts_to_text(c), sum(c)) == c
    # Known value of the public format.
    assert raster.counts_to_text([6, 1, 40, 4, 5, 4, 5, 4, 21]) == "61X13mN000`0"
    assert raster.text_to_counts("", 5) is None and raster.text_to_counts("~", 5) is None
    assert raster.text_to_counts(raster.counts_to_text([9]), 4) is None


def test_shared_length():
    rng = np.random.default_rng(9)
    for _ in range(50):
        a, b = rng.random(200) < 0.5, rng.random(200) < 0.5
        as_pairs = lambda m: np.flatnonzero(np.diff(np.r_[0, m.astype(int), 0])).reshape(-1, 2)
        assert raster.shared_length(as_pairs(a), as_pairs(b)) == int((a & b).sum())


def test_painter(spark):
    rows = [(1, "a", 0, 6, 0, 6), (1, "b", 3, 9, 2, 10), (1, "c", 0, 2, 1, 3)]
    df = spark.createDataFrame(rows, "image_id BIGINT, annotation_id STRING, x0 BIGINT, x1 BIGINT, y0 BIGINT, y1 BIGINT")
    df = df.withColumn("ord", F.col("annotation_id")).withColumn("obj", F.struct("annotation_id"))
    for policy in ("first", "last"):
        plane = np.full((10, 10), "", dtype=object)
        for _, name, x0, x1, y0, y1 in (rows if policy == "last" else rows[::-1]):
            plane[y0:y1, x0:x1] = name
        got = np.full((10, 10), "", dtype=object)
        for r in W.paint(df, policy).collect():
            got[r["y0"]:r["y1"], r["x0"]:r["x1"]] = r["obj"]["annotation_id"]
        assert (got == plane).all()
    assert W.plane_conflicts(W.paint(df)).first()["overlap_pixels"] == 12 + 4


def test_counts_to_few_slabs(spark):
    """A box comes back as one slab, a frame as its parts; what a column holds stays as it was."""
    slabs = spark.createDataFrame([("a", 10, 12, 2, 9, 1, 5), ("b", 10, 12, 0, 3, 0, 10), ("b", 10, 12, 3, 6, 4, 10)],
                                  "annotation_id string, height long, width long, x0 long, x1 long, y0 long, y1 long")
    rles = M.slabs_to_rle(slabs, "annotation_id", "height")
    back = M.rle_to_slabs(rles, "annotation_id")
    got = sorted(tuple(r) for r in back.collect())
    assert [r for r in got if r[0] == "a"] == [("a", 2, 9, 1, 5)]
    columns = sorted(tuple(r) for r in M.to_columns(back).select("annotation_id", "x", "y0", "y1").collect() if r["annotation_id"] == "b")
    assert columns == [("b", 0, 0, 10), ("b", 1, 0, 10), ("b", 2, 0, 10), ("b", 3, 4, 10), ("b", 4, 4, 10), ("b", 5, 4, 10)]


def test_signature_of_overlapping_slabs_needs_one_shuffle(spark):
    slabs = spark.createDataFrame([("a", 10, 12, 0, 5, 0, 6), ("a", 10, 12, 3, 8, 2, 9), ("a", 10, 12, 3, 8, 2, 9), ("n", 10, 12, 1, 2, 0, 3)],
                                  "annotation_id string, height long, width long, x0 long, x1 long, y0 long, y1 long")
    rles = M.slabs_to_rle(slabs, "annotation_id", overlapping=True)
    assert rles._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    mask = np.zeros((10, 12), int)
    mask[0:6, 0:5] = 1
    mask[2:9, 3:8] = 1
    assert {r["annotation_id"]: r["counts"] for r in rles.collect()} == {"a": counts(mask), "n": [10, 3, 107]}


def test_columns_merge_as_slabs(spark):
    """Columns are put together before they are shuffled; nulls among the keys keep their groups."""
    slabs = spark.createDataFrame([("a", None, 0, 700, 2, 9), ("a", None, 600, 800, 5, 12), ("a", 1, 3, 5, 0, 2), ("a", 1, 3, 5, 2, 4), ("a", 1, 3, 5, 6, 7)],
                                  "k string, j long, x0 long, x1 long, y0 long, y1 long")
    merged = M.merge_columns(M.to_columns(slabs), "k", "j")
    assert "Window" not in merged._jdf.queryExecution().sparkPlan().toString()
    got = {(r["j"], r["x"], r["y0"], r["y1"]) for r in merged.collect()}
    wanted = {(None, x, 2, 9) for x in range(600)} | {(None, x, 2, 12) for x in range(600, 700)} | {(None, x, 5, 12) for x in range(700, 800)}
    assert got == wanted | {(1, x, 0, 4) for x in (3, 4)} | {(1, x, 6, 7) for x in (3, 4)} and merged.count() == len(got)


def test_hulls_of_many_masks_are_those_of_each():
    rng = np.random.default_rng(11)
    for _ in range(50):
        owner = np.sort(rng.integers(0, 9, 40))
        x, y = rng.integers(0, 30, (2, 40))
        slabs = np.stack([x, x + rng.integers(1, 9, 40), y, y + rng.integers(1, 9, 40)], axis=1)
        ring, points = shapes.convex_hulls(owner, slabs)
        for k in np.unique(owner):
            assert points[ring == k].tolist() == raster.convex_hull(raster.corners(slabs[owner == k])).tolist()


def test_polygon_raster_looks_only_at_steps_into_pixel_columns():
    import tracemalloc
    high = 400_000
    points = np.array([(0, 0), (3, 0), (3, high), (0, high)], float)
    tracemalloc.start()
    _, pairs = shapes.polygon_intervals(np.zeros(4, np.int64), points, np.array([high]), np.array([5]))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs.tolist() == [[0, high], [high, 2 * high], [2 * high, 3 * high]] or pairs.tolist() == [[0, 3 * high]]
    assert held < 1_000_000


def test_columns_alike_are_one_slab_before_they_are_sorted(monkeypatch):
    sorted_rows = []
    lexsort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or lexsort(keys))
    columns = np.stack([np.arange(1000), np.arange(1, 1001), np.zeros(1000, int), np.full(1000, 7)], axis=1)
    owner, slabs = shapes.side_by_side(np.zeros(1000, np.int64), columns)
    assert slabs.tolist() == [[0, 1000, 0, 7]] and max(sorted_rows) == 1


def test_counts_become_slabs_without_sorting_every_column(monkeypatch):
    import pyarrow as pa
    sorted_rows = []
    lexsort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or lexsort(keys))
    slab = pa.struct([(c, pa.int64()) for c in ("x0", "x1", "y0", "y1")])
    batch = pa.record_batch({"k": [1], "_w": [500], "_h": [40], "_slabs": pa.array([[{"x0": 5, "x1": 405, "y0": 3, "y1": 9}]], pa.list_(slab))})
    made = pa.Table.from_batches(M._encode_batches(["k"])([batch])).to_pylist()
    assert made[0]["counts"] == [203, *[6, 34] * 399, 6, 40 * 500 - 404 * 40 - 9] and not sorted_rows


def test_repair_gates_exchange_pixels_once(spark):
    boxes = "annotation_id STRING, image_id BIGINT, x0 BIGINT, x1 BIGINT, y0 BIGINT, y1 BIGINT"
    slabs = spark.createDataFrame([("t", 1, 0, 10, 0, 10), ("o", 1, 8, 20, 0, 10)], boxes)
    notes = slabs.selectExpr("*", "100 AS width", "100 AS height", "0 AS tx0", "0 AS ty0", "50 AS tx1", "50 AS ty1", "(x1 - x0) * (y1 - y0) AS area", "0L AS revision", "'draft' AS status",
                             "'sam2' AS source_kind", "'m' AS model_id", "0 AS model_class_index", "'c' AS class_id", "false AS manually_edited", "CAST(NULL AS STRING) AS review_actor", "false AS training_excluded")
    candidates = spark.sql("SELECT 'c' AS candidate_id, 't' AS target_id, 1L AS image_id, 0.9D AS predicted_iou, 0.9D AS stability_score, 0 AS crop_x0, 0 AS crop_y0, 60 AS crop_x1, 60 AS crop_y1")
    shape = spark.createDataFrame([("c", 1, 1, 15, 0, 10)], boxes.replace("annotation_id", "candidate_id"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.repair_gates(candidates, shape, notes, slabs, slabs.limit(0))[1]._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    joined = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "bx#" in line and "ReusedExchange" not in line]
    assert len(joined) < 4  # two sides each for the target and for the others, if nothing is shared
    metrics, reasons, _ = S.repair_gates(candidates, shape, notes, slabs, slabs.limit(0))
    assert metrics.first()["kept_px"] == 90
    assert sorted(r["reason"] for r in reasons.collect()) == [
        "candidate_still_touches_crop_boundary", "could_merge_distinct_neighbour:o", "physical_image_boundary_unrecoverable"]
    # An intersection counts once for each row of a candidate that comes twice.
    assert S.repair_gates(candidates.union(candidates), shape, notes, slabs, slabs.limit(0))[0].first()["kept_px"] == 180


def test_a_stored_view_is_joined_once(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    before = v.annotations
    v.store("annotations")
    assert v.annotations.dtypes == before.dtypes and before.exceptAll(v.annotations).isEmpty() and v.annotations.count() == before.count()
    assert "Join" not in v.annotations._jdf.queryExecution().optimizedPlan().toString()
