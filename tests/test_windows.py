"""Tiling, numbering, rounds, history and hand-made cases."""
import random

import pytest
from pyspark.sql import functions as F

from maskloom.operators import history as H, seams as S, tiling as TL, windows as W


def plan(spark, w, h, tiling=TL.DEFAULT, **kw):
    df = spark.createDataFrame([(1, w, h)], "image_id BIGINT, width BIGINT, height BIGINT")
    return [tuple(r) for r in TL.plan_tiles(df, tiling, **kw)[0].orderBy("tile_idx").select("x0", "y0", "x1", "y1").collect()]


def test_plans(spark):
    assert len(plan(spark, 3024, 4032)) == 88
    assert len(plan(spark, 3024, 4032, TL.resolve_tiling(preset="custom", width=640, height=384))) == 84
    assert len(plan(spark, 3024, 4032, TL.TRAINING, padded=True)) == 48
    assert len(plan(spark, 2048, 1536)) == 20 and TL.DEFAULT.overlap_x == 128
    assert plan(spark, 1500, 700, TL.square_tiling()) == [(0, 0, 1024, 700), (476, 0, 1500, 700)]
    assert sorted({t[0] for t in plan(spark, 1100, 600, TL.TRAINING)}) == [0, 512, 588]


@pytest.mark.parametrize("bad", [dict(preset="512", width=400), dict(width=True), dict(overlap_x=100), dict(overlap_x=float("nan")),
                                 dict(overlap_mode="pixels", overlap_x=512), dict(mode="half"), dict(overlap_mode="pixels", overlap_x=1.5)])
def test_bad_tiling(bad):
    with pytest.raises(ValueError):
        TL.resolve_tiling(**bad)


def test_tile_guard(spark):
    df = spark.createDataFrame([(1, 9000, 9000), (2, 20000, 20000), (3, 100, 100)], "image_id BIGINT, width BIGINT, height BIGINT")
    tiles, rejects = TL.plan_tiles(df, TL.resolve_tiling(preset="custom", width=64, height=64, overlap_x=0, overlap_y=0))
    assert {r["image_id"]: r["reason"] for r in rejects.collect()} == {1: "too_many_tiles", 2: "bad_dimensions"}
    assert {r["image_id"] for r in tiles.select("image_id").distinct().collect()} == {3}


def test_hits_match_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        w, h = rng.randint(20, 900), rng.randint(20, 900)
        x0, y0 = rng.randrange(w), rng.randrange(h)
        rows.append((i, w, h, x0, y0, rng.randint(x0 + 1, w), rng.randint(y0 + 1, h)))
    df = spark.createDataFrame(rows, "image_id BIGINT, width BIGINT, height BIGINT, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT")
    for tiling in (TL.resolve_tiling(preset="custom", width=100, height=80, overlap_x=30, overlap_y=10), TL.TRAINING,
                   TL.resolve_tiling(preset="custom", width=64, height=64, overlap_mode="pixels", overlap_x=50, overlap_y=0)):
        got = {(r["image_id"], r["tile_idx"]) for r in TL.tiles_hit(df, tiling).collect()}
        tiles = TL.plan_tiles(df, tiling)[0].collect()
        boxes = {r[0]: r[3:] for r in rows}
        want = {(t["image_id"], t["tile_idx"]) for t in tiles
                if t["x0"] < boxes[t["image_id"]][2] and t["x1"] > boxes[t["image_id"]][0] and t["y0"] < boxes[t["image_id"]][3] and t["y1"] > boxes[t["image_id"]][1]}
        assert got == want


@pytest.mark.parametrize("n,rounds,sizes", [(17, 4, [5, 4, 4, 4]), (8, 5, [2, 2, 2, 1, 1]), (3, 3, [1, 1, 1]), (9, 1, [9])])
def test_rounds(spark, n, rounds, sizes):
    pool = spark.range(n).withColumnRenamed("id", "image_id")
    got = W.plan_rounds(pool, rounds).groupBy("round_number").count().orderBy("round_number").collect()
    assert [r["count"] for r in got] == sizes


@pytest.mark.parametrize("n,rounds", [(0, 1), (1, 2), (1, 0)])
def test_bad_rounds(spark, n, rounds):
    with pytest.raises(ValueError):
        W.plan_rounds(spark.range(n).withColumnRenamed("id", "image_id"), rounds)


def test_manual_rounds(spark):
    pool = spark.range(4).withColumnRenamed("id", "image_id")
    order = spark.createDataFrame([(3, 0), (1, 1), (0, 2), (2, 3)], "image_id BIGINT, position INT")
    got = {r["image_id"]: r["round_number"] for r in W.plan_rounds(pool, 2, order="manual", manual=order).collect()}
    assert got == {3: 1, 1: 1, 0: 2, 2: 2}
    with pytest.raises(ValueError):
        W.plan_rounds(pool, 2, order="manual", manual=order.filter("image_id > 0"))


def test_dense_ids_on_one_hot_key(spark):
    df = spark.range(5000).select(F.lit(7).alias("k"), (F.col("id") * 7919 % 5000).alias("v")).repartition(8)
    got = W.dense_ids(df, ["k", "v"], "n").collect()
    assert sorted((r["v"], r["n"]) for r in got) == [(i, i + 1) for i in range(5000)]


def test_next_review(spark):
    rows = [(0, False, None, "pool"), (1, True, None, "pool"), (2, False, "image", "pool"), (3, False, None, "excluded"), (4, False, None, "train"), (5, True, None, "pool")]
    df = spark.createDataFrame(rows, "image_id BIGINT, complete BOOLEAN, missing STRING, role STRING")
    for block in (1, 2, 100):
        got = {r["image_id"]: r["next_image_id"] for r in W.next_review(df, block).collect()}
        assert got == {0: 4, 1: 4, 2: 4, 3: 4, 4: 0, 5: 0}


def replay(actions):
    """Literal undo / redo: highest live entry, lowest undone entry, edits drop undone ones."""
    live, undone = [], []
    for seq, action in enumerate(actions):
        if action == "edit":
            undone, live = [], live + [seq]
        elif action == "undo" and live:
            undone.append(live.pop())
        elif action == "redo" and undone:
            back = min(undone)
            undone.remove(back)
            live.append(back)
            live.sort()
    return len(live), len(undone), live[-1] if live else None


@pytest.mark.parametrize("chunk", [1_000_000, 7])
def test_history(spark, chunk):
    rng = random.Random(11)
    logs = {i: [rng.choice(["edit", "edit", "undo", "undo", "redo", "review"]) for _ in range(rng.choice([1, 5, 40, 90]))] for i in range(12)}
    rows = [(i, s, a) for i, log in logs.items() for s, a in enumerate(log)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "image_id BIGINT, seq BIGINT, action STRING")
    got = {r["image_id"]: (r["depth"], r["redo"], r["top_seq"]) for r in H.fold_history(df, chunk).collect()}
    assert got == {i: replay(log) for i, log in logs.items()}


def test_piece_forms():
    """What a piece makes of every depth before it, against the plain walk."""
    rng = random.Random(7)
    for _ in range(300):
        actions = ["edit"] + [rng.choice(["edit", "undo", "undo", "redo", "redo", "review"]) for _ in range(rng.randrange(0, 40))]
        base, points = H.piece_form(actions)
        for start in range(0, 45, 3):
            depth, redo = start, 0
            for a in actions:
                if a == "edit":
                    depth, redo = depth + 1, 0
                elif a == "undo" and depth:
                    depth, redo = depth - 1, redo + 1
                elif a == "redo" and redo:
                    depth, redo = depth + 1, redo - 1
            assert base + start - int((points < start).sum()) == depth


def test_restored_rows_follow_the_position(spark):
    """Two rows, an edit of each, a deletion; undo brings rows back, a redo to an archived class is refused."""
    images = spark.createDataFrame([(1, True, "human", 5), (2, True, "human", 9)], "image_id BIGINT, complete BOOLEAN, review_actor STRING, revision BIGINT")
    rows = spark.createDataFrame([(1, "a", "c", 2), (1, "b", "c", 2), (2, "z", "c", 1)], "image_id BIGINT, annotation_id STRING, class_id STRING, revision BIGINT")
    changes = spark.createDataFrame([(1, 10, "a", False, None), (1, 11, "b", True, None), (1, 12, "n", False, "gone")],
                                    "image_id BIGINT, seq BIGINT, annotation_id STRING, deleted BOOLEAN, class_id STRING")
    classes = spark.createDataFrame([("c", False), ("gone", True)], "class_id STRING, archived BOOLEAN")
    log = spark.createDataFrame([(1, s, a) for s, a in ((10, "edit"), (11, "edit"), (12, "edit"), (13, "undo"), (14, "redo"), (15, "undo"))], "image_id BIGINT, seq BIGINT, action STRING")
    out = H.restore_history(images, rows, log, changes, classes)
    assert {(r["annotation_id"], r["class_id"], r["revision"]) for r in out.annotations.collect()} == {("a", None, 10), ("b", "c", 10), ("z", "c", 1)}
    assert {(r["image_id"], r["complete"], r["revision"]) for r in out.images.collect()} == {(1, False, 10), (2, True, 9)}
    assert [(r["seq"], r["reason"]) for r in out.conflicts.collect()] == [(14, "archived_class")]
    early = H.restore_history(images, rows, log, changes, classes, upto=12)
    assert {r["annotation_id"] for r in early.annotations.collect()} == {"a", "n", "z"}


def test_context_crops(spark):
    base = dict(annotation_id="a", x0=490, y0=490, x1=520, y1=520)
    def crops(w, h, kind):
        df = spark.createDataFrame([(*base.values(), w, h, kind)], "annotation_id STRING, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT, width BIGINT, height BIGINT, source_kind STRING")
        return [(r["crop_x1"] - r["crop_x0"], r["crop_y1"] - r["crop_y0"]) for r in S.context_crops(df).orderBy("attempt").collect()]
    assert crops(2000, 1800, "yolo") == [(512, 512), (1024, 1024), (1536, 1536)]
    assert crops(2000, 1800, "sam2") == [(512, 512)]
    assert crops(100, 80, "yolo") == [(100, 80)]


def test_collisions(spark):
    rows = [(1, 0, 1, 0.0, 0.0, 1.0, 1.0), (1, 0, 2, 0.0, 0.0, 1.0, 1.0), (1, 1, 3, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "image_id BIGINT, class_index INT, row INT, minx FLOAT, miny FLOAT, maxx FLOAT, maxy FLOAT")
    assert [tuple(r) for r in W.yolo_collisions(df).collect()] == [(1, 0, 1, 2)]
