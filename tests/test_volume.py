"""What a plan exchanges and reads: views are read once, counts are formed after the last exchange."""
import re

from pyspark.sql import Row, functions as F

from maskloom.operators import predicates as P, windows as W
from maskloom.plans import views as VW
from maskloom.sinks import formats as O
from maskloom.sources import formats as I

SMALL = "/root/testdata/sf0.001"


def plan(df):
    """The plan as lines from its root; a line's depth is where its text begins."""
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def rows(df):
    return sorted(map(str, df.collect()))


def test_views_have_the_rows_of_the_common_text(spark):
    v = VW.Views(spark, SMALL)
    for name in VW.SPARK_VIEWS:
        common = v.sql(VW.VIEWS[name])
        made = getattr(v, name)
        assert made.columns == common.columns and [f.dataType for f in made.schema] == [f.dataType for f in common.schema]
        assert rows(made) == rows(common) != []


def test_shapes_read_their_table_once(spark):
    text = "\n".join(plan(VW.Views(spark, SMALL).shapes))
    assert len(re.findall(r"FileScan parquet [^\n]*l_orderkey", text)) == 1 and "Union" not in text


def test_annotations_come_by_image(spark):
    """What is counted by image needs no exchange beyond those of the two joins."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = VW.Views(spark, SMALL).annotations.groupBy("image_id").count()
        assert sum("Exchange" in line for line in plan(df)) == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbered_rows_are_not_exchanged_again(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = W.dense_ids(spark.range(100).select("id"), ["id"], "n")
        assert not any("SortMergeJoin" in line for line in plan(df))
        assert [r.n for r in df.orderBy("id").collect()] == list(range(1, 101))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_coco_counts_come_after_the_last_exchange(spark):
    images = spark.createDataFrame([(1, 20, 10), (2, 8, 8)], "image_id BIGINT, width BIGINT, height BIGINT")
    classes = spark.createDataFrame([Row(class_id="c", name="c", ord=1, archived=False)])
    objects = spark.createDataFrame([("a", 1, "c", "mask", 2, 3, 5, 6), ("b", 1, "c", "box", 0, 0, 4, 4), ("d", 2, "c", "mask", 1, 1, 2, 3), ("e", 2, "c", "mask", 0, 0, 1, 1), (None, 2, "c", "mask", 0, 0, 1, 1)],
                                    "annotation_id STRING, image_id BIGINT, class_id STRING, geom_type STRING, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT")
    slabs = objects.filter("annotation_id <> 'e' OR annotation_id IS NULL").select("image_id", "annotation_id", "x0", "x1", "y0", "y1")
    made = O.coco_rows(images, objects, classes, slabs)[2]
    lines = plan(made)
    encode = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    assert not any("Exchange" in line or "Join" in line for line in lines[:encode])
    got = {(r.source_id, r.image_id): r for r in made.collect()}
    assert got["a", 1].counts == [23, 3, 7, 3, 7, 3, 154] and got["a", 1].size == [10, 20] and got["a", 1].area == 9 and got["a", 1].bbox == [2, 3, 3, 3]
    assert got["b", 1].counts is None and got["b", 1].size is None and got["b", 1].area == 16
    for key in (("e", 2), (None, 2)):
        assert got[key].counts is None and got[key].area is None
    assert got["d", 2].counts == [9, 2, 53] and len(got) == 5


def test_exported_objects_need_no_judged_images(spark):
    images = spark.createDataFrame([(1, "train", True, False), (2, "train", False, False), (3, "excluded", True, False), (4, "pool", None, False), (5, None, True, False), (6, "test", True, True)],
                                   "image_id BIGINT, role STRING, complete BOOLEAN, removed BOOLEAN")
    classes = spark.createDataFrame([Row(class_id="c", archived=False), Row(class_id="old", archived=True)])
    objects = spark.createDataFrame([(f"{i}-{k}-{s}", i, k, s) for i in range(1, 8) for k in ("c", "old", None) for s in ("accepted", "draft", "rejected")],
                                    "annotation_id STRING, image_id BIGINT, class_id STRING, status STRING")
    for mode in ("labeled", "reviewed"):
        judged, all_objects = P.export_disposition(images, objects, classes, mode)
        kept, out = P.exported(judged, all_objects)
        joined = all_objects.filter("object_reason IS NULL").join(kept.select("image_id"), "image_id", "left_semi")
        assert rows(out.select("annotation_id")) == rows(joined.select("annotation_id")) != []
        assert sum("Join" in line for line in plan(out)) == 2


def test_plane_losses_count_pixels_of_the_same_value(spark):
    classes = spark.createDataFrame([Row(class_id=c, name=c, ord=i, archived=False) for i, c in enumerate("pq")])
    made = [("a", 1, "p", 0, 10, 0, 10), ("b", 1, "p", 5, 15, 0, 10), ("c", 1, "q", 8, 20, 0, 4), ("d", 2, "q", 0, 3, 0, 3), ("e", 2, "p", 200, 600, 0, 300)]
    objects = spark.createDataFrame([(m[0], m[1], m[2]) for m in made], "annotation_id STRING, image_id BIGINT, class_id STRING")
    other = [("z", 2, "p", 0, 600, 0, 600)]  # slabs of objects that are not exported stay off the plane
    slabs = spark.createDataFrame(made + other, "annotation_id STRING, image_id BIGINT, class_id STRING, x0 BIGINT, x1 BIGINT, y0 BIGINT, y1 BIGINT").drop("class_id")
    runs, losses = O.label_plane(objects, classes, slabs, "semantic", "last", allow_lossy=True)
    assert {(r.annotation_id, r.removed_pixels, r.reason) for r in losses.collect()} == {
        ("a", 8, "hidden_by_overlap"), ("b", 28, "hidden_by_overlap"), ("a", 0, "instances_merged:2")}
    got = {(r.image_id, r.value): r.n for r in runs.groupBy("image_id", "value").agg(F.sum(F.expr("(x1 - x0) * (y1 - y0)")).alias("n")).collect()}
    assert got == {(1, 1): 122, (1, 2): 48, (2, 2): 9, (2, 1): 120000}
    # Objects and slabs are durable: neither plan joins or reads the tables they came from.
    assert not any("Join" in line for line in plan(runs))


def test_plane_runs_come_from_whole_batches(spark):
    planes = spark.createDataFrame([(1, 0, [0, 5, 5, 7, 0, 5]), (1, 1, []), (1, 2, None), (2, 4, [5]), (2, 5, [5, None, 5, 0]), (2, 6, [None, 3]), (3, 0, [0, 0])],
                                   "image_id BIGINT, x BIGINT, values ARRAY<INT>")
    made = I.plane_runs(planes)
    assert {tuple(r) for r in made.collect()} == {(1, 0, 1, 1, 3, 5), (1, 0, 1, 3, 4, 7), (1, 0, 1, 5, 6, 5), (2, 4, 5, 0, 1, 5), (2, 5, 6, 0, 3, 5)}
    assert made.schema["value"].dataType.simpleString() == "int"
    assert {tuple(r) for r in I.plane_runs(planes.filter("image_id = 2 AND x = 4").withColumn("span", F.lit(3))).collect()} == {(2, 4, 7, 0, 1, 5)}
    assert any("MapInArrow" in line for line in plan(made))


def test_label_lines_are_judged_once(spark):
    """Rows, slabs and rejects read one judged table; a polygon's ring and edges are named once."""
    images = spark.createDataFrame([(1, "1.png", 20, 10)], "image_id BIGINT, name STRING, width INT, height INT")
    classes = spark.createDataFrame([Row(class_id="c", name="c", ord=1, archived=False)])
    names = spark.createDataFrame([(0, "c", "c")], "class_index BIGINT, name STRING, stable_id STRING")
    made = {"box": "0 0 0 0.5 0 0.5 0.5 0 0.5", "closed": "0 0 0 0.5 0 0.5 0.5 0 0", "cross": "0 0 0 0.5 0.5 0.5 0 0 0.6", "twice": "0 0 0 0.5 0 0.5 0 0 0.5",
            "flat": "0 0 0 0.1 0.1 0.2 0.2", "short": "0 0 0 0.5 0.5", "out": "0 0 0 1.5 0 0.5 0.5", "class": "7 0 0 0.5 0 0.5 0.5"}
    lines = spark.createDataFrame([("1.txt", k, v) for k, v in made.items()], "_file STRING, _line STRING, value STRING")
    got = I.parse_yolo(lines, images, classes, names)
    for part in (got.annotations, got.slabs):
        assert not any("Join" in line for line in plan(part))
    assert got.annotations.count() == 2
    assert sorted((r.id.split(": ")[1], r.reason) for r in got.rejects.collect()) == sorted([
        (made["cross"], "edges_cross"), (made["twice"], "repeated_vertex"), (made["flat"], "no_area"), (made["short"], "bad_field_count"),
        (made["out"], "coordinate_not_normalized"), (made["class"], "class_not_in_map")])


def test_run_text_is_judged_in_whole_batches(spark):
    """Text is decoded, judged and cut in one place: no count passes through an expression of Spark's."""
    images = spark.createDataFrame([(1, "1.png", 3, 4), (2, "2.png", None, 4)], "image_id BIGINT, name STRING, width INT, height INT")
    classes = spark.createDataFrame([Row(class_id="c", name="c", ord=1, archived=False)])
    categories = spark.createDataFrame([(1, "c", "c")], "id BIGINT, name STRING, source_id STRING")
    pictures = spark.createDataFrame([(1, "1.png", 3, 4, "1"), (2, "2.png", None, None, "2")], "id BIGINT, file_name STRING, width INT, height INT, source_id STRING")
    seg = ['{"size":[4,3],"counts":"[1,2,9]"}', '{"size":[4,3],"counts":"[12]"}', '{"size":[4,3],"counts":"[1,2,8]"}', '{"size":[4,3],"counts":"[1,-2,13]"}', '{"size":[3,4],"counts":"[1,2,9]"}',
           '{"counts":"[1,2,9]"}', '{"size":[4,3]}', '{"size":[4,3],"counts":"[3,6,3]"}', "[]", "[[0,0,3,0,3,4,0,4]]", '{"size":[4,3],"counts":"[]"}']
    rows = spark.createDataFrame([(k, 1, 1, 0, None, [0.0, 0.0, 2.0, 2.0], s) for k, s in enumerate(seg)] + [(50, 2, 1, 0, None, None, seg[0])],
                                 "id BIGINT, image_id BIGINT, category_id BIGINT, iscrowd INT, area DOUBLE, bbox ARRAY<DOUBLE>, segmentation STRING")
    got = I.parse_coco(categories, pictures, rows, images, classes)
    assert not any("forall(" in line or "exists(counts" in line for line in plan(got.annotations))
    assert {(int(r.external_id), r.geom_type, r.x0, r.y0, r.x1, r.y1) for r in got.annotations.collect()} == {
        (0, "mask", 0, 1, 1, 3), (5, "mask", 0, 1, 1, 3), (7, "mask", 0, 0, 3, 4), (8, "box", 0, 0, 2, 2), (9, "polygon", 0, 0, 3, 4)}
    why = {int(r.id): r.reason for r in got.rejects.filter("kind = 'annotation'").collect()}
    assert why == {1: "empty_mask", **dict.fromkeys((2, 3, 4, 6, 10, 50), "bad_rle")}
    area = {r.annotation_id: r.n for r in got.slabs.groupBy("annotation_id").agg(F.sum(F.expr("(x1 - x0) * (y1 - y0)")).alias("n")).collect()}
    assert sorted(area.values()) == [2, 2, 6, 12]
