"""Files written and read back, images, planes, snapshots, streams and request conflicts."""
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from maskloom.operators import curation as C, masks as M
from maskloom.sinks import formats as O, publish as P, snapshots as SN
from maskloom.sources import formats as I, images as IM
from maskloom.streaming import jobs as ST

SLABS = "image_id BIGINT, annotation_id STRING, x0 BIGINT, x1 BIGINT, y0 BIGINT, y1 BIGINT"


@pytest.fixture(scope="module")
def scene(spark):
    classes = spark.createDataFrame([("c1", "leaf & <β>", 1, False), ("c2", "stem", 2, False), ("c3", "old", 3, True)], "class_id STRING, name STRING, ord BIGINT, archived BOOLEAN")
    images = spark.createDataFrame([(i, f"n{i}.png", 53, 44, r, True, f"g{i}", f"sha{i}", False, False, None, "human", 0) for i, r in
                                    ((1, "train"), (2, "validation"), (3, "test"), (4, "pool"))],
                                   "image_id BIGINT, name STRING, width BIGINT, height BIGINT, role STRING, complete BOOLEAN, group_id STRING, sha256 STRING, removed BOOLEAN, training_excluded BOOLEAN, missing STRING, review_actor STRING, revision BIGINT")
    # An L; a frame; a slim frame and a staircase beside it; a plain box.
    frame, slim = [(6, 12, 10, 34), (12, 20, 10, 16), (12, 20, 26, 34), (20, 30, 10, 34)], [(3, 8, 20, 40), (8, 14, 20, 24), (8, 14, 33, 40), (14, 19, 20, 40)]
    shapes = {("a", 1): [(4, 10, 5, 33), (10, 24, 25, 33)], ("b", 2): frame, ("c", 3): [*slim, (30, 34, 5, 9), (34, 38, 5, 13)], ("d", 1): [(28, 45, 3, 21)]}
    slabs = spark.createDataFrame([(i, a, *s) for (a, i), ss in shapes.items() for s in ss], SLABS)
    stats = M.mask_stats(slabs, "annotation_id").selectExpr("annotation_id", "bx0 AS x0", "by0 AS y0", "bx1 AS x1", "by1 AS y1", "area")
    base = spark.createDataFrame([(a, i, c, g, "accepted", 1, "human", False) for a, i, c, g in
                                  (("a", 1, "c1", "mask"), ("b", 2, "c2", "mask"), ("c", 3, "c1", "mask"), ("d", 1, "c2", "box"))],
                                 "annotation_id STRING, image_id BIGINT, class_id STRING, geom_type STRING, status STRING, revision BIGINT, review_actor STRING, training_excluded BOOLEAN")
    return dict(classes=classes, images=images, slabs=slabs, annotations=base.join(stats, "annotation_id").cache())


def pixels(slabs):
    cols = M.merge_columns(M.to_columns(slabs), "annotation_id").groupBy("annotation_id").agg(F.sum(F.expr("y1 - y0")).alias("n"), F.sum(F.expr("x * (y1 - y0)")).alias("m"))
    return sorted((r["n"], r["m"]) for r in cols.collect())


def test_coco(spark, scene, tmp_path):
    path = str(tmp_path / "coco")
    O.write_coco(scene["images"], scene["annotations"], scene["classes"], scene["slabs"], path)
    got = I.read_coco(spark, path, scene["images"], scene["classes"], sharded=True)
    assert got.rejects.count() == 0
    rows = {(r["image_id"], r["class_id"], r["geom_type"]) for r in got.annotations.collect()}
    assert rows == {(1, "c1", "mask"), (2, "c2", "mask"), (3, "c1", "mask"), (1, "c2", "box")}
    assert pixels(got.slabs) == pixels(scene["slabs"].filter("annotation_id <> 'd'"))
    with pytest.raises(Exception, match="already exists"):
        O.write_coco(scene["images"], scene["annotations"], scene["classes"], scene["slabs"], path)


def test_coco_document(spark, scene, tmp_path):
    plate = [7, 4, 27, 4, 27, 16, 7, 16]
    body = {"categories": [{"id": 1, "name": "leaf & <β>"}, {"id": 2, "name": "bark"}],
            "images": [{"id": 10, "file_name": "n1.png", "width": 53, "height": 44}, {"id": 11, "file_name": "../n2.png", "width": 53, "height": 44}],
            "annotations": [
                {"id": 1, "image_id": 10, "category_id": 1, "segmentation": [plate], "area": 240},
                {"id": 2, "image_id": 10, "category_id": 2, "segmentation": [plate, [30, 20, 40, 20, 40, 30, 30, 30]], "area": 1},
                {"id": 3, "image_id": 10, "category_id": 1, "segmentation": {"size": [44, 53], "counts": [9, 6, 2317]}},
                {"id": 4, "image_id": 10, "category_id": 1, "bbox": [2, 3, 5, 6]},
                {"id": 5, "image_id": 99, "category_id": 1, "bbox": [2, 3, 5, 6]},
                {"id": 6, "image_id": 10, "category_id": 1, "segmentation": {"size": [44, 53], "counts": [9, 6, 7]}},
                {"id": 7, "image_id": 10, "category_id": 1, "segmentation": [[0, 0, 5, 5, 5, 0, 0, 6]]},
                {"id": 8, "image_id": 10, "category_id": 1, "bbox": [30, 2, 30, 4]}]}
    (tmp_path / "a.json").write_text(json.dumps(body))
    got = I.read_coco(spark, str(tmp_path / "a.json"), scene["images"], scene["classes"])
    rows = {r["external_id"]: r for r in got.annotations.collect()}
    assert {k: r["geom_type"] for k, r in rows.items()} == {"1": "polygon", "2": "mask", "3": "mask", "4": "box"}
    assert rows["2"]["class_id"] not in ("c1", "c2") and len(rows["2"]["class_id"]) == 36
    assert {r["id"]: r["reason"] for r in got.rejects.collect() if r["kind"] == "annotation"} == {
        "5": "unknown_image", "6": "bad_rle", "7": "bad_polygon", "8": "bad_box"}
    assert [r["reason"] for r in got.losses.collect()] == ["area_recomputed_from_segmentation"] and got.losses.first()["lossy"] is False
    assert {r["annotation_id"]: r["area"] for r in M.mask_stats(got.slabs, "annotation_id").collect()}[rows["2"]["annotation_id"]] == 240 + 100


def test_yolo_seg(spark, scene, tmp_path):
    path = str(tmp_path / "yolo")
    strict = scene["annotations"].filter("geom_type <> 'box'")
    with pytest.raises(O.ExportBlocked) as caught:
        O.write_yolo(scene["images"], scene["annotations"], scene["classes"], scene["slabs"], path)
    assert {r["annotation_id"]: r["reason"] for r in caught.value.failures.collect()} == {"b": "topology_needs_consent", "c": "topology_needs_consent", "d": "box_only"}
    O.write_yolo(scene["images"], strict, scene["classes"], scene["slabs"], path, allow_lossy=True)
    got = I.read_yolo(spark, f"{path}/labels", scene["images"], scene["classes"], I.class_names(spark, f"{path}/class_map"))
    assert got.rejects.count() == 0
    areas = {r["image_id"]: r["area"] for r in M.mask_stats(got.slabs, "image_id", "annotation_id").collect()}
    assert areas[1] == 280 and areas[2] == 576 and areas[3] > 320 + 48
    files = spark.read.option("recursiveFileLookup", "true").text(f"{path}/labels").select("_metadata.file_path").distinct().collect()
    assert any("image_id=4" in r[0] for r in files)  # a negative has its own empty label


def test_yolo_box_and_rejects(spark, scene, tmp_path):
    path = str(tmp_path / "box")
    with pytest.raises(O.ExportBlocked):
        O.write_yolo(scene["images"], scene["annotations"], scene["classes"], scene["slabs"], path, kind="box")
    O.write_yolo(scene["images"], scene["annotations"], scene["classes"], scene["slabs"], path, kind="box", allow_lossy=True)
    names = I.class_names(spark, names=["leaf & <β>", "stem"])
    got = I.read_yolo(spark, f"{path}/labels", scene["images"], scene["classes"], names, kind="box")
    boxes = sorted(tuple(round(r[c], 6) for c in ("x0", "y0", "x1", "y1")) for r in got.annotations.collect())
    assert boxes == sorted([(4, 5, 24, 33), (6, 10, 30, 34), (3, 5, 38, 40), (28, 3, 45, 21)])
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "n1.txt").write_text("0 0.5 0.5 0.2\n9 .5 .5 .1 .1\n0 1.5 .5 .1 .1\n-1 .5 .5 .1 .1\n\n0 .5 .5 .1 .1\n")
    (tmp_path / "bad" / "zz.txt").write_text("0 .5 .5 .1 .1\n")
    got = I.read_yolo(spark, str(tmp_path / "bad"), scene["images"], scene["classes"], names, kind="box")
    assert got.annotations.count() == 1
    assert sorted(r["reason"] for r in got.rejects.collect()) == ["bad_class_index", "bad_field_count", "class_not_in_map", "coordinate_not_normalized", "missing", "missing"]


def test_class_names(spark, tmp_path):
    (tmp_path / "d.yaml").write_text("names: [a, b]\n")
    (tmp_path / "m.json").write_text(json.dumps({"classes": [{"index": 0, "name": "a"}, {"index": 1, "name": "x"}]}))
    assert [r["name"] for r in I.class_names(spark, yaml_path=str(tmp_path / "d.yaml")).collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="disagree"):
        I.class_names(spark, str(tmp_path / "m.json"), str(tmp_path / "d.yaml"))


def test_voc(spark, scene, tmp_path):
    path = str(tmp_path / "voc")
    with pytest.raises(O.ExportBlocked):
        O.write_voc(scene["images"], scene["annotations"], scene["classes"], path)
    O.write_voc(scene["images"], scene["annotations"], scene["classes"], path, allow_lossy=True)
    got = I.read_voc(spark, path, scene["images"], scene["classes"])
    boxes = sorted((r["image_id"], r["class_id"], r["x0"], r["y1"]) for r in got.annotations.collect())
    assert boxes == [(1, "c1", 4, 33), (1, "c2", 28, 21), (2, "c2", 6, 34), (3, "c1", 3, 40)]
    assert got.rejects.count() == 0
    # Flags survive export and import.
    flagged = scene["annotations"].withColumn("flags", F.expr("map('difficult', CAST(annotation_id = 'a' AS STRING), 'truncated', CAST(annotation_id = 'c' AS STRING))"))
    O.write_voc(scene["images"], flagged, scene["classes"], path + "-flags", allow_lossy=True)
    marks = {(r["image_id"], r["x0"]): r["flags"] for r in I.read_voc(spark, path + "-flags", scene["images"], scene["classes"]).annotations.collect()}
    assert marks[1, 4] == {"difficult": "true", "truncated": "false"} and marks[3, 3] == {"difficult": "false", "truncated": "true"}
    again = I.read_voc(spark, path, scene["images"], scene["classes"])
    assert {r["annotation_id"] for r in again.annotations.collect()} == {r["annotation_id"] for r in got.annotations.collect()}
    # One document per image: with a second one neither counts.
    for part in "xy":
        O.write_voc(scene["images"].filter("image_id < 3"), scene["annotations"].filter(f"image_id = {1 if part == 'x' else 2} OR image_id = 1"), scene["classes"], f"{path}2/{part}", allow_lossy=True)
    twice = I.read_voc(spark, path + "2", scene["images"], scene["classes"])
    assert twice.annotations.count() == 0 and {r["reason"] for r in twice.rejects.collect()} == {"several_files_for_one_image"}


def test_labelme(spark, scene, tmp_path):
    path = str(tmp_path / "lm")
    with pytest.raises(O.ExportBlocked):
        O.write_labelme(scene["images"], scene["annotations"], scene["classes"], scene["slabs"], path)
    O.write_labelme(scene["images"], scene["annotations"], scene["classes"], scene["slabs"], path, allow_lossy=True)
    got = I.read_labelme(spark, path, scene["images"], scene["classes"], lines=True)
    kinds = sorted((r["image_id"], r["geom_type"]) for r in got.annotations.collect())
    assert kinds == [(1, "box"), (1, "polygon"), (2, "polygon"), (3, "mask")] and got.rejects.count() == 0
    areas = {r["image_id"]: r["area"] for r in M.mask_stats(got.slabs, "image_id").collect()}
    assert areas == {1: 280, 2: 576, 3: 320 + 48}


def test_labelme_groups(spark, scene, tmp_path):
    tri = lambda x: [[x, 2], [x + 5, 2], [x + 5, 9]]
    shapes = [dict(label="stem", points=tri(1), group_id=7, shape_type="polygon", flags={"a": True}), dict(label="stem", points=tri(10), group_id=7, shape_type="polygon", flags={}),
              dict(label="stem", points=tri(20), group_id="7", shape_type="polygon", flags={}), dict(label="stem", points=[[3, 3]], shape_type="circle"),
              dict(label="stem", points=[[9, 9], [3, 3]], shape_type="rectangle", group_id=None)]
    (tmp_path / "n1.json").write_text(json.dumps({"imagePath": "n1.png", "imageWidth": 53, "imageHeight": 44, "shapes": shapes}))
    strict = I.read_labelme(spark, str(tmp_path), scene["images"], scene["classes"])
    assert [r["reason"] for r in strict.rejects.collect()] == ["unsupported_shape"]
    got = I.read_labelme(spark, str(tmp_path), scene["images"], scene["classes"], allow_lossy=True)
    assert sorted(r["geom_type"] for r in got.annotations.collect()) == ["box", "mask", "polygon"]
    assert sorted(r["reason"] for r in got.losses.collect()) == ["grouped_shapes_differ_in_flags", "unsupported_shape_skipped:circle"]


def test_authored_polygons_survive(spark, scene, tmp_path):
    """Import, export, import: vertices, crowd marks and flags stay what the author wrote."""
    kite = [6.5, 3.25, 30.0, 9.5, 20.25, 31.0, 4.0, 17.75]
    body = {"categories": [{"id": 4, "name": "stem"}], "images": [{"id": 9, "file_name": "n1.png", "width": 53, "height": 44}],
            "annotations": [{"id": 1, "image_id": 9, "category_id": 4, "segmentation": [kite], "iscrowd": 1}]}
    (tmp_path / "k.json").write_text(json.dumps(body))
    first = I.read_coco(spark, str(tmp_path / "k.json"), scene["images"], scene["classes"])
    rows, slabs = first.annotations.cache(), first.slabs.cache()
    corners = [(p["x"], p["y"]) for p in rows.first()["points"]]
    assert corners == list(zip(kite[::2], kite[1::2]))
    O.write_coco(scene["images"], rows, scene["classes"], slabs, str(tmp_path / "c"))
    back = I.read_coco(spark, str(tmp_path / "c"), scene["images"], scene["classes"], sharded=True).annotations.first()
    assert [(p["x"], p["y"]) for p in back["points"]] == corners and back["flags"] == {"iscrowd": "1"}
    yolo, failures = O.yolo_seg_rows(scene["images"], rows, scene["classes"], slabs)
    line = yolo.first()
    assert failures.count() == 0 and line["method"] == "authored_polygon" and len(line["coords"]) == 8
    O.write_labelme(scene["images"], rows.withColumn("flags", F.expr("map('occluded', 'true')")), scene["classes"], slabs, str(tmp_path / "l"))
    shape = I.read_labelme(spark, str(tmp_path / "l"), scene["images"], scene["classes"], lines=True).annotations.first()
    assert [(p["x"], p["y"]) for p in shape["points"]] == corners and shape["flags"] == {"occluded": "true"}


def png(rows):
    height, width = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(r) for r in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_and_planes(spark, tmp_path):
    plane = [[0] * 20 for _ in range(10)]
    for y in range(2, 6):
        for x in range(3, 9):
            plane[y][x] = 1
    plane[9][19] = 2
    (tmp_path / "p.png").write_bytes(png(plane))
    (tmp_path / "broken.png").write_bytes(b"not a picture")
    (tmp_path / "notes.txt").write_text("hello")
    images, rejects = IM.image_manifest(spark, str(tmp_path))
    assert [(r["name"], r["width"], r["height"], r["role"]) for r in images.collect()] == [("p.png", 20, 10, "pool")]
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in rejects.collect()} == {"broken.png": "undecodable", "notes.txt": "unsupported_format"}

    tiles = IM.tile_pixels(IM.pixel_images(spark, str(tmp_path / "p.png")), size=16).orderBy("tile_idx").collect()
    assert [(r["x0"], r["valid_w"], r["valid_h"]) for r in tiles] == [(0, 16, 10), (4, 16, 10)]
    last = tiles[1]["data"]
    assert last[-1] == 2 and last[9 * 16 + 15] == 2 and last[3 * 16] == 1

    columns = IM.plane_columns(spark, str(tmp_path / "p.png")).withColumn("image_id", F.lit(1).cast("bigint"))
    mapping = spark.createDataFrame([(1, 1, "c", "a"), (1, 2, "c", "b"), (1, 5, "c", "z")], "image_id BIGINT, value INT, class_id STRING, annotation_id STRING")
    slabs, losses, bad = I.read_planes(columns, mapping)
    assert {r["annotation_id"]: r["area"] for r in M.mask_stats(slabs, "annotation_id").collect()} == {"a": 24, "b": 1}
    assert [r["annotation_id"] for r in losses.collect()] == ["z"] and bad.count() == 0
    assert [r["reason"] for r in I.read_planes(columns, mapping.filter("value <> 2"))[2].collect()] == ["unmapped_value"]


def tags(order, *entries):
    """A directory of (code, type, value) at the head of a file."""
    body = struct.pack(order + "H", len(entries))
    for code, kind, value in entries:
        body += struct.pack(order + "HHI", code, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + body + struct.pack(order + "I", 0)


def segment(marker, body):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body


def test_image_headers(spark, tmp_path):
    frame = segment(0xC2, struct.pack(">BHHB", 8, 40, 70, 3) + bytes(9))
    scan = segment(0xDA, bytes(10)) + b"\1\2\xff\0\xff\xd9"
    thumb = b"\xff\xd8" + segment(0xC0, struct.pack(">BHHB", 8, 5, 6, 3) + bytes(9)) + b"\xff\xd9"
    riff = lambda body: b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body
    chunk = lambda kind, data: kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    turned = tags("<", (274, 3, 6))
    picture = lambda depth, *more: (b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in (
        (b"IHDR", struct.pack(">IIBBBBB", 70, 40, depth, 2, 0, 0, 0)), *more, (b"IDAT", b"eXIf"), (b"IEND", b""))))
    files = {
        # The frame lies behind 40 segments of full length, and the thumbnail of the EXIF block is not taken for it.
        "far.jpg": b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + tags(">", (271, 4, 99), (274, 3, 8)) + thumb) + b"\xff" + segment(0xFE, bytes(65_000)) * 40 + frame + scan,
        "plain.jpg": b"\xff\xd8" + segment(0xE0, b"JFIF\0") + frame + scan,
        "cut.jpg": b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + turned + thumb) + frame + scan[:-2],
        "nothing.jpg": b"\xff\xd8" + scan, "short.jpg": b"\xff\xd8\xff\xc0\0", "lying.jpg": b"\xff\xd8\xff\xe1\xff\xff",
        "turn.png": picture(8, (b"eXIf", turned)), "deep.png": picture(16), "moving.png": picture(8, (b"acTL", bytes(8))), "cut.png": picture(8)[:-4],
        "old.bmp": b"BM" + bytes(8) + struct.pack("<IIHHHH", 26, 12, 70, 40, 1, 24) + bytes(8),
        "top.bmp": b"BM" + bytes(8) + struct.pack("<IIiiHH", 54, 40, 70, -40, 1, 24) + bytes(40),
        "lossy.webp": riff(chunk(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 70 | 1 << 14, 40) + bytes(3))),
        "lossless.webp": riff(chunk(b"VP8L", b"\x2f" + struct.pack("<I", 69 | 39 << 14) + bytes(8))),
        "turn.webp": riff(chunk(b"VP8X", b"\x08\0\0\0\x45\0\0\x27\0\0") + chunk(b"VP8 ", bytes(11)) + chunk(b"EXIF", b"Exif\0\0" + turned)),
        "moving.webp": riff(chunk(b"VP8X", b"\x02\0\0\0\x45\0\0\x27\0\0")),
        "little.tif": tags("<", (256, 3, 70), (257, 4, 40), (258, 3, 8), (274, 3, 5)), "big.tif": tags(">", (256, 4, 70), (257, 3, 40)),
        "deep.tif": tags(">", (256, 4, 70), (257, 3, 40), (258, 3, 16)), "pages.tif": tags("<", (256, 3, 70), (257, 4, 40))[:-4] + b"\x08\0\0\0",
        "none.tif": b"II*\0\xff\xff\xff\xff", "blank.png": b"\n", "anim.gif": b"GIF89a" + bytes(20), "huge.tif": tags("<", (256, 4, 70_000), (257, 4, 40_000)),
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    with open(tmp_path / "large.png", "wb") as f:
        f.truncate((1 << 31) + 10)
    images, rejects = IM.image_manifest(spark, str(tmp_path))
    assert {r["name"]: (r["width"], r["height"], r["orientation"]) for r in images.collect()} == {
        "far.jpg": (40, 70, 8), "plain.jpg": (70, 40, 1), "turn.png": (40, 70, 6), "old.bmp": (70, 40, 1), "top.bmp": (70, 40, 1), "lossy.webp": (70, 40, 1),
        "lossless.webp": (70, 40, 1), "turn.webp": (40, 70, 6), "little.tif": (40, 70, 5), "big.tif": (70, 40, 1)}
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in rejects.collect()} == {
        "cut.jpg": "undecodable", "nothing.jpg": "undecodable", "short.jpg": "undecodable", "lying.jpg": "undecodable", "deep.png": "high_bit_depth",
        "moving.png": "several_pictures", "cut.png": "undecodable", "moving.webp": "several_pictures", "deep.tif": "high_bit_depth", "pages.tif": "several_pictures",
        "none.tif": "undecodable", "blank.png": "undecodable", "anim.gif": "unsupported_format", "huge.tif": "too_many_pixels", "large.png": "file_too_large"}


def test_packed_yolo(spark, scene, tmp_path):
    """Packed labels read back like the folder form, in few files; text files with a line per object."""
    one, many = str(tmp_path / "packed"), str(tmp_path / "folders")
    O.write_yolo_packed(scene["images"], scene["annotations"], scene["classes"], scene["slabs"], one, kind="box", allow_lossy=True, files=2)
    O.write_yolo(scene["images"], scene["annotations"], scene["classes"], scene["slabs"], many, kind="box", allow_lossy=True)
    assert len(list((tmp_path / "packed").glob("attempt-*/labels/part-*.json"))) <= 2
    shape = lambda read: sorted(tuple(r) for r in read.annotations.select("image_id", "class_id", *[F.round(c, 6) for c in ("x0", "y0", "x1", "y1")]).collect())
    packed = I.read_yolo_packed(spark, one, scene["images"], scene["classes"], "box")
    folders = I.read_yolo(spark, f"{many}/labels", scene["images"], scene["classes"], I.class_names(spark, f"{many}/class_map"), kind="box")
    assert shape(packed) == shape(folders) and len(shape(packed)) == scene["annotations"].count() and packed.rejects.count() == 0
    labels = P.published(spark, one, "labels", form="json")
    assert labels.count() == scene["images"].count()


def test_publication_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.range(3)
    bad = good.select(F.raise_error(F.lit("midway")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="midway"):
        P.publish({"a": good, "b": bad}, path)
    with pytest.raises(ValueError, match="nothing is published"):
        P.published(spark, path, "a")
    P.publish({"a": good, "b": good}, path)
    assert P.published(spark, path, "b").count() == 3
    with pytest.raises(ValueError, match="published already"):
        P.publish({"a": good}, path)
    with pytest.raises(ValueError, match="no table c"):
        P.published(spark, path, "c")


def test_bundle_is_all_or_nothing(spark, scene, tmp_path):
    path = str(tmp_path / "bundle")
    given = (scene["images"], scene["annotations"], scene["classes"], scene["slabs"])
    losses = spark.createDataFrame([("a", True, "box_of_a_mask")], "annotation_id STRING, lossy BOOLEAN, reason STRING")
    with pytest.raises(O.ExportBlocked):  # COCO is whole when VOC refuses the masks
        O.write_bundle(*given, path, ("coco", "voc"))
    with pytest.raises(ValueError, match="nothing is published"):
        P.published_folder(spark, path, "coco")
    with pytest.raises(ValueError, match="no writer for tiff"):
        O.write_bundle(*given, path, ("coco", "tiff"))
    manifest = {"loss_report": losses, "broken": losses.selectExpr("CASE WHEN lossy THEN raise_error('lost') ELSE '' END AS x")}
    with pytest.raises(Exception, match="lost"):
        O.write_bundle(*given, path, ("coco",), manifest=manifest)
    O.write_bundle(*given, path, ("coco", "yolo_box", "voc", "labelme"), True, {"loss_report": losses})
    folder = lambda name: P.published_folder(spark, path, name)
    reads = [I.read_coco(spark, folder("coco"), *given[:1], given[2], sharded=True), I.read_yolo_packed(spark, folder("yolo_box"), given[0], given[2], "box"),
             I.read_voc(spark, folder("voc"), given[0], given[2]), I.read_labelme(spark, folder("labelme"), given[0], given[2], lines=True)]
    for read in reads:
        assert sorted(r["image_id"] for r in read.annotations.collect()) == [1, 1, 2, 3] and read.rejects.count() == 0
    assert spark.read.json(folder("manifest") + "/loss_report").first()["reason"] == "box_of_a_mask"
    with pytest.raises(ValueError, match="published already"):
        O.write_bundle(*given, path, ("coco",))


def test_dedup(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")], "path STRING, sha256 STRING")
    known = spark.createDataFrame([("2", False), ("3", True)], "sha256 STRING, removed BOOLEAN")
    imported, duplicates = IM.dedup_by_hash(new, known)
    assert sorted(r["path"] for r in imported.collect()) == ["a", "d"] and sorted(r["path"] for r in duplicates.collect()) == ["b", "c"]


def test_plane_policies(spark, scene):
    rows = spark.createDataFrame([("o0", 1, "c1"), ("o1", 1, "c1")], "annotation_id STRING, image_id BIGINT, class_id STRING")
    slabs = spark.createDataFrame([(1, a, 5, 14, 3, 20) for a in ("o0", "o1")], SLABS)
    with pytest.raises(O.ExportBlocked):
        O.label_plane(rows, scene["classes"], slabs, "instance_id", "error")
    for policy, hidden in (("first", "o1"), ("last", "o0")):
        _, losses = O.label_plane(rows, scene["classes"], slabs, "instance_id", policy)
        assert [(r["annotation_id"], r["removed_pixels"]) for r in losses.collect()] == [(hidden, 153)]
    with pytest.raises(O.ExportBlocked) as caught:  # two instances of a class in one value
        O.label_plane(rows, scene["classes"], slabs, "semantic", "last")
    assert [r["reason"] for r in caught.value.failures.collect()] == ["merging_instances_needs_consent"]
    with pytest.raises(O.ExportBlocked) as caught:
        O.label_plane(rows, scene["classes"], slabs.filter("annotation_id = 'o0'"), "instance_id", "last")
    assert [(r["annotation_id"], r["reason"]) for r in caught.value.failures.collect()] == [("o1", "no_foreground")]
    _, losses = O.label_plane(rows, scene["classes"], slabs, "semantic", "last", allow_lossy=True)
    assert [r["reason"] for r in losses.collect()] == ["instances_merged:2"]


def test_snapshot(spark, scene, tmp_path):
    path = str(tmp_path / "snap")
    rows = scene["annotations"].filter("geom_type = 'mask'")
    with pytest.raises(ValueError, match="not ready"):  # b is a frame: its tile needs consent
        SN.build_snapshot(scene["images"], rows, scene["classes"], scene["slabs"], str(tmp_path / "strict"))
    receipt = SN.build_snapshot(scene["images"], rows, scene["classes"], scene["slabs"], path, allow_lossy=True)
    assert {r["table"] for r in receipt.collect()} == {"images", "versions", "labels", "tiles", "classes"}
    SN.seal_snapshot(spark, path)
    got = SN.read_snapshot(spark, path, "p2")
    assert {r["annotation_id"] for r in got["versions"].collect()} == {"a", "b"}
    victim = next((tmp_path / "snap" / "versions").glob("*.parquet"))
    (victim.parent / "part-99999-extra.snappy.parquet").write_bytes(victim.read_bytes())
    with pytest.raises(ValueError, match="changed"):
        SN.read_snapshot(spark, path, "p3")
    with pytest.raises(ValueError, match="not ready"):
        SN.build_snapshot(scene["images"].filter("role <> 'validation'"), rows, scene["classes"], scene["slabs"], str(tmp_path / "no"))


def test_stream_batches_and_replay(spark, tmp_path):
    schema = "image_id BIGINT, layer_id BIGINT, tile_idx BIGINT, candidate BIGINT, annotation_id STRING, signature STRING"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    tombs = spark.createDataFrame([(1, 0, "gone")], "image_id BIGINT, layer_id BIGINT, signature STRING")

    def feed(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        ST.ingest_tile_results(spark.readStream.schema(schema).parquet(source), tombs, out, state)
        return sorted(r["annotation_id"] for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/proposals").collect())

    assert feed([(1, 0, 0, 0, "a", "s1"), (1, 0, 0, 1, "b", "gone"), (1, 0, 0, 0, "a", "s1")]) == ["a"]
    assert feed([(1, 0, 1, 0, "c", "s1"), (1, 0, 1, 1, "d", "s2"), (1, 0, 0, 0, "a", "s1"), (1, 1, 0, 0, "e", "gone")]) == ["a", "d", "e"]


def test_stream_never_reads_its_store(spark, tmp_path):
    """Origins and proposals of several batches: a mask keeps its proposal although the store is gone."""
    schema = "image_id BIGINT, layer_id BIGINT, tile_idx BIGINT, candidate BIGINT, annotation_id STRING, signature STRING"
    tombs = spark.createDataFrame([], "image_id BIGINT, layer_id BIGINT, signature STRING")
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    found = []
    for k, rows in enumerate([[(1, 0, 0, 0, "a", "s")], [(1, 0, 1, 0, "b", "s"), (1, 0, 0, 0, "a", "s")], [(2, 0, 0, 0, "c", "s"), (1, 0, 1, 0, "b", "s"), (1, 0, 2, 5, "d", "t")]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        out = str(tmp_path / f"out{k}")  # a fresh folder: only state can know what came before
        ST.ingest_tile_results(spark.readStream.schema(schema).parquet(source), tombs, out, state)
        read = lambda name: sorted(r["annotation_id"] for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/{name}").collect())
        found.append((read("proposals"), read("origins")))
    assert found == [(["a"], ["a"]), ([], ["b"]), (["c", "d"], ["c", "d"])]


def test_edits_over_batches_and_restart(spark, tmp_path):
    schema = "image_id BIGINT, seq BIGINT, expected_revision BIGINT"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in ([(1, 2, 1), (1, 1, 0), (2, 1, 5)], [(1, 3, 1), (1, 4, 2), (2, 2, 0)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        ST.run_to_folder(ST.apply_edit_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).repartition(1)), out, state)
    got = {(r["image_id"], r["seq"]): (r["applied"], r["revision"]) for r in spark.read.option("recursiveFileLookup", "true").parquet(out).collect()}
    assert got[1, 4] == (True, 3) or got[1, 2][0] is False  # files of one write may come as batches of their own
    assert got[2, 1] == (False, 0) and got[2, 2] == (True, 1) and len(got) == 6


def test_late_actions(spark, tmp_path):
    """Append mode: a window is published once the watermark passes it, and rows behind the watermark are dropped."""
    from datetime import datetime
    schema = "created_at TIMESTAMP, action STRING"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    for rows in ([(at(8, 5), "edit"), (at(8, 50), "edit"), (at(9, 10), "undo")], [(at(14), "edit")], [(at(8, 30), "edit"), (at(20), "edit")], [(at(23), "edit")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ST.run_to_folder(ST.action_windows(spark.readStream.schema(schema).parquet(source)), out, state)
    got = sorted((r["window_start"].hour, r["action"], r["n"]) for r in spark.read.option("recursiveFileLookup", "true").parquet(out).collect())
    assert got == [(8, "edit", 2), (9, "undo", 1), (14, "edit", 1), (20, "edit", 1)]


def test_first_request_of_an_image_wins(spark):
    cols = "annotation_id STRING, image_id BIGINT, class_id STRING, status STRING, revision BIGINT, review_actor STRING, geom_type STRING, source_kind STRING, operation STRING, layer_id BIGINT, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT, generation_signature STRING"
    ann = spark.createDataFrame([("a", 1, "c1", "draft", 4, None, "mask", "manual", None, None, 0, 0, 2, 2, None), ("b", 1, "c1", "draft", 4, None, "mask", "manual", None, 3, 0, 0, 3, 3, "made")], cols)
    img = spark.createDataFrame([(1, False, True, "human", 2)], "image_id BIGINT, removed BOOLEAN, complete BOOLEAN, review_actor STRING, revision BIGINT")
    cls = spark.createDataFrame([("c1", False)], "class_id STRING, archived BOOLEAN")
    req = spark.createDataFrame([(1, 1, "a", 3, "accept", None, True, "human"), (2, 1, "a", 4, "accept", None, True, "human"), (3, 1, "b", 4, "delete", None, True, "human")],
                                "request_id BIGINT, image_id BIGINT, annotation_id STRING, expected_revision BIGINT, action STRING, class_id STRING, confirm BOOLEAN, actor STRING")
    out = C.apply_selection(ann, img, cls, req)
    assert {r["request_id"]: r["reason"] for r in out.conflicts.collect()} == {1: "stale_revision", 3: "image_changed"}
    assert {r["annotation_id"]: (r["status"], r["revision"]) for r in out.annotations.collect()} == {"a": ("accepted", 5), "b": ("draft", 4)}
    assert not out.images.first()["complete"] and out.tombstones.count() == 0
    only = C.apply_selection(ann, img, cls, req.filter("request_id = 3"))
    assert [(r["reason"], r["signature"]) for r in only.tombstones.collect()] == [("deleted", "made")] and only.annotations.count() == 1
    # Without a stored signature the pixels decide, never the bounds; without pixels the job stops.
    bare = ann.drop("generation_signature")
    drawn = spark.createDataFrame([("b", 0, 1, 0, 3, 9, 8), ("b", 1, 3, 2, 3, 9, 8)], "annotation_id STRING, x0 BIGINT, x1 BIGINT, y0 BIGINT, y1 BIGINT, width BIGINT, height BIGINT")
    made = C.apply_selection(bare, img, cls, req.filter("request_id = 3"), drawn).tombstones.first()["signature"]
    assert made == M.mask_signatures(drawn, "annotation_id").first()["signature"] != M.mask_signatures(drawn.limit(1).withColumn("x1", F.lit(3).cast("bigint")), "annotation_id").first()["signature"]
    with pytest.raises(Exception, match="needs generation_signature or slabs"):
        C.apply_selection(bare, img, cls, req.filter("request_id = 3")).tombstones.collect()


def test_stream_of_a_folder_and_of_a_file(spark, tmp_path):
    """A table may be one file or a folder of files: both stream."""
    from types import SimpleNamespace

    from maskloom.plans import exchange_queries as X
    spark.range(7).selectExpr("id AS doc_id").repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    whole = tmp_path / "whole"
    spark.range(5).selectExpr("id AS doc_id").coalesce(1).write.parquet(str(whole))
    next(whole.glob("*.parquet")).rename(tmp_path / "one.parquet")
    for name, rows in (("many", 7), ("one", 5)):
        got = ST.run_to_folder(X._stream(SimpleNamespace(spark=spark, sf_dir=str(tmp_path)), name), str(tmp_path / f"out-{name}"), str(tmp_path / f"state-{name}"))
        assert got.count() == rows


def test_stream_state_without_python_groups(spark, tmp_path, monkeypatch):
    """Proposals are judged by a built-in aggregate; the least annotation of the first batch proposes, a null last."""
    schema = "image_id BIGINT, layer_id BIGINT, tile_idx BIGINT, candidate BIGINT, annotation_id STRING, signature STRING"
    tombs = spark.createDataFrame([], "image_id BIGINT, layer_id BIGINT, signature STRING")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    plans, run = [], ST._run
    monkeypatch.setattr(ST, "_run", lambda stream, *rest: (plans.append(stream._jdf.queryExecution().logical().toString()), run(stream, *rest))[1])
    rows = [[(1, 0, 0, 0, "b", "s"), (1, 0, 1, 0, "a", "s"), (1, 0, 2, 0, None, "s"), (None, 0, None, None, "n", None)], [(1, 0, 3, 0, "A", "s"), (None, 0, None, None, "n", None)]]
    for batch in rows:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        ST.ingest_tile_results(spark.readStream.schema(schema).parquet(source), tombs, out, state)
    read = lambda name: spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/{name}").collect()
    assert sorted((r["annotation_id"], r["image_id"]) for r in read("proposals")) == [("a", 1), ("n", None)]
    assert sorted(str(r["annotation_id"]) for r in read("origins")) == ["A", "None", "a", "b", "n"]
    assert not any("FlatMapGroupsInPandas" in p for p in plans)
