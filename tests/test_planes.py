"""The plane sweep against pixels, and crowded planes whose result stays near what is visible."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.functions import planes
from maskloom.operators import masks as M, windows as W


def scene(rng, count):
    x0, y0 = rng.integers(0, 20, count), rng.integers(0, 20, count)
    return rng.integers(0, 3, count), np.stack([x0, x0 + rng.integers(1, 15, count), y0, y0 + rng.integers(1, 15, count)], axis=1)


def drawn(made, values, empty):
    out = np.full((3, 40, 40), empty)
    for p, a, b, c, d, v in zip(made.plane, made.x0, made.x1, made.y0, made.y1, values):
        assert a < b and c < d and (out[p, a:b, c:d] == empty).all()
        out[p, a:b, c:d] = v
    return out


@pytest.mark.parametrize("strips", [5, 50, 4_000_000])
def test_sweep(monkeypatch, strips):
    monkeypatch.setattr(planes, "STRIPS", strips)  # small: a plane is worked in many ranges of strips
    rng = np.random.default_rng(strips)
    for _ in range(60):
        plane, slabs = scene(rng, rng.integers(1, 30))
        rank, side, most = rng.permutation(len(plane)), rng.integers(0, 2, len(plane)), int(rng.choice([1, 2, 100]))
        front, cover, sides = np.full((3, 40, 40), -1), np.zeros((3, 40, 40), int), np.zeros((2, 3, 40, 40), bool)
        for k in np.argsort(-rank):
            a, b, c, d = slabs[k]
            front[plane[k], a:b, c:d] = rank[k]
            cover[plane[k], a:b, c:d] += 1
            sides[side[k], plane[k], a:b, c:d] = True
        made = planes.sweep(plane, slabs, rank, most=most)
        assert (drawn(made, made.front, -1) == front).all() and (drawn(made, made.cover, 0) == np.minimum(cover, most)).all()
        made = planes.sweep(plane, slabs)
        assert (drawn(made, np.ones(len(made.x0)), 0) == (cover > 0)).all()
        for how, want in (("or", sides[0] | sides[1]), ("and", sides[0] & sides[1]), ("xor", sides[0] ^ sides[1]), ("minus", sides[0] & ~sides[1])):
            made = planes.sweep(plane, slabs, side=side, keep=M.COMBINE[how])
            assert (drawn(made, np.ones(len(made.x0)), 0) == want).all()


def test_crowded_plane(spark):
    """1 000 objects that all overlap: every pixel corner is a border, but few pieces are visible."""
    n = 1000
    df = spark.range(n).selectExpr("1L AS image_id", "id AS x0", f"id + {n} AS x1", "id AS y0", f"id + {n} AS y1", "id AS ord", "struct(id AS n) AS obj")
    painted = W.paint(df)
    got = {r["n"]: r["area"] for r in painted.groupBy("obj.n").agg(F.sum(F.expr("(x1 - x0) * (y1 - y0)")).alias("area")).collect()}
    assert got == {k: n * n if k == 0 else 2 * n - 1 for k in range(n)} and painted.count() < 6 * n
    union = M.mask_union(df.select("image_id", "x0", "x1", "y0", "y1"), "image_id")
    assert M.mask_stats(union, "image_id").first()["area"] == n * n + (n - 1) * (2 * n - 1) and union.count() < 6 * n
    deep = W.paint(df.filter("id < 30"), exact_cover=True)
    assert deep.agg(F.max("covering")).first()[0] == 30


def test_wide_image_in_blocks(spark):
    """Slabs across several blocks of columns; names decide the order; empty slabs give nothing."""
    rows = [(1, "b", 0, 3000, 0, 4), (1, "a", 500, 530, 1, 9), (1, "c", 511, 2000, 0, 9), (2, "z", 7, 7, 0, 5), (2, "y", 5, 6, 0, 5)]
    df = spark.createDataFrame(rows, "image_id BIGINT, annotation_id STRING, x0 BIGINT, x1 BIGINT, y0 BIGINT, y1 BIGINT").withColumn("ord", F.col("annotation_id")).withColumn("obj", F.struct("annotation_id"))
    for policy in ("first", "last"):
        plane = np.full((3, 9, 3000), "", dtype=object)
        for i, name, x0, x1, y0, y1 in sorted(rows, key=lambda r: r[1], reverse=policy == "first"):
            plane[i, y0:y1, x0:x1] = name
        got = np.full((3, 9, 3000), "", dtype=object)
        for r in W.paint(df, policy).collect():
            got[r["image_id"], r["y0"]:r["y1"], r["x0"]:r["x1"]] = r["obj"]["annotation_id"]
        assert (got == plane).all()
