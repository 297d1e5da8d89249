"""Every polygon of the polygon view against loops over pixels."""
import math

import __spark_entry__ as entry_module
from maskloom.plans.exchange_queries import SPARK_POLYGONS
from maskloom.plans.views import Views

DATA = "/root/testdata/sf0.001"


def toggled(points, h, w):
    """Area by the published rule: walk the edges on the fine grid, note crossings, toggle pixel by pixel."""
    fine, walk = [(int(5 * x + 0.5), int(5 * y + 0.5)) for x, y in points], []
    for (xs, ys), (xe, ye) in zip(fine, fine[1:] + fine[:1]):
        dx, dy = abs(xe - xs), abs(ye - ys)
        flip = xs > xe if dx >= dy else ys > ye
        if flip:
            xs, ys, xe, ye = xe, ye, xs, ys
        for d in range(max(dx, dy) + 1):
            t = max(dx, dy) - d if flip else d
            walk.append((t + xs, int(ys + (ye - ys) / max(dx, 1) * t + 0.5)) if dx >= dy else (int(xs + (xe - xs) / dy * t + 0.5), t + ys))
    marks = set()
    for (u0, v0), (u, v) in zip(walk, walk[1:]):
        x = ((u if u < u0 else u - 1) + 0.5) / 5 - 0.5
        if u != u0 and x == math.floor(x) and 0 <= x <= w - 1:
            marks ^= {int(x) * h + math.ceil(min(max((min(v, v0) + 0.5) / 5 - 0.5, 0), h))}
    on, area = False, 0
    for i in range(h * w):
        on ^= i in marks
        area += on
    return area


def centres(points, h, w):
    """Pixels whose centre is inside by the even-odd rule."""
    inside = 0
    for x in range(max(0, int(min(p[0] for p in points))), min(w, int(max(p[0] for p in points)) + 1)):
        for y in range(max(0, int(min(p[1] for p in points))), min(h, int(max(p[1] for p in points)) + 1)):
            cx, cy = x + 0.5, y + 0.5
            cut = [ay + (cx - ax) / (bx - ax) * (by - ay) > cy for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]) if (ax > cx) != (bx > cx)]
            inside += sum(cut) % 2
    return inside


def test_every_polygon_of_the_view(spark):
    got = {r.annotation_id: r.area for r in entry_module.queries()["mask_09_every_polygon"](spark, DATA).collect()}
    rows = Views(spark, DATA).sql(SPARK_POLYGONS).collect()
    assert len(rows) == len(got) and {r.p_key % 5 for r in rows} == set(range(5))
    seen = {}
    for r in rows:
        seen.setdefault(r.p_key % 5, [])
        if len(seen[r.p_key % 5]) < 3:
            points = [(p.x, p.y) for p in r.points]
            seen[r.p_key % 5].append(r.annotation_id)
            assert got[r.annotation_id] == toggled(points, r.height, r.width), (r.p_key % 5, points)
            wide = max(p[0] for p in points) - min(p[0] for p in points)
            assert abs(got[r.annotation_id] - centres(points, r.height, r.width)) <= 2 * wide + 2
    assert all(any(got[a] > 0 for a in seen[k]) for k in (0, 1, 3))


def test_raster_of_a_rectangle_is_one_slab(spark):
    """Columns alike side by side are one row; a bent outline keeps its pixels."""
    from maskloom.operators import vectors as V
    ring = lambda *p: [(float(x), float(y)) for x, y in p]
    rows = [("box", 300, 200, ring((10, 20), (250, 20), (250, 90), (10, 90))), ("bent", 300, 200, ring((0, 0), (60, 0), (60, 20), (20, 20), (20, 50), (0, 50)))]
    df = spark.createDataFrame(rows, "annotation_id STRING, width BIGINT, height BIGINT, points ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>")
    got = [tuple(r) for r in V.rasterize(df, "annotation_id").select("annotation_id", "x0", "x1", "y0", "y1").collect()]
    assert [g for g in got if g[0] == "box"] == [("box", 10, 250, 20, 90)]
    assert len(got) == 3
    assert {(x, y) for _, x0, x1, y0, y1 in got[:] if _ == "bent" for x in range(x0, x1) for y in range(y0, y1)} == \
        {(x, y) for x in range(60) for y in range(50) if x < 20 or y < 20}
