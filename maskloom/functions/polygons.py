"""Polygon expressions over ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>> columns."""
from __future__ import annotations


def _once(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once, however often it is named."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def edges(points: str) -> str:
    return (f"transform(zip_with({points}, concat(slice({points}, 2, size({points})), slice({points}, 1, 1)), "
            "(a, b) -> struct(a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by)), (e, i) -> struct(e.ax AS ax, e.ay AS ay, e.bx AS bx, e.by AS by, i AS i))")


def doubled_area(points: str) -> str:
    """Signed doubled shoelace area."""
    return f"aggregate({edges(points)}, 0.0D, (s, e) -> s + e.ax * e.by - e.bx * e.ay)"


def _turn(p: str, q: str, r: str) -> str:
    (px, py), (qx, qy), (rx, ry) = p.split(), q.split(), r.split()
    return f"(({qx} - {px}) * ({ry} - {py}) - ({qy} - {py}) * ({rx} - {px}))"


def edges_cross(points: str) -> str:
    """Any two non-adjacent edges properly cross."""
    a, b, c, d = "f.ax f.ay", "f.bx f.by", "g.ax g.ay", "g.bx g.by"
    proper = f"{_turn(a, b, c)} * {_turn(a, b, d)} < 0 AND {_turn(c, d, a)} * {_turn(c, d, b)} < 0"
    return _once("_edges", edges(points), f"exists(_edges, f -> exists(_edges, g -> g.i >= f.i + 2 AND NOT (f.i = 0 AND g.i = size({points}) - 1) AND {proper}))")


def contains(points: str, px: str, py: str) -> str:
    """Even-odd containment."""
    return (f"aggregate({edges(points)}, false, (odd, e) -> odd <> ((e.ay > {py}) <> (e.by > {py}) AND "
            f"{px} < (e.bx - e.ax) * ({py} - e.ay) / nullif(e.by - e.ay, 0) + e.ax))")


def issue(points: str) -> str:
    finite = f"exists({points}, p -> p.x IS NULL OR p.y IS NULL OR isnan(p.x) OR isnan(p.y) OR abs(p.x) = double('Infinity') OR abs(p.y) = double('Infinity'))"
    return (f"CASE WHEN coalesce(size({points}), 0) < 3 THEN 'too_few_vertices' WHEN {finite} THEN 'not_finite' "
            f"WHEN abs({doubled_area(points)}) < 0.01 THEN 'no_area' WHEN {edges_cross(points)} THEN 'edges_cross' END")


def strict_issue(points: str, width: str, height: str) -> str:
    """Import rule: also no vertex outside the image and no repeated vertex (a closing one is allowed)."""
    ring = f"CASE WHEN size({points}) > 1 AND get({points}, 0) = get({points}, size({points}) - 1) THEN slice({points}, 1, size({points}) - 1) ELSE {points} END"
    outside = f"exists({points}, p -> NOT (p.x BETWEEN 0 AND {width} AND p.y BETWEEN 0 AND {height}))"
    return _once("_ring", ring, f"CASE WHEN coalesce(size(_ring), 0) < 3 THEN 'too_few_vertices' WHEN {outside} THEN 'outside_image' "
                                f"WHEN size(array_distinct(_ring)) < size(_ring) THEN 'repeated_vertex' ELSE {issue('_ring')} END")


def bbox_columns(points: str) -> list[str]:
    """min/max of the vertices as x0, x1, y0, y1."""
    return [f"array_{f}(transform({points}, p -> p.{axis})) AS {axis}{n}" for axis in "xy" for f, n in (("min", 0), ("max", 1))]
