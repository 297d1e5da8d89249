"""Helpers for a single mask: one-mask forms of :mod:`shapes`, and the convex hull.

A mask is bounded by the image limit.
"""
from __future__ import annotations

import numpy as np

from . import shapes


def _one(slabs: np.ndarray) -> np.ndarray:
    return np.zeros(len(slabs), np.int64)


def topology(slabs: np.ndarray):
    """(4-connected components, holes). Holes are background parts that do not reach the outside."""
    components, holes = shapes.topology(_one(slabs), slabs, 1)
    return int(components[0]), int(holes[0])


def hole_slabs(slabs: np.ndarray) -> np.ndarray:
    return shapes.holes(_one(slabs), slabs)[1]


def component_slabs(slabs: np.ndarray) -> list[np.ndarray]:
    _, part, rows = shapes.components(_one(slabs), slabs)
    return [rows[part == k] for k in range(int(part.max()) + 1)]


def outline(slabs: np.ndarray) -> np.ndarray:
    """Pixel-edge ring of a mask with one component and no hole, without collinear points."""
    return shapes.outlines(_one(slabs), slabs)[1].astype(float)


def convex_hull(points: np.ndarray) -> np.ndarray:
    pts = np.unique(points, axis=0)

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts.tolist()) + half(pts[::-1].tolist()), float)


def corners(slabs: np.ndarray) -> np.ndarray:
    x0, x1, y0, y1 = slabs.T
    return np.concatenate([np.stack(p, axis=1) for p in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def polygon_intervals(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """Foreground [start, end) in column-major order, by the published COCO polygon rule."""
    return shapes.polygon_intervals(_one(points), np.asarray(points, float), np.array([height]), np.array([width]))[1]


def intervals_to_slabs(pairs: np.ndarray, height: int) -> np.ndarray:
    """One slab per touched pixel column of flat column-major intervals."""
    return shapes.intervals_to_slabs(_one(pairs), pairs, np.array([height]))[1]


def slabs_to_intervals(slabs: np.ndarray, height: int) -> np.ndarray:
    """Sorted flat column-major intervals of non-overlapping slabs."""
    return shapes.slabs_to_intervals(_one(slabs), slabs, np.array([height]))[1]


def shared_length(a: np.ndarray, b: np.ndarray) -> int:
    """Common length of two sorted, disjoint interval sets."""
    size = max(int(a.max()) if len(a) else 0, int(b.max()) if len(b) else 0)
    return int(shapes.shared_length(_one(a), a, _one(b), b, 1, size)[0])


def slab_area(slabs: np.ndarray) -> int:
    return int(((slabs[:, 1] - slabs[:, 0]) * (slabs[:, 3] - slabs[:, 2])).sum()) if len(slabs) else 0


def counts_to_text(counts) -> str:
    """Compressed run text of one list of counts."""
    return shapes.counts_to_text(np.asarray(counts, np.int64), np.array([0, len(counts)]))[0].tobytes().decode("ascii")


def text_to_counts(text: str, total: int):
    """Counts of a compressed run text, or None when it is malformed or exceeds ``total`` pixels."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts, _, valid = shapes.text_to_counts(raw, np.array([0, len(raw)]), np.array([total]))
    return counts.tolist() if valid[0] else None
