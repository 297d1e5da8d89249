"""Planes of overlapping slabs, many at once: union, pixel combination and painter's order (numpy, no loop per slab).

A sweep over x keeps one strip for every stretch between x borders of a plane. Inside a strip, y borders cut
elementary segments; a segment's coverage is a running sum of starts and ends, and its front object the minimum
that intervals push down a table of doubling blocks. Equal neighbours in y, then in x, grow together again, so the
result follows the visible pieces and not the number of borders.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .shapes import LOW, spans

STRIPS = 4_000_000  # (slab, strip) entries held at once; strips are independent, so a crowded plane is worked in ranges
NONE = np.iinfo(np.int64).max


class Pieces(NamedTuple):
    plane: np.ndarray
    x0: np.ndarray
    x1: np.ndarray
    y0: np.ndarray
    y1: np.ndarray
    front: np.ndarray
    cover: np.ndarray


def _front(first: np.ndarray, stop: np.ndarray, rank: np.ndarray, count: int) -> np.ndarray:
    """Smallest rank over each of ``count`` segments, from intervals of segments [first, stop)."""
    length = stop - first
    level = np.frexp(length.astype(float))[1] - 1  # floor of the binary logarithm
    out = np.full(count, NONE)
    for k in range(int(level.max()) if len(level) else 0, -1, -1):
        half = 1 << k
        if half < count:
            pushed = out.copy()
            np.minimum(pushed[half:], out[:-half], out=pushed[half:])
            out = pushed
        here = np.flatnonzero(level == k)
        np.minimum.at(out, first[here], rank[here])
        np.minimum.at(out, stop[here] - half, rank[here])
    return out


def _strip_runs(strip, y0, y1, rank, sides, keep, most):
    """Visible runs of some strips: strip, y0, y1, front, cover; neighbours alike are one run."""
    high = int(y1.max()) + 1
    begin, end = strip * high + y0, strip * high + y1
    points = np.unique(np.concatenate([begin, end]))
    first, stop = np.searchsorted(points, begin), np.searchsorted(points, end)
    n = len(points)
    count = [np.cumsum(np.bincount(first[s], minlength=n) - np.bincount(stop[s], minlength=n)) for s in sides]
    shown = np.flatnonzero(keep(*count))
    if not len(shown):
        return (shown,) * 5
    front = np.zeros(n, np.int64) if rank is None else _front(first, stop, rank, n)
    cover = np.minimum(count[0], most) if len(count) == 1 else np.zeros(n, np.int64)
    here, place = points[shown] // high, points[shown] % high
    fresh = np.ones(len(shown), bool)
    fresh[1:] = (shown[1:] != shown[:-1] + 1) | (here[1:] != here[:-1]) | (front[shown[1:]] != front[shown[:-1]]) | (cover[shown[1:]] != cover[shown[:-1]])
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(shown)) - 1
    lower = points[shown[tail] + 1] - here[tail] * high
    return here[head], place[head], lower, front[shown[head]], cover[shown[head]]


def sweep(plane: np.ndarray, slabs: np.ndarray, rank: np.ndarray | None = None, side: np.ndarray | None = None, keep=None, most: int = 1) -> Pieces:
    """Disjoint pieces of every plane.

    ``rank``: of overlapping slabs the one of the smallest rank is in front (pieces are cut where it changes).
    ``side``: 0 or 1 per slab; ``keep(n0, n1)`` then says which coverage is shown (without: any). ``most``: coverage is
    told apart up to this count.
    """
    base = np.asarray(plane, np.int64) << 32
    left, right = base | slabs[:, 0], base | slabs[:, 1]
    cuts = np.unique(np.concatenate([left, right]))
    first, stop = np.searchsorted(cuts, left), np.searchsorted(cuts, right)
    held = np.cumsum(np.cumsum(np.bincount(first, minlength=len(cuts)) - np.bincount(stop, minlength=len(cuts))))
    found, at = [], 0
    while at < len(cuts):
        until = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + STRIPS, "right")))
        a, b = np.maximum(first, at), np.minimum(stop, until)
        slab, strip = spans(a, np.maximum(b - a, 0))
        if len(slab):
            if side is None:
                sides, shown = [slice(None)], keep or (lambda n: n > 0)
            else:
                of = side[slab]
                sides, shown = [np.flatnonzero(of == 0), np.flatnonzero(of == 1)], keep
            found.append(_strip_runs(strip, slabs[slab, 2], slabs[slab, 3], None if rank is None else rank[slab], sides, shown, most))
        at = until
    strip, y0, y1, front, cover = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else [()] * 5))
    order = np.lexsort((strip, cover, front, y1, y0))
    strip, y0, y1, front, cover = strip[order], y0[order], y1[order], front[order], cover[order]
    fresh = np.ones(len(strip), bool)
    fresh[1:] = (strip[1:] != strip[:-1] + 1) | (y0[1:] != y0[:-1]) | (y1[1:] != y1[:-1]) | (front[1:] != front[:-1]) | (cover[1:] != cover[:-1])
    head = np.flatnonzero(fresh)
    if not len(head):
        return Pieces(*(head,) * 7)
    last = strip[np.append(head[1:], len(strip)) - 1]
    strip = strip[head]
    return Pieces(cuts[strip] >> 32, cuts[strip] & LOW, cuts[last + 1] & LOW, y0[head], y1[head], front[head], cover[head])
