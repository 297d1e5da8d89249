"""Topology, outlines, polygon rasters and run text of many masks at once (numpy, no loop per mask, run or edge).

Slabs are rows (x0, x1, y0, y1) beside the number of their mask; the slabs of a mask do not overlap.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np

LOW = (1 << 32) - 1


def spans(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first, first + 1, ... of given lengths: the range and the value of every entry."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, first[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]


class Runs(NamedTuple):
    """Vertical runs of all masks, cut at the x borders of their mask, touching ones merged; sorted by strip and y.

    Strip s lies between ``cuts[s]`` and ``cuts[s + 1]``; a cut is mask << 32 | x. The last cut of a mask opens no strip.
    """
    cuts: np.ndarray
    strip: np.ndarray
    y0: np.ndarray
    y1: np.ndarray

    @property
    def mask(self) -> np.ndarray:
        return self.cuts[self.strip] >> 32

    def slabs(self, rows=slice(None)) -> np.ndarray:
        s = self.strip[rows]
        return np.stack([self.cuts[s] & LOW, self.cuts[s + 1] & LOW, self.y0[rows], self.y1[rows]], axis=1)


def strips(mask: np.ndarray, slabs: np.ndarray) -> Runs:
    base = np.asarray(mask, np.int64) << 32
    left, right = base | slabs[:, 0], base | slabs[:, 1]
    cuts = np.unique(np.concatenate([left, right]))
    first = np.searchsorted(cuts, left)
    owner, strip = spans(first, np.searchsorted(cuts, right) - first)
    y0, y1 = slabs[owner, 2], slabs[owner, 3]
    order = np.lexsort((y0, strip))
    strip, y0, y1 = strip[order], y0[order], y1[order]
    fresh = np.ones(len(strip), bool)
    fresh[1:] = (strip[1:] != strip[:-1]) | (y0[1:] > y1[:-1])
    start = np.flatnonzero(fresh)
    return Runs(cuts, strip[start], y0[start], y1[np.append(start[1:], len(strip)) - 1] if len(strip) else y1)


def touching(strip: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs in neighbouring strips that overlap in y. Runs are sorted and disjoint inside a strip."""
    if not len(strip):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = int(y0.min()), int(y1.max()) - int(y0.min()) + 2
    begins, ends = strip * high + (y0 - low), strip * high + (y1 - low)
    first = np.searchsorted(ends, begins + high, side="right")
    stop = np.searchsorted(begins, ends + high, side="left")
    return spans(first, np.maximum(stop - first, 0))


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of every node's component: roots hook onto smaller ones, then all pointers jump to their root."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            higher = label[label]
            if (higher == label).all():
                break
            label = higher


def background(runs: Runs) -> tuple[Runs, np.ndarray, np.ndarray]:
    """Gaps of all strips inside a frame one pixel larger than each mask, their component, and the outer component by mask.

    Frame strips have no slabs of their own: ``Runs.strip`` of a gap may lie outside the cuts' strips (marked -1).
    """
    masks = np.unique(runs.cuts >> 32)
    begin = np.searchsorted(runs.cuts, masks << 32)
    end = np.append(begin[1:], len(runs.cuts)) - 1  # the last cut of each mask
    of_run = np.searchsorted(masks, runs.mask)
    top = np.full(len(masks), np.iinfo(np.int64).max)
    bottom = np.full(len(masks), np.iinfo(np.int64).min)
    np.minimum.at(top, of_run, runs.y0)
    np.maximum.at(bottom, of_run, runs.y1)
    top, bottom = top - 1, bottom + 1
    # Strips are numbered anew, with a frame strip on both sides and a free number between masks.
    owner, strip = spans(begin, end - begin)
    # Every strip contributes an end marker at its top and bottom; gaps lie between a run's end and the next run's start.
    places = np.concatenate([runs.strip, strip])
    order = np.lexsort((np.concatenate([runs.y1, top[owner]]), places))
    from_y = np.concatenate([runs.y1, top[owner]])[order]
    until = np.concatenate([runs.y0, bottom[owner]])
    to_y = until[np.lexsort((until, places))]
    places = places[order]
    inner = to_y > from_y
    number = places + 2 * np.searchsorted(end, places) + 1
    ids = np.concatenate([number[inner], begin + 2 * np.arange(len(masks)), end + 2 * np.arange(len(masks)) + 1])
    strip_of = np.concatenate([places[inner], np.full(2 * len(masks), -1)])
    y0 = np.concatenate([from_y[inner], top, top])
    y1 = np.concatenate([to_y[inner], bottom, bottom])
    order = np.lexsort((y0, ids))
    ids, strip_of, y0, y1 = ids[order], strip_of[order], y0[order], y1[order]
    label = connected(len(ids), *touching(ids, y0, y1))
    outer = label[np.searchsorted(ids, begin + 2 * np.arange(len(masks)))]
    gap_mask = np.searchsorted(begin + 2 * np.arange(len(masks)), ids, side="right") - 1
    return Runs(runs.cuts, strip_of, y0, y1), label, outer[gap_mask]


def topology(mask: np.ndarray, slabs: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """4-connected components and holes (background parts that do not reach the outside) of each of ``count`` masks."""
    if not len(slabs):
        return np.zeros(count, np.int64), np.zeros(count, np.int64)
    runs = strips(mask, slabs)
    label = connected(len(runs.strip), *touching(runs.strip, runs.y0, runs.y1))
    roots = np.flatnonzero(label == np.arange(len(label)))
    gaps, part, outer = background(runs)
    holes = np.flatnonzero((part == np.arange(len(part))) & (part != outer))
    return np.bincount(runs.mask[roots], minlength=count), np.bincount(gaps.mask[holes], minlength=count)


def holes(mask: np.ndarray, slabs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask and slabs of all holes."""
    gaps, part, outer = background(strips(mask, slabs))
    inside = np.flatnonzero(part != outer)
    return gaps.mask[inside], gaps.slabs(inside)


def components(mask: np.ndarray, slabs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mask, component number within it (by its first run) and slab of every run."""
    runs = strips(mask, slabs)
    label = connected(len(runs.strip), *touching(runs.strip, runs.y0, runs.y1))
    root = label == np.arange(len(label))
    number = np.cumsum(root) - 1
    first = np.full(int(runs.mask.max()) + 1 if len(label) else 0, np.iinfo(np.int64).max)
    np.minimum.at(first, runs.mask, number[label])
    return runs.mask, number[label] - first[runs.mask], runs.slabs()


def outlines(mask: np.ndarray, slabs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixel-edge rings of masks with one component and no hole: mask and vertex (x, y), in order, without collinear points.

    Half-edges keep the mask on one side. Horizontal ones are the ends of runs, vertical ones the places of a cut
    that a run of exactly one side covers. Every vertex has one successor, and pointer doubling ranks the ring.
    """
    runs = strips(mask, slabs)
    high = int(runs.y1.max()) + 1
    top, bottom = runs.strip * high + runs.y0, runs.strip * high + runs.y1
    # +1 where a run to the right of the cut begins or one to the left ends, counted apart for both sides.
    place = np.concatenate([top, bottom, top + high, bottom + high])
    n = len(top)
    right = np.concatenate([np.ones(n, np.int64), -np.ones(n, np.int64), np.zeros(2 * n, np.int64)])
    left = np.concatenate([np.zeros(2 * n, np.int64), np.ones(n, np.int64), -np.ones(n, np.int64)])
    order = np.argsort(place, kind="stable")
    place = place[order]
    head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    place = place[head]
    right, left = np.cumsum(np.add.reduceat(right[order], head)), np.cumsum(np.add.reduceat(left[order], head))
    opens, closes = np.flatnonzero((right > 0) & (left == 0)), np.flatnonzero((left > 0) & (right == 0))
    start = np.concatenate([top, bottom + high, place[opens + 1], place[closes]])
    stop = np.concatenate([top + high, bottom, place[opens], place[closes + 1]])
    way = np.concatenate([np.repeat([0, 1], n), np.full(len(opens), 2), np.full(len(closes), 3)])
    order = np.argsort(start)
    start, stop, way = start[order], stop[order], way[order]
    follow = np.searchsorted(start, stop)
    owner = runs.cuts[start // high] >> 32
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))  # the smallest (x, y) of each ring
    is_first = np.zeros(len(start), bool)
    is_first[first] = True
    straight = np.zeros(len(start), bool)
    straight[follow] = way[follow] == way
    ahead = np.where(is_first[follow], np.arange(len(start)), follow)
    steps = (ahead != np.arange(len(start))).astype(np.int64)
    while True:
        further = ahead[ahead]
        if (further == ahead).all():
            break
        steps, ahead = steps + steps[ahead], further
    order = np.lexsort((-steps, owner))
    order = order[~straight[order]]
    vertex = start[order]
    return owner[order], np.stack([runs.cuts[vertex // high] & LOW, vertex % high], axis=1)


def _chain(mask: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows on the strict lower hull of each mask; rows are sorted by mask and x, and no x comes twice in a mask.

    A row on or above the line between its neighbours is no corner, whatever else is dropped in the same round.
    """
    held = np.arange(len(mask))
    done = [held[:0]]
    while len(held):
        a, b, c = held[:-2], held[1:-1], held[2:]
        over = np.zeros(len(held), bool)
        over[1:-1] = (mask[a] == mask[c]) & ((x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a]) <= 0)
        # Masks that lost no row in this round are finished.
        busy = np.isin(mask[held], mask[held[over]])
        done.append(held[~busy])
        held = held[busy & ~over]
    return np.sort(np.concatenate(done))


def convex_hulls(mask: np.ndarray, slabs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask and vertex (x, y) of the convex hull of all pixels of each mask, without collinear points, from its smallest (x, y)."""
    none = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    if not len(slabs):
        return none
    owner, x = np.repeat(mask, 2), slabs[:, :2].reshape(-1)
    top, bottom = np.repeat(slabs[:, 2], 2), np.repeat(slabs[:, 3], 2)
    order = np.lexsort((x, owner))
    owner, x = owner[order], x[order]
    head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (x[1:] != x[:-1])]))
    top, bottom = np.minimum.reduceat(top[order], head), np.maximum.reduceat(bottom[order], head)
    owner, x = owner[head], x[head]
    there, back = _chain(owner, x, top), _chain(owner, x, -bottom)
    rings = np.concatenate([owner[there], owner[back]])
    points = np.concatenate([np.stack([x[there], top[there]], axis=1), np.stack([x[back], bottom[back]], axis=1)])
    # Along the smallest y with growing x, then back along the largest.
    way = np.repeat([0, 1], [len(there), len(back)])
    order = np.lexsort((np.where(way == 0, points[:, 0], -points[:, 0]), way, rings))
    return rings[order], points[order]


# Fixed value: the COCO polygon rule samples edges on a grid five times finer than pixels.
COCO_SCALE = 5
MIDDLE = 2  # the fine column left of a pixel column's middle


def polygon_intervals(ring: np.ndarray, points: np.ndarray, height: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polygon and foreground [start, end) in column-major order of each of ``len(height)`` polygons, by the COCO rule.

    ``ring`` numbers the polygon of every vertex and is sorted. Every edge is walked on the fine grid along its longer
    axis, from its lower end. Where the walk steps into a new fine column that is the middle of a pixel column, a
    crossing is noted; sorted crossings toggle the mask. Steps between middles change nothing and are left out.
    """
    none = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    if not len(points):
        return none
    fine = (COCO_SCALE * np.asarray(points, float) + 0.5).astype(np.int64)
    n = len(fine)
    last = np.append(ring[1:] != ring[:-1], True)
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    follow = np.arange(1, n + 1)
    follow[last] = first
    xs, ys, xe, ye = fine[:, 0], fine[:, 1], fine[follow, 0], fine[follow, 1]
    dx, dy = np.abs(xe - xs), np.abs(ye - ys)
    wide = dx >= dy
    flip = np.where(wide, xs > xe, ys > ye)
    xs, xe, ys, ye = np.where(flip, xe, xs), np.where(flip, xs, xe), np.where(flip, ye, ys), np.where(flip, ys, ye)
    # A flat edge steps by one fine column at a time, so only its steps into a middle are looked at. An upright one has none.
    flat = np.flatnonzero(wide & (dx > 0))
    of = ring[flat]
    low = np.maximum(-((MIDDLE - xs[flat]) // COCO_SCALE), 0)
    high = np.minimum((xe[flat] - 1 - MIDDLE) // COCO_SCALE, np.ceil(width[of]).astype(np.int64) - 1)
    edge, column = spans(low, np.maximum(high - low + 1, 0))
    here, edge = of[edge], flat[edge]
    t = COCO_SCALE * column + MIDDLE - xs[edge]
    slope = (ye[edge] - ys[edge]) / dx[edge]
    walked = [(ys[edge] + slope * (t + step) + 0.5).astype(np.int64) for step in (0, 1)]
    fine_row = np.minimum(*walked)
    # A steep edge is walked whole.
    steep = np.flatnonzero(~wide & (dx > 0))
    edge, t = spans(np.zeros(len(steep), np.int64), dy[steep] + 1)
    own = edge
    edge = steep[edge]
    u = (xs[edge] + (xe[edge] - xs[edge]) / dy[edge] * t + 0.5).astype(np.int64)
    moved = np.flatnonzero((u[1:] != u[:-1]) & (own[1:] == own[:-1]))
    left = np.minimum(u[moved], u[moved + 1])
    usable = (left >= 0) & (left % COCO_SCALE == MIDDLE) & (left // COCO_SCALE <= width[ring[edge[moved]]] - 1)
    moved, left = moved[usable], left[usable]
    here = np.concatenate([here, ring[edge[moved]]])
    column = np.concatenate([column, left // COCO_SCALE])
    fine_row = np.concatenate([fine_row, ys[edge[moved]] + t[moved]])
    row = np.ceil(np.clip((fine_row + 0.5) / COCO_SCALE - 0.5, 0, height[here]))
    marks = (column * height[here] + row).astype(np.int64)
    odd = np.flatnonzero(np.bincount(here, minlength=len(height)) % 2)
    here, marks = np.concatenate([here, odd]), np.concatenate([marks, height[odd].astype(np.int64) * width[odd].astype(np.int64)])
    order = np.lexsort((marks, here))
    pairs, here = marks[order].reshape(-1, 2), here[order][::2]
    filled = pairs[:, 0] < pairs[:, 1]
    return here[filled], pairs[filled]


def intervals_to_slabs(owner: np.ndarray, pairs: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One slab per touched pixel column of flat column-major intervals; ``height`` by owner."""
    high = height[owner].astype(np.int64)
    first = pairs[:, 0] // high
    row, x = spans(first, (pairs[:, 1] - 1) // high - first + 1)
    y0 = np.maximum(pairs[row, 0] - x * high[row], 0)
    y1 = np.minimum(pairs[row, 1] - x * high[row], high[row])
    return owner[row], np.stack([x, x + 1, y0, y1], axis=1)


def _alike(owner: np.ndarray, slabs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x0, x1, y0, y1 = slabs.T
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (y0[1:] != y0[:-1]) | (y1[1:] != y1[:-1]) | (x0[1:] != x1[:-1])
    head = np.flatnonzero(fresh)
    made = slabs[head]
    made[:, 1] = x1[np.append(head[1:], len(owner))[:len(head)] - 1]
    return owner[head], made


def side_by_side(owner: np.ndarray, slabs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring columns of a mask with the same run as one slab; the slabs of a mask do not overlap."""
    # Columns mostly come in order: what is alike and follows each other is one before anything is sorted.
    owner, slabs = _alike(np.asarray(owner), slabs)
    order = np.lexsort((slabs[:, 0], slabs[:, 3], slabs[:, 2], owner))
    return _alike(owner[order], slabs[order])


def slabs_to_intervals(mask: np.ndarray, slabs: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat column-major intervals of non-overlapping slabs, sorted by mask and start."""
    row, x = spans(slabs[:, 0], slabs[:, 1] - slabs[:, 0])
    owner = np.asarray(mask, np.int64)[row]
    high = height[owner].astype(np.int64)
    pairs = np.stack([x * high + slabs[row, 2], x * high + slabs[row, 3]], axis=1)
    order = np.lexsort((pairs[:, 0], owner))
    return owner[order], pairs[order]


def shared_length(a_owner: np.ndarray, a: np.ndarray, b_owner: np.ndarray, b: np.ndarray, count: int, size: int) -> np.ndarray:
    """Common length by owner of two interval sets, sorted by owner and disjoint inside one; positions lie below ``size``."""
    if not len(a) or not len(b):
        return np.zeros(count, np.int64)
    shift = size + 1
    a0, a1 = a[:, 0] + a_owner * shift, a[:, 1] + a_owner * shift
    b0, b1 = b[:, 0] + b_owner * shift, b[:, 1] + b_owner * shift
    before = np.concatenate([[0], np.cumsum(b1 - b0)])

    def covered(t):
        k = np.searchsorted(b0, t, side="right")
        prior = np.maximum(k, 1) - 1
        return np.where(k > 0, before[prior] + np.minimum(t, b1[prior]) - b0[prior], 0)

    out = np.zeros(count, np.int64)
    np.add.at(out, a_owner, covered(a1) - covered(a0))
    return out


# The alphabet of COCO's compressed run text (6 bits per character, from code 48; 5 bits carry the
# number, least significant first, the sixth says that more follow). From the fourth on, a number is the
# difference to the one two before it.
TEXT_BASE, MORE, SIGN, BITS = 48, 32, 16, 5


def counts_to_text(counts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters and their offsets of the run texts of many count lists."""
    counts = np.asarray(counts, np.int64)
    inside = np.arange(len(counts)) - np.repeat(offsets[:-1], np.diff(offsets))
    late = inside > 2
    value = counts.copy()
    value[late] -= counts[np.flatnonzero(late) - 2]
    size = np.where(value < 0, ~value, value)
    length = np.ones(len(value), np.int64)
    for bits in range(BITS - 1, 60, BITS):  # one step per character that a 64-bit number can need
        length += size >> bits > 0
    owner, place = spans(np.zeros(len(value), np.int64), length)
    code = (value[owner] >> (BITS * place)) & 31
    code += np.where(place + 1 < length[owner], MORE, 0) + TEXT_BASE
    return code.astype(np.uint8), np.concatenate([[0], np.cumsum(length)])[offsets]


def text_to_counts(text: np.ndarray, offsets: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, their offsets, whether valid) of many run texts.

    A text is valid if its characters belong to the alphabet, its last number ends, no number is
    wider than the pixel total allows, and its counts are not negative and add up to at most the total.
    An invalid text gives no counts.
    """
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    code = text.astype(np.int64) - TEXT_BASE
    bad = np.bincount(owner[(code < 0) | (code > 63)], minlength=n) > 0
    ends = code & MORE == 0
    filled = np.flatnonzero(np.diff(offsets) > 0)
    bad[np.diff(offsets) == 0] = True
    bad[filled] |= ~ends[offsets[filled + 1] - 1]
    keep = ~bad[owner]
    owner, code, ends = owner[keep], code[keep], ends[keep]
    stop = np.flatnonzero(ends) + 1
    start = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
    length = stop - start
    of = owner[start] if len(stop) else owner
    # A difference of two counts needs one bit more than the total, and a sign.
    widest = -(-(np.ceil(np.log2(total.astype(float) + 1)).astype(np.int64) + 2) // BITS)
    bad |= np.bincount(of[length > widest[of]], minlength=n) > 0
    keep = ~bad[of]
    number = np.repeat(np.arange(len(stop)), length)
    place = np.arange(len(number)) - start[number]
    part = np.where(place < 12, (code & 31) << (BITS * np.minimum(place, 11)), 0)
    value = np.add.reduceat(part, start) if len(start) else part
    if len(start):
        value -= np.where(code[stop - 1] & SIGN, np.int64(1) << (BITS * np.minimum(length, 12)), 0)
    of, value = of[keep], value[keep]
    size = np.bincount(of, minlength=n)
    cut = np.concatenate([[0], np.cumsum(size)])
    inside = np.arange(len(of)) - cut[of]
    # Counts of one parity are running sums of their differences; the first count stands alone.
    chain = of * 3 + np.where(inside == 0, 0, 1 + inside % 2)
    order = np.argsort(chain, kind="stable")
    sums = np.cumsum(value[order])
    chained = chain[order]
    lead = np.flatnonzero(np.concatenate([[True], chained[1:] != chained[:-1]])) if len(order) else order
    prior = np.concatenate([[0], sums])[lead]
    counts = np.empty(len(of), np.int64)
    counts[order] = sums - np.repeat(prior, np.diff(np.append(lead, len(order))))
    bad |= np.bincount(of[(counts < 0) | (counts > total[of])], minlength=n) > 0
    counts = np.where(bad[of], 0, counts)
    bad |= (np.bincount(of, weights=counts, minlength=n) > total) | (size > 2 * total + 1)
    keep = ~bad[of]
    return counts[keep], np.concatenate([[0], np.cumsum(np.where(bad, 0, size))]), ~bad
