"""Arrow lists of rings as flat numpy arrays: many rings are cut and measured at once inside a Spark task.

``Rings`` holds the points of all rings behind each other, the number of points of each ring and the batch row that owns it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Pairs of points and triangles (or edges) that are worked on at once.
BLOCK = 1 << 18


@dataclass(frozen=True)
class Rings:
    x: np.ndarray
    y: np.ndarray
    n: np.ndarray
    owner: np.ndarray

    @property
    def of_point(self) -> np.ndarray:
        """The ring of each point."""
        return np.repeat(np.arange(len(self.n)), self.n)

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.n) - self.n

    def take(self, rings: np.ndarray) -> Rings:
        """These rings in this order, which may repeat some."""
        at = spread(self.start[rings], self.n[rings])
        return Rings(self.x[at], self.y[at], self.n[rings], self.owner[rings])

    def points(self, keep: np.ndarray) -> Rings:
        """All rings with only these of their points."""
        return Rings(self.x[keep], self.y[keep], np.bincount(self.of_point[keep], minlength=len(self.n)), self.owner)


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each stretch, one stretch behind the other."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


def read(column: pa.ListArray) -> Rings:
    """The rings of a column array<array<struct<x,y>>>."""
    outer = column.offsets.to_numpy()
    inner = column.values.offsets.to_numpy()
    counts = np.diff(outer)
    first, last = inner[outer[0]], inner[outer[-1]]
    points = column.values.values.slice(first, last - first)
    x, y = (child.to_numpy(zero_copy_only=False).astype(float) for child in points.flatten())
    return Rings(x, y, np.diff(inner[outer[0] : outer[-1] + 1]), np.repeat(np.arange(len(counts)), counts))


def write(rings: Rings, rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A column with the rings of these rows, which are all that own any."""
    points = pa.StructArray.from_arrays([pa.array(rings.x), pa.array(rings.y)], fields=list(kind.value_type.value_type))
    bounds = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    inner = pa.ListArray.from_arrays(bounds(rings.n), points, type=kind.value_type)
    return pa.ListArray.from_arrays(bounds(np.bincount(rings.owner, minlength=rows[-1] + 1 if len(rows) else 0)[rows]), inner, type=kind)


def following(rings: Rings) -> np.ndarray:
    """The place of each point's successor in its ring."""
    after = np.arange(len(rings.x)) + 1
    full = rings.n > 0
    after[(rings.start + rings.n - 1)[full]] = rings.start[full]
    return after


def clip(rings: Rings, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> Rings:
    """The part of each ring in its half plane a x + b y >= c."""
    of, after = rings.of_point, following(rings)
    d0 = a[of] * rings.x + b[of] * rings.y - c[of]
    d1 = d0[after]
    crosses = ((d0 > 0) & (d1 < 0)) | ((d0 < 0) & (d1 > 0))
    t = np.where(crosses, d0 / np.where(crosses, d0 - d1, 1.0), 0.0)
    # each point is followed by the place where its edge crosses
    both = lambda v: np.stack([v, v + t * (v[after] - v)], axis=1).ravel()
    wide = Rings(both(rings.x), both(rings.y), 2 * rings.n, rings.owner)
    return wide.points(np.stack([d0 >= 0, crosses], axis=1).ravel())


def areas(rings: Rings) -> np.ndarray:
    """Signed areas, about a ring's first point, so that large coordinates don't cancel."""
    of, after = rings.of_point, following(rings)
    x, y = rings.x - rings.x[rings.start[of]], rings.y - rings.y[rings.start[of]]
    return np.bincount(of, weights=x * y[after] - x[after] * y, minlength=len(rings.n)) / 2


def triangles(rings: Rings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, sign, sides) of all rings' fans; sides[t, k] = (a, b, c). The signed triangles add up to a ring's inside, whatever its shape."""
    count = np.maximum(rings.n - 2, 0)
    second = spread(rings.start + 1, count)
    corners = np.stack([np.repeat(rings.start, count), second, second + 1], axis=1)
    x, y = rings.x[corners], rings.y[corners]
    area = (x[:, 1] - x[:, 0]) * (y[:, 2] - y[:, 0]) - (x[:, 2] - x[:, 0]) * (y[:, 1] - y[:, 0])
    turned = area < 0
    for v in (x, y):
        v[turned] = v[turned, ::-1]
    a, b = y - np.roll(y, -1, axis=1), np.roll(x, -1, axis=1) - x
    some = area != 0
    return np.repeat(rings.owner, count)[some], np.sign(area[some]), np.stack([a, b, a * x + b * y], axis=2)[some]


def segments(rings: Rings, close: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, from, to) of the edges: places of their ends; ``close`` adds the one from the last to the first point."""
    of, after = rings.of_point, following(rings)
    start = np.flatnonzero((after > np.arange(len(after))) | close)
    return rings.owner[of[start]], start, after[start]


def inside_shares(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part (from, to) of each segment inside all of its half planes sides[i, k], as shares of it; (0, 0) if none."""
    low, high = np.zeros(len(x0)), np.ones(len(x0))
    for a, b, c in np.moveaxis(sides, 1, 0).transpose(0, 2, 1):
        d0, d1 = a * x0 + b * y0 - c, a * x1 + b * y1 - c
        t = d0 / np.where(d0 == d1, 1.0, d0 - d1)
        low = np.where((d0 < 0) & (d1 >= 0), np.maximum(low, t), low)
        high = np.where((d0 >= 0) & (d1 < 0), np.minimum(high, t), high)
        high = np.where((d0 < 0) & (d1 < 0), 0.0, high)
    none = high <= low
    return np.where(none, 0.0, low), np.where(none, 0.0, high)


def pairs(left: np.ndarray, right: np.ndarray, rows: int, cost: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all (left, right) with one owner, in blocks; ``right`` is in order of owners. ``cost`` is that of a right one."""
    count = np.bincount(right, minlength=rows)
    first = np.cumsum(count) - count
    total = np.bincount(right, weights=cost, minlength=rows)[left] if cost is not None else count[left]
    block = (np.cumsum(total) // BLOCK).astype(np.int64)
    for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(block)) + 1):
        n = count[left[part]]
        yield np.repeat(part, n), spread(first[left[part]], n)


def common_sizes(kind: str, weights: Rings, shapes: Rings, rows: int) -> np.ndarray:
    """For each row the area, length or number of points that its weight rings share with its shape rings."""
    out = np.zeros(rows)
    add = lambda owner, size: np.add(out, np.bincount(owner, weights=size, minlength=rows), out=out)
    if kind == "point":
        owner, p, q = segments(shapes, close=True)
        mine = np.repeat(weights.owner, weights.n)
        touched, odd = np.zeros(len(mine), int), np.zeros(len(mine), int)
        for e, i in pairs(owner, mine, rows):
            x, y = weights.x[i], weights.y[i]
            ax, ay, bx, by = shapes.x[p[e]], shapes.y[p[e]], shapes.x[q[e]], shapes.y[q[e]]
            near = (np.minimum(ax, bx) <= x) & (x <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by))
            touched += np.bincount(i[near & ((bx - ax) * (y - ay) == (by - ay) * (x - ax))], minlength=len(mine))
            passes = (ay > y) != (by > y)
            right = passes & (x < ax + (y - ay) / np.where(passes, by - ay, 1.0) * (bx - ax))
            odd += np.bincount(i[right], minlength=len(mine))
        add(mine, ((touched > 0) | (odd % 2 == 1)).astype(float))
        return out
    owner, sign, sides = triangles(shapes)
    if kind == "line":
        mine, p, q = segments(weights, close=False)
        for t, i in pairs(owner, mine, rows):
            x0, y0, x1, y1 = weights.x[p[i]], weights.y[p[i]], weights.x[q[i]], weights.y[q[i]]
            low, high = inside_shares(x0, y0, x1, y1, sides[t])
            add(owner[t], sign[t] * (high - low) * np.hypot(x1 - x0, y1 - y0))
        return np.abs(out)
    for t, i in pairs(owner, weights.owner, rows, weights.n):
        part = weights.take(i)
        for k in range(3):
            part = clip(part, *sides[t, k].T)
        add(owner[t], sign[t] * areas(part))
    return np.abs(out)


def cut(kind: str, rings: Rings, axis: int, low: np.ndarray, high: np.ndarray) -> Rings:
    """The part of each row's rings between low and high (by row) along axis 0 (x) or 1 (y).

    A point on the upper bound, and a segment along it, belong to the next strip. Pieces of lines are rings of two points.
    """
    low, high = low[rings.owner], high[rings.owner]
    one, zero = np.ones(len(rings.n)), np.zeros(len(rings.n))
    a, b = (one, zero) if axis == 0 else (zero, one)
    if kind == "polygon":
        part = clip(clip(rings, a, b, low), -a, -b, -high)
        return part.take(np.flatnonzero(part.n > 2))
    of = rings.of_point
    v = rings.x if axis == 0 else rings.y
    if kind == "point":
        part = rings.points((v >= low[of]) & (v < high[of]))
        return part.take(np.flatnonzero(part.n))
    owner, p, q = segments(rings, close=False)
    r = of[p]
    sides = np.stack([np.stack([a[r], b[r], low[r]], axis=1), np.stack([-a[r], -b[r], -high[r]], axis=1)], axis=1)
    x0, y0, x1, y1 = rings.x[p], rings.y[p], rings.x[q], rings.y[q]
    start, end = inside_shares(x0, y0, x1, y1, sides)
    keep = (end > start) & ~((v[p] == high[r]) & (v[q] == high[r]))
    ends = lambda u0, u1: np.stack([u0 + start * (u1 - u0), u0 + end * (u1 - u0)], axis=1)[keep].ravel()
    return Rings(ends(x0, x1), ends(y0, y1), np.full(keep.sum(), 2), owner[keep])


def thinned(rings: Rings, tolerance: float) -> Rings:
    """Farthest-point subdivision: a stretch is one segment when all its points are near enough. All stretches are cut in rounds together."""
    keep = np.zeros(len(rings.x), bool)
    full = rings.n > 0
    first, last = rings.start[full], (rings.start + rings.n - 1)[full]
    keep[first] = keep[last] = True
    while len(first):
        inner = np.maximum(last - first - 1, 0)
        first, last, inner = first[inner > 0], last[inner > 0], inner[inner > 0]
        if not len(first):
            break
        i, s = spread(first + 1, inner), np.repeat(np.arange(len(first)), inner)
        dx, dy = (rings.x[last] - rings.x[first])[s], (rings.y[last] - rings.y[first])[s]
        px, py = rings.x[i] - rings.x[first][s], rings.y[i] - rings.y[first][s]
        length = np.hypot(dx, dy)
        away = np.where(length > 0, np.abs(dx * py - dy * px) / np.where(length > 0, length, 1.0), np.hypot(px, py))
        best = np.maximum.reduceat(away, np.cumsum(inner) - inner)
        far = np.full(len(first), len(rings.x))
        np.minimum.at(far, s, np.where(away == best[s], i, len(rings.x)))
        open_ = best > tolerance
        keep[far[open_]] = True
        first, last = np.concatenate([first[open_], far[open_]]), np.concatenate([far[open_], last[open_]])
    return rings.points(keep)


@dataclass(frozen=True)
class Blocks:
    """Blocks of grid cells [row0, row1) x [col0, col1) of batch rows; a full one has no rings and is covered wholly, the others are single cells whose rings carry the block's number."""

    row: np.ndarray
    bounds: np.ndarray
    full: np.ndarray
    rings: Rings


def sizes(kind: str, rings: Rings, count: int) -> np.ndarray:
    """Area, length or number of points of the rings of each of so many owners."""
    if kind == "polygon":
        return np.abs(np.bincount(rings.owner, weights=areas(rings), minlength=count)) if len(rings.x) else np.zeros(count)
    if kind == "point":
        return np.bincount(np.repeat(rings.owner, rings.n), minlength=count).astype(float)
    owner, p, q = segments(rings, close=False)
    return np.bincount(owner, weights=np.hypot(rings.x[q] - rings.x[p], rings.y[q] - rings.y[p]), minlength=count)


def half(kind: str, rings: Rings, axis: int, low: np.ndarray, middle: np.ndarray, high: np.ndarray, upper: bool) -> Rings:
    """The lower or upper part of each owner's rings, which lie between low and high."""
    if kind != "polygon":
        return cut(kind, rings, axis, middle if upper else low, high if upper else middle)
    sign = 1.0 if upper else -1.0
    along, across = np.full(len(rings.n), sign), np.zeros(len(rings.n))
    part = clip(rings, *((along, across) if axis == 0 else (across, along)), sign * middle[rings.owner])
    return part.take(np.flatnonzero(part.n > 2))


def whole(rings: Rings, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which blocks, whose corners are x[i, 0], y[i, 0] and x[i, 1], y[i, 1], are covered wholly: one ring of the block's area that runs along its border. Several rings could cover one part twice."""
    count = len(x)
    box = (x[:, 1] - x[:, 0]) * (y[:, 1] - y[:, 0])
    likely = (np.bincount(rings.owner, minlength=count) == 1) & (sizes("polygon", rings, count) >= box * (1 - 1e-9))
    of = np.repeat(rings.owner, rings.n)
    near = likely[of]
    of, px, py = of[near], rings.x[near], rings.y[near]
    away = np.minimum(np.abs(px[:, None] - x[of]).min(axis=1) / (x[of, 1] - x[of, 0]), np.abs(py[:, None] - y[of]).min(axis=1) / (y[of, 1] - y[of, 0]))
    inside = np.bincount(of[away > 1e-9], minlength=count) > 0
    return likely & ~inside


def cover(kind: str, rings: Rings, x0: float, y0: float, dx: float, dy: float) -> Blocks:
    """The cells that each row's rings touch, as a tree of halved blocks.

    A block is halved along its longer side until it is covered wholly or is one cell. A ring's points are copied once a level, not once a row or column of cells, and what is covered wholly needs no geometry.
    """
    bounds = np.zeros((0, 4), np.int64)
    row = np.zeros(0, np.int64)
    if len(rings.x):
        rings = rings.take(np.flatnonzero(rings.n > 0))
        row, number = np.unique(rings.owner, return_inverse=True)
        rings = Rings(rings.x, rings.y, rings.n, number)
        of = np.repeat(number, rings.n)
        span = lambda v, origin, step: [np.floor((f.reduceat(v, np.searchsorted(of, np.arange(len(row)))) - origin) / step).astype(np.int64) for f in (np.minimum, np.maximum)]
        (r0, r1), (c0, c1) = span(rings.y, y0, dy), span(rings.x, x0, dx)
        bounds = np.stack([r0, r1 + 1, c0, c1 + 1], axis=1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, Rings]] = []
    while len(row):
        x, y = x0 + bounds[:, 2:] * dx, y0 + bounds[:, :2] * dy
        full = whole(rings, x, y) if kind == "polygon" else np.zeros(len(row), bool)
        tall, wide = bounds[:, 1] - bounds[:, 0], bounds[:, 3] - bounds[:, 2]
        done = full | ((tall == 1) & (wide == 1))
        found.append((row[done], bounds[done], full[done], owned(rings, done & ~full, done)))
        halves = []
        for axis, chosen in ((1, ~done & (tall >= wide)), (0, ~done & (tall < wide))):
            part = owned(rings, chosen, chosen)
            own, at = bounds[chosen], 0 if axis == 1 else 2
            middle = (own[:, at] + own[:, at + 1]) // 2
            place = lambda n: (y0 + n * dy) if axis == 1 else (x0 + n * dx)  # noqa: B023, E731
            for upper in (False, True):
                kept = half(kind, part, axis, place(own[:, at]), place(middle), place(own[:, at + 1]), upper)
                mine = own.copy()
                mine[:, at if upper else at + 1] = middle
                some = np.bincount(kept.owner, minlength=len(mine)) > 0
                halves.append((row[chosen][some], mine[some], owned(kept, some, some)))
        row, bounds = (np.concatenate(v) for v in list(zip(*halves))[:2])
        rings = joined([h[2] for h in halves], [len(h[0]) for h in halves])
    if not found:
        return Blocks(row, bounds, np.zeros(0, bool), Rings(np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)))
    return Blocks(*(np.concatenate([f[k] for f in found]) for k in range(3)), joined([f[3] for f in found], [len(f[0]) for f in found]))


def owned(rings: Rings, wanted: np.ndarray, numbered: np.ndarray) -> Rings:
    """The rings of the wanted owners, who get new numbers among the numbered ones."""
    part = rings.take(np.flatnonzero(wanted[rings.owner]))
    return Rings(part.x, part.y, part.n, (np.cumsum(numbered) - 1)[part.owner])


def joined(parts: list[Rings], owners: list[int]) -> Rings:
    """Rings behind each other, owners of each part counted on from the part before."""
    first = np.cumsum([0, *owners[:-1]])
    return Rings(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("x", "y", "n")), np.concatenate([p.owner + f for p, f in zip(parts, first)]))


def in_order(rings: Rings) -> Rings:
    """The rings by their owners."""
    return rings.take(np.argsort(rings.owner, kind="stable"))
