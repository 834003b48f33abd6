"""The tree of blocks against shapes cut cell by cell, and surrogates against sampling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroflux.operators import rings as geo
from aeroflux.operators import surrogates as sg
from aeroflux.operators.grids import Grid


def flat(*parts):
    """Rings of (owner, points)."""
    xy = np.concatenate([np.array(p, float).reshape(-1, 2) for _, p in parts])
    return geo.Rings(xy[:, 0], xy[:, 1], np.array([len(p) for _, p in parts]), np.array([o for o, _ in parts]))


def star(rng, cx, cy, r, n, turn=1, least=0.3):
    angles = np.sort(rng.uniform(0, 2 * math.pi, n))[::turn]
    far = r * rng.uniform(least, 1.0, n)
    return np.column_stack([cx + far * np.cos(angles), cy + far * np.sin(angles)])


def by_cell(kind, rings, x0, y0, dx, dy, cells):
    """Sizes by cutting every row's rings to every cell."""
    out = {}
    rows = int(rings.owner.max()) + 1
    for r, c in cells:
        low = lambda origin, step, n: np.full(rows, origin + n * step)
        part = geo.cut(kind, rings, 1, low(y0, dy, r), low(y0, dy, r + 1))
        part = geo.cut(kind, part, 0, low(x0, dx, c), low(x0, dx, c + 1))
        for row, size in enumerate(geo.sizes(kind, part, rows)):
            if size > 1e-12:
                out[row, r, c] = size
    return out


def covered(kind, rings, x0, y0, dx, dy):
    found = geo.cover(kind, rings, x0, y0, dx, dy)
    sizes = np.where(found.full, dx * dy, geo.sizes(kind, found.rings, len(found.row)))
    out = {}
    for row, (r0, r1, c0, c1), size in zip(found.row, found.bounds, sizes):
        for r in range(r0, r1):
            for c in range(c0, c1):
                assert (row, r, c) not in out
                out[row, r, c] = size
    return {k: v for k, v in out.items() if v > 1e-12}, found


def test_blocks_of_polygons_with_holes():
    rng = np.random.default_rng(4)
    parts = [(0, [(0, 0), (10, 0), (10, 10), (0, 10)]), (0, [(3, 3), (3, 6.5), (6.5, 6.5), (6.5, 3)]), (1, star(rng, 5, 5, 7, 60)), (1, star(rng, 5, 5, 1, 9, -1)), (2, star(rng, -3, 2, 4, 7)), (4, [(1, 1), (2, 1), (2, 2), (1, 2)])]
    rings = flat(*parts)
    got, found = covered("polygon", rings, -0.5, 0.25, 1.0, 0.5)
    want = by_cell("polygon", rings, -0.5, 0.25, 1.0, 0.5, [(r, c) for r in range(-12, 30) for c in range(-8, 14)])
    assert got.keys() == want.keys() and got == pytest.approx(want)
    assert found.full.any() and len(found.row) < len(got)
    assert set(found.row) == {0, 1, 2, 4}


def test_parts_that_cover_twice_are_not_full():
    """Two copies of a left half have the area of the whole."""
    half_box = [(0, 0), (4, 0), (4, 8), (0, 8)]
    got, found = covered("polygon", flat((0, half_box), (0, half_box)), 0.0, 0.0, 8.0, 8.0)
    assert not found.full.any() and got == {(0, 0, 0): 64.0}
    got, found = covered("polygon", flat((0, half_box)), 0.0, 0.0, 4.0, 4.0)
    assert found.full.all() and got == {(0, 0, 0): 16.0, (0, 1, 0): 16.0}


def test_blocks_of_lines_and_points():
    rng = np.random.default_rng(5)
    lines = flat((0, rng.uniform(-4, 12, (40, 2))), (1, [(0, 3), (9, 3)]), (1, [(2, 0), (2, 5)]))
    cells = [(r, c) for r in range(-6, 16) for c in range(-6, 16)]
    got, _ = covered("line", lines, 0.0, 0.0, 1.0, 1.0)
    want = by_cell("line", lines, 0.0, 0.0, 1.0, 1.0, cells)
    assert got.keys() == want.keys() and got == pytest.approx(want)
    points = flat((0, rng.integers(-3, 9, (50, 2))), (2, [(0.5, 0.5), (0.5, 0.5)]))
    got, _ = covered("point", points, 0.0, 0.0, 1.0, 1.0)
    assert got == by_cell("point", points, 0.0, 0.0, 1.0, 1.0, cells) and got[2, 0, 0] == 2


def test_nothing_to_cover():
    empty = geo.Rings(np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(geo.cover("polygon", empty, 0, 0, 1, 1).row) == 0


def test_surrogate_of_stars_equals_sampling(spark):
    """Shares of a star with a hole, by star-shaped weights, against points thrown at the plane."""
    rng = np.random.default_rng(9)
    shape, hole, weight = star(rng, 10, 10, 9, 400, 1, 0.85), star(rng, 10, 10, 2, 40, -1), star(rng, 12, 9, 8, 200)
    as_ring = lambda p: [{"x": float(a), "y": float(b)} for a, b in p]
    inputs = spark.createDataFrame([("s", [as_ring(shape), as_ring(hole)])], "shape_id string, rings array<array<struct<x: double, y: double>>>")
    weights = spark.createDataFrame([("w", "polygon", [as_ring(weight)])], "weight_id string, kind string, rings array<array<struct<x: double, y: double>>>")
    grid = Grid("g", 9, 9, 2.0, 2.0, 0.0, 0.0)
    got = {(r["row"], r["col"]): r["weight"] for r in sg.create_surrogate(sg.input_shapes(inputs, grid), sg.weight_shapes(weights, grid, [], []), grid, "1").collect()}
    x, y = rng.uniform(0, 20, (2, 400_000))

    def inside(ring):
        out = np.zeros(len(x), bool)
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0)):
            crosses = (ay > y) != (by > y)
            out ^= crosses & (x < ax + (y - ay) / (by - ay if by != ay else 1.0) * (bx - ax))
        return out

    hit = inside(shape) & ~inside(hole) & inside(weight)
    counts = {}
    for r, c in zip((y[hit] // 2).astype(int), (x[hit] // 2).astype(int)):
        counts[r, c] = counts.get((r, c), 0) + 1
    total = hit.sum()
    for cell in set(got) | {k for k, n in counts.items() if k[0] < 9 and k[1] < 9 and n > 20}:
        assert got.get(cell, 0.0) == pytest.approx(counts.get(cell, 0) / total, abs=0.004)
    assert sg.tiles(inputs.withColumn("kind", F.lit("polygon")), grid, "shape_id").where("full").count() > 5
