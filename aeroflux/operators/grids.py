"""Grids, projections and points in cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: radius in metres of the sphere that the meteorology's projections use.
SPHERE = 6370997.0


@dataclass(frozen=True)
class Grid:
    """A regular grid: nx by ny cells of dx by dy from the corner (x0, y0); rows run along y."""

    name: str
    nx: int
    ny: int
    dx: float
    dy: float
    x0: float
    y0: float


@dataclass(frozen=True)
class Projection:
    """kind: lonlat, lcc (standard parallels lat1 and lat2, origin lat0, lon0) or mercator (true scale at lat1)."""

    kind: str = "lonlat"
    lat1: float = 0.0
    lat2: float = 0.0
    lat0: float = 0.0
    lon0: float = 0.0
    radius: float = SPHERE


def regular_grid(spark: SparkSession, grid: Grid) -> DataFrame:
    """(grid, row, col, xmin, ymin, xmax, ymax), one row for each cell."""
    n = F.col("id")
    row, col = F.floor(n / grid.nx).cast("int"), (n % grid.nx).cast("int")
    cells = spark.range(grid.nx * grid.ny).select(F.lit(grid.name).alias("grid"), row.alias("row"), col.alias("col"))
    x, y = F.col("col") * grid.dx + grid.x0, F.col("row") * grid.dy + grid.y0
    return cells.select("*", x.alias("xmin"), y.alias("ymin"), (x + grid.dx).alias("xmax"), (y + grid.dy).alias("ymax"))


def irregular_grid(shapes: DataFrame, name: str, ordinal: str = "ordinal", rings: str = "rings", project: Projection | None = None) -> DataFrame:
    """(grid, row, col, rings, xmin, ymin, xmax, ymax): one column, rows by the polygons' order; reprojected if asked for."""
    geometry = F.col(rings) if project is None else projected_rings(F.col(rings), project)
    cells = shapes.select(F.lit(name).alias("grid"), F.col(ordinal).cast("int").alias("row"), F.lit(0).alias("col"), geometry.alias("rings"))
    return cells.select("*", *extent(F.col("rings")))


def extent(rings: Column) -> list[Column]:
    xs, ys = F.transform(F.flatten(rings), lambda p: p["x"]), F.transform(F.flatten(rings), lambda p: p["y"])
    return [F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax")]


def nested_grids(ref_x: float | None, ref_y: float | None, dx: float, dy: float, parents: list[int], ratios: list[int], i_start: list[int], j_start: list[int], e_we: list[int], e_sn: list[int], lon0: float = 0.0, lat0: float = 0.0, lonlat: bool = False) -> list[Grid]:
    """Grids d01, d02, ... of nested domains, a handful of parameters each."""
    grids: list[Grid] = []
    for k, (nx, ny) in enumerate(zip(e_we, e_sn)):
        if k == 0:
            rx, ry = ref_x if ref_x is not None else nx / 2, ref_y if ref_y is not None else ny / 2
            step_x, step_y = dx, dy
            x0, y0 = -(rx - 0.5) * dx + (lon0 if lonlat else 0.0), -(ry - 0.5) * dy + (lat0 if lonlat else 0.0)
        else:
            parent = grids[parents[k] - 1]
            step_x, step_y = parent.dx / ratios[k], parent.dy / ratios[k]
            x0, y0 = parent.x0 + (i_start[k] - 1) * parent.dx, parent.y0 + (j_start[k] - 1) * parent.dy
        grids.append(Grid(f"d{k + 1:02d}", nx - 1, ny - 1, step_x, step_y, x0, y0))
    return grids


def project(lon: Column, lat: Column, p: Projection) -> tuple[Column, Column]:
    """Plane coordinates of longitudes and latitudes in degrees, on the sphere."""
    if p.kind == "lonlat":
        return lon, lat
    turn = F.pmod(lon - p.lon0 + 180.0, F.lit(360.0)) - 180.0
    if p.kind == "mercator":
        k = p.radius * math.cos(math.radians(p.lat1))
        return F.radians(turn) * k, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * k
    if p.kind != "lcc":
        raise ValueError(f"projection {p.kind}")
    f1, f2, f0 = map(math.radians, (p.lat1, p.lat2, p.lat0))
    half = lambda f: math.tan(math.pi / 4 + f / 2)
    n = math.sin(f1) if p.lat1 == p.lat2 else math.log(math.cos(f1) / math.cos(f2)) / math.log(half(f2) / half(f1))
    scale = p.radius * math.cos(f1) * half(f1) ** n / n
    rho = scale / F.pow(F.tan(F.radians(lat) / 2 + math.pi / 4), F.lit(n))
    theta = F.radians(turn) * n
    return rho * F.sin(theta), F.lit(scale / half(f0) ** n) - rho * F.cos(theta)


def projected_rings(rings: Column, p: Projection) -> Column:
    def point(v: Column) -> Column:
        x, y = project(v["x"], v["y"], p)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(rings, lambda ring: F.transform(ring, point))


def _steps(value: Column, origin: float, step: float, count: int) -> Column:
    """Numbers of the cells that touch a coordinate: two on a shared edge."""
    at = (value - origin) / step
    low = F.floor(at).cast("int")
    touching = F.when(at == low, F.array(low - 1, low)).otherwise(F.array(low))
    return F.filter(touching, lambda i: (i >= 0) & (i < count))


def points_to_cells(points: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """points x the cells they touch, with the weight 1 / number of cells; points outside have no row."""
    located = points.withColumn("_cols", _steps(F.col(x), grid.x0, grid.dx, grid.nx)).withColumn("_rows", _steps(F.col(y), grid.y0, grid.dy, grid.ny))
    weight = F.lit(1.0) / (F.size("_cols") * F.size("_rows"))
    cells = located.withColumn("weight", F.when((F.size("_cols") > 0) & (F.size("_rows") > 0), weight)).withColumn("row", F.explode("_rows")).withColumn("col", F.explode("_cols"))
    return cells.withColumn("grid", F.lit(grid.name)).drop("_cols", "_rows")


def on_or_inside(x: Column, y: Column, rings: Column) -> Column:
    """Is a point inside rings (even-odd) or on an edge."""

    def edge(a: Column, b: Column) -> Column:
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        touches = (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        passes = (a["y"] > y) != (b["y"] > y)
        right = F.when(passes, x < a["x"] + (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) * (b["x"] - a["x"])).otherwise(F.lit(False))
        return F.struct(touches.alias("touches"), right.cast("int").alias("right"))

    edges = F.flatten(F.transform(rings, lambda ring: F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: edge(F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))))))
    odd = F.aggregate(edges, F.lit(0), lambda total, e: total + e["right"]) % 2 == 1
    return odd | F.exists(edges, lambda e: e["touches"])


def points_to_irregular(points: DataFrame, cells: DataFrame, tile: float, x: str = "x", y: str = "y") -> DataFrame:
    """As points_to_cells for polygons: points and cells meet in tiles of the plane, then each pair is tested exactly."""
    n = lambda c: F.floor(c / tile).cast("long")
    spread = cells.withColumn("_tx", F.explode(F.sequence(n(F.col("xmin")), n(F.col("xmax"))))).withColumn("_ty", F.explode(F.sequence(n(F.col("ymin")), n(F.col("ymax")))))
    rows = points.withColumn("_row", F.monotonically_increasing_id())
    hits = rows.withColumn("_tx", n(F.col(x))).withColumn("_ty", n(F.col(y))).join(spread.select("grid", "row", "col", "rings", "_tx", "_ty"), ["_tx", "_ty"]).where(on_or_inside(F.col(x), F.col(y), F.col("rings")))
    # a point's cells together: by the row, as several points may have one name
    cells_of = hits.groupBy("_row").agg(F.first(F.struct(*points.columns)).alias("_p"), F.collect_list(F.struct("grid", "row", "col")).alias("_cells"))
    return cells_of.withColumn("weight", F.lit(1.0) / F.size("_cells")).withColumn("_c", F.explode("_cells")).select("_p.*", "_c.*", "weight")
