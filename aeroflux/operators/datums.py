"""Datums of longitudes and latitudes: shifts to WGS 84 as column expressions.

A position on an older datum is moved by the standard Molodensky formula: the ellipsoids' difference in size and flattening, and the distance of their centres, seen along the meridian and the parallel. Heights are 0. Three mean distances fit a region to some metres; a table of shifts at the nodes of a grid fits better and is interpolated by a join (:func:`shift_by_nodes`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroflux.operators.grids import Projection, project


@dataclass(frozen=True)
class Ellipsoid:
    """Semi-major axis in metres and flattening."""

    a: float
    f: float

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)


# Ellipsoids, and the distance in metres from the centre of Clarke's to that of WGS 84 by region of NAD27.
WGS84 = Ellipsoid(6378137.0, 1 / 298.257223563)
CLARKE_1866 = Ellipsoid(6378206.4, 1 - 6356583.8 / 6378206.4)
NAD27_SHIFTS = {
    "conus": (-8.0, 160.0, 176.0),
    "eastern": (-9.0, 161.0, 179.0),
    "western": (-8.0, 159.0, 175.0),
    "alaska": (-5.0, 135.0, 172.0),
    "canada": (-10.0, 158.0, 187.0),
    "mexico": (-12.0, 130.0, 190.0),
    "caribbean": (-3.0, 142.0, 183.0),
    "central america": (0.0, 125.0, 194.0),
}
#: Datums that agree with WGS 84 within a metre or two and aren't moved.
LIKE_WGS84 = ("lonlat", "nad83", "wgs84")


def molodensky(lon: Column, lat: Column, shift: tuple[Column, Column, Column], of: Ellipsoid, to: Ellipsoid = WGS84) -> tuple[Column, Column]:
    """Longitude and latitude in degrees on ``to`` of a position on ``of``, whose centre lies at -shift (metres)."""
    dx, dy, dz = shift
    sin_lat, cos_lat, sin_lon, cos_lon = F.sin(F.radians(lat)), F.cos(F.radians(lat)), F.sin(F.radians(lon)), F.cos(F.radians(lon))
    w2 = 1 - of.e2 * sin_lat * sin_lat
    prime, meridian = of.a / F.sqrt(w2), of.a * (1 - of.e2) / F.pow(w2, F.lit(1.5))
    da, df, ratio = to.a - of.a, to.f - of.f, 1 - of.f
    north = -dx * sin_lat * cos_lon - dy * sin_lat * sin_lon + dz * cos_lat + da * prime * of.e2 * sin_lat * cos_lat / of.a + df * (meridian / ratio + prime * ratio) * sin_lat * cos_lat
    east = -dx * sin_lon + dy * cos_lon
    return lon + F.degrees(east / (prime * cos_lat)), lat + F.degrees(north / meridian)


def to_wgs84(lon: Column, lat: Column, datum: Column, region: Column | None = None) -> tuple[Column, Column]:
    """Positions on WGS 84 by the label of their datum (lonlat, nad27, nad83, wgs84) and, for NAD27, their region (conus if none is given).

    Another label and another region fail; a null label or coordinate gives null.
    """
    region = F.lit("conus") if region is None else region
    each = []
    for axis in range(3):
        value = F.raise_error(F.concat(F.lit("no shift of NAD27 for "), region)).cast("double")
        for name, shift in NAD27_SHIFTS.items():
            value = F.when(region == name, F.lit(shift[axis])).otherwise(value)
        each.append(value)
    moved = molodensky(lon, lat, tuple(each), CLARKE_1866)
    unknown = F.raise_error(F.concat(F.lit("no shift of datum "), datum)).cast("double")
    choose = lambda same, new: F.when(datum.isNull(), F.lit(None).cast("double")).when(datum.isin(*LIKE_WGS84), same).when(datum == "nad27", new).otherwise(unknown)
    return choose(lon, moved[0]), choose(lat, moved[1])


def shift_by_nodes(points: DataFrame, nodes: DataFrame, step: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points with lon and lat moved by shifts in degrees between the four nodes around them.

    ``nodes``: (i, j, dlon, dlat) at longitude i * step and latitude j * step. A point whose square lacks a node keeps its place; ``shifted`` tells which were moved. Squares are joined by their corner, so each node is looked up once for its square, not once for a point's corner.
    """
    square = nodes.select("i", "j", F.struct("dlon", "dlat").alias("sw"))
    for name, di, dj in (("se", 1, 0), ("nw", 0, 1), ("ne", 1, 1)):
        square = square.join(nodes.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.struct("dlon", "dlat").alias(name)), ["i", "j"])
    at = points.withColumns({"i": F.floor(F.col(lon) / step), "j": F.floor(F.col(lat) / step)})
    found = at.join(square, ["i", "j"], "left")
    u, v = F.col(lon) / step - F.col("i"), F.col(lat) / step - F.col("j")
    mean = lambda c: (1 - u) * (1 - v) * F.col(f"sw.{c}") + u * (1 - v) * F.col(f"se.{c}") + (1 - u) * v * F.col(f"nw.{c}") + u * v * F.col(f"ne.{c}")
    kept = [c for c in points.columns if c not in (lon, lat)]
    return found.select(*kept, (F.col(lon) + F.coalesce(mean("dlon"), F.lit(0.0))).alias(lon), (F.col(lat) + F.coalesce(mean("dlat"), F.lit(0.0))).alias(lat), F.col("sw").isNotNull().alias("shifted"))


def located(points: DataFrame, projection: Projection, region: str | None = None, lon: str = "lon", lat: str = "lat", datum: str = "datum") -> DataFrame:
    """points with x and y on a grid's projection, their datum's shift applied first."""
    moved = to_wgs84(F.col(lon), F.col(lat), F.col(datum), F.col(region) if region else None)
    x, y = project(*moved, projection)
    return points.withColumns({"x": x, "y": y})
