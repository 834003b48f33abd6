"""Gridded totals and hours, and their sinks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroflux.operators.emissions import SPECIES, amount, clipped, total_unit
from aeroflux.operators.grids import Grid
from aeroflux.operators.met import plume_layer, plume_layer_by_hour
from aeroflux.sources import hourframes

CELL = ["grid", "row", "col"]


class Outputter(Protocol):
    """What a model's output needs: a layer for every row, and a place to write to."""

    def layer(self, df: DataFrame) -> DataFrame: ...

    def write(self, df: DataFrame) -> None: ...


@dataclass(frozen=True)
class ParquetOutput:
    """An Outputter of Parquet by grid and date; points get the layer of their plume in the air ``met``, whose columns of air are named by ``by``."""

    path: str
    met: DataFrame
    by: tuple[str, ...]
    kemit: int

    def layer(self, df: DataFrame) -> DataFrame:
        return plume_layer(df, self.met, list(self.by), self.kemit)

    def write(self, df: DataFrame) -> None:
        write_gridded(df, self.path)


@dataclass(frozen=True)
class FrameOutput:
    """An Outputter of files of so many steps for each domain, by the hourframes data source; values are per area of the domain's cells.

    ``met`` has a column of air for each cell and frame; points are layered by the latest frame of their hour. ``unit_metres`` is the length of the domains' unit.
    """

    path: str
    met: DataFrame
    by: tuple[str, ...]
    kemit: int
    domains: tuple[Grid, ...]
    start: str
    steps_per_file: int
    step_hours: int = 1
    unit_metres: float = 1000.0

    def layer(self, df: DataFrame) -> DataFrame:
        return plume_layer_by_hour(df, self.met, list(self.by), self.kemit)

    def write(self, df: DataFrame) -> None:
        hourframes.write_frames(over_areas(df, self.domains, self.unit_metres), self.path, self.start, self.steps_per_file, self.step_hours)


def over_areas(df: DataFrame, domains: Sequence[Grid], metres: float = 1000.0) -> DataFrame:
    """df with values over the cell area of their domain, whose steps are in units of so many metres; a domain that isn't given fails."""
    value, unit = F.raise_error(F.concat(F.lit("no domain "), F.col("grid"))).cast("double"), F.when(F.col("unit") == "kmol", "mol/km2/h").otherwise("ug/m2/s")
    for g in domains:
        value = F.when(F.col("grid") == g.name, per_area(F.col("value"), F.col("unit"), g.dx * metres / 1000, g.dy * metres / 1000)).otherwise(value)
    return df.withColumns({"value": value, "unit": unit})


def gridded_output(out: Outputter, areas: DataFrame, area_cells: DataFrame, area_on: list[str], points: DataFrame, point_cells: DataFrame, point_on: list[str]) -> DataFrame:
    """Hours of areas (layer 0) and of points (in their plumes' layers) in the cells of their grids, written through ``out`` and returned."""
    both = gridded_hourly(areas, area_cells, area_on).unionByName(gridded_hourly(out.layer(points), point_cells, point_on))
    whole = both.groupBy("hour_ts", "grid", "layer", "row", "col", *SPECIES).agg(F.sum("value").alias("value"), F.min("unit").alias("unit"))
    out.write(whole)
    return whole


def _keyed(cells: DataFrame, on: list[str]) -> DataFrame:
    """(on, grid, row, col, weight) behind a generator: else Spark infers from equal keys that what cells were filtered by (their shapes' geometry) holds for the emissions too, and works it out for each of their rows."""
    return cells.select(F.explode(F.array(F.struct(*on, *CELL, "weight"))).alias("_cell")).select("_cell.*")


def spatialize(emissions: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """emissions x the cells of their shape or point: ``on`` names the columns that cells are keyed by."""
    return emissions.join(_keyed(cells, on), on)


def gridded_totals(emissions: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """(grid, row, col, pollutant, prefix, value, unit) of whole totals. Records of one shape are added up before they spread over its cells."""
    whole = emissions.groupBy(*on, *SPECIES).agg(F.sum(amount()).alias("total"), F.min(total_unit()).alias("unit"))
    return spatialize(whole, cells, on).groupBy(*CELL, *SPECIES).agg(F.sum(F.col("total") * F.col("weight")).alias("value"), F.min("unit").alias("unit"))


def gridded_period(emissions: DataFrame, cells: DataFrame, on: list[str], begin: Column, end: Column) -> DataFrame:
    return gridded_totals(clipped(emissions, begin, end), cells, on)


def gridded_hourly(hourly: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """(hour_ts, grid, layer, row, col, pollutant, prefix, value, unit) from amounts in hours; without a layer it is 0.

    Amounts of one shape, hour, layer and pollutant are added up before they spread over cells.
    """
    if "layer" not in hourly.columns:
        hourly = hourly.withColumn("layer", F.lit(0))
    whole = hourly.groupBy(*on, "hour_ts", "layer", *SPECIES).agg(F.sum("amount").alias("amount"), F.min("unit").alias("unit"))
    # the estimate of rows in hours is that of the rows before hours multiplied them, and either side may be large: neither is broadcast
    spread = whole.hint("merge").join(_keyed(cells, on), on)
    return spread.groupBy("hour_ts", "grid", "layer", "row", "col", *SPECIES).agg(F.sum(F.col("amount") * F.col("weight")).alias("value"), F.min("unit").alias("unit"))


def per_area(value: Column, unit: Column, dx_km: float, dy_km: float) -> Column:
    """An hour's gas (kmol) as mol/km2/h, its particles (kg) as ug/m2/s; other units fail."""
    gas = value * 1000.0 / (dx_km * dy_km)
    particle = value * 1e9 / (dx_km * 1000.0) / (dy_km * 1000.0) / 3600.0
    return F.when(unit == "kmol", gas).when(unit == "kg", particle).otherwise(F.raise_error(F.concat(F.lit("no output unit for "), unit)).cast("double"))


def write_gridded(df: DataFrame, path: str, hour: str = "hour_ts") -> None:
    """Parquet by grid and date; rows of a date are brought together, so that a date is few files."""
    dated = df.withColumn("date", F.to_date(hour))
    dated.repartition("grid", "date").sortWithinPartitions(hour).write.mode("overwrite").partitionBy("grid", "date").parquet(path)


def wkt(rings: Column) -> Column:
    """Polygon text of rings, closed."""
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.concat_ws(", ", F.transform(F.concat(r, F.slice(r, 1, 1)), point)), F.lit(")"))
    return F.concat(F.lit("POLYGON ("), F.concat_ws(", ", F.transform(rings, ring)), F.lit(")"))


def cell_rings() -> Column:
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.array(F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax")))


def export_grid(cells: DataFrame) -> DataFrame:
    """(grid, row, col, geometry)."""
    rings = F.col("rings") if "rings" in cells.columns else cell_rings()
    return cells.select(*CELL, wkt(rings).alias("geometry"))


def export_surrogate(surrogate: DataFrame, cells: DataFrame) -> DataFrame:
    """(row, col, shape_id, weight, covered as T or F, geometry)."""
    return surrogate.join(export_grid(cells), CELL).select("row", "col", "shape_id", "weight", F.when(F.col("covered"), "T").otherwise("F").alias("covered"), "geometry")


def write_table(df: DataFrame, path: str, tabs: bool = False) -> None:
    """A table with its header as comma- or tab-separated text."""
    df.write.mode("overwrite").csv(path, sep="\t" if tabs else ",", header=True)
