"""Spatial surrogates: shares of an area's emissions in grid cells, from shapes and weights or from given tables.

Shapes have rings of points (array<array<struct<x,y>>>); holes are wound against their shells. To make a surrogate, the plane is tiled with the grid's cells, also beyond the grid; input and weight shapes are cut to tiles by a tree of halved blocks, whose wholly covered ones need no geometry, and meet by an equi-join on the tile. The size of a common part is the exact sum over signed triangles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeroflux.operators import rings as geo
from aeroflux.operators.grids import Grid, Projection, extent, projected_rings
from aeroflux.operators.matching import match_code, match_code_double


# --- assignment -----------------------------------------------------------------------------------------------------


def merge_grid_refs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both references; a key with two codes fails."""
    merged = a.unionByName(b).groupBy("country", "scc", "fips").agg(F.min("code").alias("code"), F.count_distinct("code").alias("_n"))
    checked = F.when(F.col("_n") == 1, F.col("code")).otherwise(F.raise_error(F.concat(F.lit("conflicting codes for "), F.concat_ws("/", "scc", "fips"))).cast("string"))
    return merged.select("country", "scc", "fips", checked.alias("code"))


def assign_surrogate(sources: DataFrame, grid_ref: DataFrame, exact: bool = False, required: bool = True) -> DataFrame:
    """sources with their surrogate code: hierarchical in SCC and FIPS, or the whole SCC and hierarchical in FIPS."""
    if exact:
        return match_code(sources, "fips", grid_ref, "fips", "code", by=["country", "scc"], required=required)
    return match_code_double(sources, "scc", "fips", grid_ref, "scc", "fips", "code", by=["country"], required=required)


def with_spec(sources: DataFrame, specs: DataFrame) -> DataFrame:
    """sources with their surrogate's backups by (country, code); a code without a specification fails."""
    found = sources.join(specs.select("country", "code", F.col("name").alias("srg_name"), "backups"), ["country", "code"], "left")
    missing = F.raise_error(F.concat(F.lit("no surrogate "), F.col("code"))).cast("string")
    return found.withColumn("srg_name", F.coalesce("srg_name", missing))


def with_backups(shapes: DataFrame, surrogates: DataFrame) -> DataFrame:
    """For each (shape_id, names in order) the first surrogate that has any weight for the shape; null if none."""
    sums = surrogates.groupBy("name", "shape_id").agg(F.sum("weight").alias("w")).where(F.col("w") > 0).select("name", "shape_id")
    tries = shapes.select("*", F.posexplode("names").alias("_order", "name"))
    best = tries.join(sums, ["name", "shape_id"]).groupBy("shape_id", "names").agg(F.min_by("name", "_order").alias("chosen"))
    return shapes.join(best, ["shape_id", "names"], "left")


# --- given surrogate tables ------------------------------------------------------------------------------------------


def normalise_surrogate(surrogate: DataFrame) -> DataFrame:
    """Cells of each shape added up; shapes with no weight are absent; a shape that the grid covers is scaled to 1."""
    keys = ["srg_code", "grid", "shape_id"]
    cells = surrogate.groupBy(*keys, "row", "col").agg(F.sum("weight").alias("weight"), F.bool_and("covered").alias("covered"))
    total = F.sum("weight").over(Window.partitionBy(*keys))
    return cells.withColumn("_total", total).where(F.col("_total") != 0).withColumn("weight", F.when(F.col("covered"), F.col("weight") / F.col("_total")).otherwise(F.col("weight"))).drop("_total")


def resolve_merges(specs: dict[str, list[tuple[float, str]]], depth: int = 16) -> dict[str, dict[str, float]]:
    """Multipliers of plain surrogates for each merged one; merges may nest. A configuration of some hundred names."""

    def plain(name: str, level: int) -> dict[str, float]:
        if level > depth:
            raise ValueError(f"surrogate {name} merges itself")
        out: dict[str, float] = {}
        for factor, part in specs.get(name) or [(1.0, name)]:
            for base, inner in ({part: 1.0} if not specs.get(part) else plain(part, level + 1)).items():
                out[base] = out.get(base, 0.0) + factor * inner
        return out

    return {name: plain(name, 0) for name, parts in specs.items() if parts}


def merge_surrogates(surrogates: DataFrame, merges: dict[str, dict[str, float]]) -> DataFrame:
    """Rows (srg_code = merged name) of sums of multiplied surrogates; the covered flag is that of the first part that has the shape."""
    rows = [(merged, part, float(factor), k) for merged, parts in merges.items() for k, (part, factor) in enumerate(parts.items())]
    table = surrogates.sparkSession.createDataFrame(rows, "merged string, srg_code string, factor double, place int")
    joined = surrogates.join(table, "srg_code")
    first = F.min_by("covered", "place").over(Window.partitionBy("merged", "grid", "shape_id"))
    return joined.withColumn("covered", first).groupBy(F.col("merged").alias("srg_code"), "grid", "shape_id", "row", "col", "covered").agg(F.sum(F.col("weight") * F.col("factor")).alias("weight")).select("srg_code", "grid", "shape_id", "row", "col", "weight", "covered")


def adjust(cells: DataFrame, factor: DataFrame) -> DataFrame:
    """Cell weights times a gridded factor; cells without a factor have 0."""
    joined = cells.join(factor.select("grid", "row", "col", "factor"), ["grid", "row", "col"], "left")
    return joined.withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).drop("factor")


# --- making surrogates ----------------------------------------------------------------------------------------------


def attribute_filter(c: Column, values: list[str], equal: bool, compat: bool = False) -> Column:
    """COL=a,b keeps the values, COL!=a,b the others. ``compat``: != keeps what differs from any of the values."""
    if equal:
        return c.isin(values)
    return F.exists(F.array(*map(F.lit, values)), lambda v: v != c) if compat else ~c.isin(values)


def overlaps_extent(grid: Grid) -> Column:
    return (F.col("xmax") >= grid.x0) & (F.col("xmin") <= grid.x0 + grid.nx * grid.dx) & (F.col("ymax") >= grid.y0) & (F.col("ymin") <= grid.y0 + grid.ny * grid.dy)


def input_shapes(shapes: DataFrame, grid: Grid, projection: Projection | None = None, tolerance: float = 0.0) -> DataFrame:
    """(shape_id, rings, covered) of the shapes near the grid; rows of one identifier become one shape."""
    moved = shapes if projection is None else shapes.withColumn("rings", projected_rings(F.col("rings"), projection))
    moved = simplify(moved, tolerance)
    near = moved.select("shape_id", "rings", *extent(F.col("rings"))).where(overlaps_extent(grid))
    inside = (F.col("xmin") >= grid.x0) & (F.col("xmax") <= grid.x0 + grid.nx * grid.dx) & (F.col("ymin") >= grid.y0) & (F.col("ymax") <= grid.y0 + grid.ny * grid.dy)
    return near.groupBy("shape_id").agg(F.flatten(F.collect_list("rings")).alias("rings"), F.bool_and(inside).alias("covered"))


def weight_of(values: list[Column], factors: list[float], kind: Column, size: Column) -> Column:
    """A weight shape's weight for each unit of size: positive parts of its columns times factors, by area or length; points as they are.

    Without columns it is 1. A polygon without area is skipped (null), a line without length and a weight that isn't finite or is negative fail.
    """
    if not values:
        return F.lit(1.0)
    total = sum((F.greatest(v.cast("double"), F.lit(0.0)) * f for v, f in zip(values, factors)), F.lit(0.0))
    line = F.when(size > 0, total / size).otherwise(F.raise_error(F.lit("a weight line has no length")).cast("double"))
    weight = F.when(kind == "point", total).when(kind == "line", line).otherwise(F.when(size > 0, total / size))
    bad = F.isnan(weight) | (weight == math.inf) | (weight < 0)
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a weight is not finite or is negative")).cast("double")).otherwise(weight)


def weight_shapes(shapes: DataFrame, grid: Grid, columns: list[str], factors: list[float], keep: Column | None = None, projection: Projection | None = None, tolerance: float = 0.0) -> DataFrame:
    """(weight_id, kind, rings, weight) of the weight shapes near the grid whose weight is over 0."""
    kept = shapes if keep is None else shapes.where(keep)
    moved = kept if projection is None else kept.withColumn("rings", projected_rings(F.col("rings"), projection))
    near = simplify(moved, tolerance).select("*", *extent(F.col("rings"))).where(overlaps_extent(grid))
    weighed = near.withColumn("weight", weight_of([F.col(c) for c in columns], factors, F.col("kind"), size_of(F.col("kind"), F.col("rings"))))
    return weighed.where(F.col("weight") > 0).select("weight_id", "kind", "rings", "weight")


def size_of(kind: Column, rings: Column) -> Column:
    """Area of polygons, length of lines, number of points."""

    def along(ring: Column, f, close: bool) -> Column:
        last = F.size(ring) - (1 if close else 2)
        steps = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.lit(0.0), lambda total, i: total + f(F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))))

    total = lambda f, close: F.aggregate(F.transform(rings, lambda ring: along(ring, f, close)), F.lit(0.0), lambda a, b: a + b)
    area = F.abs(total(lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]) / 2, True))
    length = total(lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2.0) + F.pow(b["y"] - a["y"], 2.0)), False)
    return F.when(kind == "polygon", area).when(kind == "line", length).otherwise(F.size(F.flatten(rings)).cast("double"))


def simplify(shapes: DataFrame, tolerance: float) -> DataFrame:
    """Rings without points that lie within the tolerance of the line through their neighbours; 0 leaves all."""
    if tolerance <= 0:
        return shapes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.arange(batch.num_rows)
            yield with_rings(batch, rows, geo.thinned(geo.read(batch.column("rings")), tolerance))

    return shapes.mapInArrow(run, shapes.schema)


def with_rings(batch: pa.RecordBatch, rows: np.ndarray, rings: geo.Rings) -> pa.RecordBatch:
    """These rows of the batch with these rings."""
    place = batch.schema.get_field_index("rings")
    field = batch.schema.field(place)
    return batch.take(pa.array(rows)).set_column(place, field, geo.write(rings, rows, field.type))


def geometry_of(shapes: DataFrame) -> T.DataType:
    return shapes.schema["rings"].dataType


def by_kind(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    for kind in pc.unique(batch.column("kind")).to_pylist():
        yield kind, batch.filter(pc.equal(batch.column("kind"), kind))


def tiles(shapes: DataFrame, grid: Grid, key: str) -> DataFrame:
    """(key, kind, row, col, full, size, rings): the plane's tiles that shapes touch, with the part of the shape in each and its area, length or number of points; rows and columns may lie off the grid.

    Tiles that a polygon covers wholly are found as blocks of any size and carry a flag and no rings; blocks become tiles only here, as rows of a few numbers.
    """
    names = ["row0", "row1", "col0", "col1"]
    fields = [*shapes.select(key, "kind").schema.fields, *(T.StructField(n, T.IntegerType()) for n in names), T.StructField("full", T.BooleanType()), T.StructField("size", T.DoubleType()), shapes.schema["rings"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("rings")
            for kind, part in by_kind(batch):
                found = geo.cover(kind, geo.read(part.column("rings")), grid.x0, grid.y0, grid.dx, grid.dy)
                size = np.where(found.full, grid.dx * grid.dy, geo.sizes(kind, found.rings, len(found.row)))
                rows = pa.array(found.row)
                by_block = geo.in_order(found.rings)
                columns = [part.column(key).take(rows), part.column("kind").take(rows), *(pa.array(found.bounds[:, k], pa.int32()) for k in range(4)), pa.array(found.full), pa.array(size), geo.write(by_block, np.arange(len(found.row)), batch.schema.field(place).type)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    blocks = shapes.select(key, "kind", "rings").mapInArrow(run, T.StructType(fields))
    each = lambda low, high: F.explode(F.sequence(F.col(low), F.col(high) - 1))
    cells = blocks.withColumn("row", each("row0", "row1")).withColumn("col", each("col0", "col1"))
    return cells.select(key, "kind", "row", "col", "full", "size", F.when(~F.col("full"), F.col("rings")).alias("rings"))


def create_surrogate(inputs: DataFrame, weights: DataFrame, grid: Grid, srg_code: str) -> DataFrame:
    """(srg_code, grid, shape_id, row, col, weight, covered): each cell's share of the weight inside an input shape.

    The denominator counts all of the shape, also off the grid; cells without weight are absent. A tile full of parts is split by Spark's own skew handling of the join.
    """
    parts = tiles(inputs.withColumn("kind", F.lit("polygon")), grid, "shape_id").select("shape_id", "row", "col", F.col("full").alias("whole"), F.col("size").alias("held"), F.col("rings").alias("shape"))
    others = tiles(weights, grid, "weight_id").join(weights.select("weight_id", "weight"), "weight_id")
    # a tile that one side covers wholly has the other side's size; only where both have an outline do outlines go on
    simple = F.when(F.col("whole"), F.col("size")).when(F.col("full"), F.col("held"))
    outline = lambda c: F.when(~F.col("whole") & ~F.col("full"), F.col(c)).otherwise(F.array().cast(geometry_of(weights))).alias(c)
    met = parts.join(others, ["row", "col"]).select("shape_id", "row", "col", "kind", "weight", simple.alias("simple"), outline("rings"), outline("shape"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, part in by_kind(batch):
                common = geo.common_sizes(kind, geo.read(part.column("rings")), geo.read(part.column("shape")), part.num_rows)
                simple = part.column("simple").to_numpy(zero_copy_only=False)
                sizes = np.where(np.isnan(simple), common, simple) * part.column("weight").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column("shape_id"), part.column("row"), part.column("col"), pa.array(sizes)], names=["shape_id", "row", "col", "size"])

    schema = T.StructType([*met.select("shape_id", "row", "col").schema.fields, T.StructField("size", T.DoubleType())])
    sizes = met.mapInArrow(run, schema)
    cells = sizes.groupBy("shape_id", "row", "col").agg(F.sum("size").alias("size"))
    whole = F.sum("size").over(Window.partitionBy("shape_id"))
    on_grid = F.col("row").between(0, grid.ny - 1) & F.col("col").between(0, grid.nx - 1)
    shares = cells.withColumn("weight", F.col("size") / F.nullif(whole, F.lit(0.0))).where(on_grid & (F.col("weight") > 0))
    return shares.join(inputs.select("shape_id", "covered"), "shape_id").select(F.lit(srg_code).alias("srg_code"), F.lit(grid.name).alias("grid"), "shape_id", "row", "col", "weight", "covered")
