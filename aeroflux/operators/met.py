"""Meteorological columns and plume rise over the long table met(grid, hour, row, col, k, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroflux.operators.asof import latest_time

# Fixed values of the formulas.
GRAVITY, BASE_PRESSURE, EXPONENT, BASE_THETA, UNSTABLE = 9.80665, 101300.0, 0.2854, 300.0, 0.005


def _column(by: list[str]):
    return Window.partitionBy(*by).orderBy("k")


def layer_heights(met: DataFrame, by: list[str], geopotential: Column) -> DataFrame:
    """met with height: geopotential above the lowest level, by gravity."""
    ground = F.first(geopotential).over(_column(by))
    return met.withColumn("height", (geopotential - ground) / GRAVITY)


def wind_speed(u: DataFrame, v: DataFrame, by: list[str]) -> DataFrame:
    """(by, row, col, k, wind) at cell centres from face values: u has one column more, v one row more."""
    keys = [*by, "row", "col", "k"]
    u_mean = u.join(u.withColumn("col", F.col("col") - 1).withColumnRenamed("u", "u_next"), keys).withColumn("uc", (F.col("u") + F.col("u_next")) / 2)
    v_mean = v.join(v.withColumn("row", F.col("row") - 1).withColumnRenamed("v", "v_next"), keys).withColumn("vc", (F.col("v") + F.col("v_next")) / 2)
    return u_mean.select(*keys, "uc").join(v_mean.select(*keys, "vc"), keys).select(*keys, F.sqrt(F.col("uc") * F.col("uc") + F.col("vc") * F.col("vc")).alias("wind"))


def stability(met: DataFrame, by: list[str], theta: Column, pressure: Column, height: Column) -> DataFrame:
    """met with temp, dtheta_dz (0 at the lowest level, null over a level without thickness), s1 and stable: potential temperature's change to the level below.

    A pressure or temperature that isn't over 0 fails.
    """
    w = _column(by)
    pressure = F.when(pressure > 0, pressure).otherwise(F.raise_error(F.lit("pressure must be over 0")).cast("double"))
    exner = F.pow(pressure / BASE_PRESSURE, F.lit(EXPONENT))
    warm = F.when(theta + BASE_THETA > 0, theta + BASE_THETA).otherwise(F.raise_error(F.lit("potential temperature must be over 0 K")).cast("double"))
    out = met.withColumn("temp", warm * exner)
    gradient = (theta - F.lag(theta).over(w)) / F.nullif(height - F.lag(height).over(w), F.lit(0.0))
    out = out.withColumn("dtheta_dz", F.when(F.lag(theta).over(w).isNull(), F.lit(0.0)).otherwise(gradient))
    return out.withColumn("s1", F.col("dtheta_dz") / F.col("temp") * exner).withColumn("stable", F.col("dtheta_dz") >= UNSTABLE)


def plume_rise(height: Column, diameter: Column, temperature: Column, velocity: Column, air: Column, wind: Column, stable: Column, s1: Column) -> Column:
    """Rise above the stack's top in metres, with the customary bounds on the stack's values."""
    h, d = F.greatest(height, F.lit(0.0)), F.greatest(diameter, F.lit(0.0))
    v, w = F.least(F.greatest(velocity, F.lit(0.0)), F.lit(40.0)), F.greatest(wind, F.lit(1.0))
    t = F.greatest(temperature, air + 10)
    momentum = (t - air < 50) & (v > w) & (v > 10)
    buoyancy = (t - air) * GRAVITY / t * v * d * d / 4
    calm = F.pow(buoyancy / F.nullif(s1, F.lit(0.0)), F.lit(1 / 3)) * 29.0 / F.pow(w, F.lit(1 / 3))
    rough = F.pow(buoyancy * h * h, F.lit(1 / 3)) * 7.4 / w
    return F.when(momentum, d * F.pow(v, F.lit(1.4)) / F.pow(w, F.lit(1.4))).when(stable, calm).otherwise(rough)


def tops(met: DataFrame, by: list[str], kemit: int) -> DataFrame:
    """(by, _top, _level): the top of each layer from 0 to kemit - 2, with the layer's k and air; the last but one layer has no top. ``air`` is null where a column lacks the layer itself."""
    air = F.struct("temp", "wind", "stable", "s1")
    below = F.lag(F.struct("k", air.alias("air"))).over(_column(by))
    level = F.struct((F.col("k") - 1).cast("int").alias("k"), F.when(below["k"] == F.col("k") - 1, below["air"]).alias("air"))
    bounded = met.select(*by, F.col("height").alias("_top"), level.alias("_level")).where(F.col("_level.k").between(0, kemit - 2) & F.col("_top").isNotNull())
    last = met.where(F.col("k") == kemit - 2).select(*by, F.lit(float("inf")).alias("_top"), F.struct(F.col("k").cast("int").alias("k"), air.alias("air")).alias("_level"))
    return bounded.unionByName(last)


def layers_over(points: DataFrame, tops: DataFrame, by: list[str], height: str, name: str) -> DataFrame:
    """points with ``name``, the lowest of their column's layers whose top is at or over a height, null if none is. A height that isn't a number fails.

    Heights and tops of a column lie one behind the other in one sorted window, from the highest down, so the work follows their number, not their product; tops needn't grow with k.
    """
    number = F.when(F.isnan(height), F.raise_error(F.lit("the plume's height is not a number")).cast("double")).otherwise(F.col(height))
    level = tops.schema["_level"].dataType
    own = points.select("*", number.alias("_top"), F.lit(None).cast(level).alias("_level"), F.lit(True).alias("_point"))
    both = own.unionByName(tops.withColumn("_point", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy(F.col("_top").desc(), "_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(name, F.when(F.col("_top").isNotNull(), F.min("_level").over(order))).where("_point")
    return found.select(*points.columns, name)


#: What a plume's layer depends on, beside the air.
STACK = ["height_m", "diam_m", "temp_k", "vel_ms"]


def plume_layer(stacks: DataFrame, met: DataFrame, by: list[str], kemit: int) -> DataFrame:
    """stacks (with the columns ``by`` of their cell) with layer: the stack's own layer gives the air, the rise gives the layer; off the grid it is 0.

    Equal stacks of a cell are worked out once. Stacks meet layers by sorted windows, so no row holds a whole column of air.
    """
    if kemit <= 1:
        return stacks.withColumn("layer", F.lit(0))
    stack = F.greatest("height_m", F.lit(0.0))
    columns = met.groupBy(*by).agg(F.max_by("height", "k").alias("_highest"))
    # Spark's estimate of stacks in hours is that of the stacks alone, so it would send them to every executor: hints keep these joins shuffled
    own = stacks.select(*by, *STACK).distinct().hint("merge").join(columns, by)
    too_high = F.raise_error(F.concat(F.lit("a stack is higher than the layers: "), stack.cast("string"))).cast("double")
    own = own.withColumn("_height", F.when(stack > F.col("_highest"), too_high).otherwise(stack)).drop("_highest")
    layers = tops(met, by, kemit)
    air = F.col("_own.air")
    rise = plume_rise(F.col("height_m"), F.col("diam_m"), F.col("temp_k"), F.col("vel_ms"), air["temp"], air["wind"], air["stable"], air["s1"])
    raised = layers_over(own, layers, by, "_height", "_own").where(F.col("_own.air").isNotNull()).select(*by, *STACK, (stack + rise).alias("_height"))
    placed = layers_over(raised, layers, by, "_height", "_over").select(*by, *STACK, F.coalesce("_over.k", F.lit(kemit - 2)).alias("_layer"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}")) for c in [*by, *STACK]]
    joined = stacks.alias("s").join(placed.alias("l"), same, "left")
    return joined.select(*(f"s.{c}" for c in stacks.columns if c != "layer"), F.coalesce("l._layer", F.lit(0)).alias("layer"))


def plume_layer_by_hour(stacks: DataFrame, met: DataFrame, by: list[str], kemit: int, hour: str = "hour_ts", frame: str = "frame_ts", oldest_hours: float | None = None) -> DataFrame:
    """stacks in hours with the layer of their plume in the air of each hour: that of the latest frame of their cell at or before it.

    A layer depends on the stack and the frame, so it is worked out once for each of those and not once an hour. Off the grid, before the first frame, and where the frame is older than ``oldest_hours``, the layer is 0.
    """
    if kemit <= 1:
        return stacks.withColumn("layer", F.lit(0))
    found = latest_time(stacks, met, by, hour, frame, "_frame")
    if oldest_hours is not None:
        found = found.withColumn("_frame", F.when(F.timestamp_diff("SECOND", F.col("_frame"), F.col(hour)) <= oldest_hours * 3600, F.col("_frame")))
    timed = stacks.hint("merge").join(found, [*by, hour], "left")
    # before the first frame there is no column of air to meet, so the layer is 0
    return plume_layer(timed, met.withColumn("_frame", F.col(frame)), [*by, "_frame"], kemit).drop("_frame")
