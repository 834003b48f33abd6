"""Totals, filters and reports over the long emissions table.

``emissions`` has record_key, pollutant, prefix, begin_ts, end_ts, rate and unit (rates per second), and usually sector and file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroflux.functions.units import seconds_between

SPECIES = ["pollutant", "prefix"]


def amount() -> Column:
    """Rate times the interval's seconds."""
    return F.col("rate") * seconds_between("begin_ts", "end_ts")


def total_unit(unit: str = "unit") -> Column:
    """Unit of a total: kg of kg/s."""
    return F.regexp_replace(unit, "/s$", "")


def filter_records(emissions: DataFrame, sources: DataFrame, predicate: Column) -> DataFrame:
    """Rows of the sources that meet the caller's predicate."""
    return emissions.join(sources.where(predicate).select("record_key").distinct(), "record_key", "left_semi")


def keep_pollutants(emissions: DataFrame, wanted: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) rows by pollutant name, prefixes aside; without a table of wanted names all are kept."""
    if wanted is None:
        return emissions, emissions.where(F.lit(False))
    names = wanted.select("pollutant").distinct()
    return emissions.join(F.broadcast(names), "pollutant", "left_semi"), emissions.join(F.broadcast(names), "pollutant", "left_anti")


def totals(emissions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total of each record and pollutant, or of the groups given."""
    return emissions.groupBy(*(by if by is not None else ["record_key"]), *SPECIES).agg(F.sum(amount()).alias("total"), F.min(total_unit()).alias("unit"))


def grand_totals(emissions: DataFrame) -> DataFrame:
    return totals(emissions, [])


def clipped(emissions: DataFrame, begin: Column, end: Column) -> DataFrame:
    """The parts of the intervals inside [begin, end); a window that ends before it begins fails."""
    begin = F.when(begin <= end, begin).otherwise(F.raise_error(F.lit("the window ends before it begins")).cast("timestamp"))
    inside = emissions.where((F.col("end_ts") > begin) & (F.col("begin_ts") < end))
    return inside.withColumn("begin_ts", F.greatest("begin_ts", begin)).withColumn("end_ts", F.least("end_ts", end))


def period_totals(emissions: DataFrame, begin: Column, end: Column, by: list[str] | None = None) -> DataFrame:
    return totals(clipped(emissions, begin, end), by)


def window_totals(emissions: DataFrame, windows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, pollutant, prefix, window_id, total, unit) for any number of windows (window_id, begin_ts, end_ts), which may overlap; as period_totals of each.

    An interval adds its rate at its begin and takes it back at its end. These changes are added up by group and instant, so a group has as many as it has distinct instants; in their order, running sums give the amount emitted up to each window's bounds, and a window's total is the difference. One pass over the emissions serves all windows; a group without an interval in a window has no row there. A window that ends before it begins fails.
    """
    keys = [*(by if by is not None else ["record_key"]), *SPECIES]
    seconds = lambda t: F.unix_micros(t) / 1e6
    checked = F.when(F.col("begin_ts") <= F.col("end_ts"), F.col("begin_ts")).otherwise(F.raise_error(F.lit("the window ends before it begins")).cast("timestamp"))
    ends = windows.select("window_id", F.explode(F.array(F.struct(checked.alias("at"), F.lit(-1.0).alias("sign")), F.struct(F.col("end_ts").alias("at"), F.lit(1.0).alias("sign")))).alias("e")).select("window_id", "e.at", "e.sign")
    # instants are counted from a window's bound, so that products of rates and seconds stay small
    origin = windows.agg(F.min("begin_ts")).scalar()
    # at one instant ends come first, then bounds, then begins: a window and an interval that only touch have nothing in common
    changes = F.array(F.struct(F.col("begin_ts").alias("at"), F.lit(2).alias("place"), F.col("rate").alias("change"), F.lit(1).alias("begun"), F.lit(0).alias("ended")), F.struct(F.col("end_ts").alias("at"), F.lit(0).alias("place"), (-F.col("rate")).alias("change"), F.lit(0).alias("begun"), F.lit(1).alias("ended")))
    events = emissions.where(F.col("begin_ts") < F.col("end_ts")).select(*keys, total_unit().alias("unit"), F.explode(changes).alias("c")).select(*keys, "unit", "c.*")
    events = events.groupBy(*keys, "at", "place").agg(F.sum("change").alias("change"), F.sum("begun").alias("begun"), F.sum("ended").alias("ended"), F.min("unit").alias("unit"))
    groups = events.groupBy(*keys).agg(F.min("unit").alias("unit"))
    bounds = groups.select("*", F.explode(ends.agg(F.collect_set("at")).scalar()).alias("at")).select(*keys, "unit", "at", F.lit(1).alias("place"), F.lit(0.0).alias("change"), F.lit(0).cast("long").alias("begun"), F.lit(0).cast("long").alias("ended"))
    order = Window.partitionBy(*keys).orderBy("at", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = seconds(F.col("at")) - seconds(origin)
    running = events.select(*bounds.columns).unionByName(bounds).withColumn("t", t)
    emitted = F.sum("change").over(order) * F.col("t") - F.sum(F.col("change") * F.col("t")).over(order)
    at_bounds = running.withColumns({"emitted": emitted, "begun": F.sum("begun").over(order), "ended": F.sum("ended").over(order)}).where("place = 1").drop("place", "change", "t")
    met = at_bounds.join(ends, "at").groupBy(*keys, "window_id").agg(F.sum(F.col("sign") * F.col("emitted")).alias("total"), F.sum(F.when(F.col("sign") > 0, F.col("begun")).otherwise(-F.col("ended"))).alias("_shared"), F.min("unit").alias("unit"))
    return met.where("_shared > 0").drop("_shared")


def file_totals(emissions: DataFrame) -> DataFrame:
    return totals(emissions, ["sector", "file"])


def kept_and_dropped(emissions: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """Totals of each file, with status kept or dropped, in one aggregation over the emissions."""
    if wanted is None:
        marked = emissions.withColumn("status", F.lit("kept"))
    else:
        names = wanted.select("pollutant").distinct().withColumn("_wanted", F.lit(True))
        # a list of names without an estimated size would send the emissions to as many tasks as there are pollutants
        marked = emissions.join(F.broadcast(names), "pollutant", "left").withColumn("status", F.when(F.col("_wanted"), "kept").otherwise("dropped"))
    return totals(marked, ["sector", "file", "status"])


def report_table(files: DataFrame, pollutants: list[str]) -> DataFrame:
    """One row for each file, one column for each pollutant in alphabetic order; prefixes of a name add up."""
    return files.groupBy("sector", "file").pivot("pollutant", sorted(pollutants)).agg(F.sum("total"))


def describe(df: DataFrame, descriptions: DataFrame, code: str) -> DataFrame:
    """df with the description of a code column, null where there is none."""
    return df.join(descriptions.select(F.col("code").alias(code), "description"), code, "left")


def units_per_pollutant(df: DataFrame) -> DataFrame:
    """Pollutants with more than one unit."""
    return df.groupBy(*SPECIES).agg(F.count_distinct("unit").alias("units")).where(F.col("units") > 1)


def assert_units(df: DataFrame) -> None:
    wrong = units_per_pollutant(df).first()
    if wrong is not None:
        raise ValueError(f"{wrong['prefix']}__{wrong['pollutant']} has {wrong['units']} units")


def consolidate(sources: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row for each record: attributes of the first row by (has no location, file, line)."""
    keys = keys or ["sector", "record_key"]
    order = F.struct((F.col("kind") == "supplemental").alias("late"), F.col("file"), F.col("line_id"))
    rest = [c for c in sources.columns if c not in keys]
    return sources.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def scale(emissions: DataFrame, factor: Column) -> DataFrame:
    """Rates times a column expression over the row."""
    return emissions.withColumn("rate", F.col("rate") * factor)
