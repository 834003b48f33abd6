"""Hours of a year's emissions: profiles by month, weekday and hour, holidays, and measured stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroflux.functions import periods
from aeroflux.functions.units import seconds_between
from aeroflux.operators.emissions import SPECIES, amount, total_unit
from aeroflux.operators.matching import match_code, match_code_double

# Pollutant names (lower case) that measured NOx and SO2 stand for.
NOX_NAMES, SOX_NAMES = ["nox", "no2", "no"], ["so2", "sox"]


def steps(df: DataFrame, start: Column, end: Column, step_hours: int = 1, name: str = "hour_ts") -> DataFrame:
    """df with a row for each step from start to before end; the first step always counts."""
    step = F.make_dt_interval(F.lit(0), F.lit(step_hours))
    return df.withColumn(name, F.explode(F.sequence(start, F.greatest(start, end - step), step)))


def assign_temporal(sources: DataFrame, t_ref: DataFrame, exact: bool = False) -> DataFrame:
    """sources with month_code, week_code and day_code by SCC and FIPS; exact takes the whole SCC only. No match fails."""
    codes = ["month_code", "week_code", "day_code"]
    ref = t_ref.select("scc", "fips", F.struct(*codes).alias("t_codes"))
    if exact:
        found = match_code(sources, "fips", ref, "fips", "t_codes", by=["scc"], required=True)
    else:
        found = match_code_double(sources, "scc", "fips", ref, "scc", "fips", "t_codes", required=True)
    return found.select(*[c for c in found.columns if c != "t_codes"], *[F.col(f"t_codes.{c}").alias(c) for c in codes])


def with_zone(df: DataFrame, zones: DataFrame) -> DataFrame:
    """df with tz by FIPS; a place without a zone fails."""
    found = df.join(F.broadcast(zones.select("fips", "tz")), "fips", "left")
    return found.withColumn("tz", F.coalesce("tz", F.raise_error(F.concat(F.lit("no time zone for "), F.col("fips"))).cast("string")))


def local_time(utc: Column, tz: Column) -> Column:
    return F.from_utc_timestamp(utc, tz)


def standard_time(utc: Column, tz: Column) -> Column:
    """Local time without daylight saving: the smaller of the offsets of 1 January and 1 July."""
    first = F.date_trunc("year", utc)
    july = first + F.make_ym_interval(F.lit(0), F.lit(6))
    offset = F.least(*[F.timestamp_diff("SECOND", t, F.from_utc_timestamp(t, tz)) for t in (first, july)])
    return F.timestamp_add("SECOND", offset, utc)


def profile_arrays(profiles: DataFrame) -> DataFrame:
    """(code, monthly, weekly, weekday, weekend): a code's shares by slot, null for a kind that it doesn't have."""
    columns = {"monthly": ("monthly", 12), "weekly": ("weekly", 7), "weekday": ("diurnal weekday", 24), "weekend": ("diurnal weekend", 24)}
    shares = {name: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("slot", "fraction")))).alias(name) for name, (kind, _) in columns.items()}
    slots = lambda name, count: F.when(F.size(name) > 0, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.col(name)[i]))
    return profiles.groupBy("code").agg(*shares.values()).select("code", *(slots(name, count).alias(name) for name, (_, count) in columns.items()))


def with_profiles(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """df with the shares of its codes as arrays, joined once a row, so that hours only look them up."""
    table = profile_arrays(profiles)
    out = df.join(table.select(F.col("code").alias("month_code"), F.col("monthly").alias("_m")), "month_code", "left")
    out = out.join(table.select(F.col("code").alias("week_code"), F.col("weekly").alias("_w")), "week_code", "left")
    return out.join(table.select(F.col("code").alias("day_code"), F.col("weekday").alias("_d"), F.col("weekend").alias("_e")), "day_code", "left")


def weekday_of(local: Column, holiday: Column) -> Column:
    """0 for Monday to 6 for Sunday; a holiday is a Sunday."""
    return F.when(holiday, F.lit(6)).otherwise(F.weekday(local))


def with_holiday(df: DataFrame, holidays: DataFrame, local: str) -> DataFrame:
    days = holidays.select(F.col("day").alias("_day")).distinct().withColumn("_holiday", F.lit(True))
    return df.withColumn("_day", F.to_date(local)).join(days, "_day", "left").drop("_day")


def temporal_factor(df: DataFrame, profiles: DataFrame, holidays: DataFrame, local: str = "local_ts") -> DataFrame:
    """df (with month_code, week_code, day_code and a local time) with t_factor.

    Month's share by weeks in the month, by the weekday's share (Monday is 0, a holiday counts as Sunday), by the hour's share of a weekday or weekend. A missing code fails. A df that comes from with_profiles already keeps its arrays.
    """
    t = F.col(local)
    out = with_holiday(df if "_m" in df.columns else with_profiles(df, profiles), holidays, local)
    weekday = weekday_of(t, F.col("_holiday"))
    diurnal = F.when(weekday < 5, F.get("_d", F.hour(t))).otherwise(F.get("_e", F.hour(t)))
    missing = F.raise_error(F.concat(F.lit("no temporal profile for "), F.concat_ws("/", "month_code", "week_code", "day_code"))).cast("double")
    factor = F.get("_m", F.month(t) - 1) / periods.weeks_in_month(t) * F.get("_w", weekday) * diurnal
    return out.withColumn("t_factor", F.coalesce(factor, missing)).drop("_holiday", "_m", "_w", "_d", "_e")


def span_of(hours: DataFrame) -> tuple | None:
    """First and last hour, two values; None without hours."""
    span = hours.agg(F.min("hour_ts").alias("lo"), F.max("hour_ts").alias("hi")).first()
    return None if span["lo"] is None else (span["lo"], span["hi"])


def reaching(emissions: DataFrame, hours: DataFrame) -> DataFrame:
    """Rows whose interval reaches into any of the hours' span: the others need no codes and no factors."""
    span = span_of(hours)
    if span is None:
        return emissions.where(F.lit(False))
    end = F.lit(span[1]).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(1))
    return emissions.where((F.col("begin_ts") < end) & (F.col("end_ts") > F.lit(span[0]).cast("timestamp")))


def in_hours(emissions: DataFrame, hours: DataFrame) -> DataFrame:
    """emissions x hours where an interval reaches into the hour [hour_ts, hour_ts + 1 h), with ``in_hour`` = rate x shared seconds.

    Hours join on the days an interval covers, so the join is an equi-join.
    """
    day = lambda t: F.to_date(t)
    last = F.col("end_ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(1).cast("decimal(18,6)"))
    span = span_of(hours)
    if span is None:
        return emissions.join(hours, F.lit(False)).withColumn("in_hour", F.lit(None).cast("double"))
    begin, end = F.greatest(day("begin_ts"), day(F.lit(span[0]))), F.least(day(last), day(F.lit(span[1])))
    daily = emissions.where(begin <= end).withColumn("_day", F.explode(F.sequence(begin, end)))
    joined = daily.join(hours.withColumn("_day", day("hour_ts")), "_day").drop("_day")
    hour_end = F.col("hour_ts") + F.make_dt_interval(F.lit(0), F.lit(1))
    shared = F.least("end_ts", hour_end), F.greatest("begin_ts", "hour_ts")
    return joined.where((F.col("end_ts") > F.col("hour_ts")) & (F.col("begin_ts") < hour_end)).withColumn("in_hour", F.col("rate") * seconds_between(shared[1], shared[0]))


def hourly_by_profile(emissions: DataFrame, hours: DataFrame, profiles: DataFrame, holidays: DataFrame) -> DataFrame:
    """emissions (with codes and tz) in each hour: the hour's part, times the temporal factor, times the hours of the UTC year."""
    rows = in_hours(with_profiles(emissions, profiles), hours).withColumn("local_ts", local_time(F.col("hour_ts"), F.col("tz")))
    factored = temporal_factor(rows, profiles, holidays)
    return factored.withColumn("amount", F.col("in_hour") * F.col("t_factor") * periods.hours_in_year(F.col("hour_ts"))).withColumn("unit", total_unit()).drop("in_hour", "local_ts")


def calendar(hours: DataFrame, zones: DataFrame, holidays: DataFrame) -> DataFrame:
    """(tz, hour_ts, month, weekday, hour, weeks, year_hours): the class of each hour in each zone of ``zones``; as many rows as hours times zones."""
    known = zones.agg(F.collect_set("tz")).scalar()
    rows = hours.select("hour_ts").distinct().withColumn("tz", F.explode(known)).withColumn("local_ts", local_time(F.col("hour_ts"), F.col("tz")))
    t = F.col("local_ts")
    out = with_holiday(rows, holidays, "local_ts")
    return out.select("tz", "hour_ts", (F.month(t) - 1).alias("month"), weekday_of(t, F.col("_holiday")).alias("weekday"), F.hour(t).alias("hour"), periods.weeks_in_month(t).alias("weeks"), periods.hours_in_year(F.col("hour_ts")).alias("year_hours"))


def hourly_totals(emissions: DataFrame, hours: DataFrame, profiles: DataFrame, holidays: DataFrame, zones: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, pollutant, prefix, hour_ts, amount, unit): sums over records of hourly_by_profile, for any number of hours.

    Hours fall into classes of month, weekday and hour of the day. Rates are added up by codes, zone and interval; profiles multiply these sums once a class, and codes are added up again; only those sums meet the hours of their class. So work follows classes (2,016 a year), not records times hours.
    """
    by = by or []
    keys = [*by, *SPECIES, "unit", "tz", "begin_ts", "end_ts"]
    sums = with_profiles(reaching(emissions, hours).groupBy(*keys, "month_code", "week_code", "day_code").agg(F.sum("rate").alias("rate")), profiles)
    missing = F.raise_error(F.concat(F.lit("no temporal profile for "), F.concat_ws("/", "month_code", "week_code", "day_code"))).cast("double")
    whole = F.col("_m").isNotNull() & F.col("_w").isNotNull() & F.col("_d").isNotNull() & F.col("_e").isNotNull()
    sums = sums.withColumn("rate", F.when(whole, F.col("rate")).otherwise(missing))
    # local months that the interval can touch: a day around it covers every zone
    first, last = F.date_sub(F.to_date("begin_ts"), 1), F.date_add(F.to_date("end_ts"), 1)
    months = F.array_distinct(F.transform(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.make_ym_interval(F.lit(0), F.lit(1))), lambda d: F.month(d) - 1))
    day_class = lambda w: F.when(w < 5, F.col("_d")).otherwise(F.col("_e"))
    by_month = sums.withColumn("month", F.explode(months)).withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
    shares = by_month.withColumn("rate", F.col("rate") * F.get("_m", F.col("month")) * F.get("_w", F.col("weekday"))).select(*keys, "month", "weekday", "rate", F.posexplode(day_class(F.col("weekday"))).alias("hour", "_share"))
    classes = shares.groupBy(*keys, "month", "weekday", "hour").agg(F.sum(F.col("rate") * F.col("_share")).alias("rate"))
    hour_end = F.col("hour_ts") + F.make_dt_interval(F.lit(0), F.lit(1))
    met = classes.join(calendar(hours, zones, holidays), ["tz", "month", "weekday", "hour"]).where((F.col("end_ts") > F.col("hour_ts")) & (F.col("begin_ts") < hour_end))
    seconds = seconds_between(F.greatest("begin_ts", "hour_ts"), F.least("end_ts", hour_end))
    amount_ = F.col("rate") * seconds / F.col("weeks") * F.col("year_hours")
    return met.groupBy(*by, *SPECIES, "hour_ts", total_unit().alias("unit")).agg(F.sum(amount_).alias("amount"))


MEASURES = ["nox", "so2", "gload", "sload", "heat"]


def cem_sums(cem: DataFrame) -> DataFrame:
    """Sums of each unit, in double; units without any load, steam or heat are left out."""
    sums = cem.groupBy("oris", "boiler").agg(*[F.sum(F.col(m).cast("double")).alias(f"{m}_sum") for m in MEASURES])
    return sums.where((F.col("gload_sum") > 0) | (F.col("sload_sum") > 0) | (F.col("heat_sum") > 0))


def cem_share(pollutant: Column) -> Column:
    """Share of the year's total in a measured hour; rows hold an hour's measures (null if missing) and the sums.

    NOx and SO2 by their masses where those were measured, else by heat, steam or gross load, whichever the unit reports first.
    """
    name = F.lower(pollutant)
    share = lambda m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) / F.nullif(F.col(f"{m}_sum"), F.lit(0.0))
    return F.when(name.isin(NOX_NAMES) & (F.col("nox_sum") > 0), share("nox")).when(name.isin(SOX_NAMES) & (F.col("so2_sum") > 0), share("so2")).when(F.col("heat_sum") > 0, share("heat")).when(F.col("sload_sum") > 0, share("sload")).otherwise(share("gload"))


def hour_key(standard: Column) -> Column:
    return F.date_format(standard, "yyMMdd HH")


def hourly_by_cem(emissions: DataFrame, hours: DataFrame, cem: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """emissions (with oris, boiler and tz) of measured units: the record's total times the hour's share; hours without data have none.

    Hours are a table by zone, with the key under which measurements of that hour stand: keys are made once a zone and hour. A unit's measurements meet the hours first, once a unit, zone and hour, whatever the number of records; records then meet the hours of their unit. Records are brought together by their own columns before they are added up, so that no task holds all records of a file.
    """
    sums = cem_sums(cem) if sums is None else sums
    by = [c for c in emissions.columns if c not in ("begin_ts", "end_ts", "rate", "unit")]
    whole = emissions.repartition(*by).groupBy(*by).agg(F.sum(amount()).alias("total"), F.min(total_unit()).alias("unit"))
    zones = emissions.agg(F.collect_set("tz")).scalar()
    times = hours.select("hour_ts").distinct().withColumn("tz", F.explode(zones)).withColumn("hour_key", hour_key(standard_time(F.col("hour_ts"), F.col("tz"))))
    place = ["oris", "boiler", "tz"]
    places = emissions.select(*place).distinct()
    measured = places.join(sums, ["oris", "boiler"]).join(F.broadcast(times), "tz").join(cem, ["oris", "boiler", "hour_key"], "left")
    return whole.join(measured, place).withColumn("amount", F.col("total") * cem_share(F.col("pollutant"))).select(*by, "hour_ts", "amount", "unit")


def hourly_emissions(emissions: DataFrame, hours: DataFrame, profiles: DataFrame, holidays: DataFrame, cem: DataFrame | None = None) -> DataFrame:
    """All hours: measured units by their data, the others by profiles."""
    keep = [c for c in emissions.columns if c not in ("begin_ts", "end_ts", "rate", "unit", "month_code", "week_code", "day_code")]
    if cem is None:
        return hourly_by_profile(emissions, hours, profiles, holidays).select(*keep, "hour_ts", "amount", "unit")
    sums = cem_sums(cem)
    measured = emissions.join(sums.select("oris", "boiler"), ["oris", "boiler"], "left_semi")
    others = emissions.join(sums.select("oris", "boiler"), ["oris", "boiler"], "left_anti")
    drop = [c for c in ("month_code", "week_code", "day_code") if c in emissions.columns]
    return hourly_by_profile(others, hours, profiles, holidays).select(*keep, "hour_ts", "amount", "unit").unionByName(hourly_by_cem(measured.drop(*drop), hours, cem, sums).select(*keep, "hour_ts", "amount", "unit"))
