"""Queries of temporal allocation: profiles over the inventory view, measured hours over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroflux.functions import codes, periods
from aeroflux.operators import temporal as tm
from aeroflux.plans.inventory_queries import J2, emissions_of
from aeroflux.plans.views import numbers, oracle, run, view
from aeroflux.sources.references import normalised

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


def profiles_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(view(spark, sf_dir, "t_raw"), ["kind", "code"], "fraction")


def temporal_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the hierarchical reference as profile codes."""
    ref, names = view(spark, sf_dir, "code_ref"), view(spark, sf_dir, "t_codes")
    count = names.count()
    numbered = ref.withColumn("n", (F.col("code") % count).cast("bigint"))
    return numbered.join(names.withColumnRenamed("code", "t_code"), "n").select("scc", "fips", F.col("t_code").alias("month_code"), F.col("t_code").alias("week_code"), F.col("t_code").alias("day_code"))


def hours_of(spark: SparkSession, sf_dir: str, day: str, count: int) -> DataFrame:
    """Hours from a day on, from the tables' own session."""
    start = F.lit(day).cast("timestamp")
    return tm.steps(spark.range(1).select(F.lit(1).alias("one")), start, start + F.make_dt_interval(F.lit(0), F.lit(count))).select("hour_ts")


CODE = f"SELECT m.scc, m.fips, t.code FROM ({J2}) m JOIN {{t_codes}} t ON t.n = m.code % (SELECT count(*) FROM {{t_codes}})"


@query(CODE.replace("t.code FROM", "t.code AS month_code, t.code AS day_code FROM"))
def temporal_assignment(spark, sf_dir):
    pairs = view(spark, sf_dir, "inv").select("scc", "fips").distinct()
    return tm.assign_temporal(pairs, temporal_ref(spark, sf_dir)).select("scc", "fips", "month_code", "day_code")


SHARES = "SELECT kind, code, slot, fraction / sum(fraction) OVER (PARTITION BY kind, code) AS fraction FROM {t_raw}"
LOCAL = "(h.hour_ts AT TIME ZONE 'UTC') AT TIME ZONE z.tz"


def factor_sql(rows: str) -> str:
    """t_factor of rows (code, local_ts, ...)."""
    return f"""SELECT x.*, m.fraction / (extract(day FROM last_day(x.local_ts)) / 7.0) * w.fraction * d.fraction AS t_factor FROM (SELECT r.*, CASE WHEN o.day IS NOT NULL THEN 6 ELSE (dayofweek(r.local_ts) + 6) % 7 END AS wd FROM ({rows}) r LEFT JOIN {{holidays}} o ON o.day = cast(r.local_ts AS date)) x
JOIN ({SHARES}) m ON m.kind = 'monthly' AND m.code = x.code AND m.slot = extract(month FROM x.local_ts) - 1
JOIN ({SHARES}) w ON w.kind = 'weekly' AND w.code = x.code AND w.slot = x.wd
JOIN ({SHARES}) d ON d.kind = CASE WHEN x.wd < 5 THEN 'diurnal weekday' ELSE 'diurnal weekend' END AND d.code = x.code AND d.slot = extract(hour FROM x.local_ts)"""


HOURS = f"(SELECT TIMESTAMP '1996-06-29' + INTERVAL 1 HOUR * i AS hour_ts FROM {numbers(96)}) h"
ZONES = "(VALUES ('America/New_York'), ('America/Chicago'), ('America/Denver'), ('America/Los_Angeles')) AS z(tz)"


@query(f"""SELECT code, tz, hour_ts, round(t_factor, 9) AS t_factor FROM ({factor_sql(f"SELECT c.code, z.tz, h.hour_ts, {LOCAL} AS local_ts FROM {{t_codes}} c CROSS JOIN {ZONES} CROSS JOIN {HOURS}")}) f""")
def temporal_factors(spark, sf_dir):
    start = F.lit("1996-06-29").cast("timestamp")
    zones = F.array(*map(F.lit, ("America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles")))
    rows = view(spark, sf_dir, "t_codes").select(*[F.col("code").alias(c) for c in ("month_code", "week_code", "day_code")], F.explode(zones).alias("tz"))
    rows = tm.steps(rows, start, start + F.make_dt_interval(F.lit(4)))
    rows = rows.withColumn("local_ts", tm.local_time(F.col("hour_ts"), F.col("tz")))
    found = tm.temporal_factor(rows, profiles_of(spark, sf_dir), view(spark, sf_dir, "holidays"))
    return found.select(F.col("month_code").alias("code"), "tz", "hour_ts", F.round("t_factor", 9).alias("t_factor"))


DAY = f"(SELECT TIMESTAMP '1996-06-30 12:00:00' + INTERVAL 1 HOUR * i AS hour_ts FROM {numbers(24)}) h"
PER_SHAPE = f"""SELECT i.fips, z.tz, c.code, i.pollutant, i.prefix, h.hour_ts, {LOCAL} AS local_ts, sum(i.tons * 907.185 / date_diff('second', i.begin_ts, i.end_ts) * date_diff('second', greatest(i.begin_ts, h.hour_ts), least(i.end_ts, h.hour_ts + INTERVAL 1 HOUR))) AS in_hour
FROM {{inv}} i JOIN {{zones}} z ON z.fips = i.fips JOIN ({CODE}) c ON c.scc = i.scc AND c.fips = i.fips JOIN {DAY} ON i.end_ts > h.hour_ts AND i.begin_ts < h.hour_ts + INTERVAL 1 HOUR GROUP BY ALL"""
HOURLY = f"SELECT fips, pollutant, prefix, hour_ts, in_hour * t_factor * date_diff('hour', date_trunc('year', hour_ts), date_trunc('year', hour_ts) + INTERVAL 1 YEAR) AS amount FROM ({factor_sql(PER_SHAPE)}) f"


def hourly_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of a day; records of one place, code, zone, pollutant and interval are added up before hours multiply them."""
    hours = hours_of(spark, sf_dir, "1996-06-30 12:00:00", 24)
    coded = tm.assign_temporal(tm.with_zone(tm.reaching(emissions_of(spark, sf_dir), hours), view(spark, sf_dir, "zones")), temporal_ref(spark, sf_dir))
    keys = ["fips", "tz", "month_code", "week_code", "day_code", "pollutant", "prefix", "begin_ts", "end_ts", "unit"]
    return tm.hourly_emissions(coded.groupBy(*keys).agg(F.sum("rate").alias("rate")), hours, profiles_of(spark, sf_dir), view(spark, sf_dir, "holidays"))


@query(f"SELECT pollutant, prefix, hour_ts, round(sum(amount), 2) AS amount FROM ({HOURLY}) y GROUP BY ALL")
def hourly_by_profile(spark, sf_dir):
    return hourly_of(spark, sf_dir).groupBy("pollutant", "prefix", "hour_ts").agg(F.round(F.sum("amount"), 2).alias("amount"))


YEAR = "(SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-12-31 23:00:00', INTERVAL 1 HOUR)) AS hour_ts) h"
BY_YEAR = f"""SELECT i.tz, i.code, i.pollutant, i.prefix, h.hour_ts, {LOCAL.replace("z.tz", "i.tz")} AS local_ts, sum(i.rate * date_diff('second', greatest(i.begin_ts, h.hour_ts), least(i.end_ts, h.hour_ts + INTERVAL 1 HOUR))) AS in_hour
FROM (SELECT z.tz, c.code, i.pollutant, i.prefix, i.begin_ts, i.end_ts, sum(i.tons * 907.185 / date_diff('second', i.begin_ts, i.end_ts)) AS rate FROM {{inv}} i JOIN {{zones}} z ON z.fips = i.fips JOIN ({CODE}) c ON c.scc = i.scc AND c.fips = i.fips WHERE i.end_ts > TIMESTAMP '1996-01-01' AND i.begin_ts < TIMESTAMP '1997-01-01' GROUP BY ALL) i
JOIN {YEAR} ON i.end_ts > h.hour_ts AND i.begin_ts < h.hour_ts + INTERVAL 1 HOUR GROUP BY ALL"""


@query(f"SELECT pollutant, prefix, hour_ts, round(sum(in_hour * t_factor * date_diff('hour', date_trunc('year', hour_ts), date_trunc('year', hour_ts) + INTERVAL 1 YEAR)), 2) AS amount FROM ({factor_sql(BY_YEAR)}) f GROUP BY ALL")
def year_of_hours(spark, sf_dir):
    """All 8,784 hours of a year by classes of hours."""
    hours, zones = hours_of(spark, sf_dir, "1996-01-01", 366 * 24), view(spark, sf_dir, "zones")
    coded = tm.assign_temporal(tm.with_zone(tm.reaching(emissions_of(spark, sf_dir), hours), zones), temporal_ref(spark, sf_dir))
    out = tm.hourly_totals(coded, hours, profiles_of(spark, sf_dir), view(spark, sf_dir, "holidays"), zones)
    return out.select("pollutant", "prefix", "hour_ts", F.round("amount", 2).alias("amount"))


SUMS = "SELECT oris, boiler, sum(cast(nox AS double)) AS nox_sum, sum(cast(so2 AS double)) AS so2_sum, sum(cast(gload AS double)) AS gload_sum, sum(cast(sload AS double)) AS sload_sum, sum(cast(heat AS double)) AS heat_sum FROM {cem_raw} GROUP BY oris, boiler HAVING sum(gload) > 0 OR sum(sload) > 0 OR sum(heat) > 0"


def cem_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "cem_raw").withColumn("hour_key", tm.hour_key(F.col("hour_std"))).drop("hour_std")


@query(f"SELECT oris, boiler, round(nox_sum, 2) AS nox, round(so2_sum, 2) AS so2, gload_sum AS gload, sload_sum AS sload, round(heat_sum, 1) AS heat FROM ({SUMS}) s")
def measured_sums(spark, sf_dir):
    s = tm.cem_sums(cem_of(spark, sf_dir))
    return s.select("oris", "boiler", F.round("nox_sum", 2).alias("nox"), F.round("so2_sum", 2).alias("so2"), F.col("gload_sum").alias("gload"), F.col("sload_sum").alias("sload"), F.round("heat_sum", 1).alias("heat"))


@query(f"""SELECT p.pol AS pollutant, c.oris, c.boiler, c.hour_std, round(CASE WHEN p.pol = 'NOX' AND s.nox_sum > 0 THEN c.nox / s.nox_sum WHEN p.pol = 'SO2' AND s.so2_sum > 0 THEN c.so2 / s.so2_sum WHEN s.heat_sum > 0 THEN c.heat / s.heat_sum WHEN s.sload_sum > 0 THEN c.sload / s.sload_sum ELSE c.gload / s.gload_sum END, 9) AS share
FROM {{cem_raw}} c JOIN ({SUMS}) s ON s.oris = c.oris AND s.boiler = c.boiler CROSS JOIN (VALUES ('NOX'), ('SO2'), ('VOC')) AS p(pol)""")
def measured_shares(spark, sf_dir):
    cem = view(spark, sf_dir, "cem_raw")
    rows = cem.join(tm.cem_sums(cem_of(spark, sf_dir)), ["oris", "boiler"]).withColumn("pollutant", F.explode(F.array(*map(F.lit, ("NOX", "SO2", "VOC")))))
    return rows.select("pollutant", "oris", "boiler", "hour_std", F.round(tm.cem_share(F.col("pollutant")), 9).alias("share"))


STANDARD = "h.hour_ts + INTERVAL 1 SECOND * least(date_diff('second', TIMESTAMP '2024-01-01', (TIMESTAMP '2024-01-01' AT TIME ZONE 'UTC') AT TIME ZONE k.tz), date_diff('second', TIMESTAMP '2024-07-01', (TIMESTAMP '2024-07-01' AT TIME ZONE 'UTC') AT TIME ZONE k.tz))"
UNITS = "SELECT s.source_id, s.oris, e.boiler, 'NOX' AS pollutant, s.temp_k * 86400 AS total, CASE s.nation % 2 WHEN 0 THEN 'America/New_York' ELSE 'Australia/Sydney' END AS tz FROM {stacks} s JOIN (SELECT DISTINCT oris, boiler FROM {cem_raw}) e ON e.oris = s.oris"
CEM_HOURS = f"(SELECT TIMESTAMP '2024-01-02' + INTERVAL 1 HOUR * i AS hour_ts FROM {numbers(24)}) h"


@query(f"""SELECT k.source_id, count(*) AS n, round(sum(k.total * coalesce(c.nox, 0) / s.nox_sum), 4) AS amount FROM ({UNITS}) k JOIN ({SUMS}) s ON s.oris = k.oris AND s.boiler = k.boiler CROSS JOIN {CEM_HOURS}
LEFT JOIN {{cem_raw}} c ON c.oris = k.oris AND c.boiler = k.boiler AND c.hour_std = {STANDARD} GROUP BY k.source_id""")
def hourly_by_measurement(spark, sf_dir):
    units = view(spark, sf_dir, "cem_raw").select("oris", "boiler").distinct()
    day = F.lit("2024-01-01").cast("timestamp")
    zone = F.when(F.col("nation") % 2 == 0, "America/New_York").otherwise("Australia/Sydney")
    rows = view(spark, sf_dir, "stacks").join(units, "oris").select("source_id", "oris", "boiler", F.lit("NOX").alias("pollutant"), zone.alias("tz"), day.alias("begin_ts"), periods.end_of(day, 12).alias("end_ts"), (F.col("temp_k") * 86400 / F.lit(366 * 86400.0)).alias("rate"), F.lit("kg/s").alias("unit"))
    hours = hours_of(spark, sf_dir, "2024-01-02", 24)
    return tm.hourly_by_cem(rows, hours, cem_of(spark, sf_dir)).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("amount"))


@query("""SELECT DISTINCT c.hour_std AS utc, (c.hour_std AT TIME ZONE 'UTC') AT TIME ZONE z.tz AS local_ts, c.hour_std + INTERVAL 1 SECOND * z.off AS standard_ts FROM {cem_raw} c CROSS JOIN (VALUES ('America/New_York', -18000), ('Australia/Sydney', 36000)) AS z(tz, off)""")
def local_and_standard_time(spark, sf_dir):
    rows = view(spark, sf_dir, "cem_raw").select(F.col("hour_std").alias("utc"), F.explode(F.array(F.lit("America/New_York"), F.lit("Australia/Sydney"))).alias("tz"))
    return rows.select("utc", tm.local_time(F.col("utc"), F.col("tz")).alias("local_ts"), tm.standard_time(F.col("utc"), F.col("tz")).alias("standard_ts")).distinct()
