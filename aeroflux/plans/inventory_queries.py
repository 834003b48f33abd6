"""Queries of codes, rates, totals, filters, matching and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroflux.functions import codes, periods, units
from aeroflux.operators import emissions as em
from aeroflux.operators import matching, scaling, surrogates
from aeroflux.plans.views import numbers, oracle, run, view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


def emissions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory view as an emissions table."""
    inv = view(spark, sf_dir, "inv")
    rate = units.period_rate(F.col("tons"), F.col("begin_ts"), F.col("end_ts"), units.to_kg("ton"))
    return inv.withColumn("rate", rate).withColumn("unit", F.lit("kg/s")).withColumn("record_key", codes.record_key("fips", "scc", "country"))


def two(name: str, digits: int = 2):
    return F.round(F.col(name), digits).alias(name)


@query("""SELECT sector, file, CASE WHEN pollutant IN ('VOC', 'NOX') THEN 'kept' ELSE 'dropped' END AS status, pollutant, prefix, round(sum(tons * 907.185), 1) AS total, 'kg' AS unit
FROM {inv} GROUP BY ALL""")
def kept_and_dropped(spark, sf_dir):
    wanted = spark.createDataFrame([("VOC",), ("NOX",)], "pollutant string")
    return em.kept_and_dropped(emissions_of(spark, sf_dir), wanted).select("sector", "file", "status", "pollutant", "prefix", two("total", 1), "unit")


@query("""SELECT fips || scc || '0' AS record_key, pollutant, prefix, round(sum(tons * 907.185), -2) AS total, 'kg' AS unit FROM {inv} GROUP BY ALL""")
def record_totals(spark, sf_dir):
    return em.totals(emissions_of(spark, sf_dir)).select("record_key", "pollutant", "prefix", two("total", -2), "unit")


@query("""SELECT fips || scc || '0' AS record_key, pollutant, prefix, round(sum(tons * 907.185 / date_diff('second', begin_ts, end_ts) * date_diff('second', greatest(begin_ts, TIMESTAMP '1996-01-10'), least(end_ts, TIMESTAMP '1996-06-20 12:00:00'))), -2) AS total, 'kg' AS unit
FROM {inv} WHERE end_ts > TIMESTAMP '1996-01-10' AND begin_ts < TIMESTAMP '1996-06-20 12:00:00' GROUP BY ALL""")
def period_totals(spark, sf_dir):
    begin, end = F.lit("1996-01-10").cast("timestamp"), F.lit("1996-06-20 12:00:00").cast("timestamp")
    return em.period_totals(emissions_of(spark, sf_dir), begin, end).select("record_key", "pollutant", "prefix", two("total", -2), "unit")


@query("""SELECT pollutant, prefix, round(sum(tons * 907.185), 0) AS total, 'kg' AS unit FROM {inv} GROUP BY ALL""")
def grand_totals(spark, sf_dir):
    return em.grand_totals(emissions_of(spark, sf_dir)).select("pollutant", "prefix", two("total", 0), "unit")


@query("""SELECT sector, file, pollutant, prefix, round(sum(tons * 907.185), 1) AS total, 'kg' AS unit FROM {inv} GROUP BY ALL""")
def file_totals(spark, sf_dir):
    return em.file_totals(emissions_of(spark, sf_dir)).select("sector", "file", "pollutant", "prefix", two("total", 1), "unit")


@query("""SELECT sector, file, round(sum(CASE WHEN pollutant = 'NOX' THEN tons * 907.185 END), 1) AS NOX, round(sum(CASE WHEN pollutant = 'PM2_5' THEN tons * 907.185 END), 1) AS PM2_5, round(sum(CASE WHEN pollutant = 'VOC' THEN tons * 907.185 END), 1) AS VOC
FROM {inv} GROUP BY sector, file""")
def report_table(spark, sf_dir):
    table = em.report_table(em.file_totals(emissions_of(spark, sf_dir)), ["VOC", "PM2_5", "NOX"])
    return table.select("sector", "file", *[two(c, 1) for c in ("NOX", "PM2_5", "VOC")])


@query("""SELECT pollutant, prefix, count(DISTINCT CASE WHEN l_linenumber = 7 THEN 'kmol/s' ELSE 'kg/s' END) AS units FROM {inv} GROUP BY ALL HAVING count(DISTINCT CASE WHEN l_linenumber = 7 THEN 'kmol/s' ELSE 'kg/s' END) > 1""")
def unit_conflicts(spark, sf_dir):
    mixed = emissions_of(spark, sf_dir).withColumn("unit", F.when(F.col("l_linenumber") == 7, "kmol/s").otherwise("kg/s"))
    return em.units_per_pollutant(mixed)


@query("""SELECT fips, pollutant, count(*) AS n, round(sum(tons * 907.185), -2) AS total FROM {inv} WHERE fips || scc || '0' IN (SELECT fips || scc || '0' FROM {inv} WHERE substr(fips, 1, 2) < '10') GROUP BY ALL""")
def record_filter(spark, sf_dir):
    rows = emissions_of(spark, sf_dir)
    kept = em.filter_records(rows, rows.select("record_key", "fips").distinct(), F.substring("fips", 1, 2) < "10")
    return kept.groupBy("fips", "pollutant").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(em.amount()), -2).alias("total"))


@query("""SELECT sector, record_key, arg_min(kind, o) AS kind, arg_min(file, o) AS file, arg_min(line_id, o) AS line_id FROM (
SELECT sector, fips || scc || '0' AS record_key, CASE WHEN l_linenumber % 3 = 0 THEN 'supplemental' ELSE 'point' END AS kind, file, l_orderkey * 10 + l_linenumber AS line_id,
  (CASE WHEN l_linenumber % 3 = 0 THEN '1' ELSE '0' END) || file || lpad(cast(l_orderkey * 10 + l_linenumber AS string), 18, '0') AS o FROM {inv}) t GROUP BY ALL""")
def consolidated_records(spark, sf_dir):
    rows = emissions_of(spark, sf_dir).select("sector", "record_key", F.when(F.col("l_linenumber") % 3 == 0, "supplemental").otherwise("point").alias("kind"), "file", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"))
    return em.consolidate(rows)


@query("""SELECT pollutant, sector, round(sum(tons * 907.185 * CASE WHEN pollutant = 'NOX' THEN 0.5 ELSE 2.0 END), 1) AS total FROM {inv} GROUP BY ALL""")
def scaled_totals(spark, sf_dir):
    scaled = em.scale(emissions_of(spark, sf_dir), F.when(F.col("pollutant") == "NOX", 0.5).otherwise(2.0))
    return scaled.groupBy("pollutant", "sector").agg(F.round(F.sum(em.amount()), 1).alias("total"))


@query("""SELECT raw, CASE WHEN length(raw) BETWEEN 1 AND 4 THEN lpad(raw, 5, '0') ELSE raw END AS fips, CASE WHEN length(raw) BETWEEN 2 AND 8 THEN rpad('00' || raw, 10, '0') ELSE raw END AS scc,
  CASE WHEN length(raw) < 6 THEN rpad(raw, 6, '0') ELSE raw END AS naics, CASE WHEN length(raw) < 4 THEN rpad(raw, 4, '0') ELSE raw END AS sic, count(*) AS n
FROM (SELECT cast(l_partkey * power(10, l_linenumber % 5) AS bigint) || '' AS raw FROM {lineitem}) t GROUP BY ALL""")
def padded_codes(spark, sf_dir):
    raw = run(spark, sf_dir, "SELECT concat('\" ', cast(cast(l_partkey * power(10, l_linenumber % 5) AS bigint) AS string), ' \"') AS raw FROM {lineitem}")
    c = F.col("raw")
    return raw.select(codes.text(c).alias("raw"), codes.fips(c).alias("fips"), codes.scc(c).alias("scc"), codes.naics(c).alias("naics"), codes.sic(c).alias("sic")).groupBy("raw", "fips", "scc", "naics", "sic").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT prefix, pollutant, count(*) AS n FROM {inv} GROUP BY ALL""")
def split_pollutants(spark, sf_dir):
    full = emissions_of(spark, sf_dir).select(codes.full_name().alias("full"))
    return full.select(codes.prefix(F.col("full")).alias("prefix"), codes.pollutant(F.col("full")).alias("pollutant")).groupBy("prefix", "pollutant").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 ELSE cast(p_size AS double) END AS value, CASE p_size % 4 WHEN 0 THEN 100.0 WHEN 1 THEN 0.0 ELSE cast(p_size AS double) END AS reff FROM {part}""")
def sentinel_numbers(spark, sf_dir):
    raw = run(spark, sf_dir, "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '-9' ELSE cast(p_size AS string) END AS t FROM {part}")
    return raw.select("p_partkey", codes.number(F.col("t")).alias("value"), codes.control(F.col("t"), 100.0).alias("reff"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN ann <= 0 AND avd >= 0 THEN avd * f / 86400 ELSE ann * f / 31536000 END, 9) AS rate FROM (
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 0.0 ELSE cast(l_extendedprice AS double) END AS ann, cast(l_quantity AS double) AS avd, CASE l_linenumber % 5 WHEN 0 THEN 907.185 WHEN 1 THEN 1000.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.001 ELSE 0.45359237 END AS f FROM {lineitem}) t""")
def annual_rates(spark, sf_dir):
    raw = run(spark, sf_dir, "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 0.0D ELSE cast(l_extendedprice AS double) END AS ann, cast(l_quantity AS double) AS avd FROM {lineitem}")
    factor = F.element_at(F.array(*[F.lit(units.to_kg(u)) for u in ("ton", "tonne", "kg", "g", "lb")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return raw.select("l_orderkey", "l_linenumber", F.round(units.annual_rate(F.col("ann"), F.col("avd"), factor), 9).alias("rate"))


@query("""SELECT o_orderkey, make_timestamp(y, m, 1, 0, 0, 0) AS month_begin, make_timestamp(y, m, 1, 0, 0, 0) + INTERVAL 1 MONTH AS month_end, make_timestamp(y, 1, 1, 0, 0, 0) + INTERVAL 12 MONTH AS year_end, m AS period,
  round(extract(day FROM make_timestamp(y, m, 1, 0, 0, 0) + INTERVAL 1 MONTH - INTERVAL 1 DAY) / 7.0, 6) AS weeks FROM (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m FROM {orders}) t""")
def period_intervals(spark, sf_dir):
    raw = run(spark, sf_dir, "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m FROM {orders}")
    begin, year = periods.begin_of("y", F.col("m")), periods.begin_of("y")
    end = periods.end_of(begin, 1)
    return raw.select("o_orderkey", begin.alias("month_begin"), end.alias("month_end"), periods.end_of(year, 12).alias("year_end"), periods.period_of(begin, end).cast("bigint").alias("period"), F.round(periods.weeks_in_month(begin), 6).alias("weeks"))


@query("""SELECT n_name, CASE n_nationkey % 7 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 WHEN 6 THEN 6 ELSE 0 END AS country FROM {nation}""")
def country_codes(spark, sf_dir):
    raw = run(spark, sf_dir, "SELECT n_name, n_nationkey % 7 AS d FROM {nation}")
    name = F.element_at(F.array(*[F.lit(x) for x in ("USA", "CANADA", "MEXICO", "CUBA", "BAHAMAS", "HAITI", "DOMINICANREPUBLIC")]), (F.col("d") + 1).cast("int"))
    digit = codes.country_of_digit(F.col("d").cast("string"))
    return raw.select("n_name", F.when(codes.country_of_name(name) == digit, digit).alias("country"))


@query("""SELECT source_id, round(height_m * 0.3048, 6) AS height_m, round(diam_m * 0.3048, 6) AS diam_m, round((temp_k + 459.67) * 5 / 9, 6) AS temp_k,
  round(vel_ms * 0.3048 * diam_m * 0.3048 * diam_m * 0.3048 * pi() / 4, 6) AS flow_m3s, round(vel_ms * 0.3048, 6) AS vel_ms, height_m = 0 AND vel_ms = 0 AS ground FROM {stacks}""")
def stack_parameters(spark, sf_dir):
    stacks = view(spark, sf_dir, "stacks")
    made = units.stack(F.col("height_m"), F.col("diam_m"), F.col("temp_k"), F.lit(0.0), F.col("vel_ms"))
    ground = units.ground_level(made["height_m"], made["vel_ms"])
    return stacks.select("source_id", *[F.round(c, 6).alias(k) for k, c in made.items()], ground.alias("ground"))


J1 = f"""SELECT fips, arg_min(code, i) AS code FROM (SELECT d.fips, r.code, s.i FROM (SELECT DISTINCT fips FROM {{inv}}) d CROSS JOIN {numbers(6)} JOIN (SELECT fips, min(code) AS code FROM {{code_ref}} GROUP BY fips) r ON r.fips = rpad(substr(d.fips, 1, 5 - s.i), 5, '0')) t GROUP BY fips"""


@query(J1)
def match_one_code(spark, sf_dir):
    ref = view(spark, sf_dir, "code_ref").groupBy("fips").agg(F.min("code").alias("code"))
    return matching.match_code(view(spark, sf_dir, "inv").select("fips").distinct(), "fips", ref, "fips", "code", required=True)


J2 = f"""SELECT scc, fips, arg_min(code, i * 10 + j) AS code FROM (SELECT d.scc, d.fips, r.code, a.i, b.j FROM (SELECT DISTINCT scc, fips FROM {{inv}}) d CROSS JOIN {numbers(11, "a(i)")} CROSS JOIN {numbers(6, "b(j)")}
JOIN {{code_ref}} r ON r.scc = rpad(substr(d.scc, 1, 10 - a.i), 10, '0') AND r.fips = rpad(substr(d.fips, 1, 5 - b.j), 5, '0')) t GROUP BY scc, fips"""


@query(J2)
def match_two_codes(spark, sf_dir):
    pairs = view(spark, sf_dir, "inv").select("scc", "fips").distinct()
    return matching.match_code_double(pairs, "scc", "fips", view(spark, sf_dir, "code_ref"), "scc", "fips", "code", required=True)


@query(f"SELECT m.code, i.pollutant, count(*) AS n, round(sum(i.tons), -1) AS tons FROM {{inv}} i JOIN ({J2}) m ON m.scc = i.scc AND m.fips = i.fips GROUP BY ALL")
def surrogate_assignment(spark, sf_dir):
    ref = view(spark, sf_dir, "code_ref").withColumn("country", F.lit(0))
    found = surrogates.assign_surrogate(view(spark, sf_dir, "inv"), ref)
    return found.groupBy("code", "pollutant").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("tons"), -1).alias("tons"))


@query(f"""SELECT scc, fips, arg_min(code, i) AS code FROM (SELECT d.scc, d.fips, r.code, s.i FROM (SELECT DISTINCT scc, fips FROM (SELECT substr(scc, 1, 7) || '000' AS scc, fips FROM {{inv}}) x) d CROSS JOIN {numbers(6)} JOIN {{code_ref}} r ON r.scc = d.scc AND r.fips = rpad(substr(d.fips, 1, 5 - s.i), 5, '0')) t GROUP BY scc, fips""")
def surrogate_exact_scc(spark, sf_dir):
    ref = view(spark, sf_dir, "code_ref").withColumn("country", F.lit(0))
    pairs = view(spark, sf_dir, "inv").select(F.lit(0).alias("country"), F.concat(F.substring("scc", 1, 7), F.lit("000")).alias("scc"), "fips").distinct()
    return surrogates.assign_surrogate(pairs, ref, exact=True, required=False).where(F.col("code").isNotNull()).select("scc", "fips", "code")


@query("""SELECT 0 AS country, scc, fips, cast(code AS string) AS code FROM {code_ref}""")
def merged_grid_refs(spark, sf_dir):
    ref = view(spark, sf_dir, "code_ref").select(F.lit(0).alias("country"), "scc", "fips", F.col("code").cast("string").alias("code"))
    return surrogates.merge_grid_refs(ref.where("fips < '20000'"), ref)


@query("""SELECT scc, arg_max(code, line_id) AS code, max(line_id) AS line_id FROM (SELECT (l_orderkey * 10 + l_linenumber) * 100000 + cast(fips AS int) AS line_id, scc, fips AS code FROM {inv}) t GROUP BY scc""")
def last_line_wins(spark, sf_dir):
    rows = view(spark, sf_dir, "inv").select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("fips").cast("int")).alias("line_id"), "scc", F.col("fips").alias("code"))
    return matching.last_line(rows, ["scc"]).select("scc", "code", "line_id")


TREND = """SELECT state, tier1, pol, CASE WHEN coalesce(b, 0) = 0 THEN 0 ELSE coalesce(t, 0) / b END AS factor FROM (SELECT state, tier1, pol, sum(CASE WHEN yr = 1995 THEN emis END) AS b, sum(CASE WHEN yr = 1997 THEN emis END) AS t FROM {trend} WHERE yr IN (1995, 1997) GROUP BY ALL) x"""


@query(f"SELECT state, tier1, pol, round(factor, 6) AS factor FROM ({TREND}) f")
def trend_factors(spark, sf_dir):
    return scaling.trend_factors(view(spark, sf_dir, "trend"), 1995, 1997).withColumn("factor", F.round("factor", 6))


@query(f"""SELECT i.pollutant, substr(i.fips, 1, 2) AS state, round(sum(i.tons * 907.185 * CASE WHEN substr(i.fips, 1, 2) IN ('72', '78') THEN 1.0 ELSE coalesce(f.factor, 1.0) END), 0) AS total
FROM {{inv}} i LEFT JOIN ({TREND}) f ON f.state = substr(i.fips, 1, 2) AND f.tier1 = cast(1 + cast(substr(i.scc, 10, 1) AS int) % 5 AS string) AND f.pol = CASE i.pollutant WHEN 'PM2_5' THEN 'PM25' ELSE i.pollutant END GROUP BY ALL""")
def scaled_by_trend(spark, sf_dir):
    rows = emissions_of(spark, sf_dir)
    tier1 = rows.select("scc").distinct().withColumn("tier1", (F.substring("scc", 10, 1).cast("int") % 5 + 1).cast("string"))
    scaled = scaling.apply_trends(rows, tier1, scaling.trend_factors(view(spark, sf_dir, "trend"), 1995, 1997))
    return scaled.groupBy("pollutant", F.substring("fips", 1, 2).alias("state")).agg(F.round(F.sum(em.amount()), 0).alias("total"))


@query("""SELECT pollutant, n.n_name AS description, round(sum(i.tons), 1) AS tons FROM {inv} i LEFT JOIN {nation} n ON lpad(cast(n.n_nationkey AS string), 2, '0') = substr(i.fips, 1, 2) GROUP BY ALL""")
def described_totals(spark, sf_dir):
    names = run(spark, sf_dir, "SELECT lpad(cast(n_nationkey AS string), 2, '0') AS code, n_name AS description FROM {nation}")
    found = em.describe(view(spark, sf_dir, "inv").withColumn("state", F.substring("fips", 1, 2)), names, "state")
    return found.groupBy("pollutant", "description").agg(F.round(F.sum("tons"), 1).alias("tons"))


WEEKS = "(SELECT i AS window_id, TIMESTAMP '1996-01-01 06:00:00' + i * INTERVAL 7 DAY AS b, TIMESTAMP '1996-01-08 06:00:00' + i * INTERVAL 7 DAY AS e FROM " + numbers(52) + ")"


@query(f"SELECT w.window_id, i.pollutant, i.prefix, i.sector, round(sum(i.tons * 907.185 / date_diff('second', i.begin_ts, i.end_ts) * date_diff('second', greatest(i.begin_ts, w.b), least(i.end_ts, w.e))) / 1e6, 0) AS total, 'kg' AS unit FROM {{inv}} i JOIN {WEEKS} w ON i.end_ts > w.b AND i.begin_ts < w.e GROUP BY ALL")
def weekly_totals(spark, sf_dir):
    """52 weeks in one pass over the emissions, in thousands of tonnes."""
    begin = F.timestamp_add("DAY", (F.col("id") * 7).cast("int"), F.lit("1996-01-01 06:00:00").cast("timestamp"))
    weeks = spark.range(52).select(F.col("id").cast("int").alias("window_id"), begin.alias("begin_ts"), F.timestamp_add("DAY", F.lit(7), begin).alias("end_ts"))
    return em.window_totals(emissions_of(spark, sf_dir), weeks, ["sector"]).withColumn("total", F.round(F.col("total") / 1e6, 0))
