"""Queries of ingest: driver tables are written as lines of inventory and reference files, parsed, and held against SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroflux.functions import codes
from aeroflux.operators import surrogates as sg
from aeroflux.plans.views import numbers, oracle, view
from aeroflux.sources import inventory as inv
from aeroflux.sources import references as ref

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

TON = 907.185


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


def lines_of(rows: DataFrame, value: Column, file: str, header: list[str], key: str = "id", month: int = 0) -> DataFrame:
    """The lines of one file: comments in its first block, then a line for each row."""
    top = rows.sparkSession.createDataFrame([(i, text) for i, text in enumerate(header)], "line_id long, value string").withColumn("block", F.lit(0).cast("long"))
    line_id = (F.col(key) + 100).cast("long")
    # behind a generator a line is put together once; else every filter of lines is moved in front of it and puts it together again. It is put together in front of the generator, by a projection that is compiled apart, as a generator's own argument is not compiled. Blocks stay in front, so that headers don't put together other blocks' lines
    data = rows.select(codes.apart(line_id).alias("line_id"), F.floor(line_id / 100_000).cast("long").alias("block"), F.array(value).alias("_line"))
    data = data.select("line_id", "block", F.explode("_line").alias("value"))
    return top.unionByName(data).select(F.lit("all").alias("sector"), F.lit(file).alias("file"), F.lit(month).alias("month"), "block", "line_id", "value")


def text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def delimited(count: int, **at: Column | str) -> Column:
    """A comma-separated line of so many fields; ``_5`` names the sixth. Commas around empty fields are one text."""
    parts, commas = [], 0
    for i in range(count):
        if f"_{i}" in at:
            parts += ([F.lit("," * commas)] if commas else []) + [text(at[f"_{i}"])]
            commas = 0
        commas += i < count - 1
    return F.concat(*parts, F.lit("," * commas))


def fixed(*parts: tuple[int, Column | str]) -> Column:
    """A line of fields of fixed width."""
    return F.concat(*[F.rpad(text(c), width, " ") for width, c in parts])


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


# columns of ``raw`` that stand in the lines: FIPS with spaces for inner zeros, short SCCs, -9 and blanks for missing amounts
FIPS, SCC, ANNUAL, AVERAGE, CEFF, REFF = "fips_text", "scc_text", "annual", "average", "ceff_text", "reff_text"
PLACE5, LONG_SCC, WHOLE_PRICE, WHOLE_QUANTITY = "place5", "long_scc", "whole_price", "whole_quantity"
TEXTS = {
    FIPS: "replace(place, '0', ' ')", SCC: "CASE WHEN n % 2 = 0 THEN '2280' || part6 ELSE '22' || part6 END", ANNUAL: "CASE WHEN n = 1 THEN '-9' WHEN n = 2 THEN '' ELSE cast(price AS string) END", AVERAGE: "cast(quantity AS string)",
    CEFF: "CASE WHEN n = 3 THEN '' WHEN n = 4 THEN '-9' ELSE cast(n AS string) END", REFF: "CASE WHEN n = 5 THEN '' ELSE cast(supp AS string) END", PLACE5: "lpad(place, 5, '0')", LONG_SCC: "'2280' || part6", WHOLE_PRICE: "cast(floor(price) AS string)", WHOLE_QUANTITY: "cast(floor(quantity) AS string)",
}

CODES = "id + 100 AS line_id, lpad(place, 5, '0') AS fips, CASE WHEN n % 2 = 0 THEN '2280' || part6 ELSE '0022' || part6 END AS scc, 0 AS country, CASE pol WHEN 'EXH__VOC' THEN 'VOC' ELSE pol END AS pollutant, CASE pol WHEN 'EXH__VOC' THEN 'EXH' ELSE '' END AS prefix"
TOTAL = f"round(CASE WHEN n > 2 THEN price * {TON} ELSE quantity * {TON} / 86400.0 * 31536000.0 END, 2)"
CONTROLS = "CASE WHEN n IN (3, 4) THEN 0.0 ELSE cast(n AS double) END AS ceff, CASE WHEN n = 5 THEN 100.0 ELSE cast(supp AS double) END AS reff"


def parsed(lines: DataFrame, *more: str) -> DataFrame:
    """Records of the lines with their intervals' number and total in kg."""
    records, _ = inv.parse(lines, TON)
    seconds = lambda i: i["rate"] * F.timestamp_diff("SECOND", i["begin_ts"], i["end_ts"])
    total = F.aggregate("intervals", F.lit(0.0), lambda t, i: t + seconds(i))
    return records.select("line_id", "fips", "scc", "country", "pollutant", "prefix", F.round(total, 2).alias("total"), F.size("intervals").alias("parts"), *[F.expr(m) for m in more])


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "raw").withColumns({name: F.expr(text) for name, text in TEXTS.items()})


HEAD = ["#COUNTRY US", "#YEAR 2005"]


@query(f"SELECT {CODES}, {TOTAL} AS total, 1 AS parts, '1234' AS sic, '123400' AS naics, '02' AS mact, '03' AS source_type, {CONTROLS}, 50.0 AS rpen FROM {{raw}}")
def ingest_orl_nonpoint(spark, sf_dir):
    line = delimited(37, _0=FIPS, _1=SCC, _2=F.lit("1234"), _3=F.lit("02"), _4=F.lit('" 03 "'), _5=F.lit("1234"), _6=quoted(F.col("pol")), _7=ANNUAL, _8=AVERAGE, _9=CEFF, _10=REFF, _11=F.lit("50"))
    return parsed(lines_of(raw(spark, sf_dir), line, "nonpoint", ["#ORL", *HEAD]), "economic.sic", "economic.naics", "control.mact", "source_type", "control.ceff", "control.reff", "control.rpen")


@query(f"""SELECT {CODES}, {TOTAL} AS total, 1 AS parts, lpad(place, 5, '0') || CASE WHEN n % 2 = 0 THEN '2280' || part6 ELSE '0022' || part6 END || '0' || 'P' || supp || n || 'S1' AS record_key, 'A plant, Inc' AS plant, '7' AS oris, 'B1' AS boiler, 'lonlat' AS datum,
-70.0 - n AS lon, 30.0 + n AS lat, round(n * 3.048, 6) AS height_m, round((100 + n + 459.67) / 1.8, 6) AS temp_k, round(CASE WHEN n % 2 = 0 THEN 3.048 * pi() / 4 * power(n * 0.3048, 2) ELSE 50 * power(0.3048, 3) END, 6) AS flow_m3s, round(CASE WHEN n % 2 = 0 THEN 3.048 ELSE 50 * power(0.3048, 3) / (pi() / 4 * power(n * 0.3048, 2)) END, 6) AS vel_ms FROM {{raw}}""")
def ingest_orl_point(spark, sf_dir):
    """Flow and velocity repair each other: even lines state the velocity, odd ones the flow."""
    n = F.col("n")
    even = n % 2 == 0
    line = delimited(70, _0=FIPS, _1=F.concat(F.lit("P"), "supp"), _2=n, _3=F.lit("S"), _4=F.lit("1"), _5=F.lit('"A plant, Inc"'), _6=SCC, _9=n * 10, _10=n, _11=100 + n, _12=F.when(even, "0").otherwise("50"), _13=F.when(even, "10").otherwise("0"), _17=F.lit("L"), _18=-70 - n, _19=30 + n, _21=F.col("pol"), _22=ANNUAL, _23=AVERAGE, _24=CEFF, _25=REFF, _29=F.lit("7"), _30=F.lit("B1"))
    return parsed(lines_of(raw(spark, sf_dir), line, "point", ["#ORL", *HEAD]), "record_key", "point.plant", "point.oris", "point.boiler", "point.datum", "point.lon", "point.lat", "round(point.height_m, 6) AS height_m", "round(point.temp_k, 6) AS temp_k", "round(point.flow_m3s, 6) AS flow_m3s", "round(point.vel_ms, 6) AS vel_ms")


@query(f"SELECT {CODES}, {TOTAL} AS total, 1 AS parts, '08' AS source_type, {CONTROLS}, 100.0 AS rpen FROM {{raw}}")
def ingest_orl_nonroad(spark, sf_dir):
    line = delimited(30, _0=FIPS, _1=SCC, _2=F.col("pol"), _3=ANNUAL, _4=AVERAGE, _5=CEFF, _6=REFF, _8=F.lit("08"))
    return parsed(lines_of(raw(spark, sf_dir), line, "nonroad", ["#ORL", *HEAD]), "source_type", "control.ceff", "control.reff", "control.rpen")


@query(f"SELECT {CODES}, {TOTAL} AS total, 1 AS parts, '05' AS source_type, {CONTROLS}, 100.0 AS rpen FROM {{raw}}")
def ingest_orl_mobile(spark, sf_dir):
    line = delimited(16, _0=FIPS, _1=SCC, _2=F.col("pol"), _3=ANNUAL, _4=AVERAGE, _5=F.lit("05"), _9=CEFF, _10=REFF)
    return parsed(lines_of(raw(spark, sf_dir), line, "mobile", ["#ORL", *HEAD]), "source_type", "control.ceff", "control.reff", "control.rpen")


IDA_HEAD = ["#IDA", *HEAD, "#POLID NOX VOC", "#DATA ignored, as the first list counts"]


def ida_sql(more: str = "") -> str:
    """Two pollutants of a line: the price, and the average days of the quantity."""
    return f"SELECT id + 100 AS line_id, lpad(place, 5, '0') AS fips, '2280' || part6 AS scc, 0 AS country, p.pol AS pollutant, '' AS prefix, round(CASE p.pol WHEN 'NOX' THEN floor(price) * {TON} ELSE floor(quantity) * {TON} / 86400.0 * 31536000.0 END, 2) AS total, 1 AS parts{more} FROM (SELECT id, place, part6, price, quantity, n, supp FROM {{raw}}) r CROSS JOIN (VALUES ('NOX'), ('VOC')) AS p(pol)"



@query(ida_sql(", 'Plant' AS plant, '7' AS oris, 'B1' AS boiler, '1234' AS sic, 'lonlat' AS datum, -70.0 - n AS lon, 30.0 + n AS lat, round(n * 3.048, 6) AS height_m, CASE p.pol WHEN 'NOX' THEN cast(n AS double) ELSE 0.0 END AS ceff, CASE p.pol WHEN 'NOX' THEN 80.0 ELSE 100.0 END AS reff"))
def ingest_ida_point(spark, sf_dir):
    n, none = F.col("n"), F.lit("")
    start = [(5, PLACE5), (15, F.concat(F.lit("P"), "supp")), (15, n), (12, F.lit("S")), (6, F.lit("7")), (6, F.lit("B1")), (2, F.lit("1")), (40, F.lit("Plant")), (10, LONG_SCC), (8, none), (4, n * 10), (6, n), (4, 100 + n), (10, F.lit("0")), (9, F.lit("10")), (74, none), (4, F.lit("1234")), (9, 30 + n), (9, -70 - n), (1, none)]
    nox, voc = [(13, WHOLE_PRICE), (13, none), (7, n), (3, F.lit("80")), (16, none)], [(13, F.lit("-9")), (13, WHOLE_QUANTITY), (7, none), (3, none), (16, none)]
    # blanks of a fixed-width field are not empty texts, so the controls' defaults are those of a blank number
    voc[2], voc[3] = (7, F.lit("0")), (3, F.lit("100"))
    lines = lines_of(raw(spark, sf_dir), fixed(*start, *nox, *voc), "ida_point", IDA_HEAD)
    return parsed(lines, "point.plant", "point.oris", "point.boiler", "economic.sic", "point.datum", "point.lon", "point.lat", "round(point.height_m, 6) AS height_m", "control.ceff", "control.reff")


@query(ida_sql(", 10.0 AS ceff, 80.0 AS reff, cast(n AS double) AS rpen"))
def ingest_ida_area(spark, sf_dir):
    each = lambda annual, day: [(10, annual), (10, day), (11, F.lit("")), (7, F.lit("10")), (3, F.lit("80")), (6, F.col("n"))]
    line = fixed((5, PLACE5), (10, LONG_SCC), *each(WHOLE_PRICE, F.lit("")), *each(F.lit("-9"), WHOLE_QUANTITY))
    return parsed(lines_of(raw(spark, sf_dir), line, "ida_area", IDA_HEAD), "control.ceff", "control.reff", "control.rpen")


@query(ida_sql())
def ingest_ida_mobile(spark, sf_dir):
    line = fixed((5, PLACE5), (10, F.lit("")), (10, LONG_SCC), (10, WHOLE_PRICE), (10, F.lit("")), (10, F.lit("0")), (10, WHOLE_QUANTITY))
    return parsed(lines_of(raw(spark, sf_dir), line, "ida_mobile", IDA_HEAD))


def months(first: int, count: int = 12) -> dict[str, Column]:
    """Even lines state some months, others none (blank or -9)."""
    return {f"_{first + m}": F.when(F.col("n") % 2 == 1, "-9" if m % 2 else "").when(F.lit(m % 3 == 0), (F.col("price") * (m + 1)).cast("string")).otherwise("") for m in range(count)}


#: Months 0, 3, 6 and 9 of an even line: 1 + 4 + 7 + 10 times the price; a blank or -9 annual value is 0.
FF10_TOTAL = f"round(CASE WHEN n % 2 = 0 THEN 22.0 * price * {TON} WHEN n = 1 THEN 0.0 ELSE price * {TON} END, 2) AS total, CASE WHEN n % 2 = 0 THEN 12 ELSE 1 END AS parts"
TITLE = "country_cd,region_cd"


@query(f"SELECT {CODES}, {FF10_TOTAL}, CASE WHEN n = 5 THEN 100.0 ELSE cast(supp AS double) END AS reff FROM {{raw}}")
def ingest_ff10_nonpoint(spark, sf_dir):
    """The line of column names counts as data by its look and is left out."""
    line = delimited(45, _0=F.lit('"US"'), _1=FIPS, _5=SCC, _7=quoted(F.col("pol")), _8=ANNUAL, _9=REFF, **months(20))
    return parsed(lines_of(raw(spark, sf_dir), line, "ff10_nonpoint", ["#FORMAT=FF10_NONPOINT", *HEAD, TITLE + "," * 43]), "control.reff")


@query(f"SELECT {CODES}, {FF10_TOTAL}, CASE n % 3 WHEN 0 THEN 'lonlat' WHEN 1 THEN 'nad27' ELSE 'nad83' END AS datum, -70.0 - n AS lon, 30.0 + n AS lat, '7' AS oris, '123400' AS naics, round(n * 3.048, 6) AS height_m FROM {{raw}}")
def ingest_ff10_point(spark, sf_dir):
    """Every datum that a location may have."""
    n = F.col("n")
    line = delimited(77, _0=F.lit("USA"), _1=FIPS, _3=F.col("supp"), _4=n, _5=F.lit("S"), _6=F.lit("1"), _11=SCC, _12=F.col("pol"), _13=ANNUAL, _14=REFF, _15=F.lit("Plant"), _17=n * 10, _18=n, _19=100 + n, _20=F.lit("0"), _21=F.lit("10"), _22=F.lit("1234"), _23=-70 - n, _24=30 + n, _25=F.when(n % 3 == 0, "003").when(n % 3 == 1, "001").otherwise("002"), _41=F.lit("7"), _42=F.lit("B1"), **months(52))
    return parsed(lines_of(raw(spark, sf_dir), line, "ff10_point", ["#FORMAT=FF10_POINT", *HEAD, TITLE + "," * 75]), "point.datum", "point.lon", "point.lat", "point.oris", "economic.naics", "round(point.height_m, 6) AS height_m")


@query(f"""SELECT {CODES}, round(CASE WHEN n % 2 = 0 THEN 3 * quantity * {TON} ELSE price * {TON} END, 2) AS total, CASE WHEN n % 2 = 1 THEN 1 WHEN n IN (4, 6) THEN 30 ELSE 28 END AS parts, 'S' AS stack_id FROM {{raw}} WHERE n < 7""")
def ingest_ff10_daily(spark, sf_dir):
    """Even lines state the 2nd and the 15th day, odd ones the month; a line without a month is left out. A month's days stop at its end."""
    n = F.col("n")
    days = {f"_{14 + d}": F.when((n % 2 == 0) & F.lit(d in (1, 14)), F.col("quantity") * (1 if d == 1 else 2)).cast("string") for d in range(31)}
    line = delimited(46, _0=F.lit("US"), _1=FIPS, _3=F.col("supp"), _4=n, _5=F.lit("S"), _6=F.lit("1"), _7=SCC, _8=F.col("pol"), _12=F.when(n < 7, n).cast("string"), _13=F.col("price").cast("string"), **days)
    return parsed(lines_of(raw(spark, sf_dir), line, "ff10_daily", ["#FORMAT=FF10_DAILY_POINT", *HEAD]), "point.stack_id")


@query("""SELECT 'cut' AS file, id + 100 AS line_id, 'fields: ' || (37 - n) AS reason FROM {raw} WHERE n <= 3
UNION ALL SELECT 'short', id + 100, 'length: 30' FROM {raw} WHERE n = 1 UNION ALL SELECT 'unknown', id + 100, 'unknown file type' FROM {raw} UNION ALL SELECT 'ageless', id + 100, 'no year' FROM {raw}""")
def ingest_rejects(spark, sf_dir):
    """Lines that can't be used, with the reason: wrong numbers of fields, wrong lengths, files of no known kind or without a year. Commas in quotation marks are no fields."""
    rows, n = raw(spark, sf_dir), F.col("n")
    nonpoint = delimited(37, _0=F.lit("1001"), _1=F.lit('"a, b"'), _6=F.lit("NOX"))
    # a file's first data line tells its kind
    first = rows.agg(F.min("id").alias("id")).withColumn("n", F.lit(9)).select("id", "n").withColumn("id", F.lit(-1).cast("long"))
    with_first = first.unionByName(rows.select("id", "n"))
    cut = F.when(n <= 3, F.concat_ws(",", F.slice(F.split(F.lit(","), "x"), 1, 0), F.array_repeat(F.lit("a"), 37 - n))).otherwise(nonpoint)
    mobile = fixed((5, F.lit("01001")), (10, F.lit("")), (10, F.lit("2280000000")), (10, F.lit("1")), (10, F.lit("")))
    lines = lines_of(with_first, cut, "cut", ["#ORL", *HEAD]).unionByName(lines_of(with_first, F.when(n == 1, F.substring(mobile, 1, 30)).otherwise(mobile), "short", ["#IDA", *HEAD, "#DATA CO"]))
    lines = lines.unionByName(lines_of(rows, nonpoint, "unknown", ["#TABLE", *HEAD])).unionByName(lines_of(rows, nonpoint, "ageless", ["#ORL", "#COUNTRY US"]))
    _, rejects = inv.parse(lines, TON)
    return rejects.select("file", "line_id", "reason")


@query(f"""SELECT 'm' || lpad(cast(n AS string), 2, '0') AS file, 1 AS country, count(*) AS records, round(sum(price) * {TON}, 0) AS total, n AS first_month, n AS last_month FROM {{raw}} GROUP BY n""")
def ingest_monthly(spark, sf_dir):
    """A file for each month with its own period: its yearly amounts count a twelfth, and the last of several headers holds."""
    rows = raw(spark, sf_dir)
    lines = None
    for month in range(1, 8):
        part = lines_of(rows.where(F.col("n") == month), delimited(30, _0=FIPS, _1=SCC, _2=F.lit("CO"), _3=F.col("price")), f"m{month:02d}", ["#ORL", "#COUNTRY US", "#COUNTRY=CANADA", "#YEAR = 1999", "#YEAR 2005"], month=month)
        lines = part if lines is None else lines.unionByName(part)
    records, _ = inv.parse(lines, inv.units.to_kg("ton", monthly=True))
    i = F.col("intervals")[0]
    # a rate of a year over the month's seconds: brought back to the year's amount
    return records.groupBy("file", "country").agg(F.count(F.lit(1)).alias("records"), F.round(F.sum(i["rate"]) * 12 * 31536000.0, 0).alias("total"), F.min(F.month(i["begin_ts"])).alias("first_month"), F.max(F.month(F.col("intervals")[0]["end_ts"]) - 1).alias("last_month"))


@query("""SELECT CASE WHEN p_size % 2 = 0 THEN p_size % 7 ELSE 0 END AS country, '00' || lpad(cast(p_partkey % 500 AS string), 8, '2') AS scc, lpad(cast(p_size AS string), 5, '1') AS fips, arg_max(p_brand, p_partkey) AS code FROM {part} GROUP BY 1, 2, 3""".replace("arg_max", "max_by"))
def ingest_grid_ref(spark, sf_dir):
    """A sixth digit is the country, short SCCs get zeros, comments are cut, and the last line of a key wins."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    fips = F.lpad(F.col("p_size").cast("string"), 5, "1")
    place = F.when(F.col("p_size") % 2 == 0, F.concat((F.col("p_size") % 7).cast("string"), fips)).otherwise(fips)
    line = F.concat_ws(";", place, F.lpad((F.col("p_partkey") % 500).cast("string"), 8, "2"), F.concat(quoted(F.col("p_brand")), F.lit("! a comment; with a mark")))
    lines = part.select(F.lit("f").alias("file"), F.col("p_partkey").alias("line_id"), line.alias("value"))
    return ref.parse_grid_ref(lines.unionByName(lines.withColumn("value", F.lit("#FIPS;SCC;code"))))


@query("""SELECT 0 AS country, 'n' || p_partkey AS name, cast(p_partkey AS string) AS code, CASE p_size % 3 WHEN 0 THEN 'area:1.0' WHEN 1 THEN 'len:0.5,pop:1.0' ELSE 'one:1.0' END AS weights, CASE WHEN p_size % 2 = 0 THEN 'KIND' END AS filter_column, CASE WHEN p_size % 2 = 0 THEN p_size % 4 = 0 END AS filter_equal, CASE WHEN p_size % 2 = 0 THEN 2 END AS filter_values, CASE p_size % 5 WHEN 0 THEN 2 ELSE 0 END AS merges, CASE p_size % 5 WHEN 1 THEN 'b1,b3' ELSE '' END AS backups FROM {part}""")
def ingest_srg_spec(spark, sf_dir):
    """Weight functions, filters, merges and backups of surrogate specifications."""
    part, size = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_size")
    spec = {
        "region": F.lit("USA"), "name": F.concat(F.lit(" n"), "p_partkey"), "code": F.col("p_partkey").cast("string"), "data_shapes": F.lit("d"), "data_attribute": F.lit(" ID "), "weight_shapes": F.lit("w"),
        "weight_attribute": F.when(size % 3 == 0, "area").when(size % 3 == 1, "NONE").otherwise(" one "), "weight_function": F.when(size % 3 == 1, "0.5*len + pop").otherwise(""),
        "filter": F.when(size % 4 == 0, "KIND=1, 2").when(size % 2 == 0, "KIND != 1,2").otherwise("NONE"), "merge": F.when(size % 5 == 0, "0.5*a+0.5*b").otherwise("NONE"),
        "backup1": F.when(size % 5 == 1, "b1"), "backup2": F.lit(None).cast("string"), "backup3": F.when(size % 5 == 1, "b3"), "details": F.lit(""), "comments": F.lit(""),
    }
    out = ref.parse_srg_spec(part.select(*[c.alias(n) for n, c in spec.items()]))
    weights = F.array_join(F.transform("weights", lambda w: F.concat_ws(":", w["name"], w["factor"].cast("string"))), ",")
    return out.select("country", "name", "code", weights.alias("weights"), F.col("filter.column").alias("filter_column"), F.col("filter.equal").alias("filter_equal"), F.when(F.col("filter").isNotNull(), F.size("filter.values")).alias("filter_values"), F.size("merge").alias("merges"), F.array_join("backups", ",").alias("backups"))


@query("""SELECT i.fips, i.scc, i.code, 'name ' || i.code AS srg_name FROM (SELECT DISTINCT fips, scc, cast(100 + cast(substr(scc, 9, 2) AS int) AS string) AS code FROM {inv}) i""")
def surrogate_by_code(spark, sf_dir):
    """Every source's surrogate specification by country and code."""
    sources = view(spark, sf_dir, "inv").select("country", "fips", "scc", (100 + F.substring("scc", 9, 2).cast("int")).cast("string").alias("code")).distinct()
    specs = sources.select("country", "code").distinct().select("country", "code", F.concat(F.lit("name "), "code").alias("name"), F.array(F.lit("b")).alias("backups"))
    return sg.with_spec(sources, specs).select("fips", "scc", "code", "srg_name")


@query("""SELECT scc, fips, max_by(m, id) AS month_code, max_by(w, id) AS week_code, max_by(d, id) AS day_code FROM (
SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN '0000000000' ELSE '00' || lpad(cast(p_partkey % 700 AS string), 8, '2') END AS scc, CASE p_size % 3 WHEN 0 THEN '00000' ELSE lpad(cast(p_size AS string), 5, '1') END AS fips, cast(p_size AS string) AS m, p_brand AS w, p_type AS d FROM {part}) r GROUP BY scc, fips""")
def ingest_temporal_ref(spark, sf_dir):
    part, size = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_size")
    fips = F.lpad(size.cast("string"), 5, "1")
    line = F.concat_ws(";", F.when(size % 5 == 0, "").otherwise(F.lpad((F.col("p_partkey") % 700).cast("string"), 8, "2")), size.cast("string"), F.col("p_brand"), F.col("p_type"), F.lit("pol"), F.when(size % 3 == 0, "").when(size % 3 == 1, fips).otherwise(F.concat(F.lit("0"), fips)))
    return ref.parse_temporal_ref(part.select(F.lit("f").alias("file"), F.col("p_partkey").alias("line_id"), line.alias("value")))


@query("""SELECT kind, lpad(cast(p AS string), 5, '0') AS code, slot, round(v / sum(v) OVER (PARTITION BY kind, p), 9) AS fraction FROM (
SELECT k.kind, p.p, s.i AS slot, cast(1 + (p.size + s.i) % 97 AS double) AS v FROM (SELECT p_partkey % 100000 AS p, max_by(p_size, p_partkey) AS size FROM {part} GROUP BY 1) p CROSS JOIN (VALUES ('monthly', 12), ('weekly', 7), ('diurnal weekday', 24), ('diurnal weekend', 24)) AS k(kind, n) JOIN """ + numbers(24) + " ON s.i < k.n) x")
def ingest_temporal_profiles(spark, sf_dir):
    """Sections by their marks, values of four characters behind a code of five, and shares of each profile's total; the last line of a code wins."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size")
    lines = None
    for number, (kind, count) in enumerate(ref.SECTIONS.items()):
        values = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.lpad((1 + (size + i) % 97).cast("string"), 4, " ")), "")
        start = number * 10**12
        own = part.select((F.lit(start + 1) + F.col("p_partkey")).cast("long").alias("line_id"), F.concat(F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"), values).alias("value"))
        own = own.unionByName(spark.createDataFrame([(start, f"/{kind.upper()}/")], "line_id long, value string"))
        lines = own if lines is None else lines.unionByName(own)
    return ref.parse_temporal_profiles(lines.withColumn("file", F.lit("f"))).withColumn("fraction", F.round("fraction", 9))


@query("SELECT DISTINCT cast(o_orderdate AS date) AS day FROM {orders}")
def ingest_holidays(spark, sf_dir):
    day = F.date_format("o_orderdate", "MM dd yyyy")
    return ref.parse_holidays(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit(" 12     "), day, F.lit("  Monday ! a day")).alias("value")))


@query("""SELECT oris, boiler, hour_key, max_by(nox, id) AS nox, max_by(so2, id) AS so2, max_by(heat, id) AS heat FROM (SELECT event_id AS id, cast(user_id % 40 AS string) AS oris, event_type AS boiler, strftime(ts, '%y%m%d %H') AS hour_key, cast(greatest(cast(round(value) AS double) - 20, 0) AS float) AS nox, cast(CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 1000 END AS float) AS so2, cast(round(value) AS float) AS heat FROM {events} WHERE user_id % 40 > 0) e GROUP BY 1, 2, 3""")
def ingest_cem(spark, sf_dir):
    """Measured hours: negatives are 0, lines without a plant are left out, and the last line of an hour counts."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    oris, value = F.col("user_id") % 40, F.round("value")
    raw_lines = e.select(F.col("event_id").alias("line_id"), F.when(oris > 0, F.concat(F.lit('" '), oris, F.lit('"'))).otherwise("").alias("c0"), quoted(F.col("event_type")).alias("c1"), F.date_format("ts", "yyMMdd").alias("c2"), F.hour("ts").cast("string").alias("c3"), (value - 20).cast("string").alias("c4"), F.when(F.col("user_id") % 3 == 0, "").otherwise((F.col("user_id") % 1000).cast("string")).alias("c5"), F.lit("-9").alias("c6"), F.lit("").alias("c7"), value.cast("string").alias("c8"))
    return ref.parse_cem(raw_lines).select("oris", "boiler", "hour_key", "nox", "so2", "heat")


@query("""SELECT '00' || lpad(cast(p_partkey % 500 AS string), 8, '2') AS scc, p_type AS pol, max_by(p_brand, p_partkey) AS code FROM {part} GROUP BY 1, 2""")
def ingest_spec_ref(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    line = F.concat_ws(";", quoted(F.lpad((F.col("p_partkey") % 500).cast("string"), 8, "2")), quoted(F.col("p_brand")), quoted(F.col("p_type")), F.lit("! why"))
    lines = part.select(F.lit("f").alias("file"), F.col("p_partkey").alias("line_id"), line.alias("value"))
    return ref.parse_spec_ref(lines.unionByName(lines.withColumn("value", F.concat(F.lit("/"), "value"))))


@query("""SELECT DISTINCT cast(p_size % 13 AS int) AS period, p_brand AS pol, '0' || lpad(cast(p_partkey % 100000 AS string), 5, '1') AS country_fips, c.code, c.part / 4.0 AS fraction FROM {part} CROSS JOIN (VALUES ('a', 1.0), ('b', 3.0)) AS c(code, part)""")
def ingest_spec_combo(spark, sf_dir):
    """Codes with their shares of the line's last number."""
    place = F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "1")
    line = F.concat_ws(";", quoted(F.col("p_brand")), place, (F.col("p_size") % 13).cast("string"), F.lit('2;"a";1;"b";3;4'))
    return ref.parse_spec_combo(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit("f").alias("file"), F.col("p_partkey").alias("line_id"), line.alias("value")))


@query("""SELECT cast(p_partkey AS string) AS species_id, p_name AS name, CASE WHEN p_size % 4 = 0 THEN 'none' ELSE cast(p_size AS string) END AS weight, CASE WHEN p_size % 5 = 0 THEN 1.0 ELSE p_size / 10.0 END AS factor FROM {part}""")
def ingest_species(spark, sf_dir):
    """Species' weights (a blank is NaN) and the factors from VOC to TOG (a blank is 1)."""
    part, size = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_size")
    species = ref.parse_species(part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.when(size % 4 != 0, size.cast("string")).alias("spec_mw")))
    factors = ref.parse_voc_to_tog(part.select(F.col("p_partkey").cast("string").alias("p_number"), F.when(size % 5 == 0, "").otherwise((size / 10).cast("string")).alias("voctotog")))
    weight = F.when(F.isnan("mw"), "none").otherwise(F.col("mw").cast("int").cast("string"))
    return species.join(factors.withColumnRenamed("code", "species_id"), "species_id").select("species_id", "name", weight.alias("weight"), "factor")


@query("""SELECT kind, code, species_id, round(w / sum(w) OVER (PARTITION BY kind, code), 9) AS fraction FROM (SELECT CASE p_size % 3 WHEN 0 THEN 'voc' WHEN 1 THEN 'gas' ELSE 'pm' END AS kind, p_brand AS code, p_type AS species_id, max_by(CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE cast(p_size AS double) END, p_partkey) AS w FROM {part} GROUP BY 1, 2, 3) x""".replace("round(w / sum(w) OVER (PARTITION BY kind, code), 9)", "CASE WHEN sum(w) OVER (PARTITION BY kind, code) = 0 THEN -1.0 ELSE round(w / sum(w) OVER (PARTITION BY kind, code), 9) END"))
def ingest_profiles(spark, sf_dir):
    """Species' shares of a profile: a blank weight is 0, the last line of a species wins; a profile without weight (NaN) shows as -1."""
    part, size = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_size")
    rows = part.select(F.when(size % 3 == 0, "voc").when(size % 3 == 1, "gas").otherwise("pm").alias("kind"), F.col("p_brand").alias("p_number"), F.col("p_type").alias("species_id"), F.when(size % 7 != 0, size.cast("string")).alias("weight_per"), F.col("p_partkey").alias("line_id"))
    return ref.parse_profiles(rows).withColumn("fraction", F.when(F.isnan("fraction"), -1.0).otherwise(F.round("fraction", 9)))


@query("""SELECT p_type AS mech, cast(p_partkey AS string) AS species_id, p_brand AS grp, p_size / 10.0 AS ratio, CASE WHEN p_size % 2 = 0 THEN 'none' ELSE 'mol' END AS basis, CASE WHEN p_size % 3 = 0 THEN 0.0 WHEN p_size % 3 = 1 THEN cast(p_size AS double) ELSE -1.0 END AS mw FROM {part}""")
def ingest_mechanisms(spark, sf_dir):
    """Assignments, group weights and species' weights of mechanisms; a negative weight (NaN) shows as -1, -9 is 0."""
    part, size = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_size")
    key, none = F.col("p_partkey").cast("string"), F.lit("")
    weight = F.when(size % 3 == 0, "-9").when(size % 3 == 1, size.cast("string")).otherwise("-2")
    a, w, s = ref.parse_mechanisms(part.select(F.col("p_type").alias("c0"), key.alias("c1"), F.col("p_brand").alias("c2"), (size / 10).cast("string").alias("c3")), part.select(key.alias("c0"), F.when(size % 2 == 0, "none").otherwise("mol").alias("c1"), key.alias("c2"), weight.alias("c3")), part.select(key.alias("c0"), *[none.alias(f"c{i}") for i in range(1, 8)], weight.alias("c8")))
    both = w.select(F.col("mech").alias("species_id"), "basis", F.col("mw").alias("w1")).join(s.select("species_id", F.col("mw").alias("w2")), "species_id")
    mw = F.when(F.isnan("w1") & F.isnan("w2"), -1.0).when(F.col("w1") == F.col("w2"), F.col("w1"))
    return a.join(both, "species_id").select("mech", "species_id", "grp", "ratio", "basis", mw.alias("mw"))


@query("""SELECT 'scc' AS kind, CASE p_size % 3 WHEN 0 THEN lpad(cast(p_partkey AS string), 10, '2') WHEN 1 THEN '00' || lpad(cast(p_partkey AS string), 8, '2') ELSE lpad(cast(p_partkey AS string), 9, '2') || '0' END AS code, p_name AS description FROM {part}
UNION ALL SELECT 'sic', lpad(cast(s_suppkey % 10000 AS string), 4, '0'), '"' || s_name || '"' FROM {supplier} UNION ALL SELECT 'naics', cast(s_suppkey AS string), '"' || s_name || '"' FROM {supplier}""")
def ingest_descriptions(spark, sf_dir):
    part, supplier = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("part", "supplier"))
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    code = F.when(size % 3 == 0, F.lpad(key, 10, "2")).when(size % 3 == 1, F.lpad(key, 8, "2")).otherwise(F.lpad(key, 9, "2"))
    scc = ref.parse_scc_descriptions(part.select(code.alias("c0"), F.concat("p_name", F.lit("! a remark")).alias("c1")))
    sic = ref.parse_sic_descriptions(supplier.select(F.concat(F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"), F.lit(" "), "s_name").alias("value")))
    naics = ref.parse_naics_descriptions(supplier.select(F.concat(quoted(F.col("s_suppkey").cast("string")), F.lit(","), quoted(F.col("s_name"))).alias("value")))
    kinds = [df.select(F.lit(kind).alias("kind"), "code", "description") for kind, df in (("scc", scc), ("sic", sic), ("naics", naics))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("""SELECT CASE WHEN p_size % 2 = 0 THEN lpad(cast(p_partkey AS string), 10, '2') ELSE '00' || lpad(cast(p_partkey AS string), 8, '2') END AS scc, lpad(cast(p_size % 15 AS string), 2, '0') AS tier1 FROM {part}""")
def ingest_tier1(spark, sf_dir):
    part, size = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_size")
    key = F.col("p_partkey").cast("string")
    return ref.parse_tier1(part.select(F.when(size % 2 == 0, F.lpad(key, 10, "2")).otherwise(F.lpad(key, 8, "2")).alias("c0"), (size % 15).cast("string").alias("c16")))


@query("""SELECT state, tier1, pol, y.yr, CASE y.yr WHEN 2005 THEN round(total, 2) ELSE 0.0 END AS emis FROM (SELECT state, tier1, pol, sum(emis) AS total FROM {trend} GROUP BY ALL) t CROSS JOIN (VALUES (1990), (2005), (2010)) AS y(yr)""")
def ingest_trends(spark, sf_dir):
    """A column for each year, with two or four digits; blanks and dots are 0."""
    wide = view(spark, sf_dir, "trend").groupBy("state", "tier1", "pol").agg(F.sum("emis").cast("string").alias("emissions05"))
    return ref.parse_trends(wide.withColumn("emissions90", F.lit("...")).withColumn("emissions2010", F.lit(" "))).withColumn("emis", F.round("emis", 2))
