"""Inventory files (ORL, IDA and FF10 families) as sources and emissions tables.

The kind of every file is found from its first lines; the data lines of all files are then parsed by one plan a kind. Large files are read in splits; only headers depend on the order of lines, and they stand in a file's first block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroflux.functions import codes, periods, units
from aeroflux.operators import datums

#: Data fields of each delimited kind, and line length of each fixed-width kind: (fixed part, part for each pollutant).
FIELDS = {"orl_point": 70, "orl_nonpoint": 37, "orl_nonroad": 30, "orl_mobile": 16, "ff10_point": 77, "ff10_daily_point": 46, "ff10_nonpoint": 45}
WIDTHS = {"ida_point": (249, 52), "ida_area": (15, 47), "ida_mobile": (25, 20)}
#: Marks in a file's first line, tested in this order.
MARKS = {"ORL": "orl", "IDA": "ida", "FF10_POINT": "ff10_point", "FF10_DAILY_POINT": "ff10_daily_point", "FF10_NONPOINT": "ff10_nonpoint", "FF10_NONROAD": "ff10_nonpoint", "FF10_ONROAD": "ff10_nonpoint"}

POINT = ["plant_id", "point_id", "stack_id", "segment", "plant", "oris", "boiler", "height_m", "diam_m", "temp_k", "flow_m3s", "vel_ms", "lon", "lat", "datum"]
CONTROL = ["mact", "ceff", "reff", "rpen"]
NUMBERS = {"height_m", "diam_m", "temp_k", "flow_m3s", "vel_ms", "lon", "lat", "ceff", "reff", "rpen"}


@dataclass(frozen=True)
class Inventory:
    """sources: one row for each line and pollutant as read; emissions: one row for each interval; rejects: lines that can't be used, with the reason."""

    sources: DataFrame
    emissions: DataFrame
    rejects: DataFrame


def _lines(spark: SparkSession, path: str, sector: str, month: int) -> DataFrame:
    read = spark.read.text(path)
    return read.select(F.lit(sector).alias("sector"), F.lit(path).alias("file"), F.lit(month).alias("month"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_id"), "value")


def paths_of(template: str, monthly: bool) -> list[tuple[str, int]]:
    """(path, month) of an inventory: one yearly file, or twelve with the month's name for [month]."""
    return [(template.replace("[month]", name), number) for number, name in enumerate(periods.MONTHS, 1)] if monthly else [(template, 0)]


def lines_of(spark: SparkSession, paths_by_sector: dict[str, list[str]], freq: str = "annual") -> DataFrame:
    """All lines of all sectors' files."""
    if freq not in ("annual", "monthly"):
        raise ValueError(f"unsupported inventory frequency {freq}")
    parts = [_lines(spark, path, sector, month) for sector, templates in paths_by_sector.items() for template in templates for path, month in paths_of(template, freq == "monthly")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # identifiers are unique in one read only; a file's path tells reads apart
    return out


def is_data(value: Column) -> Column:
    return (F.length(value) > 0) & ~value.startswith("#")


def field_count(value: Column) -> Column:
    """Fields of a delimited line; commas in quotation marks don't count."""
    return F.size(F.split(F.regexp_replace(value, '"[^"]*"', ""), ","))


def headers(lines: DataFrame) -> DataFrame:
    """One row for each file: kind, year, country and pollutants, from its first block."""
    first_block = lines.where(F.col("block") == 0)
    data = is_data(F.col("value"))
    edges = first_block.groupBy("file").agg(F.min_by("value", "line_id").alias("first_line"), F.min_by(F.when(data, F.col("value")), F.when(data, F.col("line_id"))).alias("first_data"), F.min(F.when(data, F.col("line_id"))).alias("data_id"))
    value = F.col("value")
    comments = first_block.where(value.startswith("#")).join(edges.select("file", "data_id"), "file").where(F.col("data_id").isNull() | (F.col("line_id") < F.col("data_id")))

    def after(word: str) -> tuple[Column, Column]:
        hit = F.substring(value, 2, len(word)) == word
        return hit & (F.length(value) > len(word) + 1), F.substring(value, len(word) + 2, 1 << 20)

    (year, year_text), (country, country_text), (polid, pol_text), (data_word, data_text) = (after(w) for w in ("YEAR", "COUNTRY", "POLID", "DATA"))
    pollutants = F.when(polid, F.trim(pol_text)).when(data_word, F.trim(data_text))
    found = comments.groupBy("file").agg(
        F.max_by(F.when(year, F.regexp_replace(year_text, '^[" =\t\n]+|[" =\t\n]+$', "")), F.when(year, F.col("line_id"))).alias("year"),
        F.max_by(F.when(country, F.regexp_replace(country_text, "^[ =\n]+|[ =\n]+$", "")), F.when(country, F.col("line_id"))).alias("country_name"),
        F.min_by(F.when(pollutants != "", pollutants), F.when(pollutants != "", F.col("line_id"))).alias("pollutants"),
    )
    family = F.lit(None).cast("string")
    for mark, kind in reversed(MARKS.items()):
        family = F.when(F.contains("first_line", F.lit(mark)), kind).otherwise(family)
    out = edges.join(found, "file", "left").withColumn("family", family).withColumn("pols", F.when(F.col("pollutants").isNotNull(), F.split("pollutants", " ")).otherwise(F.array().cast("array<string>")))
    orl = ida = F.lit(None).cast("string")
    for kind, count in FIELDS.items():
        if kind.startswith("orl"):
            orl = F.when(field_count(F.col("first_data")) == count, kind).otherwise(orl)
    for kind, (fixed, each) in WIDTHS.items():
        ida = F.when(F.length("first_data") == fixed + each * F.size("pols"), kind).otherwise(ida)
    ida = F.when(F.size("pols") < 10, ida)
    kind = F.when(F.col("family") == "orl", orl).when(F.col("family") == "ida", ida).otherwise(F.col("family"))
    country_code = F.when(F.col("country_name").isNotNull(), codes.country_of_name(F.col("country_name"))).otherwise(F.lit(0))
    return out.select("file", kind.alias("kind_of_file"), "year", country_code.alias("country"), "pols")


def _record(kind: str, fips: Column, scc: Column, country: Column, pollutant: Column, intervals: Column, **more: Column) -> list[Column]:
    """The common shape that every kind of line is brought to."""
    text = lambda name: more.get(name, F.lit(None)).cast("double" if name in NUMBERS else "string")
    return [
        F.lit(kind).alias("kind"),
        fips.alias("fips"),
        scc.alias("scc"),
        country.cast("int").alias("country"),
        more.get("source_type", F.lit(None)).cast("string").alias("source_type"),
        F.struct(*[text(c).alias(c) for c in POINT]).alias("point"),
        F.struct(more.get("sic", F.lit(None)).cast("string").alias("sic"), more.get("naics", F.lit(None)).cast("string").alias("naics")).alias("economic"),
        F.struct(*[text(c).alias(c) for c in CONTROL]).alias("control"),
        codes.pollutant(pollutant).alias("pollutant"),
        codes.prefix(pollutant).alias("prefix"),
        intervals.alias("intervals"),
    ]


def _interval(begin: Column, end: Column, rate: Column) -> Column:
    return F.struct(begin.alias("begin_ts"), end.alias("end_ts"), rate.alias("rate"))


def _whole_period(annual: Column, average_day: Column, factor: float) -> Column:
    """The file's own period: its month, or its year."""
    month = F.col("month")
    begin = periods.begin_of("year", F.greatest(month, F.lit(1)))
    end = F.when(month == 0, periods.end_of(begin, 12)).otherwise(periods.end_of(begin, 1))
    return F.array(_interval(begin, end, units.annual_rate(codes.number(annual), codes.number(average_day), factor)))


def _present(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).isin("", codes.MISSING) == F.lit(False)


def _monthly_or_annual(annual: Column, months: list[Column], factor: float) -> Column:
    """Twelve months where any of them is given, else the calendar year."""
    each = [_interval(b := periods.begin_of("year", m), e := periods.end_of(b, 1), units.period_rate(codes.number(c), b, e, factor)) for m, c in enumerate(months, 1)]
    begin = periods.begin_of("year")
    year = _interval(begin, periods.end_of(begin, 12), units.annual_rate(codes.number(annual), F.lit(0.0), factor))
    return F.when(F.exists(F.array(*months), _present), F.array(*each)).otherwise(F.array(year))


def _location(x: Column, y: Column, kind: Column, datum: Column) -> dict[str, Column]:
    """Longitude and latitude; other kinds of location and unknown datums fail."""
    known = F.when(codes.text(datum).isin("", "003"), "lonlat").when(codes.text(datum) == "001", "nad27").when(codes.text(datum) == "002", "nad83")
    name = F.coalesce(known, F.raise_error(F.concat(F.lit("invalid datum "), datum)).cast("string"))
    name = F.when(codes.text(kind) == "L", name).otherwise(F.raise_error(F.lit("the location's type must be L")).cast("string"))
    return {"lon": codes.number(x), "lat": codes.number(y), "datum": name}


def _stack(height: Column, diameter: Column, temperature: Column, flow: Column, velocity: Column) -> dict[str, Column]:
    return units.stack(*map(codes.number, (height, diameter, temperature, flow, velocity)))


def _delimited(kind: str, c: list[Column], factor: float) -> list[Column]:
    """Columns of a delimited line by kind of file; c are its fields."""
    text, country = codes.text, F.col("country")
    c = [codes.apart(c[0]), *c[1:]]  # around a field alone, as what stands inside isn't compiled
    if kind == "orl_point":
        more = {"plant_id": text(c[1]), "point_id": text(c[2]), "stack_id": text(c[3]), "segment": text(c[4]), "plant": text(c[5]), "source_type": text(c[8]), "sic": codes.sic(c[14]), "mact": text(c[15]), "naics": codes.naics(c[16]), "ceff": codes.control(c[24], 0.0), "reff": codes.control(c[25], 100.0), "oris": text(c[29]), "boiler": text(c[30])}
        more |= _stack(*c[9:14]) | _location(c[18], c[19], c[17], F.lit(""))
        return _record("point", codes.fips(c[0]), codes.scc(c[6]), country, c[21], _whole_period(c[22], c[23], factor), **more)
    if kind == "orl_nonpoint":
        more = {"sic": codes.sic(c[2]), "mact": text(c[3]), "source_type": text(c[4]), "naics": codes.naics(c[5]), "ceff": codes.control(c[9], 0.0), "reff": codes.control(c[10], 100.0), "rpen": codes.control(c[11], 100.0)}
        return _record("polygon", codes.fips(c[0]), codes.scc(c[1]), country, c[6], _whole_period(c[7], c[8], factor), **more)
    if kind in ("orl_nonroad", "orl_mobile"):
        at, type_at = (5, 8) if kind == "orl_nonroad" else (9, 5)
        more = {"source_type": text(c[type_at]), "ceff": codes.control(c[at], 0.0), "reff": codes.control(c[at + 1], 100.0), "rpen": codes.control(c[at + 2], 100.0)}
        return _record("polygon", codes.fips(c[0]), codes.scc(c[1]), country, c[2], _whole_period(c[3], c[4], factor), **more)
    country = codes.country_of_name(text(c[0]))
    if kind == "ff10_nonpoint":
        return _record("polygon", codes.fips(c[1]), codes.scc(c[5]), country, c[7], _monthly_or_annual(c[8], c[20:32], factor), reff=codes.control(c[9], 100.0))
    place = {"plant_id": text(c[3]), "point_id": text(c[4]), "stack_id": text(c[5]), "segment": text(c[6])}
    if kind == "ff10_point":
        more = place | {"reff": codes.control(c[14], 100.0), "plant": text(c[15]), "naics": codes.naics(c[22]), "oris": text(c[41]), "boiler": text(c[42])}
        more |= _stack(*c[17:22]) | _location(c[23], c[24], F.lit("L"), c[25])
        return _record("point", codes.fips(c[1]), codes.scc(c[11]), country, c[12], _monthly_or_annual(c[13], c[52:64], factor), **more)
    # daily: a month's days where any is given, else the month
    begin = periods.begin_of("year", F.when(F.coalesce(c[12], F.lit("")) == "", F.lit("1")).otherwise(c[12]).cast("int"))
    end = periods.end_of(begin, 1)
    day = lambda v, i: _interval(begin + F.make_dt_interval(i), begin + F.make_dt_interval(i + 1), codes.number(v) * factor / units.SECONDS_PER_DAY)
    days = F.slice(F.transform(F.array(*c[14:45]), day), F.lit(1), periods.days_in_month(begin))
    month = F.array(_interval(begin, end, units.period_rate(codes.number(c[13]), begin, end, factor)))
    return _record("supplemental", codes.fips(c[1]), codes.scc(c[7]), country, c[8], F.when(F.exists(F.array(*c[14:45]), _present), days).otherwise(month), **place)


#: Places of the fields of a fixed-width line's own part, and of each pollutant's part behind it.
LINE_AT = {
    "ida_point": {"fips": (0, 5), "plant_id": (5, 20), "point_id": (20, 35), "stack_id": (35, 47), "oris": (47, 53), "boiler": (53, 59), "segment": (59, 61), "plant": (61, 101), "scc": (101, 111), "height": (119, 123), "diameter": (123, 129), "temperature": (129, 133), "flow": (133, 143), "velocity": (143, 152), "sic": (226, 230), "lat": (230, 239), "lon": (239, 248)},
    "ida_area": {"fips": (0, 5), "scc": (5, 15)},
    "ida_mobile": {"fips": (0, 5), "scc": (15, 25)},
}
PART_AT = {
    "ida_point": {"annual": (0, 13), "day": (13, 26), "ceff": (26, 33), "reff": (33, 36)},
    "ida_area": {"annual": (0, 10), "day": (10, 20), "ceff": (31, 38), "reff": (38, 41), "rpen": (41, 47)},
    "ida_mobile": {"annual": (0, 10), "day": (10, 20)},
}


def _fixed(kind: str, rows: DataFrame, factor: float) -> DataFrame:
    """Records of fixed-width lines: a line's own fields are cut and read once, before its pollutants multiply them, and each pollutant's fields are cut once."""
    fixed, each = WIDTHS[kind]
    place, part = LINE_AT[kind], PART_AT[kind]
    keep = ["sector", "file", "line_id", "month", "year", "country"]
    cut = rows.select(*keep, "pols", F.substring("value", fixed + 1, 1 << 20).alias("_parts"), *[F.substring("value", a + 1, b - a).alias(f"_{name}") for name, (a, b) in place.items()])
    at = lambda name: F.col(f"_{name}")
    own = {"_fips": codes.fips(codes.apart(at("fips"))), "_scc": codes.scc(at("scc"))}
    if kind == "ida_point":
        numbers = ["height", "diameter", "temperature", "flow", "velocity"]
        own |= {f"_{name}": codes.text(at(name)) for name in ("plant_id", "point_id", "stack_id", "oris", "boiler", "segment", "plant")} | {"_sic": codes.sic(at("sic"))}
        own |= {f"_{name}": codes.number(at(name)) for name in numbers} | {f"_{name}": c for name, c in _location(at("lon"), at("lat"), F.lit("L"), F.lit("")).items()}
        read = cut.withColumns(own).withColumns({f"_{name}": c for name, c in units.stack(*map(at, numbers)).items()})
    else:
        read = cut.withColumns(own)
    start = F.col("_i") * each
    one = read.select("*", F.posexplode("pols").alias("_i", "_pol"))
    one = one.withColumns({f"_{name}": F.substring(F.col("_parts"), start + a + 1, F.lit(b - a)) for name, (a, b) in part.items()})
    more = {name: at(name) for name in ("sic", *POINT)} if kind == "ida_point" else {}
    more |= {name: codes.control(at(name), 0.0 if name == "ceff" else 100.0) for name in part if name in CONTROL}
    whole = _record("point" if kind == "ida_point" else "polygon", at("fips"), at("scc"), F.col("country"), F.col("_pol"), _whole_period(at("annual"), at("day"), factor), **more)
    return one.select("sector", "file", "line_id", *whole)


def parse(lines: DataFrame, factor: float) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of all data lines; a record has one pollutant and its intervals."""
    # one row for each file, as the list of files itself; only the kinds that occur are planned for
    found = headers(lines)
    rows = found.collect()
    about, kinds = F.broadcast(lines.sparkSession.createDataFrame(rows, found.schema)), {r["kind_of_file"] for r in rows}
    data = lines.where(is_data(F.col("value"))).join(about, "file", "left")
    value, kind = F.col("value"), F.col("kind_of_file")
    wanted = F.lit(None).cast("int")
    for name, count in FIELDS.items():
        wanted = F.when(kind == name, F.lit(count)).otherwise(wanted)
    width = F.lit(None).cast("int")
    for name, (fixed, each) in WIDTHS.items():
        width = F.when(kind == name, fixed + each * F.size("pols")).otherwise(width)
    reason = (
        F.when(kind.isNull(), "unknown file type")
        .when(F.col("year").isNull(), "no year")
        .when(wanted.isNotNull() & (field_count(value) != wanted), F.concat(F.lit("fields: "), field_count(value).cast("string")))
        .when(width.isNotNull() & (F.length(value) != width), F.concat(F.lit("length: "), F.length(value).cast("string")))
    )
    data = data.withColumn("reason", reason)
    rejects = data.where(F.col("reason").isNotNull()).select("sector", "file", "line_id", "reason", "value")
    good = data.where(F.col("reason").isNull())
    parts = []
    for name, count in FIELDS.items():
        if name not in kinds:
            continue
        schema = ", ".join(f"c{i} string" for i in range(count))
        rows = good.where(kind == name).withColumn("f", F.from_csv("value", schema))
        c = [F.col(f"f.c{i}") for i in range(count)]
        if name.startswith("ff10"):
            rows = rows.where(~F.contains(F.coalesce(c[0], F.lit("")), F.lit("country_cd")))
        if name == "ff10_daily_point":
            rows = rows.where(F.coalesce(c[12], F.lit("")) != "")
        parts.append(rows.select("sector", "file", "line_id", *_delimited(name, c, factor)))
    for name in WIDTHS:
        if name not in kinds:
            continue
        parts.append(_fixed(name, good.where(kind == name), factor))
    if not parts:
        name = "ff10_nonpoint"
        rows = good.where(F.lit(False)).withColumn("f", F.from_csv("value", ", ".join(f"c{i} string" for i in range(FIELDS[name]))))
        parts.append(rows.select("sector", "file", "line_id", *_delimited(name, [F.col(f"f.c{i}") for i in range(FIELDS[name])], factor)))
    records = parts[0]
    for part in parts[1:]:
        records = records.unionByName(part)
    key = codes.record_key("fips", "scc", "country")
    place = F.concat(*[F.coalesce(F.col(f"point.{c}"), F.lit("")) for c in ("plant_id", "point_id", "stack_id", "segment")])
    return records.withColumn("record_key", F.when(F.col("kind") == "polygon", key).otherwise(F.concat(key, place))), rejects


def read_inventory(spark: SparkSession, paths_by_sector: dict[str, list[str]], input_unit: str = "ton", freq: str = "annual", compat: bool = False, on_bad: str = "fail") -> Inventory:
    """Inventory files of several sectors. ``on_bad``: a line that can't be parsed fails the read, or is left to ``rejects``."""
    records, rejects = parse(lines_of(spark, paths_by_sector, freq), units.to_kg(input_unit, freq == "monthly", compat))
    if on_bad == "fail" and (wrong := rejects.first()) is not None:
        raise ValueError(f"{wrong['file']}: {wrong['reason']}: {wrong['value'][:80]}")
    sources = records.drop("intervals", "prefix")
    emissions = records.select("record_key", "sector", "file", "fips", "scc", "country", "pollutant", "prefix", F.explode("intervals").alias("i")).select("record_key", "sector", "file", "fips", "scc", "country", "pollutant", "prefix", "i.begin_ts", "i.end_ts", "i.rate", F.lit("kg/s").alias("unit"))
    return Inventory(sources, emissions, rejects)


def on_wgs84(sources: DataFrame) -> DataFrame:
    """sources whose points lie on WGS 84: NAD27 positions are shifted, the label tells it. Polygons have no point and stay as they are."""
    lon, lat = datums.to_wgs84(F.col("point.lon"), F.col("point.lat"), F.col("point.datum"))
    moved = F.when(F.col("point.datum").isNotNull(), F.lit("wgs84"))
    return sources.withColumn("point", F.col("point").withField("lon", lon).withField("lat", lat).withField("datum", moved))
