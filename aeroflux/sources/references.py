"""Reference tables: gridding, temporal, speciation and description files.

These files are small against inventories. Where the order of lines matters (the last line of a key wins, section marks), a file is read whole and its lines are numbered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeroflux.functions import codes
from aeroflux.operators.matching import last_line


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_id, value) in the files' order, without comments behind '!' being cut."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_id", "value"))
    return whole.where(F.col("value") != "")


def _cut(c: Column, mark: str = "!") -> Column:
    return F.split(c, mark)[0]


def _strip(c: Column, characters: str = '" ') -> Column:
    return F.regexp_replace(c, f"^[{characters}]+|[{characters}]+$", "")


def _longer_scc(c: Column) -> Column:
    return F.when(F.length(c) == 8, F.concat(F.lit("00"), c)).otherwise(c)


def _fields(lines: DataFrame, separator: str = ";", skip: str = "#") -> DataFrame:
    data = lines.withColumn("value", _cut(F.col("value"))).where((F.col("value") != "") & ~F.col("value").rlike(f"^[{skip}]"))
    return data.withColumn("f", F.split("value", separator))


def parse_grid_ref(lines: DataFrame) -> DataFrame:
    """(country, scc, fips, code); a sixth digit in front of the FIPS is the country."""
    f = F.col("f")
    six = F.length(f[0]) == 6
    country = F.when(six, codes.country_of_digit(F.substring(f[0], 1, 1))).otherwise(F.lit(0))
    rows = _fields(lines).select("line_id", country.alias("country"), _longer_scc(f[1]).alias("scc"), F.when(six, F.substring(f[0], 2, 5)).otherwise(f[0]).alias("fips"), _strip(f[2]).alias("code"))
    return last_line(rows, ["country", "scc", "fips"]).drop("line_id")


def read_grid_ref(spark: SparkSession, path: str) -> DataFrame:
    return parse_grid_ref(numbered_lines(spark, path))


#: Columns of a surrogate specification.
SPEC_FIELDS = "region, name, code, data_shapes, data_attribute, weight_shapes, weight_attribute, weight_function, filter, merge, backup1, backup2, backup3, details, comments".split(", ")


def parse_srg_spec(raw: DataFrame) -> DataFrame:
    """Surrogate specifications with their weight functions, filters, merges and backups as arrays."""
    raw = raw.select(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in SPEC_FIELDS])
    given = lambda c: (c != "") & (c != "NONE")

    def term(t: Column) -> Column:
        parts = F.split(t, "\\*")
        two = F.size(parts) == 2
        checked = F.when(F.size(parts) > 2, F.raise_error(F.concat(F.lit("invalid weight function "), t)).cast("string")).otherwise(parts[F.size(parts) - 1])
        return F.struct(F.when(two, F.trim(parts[0]).cast("double")).otherwise(F.lit(1.0)).alias("factor"), F.trim(checked).alias("name"))

    none = F.array().cast("array<struct<factor:double,name:string>>")
    attribute = F.when(given(F.col("weight_attribute")), F.array(F.struct(F.lit(1.0).alias("factor"), F.trim("weight_attribute").alias("name")))).otherwise(none)
    function = F.when(F.col("weight_function") != "", F.transform(F.split("weight_function", "\\+"), term)).otherwise(none)
    merge = F.when(given(F.col("merge")), F.transform(F.split("merge", "\\+"), term)).otherwise(none)
    return raw.select(
        codes.country_of_name(F.col("region")).alias("country"),
        F.trim("name").alias("name"),
        "code",
        "data_shapes",
        F.trim("data_attribute").alias("data_attribute"),
        "weight_shapes",
        F.concat(attribute, function).alias("weights"),
        filter_of(F.col("filter")).alias("filter"),
        merge.alias("merge"),
        F.filter(F.array("backup1", "backup2", "backup3"), lambda b: b != "").alias("backups"),
        "details",
    )


def read_srg_spec(spark: SparkSession, path: str) -> DataFrame:
    return parse_srg_spec(spark.read.csv(path, schema=", ".join(f"{n} string" for n in SPEC_FIELDS), comment="#", header=True, enforceSchema=True))


def filter_of(c: Column) -> Column:
    """struct(column, equal, values) of COL=a,b or COL!=a,b; null where there is none."""
    unequal = F.contains(c, F.lit("!="))
    parts = F.when(unequal, F.split(c, "!=")).otherwise(F.split(c, "="))
    made = F.struct(F.trim(parts[0]).alias("column"), (~unequal).alias("equal"), F.transform(F.split(parts[1], ","), lambda v: F.trim(v)).alias("values"))
    return F.when((c != "") & (c != "NONE"), made)


def parse_temporal_ref(lines: DataFrame) -> DataFrame:
    """(scc, fips, month_code, week_code, day_code); blank codes stand for all."""
    f = F.col("f")
    fips = F.when(f[5] == "", "00000").when(F.length(f[5]) == 6, F.substring(f[5], 2, 5)).when(F.length(f[5]) == 5, f[5]).otherwise(F.raise_error(F.concat(F.lit("wrong FIPS "), f[5])).cast("string"))
    rows = _fields(lines, skip="#/").select("line_id", F.when(f[0] == "", "0000000000").otherwise(_longer_scc(f[0])).alias("scc"), fips.alias("fips"), f[1].alias("month_code"), f[2].alias("week_code"), f[3].alias("day_code"))
    return last_line(rows, ["scc", "fips"]).drop("line_id")


def read_temporal_ref(spark: SparkSession, path: str) -> DataFrame:
    return parse_temporal_ref(numbered_lines(spark, path))


# Section marks of a profile file and the number of values on a line.
SECTIONS = {"monthly": 12, "weekly": 7, "diurnal weekday": 24, "diurnal weekend": 24}


def parse_temporal_profiles(lines: DataFrame) -> DataFrame:
    """(kind, code, slot, fraction): slots count from 0, fractions of a profile add up to 1; the last line of a code wins."""
    lines = lines.where(~F.col("value").startswith("#"))
    mark = F.col("value").startswith("/")
    # only marks are put in order, and a file has few: each holds up to the next, so no task holds a file's lines
    following = F.lead("line_id").over(Window.partitionBy("file").orderBy("line_id"))
    sections = lines.where(mark).select(F.col("file").alias("_file"), F.lower(F.regexp_replace("value", "^[/ ]+|[/ ]+$", "")).alias("kind"), F.col("line_id").alias("_from"), following.alias("_to"))
    inside = (F.col("file") == F.col("_file")) & (F.col("line_id") > F.col("_from")) & (F.col("_to").isNull() | (F.col("line_id") < F.col("_to")))
    rows = lines.where(~mark).join(F.broadcast(sections), inside, "left")
    count = F.lit(None).cast("int")
    for kind, n in SECTIONS.items():
        count = F.when(F.col("kind") == kind, F.lit(n)).otherwise(count)
    count = F.coalesce(count, F.raise_error(F.concat(F.lit("unknown profile section "), F.col("kind"))).cast("int"))
    values = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.trim(F.substring(F.col("value"), i * 4 + 6, F.lit(4))).cast("double"))
    kept = last_line(rows.select("line_id", "kind", F.trim(F.substring("value", 1, 5)).alias("code"), values.alias("values")), ["kind", "code"])
    return normalised(kept.select("kind", "code", F.posexplode("values").alias("slot", "fraction")), ["kind", "code"], "fraction")


def read_temporal_profiles(spark: SparkSession, path: str) -> DataFrame:
    return parse_temporal_profiles(numbered_lines(spark, path))


def normalised(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values as shares of their group's total; a group that adds up to 0 has NaN."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn(value, F.when(total != 0, F.col(value) / total).otherwise(F.lit(math.nan)))


def parse_holidays(lines: DataFrame) -> DataFrame:
    lines = lines.where((F.length("value") >= 19) & ~F.col("value").startswith("#"))
    return lines.select(F.to_date(F.substring("value", 9, 10), "MM dd yyyy").alias("day")).distinct()


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    return parse_holidays(spark.read.text(path))


def parse_cem(raw: DataFrame) -> DataFrame:
    """Measured hours of stacks: (oris, boiler, hour_key, nox, so2, gload, sload, heat) as floats, negatives as 0.

    ``hour_key`` is 'yyMMdd HH' in standard time; of lines for the same hour the last in the file counts.
    """
    value = lambda i: F.greatest(codes.number(F.col(f"c{i}")), F.lit(0.0)).cast("float")
    rows = raw.where(codes.text(F.col("c0")) != "").select(codes.text(F.col("c0")).alias("oris"), codes.text(F.col("c1")).alias("boiler"), F.concat(F.col("c2"), F.lit(" "), F.lpad(F.trim("c3"), 2, "0")).alias("hour_key"), "line_id", *[value(i).alias(n) for i, n in zip(range(4, 9), ("nox", "so2", "gload", "sload", "heat"))])
    return last_line(rows, ["oris", "boiler", "hour_key"]).drop("line_id")


def read_cem(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_cem(spark.read.csv(paths, schema=", ".join(f"c{i} string" for i in range(9))).select("*", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("line_id")))


def parse_spec_ref(lines: DataFrame) -> DataFrame:
    """(scc, pol, code)."""
    f = F.col("f")
    rows = _fields(lines, skip="#/").select("line_id", _longer_scc(_strip(f[0], '"')).alias("scc"), _strip(f[2], '"').alias("pol"), _strip(f[1], '"').alias("code"))
    return last_line(rows, ["scc", "pol"]).drop("line_id")


def read_spec_ref(spark: SparkSession, path: str) -> DataFrame:
    return parse_spec_ref(numbered_lines(spark, path))


def parse_spec_combo(lines: DataFrame) -> DataFrame:
    """(period, pol, country_fips, code, fraction); period 0 is the year, 1 to 12 are months."""
    rows = _fields(lines, skip="#/").withColumn("f", F.transform("f", lambda x: _strip(x)))
    f, n = F.col("f"), F.size("f")
    period = f[2].cast("int")
    period = F.when(period.between(0, 12), period).otherwise(F.raise_error(F.concat(F.lit("invalid period "), f[2])).cast("int"))
    place = F.when(F.length(f[1]) == 5, F.concat(F.lit("0"), f[1])).otherwise(f[1])
    pairs = rows.select("line_id", period.alias("period"), f[0].alias("pol"), place.alias("country_fips"), F.element_at(f, -1).cast("double").alias("total"), "f", F.explode(F.sequence(F.lit(4), n - 2, F.lit(2))).alias("i"))
    split = pairs.select("line_id", "period", "pol", "country_fips", f[F.col("i")].alias("code"), (f[F.col("i") + 1].cast("double") / F.col("total")).alias("fraction"))
    return last_line(split, ["period", "pol", "country_fips", "code"]).drop("line_id")


def read_spec_combo(spark: SparkSession, path: str) -> DataFrame:
    return parse_spec_combo(numbered_lines(spark, path))


def _with_header(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.col(f"`{c}`").alias(c.lower()) for c in raw.columns])


def parse_species(raw: DataFrame) -> DataFrame:
    """(species_id, name, mw); a blank weight is NaN, so that what depends on it is NaN too."""
    weight = F.when(F.coalesce("spec_mw", F.lit("")) == "", F.lit(math.nan)).otherwise(F.col("spec_mw").cast("double"))
    return raw.select(F.col("id").alias("species_id"), "name", weight.alias("mw"))


def read_species(spark: SparkSession, path: str) -> DataFrame:
    return parse_species(_with_header(spark, path))


def parse_voc_to_tog(raw: DataFrame) -> DataFrame:
    """(code, factor); a blank factor is 1."""
    return raw.select(F.col("p_number").alias("code"), F.when(F.coalesce("voctotog", F.lit("")) == "", F.lit(1.0)).otherwise(F.col("voctotog").cast("double")).alias("factor"))


def read_voc_to_tog(spark: SparkSession, path: str) -> DataFrame:
    return parse_voc_to_tog(_with_header(spark, path))


def read_profiles(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(kind, code, species_id, fraction) from one file for each kind (voc, gas, pm); the last line of a species wins, fractions of a code add up to 1."""
    parts = []
    for kind, path in paths.items():
        raw = _with_header(spark, path)
        parts.append(raw.select(F.lit(kind).alias("kind"), "p_number", "species_id", "weight_per", F.monotonically_increasing_id().alias("line_id")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return parse_profiles(out)


def parse_profiles(raw: DataFrame) -> DataFrame:
    """The same from rows (kind, p_number, species_id, weight_per, line_id)."""
    weight = F.when(F.coalesce("weight_per", F.lit("")) == "", F.lit(0.0)).otherwise(F.col("weight_per").cast("double"))
    kept = last_line(raw.select("kind", F.col("p_number").alias("code"), "species_id", weight.alias("fraction"), "line_id"), ["kind", "code", "species_id"])
    return normalised(kept.drop("line_id"), ["kind", "code"], "fraction")


def _not_negative(c: Column) -> Column:
    value = codes.number(c)
    return F.when(value < 0, F.lit(math.nan)).otherwise(value)


def read_mechanisms(spark: SparkSession, assignment: str, group_weights: str, species_info: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mech, species_id, grp, ratio), (mech, grp, basis, mw) and (species_id, name, mw); negative weights are NaN."""
    plain = lambda path, n: spark.read.csv(path, schema=", ".join(f"c{i} string" for i in range(n)))
    return parse_mechanisms(plain(assignment, 4), plain(group_weights, 4), plain(species_info, 9))


def parse_mechanisms(assignment: DataFrame, group_weights: DataFrame, species_info: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same from columns c0, c1, ... of text."""
    a = assignment.select(F.col("c0").alias("mech"), F.col("c1").alias("species_id"), F.col("c2").alias("grp"), codes.number(F.col("c3")).alias("ratio"))
    w = group_weights.select(F.col("c0").alias("mech"), F.col("c2").alias("grp"), F.col("c1").alias("basis"), _not_negative(F.col("c3")).alias("mw"))
    s = species_info.select(F.col("c0").alias("species_id"), F.col("c1").alias("name"), _not_negative(F.col("c8")).alias("mw"))
    return a, w, s


def parse_scc_descriptions(raw: DataFrame) -> DataFrame:
    n = F.length("c0")
    code = F.when(n >= 10, F.col("c0")).when(n == 8, F.concat(F.lit("00"), F.col("c0"))).when(n == 9, F.concat(F.col("c0"), F.lit("0"))).otherwise(F.raise_error(F.concat(F.lit("invalid scc "), F.col("c0"))).cast("string"))
    return raw.select(code.alias("code"), _cut(F.coalesce("c1", F.lit(""))).alias("description"))


def read_scc_descriptions(spark: SparkSession, path: str) -> DataFrame:
    return parse_scc_descriptions(spark.read.csv(path, schema="c0 string, c1 string", comment="#"))


def _clean(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit("")), F.lit('"'))


def parse_sic_descriptions(lines: DataFrame) -> DataFrame:
    lines = lines.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return lines.select(F.trim(F.substring("value", 1, 4)).alias("code"), _clean(F.substring("value", 6, 1 << 20)).alias("description"))


def read_sic_descriptions(spark: SparkSession, path: str) -> DataFrame:
    return parse_sic_descriptions(spark.read.text(path))


def parse_naics_descriptions(lines: DataFrame) -> DataFrame:
    lines = lines.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    f = F.split("value", ",")
    return lines.select(_strip(f[0], '"').alias("code"), _clean(f[1]).alias("description"))


def read_naics_descriptions(spark: SparkSession, path: str) -> DataFrame:
    return parse_naics_descriptions(spark.read.text(path))


def parse_tier1(raw: DataFrame) -> DataFrame:
    """(scc, tier1) from the crosswalk; one-digit tiers get a zero in front."""
    code = _longer_scc(F.col("c0"))
    checked = F.when(F.length(code) == 10, code).otherwise(F.raise_error(F.concat(F.lit("invalid SCC code "), code)).cast("string"))
    return raw.select(checked.alias("scc"), F.when(F.length("c16") == 1, F.lpad("c16", 2, "0")).otherwise(F.col("c16")).alias("tier1"))


def read_tier1(spark: SparkSession, path: str) -> DataFrame:
    return parse_tier1(spark.read.csv(path, schema=", ".join(f"c{i} string" for i in range(17)), header=True, enforceSchema=True))


def parse_trends(raw: DataFrame) -> DataFrame:
    """(state, tier1, pol, yr, emis) from a table with a column emissionsYY for each year; blanks and '...' are 0."""
    years = [c for c in raw.columns if c.startswith("emissions")]
    long = raw.unpivot(["state", "tier1", "pol"], years, "name", "text")
    short = F.substring("name", 10, 4).cast("int")
    year = F.when(short > 99, short).when(short > 50, short + 1900).otherwise(short + 2000)
    amount = F.when(F.trim(F.coalesce("text", F.lit(""))).isin("", "..."), F.lit(0.0)).otherwise(F.trim("text").cast("double"))
    return long.select("state", "tier1", "pol", year.alias("yr"), amount.alias("emis"))


def read_trends(spark: SparkSession, path: str) -> DataFrame:
    return parse_trends(_with_header(spark, path))
