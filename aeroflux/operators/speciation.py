"""Speciation of lumped pollutants into species and mechanism groups, as joins along the emissions table.

Tables: speciation(pollutant_key, spec_type), spec_names(pollutant_key, pos, name, grouped), spec_profile(pollutant_key, species, factor), species(species_id, name, mw), voc_to_tog(code, factor), profiles(kind, code, species_id, fraction), spec_ref(scc, pol, code), spec_combo(period, pol, country_fips, code, fraction), group_factors(mech, species_id, grp, molar, mass).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroflux.functions import periods
from aeroflux.functions.codes import full_name
from aeroflux.operators.emissions import amount, total_unit
from aeroflux.operators.matching import fallback, level_of, levels, match_code_double

# Speciation types and the kind of profile each takes.
PROFILE_KIND = {"VOC": "voc", "VOCUngrouped": "voc", "NOx": "gas", "PM2.5": "pm"}


@dataclass(frozen=True)
class SpeciationData:
    """The reference tables of one speciation run."""

    speciation: DataFrame
    spec_names: DataFrame
    spec_profile: DataFrame
    species: DataFrame
    voc_to_tog: DataFrame
    profiles: DataFrame
    spec_ref: DataFrame
    spec_combo: DataFrame
    group_factors: DataFrame

    def persisted(self) -> SpeciationData:
        """The same tables, kept by executors after their first use; they are small against emissions, and a lost executor's part is read again."""
        return SpeciationData(*(getattr(self, f.name).persist(StorageLevel.MEMORY_AND_DISK) for f in fields(self)))


def group_factors(assignment: DataFrame, group_weights: DataFrame, species: DataFrame) -> DataFrame:
    """(mech, species_id, grp, molar, mass): kmol of a group for a kg of the species, and its share of the mass.

    A group's ratio is moles for each mole of the species; mass shares weigh ratios by the groups' weights and add up to 1.
    """
    joined = assignment.join(species.select("species_id", F.col("mw").alias("species_mw")), "species_id").join(group_weights.select("mech", "grp", F.col("mw").alias("group_mw")), ["mech", "grp"], "left")
    molar = F.col("ratio") / F.nullif(F.col("species_mw"), F.lit(0.0))
    weighed = molar * F.coalesce("group_mw", F.lit(math.nan))
    total = F.sum(weighed).over(Window.partitionBy("mech", "species_id"))
    return joined.select("mech", "species_id", "grp", molar.alias("molar"), (weighed / F.nullif(total, F.lit(0.0))).alias("mass"))


def with_type(emissions: DataFrame, speciation: DataFrame, spec_names: DataFrame, spec_profile: DataFrame) -> DataFrame:
    """emissions with spec_key and spec_type: the full name's entry, else the name's; without a stated type, names make it Single and a profile Direct; else it fails."""
    names = spec_names.select("pollutant_key").distinct().withColumn("has_names", F.lit(True))
    profile = spec_profile.select("pollutant_key").distinct().withColumn("has_profile", F.lit(True))
    about = speciation.join(names, "pollutant_key", "left").join(profile, "pollutant_key", "left")
    kind = F.when(F.coalesce("spec_type", F.lit("")) != "", F.col("spec_type")).when(F.col("has_names"), "Single").when(F.col("has_profile"), "Direct")
    table = about.select("pollutant_key", kind.alias("spec_type"))
    full = table.select(F.col("pollutant_key").alias("full_name"), F.struct(F.col("pollutant_key").alias("key"), F.col("spec_type").alias("type")).alias("by_full"))
    name = table.select(F.col("pollutant_key").alias("pollutant"), F.struct(F.col("pollutant_key").alias("key"), F.col("spec_type").alias("type")).alias("by_name"))
    found = emissions.withColumn("full_name", full_name()).join(full, "full_name", "left").join(name, "pollutant", "left").withColumn("spec", F.coalesce("by_full", "by_name"))
    missing = F.raise_error(F.concat(F.lit("no speciation type for "), F.col("full_name"))).cast("string")
    return found.withColumn("spec_key", F.col("spec.key")).withColumn("spec_type", F.coalesce(F.col("spec.type"), missing)).drop("by_full", "by_name", "spec")


def profile_codes(emissions: DataFrame, spec_ref: DataFrame, spec_combo: DataFrame, partial: bool) -> DataFrame:
    """emissions with the code and fraction of their speciation profiles; a combination gives several rows.

    The full name is looked up before the name. ``partial`` falls back to less specific codes; pollutant texts fall back as well, so rows for zeros serve all.
    """
    keys = ["scc", "full_name", "pollutant"]
    found = _profile_of(_names(emissions), spec_ref, partial).groupBy(*keys).agg(F.min_by("code", _first_code()).alias("code"))
    coded = emissions.join(F.broadcast(found), keys, "left")
    missing = F.raise_error(F.concat(F.lit("no speciation profile for "), F.concat_ws("/", "scc", "full_name"))).cast("string")
    coded = combined(coded.withColumn("code", F.coalesce("code", missing)), spec_combo, partial, emissions)
    several = F.coalesce(F.col("combined").cast(CODES), F.raise_error(F.concat(F.lit("no combination for "), F.concat_ws("/", "pollutant", "country_fips"))).cast(CODES))
    codes = F.when(F.col("code") == "COMBO", several).otherwise(F.array(F.struct(F.col("code"), F.lit(1.0).alias("fraction"))).cast(CODES))
    return coded.select(*emissions.columns, F.explode(codes).alias("c")).select(*emissions.columns, F.col("c.code").alias("code"), F.col("c.fraction").alias("code_fraction"))


def with_place(emissions: DataFrame) -> DataFrame:
    """emissions with the period and the country_fips that combinations are stated for."""
    return emissions.withColumns({"period": periods.period_of(F.col("begin_ts"), F.col("end_ts")), "country_fips": F.concat(F.col("country").cast("string"), F.col("fips"))})


def combined(df: DataFrame, spec_combo: DataFrame, partial: bool, emissions: DataFrame) -> DataFrame:
    """df with ``combined``, the codes with fractions of the combination for its period, pollutant and place, null without one; its codes are those of emissions, which is cheaper to read."""
    grouped = spec_combo.groupBy("period", "pol", "country_fips").agg(F.collect_list(F.struct("code", "fraction")).alias("combined"))
    placed = df if "country_fips" in df.columns else with_place(df)
    if partial:
        return match_code_double(placed, "pollutant", "country_fips", grouped, "pol", "country_fips", "combined", by=["period"], codes=with_place(emissions))
    return placed.join(F.broadcast(grouped.withColumnRenamed("pol", "pollutant")), ["period", "pollutant", "country_fips"], "left")


CODES = "array<struct<code:string,fraction:double>>"
OUT = ["record_key", "pollutant", "prefix", "begin_ts", "end_ts", "rate", "unit"]


def _groups(data: SpeciationData, mechanism: str, mass: bool) -> DataFrame:
    """(species_id, groups): a species' mechanism groups with the factor of each."""
    mine = data.group_factors.where(F.col("mech") == mechanism)
    return mine.groupBy("species_id").agg(F.collect_list(F.struct("grp", F.col("mass" if mass else "molar").alias("factor"))).alias("groups"))


def _entries(data: SpeciationData, groups: DataFrame) -> DataFrame:
    """(pollutant_key, entry): what is said of each pollutant: its type, the species it stands for if it is single, all species it states, its shares if it is direct.

    The first of a single pollutant's names gives its species; a name's species is the one with the smallest identifier.
    """
    known = data.species.groupBy("name").agg(F.min_by(F.struct("species_id", "mw"), "species_id").alias("s")).select("name", "s.species_id", "s.mw")
    named = data.spec_names.join(known, "name", "left").join(groups, "species_id", "left")
    single = F.min_by(F.when(F.col("pos") == 0, F.struct("name", "grouped", "species_id", "mw", "groups")), F.when(F.col("pos") == 0, F.lit(0)))
    names = named.groupBy("pollutant_key").agg(single.alias("single"), F.collect_set("species_id").alias("stated"))
    direct = data.spec_profile.groupBy("pollutant_key").agg(F.collect_list(F.struct("species", "factor")).alias("direct"))
    kind = F.when(F.coalesce("spec_type", F.lit("")) != "", F.col("spec_type")).when(F.col("stated").isNotNull(), "Single").when(F.col("direct").isNotNull(), "Direct")
    about = data.speciation.join(names, "pollutant_key", "left").join(direct, "pollutant_key", "left")
    return about.select("pollutant_key", F.struct(kind.alias("type"), "single", "stated", "direct").alias("entry"))


def _names(emissions: DataFrame) -> DataFrame:
    """(scc, full_name, pollutant, rank, name): the names under which each distinct key is looked up, in their order."""
    keys = ["scc", "full_name", "pollutant"]
    return emissions.select(*keys).distinct().select(*keys, F.posexplode(F.array_distinct(F.array("full_name", "pollutant"))).alias("rank", "name"))


def _profile_of(names: DataFrame, spec_ref: DataFrame, partial: bool) -> DataFrame:
    """names with the profile code of each level of the reference at which the name has one."""
    if not partial:
        return names.withColumn("level", F.lit(0)).join(spec_ref.select("scc", F.col("pol").alias("name"), "code"), ["scc", "name"], "left")
    tried = names.select("*", F.explode_outer(levels(spec_ref, ["scc", "pol"])).alias("level"))
    tried = tried.withColumns({"_scc": fallback(F.col("scc"), F.col("level.z0")), "_pol": fallback(F.col("name"), F.col("level.z1"))})
    fits = (F.col("level.z0") <= F.length("scc")) & (F.col("level.z1") <= F.length("name"))
    tried = tried.withColumn("_scc", F.when(fits, F.col("_scc")))
    ref = spec_ref.select(F.col("scc").alias("_scc"), F.col("pol").alias("_pol"), "code", level_of(["scc", "pol"]).alias("level"))
    return tried.join(ref, ["_scc", "_pol", "level"], "left")


def _first_code() -> Column:
    return F.when(F.col("code").isNotNull(), F.struct("rank", "level"))


def _resolved(emissions: DataFrame, data: SpeciationData, partial: bool) -> DataFrame:
    """(scc, full_name, pollutant, spec_key, code) of the distinct keys: for each the key of the entry and the profile code of its full name, else of its name."""
    known = data.speciation.select("pollutant_key", F.col("pollutant_key").alias("name")).distinct()
    typed = _names(emissions).join(F.broadcast(known), "name", "left")
    coded = _profile_of(typed, data.spec_ref, partial)
    return coded.groupBy("scc", "full_name", "pollutant").agg(F.min_by("pollutant_key", F.when(F.col("pollutant_key").isNotNull(), F.col("rank"))).alias("spec_key"), F.min_by("code", _first_code()).alias("code"))


def _profile_parts(data: SpeciationData, groups: DataFrame) -> DataFrame:
    """(kind, code, parts, tog): species of each profile with their shares, names, weights and groups; the profile's factor from VOC to TOG."""
    known = data.profiles.join(data.species.select("species_id", "name", "mw"), "species_id", "left").join(groups, "species_id", "left")
    parts = known.groupBy("kind", "code").agg(F.collect_list(F.struct("species_id", "fraction", "name", "mw", "groups")).alias("parts"))
    return parts.join(data.voc_to_tog.select("code", F.col("factor").alias("tog")), "code", "left")


def _coded(emissions: DataFrame, data: SpeciationData, entries: DataFrame, partial: bool) -> DataFrame:
    """emissions with what decides their results: spec_type, spec_key of their entry, the species that their record states, and kind, code and code_fraction of a profile; a combination gives several rows.

    Tables of codes and entries are sent to all executors; the rows are shuffled once, by their record, and carry keys, not entries.
    """
    rows = with_place(emissions.withColumn("full_name", full_name()))
    about = entries.select(F.col("pollutant_key").alias("spec_key"), F.col("entry.type").alias("spec_type"), F.when(F.col("entry.type") == "Single", F.col("entry.stated")).alias("_stated"))
    found = rows.join(F.broadcast(_resolved(rows, data, partial)), ["scc", "full_name", "pollutant"], "left").join(F.broadcast(about), "spec_key", "left")
    nothing = F.raise_error(F.concat(F.lit("no speciation type for "), F.col("full_name"))).cast("string")
    found = found.withColumn("spec_type", F.coalesce("spec_type", nothing))
    profiled = F.col("spec_type").isin(*PROFILE_KIND)
    stated = F.array_sort(F.array_distinct(F.flatten(F.collect_set("_stated").over(Window.partitionBy("record_key")))))
    found = combined(found.withColumn("stated", stated), data.spec_combo, partial, emissions)

    fail = lambda text, *what: F.raise_error(F.concat(F.lit(text), F.concat_ws("/", *what)))
    plain = F.array(F.struct(F.col("code"), F.lit(1.0).alias("fraction"))).cast(CODES)
    several = F.coalesce(F.col("combined").cast(CODES), fail("no combination for ", "pollutant", "country_fips").cast(CODES))
    codes = F.when(~profiled, F.array(F.lit(None).cast("struct<code:string,fraction:double>"))).when(F.col("code").isNull(), fail("no speciation profile for ", "scc", "full_name").cast(CODES)).when(F.col("code") == "COMBO", several).otherwise(plain)
    kind = F.lit(None).cast("string")
    for spec_type, name in PROFILE_KIND.items():
        kind = F.when(F.col("spec_type") == spec_type, name).otherwise(kind)
    return found.select(*emissions.columns, "spec_type", "spec_key", "stated", F.explode(codes).alias("c")).withColumns({"kind": kind, "code": F.col("c.code"), "code_fraction": F.col("c.fraction")}).drop("c")


def _spread(coded: DataFrame, data: SpeciationData, groups: DataFrame, entries: DataFrame, mechanism: str, mass: bool, keep: list[str], amount: str) -> DataFrame:
    """Every row's results, exploded once; ``amount`` is multiplied, ``doubled`` marks what a single pollutant states."""
    with_entry = coded.join(F.broadcast(entries.withColumnRenamed("pollutant_key", "spec_key")), "spec_key", "left")
    with_parts = with_entry.join(F.broadcast(_profile_parts(data, groups)), ["kind", "code"], "left").withColumn("results", _results(mechanism, mass))
    return with_parts.select(*keep, F.explode("results").alias("r")).withColumns({"pollutant": F.col("r.pollutant"), "unit": F.col("r.unit"), amount: F.col(amount) * F.col("r.factor"), "doubled": F.col("r.doubled")}).drop("r")


def speciate(emissions: DataFrame, data: SpeciationData, mechanism: str, mass: bool = False, partial: bool = False) -> tuple[DataFrame, DataFrame]:
    """(emissions, dropped) by species or mechanism group; dropped holds what single pollutants of the record state already.

    One pass: distinct keys are resolved to entries and codes, and every row gets one array of its results, whatever its type, which is exploded once. Species that a record states are gathered in a window over the record before rows multiply.
    """
    keep = [*(c for c in emissions.columns if c in ("sector", "file", "fips", "scc", "country")), *OUT]
    groups = _groups(data, mechanism, mass)
    entries = _entries(data, groups)
    out = _spread(_coded(emissions, data, entries, partial), data, groups, entries, mechanism, mass, keep, "rate")
    return out.where("NOT doubled").select(*keep), out.where("doubled").select(*keep)


def speciated_totals(emissions: DataFrame, data: SpeciationData, mechanism: str, by: list[str] | None = None, mass: bool = False, partial: bool = False) -> tuple[DataFrame, DataFrame]:
    """(totals, dropped) of speciate by the columns ``by`` of emissions: (by, pollutant, total, unit).

    Rows that become the same species in the same shares are added up before they multiply by species, so what is exploded follows codes, not records.
    """
    by = by or []
    groups = _groups(data, mechanism, mass)
    entries = _entries(data, groups)
    same = [*by, "unit", "spec_type", "spec_key", "stated", "kind", "code", "code_fraction"]
    coded = _coded(emissions, data, entries, partial).groupBy(*same).agg(F.sum(amount()).alias("total"))
    out = _spread(coded, data, groups, entries, mechanism, mass, [*by, "unit", "total"], "total")
    sums = out.groupBy(*by, "pollutant", total_unit().alias("unit"), "doubled").agg(F.sum("total").alias("total"))
    columns = [*by, "pollutant", "total", "unit"]
    return sums.where("NOT doubled").select(*columns), sums.where("doubled").select(*columns)


def _results(mechanism: str, mass: bool) -> Column:
    """What becomes of a row: array<struct<pollutant, unit, factor, doubled>>.

    VOC goes to mechanism groups, PM2.5 stays mass, the other gases are species in mass or moles; a single pollutant is its species or that one's groups; direct ones are split by their shares.
    """
    kind = F.col("spec_type")
    unit = F.lit("kg/s" if mass else "kmol/s")
    missing = lambda text, what: F.raise_error(F.concat(F.lit(text), F.coalesce(what, F.lit("")))).cast("string")
    result = lambda name, in_unit, factor, doubled=False: F.struct(name.alias("pollutant"), in_unit.alias("unit"), factor.cast("double").alias("factor"), F.lit(doubled).alias("doubled"))
    of_type = "array<struct<pollutant:string,unit:string,factor:double,doubled:boolean>>"
    moles = lambda factor, weight: factor if mass else factor / F.nullif(weight, F.lit(0.0))

    def in_groups(species: Column, groups: Column, factor: Column) -> Column:
        none = F.array(result(missing(f"mechanism {mechanism} has no species ", species), unit, factor))
        return F.coalesce(F.transform(groups, lambda g: result(g["grp"], unit, factor * g["factor"])), none).cast(of_type)

    voc = kind.isin("VOC", "VOCUngrouped")
    tog = F.when(voc, F.coalesce("tog", F.raise_error(F.concat(F.lit("no VOC factor for "), F.col("code"))).cast("double"))).otherwise(F.lit(1.0))

    def of_part(p: Column) -> Column:
        factor = tog * F.col("code_fraction") * p["fraction"]
        doubled = F.array(result(p["name"], F.col("unit"), factor, True)).cast(of_type)
        alone = F.when(kind == "PM2.5", F.array(result(p["name"], F.lit("kg/s"), factor)).cast(of_type)).otherwise(F.array(result(p["name"], unit, moles(factor, p["mw"]))).cast(of_type))
        return F.when(F.coalesce(F.array_contains("stated", p["species_id"]), F.lit(False)), doubled).when(kind == "VOC", in_groups(p["species_id"], p["groups"], factor)).otherwise(alone)

    one = F.col("entry.single")
    species = F.coalesce(one["species_id"].cast("string"), missing("no species is named ", one["name"]))
    # without a name at the first place the pollutant has no result
    of_single = F.when(one.isNull(), F.array().cast(of_type)).when(one["grouped"], in_groups(species, one["groups"], F.lit(1.0))).otherwise(F.array(result(F.when(species.isNotNull(), one["name"]), unit, moles(F.lit(1.0), one["mw"]))).cast(of_type))
    of_direct = F.transform(F.col("entry.direct"), lambda d: result(d["species"], F.col("unit"), d["factor"])).cast(of_type)
    no_profile = F.raise_error(F.concat(F.lit("no profile "), F.concat_ws("/", "kind", "code"))).cast(of_type)
    of_profile = F.coalesce(F.flatten(F.transform("parts", of_part)), no_profile)
    return F.when(kind == "Single", of_single).when(kind == "Direct", of_direct).otherwise(of_profile)
