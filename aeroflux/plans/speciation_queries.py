"""Queries of speciation over the inventory view."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroflux.functions.codes import full_name
from aeroflux.operators import emissions as em
from aeroflux.operators import speciation as sp
from aeroflux.plans.inventory_queries import emissions_of
from aeroflux.plans.views import numbers, oracle, view
from aeroflux.sources.references import normalised

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# Configuration of the queries: how each pollutant is split.
TYPES = [("VOC", "VOC"), ("NOX", "NOx"), ("PM2_5", "PM2.5"), ("EXH__VOC", "VOCUngrouped"), ("EXH__NOX", ""), ("EXH__PM2_5", "")]
DIRECT = [("EXH__PM2_5", "SOOT", 0.7), ("EXH__PM2_5", "ASH", 0.3)]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


def data_of(spark: SparkSession, sf_dir: str) -> sp.SpeciationData:
    species = view(spark, sf_dir, "species")
    one = species.agg(F.min("species_id").alias("s")).select(F.lit("EXH__NOX").alias("pollutant_key"), F.lit(0).alias("pos"), F.concat(F.lit("n "), F.col("s")).alias("name"), F.lit(False).alias("grouped"))
    shares = normalised(view(spark, sf_dir, "profile"), ["code"], "weight").select("code", F.col("species").alias("species_id"), F.col("weight").alias("fraction"))
    profiles = shares.select(F.explode(F.array(*map(F.lit, ("voc", "gas", "pm")))).alias("kind"), "*")
    return sp.SpeciationData(
        speciation=spark.createDataFrame(TYPES, "pollutant_key string, spec_type string"),
        spec_names=one,
        spec_profile=spark.createDataFrame(DIRECT, "pollutant_key string, species string, factor double"),
        species=species,
        voc_to_tog=view(spark, sf_dir, "brands").select(F.col("brand").alias("code"), (F.lit(1.0) + F.col("n") / 100).alias("factor")),
        profiles=profiles,
        spec_ref=view(spark, sf_dir, "spec_ref"),
        spec_combo=view(spark, sf_dir, "spec_combo").withColumn("fraction", F.col("fraction").cast("double")),
        group_factors=sp.group_factors(view(spark, sf_dir, "mech_assign").withColumn("ratio", F.col("ratio").cast("double")), view(spark, sf_dir, "mech_mw"), species),
    )


@query("""SELECT code, species, round(weight / sum(weight) OVER (PARTITION BY code), 9) AS fraction FROM {profile}""")
def normalised_profiles(spark, sf_dir):
    return normalised(view(spark, sf_dir, "profile"), ["code"], "weight").select("code", "species", F.round("weight", 9).alias("fraction"))


FACTORS = """SELECT a.mech, a.species_id, a.grp, a.ratio / s.mw AS molar, a.ratio / s.mw * w.mw / sum(a.ratio / s.mw * w.mw) OVER (PARTITION BY a.mech, a.species_id) AS mass FROM {mech_assign} a JOIN {species} s USING (species_id) JOIN {mech_mw} w ON w.mech = a.mech AND w.grp = a.grp"""


@query(f"SELECT mech, species_id, grp, round(molar, 9) AS molar, round(mass, 9) AS mass FROM ({FACTORS}) f")
def mechanism_factors(spark, sf_dir):
    return data_of(spark, sf_dir).group_factors.select("mech", "species_id", "grp", F.round("molar", 9).alias("molar"), F.round("mass", 9).alias("mass"))


TYPED = """SELECT *, CASE WHEN prefix = 'EXH' AND pollutant = 'VOC' THEN 'VOCUngrouped' WHEN prefix = 'EXH' AND pollutant = 'NOX' THEN 'Single' WHEN prefix = 'EXH' AND pollutant = 'PM2_5' THEN 'Direct' WHEN pollutant = 'VOC' THEN 'VOC' WHEN pollutant = 'NOX' THEN 'NOx' ELSE 'PM2.5' END AS spec_type, fips || scc || '0' AS record_key FROM {inv}"""


@query(f"SELECT pollutant, prefix, spec_type, count(*) AS n FROM ({TYPED}) t GROUP BY ALL")
def speciation_types(spark, sf_dir):
    data = data_of(spark, sf_dir)
    typed = sp.with_type(emissions_of(spark, sf_dir), data.speciation, data.spec_names, data.spec_profile)
    return typed.groupBy("pollutant", "prefix", "spec_type").agg(F.count(F.lit(1)).alias("n"))


CODED = f"""SELECT d.scc, d.pollutant, arg_min(r.code, s.i) AS code FROM (SELECT DISTINCT scc, pollutant FROM {{inv}}) d CROSS JOIN {numbers(11)} JOIN {{spec_ref}} r ON r.scc = rpad(substr(d.scc, 1, 10 - s.i), 10, '0') AND r.pol = d.pollutant GROUP BY ALL"""


@query(f"""SELECT scc, pollutant, b.brand AS code, round(f, 6) AS code_fraction FROM (SELECT c.scc, c.pollutant, c.code AS brand, 1.0 AS f FROM ({CODED}) c WHERE c.code <> 'COMBO'
UNION ALL SELECT c.scc, c.pollutant, k.code, k.fraction FROM ({CODED}) c JOIN (SELECT DISTINCT pol, code, fraction FROM {{spec_combo}}) k ON k.pol = c.pollutant WHERE c.code = 'COMBO') b""")
def speciation_codes(spark, sf_dir):
    data = data_of(spark, sf_dir)
    rows = emissions_of(spark, sf_dir).withColumn("full_name", full_name())
    coded = sp.profile_codes(rows.groupBy("scc", "pollutant").agg(F.min("full_name").alias("full_name"), F.min("begin_ts").alias("begin_ts"), F.min("end_ts").alias("end_ts"), F.lit(0).alias("country"), F.min("fips").alias("fips")).withColumn("begin_ts", F.lit("1996-01-01").cast("timestamp")).withColumn("end_ts", F.lit("1996-02-01").cast("timestamp")), data.spec_ref, data.spec_combo, partial=True)
    return coded.select("scc", "pollutant", "code", F.round("code_fraction", 6).alias("code_fraction"))


PARTS = f"""SELECT t.record_key, t.pollutant, t.prefix, t.spec_type, p.species_id, t.tons * 907.185 * c.f * p.fraction * CASE WHEN t.pollutant = 'VOC' THEN 1 + b.n / 100 ELSE 1 END AS amount
FROM ({TYPED}) t JOIN (SELECT c.scc, c.pollutant, c.code, 1.0 AS f FROM ({CODED}) c WHERE c.code <> 'COMBO' UNION ALL SELECT c.scc, c.pollutant, k.code, k.fraction FROM ({CODED}) c JOIN (SELECT DISTINCT pol, code, fraction FROM {{spec_combo}}) k ON k.pol = c.pollutant WHERE c.code = 'COMBO') c ON c.scc = t.scc AND c.pollutant = t.pollutant
JOIN (SELECT code, species AS species_id, weight / sum(weight) OVER (PARTITION BY code) AS fraction FROM {{profile}}) p ON p.code = c.code JOIN {{brands}} b ON b.brand = c.code WHERE t.spec_type NOT IN ('Single', 'Direct')"""
DOUBLED = f"""SELECT DISTINCT record_key, (SELECT min(species_id) FROM {{species}}) AS species_id FROM ({TYPED}) t WHERE spec_type = 'Single'"""


def speciated_sql(mass: bool) -> str:
    per = "1.0" if mass else "1 / s.mw"
    unit = "'kg'" if mass else "'kmol'"
    factor = "mass" if mass else "molar"
    return f"""WITH parts AS (SELECT p.* FROM ({PARTS}) p LEFT JOIN ({DOUBLED}) d ON d.record_key = p.record_key AND d.species_id = p.species_id WHERE d.record_key IS NULL)
SELECT pollutant, unit, round(sum(amount), 2) AS total FROM (
SELECT f.grp AS pollutant, {unit} AS unit, p.amount * f.{factor} AS amount FROM parts p JOIN ({FACTORS}) f ON f.species_id = p.species_id WHERE p.spec_type = 'VOC'
UNION ALL SELECT 'n ' || p.species_id, {unit}, p.amount * {per} FROM parts p JOIN {{species}} s ON s.species_id = p.species_id WHERE p.spec_type IN ('VOCUngrouped', 'NOx')
UNION ALL SELECT 'n ' || p.species_id, 'kg', p.amount FROM parts p WHERE p.spec_type = 'PM2.5'
UNION ALL SELECT 'n ' || s.species_id, {unit}, t.tons * 907.185 * {per} FROM ({TYPED}) t JOIN {{species}} s ON s.species_id = (SELECT min(species_id) FROM {{species}}) WHERE t.spec_type = 'Single'
UNION ALL SELECT x.species, 'kg', t.tons * 907.185 * x.factor FROM ({TYPED}) t JOIN (VALUES ('SOOT', 0.7), ('ASH', 0.3)) AS x(species, factor) ON t.spec_type = 'Direct') u GROUP BY ALL"""


def wrapped(sql: str) -> str:
    """The SQL's own WITH becomes one more view of the oracle's."""
    head = oracle(sql)
    first, rest = head.split("\nWITH parts AS ", 1)
    return f"{first},\nparts AS {rest}"


def speciated(spark: SparkSession, sf_dir: str, mass: bool) -> DataFrame:
    out, _ = sp.speciated_totals(emissions_of(spark, sf_dir), data_of(spark, sf_dir).persisted(), "M1", mass=mass, partial=True)
    return out.select("pollutant", "unit", F.round("total", 0 if mass else 2).alias("total"))


def speciated_moles(spark, sf_dir):
    return speciated(spark, sf_dir, False)


def speciated_mass(spark, sf_dir):
    return speciated(spark, sf_dir, True)


for _f, _mass in ((speciated_moles, False), (speciated_mass, True)):
    QUERIES[_f.__name__], ORACLE_SQL[_f.__name__] = _f, wrapped(speciated_sql(_mass).replace("round(sum(amount), 2)", "round(sum(amount), 0)" if _mass else "round(sum(amount), 2)"))


@query(f"""SELECT p.pollutant AS source, p.prefix, 'n ' || p.species_id AS pollutant, round(sum(p.amount), 1) AS total FROM ({PARTS}) p JOIN ({DOUBLED}) d ON d.record_key = p.record_key AND d.species_id = p.species_id GROUP BY ALL""".replace("p.pollutant AS source, ", ""))
def double_counted_species(spark, sf_dir):
    _, dropped = sp.speciated_totals(emissions_of(spark, sf_dir), data_of(spark, sf_dir).persisted(), "M1", ["prefix"], partial=True)
    return dropped.select("prefix", "pollutant", F.round("total", 1).alias("total"))


@query(f"""SELECT f.grp AS pollutant, 'kmol' AS unit, round(sum(t.tons * 907.185 * f.molar), 2) AS total FROM ({TYPED}) t JOIN ({FACTORS}) f ON f.species_id = (SELECT min(species_id) FROM {{species}}) WHERE t.spec_type = 'Single' GROUP BY ALL""")
def grouped_singles(spark, sf_dir):
    """A single pollutant that stands for a species' mechanism groups."""
    data = data_of(spark, sf_dir)
    grouped = replace(data, spec_names=data.spec_names.withColumn("grouped", F.lit(True))).persisted()
    out, _ = sp.speciate(emissions_of(spark, sf_dir).where("prefix = 'EXH' AND pollutant = 'NOX'"), grouped, "M1", partial=True)
    return out.groupBy("pollutant", em.total_unit().alias("unit")).agg(F.round(F.sum(em.amount()), 2).alias("total"))


def speciated_by_sector(spark, sf_dir):
    """Moles of groups and species by sector: rows are added up by their codes before they become species."""
    out, _ = sp.speciated_totals(emissions_of(spark, sf_dir), data_of(spark, sf_dir).persisted(), "M1", ["sector"], partial=True)
    return out.select("sector", "pollutant", "unit", F.round("total", 2).alias("total"))


QUERIES["speciated_by_sector"] = speciated_by_sector
ORACLE_SQL["speciated_by_sector"] = wrapped(
    speciated_sql(False)
    .replace("SELECT pollutant, unit, round(", "SELECT sector, pollutant, unit, round(")
    .replace("AS pollutant, 'kmol' AS unit, p.amount", "AS pollutant, p.sector, 'kmol' AS unit, p.amount")
    .replace("p.species_id, 'kmol', p.amount", "p.species_id, p.sector, 'kmol', p.amount")
    .replace("p.species_id, 'kg', p.amount", "p.species_id, p.sector, 'kg', p.amount")
    .replace("s.species_id, 'kmol', t.tons", "s.species_id, t.sector, 'kmol', t.tons")
    .replace("SELECT x.species, 'kg', t.tons", "SELECT x.species, t.sector, 'kg', t.tons")
    .replace("SELECT t.record_key, t.pollutant", "SELECT t.record_key, t.sector, t.pollutant")
)
