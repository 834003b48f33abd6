"""Scaling inventories between years with state trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroflux.functions.codes import scaling_family

# State codes that are never scaled, and codes that take another state's trend.
UNSCALED_STATES = ["72", "78"]
STAND_INS, STAND_IN_FOR = ["85", "88", "98"], "06"


def trend_factors(trends: DataFrame, base_year: int, scale_year: int) -> DataFrame:
    """(state, tier1, pol, factor): target by base; 0 where the base is 0. A year that the table lacks fails."""
    have = {r[0] for r in trends.select("yr").where(F.col("yr").isin(base_year, scale_year)).distinct().collect()}
    if missing := {base_year, scale_year} - have:
        raise ValueError(f"no trend for {sorted(missing)}")
    of = lambda year: F.sum(F.when(F.col("yr") == year, F.col("emis")))
    both = trends.where(F.col("yr").isin(base_year, scale_year)).groupBy("state", "tier1", "pol").agg(of(base_year).alias("base"), of(scale_year).alias("target"))
    factor = F.lit(1.0) if base_year == scale_year else F.when(F.coalesce("base", F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.coalesce("target", F.lit(0.0)) / F.col("base"))
    return both.select("state", "tier1", "pol", factor.alias("factor"))


def state_of(fips: Column) -> Column:
    state = F.substring(fips, 1, 2)
    return F.when(state.isin(STAND_INS), STAND_IN_FOR).otherwise(state)


def with_trend(emissions: DataFrame, tier1: DataFrame, factors: DataFrame) -> DataFrame:
    """emissions with trend_factor: by state, tier and pollutant family; 1 abroad, in unscaled states and without a trend.

    A domestic source whose SCC has no tier fails.
    """
    tiered = emissions.join(tier1.select("scc", "tier1"), "scc", "left")
    domestic = F.col("country") == 0
    tier = F.when(domestic & F.col("tier1").isNull(), F.raise_error(F.concat(F.lit("no tier for SCC "), F.col("scc"))).cast("string")).otherwise(F.col("tier1"))
    keyed = tiered.withColumn("tier1", tier).withColumn("state", state_of(F.col("fips"))).withColumn("pol", scaling_family(F.col("pollutant")))
    joined = keyed.join(factors, ["state", "tier1", "pol"], "left")
    use = domestic & ~F.col("state").isin(UNSCALED_STATES)
    return joined.withColumn("trend_factor", F.when(use, F.coalesce("factor", F.lit(1.0))).otherwise(F.lit(1.0))).drop("factor", "state", "tier1", "pol")


def apply_trends(emissions: DataFrame, tier1: DataFrame, factors: DataFrame) -> DataFrame:
    return with_trend(emissions, tier1, factors).withColumn("rate", F.col("rate") * F.col("trend_factor")).drop("trend_factor")
