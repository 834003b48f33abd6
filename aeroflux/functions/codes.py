"""Column expressions for the codes and numbers of inventory files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The countries an inventory may name, and their one-digit codes.
COUNTRY_CODES = {"USA": 0, "US": 0, "CANADA": 1, "CA": 1, "CAN": 1, "MEXICO": 2, "MEX": 2, "MX": 2, "CUBA": 3, "BAHAMAS": 4, "HAITI": 5, "DOMINICANREPUBLIC": 6}

# Pollutants that scale with a family's trend.
PM25_FAMILY = ["PM2_5", "PM25-PRI", "OC", "EC", "PMFINE", "SO4", "NO3", "PTI", "PSO4", "PSI", "POC", "PNO3", "PNH4", "PMOTHR", "PMN", "PMG", "PM25", "PK", "PFE", "PEC", "PCL", "PCA", "DIESEL-PM25", "PAL"]
VOC_FAMILY = ["XYL", "UNR", "TOL", "TERP", "PAR", "OLE", "NVOL", "MEOH", "ISOP", "IOLE", "FORM", "ETOH", "ETHA", "ETH", "VOC_INV", "NMOG", "NHTOG", "ETHANOL", "CB05_XYL", "CB05_TOL", "CB05_PAR", "CB05_OLE", "CB05_MEOH", "CB05_ISOP", "CB05_IOLE", "CB05_FORM", "CB05_ETOH", "CB05_ETHA", "CB05_ETH", "CB05_BENZENE", "CB05_ALDX", "CB05_ALD2", "ALDX", "ALD2"]
NOX_FAMILY = ["NO2", "NO", "HONO"]

#: Stand for a missing number or code.
MISSING = "-9"


def text(c: Column) -> Column:
    """Without quotation marks and spaces around it; null is empty."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit('" '))


def apart(c: Column) -> Column:
    """c itself, by a higher-order function: Spark compiles a projection that has one apart, in many short methods. A projection of dozens of fields in a whole stage is one method, which is too long for the JVM's compiler and stays interpreted. What stands inside ``apart`` is not compiled at all, so c should be a plain column."""
    return F.transform(F.array(c), lambda x: x)[0]


def number(c: Column) -> Column:
    """Empty, null and -9 are 0; what isn't a number fails."""
    trimmed = F.trim(F.coalesce(c, F.lit("")))
    return F.when(trimmed.isin("", MISSING), F.lit(0.0)).otherwise(trimmed.cast("double"))


def fips(c: Column) -> Column:
    """Inner spaces become zeros, codes of one to four characters get zeros in front."""
    code = F.translate(text(c), " ", "0")
    return F.when(F.length(code).between(1, 4), F.lpad(code, 5, "0")).otherwise(code)


def scc(c: Column) -> Column:
    """Two to eight characters get two zeros in front and zeros behind up to ten."""
    code = text(c)
    return F.when(F.length(code).between(2, 8), F.rpad(F.concat(F.lit("00"), code), 10, "0")).otherwise(code)


def padded_behind(c: Column, length: int) -> Column:
    """Zeros behind up to the length; empty and -9 are empty."""
    code = text(c)
    longer = F.when(F.length(code) < length, F.rpad(code, length, "0")).otherwise(code)
    return F.when(code.isin("", MISSING), F.lit("")).otherwise(F.translate(longer, " ", "0"))


def naics(c: Column) -> Column:
    return padded_behind(c, 6)


def sic(c: Column) -> Column:
    return padded_behind(c, 4)


def pollutant(c: Column) -> Column:
    """Name of PREFIX__NAME."""
    parts = F.split(text(c), "__")
    return F.when(F.size(parts) > 1, parts[1]).otherwise(parts[0])


def prefix(c: Column) -> Column:
    """Prefix of PREFIX__NAME, or empty."""
    parts = F.split(text(c), "__")
    return F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit(""))


def full_name(pollutant: str | Column = "pollutant", prefix: str | Column = "prefix") -> Column:
    name, front = (F.col(x) if isinstance(x, str) else x for x in (pollutant, prefix))
    return F.when(front == "", name).otherwise(F.concat(front, F.lit("__"), name))


def country_of_name(c: Column) -> Column:
    """Code of a country's name; a name that isn't known fails."""
    known = F.create_map(*[F.lit(x) for pair in COUNTRY_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, c), F.raise_error(F.concat(F.lit("unknown country: "), F.coalesce(c, F.lit("null")))).cast("int"))


def country_of_digit(c: Column) -> Column:
    """Code of the leading digit of a six-digit FIPS."""
    return F.when(c.rlike("^[0-6]$"), F.try_to_number(c, F.lit("9")).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown country code: "), F.coalesce(c, F.lit("null")))).cast("int"))


def record_key(*parts: str) -> Column:
    """Label of a source: its codes one after another."""
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


def scaling_family(c: Column) -> Column:
    """PM25, VOC or NOX for members of these families, else the name itself."""
    return F.when(c.isin(PM25_FAMILY), F.lit("PM25")).when(c.isin(VOC_FAMILY), F.lit("VOC")).when(c.isin(NOX_FAMILY), F.lit("NOX")).otherwise(c)


def control(c: Column, blank: float) -> Column:
    """Control percentages: blank has a default of its own, -9 is 0."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(blank)).otherwise(number(c))
