"""Hierarchical code matching and last-line-wins look-ups.

A code falls back to itself with 1, 2, ... trailing characters replaced by zeros. A code that meets a reference row at some fallback also meets it at the one that zeroes as many characters as the row has trailing zeros, and of two rows the one with fewer zeros is met first. So the reference's numbers of trailing zeros are an index of levels: only fallbacks of those levels are tried, and a level that the reference doesn't hold costs nothing. Only distinct codes are expanded; the fact table is joined to the result, never multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidates(code: Column) -> Column:
    """The code and its fallbacks, most specific first."""
    n = F.length(code)
    return F.transform(F.sequence(F.lit(0), n), lambda i: fallback(code, i))


def fallback(code: Column, zeros: Column) -> Column:
    """The code with so many trailing characters replaced by zeros."""
    n = F.length(code)
    return F.rpad(F.substring(code, F.lit(1), n - zeros), n, "0")


def trailing_zeros(code: Column) -> Column:
    return F.length(code) - F.length(F.rtrim(code, F.lit("0")))


def level_of(columns: list[str]) -> Column:
    return F.struct(*(trailing_zeros(F.col(c)).alias(f"z{k}") for k, c in enumerate(columns)))


def levels(ref: DataFrame, columns: list[str]) -> Column:
    """The level index of a reference: the distinct numbers of trailing zeros of its codes, as one array of structs z0, z1, ...; its size is bounded by the codes' lengths."""
    return ref.agg(F.collect_set(F.when(F.forall(F.array(*columns), lambda c: c.isNotNull()), level_of(columns))).alias("levels")).scalar()


def _matched(df: DataFrame, columns: list[str], ref: DataFrame, ref_columns: list[str], value: str, by: list[str]) -> DataFrame:
    """Each distinct (by, columns) with the value of its most specific row of ref."""
    codes = df.select(*by, *columns).distinct()
    tried = codes.select("*", F.explode(levels(ref, ref_columns)).alias("_level"))
    within = [F.col(f"_level.z{k}") <= F.length(c) for k, c in enumerate(columns)]
    for test in within:
        tried = tried.where(test)
    tries = tried.select("*", *(fallback(F.col(c), F.col(f"_level.z{k}")).alias(f"_try{k}") for k, c in enumerate(columns)))
    # a row is met at its own level only, so that zeros inside a code don't make an earlier level of it
    keyed = ref.select(*by, *(F.col(c).alias(f"_try{k}") for k, c in enumerate(ref_columns)), F.col(value).alias("_value"), level_of(ref_columns).alias("_level"))
    found = tries.join(keyed, [*by, *(f"_try{k}" for k in range(len(columns))), "_level"])
    return found.groupBy(*by, *columns).agg(F.min_by("_value", "_level").alias(value))


def _class_key(place: int | Column, code: Column) -> Column:
    return F.concat((F.lit(place) if isinstance(place, int) else place).cast("string"), F.lit(":"), code)


def _listed(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, _at, _code): the distinct codes of all columns, in one pass over df."""
    each = F.array(*(F.struct(F.lit(k).alias("_at"), F.col(c).alias("_code")) for k, c in enumerate(columns)))
    return df.select(*by, F.explode(each).alias("_c")).select(*by, "_c._at", "_c._code").distinct()


def _classes(df: DataFrame, columns: list[str], ref: DataFrame, ref_columns: list[str], by: list[str]) -> DataFrame:
    """(by, _key, _class): each distinct code of the columns with its class, the most specific code of the reference that it meets. Code and class meet the same less specific ones, so pairs of codes match as pairs of classes do. One row for each code of a list, so small that it can be sent to all executors; one table serves both columns, told apart by their keys, so that df is read once for both."""
    of_level = F.lit(None)
    for k, c in enumerate(ref_columns):
        of_level = F.when(F.col("_at") == k, levels(ref, [c])).otherwise(of_level)
    tried = _listed(df, columns, by).select("*", F.explode(of_level).alias("_level")).where(F.col("_level.z0") <= F.length("_code"))
    tries = tried.withColumn("_try", fallback(F.col("_code"), F.col("_level.z0")))
    own = _listed(ref, ref_columns, by).select(*by, "_at", F.col("_code").alias("_try"), F.col("_code").alias("_value"), level_of(["_code"]).alias("_level"))
    found = tries.join(own, [*by, "_at", "_try", "_level"]).groupBy(*by, "_at", "_code").agg(F.min_by("_value", "_level").alias("_class"))
    return found.select(*by, _class_key(F.col("_at"), F.col("_code")).alias("_key"), "_class")


def match_code(df: DataFrame, column: str, ref: DataFrame, ref_column: str, value: str, by: list[str] | None = None, required: bool = False) -> DataFrame:
    """df with the value of the most specific matching row of ref; null without a match, or an error if required.

    ``by`` names columns, alike on both sides, that must be equal.
    """
    by = by or []
    out = df.join(_matched(df, [column], ref, [ref_column], value, by), [*by, column], "left")
    return _required(out, value, F.col(column)) if required else out


def match_code_double(df: DataFrame, first: str, second: str, ref: DataFrame, ref_first: str, ref_second: str, value: str, by: list[str] | None = None, required: bool = False, codes: DataFrame | None = None) -> DataFrame:
    """As match_code with two codes: the first code's fallbacks are the outer loop, the second's the inner one. Fallbacks are tried on pairs of classes (see _classes), never on pairs of codes.

    Pairs of classes are made of the reference's own codes, so their table is as large as the reference allows, whatever the rows; classes and pairs are sent to all executors, and df is never shuffled. ``codes`` is a table of the same codes that is cheaper to read than df.
    """
    by = by or []
    classes = _classes(df if codes is None else codes, [first, second], ref, [ref_first, ref_second], by)
    classed = df
    for k, (column, name) in enumerate(((first, "_first"), (second, "_second"))):
        own = classes.select(*by, F.col("_key").alias(f"_key{k}"), F.col("_class").alias(name))
        classed = classed.withColumn(f"_key{k}", _class_key(k, F.col(column))).join(F.broadcast(own), [*by, f"_key{k}"], "left")
    firsts, seconds = (ref.select(*by, F.col(c).alias(name)).distinct() for c, name in ((ref_first, "_first"), (ref_second, "_second")))
    pairs = firsts.join(F.broadcast(seconds), by) if by else firsts.crossJoin(F.broadcast(seconds))
    found = _matched(pairs, ["_first", "_second"], ref, [ref_first, ref_second], value, by)
    out = classed.join(F.broadcast(found), [*by, "_first", "_second"], "left").select(*df.columns, value)
    return _required(out, value, F.concat_ws("/", first, second)) if required else out


def _required(df: DataFrame, value: str, what: Column) -> DataFrame:
    missing = F.raise_error(F.concat(F.lit(f"no {value} for "), what)).cast(df.schema[value].dataType)
    return df.withColumn(value, F.coalesce(F.col(value), missing))


def last_line(df: DataFrame, keys: list[str], line: str = "line_id") -> DataFrame:
    """The row with the highest line of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(line)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
