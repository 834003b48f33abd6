"""As-of joins: to each row the latest row of a time series at or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_time(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, name: str) -> DataFrame:
    """(by, left_time, name): the distinct times of left with the latest time of right at or before each, null if there is none.

    Both sides' distinct times of a key lie one behind the other in one sorted window, so the work follows the number of times, not their product; keys that are null match nothing.
    """
    if by:
        known = F.forall(F.array(*(F.col(c).isNotNull() for c in by)), lambda x: x)
    else:
        known = F.lit(True)
    kind = lambda df, time, stamp, side: df.where(known & F.col(time).isNotNull()).select(*by, F.col(time).alias("_time")).distinct().select(*by, "_time", stamp.alias("_stamp"), F.lit(side).alias("_side"))
    both = kind(left, left_time, F.lit(None).cast("timestamp"), 1).unionByName(kind(right, right_time, F.col("_time").cast("timestamp"), 0))
    order = Window.partitionBy(*by).orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(name, F.last("_stamp", ignorenulls=True).over(order)).where(F.col("_side") == 1).select(*by, F.col("_time").alias(left_time), name)


def join_as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, tolerance_hours: float | None = None) -> DataFrame:
    """left with right's rows of the latest time at or before its own, as a left join; right may hold several rows of one time.

    ``tolerance_hours``: older rows don't count. Columns of right but the keys must not be columns of left.
    """
    found = latest_time(left, right, by, left_time, right_time, "_as_of")
    if tolerance_hours is not None:
        age = F.timestamp_diff("SECOND", F.col("_as_of"), F.col(left_time))
        found = found.withColumn("_as_of", F.when(age <= tolerance_hours * 3600, F.col("_as_of")))
    timed = left.join(found, [*by, left_time], "left")
    return timed.join(right.withColumn("_as_of", F.col(right_time)), [*by, "_as_of"], "left").drop("_as_of")
