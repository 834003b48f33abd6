"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of shuffled documents. A document's virtual finish time is the source's cumulative tokens up to and including it, divided by the source's target; repeats of a source queue up behind its first pass. All queues are range-sorted together by finish time and cut at the total budget.

All of it is DataFrame work. Running sums never put a source, or the whole table, into one task: rows are dealt to buckets of their order, bucket totals (one row each) are summed up first, and a window adds the rest inside each bucket.

Defined results: a null text has size 0 and is never taken; null sources form one source that comes last; a null doc_id is shuffled like any other; repeated rows are documents of their own; when no document has a word all targets are 0; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroflux.llm.common import WORD, checkpoint

#: Weights by position of the source, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: The mix's size in terms of all tokens, and how often a source may be used.
SHARE, REPEATS = 1.5, 2
#: Hexadecimal digits of the shuffle key that make a bucket: 4,096 buckets of a source.
DIGITS = 3


def size_of_text(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """Target of every source from rows (source, source_size).

    Shares follow the weights; a source stops at repeats times its size and the excess goes to the others by weight. That is water filling: by rising cap per weight, the sources whose cap lies under the level of the rest are full.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int"))
    ranked = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
        .withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
    )
    reached = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    return found.withColumn("target", F.coalesce(F.least("cap", reached * F.col("weight")), F.col("cap"))).select("source", "source_size", "target")


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, doc_id, source, size, source_size, target, times, taken) for every document; times is how often the mix takes it. ``carry`` names further columns to keep."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = checkpoint(docs.select("doc_id", "source", *carry, (size_of_text() if size is None else size).alias("size")).withColumn("key", key).withColumn("row_id", F.monotonically_increasing_id()))
    bucket = F.substring("key", 1, DIGITS)
    # one row for each source and bucket: bounded by sources x 4,096
    cells = checkpoint(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("cell")))
    aims = targets(cells.groupBy("source").agg(F.sum("cell").alias("source_size")), weights, share, repeats)
    ahead = F.coalesce(F.sum("cell").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cells.withColumn("ahead", ahead).alias("c").join(aims.alias("a"), F.expr("c.source <=> a.source")).select("c.source", "bucket", "ahead", "source_size", "target")
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key", "row_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = checkpoint(
        rows.withColumn("bucket", bucket)
        .withColumn("inside", inside)
        .alias("r")
        .join(offsets.alias("o"), F.expr("r.source <=> o.source AND r.bucket = o.bucket"))
        .select("row_id", "doc_id", *carry, "r.source", "size", "key", "source_size", "target", (F.col("ahead") + F.col("inside")).alias("through"))
    )
    passes = placed.withColumn("again", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("finish", (F.col("through") + F.col("again") * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target")))
    times = cut_at_budget(passes.where(F.col("size") > 0), placed).groupBy("row_id").agg(F.count(F.lit(1)).alias("times"))
    return placed.join(times, "row_id", "left").select("row_id", "doc_id", *carry, "source", "size", "source_size", "target", F.coalesce("times", F.lit(0)).alias("times"), (F.coalesce("times", F.lit(0)) * F.col("size")).cast("long").alias("taken"))


def cut_at_budget(queue: DataFrame, placed: DataFrame) -> DataFrame:
    """The queue's head by (finish, key, row_id, again) whose sizes add up to at most the sum of targets.

    A range sort deals the queue to ordered partitions; their totals come first, then running sums inside each.
    """
    order = ["finish", "key", "row_id", "again"]
    parts = max(8, int(queue.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = checkpoint(queue.select("row_id", "again", "size", "key", "finish").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    # one row for each partition of the sort
    ahead = dealt.groupBy("part").agg(F.sum("size").alias("held")).withColumn("ahead", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "ahead")
    # one number
    budget = placed.groupBy("source").agg(F.max("target").alias("target")).agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    through = F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("inside", through).join(F.broadcast(ahead), "part").where(F.col("ahead") + F.col("inside") <= F.lit(budget)).select("row_id", "again")
