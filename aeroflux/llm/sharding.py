"""Sharding by a k-d tree: recursive splits at distributed weighted medians along the widest metadata dimension, until leaves reach the target bytes.

DataFrame work only. Points of the tree are groups of equal texts with the group's metadata; a group that outweighs both a share (PIECE) of a leaf and the largest row is dealt into pieces by hash, so that no point outweighs a leaf. Medians of all nodes of a level are found together by histograms: a few counting passes narrow the bin that holds the median. The tables of nodes stay on the cluster.

Defined results: a null text counts as no bytes and null texts are one group; null metadata sorts first; repeated rows are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroflux.llm.common import checkpoint

#: Bins of a histogram pass, and passes: a cut is found to 2**9 of a coordinate's 2**48 positions.
BINS, PASSES = 8192, 3
#: A group of equal texts stays whole up to this share of a leaf, or up to the size of the largest row, which can't be cut either.
PIECE = 1 / 8
#: Bytes that a row costs besides its text.
ROW_BYTES = 8
#: Slots are counted in buckets of about so many rows.
SLOT_ROWS = 100_000

#: Coordinates run from 0 to 2**48 - 1.
SPAN = 1 << 48


def text_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def _spread(ordinal: Column, steps: int, tie: Column) -> Column:
    """A coordinate from an ordinal of 0 .. steps - 1; equal ordinals are told apart by a hash."""
    width = SPAN // steps
    return (ordinal * F.lit(width) + F.pmod(tie, F.lit(width))).cast("long")


def coordinates(source: Column, lang: Column, size: Column, doc_id: Column, group: Column) -> dict[str, Column]:
    """Metadata dimensions on one scale. Categories lie in the order of their first bytes, sizes on a log scale."""

    def leading(text: Column) -> Column:
        # two bytes of an order-keeping code and ten bits of a hash separate categories
        code = F.ascii(F.substring(F.coalesce(text, F.lit("")), 1, 1)) % 256
        return code * 1024 + F.pmod(F.xxhash64(text), F.lit(1024))

    return {
        "x_source": _spread(leading(source), 256 * 1024, F.xxhash64(group, F.lit(1))),
        "x_lang": _spread(leading(lang), 256 * 1024, F.xxhash64(group, F.lit(2))),
        "x_size": _spread(F.least(F.floor(F.log2(size.cast("double")) * 4096), F.lit((1 << 18) - 1)).cast("long"), 1 << 18, F.xxhash64(group, F.lit(3))),
        "x_id": F.pmod(F.xxhash64(doc_id, F.lit(4)), F.lit(SPAN)).cast("long"),
    }


DIMENSIONS = ("x_source", "x_lang", "x_size", "x_id")


def shard_by_tree(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, piece_share: float = PIECE) -> DataFrame:
    """(row_id, doc_id, size, text_crc32, shard) of every row; give the number of shards or a leaf's target bytes.

    A group of equal texts that weighs up to ``piece_share`` of a leaf is never cut: that is what equal sizes allow it, as a cut of the tree can miss its share by half of its heaviest point. 1 keeps every group that fits a leaf whole, at the price of less equal leaves.
    """
    meta = checkpoint(
        docs.select(
            "doc_id",
            "source",
            "lang",
            text_size().alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("hash"),
        ).withColumn("row_id", F.monotonically_increasing_id())
    )
    total, largest = meta.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    leaves = shards or max(1, round(total / target_bytes))
    limit = max(1, int(total / leaves * piece_share), min(largest, total // leaves // 4))
    group = ["hash", "text_crc32", "size"]
    groups = meta.groupBy(*group).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "source", "lang")).alias("first"))
    # the pieces of large groups: fewer than leaves / PIECE of them, in any case, so the table can be broadcast
    heavy = groups.where(F.col("copies") * F.col("size") > limit).where(F.col("copies") > 1).select(*group, F.ceil(F.col("copies") * F.col("size") / limit).cast("int").alias("pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id", "row_id"), F.col("pieces").cast("long")).cast("int"), F.lit(0))
    rows = checkpoint(meta.join(F.broadcast(heavy), group, "left").withColumn("piece", piece).drop("pieces"))
    identity = F.struct(*group, "piece")
    points = rows.groupBy(*group, "piece").agg(F.sum("size").alias("weight"), F.min(F.struct("doc_id", "source", "lang")).alias("first"))
    x = coordinates(F.col("first.source"), F.col("first.lang"), F.col("size"), F.col("first.doc_id"), F.xxhash64(identity))
    points = checkpoint(points.select(*group, "piece", "weight", *[c.alias(k) for k, c in x.items()]))
    placed = grow(points, leaves, total).select(*group, "piece", "shard")
    return rows.join(placed, [*group, "piece"]).select("row_id", "doc_id", "size", "text_crc32", "shard")


def grow(points: DataFrame, leaves: int, total: int) -> DataFrame:
    """points with shard, the number of their leaf, level by level.

    A node is named by its first leaf; points carry it and the number of its leaves. A level is one job: medians are found and applied by one plan, whose tables of nodes have at most ``leaves`` rows, so they may be broadcast.
    """
    points = points.withColumns({"shard": F.lit(0).cast("long"), "leaves": F.lit(leaves).cast("long")})
    half = F.floor(F.col("leaves") / 2).cast("long")
    for _ in range((leaves - 1).bit_length()):
        moved = points.join(F.broadcast(_medians(points.where("leaves > 1"))), "shard", "left")
        right = _along(F.col("dimension")) >= F.col("cut")
        points = checkpoint(
            moved.withColumns({"half": half, "right": right})
            .withColumns({"shard": F.when(F.col("right"), F.col("shard") + F.col("half")).otherwise(F.col("shard")), "leaves": F.when(F.col("right"), F.col("leaves") - F.col("half")).when(~F.col("right"), F.col("half")).otherwise(F.col("leaves"))})
            .drop("dimension", "cut", "half", "right")
        )
    return points.drop("leaves")


def _along(dimension: Column) -> Column:
    """A point's coordinate along the named dimension."""
    value = F.lit(None).cast("long")
    for d in DIMENSIONS:
        value = F.when(dimension == d, F.col(d)).otherwise(value)
    return value


def _medians(points: DataFrame) -> DataFrame:
    """(shard, dimension, cut): where each node is cut along its widest dimension, so that the weight below comes nearest to its left leaves' share.

    A pass counts BINS bins of the part that holds the median and goes on inside the bin that reaches it. A node's row carries all that the next pass needs, so passes follow each other in one plan.
    """
    extents = points.groupBy("shard").agg(F.sum("weight").alias("weight"), F.first("leaves").alias("leaves"), *[f(d).alias(f"{k}_{d}") for d in DIMENSIONS for k, f in (("low", F.min), ("high", F.max))])
    spans = [F.struct((F.col(f"high_{d}") - F.col(f"low_{d}")).alias("span"), F.lit(-i).alias("order"), F.lit(d).alias("dimension"), F.col(f"low_{d}").alias("low"), (F.col(f"high_{d}") + 1).alias("high")) for i, d in enumerate(DIMENSIONS)]
    want = F.col("weight") * F.floor(F.col("leaves") / 2) / F.col("leaves")
    nodes = extents.withColumn("w", F.greatest(*spans)).select("shard", "w.dimension", "w.low", "w.high", F.lit(0).cast("long").alias("below"), want.cast("double").alias("want"), F.col("w.low").alias("cut"))
    for _ in range(PASSES):
        asked = nodes.withColumn("width", F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / BINS)).cast("long"))
        value = _along(F.col("dimension"))
        inside = points.join(F.broadcast(asked), "shard").where((value >= F.col("low")) & (value < F.col("high")))
        carried = ["dimension", "low", "below", "want", "width"]
        bins = inside.groupBy("shard", F.floor((value - F.col("low")) / F.col("width")).cast("long").alias("bin")).agg(F.sum("weight").alias("held"), *(F.first(c).alias(c) for c in carried))
        through = F.col("below") + F.sum("held").over(Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        # the first bin that reaches what is wanted; there is one, as the part's weight does
        reached = bins.withColumn("through", through).where(F.col("through") >= F.col("want")).groupBy("shard").agg(F.min_by(F.struct("bin", "through", "held", *carried), "bin").alias("b")).select("shard", "b.*")
        start = F.col("low") + F.col("bin") * F.col("width")
        before = F.col("through") - F.col("held")
        nearer = F.abs(before - F.col("want")) <= F.abs(F.col("through") - F.col("want"))
        nodes = reached.select("shard", "dimension", start.alias("low"), (start + F.col("width")).alias("high"), before.alias("below"), "want", F.when(nearer, start).otherwise(start + F.col("width")).alias("cut"))
    return nodes.select("shard", "dimension", "cut")


def with_slots(rows: DataFrame, shards: int) -> DataFrame:
    """Gapless slots of each shard by doc_id order of hashes, counted in buckets so that no shard is one task's work."""
    count = rows.count()
    buckets = max(1, math.ceil(count / shards / SLOT_ROWS)) * 16
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    # one row for each shard and bucket
    totals = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = totals.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "row_id"))
    return rows.withColumn("inside", inside).join(ahead, ["shard", "bucket"]).withColumn("slot", (F.col("ahead") + F.col("inside") - 1).cast("long")).drop("bucket", "inside", "ahead")
