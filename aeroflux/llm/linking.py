"""Components of nodes that share keys and that a judge finds alike, without all pairs of a key.

Every key is led by the member that shares most with others, as the text that others were copied from does. The keys of one leader are a star. Two rounds: first every member of a star is judged against its leader. Stars whose members are not all connected by that go on: their members meet in blocks, where a block function links them further, knowing who is connected already. A star with more than ``group`` members is dealt to pairs of chunks, so that no star is one task's work. What all pairs of a key would connect is connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroflux.llm.common import checkpoint, parts_of_shuffle, stored
from aeroflux.llm.simhash import components

#: Members of a star that one task holds; more are met as pairs of chunks.
GROUP = 2048

#: (data of one side, data of the other) to which pairs are alike.
Judge = Callable[[list[bytes], list[bytes]], list[bool]]
#: (data of members, their blocks' numbers in order, their components, and 0 or 1 where two chunks meet) to linked places.
Block = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray | None], list[tuple[int, int]]]


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def stars(rows: DataFrame) -> DataFrame:
    """(lead, node) from rows (key, node), each once: who shares a key with the key's leader, the leader included."""
    several = stored(rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", "n"))
    members = checkpoint(rows.join(several, "key").select("key", "node", "n"))
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    lead = members.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("lead"))
    return checkpoint(members.join(lead, "key").select(F.col("lead.node").alias("lead"), "node").distinct())


def connected(members: DataFrame, payload: DataFrame, judge: Judge, block: Block, group: int = GROUP) -> DataFrame:
    """(node, component) of the linked nodes from stars (lead, node), and (node, data) of every node in them."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, mine, its = (c.to_pylist() for c in batch.columns)
            alike = judge(mine, its)
            yield _links([x for x, yes in zip(a, alike) if yes], [x for x, yes in zip(b, alike) if yes])

    mine, its = payload.select("node", F.col("data").alias("mine")), payload.select(F.col("node").alias("lead"), F.col("data").alias("its"))
    pairs = members.where("node <> lead").select(F.greatest("node", "lead").alias("node"), F.least("node", "lead").alias("lead")).distinct()
    first = checkpoint(pairs.join(mine, "node").join(its, "lead").select("node", "lead", "mine", "its").mapInArrow(judged, "a long, b long"))
    found = components(first)
    known = members.join(found, "node", "left").select("lead", "node", F.coalesce("component", "node").alias("c"))
    # stars of two are settled
    apart = known.groupBy("lead").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high AND n > 2")
    apart = checkpoint(apart.select("lead", F.ceil(F.col("n") / group).cast("int").alias("chunks")))
    if apart.isEmpty():
        return found
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int")
    # every pair of chunks meets once, (k, k) standing for the inside of a chunk
    partners = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, F.col("k")).alias("x"), F.greatest(o, F.col("k")).alias("y"), (o < F.col("k")).cast("int").alias("part")))
    dealt = known.join(apart, "lead").join(payload, "node").withColumn("k", chunk).withColumn("p", F.explode(partners)).select("lead", "p.x", "p.y", "p.part", "node", "c", "data")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            for inside in (True, False):
                chosen = [r for r in held if (r[1] == r[2]) == inside]
                if len(chosen) > 1:
                    number, names = [], {}
                    for r in chosen:
                        number.append(names.setdefault(r[:3], len(names)))
                    linked = block([r[6] for r in chosen], np.array(number), np.array([r[5] for r in chosen]), None if inside else np.array([r[3] for r in chosen]))
                    yield _links([chosen[i][4] for i, _ in linked], [chosen[j][4] for _, j in linked])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= group and row[:3] != held[-1][:3]:  # blocks are looked at together until they have enough members
                    yield from close()
                    held = []
                held.append(row)
        yield from close()

    order = ["lead", "x", "y"]
    second = checkpoint(dealt.repartition(parts_of_shuffle(dealt), *order).sortWithinPartitions(*order, "node").mapInArrow(blocks, "a long, b long"))
    return components(first.union(second))
