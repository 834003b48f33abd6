"""SimHash near-dedup by bit-sliced comparison.

Fingerprints are majorities of the bits of hashed word shingles. Distinct fingerprints meet in tables: a table takes some of the bits as its key, so only fingerprints that agree there are compared. Its blocks are chosen by pigeonhole (``exact_tables``), so no pair within the radius is missed.

Inside a table the fingerprints of a task are stored as vertical bit planes. Rows of one key are compared at growing distances in the sorted order: planes are xor-ed 64 rows at a time, carry-save counters add up the differing bits, and words of 64 comparisons are abandoned as soon as all of them exceed the radius. Links already implied by others are skipped, so a group of copies yields a spanning tree and never all pairs. Components are found by large-star/small-star rounds over the links.

Defined results: null and word-less texts have fingerprint zero, linked like any other; shorter texts than a shingle are one shingle; equal fingerprints are one node, named by a hash of the fingerprint and labelled by the smallest doc_id of its component (null sorts last), so rows without doc_id or with the same one are not linked by that; repeated rows get the same component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroflux.llm.common import checkpoint, prepare

WORDS, RADIUS, SEED = 4, 4, 42
#: Distinct fingerprints of one key that one task compares; larger groups are compared as pairs of chunks.
GROUP = 1 << 14
#: Links that a task of the component rounds takes.
LINKS = 1 << 18

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Lower-cases A to Z alone.
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    found = _WORD.findall((text or "").translate(_LOWER))
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(" ".join(found), SEED)], np.uint64)
    line = " ".join(found).encode()
    ends = np.cumsum([len(w.encode()) + 1 for w in found]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())], np.uint64)


def _more(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Further 64 bits of each shingle for wide fingerprints."""
    if lane == 0:
        return hashes
    x = hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64((lane * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, words: int = WORDS, bits: int = 64) -> list[int]:
    """The bits as unsigned 64-bit numbers; a bit is 1 if it is set in over half of the shingles."""
    return majority(shingle_hashes(text, words), bits)


def majority(hashes: np.ndarray, bits: int = 64) -> list[int]:
    """The bits that over half of the hashes have, as unsigned 64-bit numbers."""
    out = []
    for lane in range(bits // 64):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            block = _more(hashes[at : at + (1 << 16)], lane).astype(">u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big"))
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, bits: int = 64) -> DataFrame:
    """(doc_id, fp binary) of every row; fp is big-endian."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [b"".join(x.to_bytes(8, "big") for x in fingerprint(text.as_py(), words, bits)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp binary")


def exact_tables(rows: int, bits: int = 64, radius: int = RADIUS) -> list[tuple[int, ...]]:
    """Bit positions of each table's key, so that every pair within the radius agrees on at least one key.

    The bits are cut into blocks; a pair within the radius agrees on all but ``radius`` of them. More blocks mean more tables but longer keys; the cheapest in moved and compared rows is taken.
    """

    def plan(blocks: int) -> tuple[float, list[tuple[int, ...]]]:
        edges = [bits * i // blocks for i in range(blocks + 1)]
        tables = [tuple(p for b in chosen for p in range(edges[b], edges[b + 1])) for chosen in itertools.combinations(range(blocks), blocks - radius)]
        compared = sum(rows * rows / 2.0 ** min(len(t), 62) for t in tables)
        return compared * 0.02 + rows * len(tables) * 4, tables

    return min((plan(blocks) for blocks in range(radius + 1, radius + 5) if blocks <= bits), key=lambda p: p[0])[1]


def _planes(fps: np.ndarray) -> np.ndarray:
    """Vertical bit planes: (bits, words) of 64 rows each, from (rows, lanes) big-endian numbers; one empty word follows."""
    rows = len(fps)
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(rows, 8 * fps.shape[1]), axis=1).T
    padded = np.zeros((bits.shape[0], (rows // 64 + 2) * 64), np.uint8)
    padded[:, :rows] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def within(planes: np.ndarray, shift: int, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Which of the comparisons (row i with row i + shift) set in the packed ``lanes`` are within the radius."""
    words = np.flatnonzero(lanes)
    out = np.zeros(len(lanes), np.uint64)
    out[words] = compared(planes, words, np.full(len(words), shift), lanes[words], radius)
    return out


def compared(planes: np.ndarray, words: np.ndarray, shift: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Of the comparisons set in ``lanes``, 64 rows of a word with the rows ``shift`` behind, those within the radius.

    Carry-save counters of ceil(log2(radius + 2)) planes count differing bits of 64 comparisons at a time and stick once over the radius; words without a comparison left are abandoned.
    """
    last = planes.shape[1] - 1
    turn = (shift % 64).astype(np.uint64)
    back = (np.uint64(64) - turn) % np.uint64(64)
    near = np.minimum(words + shift // 64, last)
    far = np.where(turn > 0, np.minimum(near + 1, last), last)  # the last word is empty
    out, place = np.zeros(len(words), np.uint64), np.arange(len(words))
    alive = lanes.copy()
    levels = (radius + 1).bit_length()
    # counters start so that the top carry falls out exactly when the radius is exceeded
    start = (1 << levels) - 1 - radius
    counters = [np.full(len(words), np.uint64(0xFFFFFFFFFFFFFFFF) if start >> k & 1 else np.uint64(0)) for k in range(levels)]
    for k in range(planes.shape[0]):
        plane = planes[k]
        carry = plane[words] ^ ((plane[near] >> turn) | (plane[far] << back))
        for level in range(levels):
            counters[level], carry = counters[level] ^ carry, counters[level] & carry
        alive &= ~carry
        if k % 8 == 7:
            keep = alive != 0
            if not keep.all():
                words, near, far, turn, back, place, alive = (x[keep] for x in (words, near, far, turn, back, place, alive))
                counters = [c[keep] for c in counters]
                if not len(words):
                    break
    out[place] = alive
    return out


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of a and b, (rows, lanes) each, differ in at most ``radius`` bits."""
    rows = len(a)
    shift = (rows + 63) // 64 * 64
    both = np.zeros((shift + rows, a.shape[1]), np.uint64)
    both[:rows], both[shift:] = a, b
    planes = _planes(both)
    lanes = np.zeros(planes.shape[1], np.uint64)
    asked = _bits(np.ones(rows, bool))
    lanes[: len(asked)] = asked
    out = np.zeros(rows, bool)
    out[_indices(within(planes, shift, lanes, radius))] = True
    return out


def _bits(mask: np.ndarray) -> np.ndarray:
    packed = np.zeros((len(mask) + 63) // 64 * 64, np.uint8)
    packed[: len(mask)] = mask
    return np.packbits(packed, bitorder="little").view("<u8").astype(np.uint64)


def _indices(words: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(words)
    bits = np.unpackbits(words[at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return at[row] * 64 + bit


def _settle(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return root
        root = up


def forest(groups: np.ndarray, fps: np.ndarray, radius: int, part: np.ndarray | None = None, label: np.ndarray | None = None, check: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that span the components of each group; rows of a group stand together.

    ``part``: 0 or 1 by row; where given, groups with both are compared across the parts only. ``label``: rows of a group with the same label are connected already. ``check(i, j)``: a pair within the radius is a link only if this holds.
    """
    n = len(groups)
    size_of = np.diff(np.r_[np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]), n]) if n else np.zeros(0, int)
    size = np.repeat(size_of, size_of)
    index = np.arange(n)
    keep = size > 1
    index, groups, fps, size = index[keep], groups[keep], fps[keep], size[keep]
    part = None if part is None else part[keep]
    links: list[tuple[int, int]] = []
    root = np.arange(len(index))
    if label is not None and len(index):
        _, first, inverse = np.unique(np.stack([groups, label[index]], axis=1), axis=0, return_index=True, return_inverse=True)
        root = first[inverse.ravel()]
    planes = _planes(fps)
    shift, packed_at, batch = 1, len(index), 1
    while len(index) > shift:
        asked = []
        stop = min(shift + batch, len(index))
        for d in range(shift, stop):  # several distances at once
            mask = (groups[d:] == groups[:-d]) & (root[d:] != root[:-d])
            if part is not None:
                mask &= part[d:] != part[:-d]
            if mask.any():
                lanes = _bits(mask)
                words = np.flatnonzero(lanes)
                asked.append((words, np.full(len(words), d), lanes[words]))
        found = 0
        if asked:
            words, far, lanes = (np.concatenate(x) for x in zip(*asked))
            lanes = compared(planes, words, far, lanes, radius)
            for w, d, lane in zip(*(x[lanes != 0].tolist() for x in (words, far, lanes))):
                found += lane.bit_count()
                while lane:
                    low = lane & -lane
                    lane ^= low
                    i = w * 64 + low.bit_length() - 1
                    a, b = i, i + d
                    while root[a] != a:
                        a = root[a]
                    while root[b] != b:
                        b = root[b]
                    if a != b and (check is None or check(int(index[i]), int(index[i + d]))):
                        root[max(a, b)] = min(a, b)
                        links.append((int(index[i]), int(index[i + d])))
            root = _settle(root)
        # more at once while few are near and the words of a batch stay some thousands
        batch = max(1, batch // 2) if found > 4096 else min(2 * batch, max(1, (1 << 16) // planes.shape[1]))
        shift = stop
        # groups whose rows were all compared, or are all linked, are done
        alive = size > shift
        if alive.sum() < 0.7 * packed_at:
            keep = np.flatnonzero(alive)
            new = np.full(len(index), -1)
            new[keep] = np.arange(len(keep))
            index, groups, fps, size, root = index[keep], groups[keep], fps[keep], size[keep], new[root[keep]]
            part = None if part is None else part[keep]
            planes, packed_at = _planes(fps), len(index)
    return links


def links(nodes: DataFrame, tables: list[tuple[int, ...]], radius: int, group: int = GROUP) -> DataFrame:
    """(a, b) of linked nodes from rows (node, fp), each fp once: a spanning forest of every key's group."""
    spark = nodes.sparkSession
    prepare(spark)
    bits = 8 * (max((max(t) for t in tables), default=63) // 8 + 1)
    positions = [np.array(t) for t in tables]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [np.uint64(1) << np.arange(len(t), dtype=np.uint64) for t in positions]
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            unpacked = np.unpackbits(raw, axis=1).astype(np.uint64)
            for number, (t, w) in enumerate(zip(positions, weights)):
                key = (unpacked[:, t] * w).sum(axis=1, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, number, np.int32)), pa.array(key.view(np.int64)), batch.column(0), batch.column(1)], names=["tab", "key", "node", "fp"])

    assert bits <= 1024
    rows = nodes.select("node", "fp").mapInArrow(keyed, "tab int, key long, node long, fp binary")
    # groups over the bound are dealt to chunks; every pair of chunks meets once, (c, c) standing for the inside of a chunk
    large = checkpoint(rows.groupBy("tab", "key").count().where(F.col("count") > group).select("tab", "key", F.ceil(F.col("count") / group).cast("int").alias("chunks")))
    if large.isEmpty():
        dealt = rows.select("tab", "key", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("part"), "node", "fp")
    else:
        chunk = F.coalesce(F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int"), F.lit(0))
        partners = F.transform(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1), lambda o: F.struct(F.least(o, F.col("c")).alias("x"), F.greatest(o, F.col("c")).alias("y"), (o < F.col("c")).cast("int").alias("part")))
        dealt = rows.join(large, ["tab", "key"], "left").withColumn("c", chunk).withColumn("p", F.explode(partners)).select("tab", "key", "p.x", "p.y", "p.part", "node", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def cut(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            whole = pa.Table.from_batches(held).combine_chunks()
            names = np.stack([whole[c].to_numpy().astype(np.int64) for c in ("tab", "key", "x", "y")], axis=1)
            change = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            end = len(names) if final else (int(change[-1]) if len(change) else 0)
            if end:
                head = whole.slice(0, end)
                groups = np.zeros(end, np.int64)
                groups[change[change < end]] = 1
                groups = np.cumsum(groups)
                fps = np.frombuffer(b"".join(head["fp"].to_pylist()), ">u8").reshape(end, -1).astype(np.uint64)
                part, inside = head["part"].to_numpy(), names[:end, 2] == names[:end, 3]
                node = head["node"].to_numpy()
                found = []
                for which in (inside, ~inside):
                    at = np.flatnonzero(which)
                    if len(at):
                        found += [(node[at[i]], node[at[j]]) for i, j in forest(groups[at], fps[at], radius, None if which is inside else part[at])]
                a, b = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            rest = whole.slice(end)
            held, count = (rest.to_batches() if rest.num_rows else []), rest.num_rows

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
                if count >= 4 * GROUP:
                    yield from cut(False)
        if held:
            yield from cut(True)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["tab", "key", "x", "y"]
    return dealt.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long")


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their component's smallest node) of links (a, b)."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if np.array_equal(x, y):
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        root = _settle(root)


def components(edges: DataFrame, rows: int = LINKS) -> DataFrame:
    """(node, component) of all nodes on links (a, b); component is the smallest node reachable.

    Up to ``rows`` links, some MB, are joined in one task. More are turned in large-star and small-star rounds to point at the smallest neighbour until nothing changes, which takes few rounds even for long chains; every round is written to the shared checkpoint folder, and its tasks have ``rows`` links each.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = checkpoint(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = state(edges)
    if before[0] <= rows:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
            node, component = joined(found["u"].to_numpy(), found["v"].to_numpy())
            for i in range(0, len(node), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(node[i : i + (1 << 16)]), pa.array(component[i : i + (1 << 16)])], names=["node", "component"])

        return checkpoint(edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, component long"))
    while True:
        few = lambda df, tasks=math.ceil(before[0] / max(rows, 1)): df.coalesce(tasks)
        edges = few(edges)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above a node point at the smallest neighbour of it
        least = few(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        large = few(few(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        # small star: the smaller neighbours of a node, and it, point at the smallest of them
        small = few(large.join(few(large.groupBy("u").agg(F.min("v").alias("m"))), "u"))
        turned = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        edges = checkpoint(few(turned))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_groups(docs: DataFrame, words: int = WORDS, bits: int = 64, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id of the component, null if it has none."""
    prints = checkpoint(fingerprints(docs, words, bits))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")).withColumn("node", F.xxhash64("fp")))
    found = components(links(nodes, exact_tables(nodes.count(), bits, radius), radius))
    named = checkpoint(nodes.join(found, "node", "left").select("fp", "first_id", F.coalesce("component", "node").alias("c")))
    labels = named.groupBy("c").agg(F.min("first_id").alias("component_id"))
    return prints.join(named.join(labels, "c").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
