"""SimHash near-dedup of documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8, and of what such links connect.

Documents meet in blocks: BANDS min-hash keys of ROWS min-hashes, whatever the number of documents; a pair at a similarity of exactly 0.8 shares no key with probability (1 - 0.8 ** ROWS) ** BANDS = 3.5e-4, a more alike pair with less. In a block, SimHash fingerprints of the sets are compared in bit planes (``simhash.within``): pairs beyond RADIUS of BITS are abandoned. At a similarity of 0.8 a fingerprint differs in 15 % of the bits, 38.7 of 256 with a deviation of 5.7, so 60 loses 1e-4 of such pairs; sets under SMALL shingles, for which that doesn't hold, are not filtered. Pairs that stay are compared by the sets themselves, so no link is below 0.8.

Defined results: null and word-less texts are one group of their own; a text shorter than a shingle is one shingle; equal texts are one node, whatever their doc_id; letters A to Z are lower-cased; repeated rows are one; a null doc_id comes last when one row of a group is chosen; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroflux.llm.common import WORD, prepare, stored
from aeroflux.llm.linking import connected, stars
from aeroflux.llm.simhash import forest, majority, pairs_within
from aeroflux.llm.wording import Words, stir, stretches

WORDS = 5
#: Least similarity, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 20, 5
BITS, RADIUS, SMALL = 256, 60, 16
#: Shingles (8 bytes each) that a block keeps decoded.
HELD = 1 << 24

_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_TIMES = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def node_of(text: str = "text") -> Column:
    """A document's node: a hash of its text, 0 if it has no word."""
    return F.when(F.col(text).rlike(WORD), F.xxhash64(text)).otherwise(F.lit(0)).cast("long")


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct shingles' 64-bit hashes in order."""
    return np.unique(Words([text]).shingles(WORDS)[0])


def band_keys(shingles: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have shingles, their BANDS keys each); at is where each text's shingles begin."""
    own = np.flatnonzero(np.diff(at))
    if not len(own):
        return own, np.zeros((0, BANDS), np.uint64)
    x, begin = (shingles >> np.uint64(32)).astype(np.uint32), at[own]
    keys = np.repeat(stir(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :], len(own), axis=0)
    mixed = np.empty_like(x)
    for band in range(BANDS):
        for k in range(band * ROWS, (band + 1) * ROWS):
            np.bitwise_xor(x, _XOR[k], out=mixed)
            np.multiply(mixed, _TIMES[k], out=mixed)
            keys[:, band] = stir(keys[:, band] + np.minimum.reduceat(mixed, begin))
    return own, keys


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the similarity of two sets, in order, at least SIMILAR."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # merges two sorted parts
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common * SIMILAR[1] >= SIMILAR[0] * (len(a) + len(b) - common) and common > 0


def keys_of(words: Words) -> list[bytes | None]:
    """Each text's keys as bytes; None if it has no word."""
    own, keys = band_keys(*words.shingles(WORDS))
    out: list[bytes | None] = [None] * (len(words.text_at) - 1)
    for i, k in zip(own.tolist(), keys):
        out[i] = k.tobytes()
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """(node, keys binary) of every row of docs; null for a text without a word."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in stretches([len(t or b"") for t in texts]):
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(keys_of(Words(texts[part])), pa.binary())], names=["node", "keys"])

    return docs.select(node_of().alias("node"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, keys binary")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column(1).to_pylist()
        nodes = np.repeat(batch.column(0).to_numpy(), [len(x) // 8 for x in raw])
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), pa.array(nodes, pa.int64())], names=["key", "node"])


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, data): the fingerprint of the text's shingle set, and the text, compressed."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        data = []
        for text in batch.column(1).to_pylist():
            shingles = shingle_set(text)
            data.append(len(shingles).to_bytes(4, "big") + b"".join(x.to_bytes(8, "big") for x in majority(shingles, BITS)) + pack(text))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["node", "data"])


_HEAD = 4 + BITS // 8


def _prints(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints as rows of 64-bit numbers, numbers of shingles)."""
    heads = np.frombuffer(b"".join(d[:_HEAD] for d in data), np.uint8).reshape(-1, _HEAD)
    return np.ascontiguousarray(heads[:, 4:]).view(">u8").astype(np.uint64), np.ascontiguousarray(heads[:, :4]).view(">u4").ravel()


def _set_of(data: bytes) -> np.ndarray:
    return shingle_set(zstandard.decompress(data[_HEAD:]))


def _judge(mine: list[bytes], its: list[bytes]) -> list[bool]:
    if not mine:
        return []
    (a, size), (b, other) = _prints(mine), _prints(its)
    close = pairs_within(a, b, RADIUS) | (np.minimum(size, other) < SMALL)
    out, lead, shingles = [], None, None
    for yes, m, i in zip(close.tolist(), mine, its):
        if yes:
            if i != lead:
                lead, shingles = i, _set_of(i)
            yes = alike(_set_of(m), shingles)
        out.append(yes)
    return out


def _block(data: list[bytes], number: np.ndarray, label: np.ndarray, part: np.ndarray | None) -> list[tuple[int, int]]:
    prints, size = _prints(data)
    sets: dict[int, np.ndarray] = {}
    held = 0

    def set_at(i: int) -> np.ndarray:
        nonlocal held
        if i not in sets:
            if held > HELD:
                sets.clear()
                held = 0
            sets[i] = _set_of(data[i])
            held += len(sets[i])
        return sets[i]

    def check(i: int, j: int) -> bool:
        a, b = int(size[i]), int(size[j])
        return min(a, b) * SIMILAR[1] >= max(a, b) * SIMILAR[0] and alike(set_at(i), set_at(j))

    def links(at: np.ndarray, radius: int) -> list[tuple[int, int]]:
        found = forest(number[at], prints[at], radius, None if part is None else part[at], label[at], lambda i, j: check(int(at[i]), int(at[j])))
        return [(int(at[i]), int(at[j])) for i, j in found]

    # small sets without a filter; the two kinds overlap
    return links(np.flatnonzero(size >= SMALL), RADIUS) + links(np.flatnonzero(size < 2 * SMALL), BITS)


def components_of(sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) of linked nodes, from (node, keys) of documents and the documents themselves."""
    prepare(docs.sparkSession)
    rows = sketches.where("keys IS NOT NULL").dropDuplicates(["node"]).select("node", "keys").mapInArrow(_split, "key long, node long")
    members = stars(rows)
    texts = docs.select(node_of().alias("node"), F.col("text").cast("binary").alias("text")).join(stored(members.select("node").distinct()), "node", "left_semi").dropDuplicates(["node"])
    return connected(members, stored(texts.mapInArrow(_payload, "node long, data binary")), _judge, _block)


def groups(docs: DataFrame) -> DataFrame:
    """(node, component) of the nodes of docs that verified links connect."""
    return components_of(stored(sketched(docs)), docs)


def _packed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), node_of().alias("node"))


def with_groups(docs: DataFrame) -> DataFrame:
    """docs with near_group besides its own columns, equal for near copies."""
    return _packed(docs).join(groups(docs), "node", "left").select("row.*", F.coalesce("component", "node").alias("near_group"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: the smallest (doc_id, node, hash of the other columns), null last; only rows equal in all of these are interchangeable."""
    others = [f"row.`{c}`" for c in docs.columns if c != "text"]
    rank = F.struct(F.col("row.doc_id").isNull().alias("none"), F.coalesce("row.doc_id", F.lit(0)).cast("long").alias("id"), F.col("node").alias("at"), F.xxhash64(*others).alias("rest"))
    ranked = _packed(docs).withColumn("rank", rank)
    lead = ranked.select("node", "rank").join(groups(docs), "node", "left").groupBy(F.coalesce("component", "node").alias("g")).agg(F.min("rank").alias("rank")).select(F.col("rank.at").alias("node"), "rank")
    return ranked.join(lead, ["node", "rank"]).dropDuplicates(["node", "rank"]).select("row.*")
