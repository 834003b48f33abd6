"""Suffix-array dedup: bytes of strings of ``length`` bytes that also start earlier in the collection are removed.

Two strings of that length are equal only if the smallest hash among their ``GRAM``-byte grams is equal. So every text is cut into runs of consecutive strings with the same smallest hash, and the runs are dealt to buckets by that hash; all equal strings meet in one bucket. A first, compact exchange of hashes leaves the runs whose hash occurs again; only these are cut out of the texts and exchanged.

A bucket's collection is built column by column: each round inserts one symbol per run, from the runs' ends, into the collection's Burrows-Wheeler transform and its common-prefix lengths, both kept as sequential streams that each round reads and merges once. Strings of equal content are then neighbours with common prefixes of at least ``length``; all but the first occurrence are marked.

Streams stay in memory, not in files, because buckets are bounded: equal runs are collapsed before the construction, already in the task that cuts them out; a hash with very many runs is dealt out by whole strings.

Most runs are settled by their hashes: two runs are taken for equal if bucket, 40 bits of the smallest gram's hash, the length and 64 bits of the run's hash agree, and their bytes are not compared. So a removal can be wrong where two different runs of one length agree in more than 104 bits of hashes; among n runs the chance of one such pair is below n * n / 2**105, which is 2e-8 for 10**12 runs.

Defined results: a null text is empty; matches never cross documents; rows with the same doc_id are told apart by a hash of their text, and identical rows are one document; a null doc_id comes first; texts shorter than ``length`` stay whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroflux.llm.common import prepare, stored

LENGTH, GRAM = 100, 50
#: Strings in a run at most.
RUN = 256
#: Bytes of text for each bucket, and the runs of one hash beyond which whole strings are dealt out.
BUCKET_BYTES, HOT = 16 << 20, 4096
#: Runs that one construction takes, if their hashes allow.
COLLECTION = 512

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(16, (n - 1).bit_length()), np.uint64(base))
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    return sums


def grams(data: np.ndarray, size: int, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of every gram."""
    sums = _sums(data) if sums is None else sums
    return _mixed((sums[size:] - sums[:-size]) * _power(_INVERSE, len(data) - size + 1))


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first string, number of strings, does the hash occur twice inside, hash of the run's bytes) of each run of a text."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.int64, np.int64, bool, np.uint64))
    sums = _sums(data)
    hashes, width = grams(data, gram, sums), length - gram + 1
    least = _window_min(hashes, width)
    start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    end = np.r_[start[1:], n]
    if (end - start).max() > RUN:
        start = np.concatenate([np.arange(a, b, RUN) for a, b in zip(start, end)])
        end = np.minimum(np.r_[start[1:], n], start + RUN)
    value = least[start]
    twice = np.zeros(len(start), bool)
    for i in range(0, len(start), 4096):
        a, b = start[i : i + 4096], end[i : i + 4096]
        v, inside = value[i : i + 4096, None], np.arange(width)
        first = a + (hashes[a[:, None] + inside] == v).argmax(axis=1)
        last = b - 1 + width - 1 - (hashes[b[:, None] - 1 + inside[::-1]] == v).argmax(axis=1)
        twice[i : i + 4096] = first != last
    whole = _mixed((sums[end + length - 1] - sums[start]) * _power(_INVERSE, n)[start])
    return value, start, end - start, twice, whole


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and where each value begins."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


#: A run: 40 bits of its hash, 64 bits of its bytes' hash, its place, strings less one, and flags.
ENTRY = np.dtype([("low", "<u4"), ("high", "u1"), ("text", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("start", "<i4"), ("count", "u1"), ("flag", "u1")])
#: Flags of an entry: its hash occurs twice inside the run; it isn't at its hash's bucket; all of it is known to be removed.
TWICE, AWAY, GONE = 1, 2, 4
#: Different runs of one hash that a batch sends to the hash's bucket; more go to a bucket of the batch's own.
HOME = 8


def pack_runs(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, data): for each batch and bucket the runs' hashes and places, column after column.

    Equal runs of a batch are settled there: all but the first are known to go. So however common a run is, a batch sends it to its bucket once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            data, at = _texts(batch.column(2))
            doc, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts, values = [], []
            for i in range(batch.num_rows):
                value, start, count, twice, whole = runs(data[at[i] : at[i + 1]])
                if len(value):
                    entry = np.zeros(len(value), ENTRY)
                    entry["low"], entry["high"] = value & np.uint64(0xFFFFFFFF), (value >> np.uint64(32)) & np.uint64(0xFF)
                    entry["text"], entry["start"], entry["count"], entry["flag"] = whole, start, count - 1, twice * TWICE
                    entry["doc"], entry["tie"] = doc[i], tie[i]
                    parts.append(entry)
                    values.append(value)
            if not parts:
                continue
            entries, value = np.concatenate(parts), np.concatenate(values)
            order = np.lexsort((entries["start"], entries["tie"], entries["doc"], entries["text"], value))
            entries, value = entries[order], value[order]
            same = value[1:] == value[:-1]
            equal = np.r_[False, same & (entries["text"][1:] == entries["text"][:-1])]
            entries["flag"][equal] |= GONE | AWAY
            # a row given twice is one document
            twin = np.r_[False, (entries["doc"][1:] == entries["doc"][:-1]) & (entries["tie"][1:] == entries["tie"][:-1]) & (entries["start"][1:] == entries["start"][:-1])] & equal
            entries, value, equal = entries[~twin], value[~twin], equal[~twin]
            fresh = np.r_[True, value[1:] != value[:-1]]
            kinds = np.cumsum(~equal)
            nth = kinds - kinds[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            entries["flag"][nth >= HOME] |= AWAY
            turn += 1
            home = (value % np.uint64(buckets)).astype(np.int64)
            home[(entries["flag"] & AWAY) != 0] = (int(value[0] >> np.uint64(8)) + turn) % buckets
            order = np.argsort(home, kind="stable")
            entries, home = entries[order], home[order]
            first = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
            blobs = [_columns(entries[a:b]) for a, b in zip(first, np.r_[first[1:], len(home)])]
            yield pa.RecordBatch.from_arrays([pa.array(home[first].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "data"])

    return docs.select("doc", "tie", "text").mapInArrow(run, "bucket int, data binary")


def _columns(entries: np.ndarray) -> bytes:
    """Entries column after column, places as differences, for the exchange's compression."""
    entries = entries[np.lexsort((entries["start"], entries["tie"], entries["doc"]))]
    out = entries.copy()
    same = (entries["doc"][1:] == entries["doc"][:-1]) & (entries["tie"][1:] == entries["tie"][:-1])
    out["start"][1:] -= np.where(same, entries["start"][:-1], 0).astype(np.int32)
    for name in ("doc", "tie"):
        out[name][1:] = np.diff(entries[name])
    return b"".join(out[name].tobytes() for name in ENTRY.names)


def _entries(data: bytes) -> np.ndarray:
    n, at = len(data) // ENTRY.itemsize, 0
    out = np.empty(n, ENTRY)
    for name in ENTRY.names:
        kind = ENTRY[name]
        out[name] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    changed = np.r_[True, (out["doc"][1:] != 0) | (out["tie"][1:] != 0)]
    for name in ("doc", "tie"):
        out[name] = np.cumsum(out[name])
    sums = np.cumsum(out["start"].astype(np.int64))
    first = np.flatnonzero(changed)
    out["start"] = sums - (sums[first] - out["start"][first])[np.cumsum(changed) - 1]
    return out


def repeated_runs(packed: DataFrame) -> DataFrame:
    """(doc, tie, start, count, key, gone) of the runs that go wholly, and of those whose hash has other runs too.

    The key is 40 bits of the run's hash.
    """

    def run(table: pa.Table) -> pa.Table:
        entries = np.concatenate([_entries(x) for x in table["data"].to_pylist()])
        key = entries["low"].astype(np.int64) | (entries["high"].astype(np.int64) << 32)
        home = (entries["flag"] & AWAY) == 0
        order = np.flatnonzero(home)
        order = order[np.lexsort((entries["start"][order], entries["tie"][order], entries["doc"][order], entries["text"][order], key[order]))]
        own, own_key = entries[order], key[order]
        equal = np.r_[False, (own_key[1:] == own_key[:-1]) & (own["text"][1:] == own["text"][:-1]) & (own["count"][1:] == own["count"][:-1])] if len(own) else np.zeros(0, bool)
        lead = np.maximum.accumulate(np.where(equal, 0, np.arange(len(own))))
        twin = equal & (own["doc"] == own["doc"][lead]) & (own["tie"] == own["tie"][lead]) & (own["start"] == own["start"][lead])
        gone = equal & ~twin
        # what stays is looked at again if its hash has another content, here or away, or repeats inside
        left = ~equal
        _, kind, contents = np.unique(own_key[left], return_inverse=True, return_counts=True)
        again = (contents[kind] > 1) | ((own["flag"][left] & TWICE) != 0)
        found = np.concatenate([own[gone], entries[~home], own[left][again]])
        keys = np.concatenate([own_key[gone], key[~home], own_key[left][again]])
        flags = np.concatenate([np.ones(gone.sum(), bool), (entries["flag"][~home] & GONE) != 0, np.zeros(again.sum(), bool)])
        return pa.table({"doc": found["doc"], "tie": found["tie"], "start": found["start"], "count": found["count"].astype(np.int32) + 1, "key": keys, "gone": flags})

    return packed.groupBy("bucket").applyInArrow(run, "doc long, tie long, start int, count int, key long, gone boolean")


def cut_runs(docs: DataFrame, found: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """(bucket, data, spans): the distinct runs of each bucket, and removed spans known at once.

    Runs of hot hashes are dealt out string by string. Equal content inside a batch keeps its first occurrence; the others are removed wholly.
    """
    place = F.struct("start", "count", "key", "hot")
    joined = docs.join(found.groupBy("doc", "tie").agg(F.collect_list(place).alias("runs")), ["doc", "tie"]).select("doc", "tie", "text", F.col("runs.start").alias("s"), F.col("runs.count").alias("n"), F.col("runs.key").alias("h"), F.col("runs.hot").alias("hot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[tuple[int, bytes], tuple] = {}
            gone: list[tuple] = []
            for doc, tie, text, s, n, h, hot in zip(*(c.to_pylist() for c in batch.columns)):
                for start, count, value, many in zip(s, n, h, hot):
                    pieces = [(start, count, value)] if not many else [(start + i, 1, int.from_bytes(hashlib.blake2b(text[start + i : start + i + length], digest_size=8).digest(), "little", signed=True)) for i in range(count)]
                    for at, strings, key in pieces:
                        content, new = (key, text[at : at + strings + length - 1]), (doc, tie, at)
                        old = best.get(content)
                        if old is None:
                            best[content] = new
                        elif new != old:
                            best[content], late = (new, old) if new < old else (old, new)
                            gone.append((*late, len(content[1])))
            by: dict[int, list] = {}
            for (key, content), (doc, tie, at) in best.items():
                by.setdefault(key % buckets, []).append((doc, tie, at, key, content))
            out_bucket, out_data = [], []
            for bucket, rows in by.items():
                rows.sort()
                out_bucket.append(bucket)
                out_data.append(_blob(rows))
            yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(out_data, pa.binary()), pa.nulls(len(out_bucket), pa.binary())], names=["bucket", "data", "spans"])
            if gone:
                spans = _spans(*(np.array(x, np.int64) for x in zip(*gone)))
                yield pa.RecordBatch.from_arrays([pa.array([int(gone[0][0] % buckets)], pa.int32()), pa.nulls(1, pa.binary()), pa.array([spans.tobytes()], pa.binary())], names=["bucket", "data", "spans"])

    return joined.mapInArrow(run, "bucket int, data binary, spans binary")


PLACE = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("at", "<i8"), ("key", "<i8"), ("size", "<i8")])


def _blob(rows: list[tuple]) -> bytes:
    place = np.array([(d, t, a, k, len(c)) for d, t, a, k, c in rows], PLACE)
    return len(rows).to_bytes(8, "little") + b"".join(place[name].tobytes() for name in PLACE.names) + b"".join(r[4] for r in rows)


def _unblob(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    n = int.from_bytes(data[:8], "little")
    place = np.empty(n, PLACE)
    for k, name in enumerate(PLACE.names):
        place[name] = np.frombuffer(data, np.int64, n, 8 + 8 * n * k)
    ends = 8 + 8 * n * len(PLACE.names) + np.cumsum(place["size"])
    return place, [data[e - s : e] for e, s in zip(ends.tolist(), place["size"].tolist())]


def construct(strings: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, group) of the suffixes of at least ``length`` bytes; equal groups share their first ``length`` bytes.

    Round j inserts the suffix of length j of every string that has one: its place follows from the transform (symbols smaller than its own, and equal ones before its shorter suffix's place), and its common prefix with both neighbours is one more than the smallest value between the same symbol's occurrences.
    """
    n = len(strings)
    sizes = np.array([len(s) for s in strings])
    longest = int(sizes.max())
    # columns from the ends; symbols from 1, in byte order
    flat = np.frombuffer(b"".join(strings), np.uint8)
    used = np.flatnonzero(np.bincount(flat, minlength=256))
    symbol = np.zeros(256, np.uint8)
    symbol[used] = np.arange(1, len(used) + 1)
    last = np.cumsum(sizes) - 1
    # the streams: preceding symbol, common prefix with the suffix in front, and in which turn the suffix was inserted
    transform, common, number = np.zeros(n, np.uint8), np.zeros(n, np.uint16), np.arange(n, dtype=np.uint32)
    place = np.arange(n)  # of each string's longest suffix so far
    active = np.arange(n)
    turns = [(active, np.zeros(n, np.int64))]
    inserted = n
    for j in range(1, longest + 1):
        active = active[sizes[active] >= j]
        new = symbol[flat[last[active] - j + 1]]
        at = place[active]
        transform[at] = new
        order = np.argsort(transform, kind="stable")  # the first-column order of all symbols
        total = len(transform)
        rank = np.empty(total, np.int32)
        rank[order] = np.arange(total, dtype=np.int32)
        here = rank[at].astype(np.int64)
        target = here - (total - np.count_nonzero(transform)) + n  # in front: the n ends, then smaller symbols
        # common prefixes with the neighbours in front and behind that begin with the same symbol
        before, behind = order[np.maximum(here - 1, 0)], order[np.minimum(here + 1, total - 1)]
        front = (here > 0) & (transform[before] == new)
        after = (here + 1 < total) & (transform[behind] == new)
        low = np.where(front, _least(common, np.where(front, before, at) + 1, at + 1) + 1, 0)
        high = np.where(after, _least(common, at + 1, np.where(after, behind, at) + 1) + 1, 0)
        # merge the new suffixes into the streams
        size = total + len(active)
        is_old = np.ones(size, bool)
        is_old[target] = False
        old_at = np.flatnonzero(is_old)
        fresh = np.arange(inserted, inserted + len(active), dtype=np.uint32)
        streams = []
        for old, added in ((transform, 0), (common, low), (number, fresh)):
            merged = np.empty(size, old.dtype)
            merged[old_at] = old
            merged[target] = added
            streams.append(merged)
        transform, common, number = streams
        turns.append((active, np.full(len(active), j)))
        inserted += len(active)
        common[target[after] + 1] = high[after]
        place = old_at[place]
        place[active] = target
    owner, held = (np.concatenate(x)[number] for x in zip(*turns))
    keep = np.flatnonzero(held >= length)
    group = np.cumsum(common < length)[keep]
    return owner[keep], sizes[owner[keep]] - held[keep], group


def _least(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of values[start:end] for each pair; an empty range gives a value that isn't used."""
    padded = np.append(values, np.uint16(0xFFFF))
    pairs = np.empty(2 * len(start), np.int64)
    pairs[0::2], pairs[1::2] = start, np.maximum(end, start)
    return np.minimum.reduceat(padded, np.minimum(pairs, len(values)))[0::2].astype(np.int64)


def _spans(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Union of the spans of each document as rows (doc, tie, start, end)."""
    order = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order], (start + size)[order]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])]
    number = np.cumsum(fresh)
    # ends only matter inside a document: a shift by document keeps a running maximum inside it
    shift = number * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift) - shift
    opens = fresh | np.r_[False, start[1:] > reach[:-1]]
    first = np.flatnonzero(opens)
    last = np.r_[first[1:], len(doc)] - 1
    return np.stack([doc[first], tie[first], start[first], reach[last]], axis=1)


def _collapse(place: np.ndarray, strings: list[bytes]) -> tuple[list[int], list[int]]:
    """(first occurrences, later ones) of equal strings of a key; a place given twice is one."""
    order = np.lexsort((place["at"], place["tie"], place["doc"])).tolist()
    keys, where = place["key"].tolist(), list(zip(place["doc"].tolist(), place["tie"].tolist(), place["at"].tolist()))
    first: dict[tuple[int, bytes], int] = {}
    late = []
    for i in order:
        k = first.setdefault((keys[i], strings[i]), i)
        if where[k] != where[i]:
            late.append(i)
    return list(first.values()), late


def _shared_parts(place: np.ndarray, strings: list[bytes], length: int) -> tuple[np.ndarray, list[bytes]]:
    """The stretches of the runs whose strings may occur again in these runs, by a hash of each string.

    What is left out has no equal, so the construction needs only the stretches.
    """
    flat = np.frombuffer(b"".join(strings), np.uint8)
    if len(flat) < length:
        return place[:0], []
    sizes = place["size"]
    ends = np.cumsum(sizes)
    hashes = grams(flat, length)
    valid = np.ones(len(hashes), bool)
    for back in range(1, length):
        cut = ends[:-1] - back
        valid[cut[(cut >= 0) & (cut < len(hashes))]] = False
    at = np.flatnonzero(valid)
    _, kind, count = np.unique(hashes[at], return_inverse=True, return_counts=True)
    at = at[count[kind] > 1]
    if not len(at):
        return place[:0], []
    owner = np.searchsorted(ends, at, side="right")
    fresh = np.r_[True, (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])]
    begin = np.flatnonzero(fresh)
    last = np.r_[begin[1:], len(at)] - 1
    who, start, stop = owner[begin], at[begin], at[last] + length
    parts = place[who].copy()
    parts["at"] += start - (ends - sizes)[who]
    parts["size"] = stop - start
    return parts, [flat[a:b].tobytes() for a, b in zip(start.tolist(), stop.tolist())]


def mark(place: np.ndarray, strings: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Spans (doc, tie, start, end) of one bucket: everything but the first occurrence of each string."""
    first, late = _collapse(place, strings)
    gone = [place[late]]
    found = []
    first.sort(key=lambda i: (int(place["key"][i]), i))
    at = 0
    while at < len(first):
        end = _whole_keys(place["key"][first], at, 16 * COLLECTION)
        parts, texts = _shared_parts(place[first[at:end]], [strings[i] for i in first[at:end]], length)
        at = end
        if not len(parts):
            continue
        kept, late = _collapse(parts, texts)
        gone.append(parts[late])
        distinct = np.array(sorted(kept, key=lambda i: (int(parts["key"][i]), i)))
        keys, count = parts["key"][distinct], parts["size"][distinct] - length + 1
        _, kind, alike = np.unique(keys, return_inverse=True, return_counts=True)
        # a hash's parts are built together if there are two, or one that may repeat inside
        distinct = distinct[(alike[kind] > 1) & (np.bincount(kind, count)[kind] > alike[kind]) | (count > 1) & (alike[kind] == 1) & _inside(texts, distinct, length)]
        low = 0
        while low < len(distinct):
            high = _whole_keys(parts["key"][distinct], low, COLLECTION)
            found.append(_later(parts[distinct[low:high]], [texts[i] for i in distinct[low:high]], length))
            low = high
    whole = np.concatenate(gone)
    if len(whole):
        found.append(_spans(whole["doc"], whole["tie"], whole["at"], whole["size"]))
    return np.concatenate(found) if found else np.zeros((0, 4), np.int64)


def _whole_keys(keys: np.ndarray, at: int, count: int) -> int:
    """End of a stretch of about so many sorted keys that breaks no key."""
    end = min(at + count, len(keys))
    while end < len(keys) and keys[end] == keys[end - 1]:
        end += 1
    return end


def _later(place: np.ndarray, strings: list[bytes], length: int) -> np.ndarray:
    """Spans of the strings that also start earlier in this collection."""
    owner, offset, group = construct(strings, length)
    p = place[owner]
    start = p["at"] + offset
    order = np.lexsort((start, p["tie"], p["doc"], group))
    g, p, start = group[order], p[order], start[order]
    fresh = np.r_[True, g[1:] != g[:-1]]
    lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    late = (p["doc"] != p["doc"][lead]) | (p["tie"] != p["tie"][lead]) | (start != start[lead])
    return _spans(p["doc"][late], p["tie"][late], start[late], np.full(late.sum(), length, np.int64)) if late.any() else np.zeros((0, 4), np.int64)


def _inside(strings: list[bytes], chosen: np.ndarray, length: int) -> np.ndarray:
    """May a run repeat one of its own strings: does a 16-byte piece that all its strings cover occur twice."""
    out = np.zeros(len(chosen), bool)
    for k, i in enumerate(chosen.tolist()):
        s = strings[i]
        spare = len(s) - length
        if spare > 0:
            middle = s[spare : spare + 16] if spare < length - 16 else b""
            # every string covers s[spare:length]; a string that repeats carries that piece along
            out[k] = not middle or s.count(middle) > 1 or s.find(middle, spare + 1) >= 0
    return out


def repeats(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc, tie, spans array<struct<s,e>>) of the documents that lose bytes; docs has doc, tie and text."""
    prepare(docs.sparkSession)
    total = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(64, math.ceil(total / bucket_bytes)) | 1  # odd, so that a bucket's number and 40 bits of a hash tell more than either
    runs_found = stored(repeated_runs(pack_runs(docs, buckets)))
    gone = runs_found.where("gone").select("doc", "tie", F.col("start").cast("long").alias("s"), (F.col("start") + F.col("count") + (length - 1)).cast("long").alias("e"))
    found = runs_found.where("NOT gone").drop("gone")
    # hashes with very many runs: fewer than all runs / HOT
    hot = found.groupBy("key").count().where(F.col("count") > HOT).select("key", F.lit(True).alias("hot"))
    found = found.join(F.broadcast(hot), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    cut = cut_runs(docs, found, buckets, length)

    def run(table: pa.Table) -> pa.Table:
        spans = [np.frombuffer(x, np.int64).reshape(-1, 4) for x in table["spans"].to_pylist() if x]
        blobs = [_unblob(x) for x in table["data"].to_pylist() if x]
        if blobs:
            spans.append(mark(np.concatenate([p for p, _ in blobs]), [s for _, strings in blobs for s in strings], length))
        rows = np.concatenate(spans) if spans else np.zeros((0, 4), np.int64)
        if len(rows):
            rows = _spans(rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] - rows[:, 2])
        return pa.table({"doc": rows[:, 0], "tie": rows[:, 1], "s": rows[:, 2], "e": rows[:, 3]})

    spans = stored(cut.groupBy("bucket").applyInArrow(run, "doc long, tie long, s long, e long"))
    return spans.union(gone).groupBy("doc", "tie").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc, tie and the text's bytes; a null doc_id comes first."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("tie"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), "doc_id")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<s,e>>, kept binary) of every row: the removed spans in order, and the bytes that remain."""
    docs = keyed(docs)
    marked = docs.join(repeats(docs, length), ["doc", "tie"], "left").select("doc_id", "text", F.col("spans.s").alias("s"), F.col("spans.e").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.binary()]
        for batch in batches:
            rows = [cleaned(*(x.as_py() for x in row)) for row in zip(*batch.columns[1:])]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", "n_bytes", "spans", "kept"])

    return marked.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<s:long,e:long>>, kept binary")


def cleaned(text: bytes, starts: list[int] | None, ends: list[int] | None) -> tuple[int, list[dict], bytes]:
    """A text without the union of its spans."""
    if not starts:
        return len(text), [], text
    start, zero = np.array(starts), np.zeros(len(starts), np.int64)
    spans = [{"s": a, "e": b} for _, _, a, b in _spans(zero, zero, start, np.array(ends) - start).tolist()]
    edges = [0, *(x for span in spans for x in (span["s"], span["e"])), len(text)]
    return len(text), spans, b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2]))
