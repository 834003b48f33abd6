"""Line dedup with a log-template tree.

A line's words are parsed by a tree of fixed depth: the number of words, then the leading words; words with digits are variable fields. Lines of one leaf that agree in most places are one template whose other places are variable. Templates that recur across documents are dropped from all of them.

Recurrence counts documents that differ: copies and near copies (``nearcopies``: a similarity of at least 0.8 of the five-word shingles, and what such links connect) are one group and count as one document, so a document that was copied a thousand times does not make boilerplate of its own lines. Documents that only share a passage count each. A template is dropped if at least ``min_docs`` groups have it.

One pass over the texts gives the lines' hashes and the documents' near-copy keys. Only leaves that enough documents have are looked at further, which are few. Their lines meet by equal segments of the places behind the leading words, which misses no pair within the allowed share of variable places; a leaf is never held by one task, and a segment that many lines share is dealt to pairs of chunks (``linking``).

Defined results: a null text stays null; lines without a word always stay and keep their place; line ends are line feeds; a template counts once for every document that has it; repeated rows and equal texts are one group; other columns pass through unchanged, whatever their names. Texts of any length are parsed whole, in blocks of about 2 MB cut at white space. Lines are told apart by 64-bit hashes, their words by 32 bits: a chance agreement (once in 4.3 billion pairs of different words) counts as an equal place, and no agreement is ever missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeroflux.llm import nearcopies
from aeroflux.llm.common import checkpoint, prepare, stored
from aeroflux.llm.linking import connected, stars
from aeroflux.llm.wording import CODE, Words, stretches

#: Documents that must share a template, leading words of a leaf, and the share of places that may vary.
MIN_DOCS, LEADING, VARIABLE = 4, 3, 0.2
#: Lines that one task compares; more are compared as pairs of chunks.
CHUNK = 4096
#: Dropped lines (8 bytes each) that are sent to every task; more are joined.
BROADCAST = 500_000


def line_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number inside the text, hash) of every line that has a word."""
    words = Words(texts, exact=True, lower=False)
    number, hashes, *_ = words.lines(LEADING)
    text = words.line_text[number]
    first = np.searchsorted(words.line_text, np.arange(len(texts)))
    return text, number - first[text], hashes.view(np.int64)


def _rows_of(texts: list[bytes | None], nodes: np.ndarray) -> pa.RecordBatch:
    """The distinct lines of some texts, and for each text a row without a line, with its near-copy keys."""
    words = Words(texts, exact=True)
    number, hashes, leaf, start, count = words.lines(LEADING)
    text = words.line_text[number]
    order = np.lexsort((hashes, text))
    again = np.r_[False, (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])] if len(order) else np.zeros(0, bool)
    keep = np.sort(order[~again])
    codes = words.codes().tobytes()
    wide = CODE.itemsize
    data = [codes[wide * a : wide * (a + n)] for a, n in zip(start[keep].tolist(), count[keep].tolist())]
    keys = nearcopies.keys_of(words)
    own = [i for i, k in enumerate(keys) if k is not None]
    none = pa.nulls(len(own), pa.int64())
    columns = [
        pa.concat_arrays([pa.array(nodes[text[keep]], pa.int64()), pa.array(nodes[own], pa.int64())]),
        pa.concat_arrays([pa.array(hashes[keep].view(np.int64)), none]),
        pa.concat_arrays([pa.array(leaf[keep].view(np.int64)), none]),
        pa.array(data + [keys[i] for i in own], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["node", "line", "leaf", "data"])


def parsed(docs: DataFrame) -> DataFrame:
    """(node, line, leaf, data) in the shared folder: of each line the codes of its words; rows without a line have their text's near-copy keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, first = np.unique(batch.column(0).to_numpy(), return_index=True)  # equal texts are one
            texts = batch.column(1).take(pa.array(first)).to_pylist()
            for part in stretches([len(t or b"") for t in texts]):
                yield _rows_of(texts[part], nodes[part])

    return stored(docs.select(nearcopies.node_of().alias("node"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, line long, leaf long, data binary"))


def segments(places: int, variable: float) -> list[tuple[int, int]]:
    """Segments of the places behind the leading ones; lines of a leaf within the allowed share agree on one of them at least."""
    allowed = int(places * variable)
    if allowed == 0:
        return []
    edges = np.linspace(min(LEADING, places), places, allowed + 2).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def spanning(codes: np.ndarray, variable: float, label: np.ndarray | None = None, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect the same lines as all pairs within the allowed share do.

    ``label``: lines with the same one are connected already; ``part``: where given, only lines of different parts are compared.
    """
    lines, places = codes.shape
    least = places - int(places * variable)
    label = np.arange(lines) if label is None else np.unique(label, return_inverse=True)[1].copy()
    found = []
    for i in range(lines):
        other = np.flatnonzero(label != label[i])
        if part is not None:
            other = other[part[other] != part[i]]
        near = other[(codes[other] == codes[i]).sum(axis=1) >= least] if len(other) else other
        if len(near):
            joined, first = np.unique(label[near], return_index=True)
            found += [(i, int(j)) for j in near[first]]
            label[np.isin(label, joined)] = label[i]
    return found


def recurring(leaf: list[tuple[int, set, bytes]], min_docs: int = MIN_DOCS, variable: float = VARIABLE) -> list[int]:
    """Lines of one leaf, given as (line, groups of documents, codes), whose template recurs: a small leaf's result without Spark."""
    root = list(range(len(leaf)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    if leaf:
        for i, j in spanning(np.stack([np.frombuffer(codes, CODE) for _, _, codes in leaf]), variable):
            x, y = top(i), top(j)
            root[max(x, y)] = min(x, y)
    of: dict[int, set] = {}
    for i, (_, groups, _) in enumerate(leaf):
        of.setdefault(top(i), set()).update(groups)
    return [line for i, (line, _, _) in enumerate(leaf) if len(of[top(i)]) >= min_docs]


def templates(lines: DataFrame, variable: float = VARIABLE, chunk: int = CHUNK) -> DataFrame:
    """(line, template) of lines that others of their leaf are like, from (line, leaf, data), each line once."""
    wide = CODE.itemsize

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes = [], []
            for line, leaf, codes in zip(*(c.to_pylist() for c in batch.columns)):
                for a, b in segments(len(codes) // wide, variable):
                    keys.append(xxhash.xxh3_64_intdigest(b"%d %d " % (leaf, a) + codes[wide * a : wide * b]) - (1 << 63))
                    nodes.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64())], names=["key", "node"])

    def judge(mine: list[bytes], its: list[bytes]) -> list[bool]:
        out = []
        for a, b in zip(mine, its):
            x, y = np.frombuffer(a, CODE), np.frombuffer(b, CODE)
            out.append(len(x) == len(y) and int((x != y).sum()) <= int(len(x) * variable))
        return out

    def block(data: list[bytes], number: np.ndarray, label: np.ndarray, part: np.ndarray | None) -> list[tuple[int, int]]:
        found = []
        edges = np.r_[np.flatnonzero(np.r_[True, number[1:] != number[:-1]]), len(number)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            codes = np.frombuffer(b"".join(data[a:b]), CODE).reshape(b - a, -1)  # a star's lines are of one leaf
            found += [(a + i, a + j) for i, j in spanning(codes, variable, label[a:b], None if part is None else part[a:b])]
        return found

    members = stars(lines.select("line", "leaf", "data").mapInArrow(keyed, "key long, node long"))
    return connected(members, lines.select(F.col("line").alias("node"), "data"), judge, block, chunk).select(F.col("node").alias("line"), F.col("component").alias("template"))


def templates_to_drop(docs: DataFrame, min_docs: int = MIN_DOCS, variable: float = VARIABLE) -> DataFrame:
    """(line) hashes of the lines whose template recurs across documents; docs has a column text."""
    prepare(docs.sparkSession)
    rows = parsed(docs)
    lines = rows.where("line IS NOT NULL")
    # a leaf of fewer lines, or of a single text, has no template that recurs
    often = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.min("line").alias("x"), F.max("line").alias("y"))
    often = often.where((F.col("n") >= min_docs) & (F.col("a") < F.col("b"))).select("leaf", (F.col("x") < F.col("y")).alias("several"))
    often = stored(often)  # a table's size is known, so few leaves are sent to the lines, and many meet them in a shuffle
    held = stored(lines.join(often, "leaf").select("node", "line", "leaf", "several", F.when(F.col("several"), F.col("data")).alias("data")))
    alike = templates(held.where("several").dropDuplicates(["line"]).select("line", "leaf", "data"), variable)
    has = checkpoint(held.select("line", "node").distinct().join(alike, "line", "left").select("line", F.coalesce("template", "line").alias("template"), "node"))
    # only documents of templates with enough texts need their near copies known
    texts = has.select("template", "node").distinct()
    wide = checkpoint(texts.join(texts.groupBy("template").count().where(F.col("count") >= min_docs).select("template"), "template"))
    keys = rows.where("line IS NULL").select("node", F.col("data").alias("keys")).join(wide.select("node").distinct(), "node", "left_semi")
    families = nearcopies.components_of(keys, docs)
    counted = wide.join(families, "node", "left").select("template", F.coalesce("component", "node").alias("family")).distinct().groupBy("template").count().where(F.col("count") >= min_docs)
    return has.select("line", "template").distinct().join(counted, "template", "left_semi").select("line")


def cleaned(texts: list[bytes | None], gone: np.ndarray | list[np.ndarray]) -> tuple[list[bytes | None], list[int], list[int]]:
    """(texts without lines whose hash is gone, numbers of lines, and of dropped ones); gone is sorted, one for all or one for each text."""
    out, n_lines, n_dropped = list(texts), [0 if t is None else t.count(b"\n") + 1 for t in texts], [0] * len(texts)
    for part in stretches([len(t or b"") for t in texts]):
        text, number, hashes = line_hashes(texts[part])
        edges = np.searchsorted(text, np.arange(part.stop - part.start + 1))
        if isinstance(gone, np.ndarray):
            at = np.minimum(np.searchsorted(gone, hashes), max(len(gone) - 1, 0))
            hit = gone[at] == hashes if len(gone) else np.zeros(len(hashes), bool)
        else:
            hit = np.concatenate([np.isin(hashes[a:b], gone[part.start + i]) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))] or [np.zeros(0, bool)])
        for i in np.unique(text[hit]).tolist():
            own = slice(edges[i], edges[i + 1])
            lose = set(number[own][hit[own]].tolist())
            out[part.start + i] = b"\n".join(x for k, x in enumerate(texts[part.start + i].split(b"\n")) if k not in lose)
            n_dropped[part.start + i] = len(lose)
    return out, n_lines, n_dropped


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, variable: float = VARIABLE, broadcast: int = BROADCAST) -> DataFrame:
    """docs with shortened texts, and n_lines and n_dropped behind its own columns; where docs has such a name, underscores are put behind the new one."""
    gone = checkpoint(templates_to_drop(docs, min_docs, variable))
    fields, width = [F.col(f"`{c}`") for c in docs.columns], len(docs.columns)
    text_at = docs.columns.index("text")
    taken = {c.lower() for c in docs.columns}
    counts = [name + "_" * next(i for i in range(len(taken) + 1) if name + "_" * i not in taken) for name in ("n_lines", "n_dropped")]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, T.LongType()) for name in counts)])

    def applied(batch: pa.RecordBatch, dropped: np.ndarray | list[np.ndarray]) -> pa.RecordBatch:
        texts, n_lines, n_dropped = cleaned(batch.column(text_at).cast(pa.binary()).to_pylist(), dropped)
        columns = list(batch.columns)[:width]
        columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[f.name for f in schema])

    if gone.count() <= broadcast:
        known = np.sort(np.array([r[0] for r in gone.collect()], np.int64))  # at most ``broadcast`` numbers

        def with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield applied(batch, known)

        return docs.mapInArrow(with_set, schema)

    # too many to send: each document's own dropped lines are joined to it; equal texts lose equal lines, so a hash of the text is the key
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in stretches([len(t or b"") for t in texts]):
                text, _, hashes = line_hashes(texts[part])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + part.start)), pa.array(hashes)], names=["row_key", "line"])

    def with_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.num_columns - 1).to_pylist()
            yield applied(batch, [np.array(x or [], np.int64) for x in own])

    key = F.xxhash64("text")
    per_text = docs.select(key.alias("row_key"), F.col("text").cast("binary").alias("text")).mapInArrow(hashed, "row_key long, line long").join(gone.distinct(), "line", "left_semi").groupBy("row_key").agg(F.collect_set("line").alias("gone_lines"))
    packed = docs.select(F.struct(*fields).alias("row"), key.alias("row_key")).join(per_text, "row_key", "left")
    return packed.select("row.*", "gone_lines").mapInArrow(with_list, schema)
