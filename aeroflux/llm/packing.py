"""Hierarchical multi-length packing of tokenised documents.

A document's tokens are cut into full windows of the largest tier; what remains is routed to the shortest context tier that holds it. Every tier is packed, the gaps of longer windows are filled from shorter tiers (pieces may be cut), and full sequences are dealt to step groups of equal token counts.

Each task packs the rows of its own input split and carries what is left from batch to batch, so tokens are never shuffled and memory stays bounded; at the end of a split the rest goes into full windows and then into windows of powers of two, so no padding is left. A lost executor repeats its splits with the same result.

Defined results: a null text is empty and has the end token alone; a null doc_id is kept; rows that repeat are packed as often as they occur; an empty table gives no sequence; the text of an added token is that token; other columns are ignored. The last step group of each split and tier holds what is left, so it may be smaller than the others.
"""

from __future__ import annotations

import base64
import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroflux.llm.common import prepare

#: Context sizes, shortest first.
TIERS = (256, 512, 1024, 2048)
END = 1
#: Tokens of one step group; every tier fills groups of its own.
STEP_TOKENS = 16 * 2048
#: Left-over tokens beyond which a task closes its open pieces.
CARRY = 1 << 18
#: Texts over so many characters are tokenised in parts.
LONG_TEXT = 200_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, sequence_tokens int, step_group long"

# a single space between two letters always starts a new token of the splitting pattern
_BOUNDARY = regex.compile(r"(?<=\p{L}) (?=\p{L})")


class Encoder:
    """Byte-level BPE ids. The rank file holds the same vocabulary as the tokenizers file and gives the same ids several times faster; the tokens that the tokenizers file adds are found in texts as it finds them."""

    def __init__(self, path: str | None = None, tokenizers_file: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(tokenizers_file or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
            added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def __call__(self, text: str | None) -> np.ndarray:
        """The text's ids and the end token."""
        ids: list[int] = []
        for part in parts_of(text or ""):
            ids += self.encoding.encode(part, allowed_special="all")
        ids.append(END)
        return np.array(ids, "<u4")


def parts_of(text: str, limit: int = LONG_TEXT) -> Iterator[str]:
    """Parts of a long text, cut only where the tokens on both sides don't depend on each other."""
    start = 0
    while len(text) - start > limit:
        cut = _BOUNDARY.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Piece:
    """Some consecutive ids of one document."""

    __slots__ = ("doc_id", "ids", "start", "total")

    def __init__(self, doc_id: int | None, ids: np.ndarray, start: int, total: int):
        self.doc_id, self.ids, self.start, self.total = doc_id, ids, start, total

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.ids[:at], self.start, self.total), Piece(self.doc_id, self.ids[at:], self.start + at, self.total)


class Packer:
    """Packs pieces; ``out`` receives (tier, pieces) of each finished sequence."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.out = tiers, []
        self.waiting: list[tuple[int, int, Piece]] = []  # (length, arrival, piece), shortest first
        self.arrivals = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Full windows of the largest tier at once; the rest waits for its tier."""
        piece, largest = Piece(doc_id, ids, 0, len(ids)), self.tiers[-1]
        while len(piece.ids) >= largest:
            window, piece = piece.cut(largest)
            self.out.append((largest, [window]))
        self._wait(piece)

    def _wait(self, piece: Piece) -> None:
        if len(piece.ids):
            self.arrivals += 1
            bisect.insort(self.waiting, (len(piece.ids), self.arrivals, piece))

    def _largest(self, most: int) -> Piece | None:
        """The longest waiting piece of at most so many tokens."""
        at = bisect.bisect_right(self.waiting, (most, self.arrivals + 1))
        return self.waiting.pop(at - 1)[2] if at else None

    def pack(self) -> None:
        """From the longest tier down: open a window with a piece of that tier and fill its gap from shorter ones.

        The last gap of a window is closed with a cut of the shortest piece; windows open only while enough tokens wait to fill them.
        """
        held = sum(length for length, _, _ in self.waiting)
        for number in range(len(self.tiers) - 1, -1, -1):
            tier = self.tiers[number]
            floor = self.tiers[number - 1] if number else 0
            while held >= tier and self.waiting and self.waiting[-1][0] > floor:
                pieces, gap = [], tier
                while gap:
                    piece = self._largest(gap)
                    if piece is None:
                        piece, rest = self.waiting.pop(0)[2].cut(gap)
                        self._wait(rest)
                    pieces.append(piece)
                    gap -= len(piece.ids)
                held -= tier
                self.out.append((tier, pieces))

    def close(self, to_end: bool) -> None:
        """Waiting pieces one after another into full windows of the largest tier; to the end also into powers of two."""
        stream, size = [piece for _, _, piece in self.waiting], sum(length for length, _, _ in self.waiting)
        self.waiting = []
        while size:
            tier = self.tiers[-1] if size >= self.tiers[-1] else 1 << (size.bit_length() - 1)
            if tier < self.tiers[-1] and not to_end:
                break
            pieces, gap = [], tier
            while gap:
                piece = stream.pop(0)
                if len(piece.ids) > gap:
                    piece, rest = piece.cut(gap)
                    stream.insert(0, rest)
                pieces.append(piece)
                gap -= len(piece.ids)
            size -= tier
            self.out.append((tier, pieces))
        for piece in stream:
            self._wait(piece)


def pack(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece of a document in a sequence; tokenizer is the path of a rank file."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(tokenizer), Packer(tiers)
        base = TaskContext.get().partitionId() << 36
        counts: dict[int, int] = {}
        number = 0

        def written() -> pa.RecordBatch:
            nonlocal number
            rows = []
            for tier, pieces in packer.out:
                # groups of one tier hold step_tokens tokens each; small last windows share a group
                group = (tier.bit_length() << 28) + counts.get(tier, 0) * tier // step_tokens
                counts[tier] = counts.get(tier, 0) + 1
                offset = 0
                for p in pieces:
                    rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, base + number, offset, tier, tier, base + group))
                    offset += len(p.ids)
                number += 1
            packer.out = []
            columns = list(zip(*rows)) or [()] * 10
            kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, encode(text.as_py()))
            packer.pack()
            if sum(length for length, _, _ in packer.waiting) > CARRY:
                packer.close(to_end=False)
            yield written()
        packer.close(to_end=True)
        yield written()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
