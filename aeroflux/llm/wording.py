"""Words, lines and shingles of many texts at once, as numpy arrays.

Words are what stands between ASCII white space; lines end at line feeds. All words of a block of bytes are hashed together, eight bytes at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of texts that are parsed together; longer texts are cut at white space.
BLOCK = 1 << 21
#: Words over so many bytes are hashed one by one.
LONG_WORD = 128
#: What a line keeps of each word: 32 bits, so two different words are taken for equal once in 4.3 billion.
CODE = np.dtype("<u4")

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Hash of a variable field: a word with a digit.
FIELD = np.uint64(xxhash.xxh3_64_intdigest(b"<*>"))


def stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _PRIME
    return x ^ (x >> np.uint64(32))


def _lowered(x: np.ndarray) -> np.ndarray:
    """Eight bytes in each number, A to Z in lower case: a byte's top bit marks it where both bounds hold."""
    ones, low = np.uint64(0x0101010101010101), x & np.uint64(0x7F7F7F7F7F7F7F7F)
    upper = ((low + ones * np.uint64(128 - 65)) ^ (low + ones * np.uint64(127 - 90))) & ~x & np.uint64(0x8080808080808080)
    return x | (upper >> np.uint64(2))


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, lower: bool, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each word in lower case and as it is, as far as wanted; data has eight bytes more than the words need."""
    small = size.astype(np.uint64) * _PRIME
    same = small.copy()
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    live = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(live):
        chunk = eights[start[live] + at]
        left = size[live] - at
        used = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        chunk = np.where(left >= 8, chunk, chunk & ((np.uint64(1) << used) - np.uint64(1)))
        if lower:
            small[live] = stir(small[live] + _lowered(chunk))
        if exact:
            same[live] = stir(same[live] + chunk)
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        word = data[start[i] : start[i] + size[i]].tobytes()
        small[i], same[i] = xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest(word)
    return small, same


def _blocks(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of data cut at white space."""
    at = 0
    while len(data) - at > BLOCK:
        cut = _SPACE.search(data, at + BLOCK)
        if cut is None:
            break
        yield at, data[at : cut.start()]
        at = cut.start()
    yield at, data[at:]


class Words:
    """The words of some texts one after another.

    ``lower`` (unless not wanted) are the hashes of the words with A to Z in lower case, ``exact`` (if wanted) of the words as they are, with one value for all words with a digit. ``text_at`` and ``line_at`` are the numbers of the words at which texts and lines begin, with one entry more than there are; ``line_text`` is the text of each line.
    """

    def __init__(self, texts: list[bytes | None], exact: bool = False, lower: bool = True):
        texts = [t or b"" for t in texts]
        data = b"\n".join(texts)
        starts, small, same, feeds = [], [], [], []
        for offset, block in _blocks(data):
            x = np.frombuffer(block + bytes(8), np.uint8)
            space = (x == 32) | ((x >= 9) & (x <= 13))
            space[-8:] = True
            edges = np.flatnonzero(space[1:] != space[:-1]) + 1
            if not space[0]:
                edges = np.r_[0, edges]
            start, size = edges[0::2], edges[1::2] - edges[0::2]
            starts.append(start + offset)
            feeds.append(np.flatnonzero(x == 10) + offset)
            low, whole = _hashes(x, start, size, lower, exact)
            small.append(low)
            if exact:
                digit = np.flatnonzero((x >= 48) & (x <= 57))
                whole[np.searchsorted(start, digit, side="right") - 1] = FIELD
                same.append(whole)
        start = np.concatenate(starts)
        self.lower = np.concatenate(small) if lower else None
        self.exact = np.concatenate(same) if exact else None
        begins = np.r_[0, np.cumsum([len(t) + 1 for t in texts])][:-1] if texts else np.zeros(0, int)
        self.text_at = np.r_[np.searchsorted(start, begins), len(start)]
        line_begins = np.r_[0, np.concatenate(feeds) + 1] if texts else np.zeros(0, int)
        self.line_at = np.r_[np.searchsorted(start, line_begins), len(start)]
        self.line_text = np.searchsorted(begins, line_begins, side="right") - 1

    def lines(self, leading: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number, hash, leaf, first word, words) of the lines that have a word; a leaf is the number of words and the leading ones."""
        count = np.diff(self.line_at)
        number = np.flatnonzero(count)
        start, count = self.line_at[number], count[number]
        if not len(number):
            none = np.zeros(0, np.uint64)
            return number, none, none, start, count
        place = np.arange(len(self.exact)) - np.repeat(start, count)
        sums = np.add.reduceat(stir(self.exact + (place.astype(np.uint64) + np.uint64(1)) * _PRIME), start)
        size = stir(count.astype(np.uint64))
        leaf = size.copy()
        for k in range(leading):
            has = count > k
            leaf[has] = stir(leaf[has] + self.exact[start[has] + k])
        return number, stir(sums ^ size), leaf, start, count

    def codes(self) -> np.ndarray:
        """The upper half of each word's hash, to compare words by."""
        return (self.exact >> np.uint64(32)).astype(CODE)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, where each text's begin): every shingle of so many words, repeats included; a shorter text is one shingle."""
        size = np.diff(self.text_at)
        counts = np.where(size >= width, size - width + 1, np.minimum(size, 1))
        at = np.r_[0, np.cumsum(counts)]
        out = np.empty(at[-1], np.uint64)
        long = size >= width
        total = len(self.lower) - width + 1
        if total > 0:
            every = np.full(total, width, np.uint64)
            for k in range(width):
                every = stir(every + self.lower[k : k + total])
            left = np.repeat(self.text_at[1:], size)[:total] - np.arange(total)  # words up to the text's end
            own = left >= width
            out[np.repeat(long, counts)] = every[own]
        for i in np.flatnonzero(~long & (size > 0)).tolist():
            value = np.full(1, size[i], np.uint64)
            for k in range(self.text_at[i], self.text_at[i + 1]):
                value = stir(value + self.lower[k : k + 1])
            out[at[i]] = value[0]
        return out, at


def stretches(sizes: list[int]) -> Iterator[slice]:
    """Consecutive stretches of values whose sizes add up to about BLOCK, so that memory stays bounded."""
    start = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= BLOCK:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))
