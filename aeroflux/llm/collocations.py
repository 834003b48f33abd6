"""Phrase collocations from an FM-index of every shard's word ids.

Tasks cut their texts to words and gather them, each language for itself, into shards of bounded length; a shard is a sequence of word ids in which a separator stands between pieces. The index of a shard holds the order of its suffixes and of its prefixes (the suffixes of the reversed sequence), as far as the depth of the phrases needs, with the Burrows-Wheeler transform of both. A phrase is a pair of intervals, one in each order. It is extended by a word on the right through the transform of the reversed sequence, which gives all right extensions with their counts and places their intervals in the forward order, and by a word on the left through the forward transform. All phrases of one length are extended together.

Counts are summed across shards, length by length: a phrase of two words is looked for only if both words occur often enough in the whole table, one of three words only if both its phrases of two do. Counts never grow with length, so nothing is lost. What a shard has to know of the whole table are its own words and phrases: it gets them back from the window that adds up the counts, by shard; nothing is broadcast. Word ids are numbers given to distinct (language, word), not hashes, so no two words are taken for one.

Shards are cut anywhere: a shard also holds the next words behind its end, as many as the longest phrase less one, and takes back what lies wholly in them, since the next shard counts it again.

Defined results: null texts are empty; a null language is `und`; empty texts and texts of separators have no words; repeated rows count as often as they occur; texts are read whole, whatever their length, and neither documents nor pieces limit a shard; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeroflux.llm.common import prepare, stored

#: Symbols of a shard, so that two ids and more fit a 64-bit key. Memory of a task follows it.
SHARD = (1 << 21) - 64
#: Bits of a shard's number that count the shards of a task, and of a word's number that count the words of a shard.
PER_TASK, PER_SHARD = 20, 21
#: Words of the longest phrase.
DEPTH = 3
#: Least count of a phrase, and share of its occurrences (in hundredths) inside a longer candidate that drops it.
LEAST, INSIDE = 10, 50
#: Phrases of each language that are returned.
TOP = 2000
#: Parts into which a language is dealt before its best phrases are ranked together.
SALTS = 64

#: Bytes between words, and bytes between pieces.
BLANKS, STOPS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)] = 1
KIND[list(STOPS)] = 2


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, A-Z lower-cased, and for each whether a piece begins with it."""
    lower = pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    offsets = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = np.frombuffer(lower.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0]
    kind = KIND[data]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = inside[begins]  # a word never runs on into the next text
    starts = np.flatnonzero(first)
    letters = data[inside]
    places = np.cumsum(inside)[starts] - 1 if len(starts) else np.zeros(0, np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.r_[places, len(letters)].astype(np.int64)), pa.py_buffer(letters))
    fresh = np.zeros(len(starts) + 1, bool)
    fresh[0] = True
    fresh[np.searchsorted(starts, np.flatnonzero(kind == 2))] = True
    fresh[np.searchsorted(starts, begins)] = True
    return words, fresh[:-1]


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """(shard, lang, words, counts, ids, tail): distinct words of a shard with their counts, and its symbols as int32, 0 between pieces and i + 1 for words[i]; the last `tail` symbols are the next shard's first."""
    prepare(docs.sparkSession)
    names = ["shard", "lang", "words", "counts", "ids", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << PER_TASK
        held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        length: dict[str, int] = {}

        def packed(lang: str, last: bool) -> Iterator[pa.RecordBatch]:
            """Shards of what is held for a language; all of it if nothing follows."""
            nonlocal number
            words = pa.concat_arrays([w for w, _ in held[lang]])
            fresh = np.concatenate([f for _, f in held[lang]])
            fresh[:1] = True
            place = np.arange(len(words)) + np.cumsum(fresh)  # a separator before each piece
            symbols = len(words) + int(fresh.sum())
            low = 0
            while low < symbols and (last or symbols - low >= size + DEPTH):
                high = min(low + size, symbols)
                end = min(high + DEPTH - 1, symbols)
                a, b = np.searchsorted(place, [low, end])
                coded = words.slice(a, b - a).dictionary_encode()
                ids = np.zeros(end - low, np.int32)
                code = coded.indices.to_numpy() + 1
                ids[place[a:b] - low] = code
                core = code[: np.searchsorted(place, high) - a]  # words of the tail count in the next shard
                counts = np.bincount(core, minlength=len(coded.dictionary) + 1)[1:]
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                row = [pa.array([number], pa.int64()), pa.array([lang], pa.string()), one(coded.dictionary.cast(pa.string())), one(pa.array(counts, pa.int64())), pa.array([ids.tobytes()], pa.binary()), pa.array([end - high], pa.int32())]
                yield pa.RecordBatch.from_arrays(row, names=names)
                number, low = number + 1, high
            a = np.searchsorted(place, low)
            held[lang] = [(words.slice(a), fresh[a:])] if a < len(words) else []
            length[lang] = len(words) - a + int(fresh[a:].sum())

        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                words, fresh = words_of(batch["text"].filter(pc.equal(langs.indices, code)))
                if len(words):
                    held.setdefault(lang, []).append((words, fresh))
                    length[lang] = length.get(lang, 0) + len(words) + int(fresh.sum())
                    if length[lang] >= size + DEPTH:
                        yield from packed(lang, last=False)
            if sum(length.values()) > 2 * size:  # many languages: the longest makes room
                longest = max(length, key=length.get)
                yield from packed(longest, last=True)
        for lang in list(held):
            if held[lang]:
                yield from packed(lang, last=True)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text"))
    return rows.mapInArrow(run, "shard long, lang string, words array<string>, counts array<long>, ids binary, tail int")


class Index:
    """Forward and reversed order of a sequence in which 0 separates pieces, sorted as deep as phrases of DEPTH words need.

    Extending all words to the right takes the reversed order sorted by one symbol, extending pairs to the left the forward order sorted by two.
    """

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.symbols, self.sigma = symbols.astype(np.int64), sigma
        self.starts = np.r_[0, np.cumsum(np.bincount(self.symbols, minlength=sigma))]  # of each symbol's interval, the same in both orders

    def backward(self) -> np.ndarray:
        """The transform of the forward order: what stands before each suffix, 0 before the first."""
        following = np.r_[self.symbols[1:], 0]
        order = np.argsort(self.symbols * self.sigma + following)
        return np.r_[0, self.symbols[:-1]][order]

    def onward(self) -> np.ndarray:
        """The transform of the reversed order: what stands behind each prefix, 0 behind the last."""
        return np.r_[self.symbols[1:], 0][np.argsort(self.symbols, kind="stable")]

    def extend(self, transform: np.ndarray, low: np.ndarray, count: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All extensions of the phrases whose intervals begin at low in this order and at other in the opposite one.

        (phrase, symbol, count, low in the opposite order): there, a phrase's extensions lie one behind the other by symbol, separators first.
        """
        phrase = np.repeat(np.arange(len(low)), count)
        within = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
        keys = np.sort(phrase * self.sigma + transform[np.repeat(low, count) + within])
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        found = np.diff(np.r_[at, len(keys)])
        phrase, symbol = keys[at] // self.sigma, keys[at] % self.sigma
        place = other[phrase] + at - (np.cumsum(count) - count)[phrase]
        words = symbol > 0
        return phrase[words], symbol[words], found[words], place[words]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, count, low in the forward order) of all pairs of words in pieces."""
        low, count = self.starts[1:-1], np.diff(self.starts)[1:]
        first, second, count, place = self.extend(self.onward(), low, count, low)
        return first + 1, second, count, place


def renamed(ids: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Symbols with 1, 2, ... for the given codes, in their order, and separators for all others."""
    name = np.zeros(max(int(ids.max(initial=0)), int(codes.max(initial=0))) + 1, np.int64)
    name[codes] = np.arange(1, len(codes) + 1)
    return name[ids]


def often(counted: DataFrame, keys: list[str], least: int, own: str) -> DataFrame:
    """Rows whose key counts at least `least` over all shards, with that count f and `own`, the smallest value of the column so named."""
    one = Window.partitionBy(*keys)
    return counted.withColumns({"f": F.sum("count").over(one), "first": F.min(own).over(one)}).where(F.col("f") >= least)


def frequent(docs: DataFrame, least: int = LEAST, size: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables of (lang, n); of words (id, lang, word, f); of pairs (g1, g2, f) and triples (g1, g2, g3, f) of word ids: all phrases that occur at least `least` times in their language."""
    dealt = stored(shards(docs, size))
    totals = dealt.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    entries = dealt.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "entry")).select("shard", "pos", "lang", "entry.words", F.col("entry.counts").alias("count"), (F.shiftleft("shard", PER_SHARD) + F.col("pos")).alias("own"))
    known = stored(often(entries, ["lang", "words"], least, "own").select("shard", "pos", F.col("first").alias("id"), "f", F.when(F.col("own") == F.col("first"), F.col("lang")).alias("lang"), F.when(F.col("own") == F.col("first"), F.col("words")).alias("word")))
    sequences = dealt.select("shard", "ids", "tail").groupBy("shard")

    def opened(shard: pa.Table, feed: pa.Table) -> tuple[Index, np.ndarray, np.ndarray]:
        """Index, word ids by symbol, and the tail's symbols."""
        ids = np.frombuffer(shard["ids"][0].as_py(), np.int32)
        words = feed.filter(pc.is_valid(feed["pos"]))
        codes, names = words["pos"].to_numpy() + 1, words["g1"].to_numpy()
        symbols = renamed(ids, codes)
        return Index(symbols, len(codes) + 1), np.r_[-1, names], symbols[len(symbols) - shard["tail"][0].as_py() :]

    def two(shard: pa.Table, feed: pa.Table) -> pa.Table:
        if not shard.num_rows or not feed.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "g1": pa.array([], pa.int64()), "g2": pa.array([], pa.int64()), "count": pa.array([], pa.int64())})
        index, names, tail = opened(shard, feed)
        first, second, count, _ = index.pairs()
        for a, b in zip(tail[:-1], tail[1:]):
            if a and b:
                count[(first == a) & (second == b)] -= 1
        # a pair that only the tail holds keeps its row: this shard has to hear whether it is frequent
        return pa.table({"shard": pa.array(np.full(len(count), shard["shard"][0].as_py()), pa.int64()), "g1": names[first], "g2": names[second], "count": count})

    def three(shard: pa.Table, feed: pa.Table) -> pa.Table:
        if not shard.num_rows or not feed.num_rows:
            return pa.table({name: pa.array([], pa.int64()) for name in ("g1", "g2", "g3", "count")})
        index, names, _ = opened(shard, feed)
        first, second, count, place = index.pairs()
        # frequent pairs by word ids: the shard's own pairs are sorted by symbols, so both sides meet by sorted keys
        symbol = np.argsort(names[1:])
        told = feed.filter(pc.is_null(feed["pos"]))
        coded = lambda g: symbol[np.searchsorted(names[1:], g, sorter=symbol)] + 1
        wanted = np.sort(coded(told["g1"].to_numpy()) * index.sigma + coded(told["g2"].to_numpy())) if told.num_rows else np.zeros(0, np.int64)
        pair = first * index.sigma + second
        kept = np.flatnonzero(np.isin(pair, wanted, assume_unique=True))
        parent, before, found, _ = index.extend(index.backward(), place[kept], count[kept], place[kept])
        left = np.isin(before * index.sigma + first[kept][parent], wanted)
        parent, before, found = kept[parent[left]], before[left], found[left]
        return pa.table({"g1": names[before], "g2": names[first[parent]], "g3": names[second[parent]], "count": found})

    words_feed = known.select("shard", "pos", F.col("id").alias("g1"), F.lit(None).cast("long").alias("g2"))
    counted = sequences.cogroup(words_feed.groupBy("shard")).applyInArrow(two, "shard long, g1 long, g2 long, count long")
    joined = stored(often(counted, ["g1", "g2"], least, "shard").select("shard", "g1", "g2", "f", (F.col("shard") == F.col("first")).alias("own")))
    pairs_feed = joined.select("shard", F.lit(None).cast("int").alias("pos"), "g1", "g2")
    triples = sequences.cogroup(words_feed.unionByName(pairs_feed).groupBy("shard")).applyInArrow(three, "g1 long, g2 long, g3 long, count long").groupBy("g1", "g2", "g3").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
    return totals, known.where("word IS NOT NULL").select("id", "lang", "word", "f"), joined.where("own").select("g1", "g2", "f"), stored(triples)


def scored(a: str, left: str, right: str) -> str:
    """floor(1000000 a a / (left right)), exactly."""
    exact = lambda x: f"cast({x} as decimal(38,0))"
    return f"({exact(1000000)} * {exact(a)} * {exact(a)} div ({exact(left)} * {exact(right)}))"


def candidates(words: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """(lang, phrase, a, cut, l, r, score, longer): every frequent phrase of two or three words with its lowest-scoring cut and the most occurrences of a longer candidate that holds it."""
    word = lambda i: words.select(F.col("id").alias(f"g{i}"), F.col("lang" if i == 1 else "word").alias("lang" if i == 1 else f"w{i}"), F.col("f").alias(f"f{i}"), *([F.col("word").alias("w1")] if i == 1 else []))
    extended = triples.select(F.explode(F.array(F.struct("g1", "g2", "f"), F.struct(F.col("g2").alias("g1"), F.col("g3").alias("g2"), "f"))).alias("x")).groupBy("x.g1", "x.g2").agg(F.max("x.f").alias("longer"))
    two = pairs.withColumnRenamed("f", "a").join(word(1), "g1").join(word(2), "g2").join(extended, ["g1", "g2"], "left")
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.lit(1).alias("cut"), F.col("f1").alias("l"), F.col("f2").alias("r"), F.expr(scored("a", "f1", "f2")).alias("score"), F.coalesce("longer", F.lit(0).cast("long")).alias("longer"))
    front, back = pairs.withColumnRenamed("f", "f12"), pairs.select(F.col("g1").alias("g2"), F.col("g2").alias("g3"), F.col("f").alias("f23"))
    three = triples.withColumnRenamed("f", "a").join(front, ["g1", "g2"]).join(back, ["g2", "g3"]).join(word(1), "g1").join(word(2), "g2").join(word(3), "g3")
    three = three.withColumns({"s1": F.expr(scored("a", "f1", "f23")), "s2": F.expr(scored("a", "f12", "f3"))}).withColumn("early", F.col("s1") <= F.col("s2"))
    either = lambda x, y: F.when(F.col("early"), x).otherwise(y)
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", either(F.lit(1), F.lit(2)).alias("cut"), either(F.col("f1"), F.col("f12")).alias("l"), either(F.col("f23"), F.col("f3")).alias("r"), either(F.col("s1"), F.col("s2")).alias("score"), F.lit(0).cast("long").alias("longer"))
    return two.unionByName(three)


def best_phrases(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP, size: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases."""
    totals, words, pairs, triples = frequent(docs, least, size)
    found = candidates(words, pairs, triples).where(100 * F.col("longer") < inside * F.col("a"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # each part's best first, so that no language is ranked in one task
    parts = Window.partitionBy("lang", "salt").orderBy(*order)
    best = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("place", F.row_number().over(parts)).where(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
