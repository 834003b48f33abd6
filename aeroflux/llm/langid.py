"""Language ID by compression: text is encoded with one zstandard raw-content dictionary per language; the smallest result wins, narrow margins are rejected.

``learn`` fits the dictionaries on a bounded, documented sample of labelled rows; ``identify`` labels every whole text. A text is cut into chunks so that the dictionary counts to the end of a long text; the sizes of all chunks are added up.

Defined results: null texts and texts without a letter are ``und`` with score 0 and are not accepted; when nothing was learned every text is ``und``; equal sizes go to the language that sorts first; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeroflux.llm.common import prepare

#: Bound of the sample: documents for each language, and bytes of each language's dictionary.
DOCS_PER_LANG, DICTIONARY_BYTES = 150, 112 * 1024
#: Bytes that are compressed at once.
CHUNK = 8192
#: Share of a text's bytes by which the best language must beat the second to be accepted.
MARGIN = 0.01
#: zstandard settings: matches of four bytes count, the search stays cheap.
LEVEL, MIN_MATCH = 6, 4

_LETTER = regex.compile(r"\p{L}")


def learn(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, from rows (doc_id, text, lang).

    The sample is the documents with the smallest hash of the identifier, at most ``docs_per_lang`` of a language, each giving at most its share of four times the dictionary, in four pieces spread over the whole text; so the driver gets a bounded number of bytes for each language. Rows that share a doc_id give the text that sorts first.
    """
    share = max(256, 4 * dictionary_bytes // docs_per_lang)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # the sort sees identifiers only; texts are fetched for the bounded sample
    picked = usable.select("lang", "doc_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_lang)
    text, quarter = F.lower("text"), share // 4
    spread = F.concat_ws("\n", *[text.substr((F.lit(1) + F.floor((F.length("text") - quarter) * k / 3)).cast("int"), F.lit(quarter)) for k in range(4)])
    piece = F.when(F.length("text") <= share, text).otherwise(spread)
    rows = usable.join(F.broadcast(picked), ["lang", "doc_id"]).groupBy("lang", "n").agg(F.min(piece).alias("piece")).collect()
    found: dict[str, list[tuple[int, bytes]]] = {}
    for row in rows:
        found.setdefault(row["lang"], []).append((row["n"], row["piece"].encode()))
    found = _agreed(found, dictionary_bytes)
    # what stands last in a dictionary is the cheapest to refer to; keep the end
    return {lang: b"\n".join(piece for _, piece in sorted(found[lang]))[-dictionary_bytes:] for lang in sorted(found)}


def _agreed(found: dict[str, list[tuple[int, bytes]]], dictionary_bytes: int) -> dict[str, list[tuple[int, bytes]]]:
    """The sampled pieces whose label the other half of the sample confirms, for labels may be wrong and a wrong text in a dictionary draws its copies."""
    halves = [{lang: [x for x in pieces if x[0] % 2 == k] for lang, pieces in found.items()} for k in (0, 1)]
    if min((len(pieces) for half in halves for pieces in half.values()), default=0) < 8:
        return found
    judges = [Identifier({lang: b"\n".join(p for _, p in pieces)[-dictionary_bytes:] for lang, pieces in half.items()}) for half in halves]
    kept = {lang: [x for x in pieces if judges[1 - x[0] % 2](x[1].decode())[0] == lang] for lang, pieces in found.items()}
    return {lang: kept[lang] or pieces for lang, pieces in found.items()}


class Identifier:
    """Per-worker compressors of the learned dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = [lang for lang in sorted(dictionaries) if len(dictionaries[lang]) >= 8]
        self.compressors = []
        for lang in self.langs:
            parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=18, min_match=MIN_MATCH, write_checksum=0, write_content_size=0, write_dict_id=0)
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=parameters)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=parameters, dict_data=content))

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode()
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        return [sum(len(c.compress(chunk)) for chunk in chunks) for c in self.compressors]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and acceptance."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, False
        sizes = self.sizes(text)
        best = min(sizes)
        scale = 1 + 0.02 * len(text)
        weights = [math.exp((best - size) / scale) for size in sizes]
        second = sorted(sizes)[1] if len(sizes) > 1 else math.inf
        return self.langs[sizes.index(best)], 1 / sum(weights), second - best >= MARGIN * len(text)


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for every row; only the text is looked at."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Identifier(dictionaries)
        for batch in batches:
            langs, scores, accepted = zip(*[judge(x.as_py()) for x in batch.column(1)]) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
