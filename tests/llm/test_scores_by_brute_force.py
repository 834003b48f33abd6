"""Scores of language, quality and media against plain versions of all their steps."""

import hashlib
import io
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from test_corpus_operators import words

from aeroflux.llm import langid, media, quality

TEXTS = [None, "", "12 34 !!", "a", "Grüße aus der Stadt", words(random.Random(1), 60), words(random.Random(2), 4000, "nopqrst"), words(random.Random(3), 30, "abcnop"), "é" * 5000]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double").repartition(3)


def test_language_scores_equal_zstandard_directly(spark):
    """Sizes of 8 KB pieces, each compressed by the library's own call with one raw dictionary per language."""
    dictionaries = {"aa": words(random.Random(7), 900).encode(), "nn": words(random.Random(8), 900, "nopqrst").encode(), "zz": b"tiny"}
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["accepted"]) for r in langid.identify(frame(spark), dictionaries).collect()}
    for i, text in enumerate(TEXTS):
        if text is None or not any(c.isalpha() for c in text):
            assert got[i] == ("und", 0.0, False)
            continue
        data = text.lower().encode()
        sizes = {}
        for lang in ("aa", "nn"):  # a dictionary below eight bytes is none
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, window_log=18, min_match=langid.MIN_MATCH, write_checksum=0, write_content_size=0, write_dict_id=0)
            raw.precompute_compress(compression_params=settings)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(compression_params=settings, dict_data=raw).compress(data[k : k + 8192])) for k in range(0, len(data), 8192))
        best = min(sizes, key=lambda k: (sizes[k], k))
        scale = 1 + 0.02 * len(text)
        score = 1 / sum(math.exp((sizes[best] - s) / scale) for s in sizes.values())
        assert got[i][0] == best and got[i][1] == pytest.approx(score)
        assert got[i][2] == (max(sizes.values()) - sizes[best] >= 0.01 * len(text))


def test_quality_scores_equal_a_plain_forward_pass(spark):
    """Embedding, filters at every second place, maximum, both poolings and the logistic function, one by one."""
    rng = random.Random(4)
    rows = [(i, i % 2, [words(rng, 40, "abcde" if i % 2 else "vwxyz").encode()]) for i in range(40)]
    network = quality.train(rows, epochs=2)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.score(frame(spark), network).collect()}
    for i, text in enumerate(TEXTS):
        data = (text or "").encode()
        pooled = []
        starts = range(0, max(1, len(data) - 64), 960) if data else []
        for start in starts:
            symbols = [b + 1 for b in data[start : start + 1024]]
            symbols += [0] * (1024 - len(symbols))
            embedded = network.E[symbols]
            values = [np.einsum("we,wef->f", embedded[p : p + 6], network.W) for p in range(0, 1024 - 6 + 1, 2)]
            pooled.append(np.maximum(np.max(values, axis=0) + network.b, 0))
        features = np.concatenate([np.max(pooled, axis=0), np.mean(pooled, axis=0)]) if pooled else np.zeros(32)
        p = 1 / (1 + math.exp(-float(np.clip(features @ network.v + network.c[0], -30, 30))))
        assert got[i][0] == pytest.approx(p, abs=1e-4), i
        assert got[i][1] == int(got[i][0] >= 0.3)


def cell_means(image, height, width):
    """Means over fractional cells by adding every pixel's shared area."""
    h, w = image.shape
    out = np.zeros((height, width))
    share = lambda i, n, k, size: max(0.0, min(i + 1, (k + 1) * size / n) - max(i, k * size / n))
    for a in range(height):
        for b in range(width):
            out[a, b] = sum(image[r, c] * share(r, height, a, h) * share(c, width, b, w) for r in range(h) for c in range(w)) / ((h / height) * (w / width))
    return out


def test_media_features_equal_plain_means(spark):
    rng = random.Random(6)
    texts = [None, "", "x", words(rng, 40), words(rng, 150), "y" * 64, "ab" * 96]
    got = {r["doc_id"]: r for r in media.text_media_digest(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        small = np.round(cell_means(image.astype(float), 8, 9), 6)
        bits = "".join(str(int(small[r, c + 1] > small[r, c])) for r in range(8) for c in range(8))
        assert got[i]["feature"] == f"{int(bits, 2):016x}"
        stored = io.BytesIO()
        np.lib.format.write_array(stored, image[:, :, None])
        assert got[i]["media_sha256"] == hashlib.sha256(stored.getvalue()).hexdigest() and got[i]["media_bytes"] == len(stored.getvalue())


def test_resize_of_tall_images_holds_few_rows():
    """Rows between cell edges are added up in place; the mean of an image of 32 MB is exact."""
    image = np.full((500_000, 64), 7, np.uint8)
    image[:250_000] = 3
    small = media.area_resize(image, 8, 9)
    assert (small[:4] == pytest.approx(3)) and (small[4:] == pytest.approx(7))


def test_quality_of_a_long_text_needs_little_memory_and_no_other_result():
    """Groups of a text's chunks give what all of them at once give; of 12 MB no unfolded copy is held."""
    rng = np.random.default_rng(3)
    network = quality.Network(seed=11)
    tables = network.tables()
    data = rng.integers(1, 255, 12_000_000, dtype=np.uint8).tobytes()
    texts = pa.array([b"short", data, b"", data[: quality.STEP * quality.GROUP + quality.OVERLAP], None, data[: quality.STEP * quality.GROUP + quality.OVERLAP + 1]], pa.binary())
    tracemalloc.start()
    got = quality.document_features(network, tables, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * len(data)
    for i, text in enumerate(texts):
        chunks = quality.chunks_of(np.frombuffer(text.as_py() or b"", np.uint8))
        pooled = network.pooled(chunks, tables)[0]
        assert np.array_equal(got[i], network.features(pooled, np.zeros(len(chunks), np.int64), 1)[0])
