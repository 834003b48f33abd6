"""Quality classifier: a byte-level convolutional network in numpy.

Filters over byte windows are learned by gradient descent; a document is covered by overlapping chunks to its last byte, each filter's responses are max-pooled inside a chunk, and the chunks' maxima and means are combined into one probability.

``sample`` draws the bounded training rows, ``train`` fits on the driver, ``score`` runs over every whole text inside Arrow batches.

Defined results: null and empty texts are scored as no chunk (all features zero); without usable labels every score is 0.5; repeated rows give repeated results; other columns are ignored. Texts of any length are scored whole: beside its bytes, a text needs 64 bytes for each of its chunks and one group of GROUP chunks unfolded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroflux.llm.common import prepare

#: Bound of the training sample: documents of each class, and chunks of a document that training looks at.
DOCS_PER_CLASS, TRAIN_CHUNKS = 1500, 6
#: Shape of the network.
CHUNK, OVERLAP, WIDTH, STRIDE, EMBED, FILTERS = 1024, 64, 6, 2, 8, 16
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.01, 7
THRESHOLD = 0.3
STEP = CHUNK - OVERLAP
#: Chunks that are unfolded together when texts are scored.
GROUP = 512


def chunk_count(size: int) -> int:
    """Chunks that cover so many bytes."""
    return max(1, -(-(size - OVERLAP) // STEP)) if size else 0


def chunks_of(data: np.ndarray) -> np.ndarray:
    """Overlapping chunks that cover all bytes, as (count, CHUNK) symbols; 0 pads, byte b is b + 1."""
    if data.size == 0:
        return np.zeros((0, CHUNK), np.int32)
    count = chunk_count(data.size)
    padded = np.zeros((count - 1) * STEP + CHUNK, np.int32)
    padded[: data.size] = data
    padded[: data.size] += 1
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class Network:
    """E embeds 257 symbols; W holds FILTERS filters over WIDTH embedded symbols; v combines max and mean of the pooled chunks."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.E = rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        self.E[0] = 0
        self.W = rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH, EMBED, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = np.zeros(2 * FILTERS, np.float32)
        self.c = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.E, self.W, self.b, self.v, self.c]

    def tables(self) -> np.ndarray:
        """Filter responses of a symbol at each place of a window, so that a convolution is a sum of look-ups."""
        return np.einsum("se,wef->wsf", self.E, self.W).astype(np.float32)

    def pooled(self, chunks: np.ndarray, tables: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Max over positions of each filter; chunks are taken in blocks of bounded size."""
        out = np.empty((len(chunks), FILTERS), np.float32)
        at = np.empty((len(chunks), FILTERS), np.int64) if places else None
        last = CHUNK - WIDTH + 1
        for i in range(0, len(chunks), 64):
            block = chunks[i : i + 64]
            total = tables[0].take(block[:, 0:last:STRIDE], axis=0)
            for w in range(1, WIDTH):
                total += tables[w].take(block[:, w : last + w : STRIDE], axis=0)
            if places:
                at[i : i + 64] = total.argmax(axis=1)
            out[i : i + 64] = total.max(axis=1)
        return np.maximum(out + self.b, 0), at

    def features(self, pooled: np.ndarray, document: np.ndarray, count: int) -> np.ndarray:
        """Max and mean of the chunks' values of each document; documents' chunks stand together."""
        out = np.zeros((count, 2 * FILTERS), np.float32)
        if len(pooled):
            first = np.flatnonzero(np.r_[True, document[1:] != document[:-1]])
            who = document[first]
            out[who, :FILTERS] = np.maximum.reduceat(pooled, first, axis=0)
            out[who, FILTERS:] = np.add.reduceat(pooled, first, axis=0) / np.diff(np.r_[first, len(document)])[:, None]
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features.astype(np.float64) @ self.v + self.c, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS) -> list[tuple[int, int, list[bytes]]]:
    """(doc_id, label, chunks) of at most docs_per_class documents of each class, those with the smallest hash.

    Of a document longer than TRAIN_CHUNKS chunks, evenly spaced chunks are taken; so the driver gets a bounded number of bytes.
    """
    prepare(docs.sparkSession)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    picked = [usable.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_per_class) for k in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text in batch.column(2):
                chunks = chunks_of(np.frombuffer(text.as_py() or b"", np.uint8))
                keep = np.unique(np.linspace(0, len(chunks) - 1, min(len(chunks), TRAIN_CHUNKS)).round().astype(int)) if len(chunks) else []
                parts.append([(chunks[k][: np.count_nonzero(chunks[k])] - 1).astype(np.uint8).tobytes() for k in keep])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.binary()))], names=["doc_id", "label", "chunks"])

    joined = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy(F.col("doc_id").cast("long").alias("doc_id"), "label").agg(F.min("text").alias("text"))  # one text for an identifier
    rows = joined.mapInArrow(run, "doc_id long, label int, chunks array<binary>").collect()
    return sorted((r["doc_id"], r["label"], [bytes(c) for c in r["chunks"]]) for r in rows)


def train(rows: list[tuple[int, int, list[bytes]]], epochs: int = EPOCHS) -> Network:
    """Adam on the log loss; classes weigh alike half-way, so that a score stays near a probability."""
    network = Network()
    labels = np.array([label for _, label, _ in rows], np.float32)
    if len(set(labels.tolist())) < 2:
        return network
    encoded = [np.concatenate([chunks_of(np.frombuffer(c, np.uint8))[:1] for c in chunks]) if chunks else np.zeros((0, CHUNK), np.int32) for _, _, chunks in rows]
    rng = np.random.default_rng(SEED)
    # short texts are rare in the sample: every second document also gives a short piece of itself
    for k in range(0, len(rows), 2):
        if rows[k][2]:
            piece = np.frombuffer(rows[k][2][0], np.uint8)
            length = int(rng.integers(16, 160))
            start = int(rng.integers(0, max(1, piece.size - length)))
            encoded.append(chunks_of(piece[start : start + length])[:1])
            labels = np.append(labels, labels[k])
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in network.parameters()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(encoded))
        for i in range(0, len(order), BATCH):
            who = order[i : i + BATCH]
            chunks = np.concatenate([encoded[k] for k in who])
            document = np.repeat(np.arange(len(who)), [len(encoded[k]) for k in who])
            gradients = _gradients(network, chunks, document, labels[who])
            step += 1
            rate = RATE * (1 - epoch / epochs * 0.8)
            for p, g, (m, s) in zip(network.parameters(), gradients, moments):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            network.E[0] = 0
    return network


def _gradients(network: Network, chunks: np.ndarray, document: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss; only the windows that won the pooling matter."""
    pooled, at = network.pooled(chunks, network.tables(), places=True)
    features = network.features(pooled, document, len(labels))
    error = ((network.probability(features) - labels) / len(labels)).astype(np.float32)
    g_v, g_c = features.T @ error, np.array([error.sum()], np.float32)
    counts = np.maximum(np.bincount(document, minlength=len(labels)), 1)[document][:, None]
    best = pooled == features[document, :FILTERS]
    g_pooled = error[document][:, None] * (network.v[:FILTERS] * best + network.v[FILTERS:] / counts) * (pooled > 0)
    g_b = g_pooled.sum(axis=0)
    window = at[:, :, None] * STRIDE + np.arange(WIDTH)
    symbols = chunks[np.arange(len(chunks))[:, None, None], window]
    g_W = np.einsum("nf,nfwe->wef", g_pooled, network.E[symbols])
    g_E = np.zeros_like(network.E)
    np.add.at(g_E, symbols.ravel(), np.einsum("nf,wef->nfwe", g_pooled, network.W).reshape(-1, EMBED))
    return [g_E, g_W.astype(np.float32), g_b, g_v, g_c]


def document_features(network: Network, tables: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Features of a batch's texts; at most GROUP chunks are unfolded at a time, a long text's in several groups."""
    pooled, document = [np.zeros((0, FILTERS), np.float32)], [np.zeros(0, np.int64)]
    group: list[np.ndarray] = []

    def flush() -> None:
        if group:
            pooled.append(network.pooled(np.concatenate(group), tables)[0])
            group.clear()

    for i, text in enumerate(texts):
        data = np.frombuffer(text.as_py() or b"", np.uint8)
        count = chunk_count(data.size)
        document.append(np.full(count, i))
        for first in range(0, count, GROUP):
            some = min(GROUP, count - first)
            group.append(chunks_of(data[first * STEP : (first + some - 1) * STEP + CHUNK]))
            if sum(map(len, group)) >= GROUP:
                flush()
    flush()
    return network.features(np.concatenate(pooled), np.concatenate(document), len(texts))


def score(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables()
        for batch in batches:
            p = network.probability(document_features(network, tables, batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, whose score reaches the threshold."""
    prepare(docs.sparkSession)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables()
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary())
            p = network.probability(document_features(network, tables, texts))
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
