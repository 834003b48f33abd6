"""Near copies by five-word shingles: verified links, rows without doc_id, recall."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_corpus_operators import words

from aeroflux.llm import nearcopies, simhash

SCHEMA = "doc_id long, text string, near_key long"


def changed(rng, text, runs):
    """text with whole runs of words replaced: each takes its shingles with it."""
    parts = text.split()
    for at, n in runs:
        parts[at : at + n] = words(rng, n).split()
    return " ".join(parts)


def plain_groups(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a and len(a & sets[j]) >= 0.8 * len(a | sets[j])):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_groups_equal_brute_force(spark):
    """Similarities from 0.6 to 1, chains, short texts, and a family in which all share much."""
    rng = random.Random(4)
    texts = [None, "", " \t", "one two three four five six", "one two three four five seven", "just two"]
    for k in range(60):
        base = words(rng, 104)
        texts += [base, changed(rng, base, [(0, 5 + k % 20)])]
    texts += [changed(rng, texts[-1], [(10 * k, 4)]) for k in range(8)]
    family = words(rng, 80)
    texts += [family + " " + words(rng, 15 + k) for k in range(20)]
    want = plain_groups(texts)
    assert len(set(want)) > 20
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    first = {}
    for r in sorted(nearcopies.with_groups(frame).collect(), key=lambda r: r["doc_id"]):
        assert want[r["doc_id"]] == first.setdefault(r["near_group"], r["doc_id"])
    kept = {r["doc_id"] for r in nearcopies.keep_one(frame).collect()}
    assert kept == set(want)
    assert nearcopies.keep_one(frame.limit(0)).count() == 0


def test_recall_at_the_least_similarity():
    rng = np.random.default_rng(2)
    shared = []
    for _ in range(400):
        all_of = rng.integers(0, 1 << 63, 100, dtype=np.uint64) * np.uint64(2)
        a, b = np.sort(all_of[:90]), np.sort(all_of[10:])
        assert nearcopies.alike(a, b) and not nearcopies.alike(a, np.sort(all_of[11:]))
        _, keys = nearcopies.band_keys(np.r_[a, b], np.array([0, 90, 180]))
        shared.append((keys[0] == keys[1]).sum())
    assert sum(n == 0 for n in shared) <= 1  # 3.5e-4 of them at this similarity
    assert abs(np.mean(shared) / (nearcopies.BANDS * 0.8**nearcopies.ROWS) - 1) < 0.1


def test_rows_without_or_with_equal_ids_stay_apart(spark):
    rng = random.Random(9)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(None, a, 0), (None, b, 0), (1, a + " x", 0), (2, b + " x", 0), (3, c, 0), (3, d, 0), (4, c + " x", 0), (5, d + " x", 0), (None, words(rng, 60), 0), (None, words(rng, 60), 0)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(2)
    kept = [r["text"] for r in nearcopies.keep_one(frame).collect()]
    assert sorted(kept) == sorted([a + " x", b + " x", c, d, rows[8][1], rows[9][1]])
    # op5: unrelated fingerprints are not linked through a missing or shared doc_id
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(frame.union(frame.select((F.col("doc_id") + 10).alias("doc_id"), "text", "near_key"))).collect() if r["doc_id"] is not None}
    assert found[11] == 1 and found[12] == 2 and found[1] != found[2]
