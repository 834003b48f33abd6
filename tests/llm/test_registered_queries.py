"""Every opN query through its table: odd rows, columns whose names clash with the operators' own, and empty tables."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash
from test_corpus_operators import words

from aeroflux.llm import lines, queries, sharding

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_dropped int, shard int, size string, node long, line string, row_id int, component_id string, fp string, score double, segment array<int>, ids long, count long"
LABELS = "doc_id long, quality int, toxic int, score double"
VECTORS = "vec_id long, embedding array<float>, label int, cluster int, rank int, v string"
TURNS = "conv_id long, turn long, role string, text string, position long, legal int"


def documents():
    rng = random.Random(21)
    shared = "One line that many of these documents have in common, number "
    texts = [words(rng, rng.randint(20, 120)) + f"\n{shared}{i}\n" + words(rng, 20) for i in range(24)]
    texts += [texts[0], texts[0], texts[1].replace("a", "b", 1), None, None, "", " \n\t", "w" * 300_000, "x y " * 4000, "é ß \U0001f600", "A.B!c,d"]
    rows = [(i, t, ("en", "fr", None)[i % 3], f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [(None, texts[2], "en", "s1"), (None, None, None, None), rows[3], rows[3]]
    return rows


def tables(spark, path, rows):
    """Tables with these documents, or empty ones."""
    clash = (7, 1, 2, 3, "big", 4, "l", 5, "c", "f", 0.5, [1], 6, 8)
    spark.createDataFrame([(*r, *clash) for r in rows], DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2, 0, 0.1) for i in range(20)] + [(3, 0, 0, 0.1), (None, 1, 0, 0.1), (5, None, None, None)] if rows else []
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    rng = random.Random(5)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(64)], 0, 1, 2, "v") for i in range(60)] + [(100, None, 0, 1, 2, "v"), (None, [1.0] * 64, 0, 1, 2, "v"), (101, [0.0] * 64, 0, 1, 2, "v"), (102, [1.0], 0, 1, 2, "v")]
    spark.createDataFrame(vectors if rows else [], VECTORS).write.parquet(f"{path}/embeddings.parquet")
    turns = [(c, t, ("user", "assistant")[t % 2], f"turn {t}", 1, 2) for c in range(5) for t in range(4)] + [(None, 0, None, None, 1, 2)]
    spark.createDataFrame(turns if rows else [], TURNS).write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd"), documents())


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("none"), [])


COLUMNS = {
    "op1_nearest": ["query_id", "rank", "vec_id", "score"],
    "op2_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_repeats": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op5_near_duplicates": ["doc_id", "fingerprint", "component_id"],
    "op6_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op7_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op8_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op9_quality": ["doc_id", "held_out", "score", "predicted"],
    "op10_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op11_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op12_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op13_clusters": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
}


def crc(text):
    return zlib.crc32(str(text).encode())


def fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check(name, rows, docs):
    """The rows of a query against what its contract says of each document."""
    by_id = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) if "doc_id" in COLUMNS[name] else None
    if name not in ("op10_packing",) and by_id is not None:
        assert by_id == sorted((d[0] is None, d[0] or 0) for d in docs)
    raw = {d[0]: (d[1] or "").encode() for d in docs if d[0] is not None}
    mine = [r for r in rows if by_id is not None and r["doc_id"] is not None]
    if name == "op2_shards":
        assert all(r["size"] == len(raw[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(raw[r["doc_id"]]) and r["law"] == "bytes" and r["grown_shard"] is None for r in mine)
        for shard in {r["shard"] for r in rows}:
            assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    elif name in ("op3_language_id", "op9_quality"):
        mod = (3, 1) if name == "op3_language_id" else (5, 0)
        assert all(r["held_out"] == (crc(r["doc_id"]) % mod[0] == mod[1]) and 0 <= r["score"] <= 1 for r in mine)
        if name == "op3_language_id":
            assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", raw[r["doc_id"]].decode())) for r in mine)
        else:
            assert all(r["predicted"] == (r["score"] >= 0.3) for r in mine)
    elif name == "op4_repeats":
        assert all(r["n_bytes"] == len(raw[r["doc_id"]]) and 0 <= r["n_removed"] <= r["n_bytes"] for r in mine)
        first = min(d[0] for d in docs if d[1] == docs[0][1])
        assert next(r for r in rows if r["doc_id"] == first)["n_removed"] == 0
        assert all(r["kept_sha256"] == hashlib.sha256(raw[r["doc_id"]]).hexdigest() for r in mine if not r["n_removed"])
    elif name == "op5_near_duplicates":
        prints = {d: fingerprint(t.decode()) for d, t in raw.items()}
        assert all(int(r["fingerprint"], 16) == prints[r["doc_id"]] for r in mine)
        root = {d: d for d in prints}
        for _ in range(5):
            for a in prints:
                for b in prints:
                    if (prints[a] ^ prints[b]).bit_count() <= 4:
                        root[a] = root[b] = min(root[a], root[b])
        assert all(r["component_id"] == root[r["doc_id"]] for r in mine)
    elif name == "op6_media":
        for r in mine:
            payload = raw[r["doc_id"]] + b"\0" * (-len(raw[r["doc_id"]]) % 64 if raw[r["doc_id"]] else 64)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw[r["doc_id"]]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    elif name == "op7_mix":
        size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t.decode())) for d, t in raw.items()}
        assert all(r["size"] == size[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"]) for r in mine)
    elif name == "op8_line_dedup":
        assert all(r["n_lines"] == (raw[r["doc_id"]].count(b"\n") + 1 if docs_text(docs, r["doc_id"]) is not None else 0) for r in mine)
        assert sum(r["n_dropped"] > 0 for r in mine if r["doc_id"] < 24) >= 22
        assert all(r["kept_sha256"] == hashlib.sha256(raw[r["doc_id"]]).hexdigest() for r in mine if not r["n_dropped"])
    elif name == "op10_packing":
        assert {r["doc_id"] for r in rows} == {d[0] for d in docs}
        for d in raw:
            parts = sorted({(r["start"], r["length"]) for r in rows if r["doc_id"] == d})
            if sum(x[0] == d for x in docs) == 1:
                assert sum(n for _, n in parts) == next(r["doc_tokens"] for r in rows if r["doc_id"] == d)


def docs_text(docs, doc_id):
    return next(d[1] for d in docs if d[0] == doc_id)


@pytest.mark.parametrize("name", sorted(COLUMNS, key=lambda n: int(n[2:].split("_")[0])))
def test_query_on_odd_and_empty_tables(spark, odd, none, name):
    docs = documents()
    got = queries.QUERIES[name](spark, odd)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    check(name, got.collect(), docs)
    empty = queries.QUERIES[name](spark, none)
    assert empty.columns == got.columns
    assert len(empty.collect()) == (1 if name == "op12_chat" else 0)


def test_all_queries_are_listed():
    assert set(COLUMNS) == set(queries.QUERIES)


def test_line_counts_take_free_names(spark):
    frame = spark.createDataFrame([(1, "a b c", 3, 4)], "n_lines_ long, text string, N_LINES int, n_dropped int")
    out = lines.drop_lines(frame)
    assert out.columns == ["n_lines_", "text", "N_LINES", "n_dropped", "n_lines__", "n_dropped_"]
    assert tuple(out.first()) == (1, "a b c", 3, 4, 1, 0)


def test_shards_keep_groups_and_follow_their_share(spark):
    """Groups up to the share stay whole, larger ones are cut; many leaves on few rows."""
    rng = random.Random(9)
    texts = [words(rng, 30) for _ in range(600)]
    texts += ["small " * 20] * 4 + ["large " * 60] * 200
    frame = spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    total = sum(len(t) + 8 for t in texts)
    for leaves in (8, 60):
        rows = sharding.shard_by_tree(frame, shards=leaves).collect()
        held = {}
        for r in rows:
            held[r["shard"]] = held.get(r["shard"], 0) + r["size"]
        heavy = max(len(t) + 8 for t in texts[:600])
        assert len(rows) == len(texts) and max(held.values()) < total / leaves + 6 * max(heavy, total / leaves / 8)
        of = lambda word: {r["shard"] for r in rows if texts[r["doc_id"]].startswith(word)}
        assert len(of("small")) == (1 if 4 * 128 <= total / leaves / 8 or 4 * 128 <= heavy else len(of("small")))
        assert len(of("large")) > 1
    whole = sharding.shard_by_tree(frame, shards=2, piece_share=1.0).collect()
    assert len({r["shard"] for r in whole if texts[r["doc_id"]].startswith("large")}) == 1
