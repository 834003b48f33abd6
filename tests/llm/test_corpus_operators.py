"""Every corpus operator against a plain, brute-force version on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from aeroflux.llm import ann, langid, lines, media, mixing, packing, quality, sharding, simhash, suffix, wording

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, row_id long"


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(n))


def corpus(seed=1, n=40):
    """Texts with copies, near copies, shared passages, empty and long ones; extra columns clash with the operators' own names."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(5, 90)) for _ in range(n)]
    passage = words(rng, 60)
    texts = [*base, base[0], base[0], base[1], base[2].replace("a", "b", 1), passage + " " + base[3], base[4] + "\n" + passage, None, "", " \t ", "é" * 70 + passage, words(rng, 3000), "ab" * 400, "x"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 0, -1, -1, -1) for i, t in enumerate(texts)]
    return [*rows, rows[1], rows[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ann_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 12)).astype(np.float32)
    vectors[100:140] = vectors[7]  # ties
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1001, [0.0] * 12, 1), (1002, [float("nan")] + [1.0] * 11, 1), (1003, [None] + [1.0] * 11, 1), (None, [1.0] * 12, 1), (1004, [1.0] * 5, 1), rows[3]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = ann.nearest(frame, frame.where("vec_id % 20 = 0"), 5, query_block=8, candidate_block=50).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 300, 20))
    v = vectors.astype(float)
    for q, found in by.items():
        scores = np.zeros(300)
        for k in range(12):
            scores += v[q, k] * v[:, k]
        order = [i for i in np.lexsort((np.arange(300), -scores)) if i != q][:5]
        assert [x[1] for x in sorted(found)] == order
        assert [x[2] for x in sorted(found)] == [scores[i] for i in order]
    assert ann.nearest(frame.limit(0), frame.limit(0), 5).count() == 0


def test_ann_of_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(60, 4)) * np.where(np.arange(60) % 3 == 0, 1e150, 1e-150)[:, None]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(frame, frame.where("vec_id % 20 = 0"), 6, query_block=2, candidate_block=16).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in (0, 20, 40):
        scores = sorted(((-sum(float(a) * float(b) for a, b in zip(vectors[q], v)), i) for i, v in enumerate(vectors) if i != q))
        assert [got[q][k] for k in range(1, 7)] == [i for _, i in scores[:6]]


def test_equal_texts_stay_together(spark):
    """Groups of equal texts are cut only where they outweigh a leaf's share and the largest row."""
    rng = random.Random(8)
    rows = [(i, words(rng, 30), "en", f"s{i % 3}") for i in range(400)]
    rows += [(1000 + i, rows[i % 40][1], "fr", "s9") for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    shard = {r["doc_id"]: r["shard"] for r in sharding.shard_by_tree(frame, shards=12).collect()}
    assert all(shard[1000 + i] == shard[i % 40] for i in range(80))
    assert len(set(shard.values())) == 12


def test_shards_are_near_equal_and_whole(docs, empty):
    rows = sharding.with_slots(sharding.shard_by_tree(docs, shards=4), 4).collect()
    source = corpus()
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in source)
    want = sorted((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in source)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    totals = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(4)]
    assert max(totals) - min(totals) <= max(r["size"] for r in rows)
    for k in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))
    assert sharding.with_slots(sharding.shard_by_tree(empty, shards=4), 4).count() == 0


def test_a_hot_text_is_dealt_to_shards(spark):
    rows = [(i, "same text", "en", "s", 0, 0, 0, 0) for i in range(3000)] + [(5000 + i, f"text {i}", "en", "s", 0, 0, 0, 0) for i in range(1000)]
    out = sharding.shard_by_tree(spark.createDataFrame(rows, SCHEMA), shards=6).groupBy("shard").agg(F.sum("size").alias("size")).collect()
    sizes = [r["size"] for r in out]
    assert len(sizes) == 6 and max(sizes) < 1.06 * sum(sizes) / 6


def test_language_by_compression(spark):
    rng = random.Random(5)
    pools = {lang: words(rng, 60, letters).split() for lang, letters in (("en", "abcdemn"), ("fr", "fghijab"), ("de", "klmnoab"))}
    rows = [(i, " ".join(rng.choices(pools[lang], k=40)), lang) for i, lang in enumerate(["en", "fr", "de", "en"] * 30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.learn(frame.where("doc_id % 3 <> 1 OR doc_id > 60"))
    assert set(learned) == {"en", "fr", "de"}
    odd = spark.createDataFrame([(900, None, "en"), (901, "", "en"), (902, "123 !!", "en"), (903, " ".join(rng.choices(pools["fr"], k=4000)), None)], frame.schema)
    got = {r["doc_id"]: r for r in langid.identify(frame.union(odd), learned).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows) >= 0.98 * len(rows)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "fr"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(frame, {}).collect()} == {"und"}


def removed(rows, length):
    """Brute force: bytes covered by a string that also starts earlier."""
    texts = sorted({(-(1 << 63) if i is None else i, xx, t) for i, xx, t in rows})
    seen, out = set(), {}
    for i, tie, t in texts:
        mask = np.zeros(len(t), bool)
        fresh = []
        for o in range(len(t) - length + 1):
            s = t[o : o + length]
            if s in seen:
                mask[o : o + length] = True
            else:
                seen.add(s)
                fresh.append(s)
        out[i, tie] = mask
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    frame = spark.createDataFrame(corpus(seed), SCHEMA).repartition(4)
    ties = {r["doc_id"]: r["tie"] for r in suffix.keyed(frame).collect()}
    source = {r[0]: (r[1] or "").encode() for r in corpus(seed)}
    want = removed([(i, ties[i], t) for i, t in source.items()], suffix.LENGTH)
    for r in suffix.remove_repeats(frame).collect():
        text, mask = source[r["doc_id"]], want[r["doc_id"], ties[r["doc_id"]]]
        edges = np.diff(np.r_[0, mask.astype(int), 0])
        assert [(s["s"], s["e"]) for s in r["spans"] or []] == list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
        assert bytes(r["kept"]) == bytes(np.frombuffer(text, np.uint8)[~mask])


def test_a_hot_hash_is_still_exact(spark, monkeypatch):
    rng = random.Random(9)
    passage = words(rng, 40)
    rows = [(i, words(rng, 12) + " " + passage + " " + words(rng, 12)) for i in range(60)]
    monkeypatch.setattr(suffix, "HOT", 5)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ties = {r["doc_id"]: r["tie"] for r in suffix.keyed(frame).collect()}
    want = removed([(i, ties[i], t.encode()) for i, t in rows], suffix.LENGTH)
    got = {r["doc_id"]: sum(s["e"] - s["s"] for s in r["spans"]) for r in suffix.remove_repeats(frame).collect()}
    assert got == {i: int(mask.sum()) for (i, _), mask in want.items()}


def test_construction_orders_all_suffixes():
    rng = random.Random(4)
    for _ in range(60):
        length = rng.choice([2, 4, 6])
        strings = [bytes(rng.choices(b"ab", k=rng.randint(length, length + 9))) for _ in range(rng.randint(1, 9))]
        owner, offset, group = suffix.construct(strings, length)
        found = {}
        for o, f, g in zip(owner.tolist(), offset.tolist(), group.tolist()):
            found.setdefault(strings[o][f : f + length], set()).add(g)
        assert len(owner) == sum(len(s) - length + 1 for s in strings)
        assert all(len(g) == 1 for g in found.values()) and len({min(g) for g in found.values()}) == len(found)


def plain_fingerprint(text, n=4):
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_near_duplicates_equal_brute_force(docs, empty):
    source = corpus()
    prints = {r[0]: plain_fingerprint(r[1]) for r in source}
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(source)
    for r in got:
        assert int.from_bytes(r["fp"], "big") == prints[r["doc_id"]]
        assert r["component_id"] == find(r["doc_id"])
    assert simhash.near_groups(empty).count() == 0


def test_bit_sliced_links_lose_nothing(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 25, dtype=np.uint64)
    fps = set(base.tolist())
    for _ in range(800):  # chains around the bases, and one large group
        x = int(rng.choice(base[:3])) if rng.random() < 0.5 else int(rng.choice(list(fps)[:40]))
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, x.to_bytes(8, "big")) for i, x in enumerate(fps)], "node long, fp binary")
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    for group in (1 << 14, 40):  # the second bound forces pairs of chunks
        for blocks in (None, 6):
            tables = simhash.exact_tables(len(fps)) if blocks is None else simhash.exact_tables(1 << 40)
            edges = simhash.links(nodes, tables, 4, group)
            assert group < 1000 or edges.count() <= len(tables) * len(fps)
            got = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
            assert got == {r["node"]: r["component"] for r in simhash.components(edges, rows=3).collect()}  # in rounds
            assert all(got.get(i, i) == find(i) for i in range(len(fps)))


def test_media_forms_and_round_trips(spark):
    grey = bytes(range(12))
    assert media.decode(b"P5\n# c\n4 3\n255\n" + grey)[:, :, 0].tobytes() == grey
    assert media.decode(b"P2 4 3 255\n" + b" ".join(b"%d" % x for x in grey)).tobytes() == grey
    assert media.decode(b"P6 2 1 255\n" + grey[:6]).shape == (1, 2, 3)
    assert media.decode(b"P4 3 1\n" + bytes([0b10100000])).ravel().tolist() == [0, 255, 0]
    assert media.decode(b"P1 3 1\n1 0 1").ravel().tolist() == [0, 255, 0]
    head = b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    bmp = head + bytes([1, 2, 3, 4, 5, 6, 0, 0]) + bytes([7, 8, 9, 10, 11, 12, 0, 0])
    assert media.decode(bmp).tolist() == [[[9, 8, 7], [12, 11, 10]], [[3, 2, 1], [6, 5, 4]]]
    image = np.random.default_rng(0).integers(0, 255, (30, 20)).astype(float)
    assert np.allclose(media.area_resize(image, 6, 5), image.reshape(6, 5, 5, 4).mean(axis=(1, 3)))
    assert media.area_resize(image, 7, 9).mean() == pytest.approx(image.mean())
    tall = np.random.default_rng(1).integers(0, 255, (2500, 64, 1)).astype(np.uint8)
    assert (media.from_tiles(media.to_tiles(tall), *tall.shape) == tall).all()
    frame = spark.createDataFrame([(1, None), (2, b""), (3, b"P5 2 2 255\n1"), (4, b"P5\n2 2\n255\n" + bytes(4))], "id long, media binary")
    got = {r["id"]: r for r in media.media_columns(frame, "id", "media").collect()}
    assert got[1]["error"] and got[2]["error"] and got[3]["error"] and got[4]["error"] is None and got[4]["width"] == 2
    assert np.load(io.BytesIO(bytes(got[4]["tiles"][0]["npy"]))).shape == (2, 2, 1)


def test_broken_media_give_a_reason():
    for broken in (b"P2 1 1 255 12345678901234567890123", b"P5 99999999999 99999999999 255 ", b"P2 1 1 255 -5", b"P2 1 1 100 101", b"P5 1 1 0 a", b"P1 1 1 7", b"BM"):
        got = media.describe(broken)
        assert got["error"] and got["tiles"] is None, broken
    wide = media.describe(b"P5 2 2 65535\n" + (np.array([300, 300, 300, 300], ">u2")).tobytes(), side=1)
    assert np.lib.format.read_array(io.BytesIO(wide["thumbnail"])).tolist() == [[1]]


def test_text_media_digest(docs):
    source = {r[0]: (r[1] or "").encode() for r in corpus()}
    for r in media.text_media_digest(docs).collect():
        text = source[r["doc_id"]]
        payload = text + bytes(-len(text) % 64 if text else 64)
        assert r["n_bytes"] == len(text) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])


def test_mix_equals_a_plain_queue(docs, empty):
    source = corpus()
    sizes = {}
    for r in source:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, share, target = 1.5 * sum(sizes.values()), dict(weight), {}
    while share:  # excess of full sources goes to the others by weight
        level = left / sum(share.values())
        full = [s for s in share if level * weight[s] > 2 * sizes[s]]
        if not full:
            target |= {s: level * w for s, w in share.items()}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            del share[s]
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(source)
    taken = {}
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    longest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - target[s]) <= longest for s in taken)
    assert sum(taken.values()) <= sum(target.values()) + 1e-6
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).select("doc_id", "size", "taken").collect())) == sorted((r["doc_id"], r["size"], r["taken"]) for r in rows)
    assert mixing.mix(empty).count() == 0


def test_line_templates(spark):
    rng = random.Random(6)
    rows = []
    for i in range(12):
        own = [words(rng, 12) for _ in range(3)]
        rows.append((i, "\n".join([own[0], f"Request {i} took {i * 7} ms on host h{i}", own[1], "Copyright by the makers of this page, all of it", "", own[2]])))
    rows += [(100 + k, rows[0][1] + "\nan own ending") for k in range(30)]  # copies of one document don't make its lines boilerplate
    rows += [(200, None), (201, ""), (202, words(rng, 2000))]
    rows.append(rows[3])
    frame = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, line long").repartition(3)
    for broadcast in (lines.BROADCAST, 0):  # sent to tasks, or joined
        got = {}
        for r in lines.drop_lines(frame, broadcast=broadcast).collect():
            got.setdefault(r["doc_id"], r)
        for i in range(12):
            kept = rows[i][1].split("\n")
            assert got[i]["text"] == "\n".join([kept[0], kept[2], kept[4], kept[5]]), i
            assert got[i]["n_dropped"] == 2 and got[i]["n_lines"] == 6
        assert got[105]["text"].endswith("an own ending") and got[105]["n_dropped"] == 2
        assert got[200]["text"] is None and got[201]["text"] == "" and got[202]["text"] == rows[-2][1]
    assert lines.drop_lines(frame.limit(0)).count() == 0


def test_template_generalises_variable_places():
    leaf = [(k, {k}, np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 100 + k], wording.CODE).tobytes()) for k in range(6)]
    assert sorted(lines.recurring(leaf)) == list(range(6))
    assert lines.recurring([(line, {0}, codes) for line, _, codes in leaf]) == []
    apart = [(k, {k}, np.arange(10 * k, 10 * k + 10).astype(wording.CODE).tobytes()) for k in range(6)]
    assert lines.recurring(apart) == [] and lines.recurring([]) == []


def test_quality_learns_and_scores_all(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 60) if i % 4 else " ".join(w.upper() + "!!" for w in words(rng, 50).split()), int(i % 4 > 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t, q) for i, t, q in rows] + [(900, None, 1), (901, "", 1), (902, words(rng, 5000), 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 180] + [(None, 1), (5, None)], "doc_id long, quality int")
    network = quality.train(quality.sample(docs, labels, 60), epochs=8)
    got = {r["doc_id"]: r for r in quality.score(docs, network).collect()}
    assert len(got) == 243 and all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[i]["predicted"] == q for i, _, q in rows[180:]) >= 57
    assert {r["doc_id"] for r in quality.keep(docs, network).collect()} == {i for i, r in got.items() if r["predicted"]}
    flat = quality.train([])
    assert {r["score"] for r in quality.score(docs, flat).collect()} == {0.5}


def test_quality_chunks_cover_everything():
    for n in (1, 63, 64, 1023, 1024, 1025, 1984, 1985, 5000):
        data = np.arange(n) % 250
        chunks = quality.chunks_of(data.astype(np.uint8))
        seen = np.zeros(n, bool)
        for k, c in enumerate(chunks):
            at = np.arange(len(c)) + k * quality.STEP
            inside = at < n
            assert (c[inside] == data[at[inside]] + 1).all() and (c[~inside] == 0).all()
            seen[at[inside]] = True
        assert seen.all()


def test_packing_is_a_partition_of_all_tokens(docs, empty):
    encode = packing.Encoder()
    source = {r[0]: encode(r[1]) for r in corpus()}
    rows = packing.pack(docs).collect()
    assert sum(r["length"] for r in rows) == sum(len(encode(r[1])) for r in corpus())
    for r in rows:
        ids = source[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and math.log2(at).is_integer()
    assert packing.pack(empty).count() == 0


def test_ids_equal_the_tokenizers_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.Encoder()
    rng = random.Random(1)
    texts = ["", " ", "it's  two\n\nlines\t", "ÀÉ ñ 漢字 😀 123,456", words(rng, 300), "a" * 3000, "a<|endoftext|>b <|endoftext|><|endoftext|>", words(rng, 40) + "<|endoftext|>" + words(rng, 40)]
    for t in texts:
        assert encode(t)[:-1].tolist() == whole.encode(t, add_special_tokens=False).ids
    long = words(rng, 300) * 5
    joined = [i for part in packing.parts_of(long, 100) for i in encode(part)[:-1].tolist()]
    assert joined == encode(long)[:-1].tolist()
