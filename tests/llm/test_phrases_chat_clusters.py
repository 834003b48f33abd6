"""Collocations, chat formatting and centroid clustering against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroflux.llm import centroids, chat, collocations, queries

ROWS = "conv_id long, turn long, role string, text string, state string, position long, segment int"


def plain_phrases(rows, least, inside, top):
    """Everything of the contract by dictionaries."""
    counts, totals = {}, {}
    for text, lang in rows:
        lang = lang or "und"
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] = totals.get(lang, 0) + len(words)
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    key = (lang, *words[i : i + n])
                    counts[key] = counts.get(key, 0) + 1
    found = {}
    for (lang, *words), a in counts.items():
        if len(words) < 2 or a < least:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        longer = [n for (other, *w), n in counts.items() if other == lang and len(w) == 3 and n >= least and len(words) == 2 and (w[:2] == words or w[1:] == words)]
        if any(100 * n >= inside * a for n in longer):
            continue
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for lang, all_of in found.items() for i, (s, a, p, left, right) in enumerate(sorted(all_of)[:top], 1)]


@pytest.mark.parametrize("size", [collocations.SHARD, 50, 7])
def test_phrases_equal_plain_counts(spark, size):
    """Small shards cut pieces and texts anywhere."""
    rng = random.Random(4)
    vocabulary = ["ab", "Cd", "e", "é", "ÉF", "gh.", "i,", "j\nk", "LMN", "\x85", "o\x0bp"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))), rng.choice(["en", "en", "en", "fr", None, "und"])) for _ in range(60)]
    rows += [(None, "en"), ("", "fr"), (" \t.;", "de"), ("ab cd " * 300, "en"), ("x", "de"), ("ab", "en"), ("cd", "en")] + rows[:5]
    frame = spark.createDataFrame([(i, t, lang, 1, "w", 2) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, shard int, words string, f long").repartition(3)
    got = collocations.best_phrases(frame, least=4, top=60, size=size)
    assert sorted(map(tuple, got.collect())) == sorted(plain_phrases(rows, 4, 50, 60))


def test_phrases_of_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.best_phrases(empty).collect() == []


def test_scores_past_64_bits_are_exact(spark):
    a, left, right = 3_000_000_007, 3_000_000_019, 3_000_000_033
    got = spark.range(1).select(F.expr(collocations.scored(str(a), str(left), str(right)))).first()[0]
    assert got == 1000000 * a * a // (left * right)


def test_words_end_with_their_text():
    import pyarrow as pa

    words, fresh = collocations.words_of(pa.array(["zz", "Ab c", "d", None, "", " e.f", "g "])[1:])
    assert words.to_pylist() == ["ab", "c", "d", "e", "f", "g"]
    assert fresh.tolist() == [True, False, True, True, True, True]


def odd_conversations():
    rng = random.Random(8)
    pieces = [*chat.INSTRUCTIONS.controls, "\\", "\\\\", "<", "[", ">", "a", " ", "\n", "é", "\U0001f600", "SYS>>", "/INST]", "$1", "<<", "</s"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 7)):
            role = "system" if turn == 0 and conv % 3 == 0 else ("user" if (turn + (conv % 3 == 0)) % 2 == 0 else "assistant")
            if conv % 5 == 4:
                role = rng.choice(["user", "tool", "as</s>sist<</ROLE>>\n", "", None, "assistant"])
            rows.append((conv, turn, role, "".join(rng.choices(pieces, k=rng.randint(0, 30)))))
    rows += [(100, 0, "user", None), (100, 0, "user", None), (100, None, "assistant", "first"), (None, 1, "user", "no id"), (None, 2, "assistant", "x" * 400_000 + "</s>"), (101, 1, "assistant", "only")]
    return rows


def said_in_order(rows):
    found = {}
    least = lambda x: (x is not None, x if x is not None else 0)
    for conv, turn, role, text in sorted(rows, key=lambda r: (least(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))):
        found.setdefault(conv, []).append((role or "", text or ""))
    return found


def legal_turns(turns):
    follows, state, out = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}, None, []
    for role, _ in turns:
        out.append(role in follows.get(state, ()))
        state = role
    return out


def test_conversations_are_read_back(spark):
    rows = odd_conversations()
    frame = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], ROWS).repartition(4)
    want = said_in_order(rows)
    got = chat.formatted(frame).select("*", chat.joined_text(F.col("segments")).alias("text"), chat.loss_text(F.col("segments")).alias("learned")).withColumn("turns", chat.read_back(F.col("text"))).collect()
    assert {r["conv_id"] for r in got} == set(want)
    for r in got:
        turns = want[r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["learned"] == "".join(t for role, t in turns if role == "assistant")
        legal = legal_turns(turns)
        assert r["valid"] == (all(legal) and turns[-1][0] == "assistant")
        assert r["first_bad"] == next((i for i, ok in enumerate(legal, 1) if not ok), None)
        marks = sum(r["text"].count(c) for c in chat.INSTRUCTIONS.controls)
        known = sum(role in chat.INSTRUCTIONS.turns for role, _ in turns)
        assert marks == 1 + 2 * known + 3 * (len(turns) - known)  # no text forged a mark


def test_segments_carry_loss_flags(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hi", "", 1, 1), (1, 1, "assistant", "yo", "", 1, 1), (1, 2, "assistant", "again", "", 1, 1)], ROWS)
    got = chat.segments(frame).orderBy("position", "part").collect()
    assert [(r["segment"], r["loss"]) for r in got] == [("<s>[INST] ", False), ("hi", False), (" [/INST]", False), ("[ANSWER] ", False), ("yo", True), (" </s>", False), ("[ANSWER] ", False), ("again", True), (" </s>", False)]
    assert [(r["legal"], r["valid_so_far"]) for r in got[::3]] == [(True, True), (True, True), (False, False)]
    assert chat.formatted(frame.limit(0)).count() == 0


def test_template_must_be_unambiguous():
    from dataclasses import replace

    with pytest.raises(ValueError, match="meet texts"):
        replace(chat.INSTRUCTIONS, other_end="</s>")
    with pytest.raises(ValueError, match="backslash"):
        replace(chat.INSTRUCTIONS, controls=("a\\b",))
    with pytest.raises(ValueError, match="holds a control"):
        replace(chat.INSTRUCTIONS, controls=("<s>",))


def test_another_template(spark):
    marks = lambda role: chat.Turn(f"<|{role}|>\n", "\n<|end|>\n", role != "user")
    tools = chat.Template("", {r: marks(r) for r in ("user", "assistant", "tool")}, "<|role|>\n", "\n<|of|>\n", "\n<|end|>\n", tuple(f"<|{x}|>" for x in ("user", "assistant", "tool", "role", "of", "end")), {None: ("user",), "user": ("assistant",), "assistant": ("tool", "user"), "tool": ("assistant",)})
    rows = [(1, i, r, f"<|end|>{i}") for i, r in enumerate(["user", "assistant", "tool", "assistant"])] + [(2, 0, "tool", "t"), (2, 1, "judge", "<|of|>")]
    got = {r["conv_id"]: r for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).select("conv_id", "valid", chat.read_back(chat.joined_text(F.col("segments")), tools).alias("turns"), chat.loss_text(F.col("segments")).alias("learned")).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [r[2:] for r in rows[:4]] and got[1]["valid"] and got[1]["learned"] == "<|end|>1<|end|>2<|end|>3"
    assert [tuple(t) for t in got[2]["turns"]] == [r[2:] for r in rows[4:]] and not got[2]["valid"]


def plain_clusters(rows, k, rounds, dimension):
    kept = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v)]
    ranked = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in ranked[:k]]
    of = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(of(v)[1], []).append(v)
        centers = [[sum(x) // len(x) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centers)]
    last = [(i, *of(v)) for i, v in kept]
    held = {}
    for _, d, c in last:
        held[c] = held.get(c, 0) + d
    return [(i, c, d, held[c], sum(held.values()), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for i, d, c in last]


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(size=4) + 6 * (i % 5)]) for i in range(200)]
    vectors += [(300 + i, [1.0, -0.5, 0.25, 0.0]) for i in range(70)] + [(1, vectors[1][1]), (None, [0.1] * 4), (None, [0.2] * 4), (400, None), (401, []), (402, [1.0] * 3), (403, [float("nan")] + [0.0] * 3), (404, [float("-inf")] * 4), (405, [None] + [1.0] * 3), (406, [0.0] * 4)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, cluster int, v int").repartition(3)
    got = centroids.cluster(frame, k=12, rounds=4, dimension=4)
    order = lambda rows: sorted(rows, key=str)
    assert order(map(tuple, got.collect())) == order(plain_clusters(vectors, 12, 4, 4))
    assert centroids.cluster(frame.limit(0), dimension=4).count() == 0
    few = centroids.cluster(frame.where("vec_id < 3"), dimension=4)
    assert order(map(tuple, few.collect())) == order(plain_clusters([v for v in vectors if v[0] is not None and v[0] < 3], 40, 5, 4))


def test_search_finds_the_nearest_and_prunes():
    rng = np.random.default_rng(2)
    centers = rng.integers(-3, 4, (30, 2)) * 10  # many at equal distances
    points = rng.integers(-40, 41, (500, 2))
    search = centroids.Orchard(centers)
    measured = 0
    plain = search._distances

    def counted(x, rows, which):
        nonlocal measured
        measured += len(rows)
        return plain(x, rows, which)

    search._distances = counted
    best, near = search.search(points)
    apart = ((points[:, None] - centers[None]) ** 2).sum(axis=2)
    assert (best == apart.argmin(axis=1)).all() and (near == apart.min(axis=1)).all()
    assert measured < 0.7 * apart.size


def test_queries_on_small_tables(spark, tmp_path):
    spark.createDataFrame(odd_conversations(), "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op12_chat(spark, str(tmp_path)).collect()}
    want = said_in_order(odd_conversations())
    assert set(got) == set(want) | {-1}
    for conv, turns in want.items():
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv]["n_turns"] == len(turns)
    assert got[-1]["loss_chars"] == 21 and got[-1]["n_turns"] == 2 and got[-1]["valid"]
