"""Line templates: documents that share a passage differ, and templates of one leaf equal brute force."""

import random

from test_corpus_operators import words

from aeroflux.llm import lines, wording


def test_documents_that_share_a_passage_differ(spark):
    """The recurring line is half of each of 12 unrelated documents."""
    rng = random.Random(12)
    passage = words(rng, 60)
    rows = [(i, passage + "\n" + words(rng, 60)) for i in range(12)]
    copied = words(rng, 80)
    rows += [(100 + i, copied + "\nending %s" % words(rng, 3)) for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == rows[i][1].split("\n")[1] for i in range(12))
    assert all(got[100 + i].startswith(copied) for i in range(6))


def alike(a, b):
    a, b = a.split(), b.split()
    return len(a) == len(b) and a[:3] == b[:3] and sum(x != y for x, y in zip(a, b)) <= int(len(a) * lines.VARIABLE)


def test_templates_of_one_leaf_equal_brute_force(spark):
    """Two templates begin with the same words; one leaf holds most lines and is dealt to pairs of chunks."""
    rng = random.Random(5)
    often = "user was seen {} at the gate of north town"
    rare = "user was seen {} with papers from {} in work"
    texts = [often.format(words(rng, 1)) for _ in range(30)] + [rare.format(words(rng, 1), words(rng, 1)) for _ in range(8)]
    texts += ["user was seen " + words(rng, 7, "ab") for _ in range(120)] + ["other line " + words(rng, 9) for _ in range(20)]
    texts = sorted(set(texts))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if alike(texts[i], texts[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    size = {i: sum(find(j) == find(i) for j in range(len(texts))) for i in range(len(texts))}
    frame = spark.createDataFrame([(i, words(rng, 30, "klmnop") + "\n" + t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_dropped"] for r in lines.drop_lines(frame).collect()}
    assert {i for i in got if got[i]} == {i for i in size if size[i] >= lines.MIN_DOCS}
    assert sum(got.values()) >= 38
    _, _, hashes = lines.line_hashes([t.encode() for t in texts])
    hashes = hashes.tolist()
    distinct = lines.parsed(frame).where("line IS NOT NULL").dropDuplicates(["line"]).select("line", "leaf", "data")
    for chunk in (4096, 10):  # the second forces pairs of chunks
        top = {r["line"]: r["template"] for r in lines.templates(distinct, chunk=chunk).collect()}
        of = [top.get(h, h) for h in hashes]
        assert all((of[i] == of[j]) == (find(i) == find(j)) for i in range(len(texts)) for j in range(i))


def test_words_that_agree_in_sixteen_bits_are_different(spark):
    """Lines of ten words, two of which may vary, differ in three places; two words of one place agree in the upper 16 bits of their hashes."""
    rng = random.Random(31)
    seen, pair = {}, None
    while pair is None:
        some = [words(rng, 1) for _ in range(2000)]
        hashes = wording.Words([" ".join(some).encode()], exact=True).exact.tolist()
        for word, value in zip(some, hashes):
            other = seen.setdefault(value >> 48, word)
            if other != word:
                pair = pair or (other, word)
    start = "the same three words that all share "
    lines_of = [start + "%s %s %s" % x for x in (("aa", "ab", pair[0]), ("ba", "bb", pair[1]))]
    frame = spark.createDataFrame([(k, words(rng, 30) + "\n" + lines_of[k % 2]) for k in range(6)], "doc_id long, text string")
    assert all(r["n_dropped"] == 0 for r in lines.drop_lines(frame).collect())
    apart = lines.templates(lines.parsed(frame).where("line IS NOT NULL").dropDuplicates(["line"]).select("line", "leaf", "data"))
    assert apart.groupBy("template").count().where("count > 1").count() == 0
