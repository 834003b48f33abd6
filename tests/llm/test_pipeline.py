"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from test_corpus_operators import words


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(11)
    good = [(i, words(rng, 120) + "\nShared line of all the pages here, number %d\n" % i + words(rng, 100), "en", f"s{i % 4}", 0) for i in range(60)]
    junk = [(100 + i, " ".join(w.upper() + "!!" for w in words(rng, 80).split()), "en", "s0", 0) for i in range(30)]
    near = []
    for k in range(5):
        parts = good[k][1].split(" ")
        parts[40] = "changed"
        near.append((200 + k, " ".join(parts), "en", "s1", 0))
    copies = [(300 + k, good[7][1], "en", "s2", 0) for k in range(4)]
    docs = spark.createDataFrame(good + junk + near + copies, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {}
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        kept[name] = frame.collect()
        if name != "packing":
            assert frame.columns == corpus_pipeline.COLUMNS
    ids = {name: {r["doc_id"] for r in rows} for name, rows in kept.items()}
    assert len(ids["quality"] & set(range(60))) >= 59 and len(ids["quality"] & set(range(100, 130))) <= 1
    assert not any("Shared line" in r["text"] for r in kept["line_dedup"]) and ids["line_dedup"] == ids["quality"]
    assert ids["near_dedup"] == {i for i in ids["quality"] if i < 200}
    assert ids["mixing"] <= ids["near_dedup"] and ids["packing"] == ids["mixing"]
    words_in = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert abs(words_in(kept["mixing"]) - 1.5 * words_in(kept["near_dedup"])) < 0.05 * words_in(kept["mixing"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.select("doc_id").distinct().count() == len(ids["packing"])


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, repeated rows and an empty table go through every stage."""
    rng = random.Random(3)
    text = words(rng, 80)
    rows = [(1, text, "en", "a", 0), (1, text, "en", "a", 0), (1, words(rng, 50), "en", "a", 0), (None, words(rng, 60), None, None, None), (2, None, "en", "b", 0), (3, "", "fr", "b", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, table in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(table, schema)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert (out.count() > 0) == bool(table), name
    mixed = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, schema), "")
    assert mixed.where("doc_id = 1 AND text = '%s'" % text).count() <= 4
    once = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, schema), "")
    assert {r["text"] for r in once.where("doc_id = 1").collect()} == {text, rows[2][1]} and once.count() == 4  # different texts of one doc_id stay; null and empty texts are one group
