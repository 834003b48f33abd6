"""The corpus operators as registered queries: opN_<name>(spark, sf_dir) over the whole table, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroflux.llm import ann, centroids, chat, collocations, langid, lines, media, mixing, packing, quality, sharding, simhash, suffix
from aeroflux.llm.common import crc_of_id, table


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries from the learning rows, then every whole text."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of_id() % 3 == 1, F.lit(False))  # a null doc_id isn't held out
    dictionaries = langid.learn(docs.where(~held_out & F.col("lang").isNotNull()))
    return langid.identify(docs, dictionaries).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media_digest(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each text has and loses, and a digest of what stays."""
    kept = lines.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_of_id() % 5 == 0, F.lit(False))  # a null doc_id isn't held out
    network = quality.train(quality.sample(docs, labels.where(~held_out)))
    return quality.score(docs, network).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.with_slots(sharding.shard_by_tree(table(spark, sf_dir, "documents"), shards=24), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays and goes of every text, as counts and a digest of the operator's spans and bytes."""
    kept = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span.e - span.s)
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best_phrases(table(spark, sf_dir, "documents"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are made of control strings, read back from their segments."""
    forged = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(forged)
    whole = chat.formatted(rows).select("conv_id", chat.joined_text(F.col("segments")).alias("text"), chat.loss_text(F.col("segments")).alias("learned"), "valid", "first_bad")
    read = whole.withColumn("turns", chat.read_back(F.col("text")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"), "valid", "first_bad")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_nearest, op2_shards, op3_language_id, op4_repeats, op5_near_duplicates, op6_media, op7_mix, op8_line_dedup, op9_quality, op10_packing, op11_collocations, op12_chat, op13_clusters)}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_nearest": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
  AND NOT list_contains(list_transform(embedding, lambda x: isfinite(x)), false) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score, cast(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS int) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0) WHERE rank <= 20""",
    "op7_mix": r"""
WITH d AS (SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS bigint) AS size, md5('mix:' || coalesce(cast(doc_id AS varchar), 'null')) AS key FROM documents),
s AS (SELECT source, cast(sum(size) AS bigint) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight, source_size * 2e0 AS cap, sum(source_size) OVER () * 1.5e0 AS total FROM s),
l AS (SELECT *, cap / weight AS ratio, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, coalesce(least(cap, max(CASE WHEN level <= ratio THEN level END) OVER () * weight), cap) AS target FROM l),
q AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) AS through FROM d),
p AS (SELECT q.doc_id, q.size, q.key, a.again, (q.through + a.again * t.source_size) / t.target AS finish FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) AS a(again) WHERE q.size > 0),
c AS (SELECT doc_id, count(*) AS times FROM (SELECT doc_id, sum(size) OVER (ORDER BY finish, key, again) AS through FROM p) x WHERE through <= (SELECT sum(target) FROM t) GROUP BY doc_id)
SELECT q.doc_id, q.size, t.source_size, t.target, cast(coalesce(c.times, 0) * q.size AS bigint) AS taken FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON c.doc_id = q.doc_id""",
    "op11_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
g AS (SELECT lang, list_extract(w, i) AS w1, list_extract(w, i + 1) AS w2, list_extract(w, i + 2) AS w3 FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p)),
f1 AS (SELECT lang, w1, count(*)::HUGEINT AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
f2 AS (SELECT lang, w1, w2, count(*)::HUGEINT AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
c2 AS (SELECT x.lang, x.w1 || ' ' || x.w2 AS phrase, x.f AS a, l.f AS l, r.f AS r, 1000000 * x.f * x.f // (l.f * r.f) AS score, 1 AS k FROM f2 x JOIN f1 l USING (lang, w1) JOIN f1 r ON r.lang = x.lang AND r.w1 = x.w2
  LEFT JOIN longer o ON o.lang = x.lang AND o.w1 = x.w1 AND o.w2 = x.w2 WHERE 100 * coalesce(o.most, 0) < 50 * x.f),
c3 AS (SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3 AS phrase, x.f AS a, a.f AS fa, bc.f AS fbc, ab.f AS fab, c.f AS fc FROM f3 x JOIN f1 a ON a.lang = x.lang AND a.w1 = x.w1 JOIN f1 c ON c.lang = x.lang AND c.w1 = x.w3
  JOIN f2 ab ON ab.lang = x.lang AND ab.w1 = x.w1 AND ab.w2 = x.w2 JOIN f2 bc ON bc.lang = x.lang AND bc.w1 = x.w2 AND bc.w2 = x.w3),
cut AS (SELECT * FROM c2 UNION ALL SELECT lang, phrase, a, fa, fbc, 1000000 * a * a // (fa * fbc), 1 FROM c3 UNION ALL SELECT lang, phrase, a, fab, fc, 1000000 * a * a // (fab * fc), 2 FROM c3),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM best JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op12_chat": r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER w AS i, lag(coalesce(role, '')) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
x AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '(<|\[)(s>|/s>|INST\]|/INST\]|ANSWER\]|<SYS>>|</SYS>>|<ROLE>>|</ROLE>>|</TURN>>)', '\1\\\2', 'g') AS safe,
  CASE WHEN i = 1 THEN role IN ('system', 'user') ELSE (before IN ('system', 'assistant') AND role = 'user') OR (before = 'user' AND role = 'assistant') END AS legal,
  CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 14 ELSE NULL END AS marks FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY i)) AS loss_sha256, (3 + sum(length(safe) + marks))::BIGINT AS formatted_chars,
  bool_and(legal) AND arg_max(role, i) = 'assistant' AS valid, min(CASE WHEN NOT legal THEN i END) AS first_bad FROM x GROUP BY conv_id""",
    "op13_clusters": """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: isfinite(x)), false)),
e0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), e) - 1 AS c, e FROM v QUALIFY c < 40),
"""
    + "".join(
        f"""a{n} AS MATERIALIZED (SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.row, k.c, list_sum(list_transform(list_zip(v.e, k.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN e{n} k) GROUP BY row),
"""
        + (
            f"""e{n + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.e, k.e) AS e FROM e{n} k LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e FROM (SELECT a.c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT row, unnest(e) AS x, unnest(range(64)) AS i FROM v) u JOIN a{n} a USING (row) GROUP BY a.c, i) GROUP BY c) m USING (c)),
"""
            if n < 5
            else ""
        )
        for n in range(6)
    )
    + """i AS (SELECT c, sum(d)::BIGINT AS held FROM a5 GROUP BY c)
SELECT v.vec_id, a.c::INT AS cluster, a.d AS distance, i.held AS cluster_inertia, (SELECT sum(held) FROM i)::BIGINT AS inertia, sha256(array_to_string(k.e, ',')) AS centroid_sha256 FROM a5 a JOIN v USING (row) JOIN i ON i.c = a.c JOIN e5 k ON k.c = a.c""",
}
