"""Five-stage corpus pipeline over ``documents``: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroflux.llm import lines, mixing, nearcopies, packing, quality
from aeroflux.llm.common import checkpoint, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not reject; null ids and repeated rows are judged by their texts like others."""
    network = quality.train(quality.sample(docs, table(spark, sf_dir, "labels")))
    return quality.keep(docs, network).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines whose template recurs across documents; a text may end empty, a null text stays null."""
    return lines.drop_lines(docs).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest (doc_id, hash of the text), null last; rows without a word are one group."""
    return nearcopies.keep_one(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows of the same doc_id and text stand for each other."""
    keys = ["id_key", "text_key"]
    keyed = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id_key"), F.xxhash64("text").alias("text_key"))
    times = mixing.mix(keyed, carry=tuple(keys)).groupBy(*keys).agg(F.sum("times").cast("int").alias("times")).where(F.col("times") > 0)
    # of rows alike in both, the one whose other columns sort first
    first = keyed.groupBy(*keys).agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("row")).select(*keys, "row.*")
    taken = first.join(times, keys)
    return taken.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
