"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern of the contracts: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and about 8 MB, so that a Python worker holds a few MB of text at once.

    These are settings of the session; other queries of it only get smaller batches by them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def parts_of_shuffle(df: DataFrame) -> int:
    """Partitions for an exchange that is asked for by number: the session setting, which is sized to the cluster and its data."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; only where none is set (tests on one machine) a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: as a checkpoint, but in compressed columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the identifier written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
