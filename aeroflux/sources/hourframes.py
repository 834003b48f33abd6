"""Files of gridded hours as a Spark data source, `hourframes`: each file holds so many steps of one domain.

Writing is a job with a commit protocol. Tasks write into a folder of their job below `_pending`; what a task has finished is told to the driver, which moves those files to their names, writes the manifest anew, and removes the job's folder with whatever lost or repeated attempts left there. If the job fails, its folder goes and nothing else has changed. Readers see the manifest's files only, so a driver that dies between two moves leaves nothing visible either.

Paths are any that Arrow's file systems open (a folder that all executors share, or a store's URI).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "_manifest.json"
#: The column that names a row's file.
FILE = "file"
SCHEMA = "file string, grid string, hour_ts timestamp, layer int, row int, col int, pollutant string, prefix string, value double, unit string"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def read_manifest(path: str) -> dict[str, int]:
    """Rows of each visible file."""
    store, root = opened(path)
    if store.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.NotFound:
        return {}
    with store.open_input_stream(f"{root}/{MANIFEST}") as stream:
        return json.loads(stream.read())


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has finished: name, place in the job's folder, rows."""

    files: list[tuple[str, str, int]]


@dataclass
class OneFile(InputPartition):
    name: str


class FrameWriter(DataSourceArrowWriter):
    """Rows arrive sorted by file, as write_frames brings them; a file of which two tasks have rows fails."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        folder = f"{root}/_pending/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(folder)
        done: list[tuple[str, str, int]] = []
        current = writer = None
        rows = 0
        try:
            for batch in iterator:
                names = batch.column(FILE).to_pylist()
                low = 0
                while low < len(names):
                    high = low + 1
                    while high < len(names) and names[high] == names[low]:
                        high += 1
                    if names[low] != current:
                        if writer is not None:
                            writer.close()
                            done.append((current, f"{folder}/{current}", rows))
                        current, rows = names[low], 0
                        writer = pq.ParquetWriter(f"{folder}/{current}", batch.schema.remove(batch.schema.get_field_index(FILE)), filesystem=store, compression="zstd")
                    part = batch.slice(low, high - low)
                    writer.write_batch(part.drop_columns([FILE]))
                    rows, low = rows + part.num_rows, high
            if writer is not None:
                writer.close()
                done.append((current, f"{folder}/{current}", rows))
        except BaseException:
            if writer is not None:
                writer.close()
            store.delete_dir(folder)
            raise
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = opened(self.path)
        found = [f for m in messages if m is not None for f in m.files]
        if len({name for name, _, _ in found}) < len(found):
            self.abort(messages)
            raise ValueError("two tasks wrote one file: bring a file's rows together before writing")
        before = read_manifest(self.path)
        names = {f"{name}-{self.job[:8]}.parquet": (place, rows) for name, place, rows in found}
        for name, (place, _) in names.items():
            store.move(place, f"{root}/{name}")
        after = ({} if self.overwrite else before) | {name: rows for name, (_, rows) in names.items()}
        with store.open_output_stream(f"{root}/{MANIFEST}.{self.job}") as stream:
            stream.write(json.dumps(after, indent=0, sort_keys=True).encode())
        store.move(f"{root}/{MANIFEST}.{self.job}", f"{root}/{MANIFEST}")
        if self.overwrite:
            for name in before:
                store.delete_file(f"{root}/{name}")
        self.abort(messages)  # what is left: the empty folder and attempts that didn't count

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/_pending/{self.job}").type != pafs.FileType.NotFound:
            store.delete_dir(f"{root}/_pending/{self.job}")


class FrameReader(DataSourceReader):
    """A partition for each visible file."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.columns = options["path"], [f.name for f in schema.fields]

    def partitions(self) -> list[OneFile]:
        return [OneFile(name) for name in sorted(read_manifest(self.path))] or [OneFile("")]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, root = opened(self.path)
        with store.open_input_file(f"{root}/{partition.name}") as stream:
            for batch in pq.ParquetFile(stream).iter_batches(batch_size=10_000):
                name = pa.array([partition.name.rsplit("-", 1)[0]] * batch.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([name if c == FILE else batch.column(c) for c in self.columns], names=self.columns)


class HourFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hourframes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options, overwrite)


def write_frames(hours: DataFrame, path: str, start: str, steps_per_file: int, step_hours: int = 1, mode: str = "overwrite") -> None:
    """hours (grid, hour_ts, layer, row, col, pollutant, prefix, value, unit) as files of so many steps, counted from start, for each domain.

    A file is named by its domain and its first step. A domain's steps of one file come together in one task; its size is that of the domain, whatever the length of the run.
    """
    first = F.lit(start).cast("timestamp")
    span = steps_per_file * step_hours
    frame = F.floor(F.timestamp_diff("HOUR", first, F.col("hour_ts")) / span)
    begin = F.timestamp_add("HOUR", (frame * span).cast("int"), first)
    named = hours.withColumn(FILE, F.concat_ws("_", "grid", F.date_format(begin, "yyyy-MM-dd_HH_mm_ss")))
    wanted = named.select(FILE, "grid", F.col("hour_ts").cast("timestamp").alias("hour_ts"), *(F.col(c).cast("int").alias(c) for c in ("layer", "row", "col")), "pollutant", "prefix", F.col("value").cast("double").alias("value"), "unit")
    hours.sparkSession.dataSource.register(HourFrames)
    wanted.repartition(FILE).sortWithinPartitions(FILE, "hour_ts", "layer", "row", "col", "pollutant", "prefix").write.format("hourframes").mode("append" if mode == "append" else "overwrite").option("path", path).save()


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(HourFrames)
    return spark.read.format("hourframes").option("path", path).load()
