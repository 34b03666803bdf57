"""Readers and writers of the log and sorted-file formats.

Files are listed and read by Spark (binaryFile), so they may sit in any store Spark reads, one
task per group of files. A log file is decoded up to its first torn or damaged frame; a damaged
sorted file fails the read.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark import schemas
from tidemark.functions import codec

#: Fixed value: the name of a log file, its number read as a number.
LOG_NAME = r"wal-(\d+)\.log$"


def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_seq, length), numerically ordered; other names are left out."""
    found = spark.read.format("binaryFile").load(folder).select("path", "length")
    seq = F.regexp_extract("path", "/" + LOG_NAME, 1)
    return found.where(seq != "").withColumn("file_seq", seq.cast("bigint")).orderBy("file_seq")


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, seq, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            rows: list = []
            for i, (op, key, value) in enumerate(codec.decode_frames(data)):
                rows.append((path, seq, i, op, key, value))
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LOG, strict=True)], schema=_LOG)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LOG, strict=True)], schema=_LOG)


_LOG = pa.schema([("file", pa.string()), ("file_seq", pa.int64()), ("ordinal", pa.int64()), ("op", pa.string()),
                  ("key", pa.string()), ("value", pa.binary())])


def replay(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of all log files of a folder."""
    files = spark.read.format("binaryFile").load(folder)
    seq = F.regexp_extract("path", "/" + LOG_NAME, 1)
    logs = files.where(seq != "").select("path", seq.cast("bigint").alias("file_seq"), "content")
    return logs.mapInArrow(_frames, schemas.LOG_FRAME)


def as_mutations(frames: DataFrame, epoch: int = 0) -> DataFrame:
    """Fresh sequence numbers in (file, ordinal) order.

    Files are numbered by the sizes of those before them (one row a file), so no task orders
    the whole log. Reading the same files again gives the same numbers.
    """
    sizes = frames.groupBy("file_seq").agg(F.max("ordinal").alias("last"))
    base = sizes.select("file_seq", F.coalesce(F.sum(F.col("last") + 1).over(
        Window.orderBy("file_seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return (frames.join(base, "file_seq").select(F.lit(epoch).cast("bigint").alias("epoch"), (F.col("base") + F.col("ordinal") + 1).alias("seq"),
                                                 "key", "op", F.when(F.col("op") == "put", F.col("value")).alias("value")))


def read_sorted_files(spark: SparkSession, folder: str, glob: str = "*.sst") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")

    def entries(batches):
        schema = pa.schema([("file", pa.string()), ("block", pa.int32()), ("key", pa.string()), ("value", pa.binary()),
                            ("tombstone", pa.bool_()), ("seq", pa.int64())])
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index, _ = codec.open_sorted_file(data)
                for no, (_, offset, length) in enumerate(index):
                    rows = [(path, no, *e) for e in codec.decode_block(data[offset : offset + length])]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    return files.mapInArrow(entries, schemas.SORTED_ENTRY)


#: Bytes of keys and values in a sorted file, about.
FILE_BYTES = 32 << 20


def sorted_files(entries: DataFrame, file_bytes: int = FILE_BYTES, target: int = codec.BLOCK_TARGET_BYTES) -> DataFrame:
    """(first_key, last_key, entries, content): indexed files of entries (key, value, tombstone, seq), which has one row a key.

    Keys are dealt to tasks by range and sorted there; a task closes a file whenever it is full, so that it holds one at a time.
    """
    from tidemark.operators.bloom import bloom_bits, marshal

    def build(batches):
        held, size = [], 0

        def close():
            keys = [k.encode() for k, *_ in held]
            content = codec.encode_sorted_file(held, marshal(keys, bloom_bits(len(keys))), target)
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]]), pa.array([held[-1][0]]), pa.array([len(held)], pa.int64()), pa.array([content], pa.binary())],
                                              names=["first_key", "last_key", "entries", "content"])

        for batch in batches:
            for key, value, tombstone, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((key, value or b"", tombstone, seq))
                size += len(key) + len(value or b"")
                if size >= file_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    rows = entries.select("key", F.col("value").cast("binary").alias("value"), "tombstone", "seq")
    return (rows.repartitionByRange("key").sortWithinPartitions("key")
            .mapInArrow(build, "first_key string, last_key string, entries bigint, content binary"))


def blocks_of(sorted_file_rows: DataFrame) -> DataFrame:
    """(first_key, block, offset, length, block_key) from the index of each file; what a reader fetches a block by."""

    def index(batches):
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = codec.open_sorted_file(data)[0]
                yield pa.RecordBatch.from_arrays([pa.array([first] * len(found)), pa.array(range(len(found)), pa.int64()), pa.array([o for _, o, _ in found], pa.int64()),
                                                  pa.array([n for _, _, n in found], pa.int64()), pa.array([k for k, _, _ in found], pa.string())],
                                                 names=["first_key", "block", "offset", "length", "block_key"])

    return sorted_file_rows.select("first_key", "content").mapInArrow(index, "first_key string, block bigint, offset bigint, length bigint, block_key string")


def entries_of(sorted_file_rows: DataFrame) -> DataFrame:
    """Entries of every block, each cut out of its file by the index and decoded by itself."""
    cut = (sorted_file_rows.join(blocks_of(sorted_file_rows), "first_key")
           .select(F.substring("content", F.col("offset").cast("int") + 1, F.col("length").cast("int")).alias("data")))

    def decode(batches):
        for batch in batches:
            rows = [e for data in batch.column(0).to_pylist() for e in codec.decode_block(data)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.bool_(), pa.int64()))],
                                             names=["key", "value", "tombstone", "seq"])

    return cut.mapInArrow(decode, "key string, value binary, tombstone boolean, seq bigint")


class LogSource(DataSource):
    """spark.read.format("mutation_log").option("path", folder): one partition a log file.

    For folders that every executor can open; `replay` reads any store that Spark reads.
    """

    @classmethod
    def name(cls) -> str:
        return "mutation_log"

    def schema(self):
        return schemas.LOG_FRAME

    def reader(self, schema):
        return LogReader(self.options["path"])


class LogReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        import os
        import re

        names = os.listdir(self.folder) if os.path.isdir(self.folder) else []
        found = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(LOG_NAME, n)))
        return [InputPartition(f) for f in found] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        seq, name = partition.value
        with open(f"{self.folder}/{name}", "rb") as f:
            for i, (op, key, value) in enumerate(codec.decode_frames(f.read())):
                yield name, seq, i, op, key, value
