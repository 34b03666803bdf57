"""Streaming state: upserts of the newest version per key, and change feeds, in any arrival order."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tidemark.operators.mutations import latest
from tidemark.sources.manifest import Generations


def stream_latest(stream: DataFrame) -> DataFrame:
    """Newest entry per key in complete or update mode; older versions that arrive late lose."""
    return (stream.groupBy("key").agg(F.max_by(F.struct("op", "value", "epoch", "seq"), F.struct("epoch", "seq")).alias("e"))
            .select("key", "e.*"))


def sink_generations(table: Generations, name: str = "stream"):
    """foreachBatch sink: each micro-batch's newest entry per key becomes one generation, once however often the batch is tried.

    `name` tells the queries apart that write to one table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            table.append(latest(batch).select("epoch", "seq", "key", "op", "value"), tag=f"{name}:{batch_id}")

    return write


class LatestProcessor(StatefulProcessor):
    """Keeps (epoch, seq, op, value) per key and emits a row when a newer version arrives."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", StructType([
            StructField("epoch", LongType()), StructField("seq", LongType()), StructField("alive", BooleanType()), StructField("value", StringType())]))

    def handleInputRows(self, key, rows, timer_values):
        import pandas as pd

        best = None
        for frame in rows:
            top = frame.sort_values(["epoch", "seq"]).iloc[-1]
            if best is None or (top.epoch, top.seq) > (best.epoch, best.seq):
                best = top
        old = self.state.get() if self.state.exists() else None
        if best is None or (old is not None and (old[0], old[1]) >= (int(best.epoch), int(best.seq))):
            return
        alive = best.op == "put"
        value = best.value if alive and isinstance(best.value, str) else None
        self.state.update((int(best.epoch), int(best.seq), bool(alive), value))
        yield pd.DataFrame({"key": [key[0]], "epoch": [int(best.epoch)], "seq": [int(best.seq)], "alive": [bool(alive)], "value": [value]})

    def close(self) -> None:
        pass


def watch_stream(stream: DataFrame, interval: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """Last entry of each key in each interval of a stream, told once the watermark has passed the interval: the ticks of a watcher.

    `watch.changes` of what it has told gives the changes that a poller would print.
    """
    return (stream.withWatermark("ts", late).groupBy("key", F.window("ts", interval).alias("w"))
            .agg(F.max_by(F.struct("op", "value"), F.struct("epoch", "seq")).alias("e"))
            .select("key", F.col("w.end").alias("tick"), "e.op", "e.value"))


def stream_updates(stream: DataFrame) -> DataFrame:
    """Change feed of the newest version per key (needs the RocksDB state store)."""
    return stream.groupBy("key").transformWithStateInPandas(
        LatestProcessor(), StructType([StructField("key", StringType()), StructField("epoch", LongType()), StructField("seq", LongType()),
                                       StructField("alive", BooleanType()), StructField("value", StringType())]), "Update", "None")
