"""Layered generations: newest layer wins, compaction, block cutting and lookup."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.keys import distinct_rows, range_of, tasks_for
from tidemark.operators.mutations import current_state

#: Fixed value: live generations that make a compaction due.
COMPACTION_TRIGGER = 4
#: Ranges of keys in which the blocks of a file are looked up.
KEY_RANGES = 256


def by_quartile(log: DataFrame, layers: int = 4) -> DataFrame:
    """The log dealt to equal ranges of seq: layer 0 the oldest."""
    span = log.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    at = F.floor((F.col("seq") - F.col("lo")) * layers / (F.col("hi") - F.col("lo") + 1)).cast("bigint")
    return log.crossJoin(F.broadcast(span)).withColumn("layer", at).drop("lo", "hi")


def overlay(layers: list[DataFrame]) -> DataFrame:
    """Newest-first overlay of layers given oldest first; each layer is already one row a key."""
    tagged = [f.select("key", "op", "value", F.lit(i).alias("layer")) for i, f in enumerate(layers)]
    won = reduce(DataFrame.unionByName, tagged).groupBy("key").agg(F.max_by(F.struct("op", "value", "layer"), "layer").alias("e"))
    return won.where("e.op = 'put'").select("key", "e.value", F.col("e.layer").cast("bigint").alias("layer"))


def layered_get(layered: DataFrame) -> DataFrame:
    """State read through a `layer` column: the winner of the newest layer that has the key."""
    per_layer = layered.groupBy("layer", "key").agg(F.max_by(F.struct("op", "value"), F.struct("epoch", "seq")).alias("e"))
    won = per_layer.groupBy("key").agg(F.max_by(F.struct("e", "layer"), "layer").alias("w"))
    return won.where("w.e.op = 'put'").select("key", F.col("w.e.value").alias("value"), F.col("w.layer").alias("layer"))


def should_compact(generations: int) -> bool:
    return generations >= COMPACTION_TRIGGER


def compact(generations: list[DataFrame]) -> DataFrame:
    """All generations merged to live rows only."""
    return current_state(reduce(DataFrame.unionByName, generations))


def compaction_stats(layered: DataFrame) -> DataFrame:
    """Rows in, kept, superseded and dropped as tombstones, per merge of all layers."""
    counts = layered.groupBy("key").agg(F.count("*").alias("n"), F.max_by("op", F.struct("epoch", "seq")).alias("op"))
    return counts.agg(F.sum("n").alias("rows_in"), F.count_if(F.col("op") == "put").alias("rows_out"),
                      F.sum(F.col("n") - 1).alias("superseded"), F.count_if(F.col("op") == "delete").alias("tombstones_dropped"))


def manifest_live(events: DataFrame) -> DataFrame:
    """Live files of an ordered add/remove log: more adds than removes, by sequence."""
    signed = F.when(F.col("type") == "add", 1).when(F.col("type") == "remove", -1).otherwise(0)
    seq = F.expr("max_by(sst_seq, ord) FILTER (WHERE type = 'add')")
    return (events.groupBy("path").agg(F.sum(signed).alias("refs"), seq.alias("sst_seq"))
            .where("refs > 0").orderBy("sst_seq", "path"))


def block_layout(entries: DataFrame, target: int, file_col: str = "file") -> DataFrame:
    """Blocks of each file, cut greedily once the encoded size reaches `target`.

    Files are independent and bounded by the writer; a file is folded in key order in batches.
    """
    import pandas as pd

    def cut(batches):
        file, no, first, rows, size, seen = None, 0, None, 0, 0, None
        done = []

        def close():
            if rows:
                done.append((file, no, first, rows, size + 4))

        for batch in batches:
            for f, key, n in zip(batch[file_col], batch["key"], batch["n"], strict=True):
                if f != file or seen is None:
                    close()
                    file, no, first, rows, size, seen = f, 0, None, 0, 0, True
                first = key if first is None else first
                rows, size = rows + 1, size + n
                if size >= target:
                    close()
                    no, first, rows, size = no + 1, None, 0, 0
            yield pd.DataFrame(done, columns=["file", "block", "first_key", "entries", "bytes"])
            done = []
        close()
        yield pd.DataFrame(done, columns=["file", "block", "first_key", "entries", "bytes"])

    from tidemark.functions.codec import entry_bytes

    rows = (entries.select(F.col(file_col), "key", entry_bytes(F.col("key"), F.col("value")).alias("n"))
            .repartition(file_col).sortWithinPartitions(file_col, "key"))
    return rows.mapInPandas(cut, "file bigint, block bigint, first_key string, entries bigint, bytes bigint")


def block_index_lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Rightmost block whose first key is at or below each distinct key; null where the key precedes all.

    Backward as-of as one sorted pass: index rows and keys are unioned and the last index row
    is carried forward within each range of keys of a file, so nothing is joined by inequality. A range begins with
    the last index row of the ranges before it. Its bounds are drawn by hash from both sides; they settle only how even the ranges are.
    """
    keys = distinct_rows(keys.select("key"))
    marks = index.select("file", F.col("first_key").alias("k"), F.lit(1).alias("kind"), F.col("block")).where("k IS NOT NULL")
    files = index.select("file").distinct()
    both = marks.select("k").unionByName(keys.select(F.col("key").alias("k"))).where("k IS NOT NULL")
    rows = both.count()
    every = max(1, rows // (64 * KEY_RANGES))
    drawn = sorted((r.k for r in both.where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).collect()), key=lambda k: k.encode() if isinstance(k, str) else k)
    bounds = list(dict.fromkeys(drawn[len(drawn) * i // KEY_RANGES] for i in range(1, KEY_RANGES))) if drawn else []
    marks = marks.withColumn("range", range_of(F.col("k"), bounds))
    asks = (keys.withColumn("range", range_of(F.col("key"), bounds)).crossJoin(F.broadcast(files))
            .select("file", F.col("key").alias("k"), F.lit(2).alias("kind"), F.lit(None).cast("bigint").alias("block"), "range"))
    lasts = marks.where("block IS NOT NULL").groupBy("file", "range").agg(F.max_by("block", "k").alias("block"))
    ranges = files.crossJoin(F.broadcast(keys.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("range"))))
    ahead = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = (ranges.join(lasts, ["file", "range"], "left")
              .select("file", F.lit(None).cast(keys.schema["key"].dataType).alias("k"), F.lit(0).alias("kind"), F.last("block", ignorenulls=True).over(ahead).alias("block"), "range"))
    w = Window.partitionBy("file", "range").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0)
    tasks = tasks_for(rows * files.count(), keys)  # a given number: small shuffles are not joined to large tasks
    return (begins.unionByName(marks).unionByName(asks).repartition(tasks, "file", "range").withColumn("found", F.last("block", ignorenulls=True).over(w))
            .where("kind = 2").select("file", F.col("k").alias("key"), F.col("found").alias("block")))
