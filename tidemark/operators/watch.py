"""Sampled change detection: the last value of each interval, emitted where it changes."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def watch_changes(log: DataFrame, interval: str = "1 hour", reemit_after_delete: bool = False) -> DataFrame:
    """Changes a poller of every key would print.

    A mutation belongs to the interval it falls in and shows at the interval's end. A key not yet
    seen and absent is silent; a delete shows once; a value shows when it differs from the last
    value seen. After a delete the same value is silent unless `reemit_after_delete`.
    """
    ticks = (log.groupBy("key", F.window("ts", interval).alias("w"))
             .agg(F.max_by(F.struct("op", "value"), F.struct("epoch", "seq")).alias("e"))
             .select("key", F.col("w.end").alias("tick"), "e.op", "e.value"))
    return changes(ticks, reemit_after_delete)


def changes(ticks: DataFrame, reemit_after_delete: bool = False) -> DataFrame:
    """What is printed of (key, tick, op, value), the last entry of each key in each interval."""
    before = Window.partitionBy("key").orderBy("tick")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    put = F.col("op") == "put"
    seen = F.last(F.when(put, F.struct("value")), ignorenulls=True).over(earlier)
    marked = ticks.withColumn("seen", seen).withColumn("before", F.lag("op").over(before))
    fresh = F.col("seen").isNull() | ~F.col("seen.value").eqNullSafe(F.col("value"))
    if reemit_after_delete:
        fresh = fresh | (F.col("before") == "delete")
    change = F.when(put & fresh, "value").when(~put & F.col("seen").isNotNull() & (F.col("before") == "put"), "deleted")
    return marked.withColumn("change", change).where("change IS NOT NULL").select("key", "tick", "change", F.when(put, F.col("value")).alias("value"))


def counter_deltas(samples: DataFrame) -> DataFrame:
    w = Window.partitionBy("metric").orderBy("tick")
    return samples.withColumn("delta", F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0)))
