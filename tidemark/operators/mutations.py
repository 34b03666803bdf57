"""Current state, history and delete outcomes of an ordered put/delete log.

Version order is (epoch, seq): a counter that restarts on reopening is safe only with its epoch.
Deletes must take part in the aggregate; filtering puts first would bring deleted keys back.
Every operator shuffles once, on key, with map-side partial aggregation where it aggregates.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mutations(events: DataFrame) -> DataFrame:
    """The log view of an event table: errors delete the user's key, all else puts its props."""
    put = ~F.col("event_type").eqNullSafe("error")
    return events.select(
        F.lit(0).cast("bigint").alias("epoch"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"),
        F.when(put, "put").otherwise("delete").alias("op"),
        F.when(put, F.col("props")).alias("value"),
        F.col("ts"),
    )


def version() -> Column:
    return F.struct("epoch", "seq")


def latest(log: DataFrame) -> DataFrame:
    """Newest entry of every key, tombstones included."""
    return (log.groupBy("key")
            .agg(F.max_by(F.struct("op", "value", "epoch", "seq"), version()).alias("e"))
            .select("key", "e.*"))


def current_state(log: DataFrame) -> DataFrame:
    """Live keys: last write wins, tombstones hide. An empty value is alive."""
    return latest(log).where("op = 'put'").select("key", "value", "epoch", "seq")


def point_get(log: DataFrame, key: str) -> DataFrame:
    """At most one row; the equality reaches the Parquet scan."""
    return current_state(log.where(F.col("key") == key))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Every wanted key with its value, or null and found = false."""
    wanted = keys.select("key").distinct()
    state = current_state(log.join(wanted, "key", "left_semi"))
    return wanted.join(state, "key", "left").select("key", "value", F.col("seq").isNotNull().alias("found"))


def as_of(log: DataFrame, seq: int, epoch: int = 0) -> DataFrame:
    return current_state(log.where((F.col("epoch") < epoch) | ((F.col("epoch") == epoch) & (F.col("seq") <= seq))))


def half_way(log: DataFrame) -> int:
    """Half of the highest sequence number: a snapshot point in the middle of a log."""
    return (log.agg(F.max("seq")).first()[0] or 0) // 2


def scan(log: DataFrame, start: str | None = None, end: str | None = None, prefix: str | None = None) -> DataFrame:
    """Live keys in order, from `start` up to but without `end`, or with a prefix; the bounds reach the Parquet scan."""
    wanted = log
    if start is not None:
        wanted = wanted.where(F.col("key") >= start)
    if end is not None:
        wanted = wanted.where(F.col("key") < end)
    if prefix is not None:
        wanted = wanted.where(F.col("key").startswith(prefix))
    return current_state(wanted).orderBy("key")


def state_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys added, removed or changed between two states."""
    a = before.select("key", F.struct("value").alias("a"))
    b = after.select("key", F.struct("value").alias("b"))
    change = (F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
              .when(~F.col("a").eqNullSafe(F.col("b")), "changed"))
    return (a.join(b, "key", "full").withColumn("change", change).where("change IS NOT NULL")
            .select("key", "change", F.col("a.value").alias("old_value"), F.col("b.value").alias("new_value")))


def history(log: DataFrame) -> DataFrame:
    """Each write with its version number per key, newest first = 1."""
    newest = Window.partitionBy("key").orderBy(F.desc("epoch"), F.desc("seq"))
    return log.select("key", "epoch", "seq", "op", "value", F.row_number().over(newest).cast("bigint").alias("rn"))


def delete_outcome(log: DataFrame) -> DataFrame:
    """Each delete with whether its key was alive just before it."""
    w = Window.partitionBy("key").orderBy("epoch", "seq")
    return (log.withColumn("before", F.lag("op").over(w)).where("op = 'delete'")
            .select("key", "epoch", "seq", F.col("before").eqNullSafe("put").alias("found")))


def op_counts(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if(F.col("op") == "put").alias("puts"), F.count_if(F.col("op") == "delete").alias("deletes"),
                   F.count_distinct("key").alias("keys_seen"))


def validated(log: DataFrame) -> DataFrame:
    """The log, failing on an op that is neither put nor delete."""
    known = F.when(F.col("op").isin("put", "delete"), F.col("op")).otherwise(
        F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
    return log.withColumn("op", known)


def live_byte_deltas(log: DataFrame) -> DataFrame:
    """Change of approximate live bytes made by each write: new size less the size it replaces."""
    w = Window.partitionBy("key").orderBy("epoch", "seq")
    size = (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("bigint")
    return (log.withColumn("size", size)
            .select("key", "epoch", "seq", (F.col("size") - F.coalesce(F.lag("size").over(w), F.lit(0))).alias("delta")))


def live_bytes(log: DataFrame, slices: int | None = None) -> DataFrame:
    """Running live bytes over the whole log in version order.

    The total order is cut into ranges of seq; each range sums alone and starts from the
    total of those before it (a table of about `slices` rows, four for each shuffle partition), so no task sees the whole log.
    """
    slices = slices or 4 * int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deltas = live_byte_deltas(log)
    span = log.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(slices)))
    cut = (deltas.crossJoin(F.broadcast(span))
           .withColumn("slice", F.floor((F.col("seq") - F.col("lo")) / width)).drop("lo", "hi"))
    totals = cut.groupBy("epoch", "slice").agg(F.sum("delta").alias("total"))
    bases = totals.select("epoch", "slice", F.coalesce(F.sum("total").over(
        Window.orderBy("epoch", "slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("epoch", "slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return (cut.join(F.broadcast(bases), ["epoch", "slice"])
            .select("seq", "key", "delta", (F.col("base") + F.sum("delta").over(inside)).alias("live_bytes")))


def flush_points(log: DataFrame, limit: int, owners: int) -> DataFrame:
    """Where each owner's write buffer would fill: size restarts at every flush, and an
    overwrite nets out only inside one buffer, so this is an ordered fold per owner.

    Keys are dealt to `owners` buffers, one for each node of the cluster, by hash; an owner's log is streamed in order in bounded
    Arrow batches and only the buffer in hand (at most `limit` bytes of keys) is kept.
    """
    import pandas as pd

    def fold(batches):
        owner, sizes, total, no, writes = None, {}, 0, 0, 0
        for batch in batches:
            out = []
            for o, epoch, seq, key, size in zip(*(batch[c] for c in ("owner", "epoch", "seq", "key", "size")), strict=True):
                if o != owner:
                    owner, sizes, total, no, writes = o, {}, 0, 0, 0
                total += size - sizes.get(key, 0)
                sizes[key] = size
                writes += 1
                if total >= limit:
                    out.append((o, no, epoch, seq, writes, total))
                    sizes, total, no, writes = {}, 0, no + 1, 0
            yield pd.DataFrame(out, columns=["owner", "flush_no", "epoch", "seq", "writes", "bytes"])

    size = (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("bigint")
    dealt = (log.select(F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(owners)).cast("bigint").alias("owner"),
                        "epoch", "seq", "key", size.alias("size"))
             .repartition(owners, "owner").sortWithinPartitions("owner", "epoch", "seq"))
    return dealt.mapInPandas(fold, "owner bigint, flush_no bigint, epoch bigint, seq bigint, writes bigint, bytes bigint")
