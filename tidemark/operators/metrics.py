"""Counters, node status and configuration precedence."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The counters a node reports.
COUNTERS = ["del_total", "forwarded_requests", "get_miss", "get_total", "key_count", "put_total",
            "raft_term", "replication_errors", "wal_writes"]


def metrics_long(log: DataFrame) -> DataFrame:
    """(metric, value) of a log, ordered by the raw name. Counts are real, not placeholders."""
    per_key = log.groupBy("key").agg(F.count_if(F.col("op") == "put").alias("p"), F.count_if(F.col("op") == "delete").alias("d"),
                                     F.max_by("op", F.struct("epoch", "seq")).alias("last"))
    wide = per_key.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("put_total"), F.coalesce(F.sum("d"), F.lit(0)).alias("del_total"),
                       F.count_if(F.col("last") == "put").alias("key_count"),
                       F.coalesce(F.sum(F.col("p") + F.col("d")), F.lit(0)).alias("wal_writes"))
    names = ["put_total", "del_total", "key_count", "wal_writes"]
    return wide.unpivot([], names, "metric", "value").orderBy("metric")


def all_counters(log: DataFrame, gets: DataFrame, requests: DataFrame, acks: DataFrame, terms: DataFrame) -> DataFrame:
    """(metric, value) of all COUNTERS: the log's own, gets (found), requests (forwarded), acks (writes, acked) and terms (term)."""
    told = [gets.agg(F.count("*").alias("get_total"), F.count_if(~F.col("found")).alias("get_miss")),
            requests.agg(F.coalesce(F.sum(F.when(F.col("forwarded"), F.col("n_requests"))), F.lit(0)).alias("forwarded_requests")),
            acks.agg(F.coalesce(F.sum(F.col("writes") - F.col("acked")), F.lit(0)).alias("replication_errors")),
            terms.agg(F.coalesce(F.max("term"), F.lit(0)).cast("bigint").alias("raft_term"))]
    out = metrics_long(log)
    for t in told:
        out = out.unionByName(t.unpivot([], t.columns, "metric", "value"))
    return out.orderBy("metric")


def metrics_map(long: DataFrame) -> DataFrame:
    return long.agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))


def status_all_nodes(hosts: DataFrame, status: DataFrame) -> DataFrame:
    """Every asked host in order, unreachable ones marked."""
    cols = [c for c in status.columns if c != "host"]
    joined = hosts.join(status.withColumn("up", F.lit(True)), "host", "left")
    return (joined.select("pos", "host", F.when(F.col("up"), "ok").otherwise("[unreachable]").alias("state"), *cols).orderBy("pos"))


def config_precedence(settings: DataFrame, order: list[str]) -> DataFrame:
    """First of `order` that is set wins, with its name."""
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in order])
    return settings.select("name", F.coalesce(*order).alias("value"), source.alias("source"))
