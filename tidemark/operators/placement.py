"""Consistent-hash placement as a bucketed as-of join.

A ring is nodes x 150 rows. Its points are counted before it is broadcast; above those of MAX_BROADCAST_NODES
the same join runs as a shuffle on the bucket.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import RING_SIZE, VNODES_PER_NODE, ring_hash

BUCKET_BITS = 20
MAX_BROADCAST_NODES = 2000


def vnodes(spark: SparkSession, nodes: list[str], per_node: int = VNODES_PER_NODE) -> DataFrame:
    """(hash, node_id, vnode); adding a node twice leaves one set of points."""
    named = spark.createDataFrame([(n,) for n in dict.fromkeys(nodes)], "node_id string")
    return (named.withColumn("vnode", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))))
            .select(ring_hash(F.concat_ws("-", "node_id", F.col("vnode").cast("string"))).alias("hash"), "node_id", "vnode"))


def node_count(ring: DataFrame) -> DataFrame:
    return ring.agg(F.count_distinct("node_id").alias("nodes"), F.count("*").alias("points"))


def arcs(ring: DataFrame, copies: int = 1, per_node: int = VNODES_PER_NODE) -> DataFrame:
    """Ring arcs (lo, hi] with the first `copies` distinct nodes met clockwise, wrap arc included.

    The ring follows itself once, a turn later. A node has `per_node` points at most, so `copies` nodes are met
    within per_node * (copies - 1) + 1 of them: each arc looks that far ahead in one ordered pass.
    """
    points = ring.select("hash", "node_id", F.lit(0).alias("turn"))
    twice = points.unionByName(points.select((F.col("hash") + RING_SIZE).alias("hash"), "node_id", F.lit(1).alias("turn")))
    w = Window.orderBy("hash")
    walk = F.collect_list("node_id").over(w.rowsBetween(0, per_node * (copies - 1)))
    met = twice.select("hash", "turn", F.coalesce(F.lag("hash").over(w), F.lit(-1)).alias("lo"), F.slice(F.array_distinct(walk), 1, copies).alias("nodes"),
                       F.row_number().over(Window.partitionBy("turn").orderBy("hash")).alias("n"))
    first = met.where("turn = 0").select(F.col("hash").alias("hi"), "lo", "nodes")
    top = met.where("turn = 1 AND n = 1").select(F.lit(RING_SIZE - 1).alias("hi"), "lo", "nodes")
    return first.unionByName(top).where("hi > lo")


def owners(keys: DataFrame, ring: DataFrame, copies: int = 1) -> DataFrame:
    """Keys with the arc's preference list; the first entry owns the key. An empty ring gives null."""
    bucketed = arcs(ring, copies).withColumn("bucket", F.explode(F.sequence(
        F.shiftright(F.col("lo") + 1, BUCKET_BITS), F.shiftright(F.col("hi"), BUCKET_BITS))))
    most = MAX_BROADCAST_NODES * VNODES_PER_NODE
    if ring.limit(most + 1).count() <= most:
        bucketed = F.broadcast(bucketed)
    hashed = keys.withColumn("h", ring_hash(F.col("key"))).withColumn("bucket", F.shiftright("h", BUCKET_BITS))
    return (hashed.join(bucketed, (hashed.bucket == bucketed.bucket) & (hashed.h > bucketed.lo) & (hashed.h <= bucketed.hi), "left")
            .select(*[hashed[c] for c in keys.columns], hashed.h.alias("hash"), "nodes", F.try_element_at("nodes", F.lit(1)).alias("owner")))


def distribution(owned: DataFrame) -> DataFrame:
    n = owned.groupBy("owner").agg(F.count("*").alias("n_keys"))
    return n.withColumn("share", F.col("n_keys") / F.sum("n_keys").over(Window.partitionBy()))


def movement(keys: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys per (old owner, new owner); only a removed node's keys should move."""
    old = owners(keys, before).select("key", F.col("owner").alias("old_owner"))
    return (owners(old, after).groupBy("old_owner", F.col("owner").alias("new_owner")).agg(F.count("*").alias("n_keys")))


def routing_report(requests: DataFrame, ring: DataFrame) -> DataFrame:
    """Requests by entry node and owner, local or forwarded."""
    routed = owners(requests, ring)
    return (routed.withColumn("forwarded", ~F.col("owner").eqNullSafe(F.col("entry_node")) & F.col("owner").isNotNull())
            .groupBy("entry_node", "owner", "forwarded").agg(F.count("*").alias("n_requests")))


def ack_report(writes: DataFrame, ring: DataFrame, down: list[str], copies: int = 2) -> DataFrame:
    """All-acknowledge replication: each write goes to its replicas; a node that is down fails it."""
    sent = owners(writes, ring, copies).select("key", "owner", F.explode("nodes").alias("replica"))
    acked = sent.withColumn("ack", ~F.col("replica").isin(down) if down else F.lit(True))
    per = acked.where("replica <> owner").groupBy("key", "owner").agg(F.bool_and("ack").alias("ok"), F.count("*").alias("replicas"))
    return per.groupBy("owner").agg(F.count("*").alias("writes"), F.count_if("ok").alias("acked"), F.sum("replicas").alias("sent"))
