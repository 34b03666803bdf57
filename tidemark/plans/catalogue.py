"""Named queries over the supplied tables, each with its SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.functions.hashing import VNODES_PER_NODE
from tidemark.operators import bloom, consensus, layers, metrics, mutations, placement, watch

NODES = ["node1", "node2", "node3"]
FLUSH_BYTES = 128
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = " ".join(sql.split())
        return f

    return keep


def log(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.mutations(spark.read.parquet(f"{sf}/events.parquet"))


def order_keys(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("key"))


M = """m AS (SELECT event_id AS seq, 'u' || user_id AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, ts FROM events)"""
R = f"""{M}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM m)"""


#: SQL for the bytes of `text` as numbers, for FNV-1a and FNV-1 of them, and for the bits that they set in a filter of `size` bits.
def sql_bytes(text: str) -> str:
    return f"list_transform(range(strlen({text})), lambda i : CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS HUGEINT))"


FNV = {"a": "(xor(h, b) * CAST(1099511628211 AS HUGEINT)) % CAST(18446744073709551616 AS HUGEINT)", "b": "xor((h * CAST(1099511628211 AS HUGEINT)) % CAST(18446744073709551616 AS HUGEINT), b)"}


def sql_positions(keys: str, size: int | str) -> str:
    """CTEs p (key, pos) over a table `keys` that has a key."""
    fold = ", ".join(f"list_reduce(list_concat([CAST(14695981039346656037 AS HUGEINT)], {sql_bytes('key')}), lambda h, b : {f}) AS {n}" for n, f in FNV.items())
    return f"""h AS (SELECT key, {fold} FROM {keys}), p AS (SELECT key, i, CAST((a + i * (CASE WHEN b = 0 THEN 1 ELSE b END)) % CAST(18446744073709551616 AS HUGEINT) % {size} AS BIGINT) AS pos
      FROM h, (SELECT CAST(unnest(range(7)) AS HUGEINT) AS i))"""


#: SQL for CRC-32 of the bytes `data`, a list of numbers; needs the CTE that makes its table.
CRC_TABLE = """crc AS (SELECT list(list_reduce(list_concat([n], range(8)), lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n))"""


def sql_crc32(data: str) -> str:
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {data}), lambda c, b : xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


@query(f"WITH {R} SELECT key, value, seq FROM r WHERE rn = 1 AND op = 'put'")
def kv_current_state(spark, sf):
    return mutations.current_state(log(spark, sf)).select("key", "value", "seq")


@query(f"""WITH {R}, l AS (SELECT * FROM r WHERE rn = 1) SELECT key, value, seq FROM l WHERE op = 'put'
  AND key IN ((SELECT min(key) FROM l WHERE op = 'put'), (SELECT min(key) FROM l WHERE op = 'delete'), 'nobody')""")
def kv_point_get(spark, sf):
    """Gets of a live key, a deleted one and one that never was: one row."""
    m = log(spark, sf)
    asked = {r.op: r.key for r in mutations.latest(m).groupBy("op").agg(F.min("key").alias("key")).collect()}
    got = [mutations.point_get(m, k) for k in (asked.get("put", "nobody"), asked.get("delete", "nobody"), "nobody")]
    return got[0].unionByName(got[1]).unionByName(got[2]).select("key", "value", "seq")


@query(f"WITH {R} SELECT key, value, seq FROM r WHERE rn = 1 AND op = 'put' AND key >= 'u2' AND key < 'u5'")
def kv_range_scan(spark, sf):
    return mutations.scan(log(spark, sf), "u2", "u5").select("key", "value", "seq")


@query(f"WITH {R} SELECT key, value, seq FROM r WHERE rn = 1 AND op = 'put' AND starts_with(key, 'u1')")
def kv_prefix_scan(spark, sf):
    return mutations.scan(log(spark, sf), prefix="u1").select("key", "value", "seq")


@query(f"WITH {R} SELECT key, value, row_number() OVER (ORDER BY key) AS place FROM r WHERE rn = 1 AND op = 'put'")
def kv_ordered_scan(spark, sf):
    from pyspark.sql import Window

    return mutations.scan(log(spark, sf)).select("key", "value", F.row_number().over(Window.orderBy("key")).cast("bigint").alias("place"))


@query(f"WITH {R} SELECT key, op, value, seq FROM r WHERE rn = 1")
def kv_raw_get_with_tombstone(spark, sf):
    return mutations.latest(log(spark, sf)).select("key", "op", "value", "seq")


@query(f"""WITH {R}, k AS (SELECT DISTINCT 'u' || c_custkey AS key FROM customer)
  SELECT k.key, s.value, s.seq IS NOT NULL AS found FROM k LEFT JOIN (SELECT * FROM r WHERE rn = 1 AND op = 'put') s ON s.key = k.key""")
def kv_multi_get(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    return mutations.multi_get(log(spark, sf), customers.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("key")))


@query(f"""WITH {M}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM m WHERE seq <= (SELECT max(seq) // 2 FROM m))
  SELECT key, value, seq FROM r WHERE rn = 1 AND op = 'put'""")
def kv_snapshot_asof(spark, sf):
    m = log(spark, sf)
    return mutations.as_of(m, mutations.half_way(m)).select("key", "value", "seq")


@query(f"""WITH {R}, a AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM m WHERE seq <= (SELECT max(seq) // 2 FROM m)) WHERE n = 1 AND op = 'put'),
  b AS (SELECT key, value FROM r WHERE rn = 1 AND op = 'put')
  SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change,
    a.value AS old_value, b.value AS new_value
  FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.value IS DISTINCT FROM b.value""")
def kv_snapshot_diff(spark, sf):
    m = log(spark, sf)
    return mutations.state_diff(mutations.as_of(m, mutations.half_way(m)), mutations.current_state(m))


@query(f"""WITH {M}, l AS (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY seq) AS b FROM m)
  SELECT key, seq, b IS NOT NULL AND b = 'put' AS found FROM l WHERE op = 'delete'""")
def kv_delete_outcome(spark, sf):
    return mutations.delete_outcome(log(spark, sf)).select("key", "seq", "found")


@query(f"WITH {M} SELECT count(*) FILTER (op = 'put') AS puts, count(*) FILTER (op = 'delete') AS deletes, count(DISTINCT key) AS keys_seen FROM m")
def kv_op_counts(spark, sf):
    return mutations.op_counts(log(spark, sf))


@query(f"WITH {R} SELECT key, seq, op, value, rn FROM r")
def kv_version_history(spark, sf):
    return mutations.history(log(spark, sf)).select("key", "seq", "op", "value", "rn")


@query(f"WITH {R} SELECT key, seq FROM r WHERE rn = 1 AND op = 'delete'")
def kv_tombstones(spark, sf):
    return mutations.latest(log(spark, sf)).where("op = 'delete'").select("key", "seq")


@query(f"""WITH {M}, s AS (SELECT seq, key, strlen(key) + coalesce(strlen(value), 0) AS size FROM m),
  d AS (SELECT seq, key, size - coalesce(lag(size) OVER (PARTITION BY key ORDER BY seq), 0) AS delta FROM s)
  SELECT seq, key, delta, CAST(sum(delta) OVER (ORDER BY seq) AS BIGINT) AS live_bytes FROM d""")
def kv_live_bytes(spark, sf):
    return mutations.live_bytes(log(spark, sf))


@query()
def kv_memtable_flush_points(spark, sf):
    return mutations.flush_points(log(spark, sf), FLUSH_BYTES, 8)


Q = f"""{M}, q AS (SELECT m.*, CAST(floor((seq - lo) * 4 / (hi - lo + 1)) AS BIGINT) AS layer FROM m, (SELECT min(seq) AS lo, max(seq) AS hi FROM m) b),
  e AS (SELECT *, row_number() OVER (PARTITION BY layer, key ORDER BY seq DESC) AS n FROM q),
  w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY layer DESC) AS k FROM e WHERE n = 1)"""


@query(f"WITH {Q} SELECT key, value, layer FROM w WHERE k = 1 AND op = 'put'")
def lsm_layered_get(spark, sf):
    return layers.layered_get(layers.by_quartile(log(spark, sf)))


@query(f"WITH {R} SELECT key, value, seq FROM r WHERE rn = 1 AND op = 'put'")
def lsm_compaction_merge(spark, sf):
    layered = layers.by_quartile(log(spark, sf))
    return layers.compact([layered.where(F.col("layer") == i) for i in range(4)]).select("key", "value", "seq")


@query(f"""WITH {R}, c AS (SELECT key, count(*) AS n, max(CASE WHEN rn = 1 THEN op END) AS op FROM r GROUP BY key)
  SELECT CAST(sum(n) AS BIGINT) AS rows_in, count(*) FILTER (op = 'put') AS rows_out, CAST(sum(n - 1) AS BIGINT) AS superseded,
    count(*) FILTER (op = 'delete') AS tombstones_dropped FROM c""")
def lsm_compaction_stats(spark, sf):
    return layers.compaction_stats(layers.by_quartile(log(spark, sf)))


@query("""WITH x AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 2 THEN 'remove' ELSE 'add' END AS type,
    'sst-' || lpad(CAST(o_custkey % 500 AS VARCHAR), 8, '0') || '.sst' AS path, o_orderkey AS sst_seq FROM orders)
  SELECT path, CAST(sum(CASE type WHEN 'add' THEN 1 ELSE -1 END) AS BIGINT) AS refs, max(sst_seq) FILTER (type = 'add') AS sst_seq
  FROM x GROUP BY path HAVING sum(CASE type WHEN 'add' THEN 1 ELSE -1 END) > 0""")
def lsm_manifest_live(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return layers.manifest_live(o.select(
        F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 3 == 2, "remove").otherwise("add").alias("type"),
        F.concat(F.lit("sst-"), F.lpad((F.col("o_custkey") % 500).cast("string"), 8, "0"), F.lit(".sst")).alias("path"),
        F.col("o_orderkey").alias("sst_seq")))


@query("""WITH i AS (SELECT c_custkey % 4 AS file, 'order-' || (c_custkey * 7) AS first_key, c_custkey AS block FROM customer),
    k AS (SELECT DISTINCT 'order-' || o_orderkey AS key FROM orders), f AS (SELECT DISTINCT file FROM i), a AS (SELECT file, key FROM k, f)
  SELECT a.file, a.key, i.block FROM a ASOF LEFT JOIN i ON a.file = i.file AND a.key >= i.first_key""")
def lsm_block_index_lookup(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    index = c.select((F.col("c_custkey") % 4).alias("file"), F.concat(F.lit("order-"), (F.col("c_custkey") * 7).cast("string")).alias("first_key"),
                     F.col("c_custkey").alias("block"))
    return layers.block_index_lookup(index, order_keys(spark, sf))


@query(f"""WITH RECURSIVE {CRC_TABLE}, k AS MATERIALIZED (SELECT key, {sql_crc32(sql_bytes('key').replace('HUGEINT', 'BIGINT'))} % 16 AS file FROM (SELECT 'order-' || o_orderkey AS key FROM orders), crc),
  c AS MATERIALIZED (SELECT file, key, row_number() OVER w AS n, sum(2 * strlen(key) + 17) OVER w AS upto FROM k WINDOW w AS (PARTITION BY file ORDER BY key)),
  e AS MATERIALIZED (SELECT a.file, a.n, a.key, coalesce(b.n, (SELECT max(n) FROM c z WHERE z.file = a.file)) AS last, coalesce(a.upto - 2 * strlen(a.key) - 17, 0) AS before
    FROM c a ASOF LEFT JOIN c b ON a.file = b.file AND a.upto - 2 * strlen(a.key) - 17 + 4096 <= b.upto),
  x AS (SELECT file, 0 AS block, n, last, key, before FROM e WHERE n = 1 UNION ALL SELECT e.file, x.block + 1, e.n, e.last, e.key, e.before FROM x JOIN e ON e.file = x.file AND e.n = x.last + 1)
  SELECT x.file, CAST(x.block AS BIGINT) AS block, x.key AS first_key, x.last - x.n + 1 AS entries, CAST(c.upto - x.before + 4 AS BIGINT) AS bytes FROM x JOIN c ON c.file = x.file AND c.n = x.last""")
def lsm_block_layout(spark, sf):
    rows = order_keys(spark, sf).select(F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(16)).alias("file"), "key", F.col("key").alias("value"))
    return layers.block_layout(rows, codec.BLOCK_TARGET_BYTES)


V = f"""v AS (SELECT CAST('0x' || substr(md5(n || '-' || i), 1, 8) AS BIGINT) AS hash, n AS node_id, CAST(i AS INTEGER) AS vnode
  FROM (SELECT unnest(['node1', 'node2', 'node3']) AS n), (SELECT unnest(range({VNODES_PER_NODE})) AS i))"""
OWN = """k AS (SELECT 'order-' || o_orderkey AS key, CAST('0x' || substr(md5('order-' || o_orderkey), 1, 8) AS BIGINT) AS hash FROM orders),
  o AS (SELECT k.key, k.hash, coalesce(v.node_id, (SELECT node_id FROM v ORDER BY hash LIMIT 1)) AS owner FROM k ASOF LEFT JOIN v ON k.hash <= v.hash)"""


@query(f"WITH {V} SELECT * FROM v")
def ring_vnodes(spark, sf):
    return placement.vnodes(spark, NODES)


@query(f"WITH {V} SELECT count(DISTINCT node_id) AS nodes, count(*) AS points FROM v")
def ring_node_count(spark, sf):
    return placement.node_count(placement.vnodes(spark, NODES))


@query(f"WITH {V}, {OWN} SELECT key, hash, owner FROM o")
def ring_owner(spark, sf):
    return placement.owners(order_keys(spark, sf), placement.vnodes(spark, NODES)).select("key", "hash", "owner")


@query(f"""WITH {V}, {OWN}, d AS (SELECT o.key, v.node_id, min((v.hash - o.hash + 4294967296) % 4294967296) AS dist FROM o, v GROUP BY ALL),
  p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dist) AS n FROM d)
  SELECT key, max(CASE WHEN n = 1 THEN node_id END) AS primary_node, max(CASE WHEN n = 2 THEN node_id END) AS second_node FROM p WHERE n <= 2 GROUP BY key""")
def ring_preference_list(spark, sf):
    owned = placement.owners(order_keys(spark, sf), placement.vnodes(spark, NODES), 2)
    return owned.select("key", F.col("nodes")[0].alias("primary_node"), F.col("nodes")[1].alias("second_node"))


@query(f"WITH {V}, {OWN} SELECT owner, count(*) AS n_keys, count(*) / sum(count(*)) OVER () AS share FROM o GROUP BY owner")
def ring_distribution(spark, sf):
    return placement.distribution(placement.owners(order_keys(spark, sf), placement.vnodes(spark, NODES)))


@query(f"""WITH {V}, {OWN}, u AS (SELECT * FROM v WHERE node_id <> 'node2'),
  p AS (SELECT o.owner AS old_owner, coalesce(u.node_id, (SELECT node_id FROM u ORDER BY hash LIMIT 1)) AS new_owner FROM o ASOF LEFT JOIN u ON o.hash <= u.hash)
  SELECT old_owner, new_owner, count(*) AS n_keys FROM p GROUP BY ALL""")
def ring_remove_node_movement(spark, sf):
    ring = placement.vnodes(spark, NODES)
    return placement.movement(order_keys(spark, sf), ring, ring.where("node_id <> 'node2'"))


@query(f"""WITH {V}, k AS (SELECT 'node' || (1 + event_id % 3) AS entry_node, CAST('0x' || substr(md5('u' || user_id), 1, 8) AS BIGINT) AS hash FROM events),
  o AS (SELECT entry_node, coalesce(v.node_id, (SELECT node_id FROM v ORDER BY hash LIMIT 1)) AS owner FROM k ASOF LEFT JOIN v ON k.hash <= v.hash)
  SELECT entry_node, owner, entry_node <> owner AS forwarded, count(*) AS n_requests FROM o GROUP BY ALL""")
def ring_routing_report(spark, sf):
    asked = log(spark, sf).select("key", F.concat(F.lit("node"), (F.col("seq") % 3 + 1).cast("string")).alias("entry_node"))
    return placement.routing_report(asked, placement.vnodes(spark, NODES))


@query(f"""WITH {V}, {OWN}, d AS (SELECT o.key, o.owner, v.node_id, min((v.hash - o.hash + 4294967296) % 4294967296) AS dist FROM o, v GROUP BY ALL),
  p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dist) AS n FROM d),
  w AS (SELECT key, owner, bool_and(node_id <> 'node3') AS ok, count(*) AS replicas FROM p WHERE n <= 2 AND node_id <> owner GROUP BY ALL)
  SELECT owner, count(*) AS writes, count(*) FILTER (ok) AS acked, CAST(sum(replicas) AS BIGINT) AS sent FROM w GROUP BY owner""")
def replication_ack_report(spark, sf):
    return placement.ack_report(order_keys(spark, sf), placement.vnodes(spark, NODES), ["node3"])


@query(f"""WITH k AS (SELECT 'order-' || o_orderkey AS key FROM orders), {sql_positions('k', bloom.bloom_bits(10_000))} SELECT key, pos FROM p""")
def bloom_positions(spark, sf):
    from tidemark.functions.hashing import bloom_positions as positions

    return order_keys(spark, sf).select("key", F.explode(positions(F.col("key"), bloom.bloom_bits(10_000))).alias("pos"))


def absent_keys(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("absent-"), F.col("c_custkey").cast("string")).alias("key"))


BLOOM_KEYS = """k AS (SELECT 'order-' || o_orderkey AS key, true AS member FROM orders UNION ALL SELECT 'absent-' || c_custkey, false FROM customer)"""


def sql_probed(size: int | str) -> str:
    return f"""{BLOOM_KEYS}, {sql_positions('k', size)}, s AS (SELECT DISTINCT pos FROM p JOIN k USING (key) WHERE member),
  q AS (SELECT k.member, k.key, bool_and(s.pos IS NOT NULL) AS maybe FROM k JOIN p USING (key) LEFT JOIN s ON s.pos = p.pos GROUP BY ALL)"""


@query(f"WITH {sql_probed(bloom.bloom_bits(15_000))} SELECT count(*) FILTER (maybe) AS false_positives, count(*) AS probes FROM q WHERE NOT member")
def bloom_fpr(spark, sf):
    """Order keys in the filter, as many bits for them as 15,000 keys take; keys of customers, none of them in it, are asked for."""
    return bloom.false_positive_rate(order_keys(spark, sf), absent_keys(spark, sf), 15_000)


@query(f"WITH {sql_probed('(SELECT (greatest(1, count(DISTINCT key)) * 10 + 7) // 8 * 8 FROM k WHERE member)')} SELECT key, maybe FROM q")
def bloom_might_contain(spark, sf):
    """Order keys and keys of customers, which are not in the filter, are asked for; it has ten bits for each distinct order key."""
    members = order_keys(spark, sf)
    size = bloom.bits_for(members)
    return bloom.might_contain(members.unionByName(absent_keys(spark, sf)), bloom.set_bits(members, size), size)


@query(f"""WITH {M}, {CRC_TABLE}, f AS (SELECT seq, CASE op WHEN 'put' THEN '01' ELSE '02' END || printf('%08X', strlen(key)) || hex(encode(key)) || printf('%08X', strlen(coalesce(value, ''))) || hex(encode(coalesce(value, ''))) AS body FROM m)
  SELECT seq, body || printf('%08X', {sql_crc32("list_transform(range(length(body) // 2), lambda i : CAST('0x' || substr(body, 2 * i + 1, 2) AS BIGINT))")}) AS frame FROM f, crc""")
def wal_frames(spark, sf):
    m = log(spark, sf)
    return m.select("seq", codec.log_frame(F.col("op"), F.col("key"), F.col("value")).alias("frame")).select("seq", F.hex("frame").alias("frame"))


def replayed(spark, sf):
    """Round trip: each mutation is framed natively and decoded again by the log reader, as if it were a file."""
    from tidemark import schemas
    from tidemark.sources import files

    framed = log(spark, sf).select(F.lit("wal-1.log").alias("path"), F.col("seq"), codec.log_frame(F.col("op"), F.col("key"), F.col("value")).alias("content"))
    frames = framed.mapInArrow(files._frames, schemas.LOG_FRAME)
    return frames.select(F.lit(0).cast("bigint").alias("epoch"), F.col("file_seq").alias("seq"), "key", "op", F.when(F.col("op") == "put", F.col("value").cast("string")).alias("value"))


@query(f"""WITH {M} SELECT seq, key, op, CASE WHEN op = 'put' THEN value END AS value FROM m""")
def wal_replay(spark, sf):
    return replayed(spark, sf).select("seq", "key", "op", "value")


@query(f"WITH {R} SELECT key, value, seq FROM r WHERE rn = 1 AND op = 'put'")
def wal_replayed_state(spark, sf):
    """The log read back into the state it stood for."""
    return mutations.current_state(replayed(spark, sf)).select("key", "value", "seq")


def newest_entries(spark, sf):
    return mutations.latest(log(spark, sf)).select("key", "value", (F.col("op") == "delete").alias("tombstone"), "seq")


@query(f"WITH {R} SELECT key, coalesce(value, '') AS value, op = 'delete' AS tombstone, seq FROM r WHERE rn = 1")
def lsm_sorted_file_round_trip(spark, sf):
    """Newest entries written as indexed files and read back block by block."""
    from tidemark.sources import files

    return files.entries_of(files.sorted_files(newest_entries(spark, sf))).withColumn("value", F.col("value").cast("string"))


@query(f"WITH {R} SELECT count(*) AS entries, min(key) AS first_key, max(key) AS last_key FROM r WHERE rn = 1")
def lsm_sorted_file_bounds(spark, sf):
    from tidemark.sources import files

    return files.sorted_files(newest_entries(spark, sf)).agg(F.sum("entries").alias("entries"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))


@query(f"""WITH {M}, t AS (SELECT key, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS tick, op, value,
    row_number() OVER (PARTITION BY key, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY seq DESC) AS n FROM m),
  x AS (SELECT key, tick, op, value, lag(op) OVER w AS b,
    last_value(CASE WHEN op = 'put' THEN struct_pack(v := value) END IGNORE NULLS) OVER (PARTITION BY key ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s
    FROM t WHERE n = 1 WINDOW w AS (PARTITION BY key ORDER BY tick))
  SELECT key, strftime(tick, '%Y-%m-%d %H:%M') AS tick, CASE op WHEN 'put' THEN 'value' ELSE 'deleted' END AS change, CASE WHEN op = 'put' THEN value END AS value FROM x
  WHERE (op = 'put' AND (s IS NULL OR s.v IS DISTINCT FROM value)) OR (op = 'delete' AND s IS NOT NULL AND b = 'put')""")
def watch_changes(spark, sf):
    return watch.watch_changes(log(spark, sf)).withColumn("tick", F.date_format("tick", "yyyy-MM-dd HH:mm"))


@query("""WITH s AS (SELECT date_trunc('day', ts) AS tick, event_type AS metric, count(*) AS n FROM events GROUP BY ALL),
  c AS (SELECT strftime(tick, '%Y-%m-%d') AS tick, metric, CAST(sum(n) OVER (PARTITION BY metric ORDER BY tick) AS BIGINT) AS value FROM s)
  SELECT tick, metric, value, value - coalesce(lag(value) OVER (PARTITION BY metric ORDER BY tick), 0) AS delta FROM c""")
def metrics_watch_deltas(spark, sf):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf}/events.parquet")
    n = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("tick"), F.col("event_type").alias("metric")).agg(F.count("*").alias("n"))
    running = n.select("tick", "metric", F.sum("n").over(Window.partitionBy("metric").orderBy("tick")).alias("value"))
    return watch.counter_deltas(running)


RAFT = """q AS (SELECT 'n' || user_id % 5 AS voter, event_id AS ord, 1 + event_id // 40 AS term, 'c' || (event_id % 4) AS candidate,
  event_id % 13 AS last_log_index, event_id % 7 AS last_log_term FROM events)"""


def votes(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.concat(F.lit("n"), (F.col("user_id") % 5).cast("string")).alias("voter"), F.col("event_id").alias("ord"),
                    (F.floor(F.col("event_id") / 40) + 1).cast("bigint").alias("term"), F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string")).alias("candidate"),
                    (F.col("event_id") % 13).alias("last_log_index"), (F.col("event_id") % 7).alias("last_log_term"))


VOTED = f"""{RAFT}, ok AS (SELECT *, last_log_term > 3 OR (last_log_term = 3 AND last_log_index >= 5) AS up FROM q),
  f AS (SELECT voter, term, arg_min(candidate, ord) AS vote FROM ok WHERE up GROUP BY ALL),
  g AS (SELECT ok.voter, ok.ord, ok.term, ok.candidate, ok.up AND ok.candidate = f.vote AS granted FROM ok LEFT JOIN f ON f.voter = ok.voter AND f.term = ok.term)"""


@query(f"WITH {VOTED} SELECT voter, ord, term, candidate, coalesce(granted, false) AS granted FROM g")
def raft_votes(spark, sf):
    return consensus.vote_fold(votes(spark, sf), 0, 3, 5).select("voter", "ord", "term", "candidate", "granted")


@query(f"WITH {VOTED} SELECT term, candidate, count(*) FILTER (granted) AS votes, count(*) FILTER (granted) + 1 >= 3 AS won FROM g GROUP BY ALL")
def raft_vote_quorum(spark, sf):
    return consensus.vote_quorum(consensus.vote_fold(votes(spark, sf), 0, 3, 5), 4)


@query(f"WITH {RAFT} SELECT voter, ord, (last_log_term, last_log_index) >= (3, 5) AS up_to_date FROM q")
def raft_log_up_to_date(spark, sf):
    ok = consensus.log_up_to_date(F.col("last_log_term"), F.col("last_log_index"), F.lit(3).cast("bigint"), F.lit(5).cast("bigint"))
    return votes(spark, sf).select("voter", "ord", ok.alias("up_to_date"))


@query("""SELECT event_id AS ord, event_id % 300 >= 150 AND event_id % 9 > 4 AND (event_id % 7, event_id % 13) >= (3, 5) AS granted FROM events""")
def raft_prevote_decision(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    i = F.col("event_id")
    asked = e.select(i.alias("ord"), (i % 300).alias("silent_ms"), (i % 9).alias("next_term"), F.lit(4).alias("current_term"), (i % 7).alias("last_log_term"),
                     (i % 13).alias("last_log_index"), F.lit(3).cast("bigint").alias("my_log_term"), F.lit(5).cast("bigint").alias("my_log_index"))
    return consensus.prevote_decision(asked).select("ord", "granted")


@query("""WITH r AS (SELECT 'n' || user_id % 5 AS node, event_id AS ord, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS role, event_id // 40 AS term FROM events),
  l AS (SELECT *, lag(role) OVER w AS pr, lag(term) OVER w AS pt FROM r WINDOW w AS (PARTITION BY node ORDER BY ord))
  SELECT node, ord, CASE role WHEN 0 THEN 'follower' WHEN 1 THEN 'candidate' ELSE 'leader' END AS role, term FROM l WHERE pr IS DISTINCT FROM role OR pt IS DISTINCT FROM term""")
def raft_leader_timeline(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    code = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).otherwise(0)
    roles = e.select(F.concat(F.lit("n"), (F.col("user_id") % 5).cast("string")).alias("node"), F.col("event_id").alias("ord"),
                     consensus.role_name(code).alias("role"), F.floor(F.col("event_id") / 40).cast("bigint").alias("term"))
    return consensus.leader_timeline(roles)


@query(f"WITH {M} SELECT seq AS idx, seq // 100 AS term, op, key, seq - 301 AS slot FROM m WHERE seq > 300")
def raft_snapshot_cut(spark, sf):
    entries = log(spark, sf).select(F.col("seq").alias("idx"), F.floor(F.col("seq") / 100).cast("bigint").alias("term"), "op", "key")
    return consensus.snapshot_cut(entries, 300)


@query("""WITH a AS (SELECT 'n' || user_id % 5 AS node, event_id AS ord, 1 + event_id // 40 - CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END AS term FROM events),
  s AS (SELECT *, greatest(coalesce(max(term) OVER (PARTITION BY node ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS seen FROM a)
  SELECT node, ord, term, greatest(seen, term) AS current_term, term >= seen AS success FROM s""")
def raft_append_entries(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    term = (F.floor(F.col("event_id") / 40) + 1 - F.when(F.col("event_id") % 11 == 0, 2).otherwise(0)).cast("bigint")
    return consensus.append_fold(e.select(F.concat(F.lit("n"), (F.col("user_id") % 5).cast("string")).alias("node"), F.col("event_id").alias("ord"), term.alias("term")))


@query(f"""WITH {M}, r AS (SELECT key, arg_max(op, seq) AS op, arg_max(coalesce(value, '~'), seq) AS value FROM m GROUP BY key)
  SELECT key, value FROM r WHERE op = 'put'""")
def raft_applied_state(spark, sf):
    entries = log(spark, sf).select(F.col("seq").alias("idx"), "op", "key", F.coalesce("value", F.lit("~")).alias("value"))
    return consensus.applied_state(entries)


@query(f"""WITH {M}, r AS (SELECT key, arg_max(op, seq) AS op, arg_max(coalesce(value, '~'), seq) AS value FROM m GROUP BY key)
  SELECT key, value FROM r WHERE op = 'put'""")
def raft_restored_state(spark, sf):
    """A snapshot of half of the log, and the entries after it: the state of the whole log."""
    entries = log(spark, sf).select(F.col("seq").alias("idx"), "op", "key", F.coalesce("value", F.lit("~")).alias("value"))
    cut = mutations.half_way(log(spark, sf))
    return consensus.restored(entries, consensus.applied_state(entries.where(F.col("idx") <= cut)), cut)


@query(f"WITH {M} SELECT max(seq) AS last_index, arg_max(seq // 100, seq) AS last_term FROM m WHERE seq > (SELECT max(seq) // 2 FROM m)")
def raft_last_index(spark, sf):
    entries = log(spark, sf).select(F.col("seq").alias("idx"), F.floor(F.col("seq") / 100).cast("bigint").alias("term"))
    cut = mutations.half_way(log(spark, sf))
    return consensus.last_index(consensus.snapshot_cut(entries, cut), cut, 0)


@query("""SELECT event_id AS ord, event_id % 7 >= event_id % 5 AS accepted, event_id % 7 >= event_id % 5 AND event_id % 90 > event_id % 40 AS installed,
  greatest(event_id % 7, event_id % 5) AS new_term, CASE WHEN event_id % 7 >= event_id % 5 AND event_id % 90 > event_id % 40 THEN event_id % 90 ELSE event_id % 40 END AS new_start FROM events""")
def raft_install_snapshot(spark, sf):
    i = F.col("event_id")
    asked = spark.read.parquet(f"{sf}/events.parquet").select(i.alias("ord"), (i % 7).alias("term"), (i % 5).alias("current_term"), (i % 90).alias("snap_last_index"), (i % 40).alias("log_start"))
    return consensus.install_snapshot(asked).select("ord", "accepted", "installed", "new_term", "new_start")


@query(f"""WITH {RAFT}, pv AS (SELECT candidate, term, count(*) FILTER (ord % 300 >= 150 AND term > 4 AND (last_log_term, last_log_index) >= (3, 5)) AS prevotes FROM q GROUP BY ALL HAVING prevotes + 1 >= 3),
  ok AS (SELECT q.*, last_log_term > 3 OR (last_log_term = 3 AND last_log_index >= 5) AS up FROM q JOIN pv USING (candidate, term)),
  f AS (SELECT voter, term, arg_min(candidate, ord) AS vote FROM ok WHERE up GROUP BY ALL),
  g AS (SELECT ok.candidate, ok.term, count(*) FILTER (ok.up AND ok.candidate = f.vote) AS votes FROM ok LEFT JOIN f ON f.voter = ok.voter AND f.term = ok.term GROUP BY ALL)
  SELECT pv.term, pv.candidate, pv.prevotes, coalesce(g.votes, 0) AS votes, coalesce(g.votes, 0) + 1 >= 3 AS won FROM pv LEFT JOIN g ON g.candidate = pv.candidate AND g.term = pv.term""")
def raft_election(spark, sf):
    """Pre-vote, votes and quorum of the candidates of each term."""
    q = votes(spark, sf)
    asked = q.select("candidate", F.col("term").alias("next_term"), (F.col("ord") % 300).alias("silent_ms"), F.lit(4).alias("current_term"), "last_log_term", "last_log_index",
                     F.lit(3).cast("bigint").alias("my_log_term"), F.lit(5).cast("bigint").alias("my_log_index"))
    return consensus.election(asked, q, 4, 3, 5)


@query("""SELECT c_custkey AS follower, c_custkey % 50 AS next_index, CASE WHEN c_custkey % 50 <= 20 AND c_custkey % 3 > 0 THEN 'snapshot' ELSE 'heartbeat' END AS send FROM customer""")
def raft_catch_up_plan(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    f = c.select(F.col("c_custkey").alias("follower"), (F.col("c_custkey") % 50).alias("next_index"), F.lit(20).alias("snap_last_index"), (F.col("c_custkey") % 3 > 0).alias("has_snapshot"))
    return consensus.catch_up_plan(f).select("follower", "next_index", "send")


@query("""WITH h AS (SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name AS host FROM nation), s AS (SELECT n_name AS host, CAST(n_regionkey AS BIGINT) AS term FROM nation WHERE n_nationkey % 4 <> 3)
  SELECT h.pos, h.host, CASE WHEN s.host IS NULL THEN '[unreachable]' ELSE 'ok' END AS state, s.term FROM h LEFT JOIN s ON s.host = h.host""")
def status_all_nodes(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    hosts = n.select(F.col("n_nationkey").cast("bigint").alias("pos"), F.col("n_name").alias("host"))
    return metrics.status_all_nodes(hosts, n.where("n_nationkey % 4 <> 3").select(F.col("n_name").alias("host"), F.col("n_regionkey").cast("bigint").alias("term")))


@query(f"""WITH {R}, a AS (SELECT count(*) FILTER (op = 'put') AS p, count(*) FILTER (op = 'delete') AS d, count(*) FILTER (rn = 1 AND op = 'put') AS k, count(*) AS w FROM r)
  SELECT 'put_total' AS metric, p AS value FROM a UNION ALL SELECT 'del_total', d FROM a UNION ALL SELECT 'key_count', k FROM a UNION ALL SELECT 'wal_writes', w FROM a""")
def metrics_long(spark, sf):
    return metrics.metrics_long(log(spark, sf))


@query(f"""WITH {R}, {V}, k AS (SELECT 'node' || (1 + event_id % 3) AS entry_node, CAST('0x' || substr(md5('u' || user_id), 1, 8) AS BIGINT) AS hash FROM events),
  w AS (SELECT entry_node <> coalesce(v.node_id, (SELECT node_id FROM v ORDER BY hash LIMIT 1)) AS forwarded FROM k ASOF LEFT JOIN v ON k.hash <= v.hash),
  {OWN.replace('k AS (', 'ok AS (').replace('FROM k ASOF', 'FROM ok k ASOF')}, d AS (SELECT o.key, o.owner, v.node_id, min((v.hash - o.hash + 4294967296) % 4294967296) AS dist FROM o, v GROUP BY ALL),
  e AS (SELECT key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dist) AS n FROM d) WHERE n <= 2 AND node_id <> owner GROUP BY key HAVING NOT bool_and(node_id <> 'node3')),
  a AS (SELECT count(*) FILTER (op = 'put') AS p, count(*) FILTER (op = 'delete') AS d, count(*) FILTER (rn = 1 AND op = 'put') AS k, count(*) AS w FROM r),
  g AS (SELECT count(*) AS n, count(*) FILTER (s.key IS NULL) AS miss FROM (SELECT DISTINCT 'u' || c_custkey AS key FROM customer) c LEFT JOIN (SELECT key FROM r WHERE rn = 1 AND op = 'put') s USING (key))
  SELECT 'put_total' AS metric, p AS value FROM a UNION ALL SELECT 'del_total', d FROM a UNION ALL SELECT 'key_count', k FROM a UNION ALL SELECT 'wal_writes', w FROM a
  UNION ALL SELECT 'get_total', n FROM g UNION ALL SELECT 'get_miss', miss FROM g UNION ALL SELECT 'forwarded_requests', count(*) FROM w WHERE forwarded
  UNION ALL SELECT 'replication_errors', count(*) FROM e UNION ALL SELECT 'raft_term', max(1 + event_id // 40) FROM events""")
def metrics_all_counters(spark, sf):
    return metrics.all_counters(log(spark, sf), kv_multi_get(spark, sf), ring_routing_report(spark, sf), replication_ack_report(spark, sf), votes(spark, sf))


@query("""WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS name, CASE WHEN c_custkey % 5 = 0 THEN 'f' || c_custkey END AS flag, CASE WHEN c_custkey % 3 = 0 THEN 'e' || c_custkey END AS env,
    CASE WHEN c_custkey % 2 = 0 THEN 'h' || c_custkey END AS home, 'd' AS fallback FROM customer)
  SELECT name, coalesce(flag, env, home, fallback) AS value, CASE WHEN flag IS NOT NULL THEN 'flag' WHEN env IS NOT NULL THEN 'env' WHEN home IS NOT NULL THEN 'home' ELSE 'fallback' END AS source FROM s""")
def config_precedence(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("name"))
    s = c.select("name", F.when(F.col("k") % 5 == 0, F.concat(F.lit("f"), "name")).alias("flag"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("e"), "name")).alias("env"),
                 F.when(F.col("k") % 2 == 0, F.concat(F.lit("h"), "name")).alias("home"), F.lit("d").alias("fallback"))
    return metrics.config_precedence(s, ["flag", "env", "home", "fallback"])
