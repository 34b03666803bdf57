import bisect
import io
import random

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.api import Engine, InvalidInput, NodeConfig, NotFound, exit_code, parse_duration, parse_peers
from tidemark.functions import codec
from tidemark.operators import bloom, consensus, layers, mutations, placement, watch
from tidemark.sources import files
from tidemark.sources.manifest import Conflict, Generations, read_hard_state
from tidemark.streaming import state as streaming

LOG = "epoch bigint, seq bigint, key string, op string, value string"


def random_log(n=400, seed=1):
    r = random.Random(seed)
    return [(i // 200, i % 200, f"k{r.randrange(30)}", *(("put", r.choice(["", "x", "é", "long" * 9])) if r.random() < 0.7 else ("delete", None))) for i in range(n)]


def model(rows):
    live = {}
    for _, _, k, op, v in sorted(rows):
        live[k] = v if op == "put" else None
        if op != "put":
            del live[k]
    return live


def test_state_matches_dict_over_epochs(spark):
    rows = random_log()
    log = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), LOG)
    assert {r.key: r.value for r in mutations.current_state(log).collect()} == model(rows)
    parts = [spark.createDataFrame(rows[i::4], LOG) for i in range(4)]
    assert {r.key: r.value for r in layers.compact(parts).collect()} == model(rows)
    seq = [r for r in rows if (r[0], r[1]) <= (1, 50)]
    assert {r.key: r.value for r in mutations.as_of(log, 50, 1).collect()} == model(seq)


def test_unknown_op_fails(spark):
    with pytest.raises(Exception, match="unknown op"):
        mutations.validated(spark.createDataFrame([(0, 0, "a", "merge", "x")], LOG)).collect()


def test_frames_native_equals_python_and_torn_tails(spark, tmp_path):
    rows = [("put", "ключ", "v"), ("delete", "a", None), ("put", "empty", "")]
    df = spark.createDataFrame(rows, "op string, key string, value string").coalesce(1)
    native = [bytes(r[0]) for r in df.select(codec.log_frame(F.col("op"), F.col("key"), F.col("value"))).collect()]
    assert native == [codec.encode_frame(o, k, (v or "").encode()) for o, k, v in rows]
    good = b"".join(native)
    (tmp_path / "wal-2.log").write_bytes(good + native[0][:-3])
    bad = bytearray(good)
    bad[len(native[0]) + 2] ^= 1
    (tmp_path / "wal-10.log").write_bytes(bytes(bad))
    (tmp_path / "other.txt").write_bytes(b"x")
    got = files.replay(spark, str(tmp_path))
    assert [(r.file_seq, r.ordinal, r.key) for r in got.orderBy("file_seq", "ordinal").collect()] == [(2, 0, "ключ"), (2, 1, "a"), (2, 2, "empty"), (10, 0, "ключ")]
    assert [r.file_seq for r in files.log_files(spark, str(tmp_path)).collect()] == [2, 10]
    assert [r.seq for r in files.as_mutations(got).orderBy("seq").collect()] == [1, 2, 3, 4]
    spark.dataSource.register(files.LogSource)
    assert spark.read.format("mutation_log").option("path", str(tmp_path)).load().count() == 4


def test_sorted_file_round_trip_and_damage(spark, tmp_path):
    rows = [(f"key-{i:06d}", f"val-{i}".encode(), i % 7 == 0, i + 1) for i in range(1000)]
    data = codec.encode_sorted_file(rows, bloom.marshal([r[0].encode() for r in rows], bloom.bloom_bits(1000)))
    (tmp_path / "sst-00000001.sst").write_bytes(data)
    got = [(r.key, bytes(r.value), r.tombstone, r.seq) for r in files.read_sorted_files(spark, str(tmp_path)).orderBy("key").collect()]
    assert got == rows
    index, filt = codec.open_sorted_file(data)
    assert len(index) > 5 and all(bloom.probe(filt, r[0].encode()) for r in rows)
    (tmp_path / "sst-00000002.sst").write_bytes(data[:50] + b"\xff" + data[51:])
    with pytest.raises(Exception, match="checksum"):
        files.read_sorted_files(spark, str(tmp_path)).count()
    with pytest.raises(codec.CorruptData):
        codec.open_sorted_file(b"short")


def test_bloom_bound_and_no_false_negatives(spark):
    members = spark.range(1000).select(F.concat(F.lit("key-"), F.col("id").cast("string")).alias("key"))
    size = bloom.bloom_bits(1000)
    assert bloom.might_contain(members, bloom.set_bits(members, size), size).where("NOT maybe").count() == 0
    with pytest.raises(ValueError):
        bloom.unmarshal(b"123")


def test_ring_edges(spark):
    keys = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "key string")
    assert placement.vnodes(spark, ["a", "a", "b"]).count() == 300
    assert {r.owner for r in placement.owners(keys, placement.vnodes(spark, ["solo"])).collect()} == {"solo"}
    assert [r.owner for r in placement.owners(keys, placement.vnodes(spark, ["x"]).limit(0)).collect()] == [None] * 3
    for r in placement.owners(keys, placement.vnodes(spark, ["a", "b", "c"]), 2).collect():
        assert len(set(r.nodes)) == 2


def test_votes(spark):
    rows = [("v", 1, 5, "a", 9, 9), ("v", 2, 5, "b", 9, 9), ("v", 3, 5, "a", 9, 9), ("v", 4, 4, "b", 9, 9), ("v", 5, 6, "b", 1, 1), ("v", 6, 6, "c", 9, 9)]
    asked = spark.createDataFrame(rows, "voter string, ord bigint, term bigint, candidate string, last_log_index bigint, last_log_term bigint")
    votes = consensus.vote_fold(asked, 0, 2, 2)
    assert [r.granted for r in votes.orderBy("ord").collect()] == [True, False, True, False, False, True]
    assert consensus.double_votes(votes).count() == 0
    assert spark.range(1).select(consensus.quorum(4)).first()[0] == 3


def test_watch_reappearance(spark):
    rows = [(0, 1, "a", "put", "x", "2024-01-01 00:10:00"), (0, 2, "a", "delete", None, "2024-01-01 01:10:00"), (0, 3, "a", "put", "x", "2024-01-01 02:10:00"),
            (0, 4, "b", "delete", None, "2024-01-01 00:10:00")]
    log = spark.createDataFrame(rows, LOG + ", t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert [r.change for r in watch.watch_changes(log).orderBy("tick").collect()] == ["value", "deleted"]
    assert [r.change for r in watch.watch_changes(log, reemit_after_delete=True).orderBy("tick").collect()] == ["value", "deleted", "value"]


def test_engine_lifecycle(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "t"))
    kv = lambda *rows: spark.createDataFrame(list(rows), "key string, value string")
    e.put(kv(("a", "1"), ("b", "")))
    e.put(kv(("a", "2"), ("c", "3")))
    assert e.get("a") == "2" and e.get("b") == ""
    assert [r.key for r in e.delete(kv(("c", None), ("zz", None)).select("key")).collect()] == ["zz"]
    with pytest.raises(NotFound):
        e.get("c")
    again = Engine(spark, str(tmp_path / "t"))
    assert again.epoch == 1
    again.put(kv(("a", "newer")))
    assert again.get("a") == "newer" and len(again.table.live()) == 4
    assert not again.load_snapshot(str(tmp_path / "snap")).found
    again.snapshot(str(tmp_path / "snap"), 7, 2)
    again.snapshot(str(tmp_path / "snap"), 9, 3)
    assert again.compact() and len(again.table.live()) == 1 and len(again.table.vacuum()) == 4
    assert {r.key: r.value for r in again.state().collect()} == {"a": "newer", "b": ""}
    again.restore(kv(("r", "1")))
    assert [r.key for r in again.state().collect()] == ["r"]
    saved = again.load_snapshot(str(tmp_path / "snap"))
    assert saved[:3] == (True, 9, 3)
    again.restore(saved.rows)
    assert again.status().first().key_count == 2
    with pytest.raises(InvalidInput):
        again.put(kv(("", "x")))
    with pytest.raises(Conflict):
        Generations(spark, str(tmp_path / "t")).publish(0, [])
    out = io.StringIO()
    assert cli.main(["--root", str(tmp_path / "t"), "get", "a"], spark, out) == 0 and out.getvalue() == "newer\n"
    assert cli.main(["--root", str(tmp_path / "t"), "get", "nope"], spark, out) == 2
    assert read_hard_state(spark, str(tmp_path / "none.json")).first().current_term == 0


def test_writes_of_many_partitions_have_one_order(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "t"))
    rows = spark.range(200).repartition(200).selectExpr("concat('k', id) as key", "string(id) as value")
    e.put(rows)
    e.put(rows.selectExpr("key", "concat(value, '!') as value"))
    assert e.log().select("key", "seq").distinct().count() == 400
    assert {r.value for r in e.state().collect()} == {f"{i}!" for i in range(200)}
    with pytest.raises(InvalidInput, match="more than once"):
        e.put(rows.unionByName(rows))


def test_delete_of_an_absent_key_writes_nothing(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "t"))
    e.put(spark.createDataFrame([("a", "1")], "key string, value string"))
    assert [r.key for r in e.delete(spark.createDataFrame([("b",)], "key string")).collect()] == ["b"]
    assert e.log().count() == 1 and len(e.table.live()) == 1
    assert e.delete(spark.createDataFrame([("a",)], "key string")).count() == 0 and e.state().count() == 0


def test_sink_writes_a_retried_batch_once(spark, tmp_path):
    table = Generations(spark, str(tmp_path / "g"))
    write = streaming.sink_generations(table)
    batch = spark.createDataFrame([(0, 1, "a", "put", "x")], LOG)
    write(batch, 7)
    write(batch, 7)
    assert len(table.live()) == 1
    write(batch, 8)
    streaming.sink_generations(table, "other")(batch, 8)
    assert len(table.live()) == 3


def test_large_rings_join_without_a_broadcast(spark, monkeypatch):
    keys = spark.range(300).selectExpr("concat('k', id) as key")
    ring = placement.vnodes(spark, ["a", "b", "c"])
    want = {r.key: r.nodes for r in placement.owners(keys, ring, 3).collect()}
    monkeypatch.setattr(placement, "MAX_BROADCAST_NODES", 2)
    got = placement.owners(keys, ring, 3)
    assert {r.key: r.nodes for r in got.collect()} == want and all(sorted(n) == ["a", "b", "c"] for n in want.values())


def test_sorted_files_of_many_tasks(spark):
    rows = [(f"key-{i:06d}", f"val-{i}", i % 7 == 0, i + 1) for i in range(3000)]
    entries = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "key string, value string, tombstone boolean, seq bigint")
    made = files.sorted_files(entries, file_bytes=8000).cache()
    spans = sorted((r.first_key, r.last_key) for r in made.select("first_key", "last_key").collect())
    assert len(spans) > 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sorted((r.key, r.value.decode(), r.tombstone, r.seq) for r in files.entries_of(made).collect()) == rows
    assert files.sorted_files(entries.limit(0)).count() == 0


def test_watch_stream_ticks(spark, tmp_path):
    rows = [(0, i, f"k{i % 3}", "put" if i % 4 else "delete", str(i) if i % 4 else None, f"2024-01-01 {i // 4:02d}:{i % 4}0:00") for i in range(40)]
    log = spark.createDataFrame(rows, LOG + ", t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    q = streaming.watch_stream(stream).writeStream.format("memory").queryName("ticks").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {tuple(r) for r in watch.changes(spark.table("ticks")).collect()}
    want = {tuple(r) for r in watch.watch_changes(log).collect()}
    last = max(r[1] for r in want)
    assert got and {r for r in want if r[1] < last} <= got <= want


def test_command_line(spark, tmp_path):
    root, kept = str(tmp_path / "t"), tmp_path / "settings.json"

    def run(*args, answer="n"):
        out = io.StringIO()
        code = cli.main(list(args), spark, out, lambda _: answer, kept)
        return code, out.getvalue()

    assert run("config", "set", "root", root)[0] == 0 and f"root\t{root}\n" in run("config", "show")[1]
    assert run("config", "set", "nonsense", "1")[0] == 4
    for k in ("b", "a", "c"):
        assert run("put", k, k * 2)[0] == 0
    assert run("scan", "--start", "b") == (0, "b\tbb\nc\tcc\n") and run("--json", "scan", "--prefix", "a") == (0, '{"key": "a", "value": "aa"}\n')
    assert run("delete", "a") == (0, "Aborted\n") and run("get", "a") == (0, "aa\n")
    assert run("delete", "a", answer="y") == (0, 'Deleted "a"\n') and run("get", "a")[0] == 2 and run("delete", "a", "--force")[0] == 2
    lines = run("status", "--all", str(tmp_path / "none"), root)[1].splitlines()
    assert "[unreachable]" in lines[0] and lines[1].split("\t")[:2] == [root, "ok"] and lines[1].endswith("\t2")


def test_config():
    with pytest.raises(InvalidInput, match="HTTP_ADDR, GRPC_ADDR, DATA_DIR"):
        NodeConfig.from_env({"NODE_ID": "n"})
    base = {"NODE_ID": "n", "HTTP_ADDR": "h", "GRPC_ADDR": "g", "DATA_DIR": "d"}
    conf = NodeConfig.from_env(base | {"PEERS": "a=1:2, b=3:4", "HEARTBEAT_INTERVAL": "1m30s"})
    assert conf.peers == [("a", "1:2"), ("b", "3:4")] and conf.heartbeat == 90
    for bad in ("x", "5", "ms"):
        with pytest.raises(InvalidInput):
            parse_duration(bad)
    with pytest.raises(InvalidInput):
        parse_peers("a")
    assert exit_code(None) == 0 and exit_code(NotFound("k")) == 2 and exit_code(OSError()) == 1


def test_streams_equal_batch(spark, tmp_path):
    rows = random_log(300, 5)
    random.Random(3).shuffle(rows)
    for i in range(3):
        spark.createDataFrame(rows[i::3], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = Generations(spark, str(tmp_path / "gens"))
    q = read().writeStream.foreachBatch(streaming.sink_generations(table)).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.key: r.value for r in mutations.current_state(table.read()).collect()} == model(rows)
    q = streaming.stream_updates(read()).writeStream.format("memory").queryName("updates").outputMode("update").option(
        "checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    last = spark.sql("SELECT key, max_by(struct(alive, value), struct(epoch, seq)) e FROM updates GROUP BY key")
    assert {r.key: r.e.value for r in last.collect() if r.e.alive} == model(rows)


def test_bloom_probes_are_looked_up_in_bytes_or_joined_alike(spark, monkeypatch):
    """No row for each position is joined or kept by key; larger filters, which are joined, say the same."""
    members = spark.createDataFrame([(f"k{i}",) for i in range(5000)], "key string")
    probes = members.unionByName(spark.createDataFrame([(f"x{i}",) for i in range(3000)] + [("k1",), ("",), (None,)], "key string"))
    size = bloom.bloom_bits(5000)
    bits = bloom.set_bits(members, size)
    found = bloom.might_contain(probes, bits, size)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.key: r.maybe for r in found.collect()}
    packed = bloom.marshal([f"k{i}".encode() for i in range(5000)], size)
    assert got == {k: bloom.probe(packed, k.encode()) for k in [*(f"k{i}" for i in range(5000)), *(f"x{i}" for i in range(3000)), ""]}
    monkeypatch.setattr(bloom, "MAX_BROADCAST_BITS", 0)
    assert {r.key: r.maybe for r in bloom.might_contain(probes, bits, size).collect()} == got
    assert bloom.might_contain(probes, bits.limit(0), size).where("maybe").count() == 0


def test_block_lookup_deals_ranges_of_keys(spark):
    """Rightmost blocks at or below keys, across ranges without blocks; one file's keys are not all in one partition."""
    starts = {0: [f"k{i:05d}" for i in range(100, 4000, 37)], 1: ["k02000"]}
    index = spark.createDataFrame([(f, k, i) for f, ks in starts.items() for i, k in enumerate(ks)], "file bigint, first_key string, block bigint")
    asked = [f"k{i:05d}" for i in range(0, 6000)]
    found = layers.block_index_lookup(index, spark.createDataFrame([(k,) for k in asked + asked[:9]], "key string"))
    rows = found.withColumn("p", F.spark_partition_id()).collect()
    want = {(f, k): bisect.bisect_right(ks, k) - 1 for f, ks in starts.items() for k in asked}
    assert len(rows) == len(want) and {(r.file, r.key): -1 if r.block is None else r.block for r in rows} == want
    assert len({r.p for r in rows if r.file == 0}) > 1


def test_bloom_filter_of_the_query_is_as_large_as_its_keys_need(spark, tmp_path):
    """60,000 order keys, some repeated, one null; the share of false positives stays that of ten bits a key, and the SQL says the same."""
    from tests.oracle import connect, same
    from tidemark.plans.catalogue import ORACLE, QUERIES

    ids = F.when(F.col("id") < 60_000, F.col("id")).when(F.col("id") < 63_000, F.col("id") - 60_000)
    spark.range(63_001).select(ids.alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(6_000).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["bloom_might_contain"](spark, str(tmp_path))
    said = {(r.member, r.maybe): r["count"] for r in found.groupBy(F.col("key").startswith("order-").alias("member"), "maybe").count().collect()}
    assert said[True, True] == 60_000 and (True, False) not in said
    assert said[False, True] + said[False, False] == 6_000 and said[False, True] <= 0.05 * 6_000
    same(found, ORACLE["bloom_might_contain"], connect(str(tmp_path)))
    spark.range(0).select(F.col("id").alias("o_orderkey")).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert [r.maybe for r in QUERIES["bloom_might_contain"](spark, str(tmp_path)).select("maybe").distinct().collect()] == [False]


def test_bloom_filters_larger_than_a_broadcast_are_looked_up_in_pieces(spark, monkeypatch):
    """Several pieces, copies of them, units in a task and keys held; the bytes are those of the byte form, and the answers those of the whole filter."""
    members = spark.range(150_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    probes = members.unionByName(spark.range(180_000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("key")))
    size = bloom.bits_for(members.unionByName(members.limit(10)))
    assert size == bloom.bloom_bits(150_000)
    monkeypatch.setattr(bloom, "PIECE_BITS", 1 << 16)
    monkeypatch.setattr(bloom, "HELD_POSITIONS", 1 << 18)
    bits = bloom.set_bits(members, size)
    assert bloom.bitmap(bits, size).tobytes() == bloom.marshal([f"k{i}".encode() for i in range(150_000)], size)[9:]
    small = bloom.bloom_bits(1_000)
    assert bloom.bitmap(bloom.set_bits(members, small), small).tobytes() == bloom.marshal([f"k{i}".encode() for i in range(150_000)], small)[9:]
    want = {r.key: r.maybe for r in bloom.might_contain(probes, bits, size).collect()}
    assert len(want) == 330_000 and all(want[f"k{i}"] for i in range(150_000)) and 0 < sum(want.values()) - 150_000 < 0.05 * 180_000
    monkeypatch.setattr(bloom, "MAX_BROADCAST_BITS", 0)
    for rows in (250_000, 5_000):
        monkeypatch.setattr(bloom, "TASK_ROWS", rows)
        got = bloom.might_contain(probes, bits, size)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r.key: r.maybe for r in got.collect()} == want
    assert bloom.might_contain(probes, bits.limit(0), size).where("maybe").count() == 0
    assert bloom.might_contain(probes.limit(0), bits, size).count() == 0
