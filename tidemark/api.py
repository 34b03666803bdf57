"""The engine's facade: puts, gets, deletes, snapshots, compaction, status and metrics over a table."""

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import layers, metrics, mutations
from tidemark.sources.manifest import Generations, Snapshot, Snapshots


class NotFound(KeyError):
    """The key has no live value."""


class InvalidInput(ValueError):
    """A request the engine does not accept."""


class Unreachable(ConnectionError):
    """A node cannot be asked."""


class ServerError(RuntimeError):
    """The engine failed."""


#: Exit codes by error.
EXIT_CODES = {None: 0, ServerError: 1, NotFound: 2, Unreachable: 3, InvalidInput: 4, KeyboardInterrupt: 5}


def exit_code(error: BaseException | None) -> int:
    if error is None:
        return 0
    return next((code for kind, code in EXIT_CODES.items() if kind and isinstance(error, kind)), 1)


class Engine:
    def __init__(self, spark: SparkSession, root: str, epoch: int | None = None):
        self.spark, self.table = spark, Generations(spark, root)
        top = self.table.read().agg(F.max("epoch"), F.max(F.struct("epoch", "seq"))["seq"]).first()
        self.epoch = epoch if epoch is not None else (0 if top[0] is None else top[0] + 1)
        self.seq = 0

    def put(self, rows: DataFrame) -> None:
        """Appends (key, value) rows as one generation; a null value is stored as empty, not as a delete."""
        self._append(rows.select("key", F.lit("put").alias("op"), F.coalesce("value", F.lit("")).alias("value")))

    def delete(self, keys: DataFrame) -> DataFrame:
        """Appends tombstones for the keys that are alive, if any is, and returns those that are not."""
        wanted, before = keys.select("key").distinct(), self.state()
        alive = wanted.join(before, "key", "left_semi")
        if not alive.isEmpty():
            self._append(alive.select("key", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("value")))
        return wanted.join(before, "key", "left_anti").select("key")

    def _append(self, rows: DataFrame) -> None:
        """One generation under one sequence number; nothing would order two rows of a key, so these are refused."""
        per_key = rows.groupBy("key").agg(F.count("*").alias("n"))
        bad, twice = per_key.agg(F.count_if(F.expr("key IS NULL OR key = ''")), F.count_if(F.col("n") > 1)).first()
        if bad:
            raise InvalidInput("a key is null or empty")
        if twice:
            raise InvalidInput(f"{twice} keys occur more than once in one write")
        self.table.append(self._numbered(rows))

    def _numbered(self, rows: DataFrame) -> DataFrame:
        self.seq += 1
        return rows.select(F.lit(self.epoch).cast("bigint").alias("epoch"), F.lit(self.seq).cast("bigint").alias("seq"), "key", "op", "value")

    def log(self) -> DataFrame:
        return self.table.read()

    def state(self) -> DataFrame:
        return mutations.current_state(self.log())

    def get(self, key: str) -> str:
        row = mutations.point_get(self.log(), key).select("value").first()
        if row is None:
            raise NotFound(key)
        return row[0]

    def get_many(self, keys: DataFrame) -> DataFrame:
        return mutations.multi_get(self.log(), keys)

    def compact(self, force: bool = False) -> bool:
        """Merges all generations into one if there are enough; the inputs stay until vacuum()."""
        old = self.table.live()
        if not old or not (force or layers.should_compact(len(old))):
            return False
        live = mutations.current_state(self.log()).select("epoch", "seq", "key", F.lit("put").alias("op"), "value")
        self.table.replace(live, old)
        return True

    def snapshot(self, path: str, last_index: int = 0, last_term: int = 0) -> None:
        """Saves the state under `path`; a reader sees the snapshot before it or this one, whole."""
        Snapshots(self.spark, path).save(self.state(), last_index, last_term)

    def load_snapshot(self, path: str) -> Snapshot:
        return Snapshots(self.spark, path).load()

    def restore(self, snapshot: DataFrame) -> None:
        """Replaces the whole state; readers see either the old or the new one."""
        old = self.table.live()
        self.table.replace(self._numbered(snapshot.select("key", F.lit("put").alias("op"), "value")), old)

    def metrics(self) -> DataFrame:
        return metrics.metrics_long(self.log())

    def status(self, node_id: str = "local") -> DataFrame:
        return self.state().agg(F.count("*").alias("key_count")).select(F.lit(node_id).alias("node_id"), F.lit("leader").alias("role"),
                                                                        F.lit(self.epoch).cast("bigint").alias("term"), "key_count")


def parse_peers(text: str) -> list[tuple[str, str]]:
    """`id=addr,id=addr`; empty parts are skipped."""
    peers = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, sep, addr = part.partition("=")
        if not sep or not name or not addr:
            raise InvalidInput(f"peer {part!r} is not id=addr")
        peers.append((name.strip(), addr.strip()))
    return peers


def parse_duration(text: str) -> float:
    """Seconds of `150ms`, `2s`, `1m30s`."""
    units = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise InvalidInput(f"duration {text!r}")
    return sum(float(n) * units[u] for n, u in parts)


@dataclass
class NodeConfig:
    node_id: str
    http_addr: str
    grpc_addr: str
    data_dir: str
    peers: list[tuple[str, str]] = field(default_factory=list)
    replica_count: int = 2
    election_timeout_min: float = 0.150
    election_timeout_max: float = 0.300
    heartbeat: float = 0.075

    @classmethod
    def from_env(cls, env: dict | None = None) -> "NodeConfig":
        """Reads a node's settings; all missing names are reported at once."""
        env = dict(os.environ) if env is None else env
        needed = ["NODE_ID", "HTTP_ADDR", "GRPC_ADDR", "DATA_DIR"]
        if missing := [n for n in needed if not env.get(n)]:
            raise InvalidInput("missing settings: " + ", ".join(missing))
        conf = cls(*(env[n] for n in needed), peers=parse_peers(env.get("PEERS", "")))
        if text := env.get("REPLICA_COUNT"):
            if not text.isdigit() or int(text) < 1:
                raise InvalidInput(f"REPLICA_COUNT {text!r}")
            conf.replica_count = int(text)
        for name, attr in (("ELECTION_TIMEOUT_MIN", "election_timeout_min"), ("ELECTION_TIMEOUT_MAX", "election_timeout_max"), ("HEARTBEAT_INTERVAL", "heartbeat")):
            if text := env.get(name):
                setattr(conf, attr, parse_duration(text))
        if conf.election_timeout_min > conf.election_timeout_max:
            raise InvalidInput("the least election timeout is above the greatest")
        return conf
