"""Bloom filters as bytes in pieces: build, probe, measure, and the byte form."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import BLOOM_BITS_PER_KEY, BLOOM_HASHES, bloom_positions_of
from tidemark.operators.keys import TASK_ROWS, distinct_rows, tasks_for

#: Bits of a piece of a filter (512 KB), and of a filter that is sent to every worker at most (16 MB).
PIECE_BITS = 1 << 22
MAX_BROADCAST_BITS = 1 << 27
#: Keys (their numbers have two bytes) and bytes of them that are looked at together, and positions that are held before they are sent on.
UNIT_KEYS = 1 << 16
UNIT_BYTES = 1 << 24
HELD_POSITIONS = 1 << 21


def bloom_bits(n_keys: int) -> int:
    """Filter size in bits: ten a key, whole bytes, at least one key."""
    return (max(1, n_keys) * BLOOM_BITS_PER_KEY + 7) // 8 * 8


def bits_for(keys: DataFrame) -> int:
    """Size of a filter that is to hold the distinct keys."""
    return bloom_bits(distinct_rows(keys.select("key").where("key IS NOT NULL")).count())


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    held: list[pa.Array] = []
    for batch in batches:
        for at in range(0, len(batch), UNIT_KEYS):
            some = batch.column(0).slice(at, UNIT_KEYS)
            if held and (sum(map(len, held)) + len(some) > UNIT_KEYS or sum(a.nbytes for a in held) > UNIT_BYTES):
                yield pa.concat_arrays(held)
                held = []
            held.append(some)
    if held:
        yield pa.concat_arrays(held)


def _positions(keys: pa.Array, size: int) -> np.ndarray:
    return bloom_positions_of(keys.cast(pa.binary()).to_pylist(), size).ravel()


def _cuts(pos: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(piece, from, to) of sorted positions."""
    starts = np.flatnonzero(np.diff(pos // width, prepend=-1))
    for from_, to in zip(starts.tolist(), [*starts[1:].tolist(), len(pos)]):
        yield int(pos[from_]) // width, from_, to


def set_bits(keys: DataFrame, size: int) -> DataFrame:
    """The filter's bytes (piece BIGINT, bits BINARY), little bit first, in pieces of PIECE_BITS; pieces without a set bit are left out. Between tasks go the
    offsets in a piece, four bytes each, or its bytes where these are fewer."""
    width, most = PIECE_BITS, HELD_POSITIONS
    pieces = -(-size // width)

    def length(piece: int) -> int:
        return min(width, size - piece * width)

    def packed(pos: np.ndarray) -> pa.RecordBatch:
        out = []
        for piece, from_, to in _cuts(pos, width):
            at = (pos[from_:to] - piece * width).astype(np.uint32)
            if 4 * len(at) >= -(-length(piece) // 8):
                bits = np.zeros(length(piece), bool)
                bits[at] = True
                at = np.packbits(bits, bitorder="little")
            out.append((piece, at.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["piece", "bits"])

    def distinct(held: list[np.ndarray]) -> np.ndarray:
        pos = np.sort(np.concatenate(held))
        return pos[np.diff(pos, prepend=-1) != 0]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for some in _units(batches):
            held.append(_positions(some, size))
            if sum(map(len, held)) > most:
                held = [distinct(held)]
                if len(held[0]) > most // 2:
                    yield packed(held[0])
                    held = []
        if held:
            yield packed(distinct(held))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if piece not in held:
                    held[piece] = np.zeros(length(piece), bool)
                bits = held[piece]
                if len(data) == -(-len(bits) // 8):
                    bits |= np.unpackbits(np.frombuffer(data, np.uint8), count=len(bits), bitorder="little").view(bool)
                else:
                    bits[np.frombuffer(data, np.uint32)] = True
        for piece, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["piece", "bits"])

    form = "piece bigint, bits binary"
    return keys.select("key").where("key IS NOT NULL").mapInArrow(sent, form).repartition(pieces, "piece").mapInArrow(joined, form)


def bitmap(bits: DataFrame, size: int) -> np.ndarray:
    """The pieces as one."""
    out = np.zeros(-(-size // 8), np.uint8)
    for r in bits.collect():
        from_ = r.piece * PIECE_BITS // 8
        out[from_ : from_ + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def might_contain(probes: DataFrame, bits: DataFrame, size: int) -> DataFrame:
    """Distinct probes with whether all their bits are set: looked up in the filter's bytes, which go to every worker, or to which the probes' positions go if
    they have more than MAX_BROADCAST_BITS."""
    known = probes.select("key").where("key IS NOT NULL")
    rows = known.count()
    keys = distinct_rows(known, rows)
    if size > MAX_BROADCAST_BITS:
        return _looked_up_in_pieces(keys, bits, size, rows)
    held = probes.sparkSession.sparkContext.broadcast(bitmap(bits, size))

    @F.pandas_udf("boolean")
    def maybe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            pos = bloom_positions_of([k.encode() for k in some], size)
            yield pd.Series((held.value[pos >> 3] >> (pos & 7).astype(np.uint8) & 1).all(axis=1))

    return keys.select("key", maybe("key").alias("maybe"))


def _looked_up_in_pieces(keys: DataFrame, bits: DataFrame, size: int, rows: int) -> DataFrame:
    """Positions of a unit of keys go to the pieces of the filter that they lie in, and the numbers of its keys that lack a bit come back to the unit. Keys are
    sorted in their tasks, so that a task that is run again makes the same units. Pieces that many keys ask are copied, so that tasks stay of bounded rows."""
    width, tasks = PIECE_BITS, tasks_for(rows, keys)
    pieces = -(-size // width)
    copies = max(1, -(-rows // (pieces * TASK_ROWS)))
    piece_kind, ask_kind, keys_kind = range(3)
    form = pa.schema([("piece", pa.int64()), ("copy", pa.int64()), ("kind", pa.int32()), ("unit", pa.int64()), ("data", pa.binary())])
    back = pa.schema([("unit", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])

    def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, some in enumerate(_units(batches)):
            unit, pos = task << 32 | n, _positions(some, size)
            order = np.argsort(pos)
            pos, who = pos[order], (order // BLOOM_HASHES).astype(np.uint16)
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, pa.schema([("key", some.type)])) as stream:
                stream.write_batch(pa.RecordBatch.from_arrays([some], ["key"]))
            asked = [(p, n % copies, ask_kind, unit, (pos[i:j] - p * width).astype(np.uint32).tobytes() + who[i:j].tobytes()) for p, i, j in _cuts(pos, width)]
            yield batch_of([*asked, ((task + n) % pieces, n % copies, keys_kind, unit, out.getvalue().to_pybytes())], form)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.zeros(0, np.uint8)
        for batch in batches:
            out = []
            for piece, copy, kind, unit, data in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == piece_kind:
                    at, held = (piece, copy), np.frombuffer(data, np.uint8)
                elif kind == keys_kind:
                    out.append((unit, keys_kind, data))
                else:
                    n = len(data) // 6
                    pos, lacks = np.frombuffer(data, np.uint32, n), np.frombuffer(data, np.uint16, n, 4 * n)
                    if at == (piece, copy):
                        lacks = lacks[(held[pos >> 3] >> (pos & 7).astype(np.uint8) & 1) == 0]
                    if len(lacks):
                        out.append((unit, ask_kind, lacks.tobytes()))
            if out:
                yield batch_of(out, back)

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lacks = []
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind == ask_kind:
                    lacks.append(np.frombuffer(data, np.uint16))
                    continue
                some = pa.ipc.open_stream(data).read_all().column(0).combine_chunks()
                maybe = np.ones(len(some), bool)
                for who in lacks:
                    maybe[who] = False
                lacks = []
                yield pa.RecordBatch.from_arrays([some.cast(pa.string()), pa.array(maybe)], ["key", "maybe"])

    asked = keys.sortWithinPartitions("key").mapInArrow(ask, "piece bigint, copy bigint, kind int, unit bigint, data binary")
    there = bits.select("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint"))).alias("copy"), F.lit(piece_kind).alias("kind"),
                        F.lit(None).cast("bigint").alias("unit"), F.col("bits").alias("data"))
    met = there.unionByName(asked).repartition(pieces * copies, "piece", "copy").sortWithinPartitions("piece", "copy", "kind")
    answers = met.mapInArrow(answer, "unit bigint, kind int, data binary")
    return answers.repartition(tasks, "unit").sortWithinPartitions("unit", "kind").mapInArrow(say, "key string, maybe boolean")


def false_positive_rate(members: DataFrame, absent: DataFrame, n_keys: int) -> DataFrame:
    size = bloom_bits(n_keys)
    answers = might_contain(absent, set_bits(members, size), size)
    return answers.agg(F.count_if("maybe").alias("false_positives"), F.count("*").alias("probes"))


def marshal(keys: list[bytes], size: int) -> bytes:
    """[8-byte size][1-byte hash count][bits], little bit first in each byte."""
    bits = bytearray((size + 7) // 8)
    if keys:
        for p in set(bloom_positions_of(keys, size).ravel().tolist()):
            bits[p // 8] |= 1 << p % 8
    return size.to_bytes(8, "big") + bytes([BLOOM_HASHES]) + bytes(bits)


def unmarshal(data: bytes) -> tuple[int, int, bytes]:
    if len(data) < 9 or (len(data) - 9) * 8 < int.from_bytes(data[:8], "big"):
        raise ValueError("filter bytes too short")
    return int.from_bytes(data[:8], "big"), data[8], data[9:]


def probe(data: bytes, key: bytes) -> bool:
    size, hashes, bits = unmarshal(data)
    return all(bits[p // 8] >> p % 8 & 1 for p in bloom_positions_of([key], size, hashes)[0].tolist())
