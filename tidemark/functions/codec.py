"""Byte formats as native Spark expressions, and their small Python decoders."""

import struct
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the log and sorted-file formats.
OP_CODES = {"put": 1, "delete": 2}
BLOCK_TARGET_BYTES = 4096
FOOTER_BYTES = 16

OP_NAMES = {code: name for name, code in OP_CODES.items()}


class CorruptData(ValueError):
    """A block or file fails its checksum or bounds."""


def be32(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0"))


def be64(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 16, "0"))


def log_frame(op: Column, key: Column, value: Column) -> Column:
    """One log frame. A null value is written as empty; an unknown op is an error."""
    key, value = key.cast("binary"), F.coalesce(value.cast("binary"), F.unhex(F.lit("")))
    code = F.when(op == "put", F.unhex(F.lit("01"))).when(op == "delete", F.unhex(F.lit("02"))).otherwise(
        F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null")))).cast("binary"))
    body = F.concat(code, be32(F.octet_length(key)), key, be32(F.octet_length(value)), value)
    return F.concat(body, be32(F.crc32(body)))


def block_entry(key: Column, value: Column, tombstone: Column, seq: Column) -> Column:
    key, value = key.cast("binary"), F.coalesce(value.cast("binary"), F.unhex(F.lit("")))
    flag = F.when(tombstone, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    return F.concat(be32(F.octet_length(key)), key, be32(F.octet_length(value)), value, flag, be64(seq))


def entry_bytes(key: Column, value: Column) -> Column:
    """Encoded size of one block entry."""
    return (F.octet_length(key.cast("binary")) + F.coalesce(F.octet_length(value.cast("binary")), F.lit(0)) + 17).cast("bigint")


def encode_frame(op: str, key: str, value: bytes = b"") -> bytes:
    k = key.encode()
    body = struct.pack(f">BI{len(k)}sI", OP_CODES[op], len(k), k, len(value)) + value
    return body + struct.pack(">I", zlib.crc32(body))


def decode_frames(data: bytes):
    """(op, key, value) up to the first short or damaged frame, which ends the replay silently."""
    at, end = 0, len(data)
    while at + 5 <= end:
        key_end = at + 5 + int.from_bytes(data[at + 1 : at + 5], "big")
        if key_end + 4 > end:
            return
        value_end = key_end + 4 + int.from_bytes(data[key_end : key_end + 4], "big")
        if value_end + 4 > end or zlib.crc32(data[at:value_end]) != int.from_bytes(data[value_end : value_end + 4], "big"):
            return
        if data[at] not in OP_NAMES:
            raise CorruptData(f"op code {data[at]} in a frame with a good checksum")
        yield OP_NAMES[data[at]], data[at + 5 : key_end].decode(), data[key_end + 4 : value_end]
        at = value_end + 4


def decode_block(block: bytes):
    """(key, value, tombstone, seq) of one block; damage is an error, never a short result."""
    if len(block) < 4 or zlib.crc32(block[:-4]) != int.from_bytes(block[-4:], "big"):
        raise CorruptData("block checksum mismatch")
    body, at = block[:-4], 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(body):
            raise CorruptData("truncated block entry")
        at += n
        return body[at - n : at]

    while at < len(body):
        key = take(int.from_bytes(take(4), "big"))
        value = take(int.from_bytes(take(4), "big"))
        yield key.decode(), value, take(1) != b"\0", int.from_bytes(take(8), "big")


def encode_sorted_file(entries, filter_bytes: bytes, target: int = BLOCK_TARGET_BYTES) -> bytes:
    """A whole indexed file from entries in key order: blocks, index, filter, footer."""
    out, index, block, first = bytearray(), [], bytearray(), None

    def cut():
        nonlocal block, first
        if block:
            data = bytes(block) + struct.pack(">I", zlib.crc32(bytes(block)))
            index.append((first, len(out), len(data)))
            out.extend(data)
            block, first = bytearray(), None

    for key, value, tombstone, seq in entries:
        k = key.encode()
        first = k if first is None else first
        block += struct.pack(f">I{len(k)}sI", len(k), k, len(value)) + value + struct.pack(">BQ", bool(tombstone), seq)
        if len(block) >= target:
            cut()
    cut()
    index_at = len(out)
    out += struct.pack(">I", len(index))
    for k, offset, length in index:
        out += struct.pack(f">I{len(k)}sII", len(k), k, offset, length)
    filter_at = len(out)
    out += filter_bytes
    return bytes(out + struct.pack(">IIII", index_at, filter_at - index_at, filter_at, len(filter_bytes)))


def decode_index(data: bytes) -> list[tuple[str, int, int]]:
    def word(at: int) -> int:
        if at + 4 > len(data):
            raise CorruptData("truncated index")
        return int.from_bytes(data[at : at + 4], "big")

    found, at = [], 4
    for _ in range(word(0)):
        end = at + 4 + word(at)
        if end + 8 > len(data):
            raise CorruptData("truncated index entry")
        found.append((data[at + 4 : end].decode(), word(end), word(end + 4)))
        at = end + 8
    return found


def open_sorted_file(data: bytes) -> tuple[list[tuple[str, int, int]], bytes]:
    """(sparse index, filter bytes) named by the footer."""
    if len(data) < FOOTER_BYTES:
        raise CorruptData("file shorter than its footer")
    index_at, index_len, filter_at, filter_len = struct.unpack(">IIII", data[-FOOTER_BYTES:])
    if max(index_at + index_len, filter_at + filter_len) > len(data) - FOOTER_BYTES:
        raise CorruptData("footer points outside the file")
    return decode_index(data[index_at : index_at + index_len]), data[filter_at : filter_at + filter_len]
