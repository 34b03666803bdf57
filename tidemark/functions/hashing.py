"""Hash expressions: the ring's 32-bit hash and the Bloom filter's bit positions."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the file and placement formats.
FNV_OFFSET_64 = 14695981039346656037
FNV_PRIME_64 = 1099511628211
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
VNODES_PER_NODE = 150
RING_SIZE = 1 << 32


def ring_hash(key: Column) -> Column:
    """First four bytes of MD5, big-endian, as a BIGINT in [0, 2^32)."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _fnv_pair(data: bytes) -> tuple[int, int]:
    mask = (1 << 64) - 1
    a = b = FNV_OFFSET_64
    for byte in data:
        a = ((a ^ byte) * FNV_PRIME_64) & mask
        b = ((b * FNV_PRIME_64) & mask) ^ byte
    return a, b or 1


def fnv_pairs(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """FNV-1a and FNV-1 of many keys at once, one numpy step per byte position.

    uint64 arithmetic wraps, which Spark's ANSI integers refuse to do.
    """
    n = len(keys)
    lengths = np.fromiter(map(len, keys), np.int64, n)
    a = np.full(n, FNV_OFFSET_64, np.uint64)
    b = a.copy()
    prime = np.uint64(FNV_PRIME_64)
    flat = np.frombuffer(b"".join(keys), np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    alive = n
    for at in range(int(lengths.max(initial=0))):
        while alive and lengths[order[alive - 1]] <= at:
            alive -= 1
        rows = order[:alive]
        byte = flat[starts[rows] + at]
        a[rows] = (a[rows] ^ byte) * prime
        b[rows] = (b[rows] * prime) ^ byte
    b[b == 0] = 1
    return a, b


def bloom_positions_of(keys: list[bytes], size: int, hashes: int = BLOOM_HASHES) -> np.ndarray:
    """(len(keys), hashes) bit positions by double hashing, wrapping at 2^64."""
    a, b = fnv_pairs(keys)
    steps = np.arange(hashes, dtype=np.uint64)
    return ((a[:, None] + steps[None, :] * b[:, None]) % np.uint64(size)).astype(np.int64)


def bloom_positions(key: Column, size: int, hashes: int = BLOOM_HASHES) -> Column:
    """ARRAY<BIGINT> of the bits a key sets in a filter of `size` bits. A null key is null."""

    @F.pandas_udf("array<bigint>")
    def positions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            known = keys.notna()
            out = pd.Series([None] * len(keys), dtype=object)
            if known.any():
                found = bloom_positions_of([k.encode() for k in keys[known]], size, hashes)
                out[known.to_numpy()] = pd.Series(list(found), index=out.index[known.to_numpy()])
            yield out

    return positions(key)
