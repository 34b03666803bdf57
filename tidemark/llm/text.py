"""Byte-level kernels over Arrow text columns: words, their 64-bit hashes, n-gram hashes.

All arrays are numpy views of one batch; long texts are worked through in pieces of PIECE bytes,
so temporaries stay bounded whatever the length of a text.
"""

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
#: Rows of an Arrow batch are handled in slices of about this many bytes of text.
SLICE = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x80:] = NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x41:0x5B] = NOT_ALNUM[0x61:0x7B] = False

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP) | np.uint64(1)


def table(values: np.ndarray, separators: np.ndarray | None = None, lower: bool = True) -> np.ndarray:
    out = values[LOWER] if lower else values.copy()
    if separators is not None:
        out[separators] = 0
    return out


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column, null as empty; offsets are into the bytes."""
    col = batch.column(name)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:
    _libc = None


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    if _libc is not None and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `limit` bytes of text, or one text."""
    done = 0
    for batch in batches:
        _, offsets = column(batch, name)
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
            done += limit
            if done > 8 * SLICE:
                trim()
                done = 0
    trim()


class Words:
    """Words of a batch: start and end bytes, hash, and each text's range of words (lo, hi). Other values give another hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, values: np.ndarray = _VALUES):
        begin, end = int(offsets[0]), int(offsets[-1])
        values = table(values, separators)
        firsts = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
        starts, ends, hashes = [], [], []
        at = begin
        while at < end:
            to = min(at + PIECE, end)
            while to < end:  # back to a place between words, or on past a longer word
                gap = np.flatnonzero(separators[data[at:to]])
                cut = at + int(gap[-1]) + 1 if len(gap) else at
                k = int(np.searchsorted(firsts, to, "right")) - 1
                cut = max(cut, int(firsts[k]) if k >= 0 else at)
                if cut > at:
                    to = cut
                    break
                to = min(to + PIECE, end)
            part = data[at:to]
            inside = ~separators[part]
            first = np.zeros(len(part), bool)
            lo, hi = np.searchsorted(firsts, [at, to])
            first[firsts[lo:hi] - at] = True
            opens = inside.copy()
            opens[1:] &= ~inside[:-1] | first[1:]
            closes = inside.copy()
            closes[:-1] &= ~inside[1:] | first[1:]
            s = np.flatnonzero(opens)
            if len(s):
                e = np.flatnonzero(closes) + 1
                length = e - s
                place = np.arange(len(part), dtype=np.int32)
                place -= np.repeat(s, np.diff(np.append(s, len(part)))).astype(np.int32) if s[0] == 0 else np.concatenate(
                    [np.zeros(s[0], np.int32), np.repeat(s, np.diff(np.append(s, len(part)))).astype(np.int32)])
                np.minimum(place, int(length.max()) - 1, out=place)
                power = np.full(int(length.max()), _STEP, np.uint64)
                power[0] = 1
                np.multiply.accumulate(power, out=power)
                v = values[part]
                v *= power[place]
                h = np.add.reduceat(v, s)
                starts.append(s + at)
                ends.append(e + at)
                hashes.append(mix(h + length.astype(np.uint64) * _STEP))
            at = to
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.start, self.end, self.hash = join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64)
        self.lo = np.searchsorted(self.start, offsets[:-1])
        self.hi = np.searchsorted(self.start, offsets[1:])
        self.count = self.hi - self.lo


_ORDER = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def gram(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words that start at each place."""
    out = np.full(len(at), n, np.uint64)
    for j in range(n):
        out += hashes[at + j] * _ORDER[j]
    return mix(out)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, one for each start."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out += hashes[j : j + m] * _ORDER[j]
    return mix(out)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values, kind))
