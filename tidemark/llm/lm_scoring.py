"""Language-model scoring by logistic context mixing over bits.

A text is its words, each spelled in bytes and closed by a stop, then one stop alone. The bits of every byte are
predicted in several contexts: the last 1, 2, 3, 4 bytes of the text, also those before the word (with `across`, as the query has it), and all of the word so far.
Bits are counted over all training
documents in lines, one for each context and half byte with its 15 nodes; a line is found by the 61-bit hash of its context, and there are as
many lines as contexts. Stretched predictions are mixed
by weights that a gate selects (how often the long contexts were seen), learned online, and the result is refined by
an adaptive map of (probability, bits of the byte so far).

With four bytes, of which one is the stop, only the first HEAD bytes of a word are predicted with text before it, and of that with TAIL bytes. So
these are spelled once for each distinct border (TAIL bytes before, HEAD bytes after the stop; the end of a text is a border as well), and the other bytes once for
each distinct word; a text adds both up for each of its words. Borders are counted over all training documents, dealt to ranges by hash, and ask the shards for their lines as ranges of words do.
Without `across`, contexts end at the word, which is spelled once whole.

The spelled probability of a word is then refined by the exact counts of the whole word, which no context can keep apart: in all
training tokens, and in those of documents of one kind. Both are left one occurrence out when their shares are learned. Kinds
are CLASSES mixture components of byte pairs, fitted without labels over all training documents in KIND_PASSES passes (only the start is taken from START_DOCS of them); every training document counts
in its likeliest one. A text's own kind is never looked up: its probability is the mixture over kinds of the
product of its words, so the kinds are reweighted by each word read. With `across` the shares are learned with the rest of a word and how often words of its range begin as it does. Result: log10 probability and total bits per byte.

Vocabulary: words of each task are counted and spelled once, dealt by hash to shards and merged there. Context counts cover
every training token. No task holds all lines: distinct words are dealt to ranges of their order, so that lines of the whole word so far lie in one range,
but for the prefixes of the words between ranges. Those, and lines of the last 1 to 4 bytes, are summed in shards by hash, which
tell each range the lines that its words meet. The weights, the map and the shares are learned from all training tokens: each range goes online
over its words, each less the occurrence at hand and weighing its count; weights and shares are averaged over ranges by the tokens that met them, the map's counts
are summed. Then a range scores its own words.

Texts are dealt to blocks by id and text; a block asks the shards once for
each of its distinct words, so a word that is everywhere costs one row a block, and a shard never meets the texts.

A null text counts as empty: its one token is the end. Without training documents N is 0 and all counts are 0. A null doc_id is in training. Repeated rows
count and are scored each. Words that tie in anything tie in their probability. Very long texts are cut into words piece by piece. An empty table gives an empty result. Extra columns are ignored.
"""

import bisect
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ngram_join import deal
from tidemark.llm.session import materialise, parts
from tidemark.llm.text import LOWER, Words, column, lists, mix, slices

#: Slots of tables that are addressed by hash alone, where no lines are given, as powers of two.
TABLE_BITS = (16, 18, 20, 20, 23)
ORDERS = (1, 2, 3, 4, None)
#: Kinds of documents, and the documents that their fit starts from.
CLASSES = 6
START_DOCS = 1000
#: First bytes of a word that are predicted with the TAIL bytes before the stop before it; from the next one on, the last four bytes lie in the word and its stop.
HEAD = TAIL = 3
#: Passes over all training documents by which kinds are fitted.
KIND_PASSES = 8
#: Buckets of byte pairs that kinds are told by.
PAIRS = 512
#: Bytes of text for which a document counts in that fit at most.
DOC_WEIGHT = 2000
#: Bytes of the words between ranges.
EDGE = 256
#: Words counted at once.
CHUNK = 1 << 15
#: Words that lie next to one another in their order and are learned together; runs of so many are taken in hashed order.
RUN = 64
#: Distinct words held in a task before they are sent off, in bytes of text.
FLUSH = 12 << 20
STOP = 0x20
GATES = 64
CELLS = 33


def spell(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts) of words that are each closed by a stop."""
    data = np.frombuffer(blob, np.uint8)
    stops = np.flatnonzero(data == STOP)
    return data, np.concatenate([[0], stops[:-1] + 1]) if len(stops) else np.zeros(0, np.int64)


def contexts(data: np.ndarray, starts: np.ndarray, tails: np.ndarray | None = None) -> list[np.ndarray]:
    """Context hash of each byte, for each order, from the bytes before it: those of its own word, then a stop, then the TAIL bytes of the text before
    that, the nearest first, in a row of `tails` for each word; without these the contexts end at the word."""
    n = len(data)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    word = None if tails is None else np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    out, h = [], np.zeros(n, np.uint64)
    for k in range(1, 5):
        back = np.where(place >= k, data[np.maximum(np.arange(n) - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        if tails is not None:
            over = np.flatnonzero(place < k - 1)
            byte = tails[word[over], k - 2 - place[over]].astype(np.uint64)
            back[over] = np.where(byte == STOP, np.uint64(0), byte + np.uint64(1))
        h = h * np.uint64(0x9E3779B97F4A7C15) + back + np.uint64(k)
        out.append(mix(h))
    values = mix(data.astype(np.uint64) + np.uint64(77))
    power = np.full(int(place.max(initial=0)) + 1, 0xD1B54A32D192ED03, np.uint64)
    power[:1] = 1
    np.multiply.accumulate(power, out=power)
    total = np.cumsum(values * power[place])
    before = np.where(place > 0, total[np.maximum(np.arange(n) - 1, 0)], np.uint64(0))
    base = np.repeat(np.where(starts > 0, total[np.maximum(starts - 1, 0)], np.uint64(0)), np.diff(np.append(starts, n)))
    out.append(mix(np.where(place > 0, before - base, np.uint64(0)) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return out


def places(starts: np.ndarray, n: int) -> np.ndarray:
    """Place of each byte in its word."""
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def distinct(data: np.ndarray, starts: np.ndarray, tails: np.ndarray | None = None, head: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that differ in themselves or in what they have before them, and the place of each byte among these: what begins alike is predicted alike.
    The first `head` bytes of a word are none of them, and have the place after the last."""
    ctx = contexts(data, starts, tails)
    before = ctx[4] if tails is None else mix(ctx[4] + ctx[3] * np.uint64(0xC2B2AE3D27D4EB4F))
    own = np.flatnonzero(places(starts, len(data)) >= head)
    _, first, inverse = np.unique(mix(before[own] + data[own].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), return_index=True, return_inverse=True)
    at = np.full(len(data), len(first))
    at[own] = inverse
    return own[first], at


def line_keys(data: np.ndarray, starts: np.ndarray, rows: np.ndarray | None = None, tails: np.ndarray | None = None):
    """For each half byte: the keys of its lines, one for each order, which is in the lowest three bits; the four above it are 0."""
    ctx = contexts(data, starts, tails)
    if rows is not None:
        ctx, data = [c[rows] for c in ctx], data[rows]
    second = (data >> 4).astype(np.uint64) + np.uint64(1)
    for half in (0, 1):
        yield [(c if half == 0 else mix(c + second)) & ~np.uint64(127) | np.uint64(i) for i, c in enumerate(ctx)]


def slots(data: np.ndarray, starts: np.ndarray, lines: "Lines | None" = None, rows: np.ndarray | None = None, tails: np.ndarray | None = None):
    """For each bit from the top, of all bytes or of some: (slot in each table, bit, bits of the byte so far)."""
    by_half = line_keys(data, starts, rows, tails)
    data = data if rows is None else data[rows]
    high = data >> 4
    for half, keys in enumerate(by_half):
        at = [(k >> np.uint64(64 - bits + 4)).astype(np.int64) << 4 if lines is None else lines.find(k) << 4 for k, bits in zip(keys, TABLE_BITS, strict=True)]
        node = np.ones(len(data), np.int64)
        nibble = (high if half == 0 else data & 15).astype(np.int64)
        for b in range(3, -1, -1):
            bit = (nibble >> b) & 1
            so_far = node if half == 0 else (16 | high).astype(np.int64) << (3 - b) | (node & ((1 << (3 - b)) - 1))
            yield [line + node for line in at], bit, so_far
            node = node * 2 + bit


def summed(keys: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(seen[order], first) if len(first) else seen


def count_lines(data: np.ndarray, starts: np.ndarray, n: np.ndarray, orders=range(5), tails: np.ndarray | None = None, head: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of all lines that the words meet after their first `head` bytes, and how often each half byte follows in n occurrences of each word."""
    found = [(np.zeros(0, np.uint64), np.zeros((0, 16), np.float32))]
    ends = np.append(starts, len(data))
    for at in range(0, len(starts), CHUNK):
        to = min(at + CHUNK, len(starts))
        piece = data[ends[at] : ends[to]]
        own, rows = np.repeat(n[at:to], np.diff(ends[at : to + 1])), None
        met = piece
        if head:
            rows = np.flatnonzero(places(starts[at:to] - ends[at], len(piece)) >= head)
            own, met = own[rows], piece[rows]
        alike = [own == k for k in (0, 1)]  # most words: sorted without their counts
        alike.append(~(alike[0] | alike[1]))
        for half, by_order in enumerate(line_keys(piece, starts[at:to] - ends[at], rows, None if tails is None else tails[at:to])):
            nibble = (met >> 4 if half == 0 else met & 15).astype(np.uint64) << np.uint64(3)
            for i in orders:
                both = by_order[i] | nibble
                for k, some in enumerate(alike):
                    x, of = both[some], None
                    if k < 2:
                        x.sort()
                    else:
                        order = np.argsort(x)
                        x, of = x[order], own[some][order]
                    keys = x & ~np.uint64(120)
                    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
                    cell = (np.cumsum(new) - 1) * 16 + (x >> np.uint64(3) & np.uint64(15)).astype(np.int64)
                    count = int(new.sum()) * 16
                    found.append((keys[new], (np.zeros(count) if k == 0 else np.bincount(cell, of, count)).reshape(-1, 16).astype(np.float32)))
    return summed(np.concatenate([k for k, _ in found]), np.concatenate([x for _, x in found]))


class Lines:
    """Lines by key; what is not among them falls on a last one without counts."""

    def __init__(self, keys: np.ndarray, seen: np.ndarray):
        """Sorted distinct keys, and how often each half byte was seen."""
        bits = max(1, int(2 * len(keys)).bit_length())
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.zeros, self.ones = (np.zeros((len(keys) + 1, 16), np.float32) for _ in range(2))
        for depth in range(4):
            both = seen.reshape(len(keys), 1 << depth, 2, 8 >> depth).sum(3)
            nodes = slice(1 << depth, 2 << depth)
            self.zeros[:-1, nodes], self.ones[:-1, nodes] = both[:, :, 0], both[:, :, 1]

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.first[keys >> self.shift]
        left = np.flatnonzero(self.keys[at] < keys)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] < keys[left]]
        return np.where(self.keys[at] == keys, at, len(self.keys) - 1)


def pairs(data: np.ndarray, offsets: np.ndarray):
    """Pieces of the texts: (numbers of the texts with bytes in it, where each starts in it, bucket of each byte and its next)."""
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    first, last = offsets[filled], offsets[filled + 1]
    for lo in range(int(offsets[0]), int(offsets[-1]), 1 << 20):
        hi = min(lo + (1 << 20), int(offsets[-1]))
        a, b = np.searchsorted(last, lo, "right"), np.searchsorted(first, hi, "left")
        here = LOWER[data[lo:hi]].astype(np.uint16)
        after = np.zeros(hi - lo, np.uint16)
        after[: len(data[lo + 1 : hi + 1])] = LOWER[data[lo + 1 : hi + 1]]
        ends = last[a:b] - 1 - lo
        after[ends[ends < hi - lo]] = 0
        yield filled[a:b], np.maximum(first[a:b] - lo, 0), (here * 113 + after) % PAIRS


def pair_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of byte pairs of each text."""
    out = np.zeros((len(offsets) - 1, PAIRS), np.float32)
    for texts, starts, code in pairs(data, offsets):
        for t, s, e in zip(texts.tolist(), starts.tolist(), [*starts[1:].tolist(), len(code)], strict=True):
            out[t] += np.bincount(code[s:e], minlength=PAIRS)
    return out


class Kinds:
    """A mixture of multinomials over byte pairs."""

    def __init__(self, counts: np.ndarray):
        """Begun at documents far from one another among these, and fitted on them; `counts` has a row for each document."""
        self.prior = np.full(CLASSES, 1 / CLASSES)
        self.logs = np.zeros((CLASSES, PAIRS), np.float32)
        counts = counts[counts.sum(1) > 0]
        if not len(counts):
            return
        total = counts.sum(1, keepdims=True)
        root = np.sqrt(counts / total)
        chosen = [int(np.argmin(((root - root.mean(0)) ** 2).sum(1)))]
        near = np.full(len(counts), np.inf)
        weight = np.minimum(total[:, 0], DOC_WEIGHT)  # a short text is a poor start
        while len(chosen) < CLASSES:
            near = np.minimum(near, ((root - root[chosen[-1]]) ** 2).sum(1))
            chosen.append(int(np.argmax(near * weight)))
        x = weighed(counts)
        self.set(np.ones(CLASSES), counts[chosen])
        for _ in range(10):
            self.set(*self.expect(x))

    def expect(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents, and pairs of them, that each kind is expected to have."""
        z = x @ self.logs.T + np.log(self.prior)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.sum(0), p.T @ x

    def set(self, docs: np.ndarray, pairs: np.ndarray) -> None:
        """The likeliest mixture for these expectations."""
        everywhere = pairs.sum(0) + 1.0
        freq = pairs + 200 * everywhere / everywhere.sum()
        self.logs = np.log(freq / freq.sum(1, keepdims=True)).astype(np.float32)
        self.prior = (docs + 1) / (docs.sum() + CLASSES)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The likeliest kind of each text."""
        return (pair_counts(data, offsets) @ self.logs.T + np.log(self.prior)).argmax(1)


def weighed(counts: np.ndarray) -> np.ndarray:
    """Counts of which no document has more than DOC_WEIGHT."""
    return np.minimum(1, DOC_WEIGHT / np.maximum(counts.sum(1, keepdims=True), 1)) * counts


def fit_kinds(rows: DataFrame) -> Kinds:
    """Expectation and maximisation over all training documents, begun on START_DOCS of them, those of the smallest hashes."""

    def count(batches):
        for batch in slices(batches, limit=FLUSH // 4):
            x = weighed(pair_counts(*column(batch, "text"))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("order"), pa.array([r.tobytes() for r in x], pa.binary())], names=["order", "counts"])

    def read(counts: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(counts), np.float16).reshape(-1, PAIRS).astype(np.float32)

    order = F.xxhash64(F.lit("kinds"), "doc_id", "text").alias("order")
    table = materialise(rows.where("train").select(order, "text").mapInArrow(count, "order bigint, counts binary"), "pairs")
    kinds = Kinds(read([r.counts for r in table.orderBy("order").limit(START_DOCS).collect()]))
    for _ in range(KIND_PASSES):

        def expect(batches, kinds=kinds):
            docs, pairs = np.zeros(CLASSES), np.zeros((CLASSES, PAIRS))
            for batch in batches:
                d, x = kinds.expect(read(batch.column("counts").to_pylist()))
                docs, pairs = docs + d, pairs + x
            yield cells(np.append(docs, pairs.ravel()))

        total = summed_cells(table.select("counts").mapInArrow(expect, CELL), CLASSES * (1 + PAIRS))[0]
        kinds = Kinds(np.zeros((0, PAIRS)))
        kinds.set(total[:CLASSES], total[CLASSES:].reshape(CLASSES, PAIRS))
    return kinds


CELL = "cell int, a double, b double"


def cells(a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of the numbers of a task that are not 0, to be summed over all tasks."""
    b = np.zeros(len(a)) if b is None else b
    at = np.flatnonzero((a != 0) | (b != 0))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(a[at].astype(np.float64)), pa.array(b[at].astype(np.float64))], names=["cell", "a", "b"])


def summed_cells(df: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.zeros(n), np.zeros(n)
    for r in df.groupBy("cell").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():
        a[r.cell], b[r.cell] = r.a, r.b
    return a, b


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -16, 16)))


class Mixer:
    def __init__(self, zeros: list[np.ndarray], ones: list[np.ndarray], lines: Lines | None = None):
        self.zeros, self.ones, self.lines = zeros, ones, lines
        self.weights = np.full((len(TABLE_BITS) + 1, GATES), 0.3)
        self.weights[-1] = 0
        centre = squash((np.arange(CELLS) - CELLS // 2) * 0.5)
        self.hits = np.repeat(centre[:, None], 512, 1) * 8.0
        self.seen = np.full((CELLS, 512), 8.0)

    @staticmethod
    def over(lines: Lines, learned: tuple | None = None) -> "Mixer":
        """All orders in the same lines; weights and map as learned elsewhere."""
        m = Mixer([lines.zeros.ravel()] * len(TABLE_BITS), [lines.ones.ravel()] * len(TABLE_BITS), lines)
        if learned:
            m.weights, m.hits, m.seen = learned
        return m

    def inputs(self, at: list[np.ndarray], own: np.ndarray | None = None, bit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions and gate; `own` occurrences of the bit itself are left out."""
        x = np.empty((len(TABLE_BITS) + 1, len(at[0])))
        buckets = []
        for i, slot in enumerate(at):
            n0, n1 = self.zeros[i][slot].astype(np.float64), self.ones[i][slot].astype(np.float64)
            if own is not None:
                n1 = np.maximum(n1 - own * bit, 0)
                n0 = np.maximum(n0 - own * (1 - bit), 0)
            x[i] = stretch((n1 + 0.05) / (n0 + n1 + 0.1))
            if i >= len(at) - 2:
                buckets.append(np.minimum(np.log2(n0 + n1 + 1) / 1.6, 7).astype(np.int64))
        x[-1] = 1
        return x, buckets[0] * 8 + buckets[1]

    def without_one(self, at: list[np.ndarray], bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As inputs, in single precision, less the one occurrence at hand."""
        one = bit.astype(np.float32)
        x = np.ones((len(TABLE_BITS) + 1, len(bit)), np.float32)
        buckets = []
        for i, slot in enumerate(at):
            n0, n1 = self.zeros[i][slot], self.ones[i][slot]
            n1 = np.maximum(n1 - one, 0)
            n0 = np.maximum(n0 - (1 - one), 0)
            if i >= len(at) - 2:
                buckets.append(np.minimum(np.log2(n0 + n1 + 1) * np.float32(1 / 1.6), 7).astype(np.int64))
            n1 += np.float32(0.05)
            n0 += np.float32(0.05)
            np.log(np.divide(n1, n0, out=n1), out=x[i])
        return x, buckets[0] * 8 + buckets[1]

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->j", x, self.weights[:, gate])

    def refine(self, z: np.ndarray, so_far: np.ndarray) -> np.ndarray:
        at = np.clip(z * 2 + CELLS // 2, 0, CELLS - 1.001)
        lo = at.astype(np.int64)
        part = at - lo
        table = lambda k: self.hits[k, so_far] / self.seen[k, so_far]
        p = (1 - part) * table(lo) + part * table(lo + 1)
        return np.clip((squash(z) + p) / 2, 1e-6, 1 - 1e-6)

    def learn(self, data: np.ndarray, starts: np.ndarray, n: np.ndarray, tails: np.ndarray | None = None, head: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """One pass over words with n occurrences each, in groups, but for their first `head` bytes, every word less the occurrence at hand: each prediction is mixed and counted in the map, then
        the weights follow its error. Returns log10 probabilities of the words as they were mixed, and the tokens that each gate has seen."""
        ends = np.append(starts[1:], len(data))
        grad2, visits, out = np.full_like(self.weights, 1e-3), np.zeros(GATES), np.zeros(len(data))
        group = int(np.clip(len(starts) // 64, 256, 2048))
        for at in range(0, len(starts), group):
            s, e = starts[at], ends[min(at + group, len(starts)) - 1]
            own = starts[at : at + group] - s
            tail = None if tails is None else tails[at : at + group]
            rows, of = distinct(data[s:e], own, tail, head)
            if not len(rows):
                continue
            weight = np.bincount(of, np.repeat(n[at : at + group], np.diff(np.append(own, e - s))), len(rows))[: len(rows)]
            share, told = weight / weight.sum(), np.zeros(len(rows) + 1)
            for slot, bit, so_far in slots(data[s:e], own, self.lines, rows, tail):
                x, gate = self.without_one(slot, bit)
                weights, z = self.weights.astype(np.float32), np.zeros(len(bit), np.float32)
                for row, by_gate in zip(x, weights, strict=True):
                    z += row * by_gate[gate]
                p = squash(z)
                told[:-1] += np.log(np.where(bit == 1, p, 1 - p))
                cell = np.clip(np.rint(z * 2 + CELLS // 2), 0, CELLS - 1).astype(np.int64) * 512 + so_far
                one = cell[bit == 1]
                self.seen += np.bincount(cell, weight, CELLS * 512).reshape(CELLS, 512)
                self.hits += np.bincount(one, weight[bit == 1], CELLS * 512).reshape(CELLS, 512)
                err = (p - bit) * share
                g = np.stack([np.bincount(gate, err * row, GATES) for row in x])
                grad2 += g * g
                self.weights -= 0.08 * g / np.sqrt(grad2)
                visits += np.bincount(gate, weight, GATES)
            out[s:e] = told[of]
        return np.add.reduceat(out, starts) / np.log(10) if len(starts) else out, visits

    def log10(self, data: np.ndarray, starts: np.ndarray, own: float | None = None) -> np.ndarray:
        """log10 probability of each word with its stop; `own` occurrences of it are left out."""
        out = np.zeros(len(data))
        for slot, bit, so_far in slots(data, starts, self.lines):
            p = self.refine(self.mixed(*self.inputs(slot, own, bit)), so_far)
            out += np.log(np.where(bit == 1, p, 1 - p))
        return np.add.reduceat(out, starts) / np.log(10) if len(starts) else out


class Ready:
    """A learned mixer with its predictions worked out for every slot: what the tasks score by."""

    def __init__(self, mixer: Mixer):
        self.tables, self.gates, self.lines = [], [], mixer.lines
        for i, (zeros, ones) in enumerate(zip(mixer.zeros, mixer.ones, strict=True)):
            if i and zeros is mixer.zeros[0]:  # lines of all orders
                self.tables.append(self.tables[0])
                self.gates.append(self.gates[0])
                continue
            self.tables.append(np.empty(len(zeros), np.float16))
            self.gates.append(np.empty(len(zeros), np.uint8) if i >= len(mixer.zeros) - 2 or mixer.lines else None)
            for at in range(0, len(zeros), 1 << 18):
                n0, n1 = zeros[at : at + (1 << 18)].astype(np.float32), ones[at : at + (1 << 18)].astype(np.float32)
                self.tables[i][at : at + len(n0)] = np.log((n1 + np.float32(0.05)) / (n0 + np.float32(0.05)))
                if self.gates[i] is not None:
                    self.gates[i][at : at + len(n0)] = np.minimum(np.log2(n0 + n1 + 1) / 1.6, 7)
        self.weights = mixer.weights.astype(np.float32)
        self.map = (mixer.hits / mixer.seen).astype(np.float32)

    def probability(self, at: list[np.ndarray], so_far: np.ndarray) -> np.ndarray:
        """Of a one bit."""
        gate = self.gates[-2][at[-2]].astype(np.int64) * 8 + self.gates[-1][at[-1]]
        z = self.weights[-1][gate]
        for table, weights, slot in zip(self.tables, self.weights[:-1], at, strict=True):
            z += weights[gate] * table[slot].astype(np.float32)
        place = np.clip(z * np.float32(2) + np.float32(CELLS // 2), 0, np.float32(CELLS - 1.001))
        lo = place.astype(np.int64)
        part = place - lo.astype(np.float32)
        p = (1 - part) * self.map[lo, so_far] + part * self.map[lo + 1, so_far]
        return np.clip((1 / (1 + np.exp(-np.clip(z, -16, 16))) + p) / 2, np.float32(1e-6), np.float32(1 - 1e-6))

    def log10(self, data: np.ndarray, starts: np.ndarray, tails: np.ndarray | None = None, head: int = 0) -> np.ndarray:
        """log10 probability of each word with its stop, but for its first `head` bytes."""
        rows, of = distinct(data, starts, tails, head)
        out = np.zeros(len(rows) + 1)
        for slot, bit, so_far in slots(data, starts, self.lines, rows, tails):
            p = self.probability(slot, so_far)
            out[:-1] += np.log(np.where(bit == 1, p, 1 - p))
        return np.add.reduceat(out[of], starts) / np.log(10) if len(starts) else np.zeros(0)


class Refined:
    """Probability of a word in each kind: shares of its count in the kind, its count in all, and its spelling."""

    def __init__(self, tokens: np.ndarray, ends: int):
        self.tokens, self.ends = tokens.astype(np.float64), ends
        self.shares = np.array([0.0, 0.0, 1.0])

    def learn(self, counts: np.ndarray, spelled: np.ndarray) -> None:
        """Expectation and maximisation over training tokens, each without the occurrence at hand."""
        word, kind = np.nonzero(counts)
        if not len(word):
            return
        all_of = counts.sum(1)[word].astype(np.float64)
        own = counts[word, kind].astype(np.float64)
        weight = own
        p = np.stack([(own - 1) / np.maximum(self.tokens[kind] - 1, 1), (all_of - 1) / max(self.tokens.sum() - 1, 1), 10.0 ** np.maximum(spelled[word], -300)])
        shares = np.full(3, 1 / 3)
        for _ in range(40):
            q = shares[:, None] * p
            shares = (q / q.sum(0) * weight).sum(1) / weight.sum()
        self.shares = np.maximum(shares, 1e-4) / np.maximum(shares, 1e-4).sum()

    def listed(self, counts: np.ndarray) -> np.ndarray:
        """What the counts add to the probability: a row of kinds for each word."""
        a, b, _ = self.shares
        words = self.tokens.sum()
        return (a * counts / np.maximum(self.tokens, 1) + b * counts.sum(1, keepdims=True) / max(words, 1)) * (words / max(words + self.ends, 1))

    def log10(self, counts: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """A row of kinds for each word."""
        c, listed = self.shares[2], self.listed(counts)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(listed), (np.log(c) + spelled * np.log(10))[:, None]) / np.log(10)

    def end(self, spelled: float) -> float:
        a, b, c = self.shares
        return float(np.log10((a + b) * self.ends / max(self.tokens.sum() + self.ends, 1) + c * 10.0**spelled))


def _take(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words, in lower case, each closed by a stop."""
    size = end - start + 1
    first = np.cumsum(size) - size
    at = np.repeat(start - first, size) + np.arange(size.sum())
    out = LOWER[data[np.minimum(at, len(data) - 1)]] if len(data) else np.zeros(0, np.uint8)
    out[first + size - 1] = STOP
    return out.tobytes()


def vocabulary(docs: DataFrame, n_parts: int, kinds: Kinds) -> DataFrame:
    """(part, counts, words): distinct words of all documents with their counts in training documents of each kind."""

    def words(batches):
        for batch in slices(batches, limit=FLUSH):
            data, offsets = column(batch, "text")
            w = Words(data, offsets)
            if not len(w.hash):
                continue
            keys, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
            train = np.repeat(batch.column("train").to_numpy(zero_copy_only=False), w.count)
            kind = np.repeat(kinds.of(data, offsets), w.count)
            n = np.bincount((inverse * CLASSES + kind)[train], minlength=len(keys) * CLASSES)
            ends = deal(keys, n_parts)
            start, end = w.start[first], w.end[first]
            blobs = [_take(data, start[a:b], end[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(n_parts), pa.int32()), lists(n, np.diff(ends) * CLASSES, pa.int64()), pa.array(blobs, pa.binary())],
                                             names=["part", "counts", "words"])

    def merge(batches):
        blobs, counts, part = [], [np.zeros(0, np.int64)], 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if len(batch) else part
            blobs += batch.column("words").to_pylist()
            counts.append(batch.column("counts").flatten().to_numpy(zero_copy_only=False))
        n = np.concatenate(counts)
        if not len(n):
            return
        data = np.frombuffer(b"".join(blobs), np.uint8)
        w = Words(data, np.array([0, len(data)]))
        keys, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        total = np.zeros((len(keys), CLASSES), np.int64)
        np.add.at(total, inverse, n.reshape(-1, CLASSES))
        for at in range(0, len(keys), 1 << 15):
            f = first[at : at + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), lists(total[at : at + len(f)].ravel(), np.array([len(f) * CLASSES]), pa.int64()),
                                              pa.array([_take(data, w.start[f], w.end[f])], pa.binary())], names=["part", "counts", "words"])

    schema = "part int, counts array<bigint>, words binary"
    return docs.select("train", "text").mapInArrow(words, schema).repartitionById(n_parts, F.col("part")).mapInArrow(merge, schema)


def borders(w: Words, data: np.ndarray) -> np.ndarray:
    """Of the words, then of the ends of all texts: the TAIL bytes of the text before the stop before it, and its own first HEAD bytes, filled with stops, as one
    number of six bytes. Words are taken with one stop between them, and stops before a text. From the top: the last byte before, the first bytes, the other two
    before from the nearer, so that what is predicted alike is near in this order."""
    n, size = len(w.start), np.minimum(w.end - w.start, 3)
    lo, hi = (int(w.start[0]), int(w.end[-1])) if n else (0, 0)
    low = np.full(hi - lo + 16, STOP, np.uint8)
    low[8 : 8 + hi - lo] = LOWER[data[lo:hi]]
    eight = np.ndarray(hi - lo + 8, ">u8", low.data, strides=(1,))
    three = lambda at: eight[at - (lo - 8)].astype(np.uint64) >> np.uint64(40)
    first = np.zeros(n, bool)
    first[w.lo[w.count > 0]] = True
    head = three(w.start) & np.array([0, 0xFF0000, 0xFFFF00, 0xFFFFFF], np.uint64)[size] | np.array([0, 0x2020, 0x20, 0], np.uint64)[size]
    tail = three(w.end - 3) & np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], np.uint64)[size] | np.array([0, 0x202000, 0x200000, 0], np.uint64)[size]
    one = np.flatnonzero((size == 1) & ~first)  # two stops back to the word before
    tail[one] = tail[one] & np.uint64(0xFFFF) | (tail[one - 1] & np.uint64(255)) << np.uint64(16)
    before = np.append(np.roll(tail, 1), tail[w.hi - 1] if n else np.zeros(len(w.lo), np.uint64))
    before[:n][first] = 0x202020
    before[n:][w.count == 0] = 0x202020
    head = np.append(head, np.full(len(w.lo), 0x202020, np.uint64))
    return (before & np.uint64(255)) << np.uint64(40) | head << np.uint64(16) | before & np.uint64(0xFF00) | before >> np.uint64(16)


def spell_borders(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, tails) of what is predicted by borders: first bytes, up to a stop."""
    each = (keys[:, None] >> (np.arange(6, dtype=np.uint64) * np.uint64(8))).astype(np.uint8)
    heads = each[:, 4:1:-1]
    keep = np.ones(heads.shape, bool)
    keep[:, 1:] = np.logical_and.accumulate(heads[:, :-1] != STOP, axis=1)
    return heads[keep], np.cumsum(keep.sum(1)) - keep.sum(1), each[:, [5, 1, 0]]


def deal_borders(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted borders by part, and the ends of the parts. Those alike in their last byte before and first two bytes go to one part."""
    part = (mix(keys >> np.uint64(24)) % np.uint64(n)).astype(np.int64)
    return np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=n))])


def once(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


class Finder:
    """Places of hashes among sorted distinct ones, all of which are there."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.first[keys >> self.shift]
        left = np.flatnonzero(self.keys[at] != keys) if len(keys) else at
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] != keys[left]]
        return at


def border_ranges(docs: DataFrame, n_parts: int) -> DataFrame:
    """Distinct borders with their counts in training documents (part -1, ranges from n_parts on), and their lines for the shards."""

    def found(batches):
        for batch in slices(batches, limit=FLUSH):
            data, offsets = column(batch, "text")
            w = Words(data, offsets)
            train = batch.column("train").to_numpy(zero_copy_only=False)
            both = np.sort(borders(w, data) << np.uint64(1) | np.append(np.repeat(train, w.count), train).astype(np.uint64))
            keys = both >> np.uint64(1)
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            n = np.add.reduceat((both & np.uint64(1)).astype(np.int64), new)
            keys = keys[new]
            order, ends = deal_borders(keys, n_parts)
            keys, n = keys[order], n[order]
            for p in range(n_parts):
                if ends[p] < ends[p + 1]:
                    yield row_of(-1, n_parts + p, counts=n[ends[p] : ends[p + 1]], words=keys[ends[p] : ends[p + 1]].tobytes())

    def count(batches):
        r, blob, n = held_words(batches, n_ranges=n_parts)
        if not blob:
            return
        keys, inverse = np.unique(np.frombuffer(blob, np.uint64), return_inverse=True)
        n = np.bincount(inverse, n[:, 0], len(keys)).astype(np.int64)
        yield row_of(-1, r, counts=n, words=keys.tobytes())
        data, starts, tails = spell_borders(keys)
        yield from asked_lines(r, *count_lines(data, starts, n, tails=tails), n_parts)

    return docs.select("train", "text").mapInArrow(found, RANGE).repartitionById(n_parts, F.col("range") - n_parts).mapInArrow(count, RANGE)


def first_bytes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first HEAD bytes of each spelled word as a number."""
    out, on = np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
    for i in range(HEAD):
        byte = np.where(on, data[np.minimum(starts + i, len(data) - 1)], STOP)
        out, on = out << 8 | byte, on & (byte != STOP)
    return out


RANGE = "part int, range int, counts array<bigint>, words binary, keys array<bigint>, seen binary"


def row_of(part: int, range_: int, keys=None, seen=None, counts=None, words=None) -> pa.RecordBatch:
    """One row of words, or of lines for a shard by hash or from it."""
    one = lambda x, t: pa.array([x], t)
    flat = lambda x: pa.array([None], pa.list_(pa.int64())) if x is None else lists(x, np.array([len(x)]), pa.int64())
    return pa.RecordBatch.from_arrays([one(part, pa.int32()), one(range_, pa.int32()), flat(counts), one(words, pa.binary()), flat(None if keys is None else keys.view(np.int64)),
                                       one(None if seen is None else zlib.compress(seen.astype(np.float32).tobytes(), 1), pa.binary())],
                                      names=["part", "range", "counts", "words", "keys", "seen"])


def lines_of(keys, seen: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.array(keys, np.int64).view(np.uint64), np.frombuffer(zlib.decompress(seen), np.float32).reshape(-1, 16)


def between_ranges(vocab: DataFrame, n_types: int, n_ranges: int) -> list[bytes]:
    """Words, or their beginnings, that cut the vocabulary in about equal bytes, from every so many words of it."""
    step = max(1, n_types // (64 * n_ranges))

    def pick(batches):
        for batch in batches:
            for blob in batch.column("words").to_pylist():
                words = blob.split(b" ")[:-1][::step]
                yield pa.RecordBatch.from_arrays([pa.array([w[:EDGE] + b" " * (len(w) < EDGE) for w in words], pa.binary()), pa.array([len(w) for w in words], pa.int64())], names=["word", "size"])

    drawn = sorted((bytes(r.word), r.size + 8) for r in vocab.mapInArrow(pick, "word binary, size bigint").collect())
    upto = np.cumsum([n for _, n in drawn])
    return sorted({drawn[int(np.searchsorted(upto, upto[-1] * k / n_ranges))][0] for k in range(1, n_ranges)}) if drawn else []


def asked_lines(range_: int, keys: np.ndarray, seen: np.ndarray, n_parts: int):
    """Lines of a range for the shards by hash."""
    ends = deal(keys, n_parts)
    for p in range(n_parts):
        if ends[p] < ends[p + 1]:
            yield row_of(p, range_, keys[ends[p] : ends[p + 1]], seen[ends[p] : ends[p + 1]])


def by_ranges(vocab: DataFrame, edges: list[bytes], n_parts: int, head: int = 0) -> DataFrame:
    """Of each range of words: its words (part -1), and its lines after their first `head` bytes for the shards by hash."""
    on_edge = np.unique(np.concatenate([k for w in [*edges, bytes([STOP])] for ks in line_keys(np.frombuffer(w, np.uint8), np.zeros(1, np.int64)) for k in ks[-1:]]))

    def out(batches):
        for batch in batches:
            for blob, n in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                words = [w + b" " for w in blob.split(b" ")[:-1]]
                to = np.array([bisect.bisect_right(edges, w) for w in words], np.int64)
                order = np.argsort(to, kind="stable")
                n = np.array(n, np.int64).reshape(-1, CLASSES)[order]
                ends = np.searchsorted(to[order], np.arange(len(edges) + 2))
                for r in range(len(edges) + 1):
                    a, b = ends[r], ends[r + 1]
                    if a < b:
                        yield row_of(-1, r, counts=n[a:b].ravel(), words=b"".join(words[i] for i in order[a:b]))

    def count(batches):
        r, blob, by_kind = held_words(batches)
        if not blob:
            return
        words = blob.split(b" ")[:-1]
        order = sorted(range(len(words)), key=words.__getitem__)  # those that begin alike together
        blob, by_kind = b"".join(words[i] + b" " for i in order), by_kind[order]
        data, starts = spell(blob)
        n = by_kind.sum(1)
        size = np.diff(np.append(starts, len(data)))
        for a in range(0, len(n), 1 << 15):
            b = min(a + (1 << 15), len(n))
            yield row_of(-1, r, counts=by_kind[a:b].ravel(), words=blob[starts[a] : starts[b - 1] + size[b - 1]])
        keys, seen = count_lines(data, starts, n, head=head)
        shared = (keys & np.uint64(7) < 4) | np.isin(keys, on_edge)
        yield from asked_lines(r, keys[shared], seen[shared], n_parts)

    return vocab.mapInArrow(out, RANGE).repartitionById(n_parts, F.col("range")).mapInArrow(count, RANGE)


def held_words(batches, lines: list | None = None, n_ranges: float = np.inf) -> tuple[int, bytes, np.ndarray]:
    """(range, words, counts by kind) of a task's rows; rows of lines are put to `lines`. Ranges from n_ranges on hold borders, with one count each."""
    r, blobs, counts = 0, [], [np.zeros(0, np.int64)]
    for batch in batches:
        for i in range(len(batch)):
            r = batch.column("range")[i].as_py()
            if batch.column("words")[i].is_valid:
                blobs.append(batch.column("words")[i].as_py())
                counts.append(batch.column("counts")[i].values.to_numpy(zero_copy_only=False))
            else:
                lines.append(lines_of(batch.column("keys")[i].values.to_numpy(zero_copy_only=False), batch.column("seen")[i].as_py()))
    return r, b"".join(blobs), np.concatenate(counts).reshape(-1, CLASSES if r < n_ranges else 1)


def told_lines(asked: DataFrame, ends: int, n_parts: int) -> DataFrame:
    """The lines that each range asked for, counted over all ranges and the ends of training documents; those of the end itself as range -1."""

    def total(batches):
        asks = [(r, *lines_of(k, x)) for batch in batches for r, k, x in zip(*(batch.column(c).to_pylist() for c in ("range", "keys", "seen")), strict=True)]
        if not asks:
            return
        keys, seen = summed(np.concatenate([k for _, k, _ in asks]), np.concatenate([x for _, _, x in asks]))
        for r, k, _ in asks:
            yield row_of(-1, r, k, seen[np.searchsorted(keys, k)])

    keys, seen = count_lines(np.array([STOP], np.uint8), np.zeros(1, np.int64), np.array([ends]))
    at = deal(keys, n_parts)
    end = pa.Table.from_batches([row_of(p, -1, keys[at[p] : at[p + 1]], seen[at[p] : at[p + 1]]) for p in range(n_parts) if at[p] < at[p + 1]])
    end = asked.sparkSession.createDataFrame(end).select(*[F.col(f.name).cast(f.dataType) for f in asked.schema])
    return asked.where("part >= 0").unionByName(end).repartitionById(n_parts, F.col("part")).mapInArrow(total, RANGE)


def range_lines(data: np.ndarray, starts: np.ndarray, n: np.ndarray, told: list, head: int = 0) -> Lines:
    """All lines of a range: those told, and its own of whole words, which no other range meets."""
    keys, seen = summed(np.concatenate([k for k, _ in told] or [np.zeros(0, np.uint64)]), np.concatenate([x for _, x in told] or [np.zeros((0, 16), np.float32)]))
    own, counted = count_lines(data, starts, n, (4,), head=head)
    own, counted = own[alone := ~np.isin(own, keys)], counted[alone]
    return Lines(*summed(np.concatenate([keys, own]), np.concatenate([seen, counted])))


#: Cells of what is learned: weights of each gate, the map, shares.
WEIGHTS, MAP = (len(TABLE_BITS) + 1) * GATES, CELLS * 512


def learned_mixer(by_range: DataFrame, by_kind: np.ndarray, ends: int, n_ranges: float = np.inf, head: int = 0) -> tuple[tuple, np.ndarray]:
    """Weights, map and shares: each range learns over all its training words or borders, and the weights and shares are averaged by the tokens that they met,
    the counts of the map summed. Where the first bytes are left to borders, the shares are learned with how often words begin with them."""

    def learn(batches):
        lines: list = []
        r, blob, counts = held_words(batches, lines, n_ranges)
        rows = np.flatnonzero(counts.sum(1) > 0)
        if not len(rows):
            return
        runs = np.arange(len(rows)) // RUN
        rows = rows[np.lexsort((np.arange(len(rows)), mix(runs.astype(np.uint64) + np.uint64(1))))]
        if r >= n_ranges:
            mixer, n = Mixer.over(Lines(*summed(*map(np.concatenate, zip(*lines, strict=True))))), counts[rows, 0]
            lines.clear()
            data, starts, tails = spell_borders(np.frombuffer(blob, np.uint64)[rows])
            blank = mixer.hits.copy(), mixer.seen.copy()
            _, visits = mixer.learn(data, starts, n, tails)
            yield learned(mixer, blank, visits, np.zeros(3), 0.0)
            return
        data, starts = spell(blob)
        mixer = Mixer.over(range_lines(data, starts, counts.sum(1), lines, head))
        lines.clear()
        to = np.append(starts[1:], len(data)) - 1
        data, starts = spell(_take(data, starts[rows], to[rows]))
        counts = counts[rows]
        blank = mixer.hits.copy(), mixer.seen.copy()
        spelled, visits = mixer.learn(data, starts, counts.sum(1), head=head)
        if head:
            begin = first_bytes(data, starts)
            _, of = np.unique(begin, return_inverse=True)
            spelled += np.log10(np.maximum(np.bincount(of, counts.sum(1))[of] - 1, 0.5) / max(by_kind.sum(), 1))
        refined = Refined(by_kind, ends)
        refined.learn(counts, spelled)
        tokens = float(counts.sum())
        yield learned(mixer, blank, visits, refined.shares, tokens)

    def learned(mixer, blank, visits, shares, tokens):
        return cells(np.concatenate([(mixer.weights * visits).ravel(), (mixer.hits - blank[0]).ravel(), shares * tokens]),
                     np.concatenate([np.tile(visits, len(TABLE_BITS) + 1), (mixer.seen - blank[1]).ravel(), np.full(3, tokens)]))

    a, b = summed_cells(by_range.mapInArrow(learn, CELL), WEIGHTS + MAP + 3)
    none = Mixer([np.zeros(1)] * len(TABLE_BITS), [np.zeros(1)] * len(TABLE_BITS))
    met = b[:WEIGHTS] > 0
    none.weights.ravel()[met] = a[:WEIGHTS][met] / b[:WEIGHTS][met]
    none.hits += a[WEIGHTS:-3].reshape(CELLS, 512)
    none.seen += b[WEIGHTS:-3].reshape(CELLS, 512)
    return (none.weights, none.hits, none.seen), a[-3:] / b[-1] if b[-1] else np.array([0.0, 0.0, 1.0])


def totals(batches):
    """(types, tokens): training words of each batch, and their occurrences in each kind."""
    for batch in batches:
        n = batch.column("counts").flatten().to_numpy(zero_copy_only=False).reshape(-1, CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array([int((n.sum(1) > 0).sum())], pa.int64()), lists(n.sum(0), np.array([CLASSES]), pa.int64())], names=["types", "tokens"])


def lm_scoring(docs: DataFrame, remainder: int = 2, modulus: int = 7, across: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every text. With `across`, contexts are the last
    bytes of the text, also before the word; else they end at the word."""
    spark = docs.sparkSession
    n_parts = parts(spark)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (~held).alias("train"))
    n_train = rows.where("train").count()
    kinds = fit_kinds(rows)
    vocab = materialise(vocabulary(rows, n_parts, kinds), "vocabulary")
    sums = vocab.mapInArrow(totals, "types bigint, tokens array<bigint>").agg(F.sum("types"), *[F.sum(F.col("tokens")[k]) for k in range(CLASSES)]).first()
    by_kind = np.array([x or 0 for x in sums[1:]])
    n_words = int(by_kind.sum())
    n_tokens, n_types = n_words + n_train, (sums[0] or 0) + (n_train > 0)
    edges = between_ranges(vocab, n_types, n_parts)
    head, n_ranges = (HEAD, n_parts) if across else (0, np.inf)
    ranges = by_ranges(vocab, edges, n_parts, head)
    ranges = materialise(ranges.unionByName(border_ranges(rows, n_parts)) if across else ranges, "ranges")
    told = materialise(told_lines(ranges, 0 if across else n_train, n_parts), "lines")
    by_range = ranges.where("part = -1").unionByName(told.where("range >= 0")).repartitionById(n_parts * (1 + across), F.col("range"))
    refined = Refined(by_kind, n_train)
    learned, refined.shares = learned_mixer(by_range, by_kind, n_train, n_ranges, head)
    if not across:
        end_lines = Lines(*summed(*map(np.concatenate, zip(*[lines_of(r["keys"], r.seen) for r in told.where("range = -1").collect()], strict=True))))
        end_of_all = refined.end(float(Ready(Mixer.over(end_lines, learned)).log10(np.array([STOP], np.uint8), np.zeros(1, np.int64))[0]))
    prior = np.log10(kinds.prior)
    width = CLASSES + across
    block = F.pmod(F.xxhash64(F.lit("block"), "doc_id", "text"), F.lit(n_parts)).cast("int").alias("block")
    texts = rows.select("doc_id", "text", "train", block).repartition(n_parts, "block")

    def to_parts(block, border, keys, n=None, lm=None):
        """Rows of sorted keys, one for each part."""
        if border:
            order, cuts = deal_borders(keys, n_parts)
            keys, lm = keys[order], None if lm is None else lm[order]
        else:
            cuts = deal(keys, n_parts)
        k = np.diff(cuts)
        none = pa.array([None] * n_parts, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(range(n_parts), pa.int32()), pa.array([block] * n_parts, pa.int32()), pa.array([border] * n_parts), lists(keys.view(np.int64), k, pa.int64()),
             none if n is None else lists(n, k, pa.int64()), none.cast(pa.list_(pa.float32())) if lm is None else lists(lm.ravel(), k * (lm.size // max(len(keys), 1)), pa.float32())],
            names=["part", "block", "border", "keys", "n", "lm"])

    def score(batches):
        lines: list = []
        r, blob, n = held_words(batches, lines, n_ranges)
        if not blob:
            return
        if r >= n_ranges:
            model = Ready(Mixer.over(Lines(*summed(*map(np.concatenate, zip(*lines, strict=True)))), learned))
            lines.clear()
            raw = np.frombuffer(blob, np.uint64)
            lm = np.concatenate([model.log10(*spell_borders(raw[at : at + 16384])) for at in range(0, len(raw), 16384)])
            yield to_parts(-1, True, raw, lm=lm)
            return
        data, starts = spell(blob)
        model = Ready(Mixer.over(range_lines(data, starts, n.sum(1), lines, head), learned))
        lines.clear()
        ends = np.append(starts, len(data))
        hashes = Words(data, np.array([0, len(data)])).hash
        for at in range(0, len(starts), 1 << 15):
            to = min(at + (1 << 15), len(starts))
            lm = np.concatenate([model.log10(data[ends[a] : ends[min(a + 8192, to)]], starts[a : min(a + 8192, to)] - ends[a], head=head) for a in range(at, to, 8192)])
            order = np.argsort(hashes[at:to])
            if across:
                with np.errstate(divide="ignore"):
                    by = np.column_stack([np.log10(refined.listed(n[at:to])), lm])
            else:
                by = refined.log10(n[at:to], lm)
            yield to_parts(-1, False, hashes[at:to][order], n[at:to][order].sum(1), by[order])

    def ask(batches):
        held: dict = {}

        size: dict = {}
        for batch in slices(batches):
            data, offsets = column(batch, "text")
            w = Words(data, offsets)
            of_text = batch.column("block").to_numpy(zero_copy_only=False)
            own = np.repeat(of_text, w.count)
            every = [(False, w.hash, own)]
            if across:
                every.append((True, borders(w, data), np.append(own, of_text)))
            for border, keys, own in every:
                for b in np.unique(own).tolist():
                    at = b, border
                    held.setdefault(at, []).append(once(keys[own == b]))
                    size[at] = size.get(at, 0) + len(held[at][-1])
                    if size[at] > 1 << 21:  # once more to distinct words
                        held[at], size[at] = [once(np.concatenate(held[at]))], 0
        for at in list(held):
            yield to_parts(*at, once(np.concatenate(held.pop(at))))

    schema = "part int, block int, border boolean, keys array<bigint>, n array<bigint>, lm array<float>"
    told_schema = "block int, border boolean, keys array<bigint>, n array<bigint>, lm array<float>"

    def answer(batches):
        parts_of = {x: ([], [], []) for x in (False, True)}
        asks = []
        for batch in batches:
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            for i, b in enumerate(blocks.tolist()):
                k = batch.column("keys")[i].values.to_numpy(zero_copy_only=False)
                border = batch.column("border")[i].as_py()
                if b < 0:
                    of = batch.column("n")[i].values
                    for x, v in zip(parts_of[border], (k, np.zeros(0, np.int64) if of is None else of.to_numpy(zero_copy_only=False), batch.column("lm")[i].values.to_numpy(zero_copy_only=False)), strict=True):
                        x.append(v)
                elif len(k):
                    asks.append((b, border, k))
        for border, held in parts_of.items():
            if not any(x[1] == border for x in asks):
                continue
            keys, n, lm = (np.concatenate(x) for x in held)
            order = np.argsort(keys)
            keys, lm = keys[order], lm.reshape(len(keys), -1)[order]
            n = n if border else n[order]
            for b, _, k in (x for x in asks if x[1] == border):
                at = np.searchsorted(keys, k)
                one = np.array([len(k)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([border]), lists(k, one, pa.int64()), lists(n[at], one, pa.int64()) if not border else pa.array([None], pa.list_(pa.int64())),
                     lists(lm[at].ravel(), one * lm.shape[1], pa.float32())], names=["block", "border", "keys", "n", "lm"])

    answers_to = (by_range.mapInArrow(score, schema).unionByName(texts.mapInArrow(ask, schema)).repartitionById(n_parts, F.col("part"))
            .mapInArrow(answer, told_schema))
    base_unit = float(np.log10(n_tokens + n_types + 1))
    end_base = float(np.log10(n_train + 1)) - base_unit
    kind = docs.schema["doc_id"].dataType.simpleString()
    ln10 = np.log(10)
    with np.errstate(divide="ignore"):
        end_listed, spelled_share = float(np.log(refined.shares[:2].sum() * n_train / max(n_words + n_train, 1))), float(np.log(refined.shares[2]))

    def combine(text: pa.Table, answers: pa.Table) -> pa.Table:
        def sorted_answers(border):
            rows = answers.filter(pa.compute.equal(answers.column("border"), border)) if answers.num_rows else answers
            flat = lambda c, t: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, t)
            keys = flat("keys", np.int64).view(np.uint64)
            keys = mix(keys) if border else keys
            order = np.argsort(keys)
            return Finder(keys[order]), flat("n", np.int64)[order] if not border else None, flat("lm", np.float32).reshape(-1, 1 if border else width)[order]

        keys, n, lm = sorted_answers(False)
        base, known = np.log10(n + 1.0) - base_unit, (n > 0).astype(np.int64)
        if across:
            border_at, _, at_border = sorted_answers(True)
            listed, lm = 10.0 ** lm[:, :CLASSES].T.astype(np.float64), lm[:, CLASSES] * ln10
            at_border = at_border[:, 0] * ln10 + spelled_share
        out = []
        for batch in slices(text.to_batches()):
            data, offsets = column(batch, "text")
            w = Words(data, offsets)
            at = keys(w.hash)
            sums = lambda v, w=w: (lambda s: s[w.hi] - s[w.lo])(np.concatenate([[0], np.cumsum(v)]))
            total = lambda v, at=at: sums(v[at])
            if across:
                by_border = at_border[border_at(mix(borders(w, data)))]
                spelled = by_border[: len(at)] + lm[at]
                p = np.exp(np.maximum(spelled, -690))
                low = np.minimum(spelled + 690, 0)  # what no number reaches of words that are not listed
                each = [sums(np.log(p + of) + np.where(of == 0, low, 0)) / ln10 + prior[k] for k, of in enumerate(x[at] for x in listed)]
                end_score = np.logaddexp(end_listed, by_border[len(at) :]) / ln10
            else:
                each, end_score = [total(np.ascontiguousarray(lm[:, k], np.float64)) + prior[k] for k in range(CLASSES)], end_of_all
            s = np.logaddexp.reduce(np.stack(each) * ln10, 0) / ln10 + end_score
            size = np.add.reduceat(np.append(w.end - w.start + 1, 0), np.minimum(w.lo, len(w.start))) * (w.count > 0) + 1
            out.append(pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(~batch.column("train").to_numpy(zero_copy_only=False)), pa.array(w.count + 1), pa.array(total(known) + (n_train > 0)),
                 pa.array(np.full(len(batch), n_tokens)), pa.array(total(base) + end_base), pa.array(s), pa.array(-s * np.log2(10) / size)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]))
        return pa.Table.from_batches(out)

    return texts.groupBy("block").cogroup(answers_to.groupBy("block")).applyInArrow(
        combine, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double")
