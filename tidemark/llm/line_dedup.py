"""Substring dedup by hashing lines and paragraphs: the earliest occurrence stays, later ones go.

A unit is a line, cut further after words that end in a full stop, exclamation or question mark, as passages seldom keep the
line breaks of their source. A paragraph is the shortest run of units, from any unit on, with at least `min_words` words; a unit
that long is one by itself, and what is shorter is never judged alone. Paragraphs are normalised to their words, A-Z in lower case and white space as one
space, and told apart by 128 bits: two digests over two hashes of each word. Every paragraph but the earliest of its digest goes, with all
its units; the earliest is that of the least (doc_id, hash of the text, unit). Everything is judged on the input.

Digests are first counted, 64 bits of each, by one aggregation with map-side combining. The paragraphs of repeated ones, a small part,
are written to a table, in which the earliest of each is found and joined back. A very common paragraph is combined before it is shuffled in the counts and
split by adaptive skew handling in both joins, as its digest has one row on the other side; that side is written first, so that each join reads
two plain tables and can be split.

A null text has no units and stays null; an empty one, or one of white space, has none and stays. Very long texts are cut into words piece by piece.
A null doc_id ranks first. Of repeated rows (doc_id and text alike) one counts as the first, and of the others every paragraph goes. An
empty table gives an empty result. All input columns but text are carried in the struct `doc`, so that no name can clash.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.session import materialise
from tidemark.llm.text import _STEP, _VALUES, Words, column, mix, slices

ENDS = np.zeros(256, bool)
ENDS[[0x2E, 0x21, 0x3F]] = True
_OTHER = mix(_VALUES + _STEP) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
KEPT = "array<struct<unit: bigint, start: bigint, end: bigint>>"


class Units:
    """Units of a batch of texts: words [first, last) of each, and each text's range of units (lo, hi)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = w = Words(data, offsets)
        n = len(w.start)
        closes = ENDS[data[w.end - 1]] if n else np.zeros(0, bool)
        begin = int(offsets[0])
        breaks = np.flatnonzero(data[begin : int(offsets[-1])] == 10) + begin
        if n:
            closes[:-1] |= np.searchsorted(breaks, w.end[:-1]) < np.searchsorted(breaks, w.start[1:])
            closes[w.hi[w.count > 0] - 1] = True
        self.last = np.flatnonzero(closes) + 1
        self.first = np.concatenate([[0], self.last[:-1]]) if len(self.last) else self.last
        self.lo, self.hi = np.searchsorted(self.first, w.lo), np.searchsorted(self.first, w.hi)

    def paragraphs(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first unit, last unit) of every paragraph, units numbered in the batch."""
        text = np.repeat(np.arange(len(self.lo)), self.hi - self.lo)
        to = np.searchsorted(self.last, self.first + max(min_words, 1))
        there = np.flatnonzero(to < self.hi[text])
        return text[there], there, to[there]


def digests(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """Of the words [first, last), whatever stands before them: polynomial sums modulo 2^64, finalised."""
    power = np.full(len(hashes) + 1, base, np.uint64)
    back = np.full(len(hashes) + 1, pow(base, -1, 1 << 64), np.uint64)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1])])
    return mix((total[last] - total[first]) * back[first] + (last - first).astype(np.uint64) * _STEP)


def with_key(docs: DataFrame) -> DataFrame:
    """docs with _n, _i, _k: whether there is a doc_id, the id, and the hash of the text."""
    kind = docs.schema["doc_id"].dataType
    return docs.withColumns({"_n": F.col("doc_id").isNotNull(), "_i": F.coalesce("doc_id", F.lit(0).cast(kind)), "_k": F.xxhash64(F.coalesce("text", F.lit("")))})


def paragraph_digests(docs: DataFrame, min_words: int, whole: bool) -> DataFrame:
    """d1 of every paragraph; with `whole` also d2, the key of its row and its units (u to v)."""
    key = ["_n", "_i", "_k"] if whole else []
    rows = with_key(docs.select("doc_id", "text")).select(*key, "text")

    def digest(batches):
        for batch in slices(batches):
            data, offsets = column(batch, "text")
            units = Units(data, offsets)
            text, u, v = units.paragraphs(min_words)
            first, last = units.first[u], units.last[v]
            d1 = pa.array(digests(units.words.hash, first, last, _BASES[0]).view(np.int64))
            if whole:
                d2 = digests(Words(data, offsets, values=_OTHER).hash, first, last, _BASES[1]).view(np.int64)
                at, lo = pa.array(text), units.lo[text]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in key], d1, pa.array(d2), pa.array(u - lo, pa.int32()), pa.array(v - lo, pa.int32())],
                                                 names=[*key, "d1", "d2", "u", "v"])
            else:
                yield pa.RecordBatch.from_arrays([d1], names=["d1"])

    if not whole:
        return rows.mapInArrow(digest, "d1 bigint")
    kind = rows.schema["_i"].dataType.simpleString()
    return rows.mapInArrow(digest, f"_n boolean, _i {kind}, _k bigint, d1 bigint, d2 bigint, u int, v int")


def cut(text: bytes, units: Units, of: int, base: int, gone: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(what is left, numbers, starts and ends of the units that stay); white space after a unit goes with it, that before the first stays."""
    w, lo, hi = units.words, units.lo[of], units.hi[of]
    starts = w.start[units.first[lo:hi]] - base
    ends = np.append(starts[1:], len(text))
    stays = np.flatnonzero(~gone)
    return text[: starts[0] if hi > lo else len(text)] + b"".join(text[starts[i] : ends[i]] for i in stays.tolist()), stays, starts[stays], ends[stays]


def line_dedup(docs: DataFrame, min_words: int = 25) -> DataFrame:
    """doc, text without later paragraphs, n_units, n_removed, and kept: (unit, start, end) in bytes of the original text, white space after a unit included."""
    repeated = materialise(paragraph_digests(docs, min_words, False).groupBy("d1").count().where("count > 1").select("d1"), "digests")
    found = materialise(paragraph_digests(docs, min_words, True).join(repeated, "d1", "left_semi"), "paragraphs")
    rank = F.struct("_n", "_i", "_k", "u")
    firsts = materialise(found.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "first"), "firsts")
    gone = found.join(firsts, ["d1", "d2"]).where(rank != F.col("first")).select("_n", "_i", "_k", F.struct("u", "v").alias("run"))
    gone = gone.groupBy("_n", "_i", "_k").agg(F.collect_set("run").alias("gone"))
    rest = [c for c in docs.columns if c != "text"]
    d = with_key(docs.select("doc_id", "text", F.struct(*[F.col(c) for c in rest]).alias("doc"))).drop("doc_id").join(gone, ["_n", "_i", "_k"], "left")
    copy = F.row_number().over(Window.partitionBy("_n", "_i", "_k").orderBy("_k")) > 1
    d = d.select("doc", "text", copy.alias("copy"), F.col("gone.u").alias("u"), F.col("gone.v").alias("v"))

    def apply(batches):
        for batch in slices(batches):
            data, offsets = column(batch, "text")
            units = Units(data, offsets)
            text, first, last = units.paragraphs(min_words)
            bounds = np.searchsorted(text, np.arange(len(batch) + 1))
            texts, n_removed, kept = [], [], []
            for i in range(len(batch)):
                lo, hi = units.lo[i], units.hi[i]
                edge = np.zeros(hi - lo + 1, np.int64)
                u, v = batch.column("u")[i].values, batch.column("v")[i].values
                if batch.column("copy")[i].as_py():
                    runs = slice(bounds[i], bounds[i + 1])
                    u, v = first[runs] - lo, last[runs] - lo
                if u is not None:
                    np.add.at(edge, np.asarray(u), 1)
                    np.add.at(edge, np.asarray(v) + 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                left, *stays = cut(data[offsets[i] : offsets[i + 1]].tobytes(), units, i, int(offsets[i]), gone)
                texts.append(left if batch.column("text")[i].is_valid else None)
                n_removed.append(int(gone.sum()))
                kept.append(stays)
            flat = [np.concatenate([k[j] for k in kept]) if kept else np.zeros(0, np.int64) for j in range(3)]
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], names=["unit", "start", "end"])
            sizes = np.concatenate([[0], np.cumsum([len(k[0]) for k in kept])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(texts, pa.binary()).view(pa.string()), pa.array(units.hi - units.lo, pa.int64()), pa.array(n_removed, pa.int64()), pa.ListArray.from_arrays(sizes, spans)],
                names=["doc", "text", "n_units", "n_removed", "kept"])

    schema = T.StructType([d.schema["doc"], T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_units", "n_removed")],
                           T.StructField("kept", T._parse_datatype_string(KEPT))])
    return d.mapInArrow(apply, schema)
