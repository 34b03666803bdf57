"""Benchmark decontamination by a prefix-filtered join of item windows with document words.

A window is `width` consecutive words of an item (a shorter item is one window). A document
contains a window only if it contains the window's rarest word, which is all of the prefix that
exact containment needs: words are ordered by their corpus counts, rarest first, and only prefix
words are looked up. A hit fixes where the window would have to start; it is dropped if that lies
before the text or if the text ends too soon (positional and length bounds), and is then verified
over the whole window: by its hash, and what passes by the bytes of its words.

Items of up to BLOCK_BYTES of text are broadcast, and documents are not shuffled: hot sources or many copies cannot meet in one task. Larger
benchmarks are joined by shuffles: distinct windows and their items are tables, words are counted in one pass over the documents, and only places of
prefix words leave a document (sieved by a bitmap of bounded size, which only saves work), with the words around them; they are joined on the prefix word, whose documents adaptive
skew handling may split, and verified there. Both ways give the same rows.

Null texts have no words. Null item ids mark hits but are not listed. Repeated rows each get their own result, repeated items count once, and windows that tie in
rarity go by their words' hashes. Very long texts are worked through in pieces. An empty table of documents gives an empty result, one of items no hits. All other columns of documents are
carried in the struct `doc`; those of items are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.ngram_join import WANTED_BITS, wanted_bitmap
from tidemark.llm.session import materialise
from tidemark.llm.text import LOWER, NOT_ALNUM, Words, column, gram, slices

#: Bytes of item text that are broadcast at most.
BLOCK_BYTES = 4 << 20


def same_words(a: tuple, at: np.ndarray, b: tuple, to: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether n words from `at` and from `to` have the same bytes in lower case; a and b are (data, starts, ends) of words."""
    ok = np.ones(len(at), bool)
    for j in range(int(n.max(initial=0))):
        rows = np.flatnonzero(ok & (n > j))
        x, y = at[rows] + j, to[rows] + j
        size = a[2][x] - a[1][x]
        equal = size == b[2][y] - b[1][y]
        ok[rows[~equal]] = False
        rows, x, y, size = rows[equal], x[equal], y[equal], size[equal]
        if len(rows):
            first = np.cumsum(size) - size
            inside = np.arange(size.sum()) - np.repeat(first, size)
            other = LOWER[a[0][np.repeat(a[1][x], size) + inside]] != LOWER[b[0][np.repeat(b[1][y], size) + inside]]
            ok[rows] = ~np.logical_or.reduceat(other, first)
    return ok


class Windows:
    """Distinct windows of a block of items, grouped by their rarest word."""

    def __init__(self, items: list, width: int):
        text = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in items], pa.large_string())})
        data, offsets = column(text, "text")
        w = Words(data, offsets, NOT_ALNUM)
        self.hashes = w.hash
        self.vocabulary = np.unique(w.hash)
        size = np.minimum(w.count, width)
        many = np.where(size > 0, w.count - size + 1, 0)
        item = np.repeat(np.arange(len(items)), many)
        inside = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        at, size = w.lo[item] + inside, size[item]
        key = np.zeros(len(at), np.uint64)
        for n in np.unique(size):
            key[size == n] = gram(w.hash, at[size == n], int(n))
        self.words = data, w.start, w.end
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        copy = np.flatnonzero(first[inverse] != np.arange(len(key)))
        while len(copy):
            other = first[inverse[copy]]
            same = same_words(self.words, at[copy], self.words, at[other], np.minimum(size[copy], size[other]))
            copy = copy[~same | (size[copy] != size[other])]
            # One hash, other words: windows of their own.
            _, begin, again = np.unique(inverse[copy], return_index=True, return_inverse=True)
            inverse[copy] = len(first) + again
            first = np.append(first, copy[begin])
        self.keys, self.at, self.size = key[first], at[first], size[first]
        order = np.argsort(inverse, kind="stable")
        self.items = item[order]
        self.item_from = np.searchsorted(inverse[order], np.arange(len(self.keys) + 1))
        self.ids = [i for i, _ in items]

    def set_rarity(self, counts: dict) -> None:
        """Chooses each window's prefix word: the rarest, by corpus count and then by hash."""
        rank = np.array([counts.get(int(h), 0) for h in self.vocabulary.view(np.int64)], np.int64)
        order = np.lexsort((self.vocabulary, rank))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        best = np.full(len(self.at), 1 << 62)
        self.offset = np.zeros(len(self.at), np.int64)
        for j in range(int(self.size.max(initial=0))):
            live = self.size > j
            r = place[np.searchsorted(self.vocabulary, self.hashes[self.at[live] + j])]
            better = r < best[live]
            rows = np.flatnonzero(live)[better]
            best[rows], self.offset[rows] = r[better], j
        prefix = self.hashes[self.at + self.offset] if len(self.at) else np.zeros(0, np.uint64)
        by = np.argsort(prefix, kind="stable")
        self.by = by
        self.prefix, first = np.unique(prefix[by], return_index=True)
        self.prefix_from = np.append(first, len(by))
        self.probe = Probe(self.prefix)


class Probe:
    """Places of a few known hashes in many: a bitmap first, then binary search."""

    def __init__(self, known: np.ndarray, bits: int = 20):
        self.known, self.shift = known, np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[known >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in hashes, places in known)."""
        at = np.flatnonzero(self.bitmap[hashes >> self.shift])
        if not len(at) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.searchsorted(self.known, hashes[at])
        k[k == len(self.known)] = 0
        ok = self.known[k] == hashes[at]
        return at[ok], k[ok]


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> dict:
    """Corpus counts, over all documents, of the words of an item block."""
    probe = docs.sparkSession.sparkContext.broadcast(Probe(vocabulary))

    def count(batches):
        p = probe.value
        total = np.zeros(len(p.known), np.int64)
        for batch in slices(batches):
            w = Words(*column(batch, "text"), NOT_ALNUM)
            total += np.bincount(p.find(w.hash)[1], minlength=len(total))
        some = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(p.known.view(np.int64)[some]), pa.array(total[some])], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r[0]: r[1] for r in rows}


def scan(batch: pa.RecordBatch, win: Windows) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a batch, (start, end) words of verified hits, and (document, item) pairs."""
    w = Words(*column(batch, "text"), NOT_ALNUM)
    at, k = win.probe.find(w.hash)
    many = win.prefix_from[k + 1] - win.prefix_from[k]
    rows = np.repeat(np.arange(len(at)), many)
    cand = win.by[np.repeat(win.prefix_from[k], many) + np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)]
    start = at[rows] - win.offset[cand]
    doc = np.searchsorted(w.lo, at[rows], "right") - 1
    ok = (start >= w.lo[doc]) & (start + win.size[cand] <= w.hi[doc])
    start, cand, doc = start[ok], cand[ok], doc[ok]
    same = np.zeros(len(start), bool)
    for n in np.unique(win.size[cand]):
        of = np.flatnonzero(win.size[cand] == n)
        same[of] = gram(w.hash, start[of], int(n)) == win.keys[cand[of]]
    start, cand, doc = start[same], cand[same], doc[same]
    same = same_words((column(batch, "text")[0], w.start, w.end), start, win.words, win.at[cand], win.size[cand])
    start, cand, doc = start[same], cand[same], doc[same]
    spans = np.stack([start, start + win.size[cand]], 1) if len(start) else np.zeros((0, 2), np.int64)
    many = win.item_from[cand + 1] - win.item_from[cand]
    rows = np.repeat(np.arange(len(cand)), many)
    item = win.items[np.repeat(win.item_from[cand], many) + np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)]
    pairs = np.unique(np.stack([doc[rows], item], 1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
    return w, spans, pairs


def covered(spans: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Words of each text inside any span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return total[hi] - total[lo]


def words_of(w: Words, data: np.ndarray, first: int, last: int) -> list[bytes]:
    return [LOWER[data[s:e]].tobytes() for s, e in zip(w.start[first:last].tolist(), w.end[first:last].tolist(), strict=True)]


def window_rows(items: DataFrame, width: int) -> DataFrame:
    """(item, window, n, words): every window of every item, its words joined by spaces, their number and their hashes."""

    def cut(batches):
        for batch in slices(batches, limit=1 << 18):
            data, offsets = column(batch, "text")
            w = Words(data, offsets, NOT_ALNUM)
            at = [(i, k) for i, n in enumerate(w.count.tolist()) if n for k in range(max(n - width, 0) + 1)]
            all_words = words_of(w, data, 0, len(w.start))
            lo = w.lo.tolist()
            ends = [(lo[i] + k, lo[i] + k + min(int(w.count[i]), width)) for i, k in at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array([i for i, _ in at], pa.int64())), pa.array([b" ".join(all_words[a:b]) for a, b in ends], pa.binary()).view(pa.string()),
                 pa.array([b - a for a, b in ends], pa.int32()), pa.array([w.hash[a:b].view(np.int64) for a, b in ends], pa.list_(pa.int64()))],
                names=["item", "window", "n", "words"])

    rows = items.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(cut, "item string, window string, n int, words array<bigint>")


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(word, n): occurrences of every word's hash in the documents, combined slice by slice."""

    def count(batches):
        for batch in slices(batches):
            keys, n = np.unique(Words(*column(batch, "text"), NOT_ALNUM).hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def joined_items(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """What broadcast_items gives, by shuffles on prefix words: nothing of the items need fit anywhere."""
    rows = materialise(window_rows(items, width), "windows")
    distinct = rows.groupBy("window").agg(F.first("n").alias("size"), F.first("words").alias("words"))
    counts = corpus_counts(docs).join(rows.select(F.explode("words").alias("word")).distinct(), "word", "left_semi")
    placed = distinct.select("window", "size", F.posexplode("words").alias("offset", "word")).join(counts, "word", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("p")
    prefix = materialise(placed.groupBy("window", "size").agg(rarest).select("window", "size", "p.word", "p.offset"), "prefixes")
    shared = docs.sparkSession.sparkContext.broadcast(wanted_bitmap(prefix.select(F.col("word").alias("node"))))

    def places(batches):
        bits = shared.value
        for batch in slices(batches):
            data, offsets = column(batch, "text")
            w = Words(data, offsets, NOT_ALNUM)
            at = np.flatnonzero((bits[w.hash >> np.uint64(64 - WANTED_BITS)] >> (w.hash & np.uint64(63))) & np.uint64(1) == 1)
            doc = np.searchsorted(w.hi, at, "right")
            first, last = np.maximum(at - width + 1, w.lo[doc]), np.minimum(at + width, w.hi[doc])
            for lo in range(0, len(at), 4096):
                to = slice(lo, lo + 4096)
                near = [[x.decode() for x in words_of(w, data, a, b)] for a, b in zip(first[to].tolist(), last[to].tolist(), strict=True)]
                of = pa.array(doc[to])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k1").take(of), batch.column("k2").take(of), pa.array(w.hash[at[to]].view(np.int64)), pa.array(at[to] - w.lo[doc[to]]),
                     pa.array((at - first)[to], pa.int32()), pa.array(near, pa.list_(pa.string()))], names=["k1", "k2", "word", "at", "left", "near"])

    keyed = docs.withColumns({"k1": F.xxhash64(F.coalesce("text", F.lit(""))), "k2": F.xxhash64(F.lit(7), F.coalesce("text", F.lit("")))})
    found = keyed.select("k1", "k2", "text").mapInArrow(places, "k1 bigint, k2 bigint, word bigint, at bigint, left int, near array<string>").join(prefix, "word")
    inside = (F.col("left") >= F.col("offset")) & (F.size("near") - F.col("left") >= F.col("size") - F.col("offset"))
    same = F.expr("array_join(slice(near, greatest(left - offset, 0) + 1, size), ' ') = window")
    hits = materialise(found.where(inside & same).select("k1", "k2", "window", (F.col("at") - F.col("offset")).alias("start"), "size").distinct(), "hits")
    spans = hits.groupBy("k1", "k2").agg(F.flatten(F.collect_set(F.array("start", F.col("start") + F.col("size")))).alias("spans"))
    named = hits.select("k1", "k2", "window").distinct().join(rows.where("item IS NOT NULL").select("window", "item").distinct(), "window")
    named = named.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    doc = F.struct(*[c for c in docs.columns if c != "text"]).alias("doc")
    return (keyed.select(doc, "text", "k1", "k2").join(spans, ["k1", "k2"], "left").join(named, ["k1", "k2"], "left").select("doc", "text", "spans", "items"))


def broadcast_items(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(doc, text, spans, items): hit words of each document, from and to in turn, and the ids of its items; the items are broadcast."""
    block = [(r[0], r[1]) for r in items.select("item_id", "text").where("text IS NOT NULL").collect()]
    win = Windows(block, width)
    win.set_rarity(word_counts(docs, win.vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast(win)

    def hits(batches):
        win = shared.value
        for batch in slices(batches):
            w, spans, pairs = scan(batch, win)
            doc = np.searchsorted(w.lo, spans[:, 0], "right") - 1
            span_lists, item_lists = [None] * len(batch), [None] * len(batch)
            for d in np.unique(doc):
                span_lists[d] = (spans[doc == d] - w.lo[d]).ravel().tolist()
                item_lists[d] = sorted({str(win.ids[i]) for i in pairs[pairs[:, 0] == d, 1] if win.ids[i] is not None})
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text"), pa.array(span_lists, pa.list_(pa.int64())),
                                              pa.array(item_lists, pa.list_(pa.string()))], names=["doc", "text", "spans", "items"])

    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"), "text")
    told = [T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
    return rows.mapInArrow(hits, T.StructType([*rows.schema.fields, *told]))


def find_items(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """(doc, text, n_words, n_hit, n_items, items_sha256, contaminated); doc holds the other columns of docs."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = (broadcast_items if size <= BLOCK_BYTES else joined_items)(docs, items, width)

    def report(batches):
        for batch in slices(batches):
            w = Words(*column(batch, "text"), NOT_ALNUM)
            spans = [np.array(s or [], np.int64).reshape(-1, 2) + lo for s, lo in zip(batch.column("spans").to_pylist(), w.lo, strict=True)]
            n_hit = covered(np.concatenate(spans), w.lo, w.hi, len(w.hash))
            ids = [i or [] for i in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("text"), pa.array(w.count), pa.array(n_hit), pa.array([len(i) for i in ids], pa.int64()),
                 pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in ids]), pa.array(n_hit > 0)],
                names=["doc", "text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    told = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]
    return found.mapInArrow(report, T.StructType([*found.schema.fields[:2], *(T.StructField(n, t) for n, t in told)]))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """One row per document: words, hit words, items with occurring windows, and their digest."""
    found = find_items(docs.select("doc_id", "text"), items, width)
    return found.select("doc.doc_id", *found.columns[2:])
