"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, and its connected components.

Sets of size n that may link at similarity t share at least c = ceil(tn) shingles with a partner, so among the first
n - c + l shingles of one global order they share l. Small (light) sets enumerate the subsets of two shingles of
that prefix and meet where a subset is equal; large (heavy) sets put the prefix for l = 1 into inverted lists, which
they share with the light sets that are within the length bound of some heavy set. The boundary is the size
at which enumerating costs more than scanning, from the counts of all sets and the lengths of all lists by size.
The order puts shingles of one document first, then rare ones, then frequent ones, each by hash. It is counted over all
documents for the low part of the hash range that prefixes reach (the rest comes before the frequent ones) and kept
as two bitmaps of bounded size; two shingles that share a bit only share a place in the order.

Equal sets are one node. Each list is first checked as a star around one member, then, where its members are still in
several components, member by member, in blocks of bounded size; so no group is expanded into pairs, and no link between
different sets is lost. Both checks compare 16-bit images of the sets, whose overlap as multisets is never below the
true one, and so only refute; what is left is verified on 64-bit shingle hashes of the whole texts, first one link to a
smaller node for each node, then those links that still join different components. If a link of the second check
is refuted, its lists are checked again on the full hashes.

A null or empty text has no shingles, n_shingles 0, and its own doc_id as component. Repeated rows are equal sets.
An empty table gives an empty result. Extra columns are ignored.
"""


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.session import materialise, parts
from tidemark.llm.text import Words, column, gram, grams, lists, mix, slices

#: Lists longer than this are put last in the order.
FREQUENT = 32
#: The bitmaps of the order have at most 2 ** MOST_BITS bits.
MOST_BITS = 29
#: Postings held in a task before they are sent off.
FLUSH = 1 << 18
#: Most sets that a task compares member by member at once.
BLOCK = 1000
#: A star is dealt to several tasks beyond this many members.
STAR = 2000
#: The bitmap of wanted sets has 64 * 2 ** WANTED_BITS bits.
WANTED_BITS = 18


def shingle_sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(*column(batch, "text"))
    all_grams = grams(w.hash, width)
    out = []
    for lo, n in zip(w.lo.tolist(), w.count.tolist(), strict=True):
        out.append(np.unique(all_grams[lo : lo + n - width + 1]) if n >= width else gram(w.hash, np.array([lo]), n) if n else all_grams[:0])
    return out


def set_id(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def needed(n, percent: int):
    """Least overlap with any partner."""
    return -(-n * percent // 100)


def size_bin(n):
    return np.minimum(np.log2(np.maximum(n, 1)) * 4, 127).astype(np.int64)


def deal(keys: np.ndarray, n: int, limit: float = 2.0**64) -> np.ndarray:
    """Ends of the n equal ranges of sorted hashes below the limit."""
    edges = (np.arange(1, n, dtype=np.float64) / n * limit).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def counted_below(percent: int) -> float:
    return min(0.9, 1.6 * (100 - percent) / 100 + 0.01) * 2.0**64


class Order:
    """Places shingles: of one document, rare, not counted, frequent; then by hash."""

    def __init__(self, percent: int, shingles: int):
        self.limit = counted_below(percent)
        self.bits = min(MOST_BITS, max(16, int(np.ceil(np.log2(max(1, shingles) / 4)))))
        self.shared, self.often = np.zeros(1 << self.bits - 3, np.uint8), np.zeros(1 << self.bits - 3, np.uint8)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        return np.minimum(hashes.astype(np.float64) * (2.0**self.bits / self.limit), 2.0**self.bits - 1).astype(np.int64)

    def prefix(self, s: np.ndarray, n: int) -> np.ndarray:
        cut = int(np.searchsorted(s, np.uint64(int(self.limit))))
        at = self.place(s[:cut])
        byte, bit = at >> 3, 7 - (at & 7).astype(np.uint8)
        tier = np.full(len(s), 2, np.uint8)
        tier[:cut] = ((self.shared[byte] >> bit) & 1) + 2 * ((self.often[byte] >> bit) & 1)
        return s[np.argsort(tier, kind="stable")[:n]]


def documents(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, node): size and set number of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sets(batches):
        for batch in slices(batches):
            found = shingle_sets(batch, width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in found], pa.int64()),
                                              pa.array([set_id(s) for s in found], pa.int64())], names=["doc_id", "n", "node"])

    return docs.select("doc_id", "text").mapInArrow(sets, f"doc_id {kind}, n bigint, node bigint")


def list_statistics(docs: DataFrame, width: int, percent: int, n_parts: int, shingles: int) -> tuple[Order, dict, dict]:
    """(order, total list length met and postings by size bin), over all documents."""
    order = Order(percent, shingles)
    limit, place, n_bits = order.limit, order.place, order.bits

    def count(batches):
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            ends = deal(keys, n_parts, limit)
            return pa.RecordBatch.from_arrays([pa.array(range(n_parts), pa.int32()), lists(keys.view(np.int64), np.diff(ends), pa.int64()),
                                               lists(n, np.diff(ends), pa.int32())], names=["part", "keys", "counts"])

        for batch in slices(batches):
            for s in shingle_sets(batch, width):
                low = s[: np.searchsorted(s, np.uint64(int(limit)))]
                held.append((low & ~np.uint64(127)) | np.uint64(size_bin(max(len(s), 1))))
                size += len(low)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def total(batches):
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            keys.append(batch.column("keys").flatten().to_numpy(zero_copy_only=False))
            counts.append(batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        keys, counts = np.concatenate(keys).view(np.uint64), np.concatenate(counts)
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
        heads = np.flatnonzero(np.append(True, (keys[1:] >> np.uint64(7)) != (keys[:-1] >> np.uint64(7)))) if len(keys) else np.zeros(0, np.int64)
        df = np.add.reduceat(counts, heads) if len(heads) else counts
        at = place(keys[heads])
        start = int(at[0]) >> 3 if len(at) else 0
        packed = []
        for rows in (df > 1, df > FREQUENT):
            bits = np.zeros(((int(at[-1]) >> 3) - start + 1) * 8 if len(at) else 0, np.uint8)
            bits[at[rows] - start * 8] = 1
            packed.append(np.packbits(bits).tobytes())
        each = np.repeat(np.where(df > FREQUENT, 0, df), np.diff(np.append(heads, len(keys))))
        b = (keys & np.uint64(127)).astype(np.int64)
        one = lambda x, kind: lists(x, np.array([len(x)]), kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array([start], pa.int64()), pa.array([packed[0]], pa.binary()), pa.array([packed[1]], pa.binary()),
             one(np.bincount(b, each * counts, 128), pa.float64()), one(np.bincount(b, counts, 128), pa.float64())],
            names=["start", "shared", "often", "met", "postings"])

    rows = (docs.select("text").mapInArrow(count, "part int, keys array<bigint>, counts array<int>").repartitionById(n_parts, F.col("part"))
            .mapInArrow(total, "start bigint, shared binary, often binary, met array<double>, postings array<double>"))
    met, postings = np.zeros(128), np.zeros(128)
    for r in rows.toLocalIterator():
        for bitmap, data in ((order.shared, r.shared), (order.often, r.often)):
            bitmap[r.start : r.start + len(data)] |= np.frombuffer(data, np.uint8)
        met += r.met
        postings += r.postings
    return order, dict(enumerate(met)), dict(enumerate(postings))


def boundary(sizes: dict, met: dict, postings: dict, percent: int) -> int:
    """Largest light size: where enumerating pairs of the prefix costs least against scanning lists."""
    gain, best, at = 0.0, 0.0, 1
    for b in sorted(sizes):
        n = int(2 ** ((b + 1) / 4))
        p = n - needed(n, percent) + 1
        scan = p * (1 + (met[b] / postings[b] if postings[b] else 1.0))
        gain += sizes[b] * (scan - (p + 1) * p / 2)
        if gain > best:
            best, at = gain, n
    return at


def candidate_lists(docs: DataFrame, width: int, percent: int, n_parts: int, order: Order, light: int) -> DataFrame:
    """(gid, members, sizes): distinct lists of two sets or more that share a prefix shingle or subset."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def post(batches):
        order = shared.value
        held, size = [], 0

        def flush():
            keys, nodes, n = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((nodes, keys))
            keys, nodes, n = keys[by], nodes[by], n[by]
            new = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))
            keys, nodes, n = keys[new], nodes[new], n[new]
            ends = deal(keys, n_parts)
            k = np.diff(ends)
            return pa.RecordBatch.from_arrays([pa.array(range(n_parts), pa.int32()), lists(keys.view(np.int64), k, pa.int64()),
                                               lists(nodes, k, pa.int64()), lists(n, k, pa.int32())], names=["part", "keys", "nodes", "sizes"])

        for batch in slices(batches):
            for s in shingle_sets(batch, width):
                n = len(s)
                if n < 2:  # links with nothing but its equals
                    continue
                p = n - needed(n, percent) + 1
                is_light = n <= light and needed(n, percent) >= 2
                first = order.prefix(s, p + is_light)
                keys = []
                if is_light:
                    i, j = np.triu_indices(len(first), 1)
                    a, b = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
                    keys.append(mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b)))
                if not is_light or 100 * n >= percent * light:
                    keys.append(mix(first[:p]))
                keys = np.concatenate(keys)
                held.append((keys, np.full(len(keys), set_id(s), np.int64), np.full(len(keys), n, np.int32)))
                size += len(keys)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def gather(batches):
        cols = [[np.zeros(0, np.int64)] for _ in range(3)]
        for batch in batches:
            for c, name in zip(cols, ("keys", "nodes", "sizes"), strict=True):
                c.append(batch.column(name).flatten().to_numpy(zero_copy_only=False))
        keys, nodes, n = (np.concatenate(c) for c in cols)
        order = np.lexsort((nodes, n, keys))
        keys, nodes, n = keys[order], nodes[order], n[order].astype(np.int64)
        if len(keys):
            new = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))
            keys, nodes, n = keys[new], nodes[new], n[new]
            # a list breaks where even neighbours by size are too far apart to link
            heads = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (100 * n[:-1] < percent * n[1:])))
            size = np.diff(np.append(heads, len(keys)))
            gid = np.add.reduceat(mix(nodes.view(np.uint64)), heads)
            keep = np.flatnonzero(size > 1)
            keep = keep[np.unique(gid[keep], return_index=True)[1]]
            for at in range(0, len(keep), 4096):
                part = keep[at : at + 4096]
                rows = np.concatenate([np.arange(heads[k], heads[k] + size[k]) for k in part])
                yield pa.RecordBatch.from_arrays([pa.array(gid[part].view(np.int64)), lists(nodes[rows], size[part], pa.int64()),
                                                  lists(n[rows], size[part], pa.int64())], names=["gid", "members", "sizes"])

    return (docs.select("text").mapInArrow(post, "part int, keys array<bigint>, nodes array<bigint>, sizes array<int>")
            .repartitionById(n_parts, F.col("part")).mapInArrow(gather, "gid bigint, members array<bigint>, sizes array<bigint>")
            .dropDuplicates(["gid"]))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def may_link(n: int, m: int, percent: int) -> bool:
    return 100 * min(n, m) >= percent * max(n, m)


def links(n: int, m: int, inter: int, percent: int) -> bool:
    return 100 * inter >= percent * (n + m - inter)


def image(s: np.ndarray) -> bytes:
    """16-bit image of a set as a sorted multiset: differences, low bytes then high bytes."""
    low = np.sort((s >> np.uint64(20)).astype(np.uint16))
    return np.diff(low, prepend=np.uint16(0)).view(np.uint8).reshape(-1, 2).T.tobytes()


class Image:
    def __init__(self, data: bytes):
        low = np.cumsum(np.frombuffer(data, np.uint8).reshape(2, -1).T.copy().view(np.uint16).ravel(), dtype=np.uint16)
        self.size = len(low)
        heads = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else np.zeros(0, np.int64)
        self.values, self.counts = low[heads], np.diff(np.append(heads, len(low)))

    def overlap(self, counts: np.ndarray) -> int:
        return int(np.minimum(counts[self.values], self.counts).sum())


def wanted_bitmap(nodes: DataFrame) -> np.ndarray:
    """Bits of the wanted nodes, or-ed in Spark: at most 2 ** WANTED_BITS words come to the driver."""
    word = F.shiftrightunsigned("node", 64 - WANTED_BITS)
    bit = F.expr("shiftleft(1L, cast(node & 63 as int))")
    rows = nodes.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b")).collect()
    out = np.zeros(1 << WANTED_BITS, np.int64)
    for w, b in rows:
        out[w] = b
    return out.view(np.uint64)


def candidate_texts(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, text) of the wanted nodes, one text each."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted_bitmap(nodes))

    def pick(batches):
        words = shared.value
        for batch in slices(batches):
            ids = np.array([set_id(s) for s in shingle_sets(batch, width)], np.int64)
            u = ids.view(np.uint64)
            hit = (words[u >> np.uint64(64 - WANTED_BITS)] >> (u & np.uint64(63))) & np.uint64(1) == 1
            rows = np.flatnonzero(hit)
            rows = rows[np.unique(ids[rows], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), batch.column("text").take(pa.array(rows))], names=["node", "text"])

    return docs.select("text").mapInArrow(pick, "node bigint, text string").dropDuplicates(["node"])


def images(texts: DataFrame, width: int) -> DataFrame:
    def make(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([image(s) for s in shingle_sets(batch, width)], pa.binary())], names=["node", "image"])

    return texts.mapInArrow(make, "node bigint, image binary")


def star_rows(pairs: DataFrame, payload: DataFrame, n_parts: int) -> DataFrame:
    """Rows of each pair's member after those of its hub, in one sorted pass; wide stars are dealt to several tasks."""
    split = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("ways"))
    p = pairs.join(split, "a")
    hubs = split.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
    rows = p.select("a", "b", F.pmod(F.xxhash64("b"), F.col("ways")).cast("int").alias("way")).unionByName(hubs)
    told = rows.join(payload.withColumnRenamed("node", "b"), "b").withColumn("member", F.col("a") != F.col("b"))
    return told.repartition(n_parts, "a", "way").sortWithinPartitions("a", "way", "member")


def not_refuted(pairs: DataFrame, small: DataFrame, percent: int, n_parts: int) -> DataFrame:
    def check(batches):
        hub, size, counts = None, 0, None
        for batch in batches:
            a, b = [], []
            for x, y, member, data in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "member", "image")), strict=True):
                i = Image(data)
                if not member:
                    hub, size, counts = x, i.size, np.zeros(1 << 16, np.int32)
                    counts[i.values] = i.counts
                elif x == hub and links(size, i.size, i.overlap(counts), percent):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return star_rows(pairs, small, n_parts).mapInArrow(check, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int, n_parts: int) -> DataFrame:
    """The pairs that link, on the full shingle hashes."""

    def check(batches):
        hub, own = None, None
        for batch in slices(batches):
            a, b = [], []
            for x, y, member, s in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "member")), shingle_sets(batch, width), strict=True):
                if not member:
                    hub, own = x, s
                elif x == hub and may_link(len(own), len(s), percent) and links(len(own), len(s), overlap(own, s), percent):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return star_rows(pairs, texts, n_parts).mapInArrow(check, "a bigint, b bigint")


def block_pairs(opened: DataFrame, payload: DataFrame, width: int, percent: int, n_parts: int) -> DataFrame:
    """A spanning set of links between the components that share a list, member by member, in pairs of blocks of about BLOCK sets.

    The payload is the text, or the image, by which nothing is proved.
    """
    m = opened.withColumn("blocks", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int"))
    m = m.withColumn("own", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("gid", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "member", "label")
    kind = [c for c in payload.columns if c != "node"][0]
    told = m.join(payload.withColumnRenamed("node", "member"), "member").select("gid", "i", "j", "member", "label", kind)

    def found(gid, nodes, labels, sets):
        """Compares each member with all larger ones of other labels at once; labels merge as links are found."""
        order = sorted(range(len(sets)), key=lambda k: sets[k].size)
        size = np.array([sets[k].size for k in order])
        label = np.array([labels[k] for k in order])
        if kind == "text":
            values = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
            times, width_of = np.ones(len(values), np.int64), size
        else:
            values = np.concatenate([sets[k].values for k in order])
            times, width_of = np.concatenate([sets[k].counts for k in order]), np.array([len(sets[k].values) for k in order])
        ends = np.cumsum(width_of)
        counts = np.zeros(int(values.max(initial=0)) + 1, np.int64)
        upto = np.searchsorted(size, size * 100 // percent, "right")
        a, b = [], []
        for k in range(len(order)):
            to = int(upto[k])
            if to <= k + 1 or (label[k + 1 : to] == label[k]).all():
                continue
            own = slice(int(ends[k] - width_of[k]), int(ends[k]))
            counts[values[own]] = times[own]
            rest = slice(int(ends[k]), int(ends[to - 1]))
            inter = np.add.reduceat(np.minimum(counts[values[rest]], times[rest]), (ends - width_of)[k + 1 : to] - ends[k])
            counts[values[own]] = 0
            ok = (100 * inter >= percent * (size[k] + size[k + 1 : to] - inter)) & (label[k + 1 : to] != label[k])
            for q in (np.flatnonzero(ok) + k + 1).tolist():
                if label[q] != label[k]:
                    label[label == label[q]] = label[k]
                    x, y = nodes[order[k]], nodes[order[q]]
                    a.append(min(x, y))
                    b.append(max(x, y))
        return pa.RecordBatch.from_arrays([pa.array([gid] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["gid", "a", "b"])

    def check(batches):
        at, nodes, labels, sets = None, [], [], []
        for batch in slices(batches) if kind == "text" else batches:
            own = shingle_sets(batch, width) if kind == "text" else [Image(x) for x in batch.column("image").to_pylist()]
            for gid, i, j, node, label, s in zip(*(batch.column(c).to_pylist() for c in ("gid", "i", "j", "member", "label")), own, strict=True):
                if (gid, i, j) != at:
                    if sets:
                        yield found(at[0], nodes, labels, sets)
                    at, nodes, labels, sets = (gid, i, j), [], [], []
                nodes.append(node)
                labels.append(label)
                sets.append(s)
        if sets:
            yield found(at[0], nodes, labels, sets)

    return told.repartition(n_parts, "gid", "i", "j").sortWithinPartitions("gid", "i", "j").mapInArrow(check, "gid bigint, a bigint, b bigint")


def open_lists(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the lists that still hold several components, with their labels; from two written tables, so that a long list is not one task's."""
    members = groups.where(F.size("members") > 2).select("gid", F.explode("members").alias("member"))
    labelled = members.join(labels.withColumnRenamed("node", "member"), "member", "left").select("gid", "member", F.coalesce("root", "member").alias("label"))
    labelled = materialise(labelled, "members")
    still = labelled.groupBy("gid").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return labelled.join(materialise(still.select("gid", "size"), "still"), "gid")


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    n_parts = parts(docs.sparkSession)
    known = materialise(documents(docs, width), "sets")
    nodes = known.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"))
    order, met, postings = list_statistics(docs, width, percent, n_parts, known.agg(F.sum("n")).first()[0] or 0)
    bins = known.where("n > 1").groupBy(F.least(F.floor(F.log2("n") * 4), F.lit(127)).alias("b")).count().collect()
    light = boundary({r[0]: r[1] for r in bins}, met, postings, percent)
    groups = materialise(candidate_lists(docs, width, percent, n_parts, order, light), "lists")
    texts = materialise(candidate_texts(docs, groups.select(F.explode("members").alias("node")), width), "texts")
    small = materialise(images(texts, width), "images")

    hub = F.array_min("members")
    pairs = (groups.select(hub.alias("a"), F.expr("sizes[array_position(members, array_min(members)) - 1]").alias("na"), F.explode(F.arrays_zip("members", "sizes")).alias("m"))
             .select("a", F.col("m.members").alias("b"), "na", F.col("m.sizes").alias("nb")).where("a <> b")
             .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b").distinct())
    likely = materialise(not_refuted(pairs, small, percent, n_parts), "likely")
    sure = materialise(verified(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts, width, percent, n_parts), "sure")
    labels = components(sure)

    def apart(links: DataFrame) -> DataFrame:
        to = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias("_" + c))
        both = links.join(to("a"), "a", "left").join(to("b"), "b", "left")
        return both.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")

    def widen(more: DataFrame) -> None:
        nonlocal sure, labels
        if not more.isEmpty():
            sure = sure.unionByName(more)
            labels = components(sure)

    rest = materialise(apart(likely), "rest")
    if not rest.isEmpty():
        widen(materialise(verified(rest, texts, width, percent, n_parts), "sure"))
    opened = materialise(open_lists(groups, labels), "open")
    if not opened.isEmpty():
        guess = materialise(block_pairs(opened, small, width, percent, n_parts).distinct(), "guess")
        if not guess.isEmpty():
            right = materialise(verified(guess.select("a", "b").distinct(), texts, width, percent, n_parts), "sure")
            doubted = guess.join(right, ["a", "b"], "left_anti").select("gid").distinct()
            widen(right)
            opened = materialise(open_lists(groups.join(doubted, "gid", "left_semi"), labels), "open")
            if not opened.isEmpty():
                widen(materialise(block_pairs(opened, texts, width, percent, n_parts).select("a", "b").distinct(), "sure"))
    rooted = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_node = rooted.join(least, "root").select("node", "component_id")
    return (known.join(by_node, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
