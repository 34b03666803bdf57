"""Suffix-array dedup: removes every byte covered by a string of `length` bytes that also starts anywhere else.

Every window of `length` bytes has an anchor, the leftmost least hash among its 32-byte grams, which depends on the
window's bytes alone; equal windows thus have equal anchors. Consecutive windows with one anchor form a run, and a run's
bytes are its context. Runs are dealt to shards by anchor, so equal windows meet in one shard and nothing else has to.

In a shard, anchors that occur once are done. Contexts that occur twice or more as a whole are repeated in all
their windows. One text of each different context of an anchor is then fetched, in sorted pieces of PIECE bytes: a suffix
array of the piece is built by Larsson-Sadakane refinement, common prefixes by Kasai's rule (only positions whose
left neighbours differ are compared, the others follow from the position before), and windows whose common prefix
reaches `length` are repeated. An anchor with more contexts than a piece holds is spread over several pieces, whose sorted
windows are merged by binary search. Contexts of one anchor are told apart by 64-bit hashes of their windows.

Matches never cross texts. A null or empty text, or one shorter than `length`, has nothing to remove. Repeated rows are occurrences of each other, and equal strings are alike
whichever comes first, so there are no ties. Occurrences of one context are found before the shuffle, among the FLUSH runs that a task holds: one of them goes to the anchor's
shard, and the others are dealt evenly by text, so that the shard of a very common passage gets no more than one of every task's hold. Of its texts one of each context is fetched. Very long texts are worked through in overlapping pieces. An empty table gives an empty result. Other columns
are carried in the struct `doc`.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.ngram_join import WANTED_BITS, deal, wanted_bitmap
from tidemark.llm.session import materialise, parts
from tidemark.llm.text import _STEP, _VALUES, column, lists, mix, slices

GRAM = 32
#: Bytes of contexts in one suffix array.
PIECE = 1 << 20
#: Runs held in a task before they are sent off.
FLUSH = 1 << 18
#: Bytes of text whose runs are found at once; longer texts are taken in chunks.
CHUNK = 1 << 20
#: Mark of a place whose context was found twice or more before it was sent to its shard.
FULL = 1


def _powers(n: int) -> int:
    return pow(int(_STEP), n, 1 << 64)


def _join(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """Hashes of strings a then b, where a has `shift` bytes."""
    return a + b * np.uint64(_powers(shift))


def runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """(text, first start, last start, anchor - first, anchor hash, context hash) of each run, in order."""
    begin, end = int(offsets[0]), int(offsets[-1])
    none = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if end - begin < length:
        return none
    g = [_VALUES[data[begin:end]]]
    for k in range(7):  # hashes of 2, 4, ..., 128 bytes
        g.append(_join(g[-1][: -(1 << k)], g[-1][1 << k :], 1 << k) if len(g[-1]) > 1 << k else g[-1][:0])
    h = mix(g[5]) | np.uint64(1)
    width = length - GRAM + 1
    m, have = h, 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    starts = len(m)
    ok = np.zeros(starts + 1, np.int32)  # starts whose window lies in one text
    lo, hi = offsets[:-1] - begin, offsets[1:] - begin - length + 1
    some = hi > lo
    np.add.at(ok, lo[some], 1)
    np.add.at(ok, hi[some], -1)
    valid = np.cumsum(ok[:-1]) > 0
    m = np.where(valid, m, np.uint64(0))
    top = np.concatenate([np.zeros(width - 1, np.uint64), m, np.zeros(len(h) - starts, np.uint64)])
    have = 1
    while have < width:
        step = min(have, width - have)
        top = np.maximum(top[:-step], top[step:])
        have += step
    anchors = np.flatnonzero(h == top[: len(h)])
    if not len(anchors):
        return none
    change = np.ones(starts, bool)
    change[1:] = (m[1:] != m[:-1]) | (valid[1:] != valid[:-1])
    after = anchors[anchors + 1 < starts] + 1
    change[after] = True
    first_of_text = lo[some]
    change[first_of_text] = True
    seg = np.flatnonzero(change & valid)
    seg_end = np.flatnonzero(np.append(change[1:] | ~valid[1:], True) & valid)
    k = np.searchsorted(anchors, seg)
    while True:  # the first anchor at or after the start that holds the least hash
        wrong = h[anchors[k]] != m[seg]
        if not wrong.any():
            break
        k[wrong] += 1
    text = np.searchsorted(offsets - begin, seg, "right") - 1
    head = np.append(True, (k[1:] != k[:-1]) | (text[1:] != text[:-1]))
    at = np.flatnonzero(head)
    s, e, a, text = seg[at], seg_end[np.append(at[1:], len(seg)) - 1], anchors[k[at]], text[at]

    def whole(x):
        out, done = np.zeros(len(x), np.uint64), 0
        for bit in range(30, -1, -1):
            while length - done >= 1 << bit and bit <= 7:
                out += g[bit][x + done] * np.uint64(_powers(done))
                done += 1 << bit
        return out

    context = mix(mix(whole(s)) + mix(whole(e) + np.uint64(1)) * _STEP + ((a - s).astype(np.uint64) << np.uint64(32)) + (e - s).astype(np.uint64))
    return text, s + begin - offsets[text], e + begin - offsets[text], a - s, mix(h[a] + _STEP), context


def suffix_array(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) by Larsson-Sadakane refinement: only groups not yet sorted are sorted again, by twice the depth."""
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key |= padded[j : j + n] << np.uint64(56 - 8 * j)
    tail = np.arange(max(0, n - 8), n)  # a text's end sorts before a zero byte
    sa = np.lexsort((np.minimum(n - np.arange(n), 8), key)) if len(tail) and (key[tail] & np.uint64(255) == 0).any() else np.argsort(key, kind="stable")
    short = np.minimum(n - sa, 8)
    head = np.append(True, (key[sa[1:]] != key[sa[:-1]]) | (short[1:] != short[:-1]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.flatnonzero(head)[np.cumsum(head) - 1]
    where = np.flatnonzero(~(head & np.append(head[1:], True)))
    h = 8
    while len(where):
        s = sa[where]
        nxt = s + h
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        pair = (rank[s] << 32) | second
        order = np.argsort(pair, kind="stable")
        s, pair = s[order], pair[order]
        sa[where] = s
        head = np.append(True, pair[1:] != pair[:-1])
        rank[s] = where[head][np.cumsum(head) - 1]
        where = where[~(head & np.append(head[1:], True))]
        h *= 2
    return sa, rank


def common_prefixes(buf: np.ndarray, sa: np.ndarray, rank: np.ndarray, direct: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, by position, right up to cap less the distance to `direct`.

    Kasai's rule: where the bytes to the left agree, the prefix is that of the position before less one. The other
    positions, and those in `direct`, are compared.
    """
    n = len(buf)
    before = np.where(rank > 0, sa[rank - 1], -1)
    derived = np.zeros(n, bool)
    derived[1:] = (before[1:] > 0) & (buf[np.arange(n - 1)] == buf[np.maximum(before[1:] - 1, 0)])
    derived[direct] = False
    at = np.flatnonzero(~derived)
    got = np.zeros(len(at), np.int64)
    live = np.flatnonzero(before[at] >= 0)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1))
    while len(live):
        i, j = at[live] + got[live], before[at[live]] + got[live]
        inside = (i < n) & (j < n)
        live, i, j = live[inside], i[inside], j[inside]
        if not len(live):
            break
        same = word[i] == word[j]
        run = np.where(same.all(1), 8, same.argmin(1))
        run = np.minimum(run, n - np.maximum(i, j))
        got[live] += run
        live = live[(run == 8) & (got[live] < cap)]
    which = np.searchsorted(at, np.arange(n), "right") - 1
    return np.maximum(got[which] - (np.arange(n) - at[which]), 0)


def repeated_windows(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """For each piece (bytes, context starts, windows of each context), which of its windows occur again in any piece."""
    out, known = [], []
    for buf, starts, many in pieces:
        sa, rank = suffix_array(buf)
        plcp = common_prefixes(buf, sa, rank, starts, 2 * length + 2 * (length - GRAM))
        of = np.repeat(starts, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        group = np.cumsum(plcp[sa] < length)
        mine = group[rank[of]]
        count = np.bincount(mine)
        again = count[mine] > 1
        if len(pieces) > 1:  # one window of each group, sorted by its bytes' hash, against those of the other pieces
            groups, first = np.unique(mine, return_index=True)
            words = np.lib.stride_tricks.as_strided(buf, (len(buf) - length + 1, length), (1, 1))[of[first]]
            sums = np.zeros(len(first), np.uint64)
            for k in range(length):
                sums += _VALUES[words[:, k]] * np.uint64(_powers(k))
            order = np.argsort(sums)
            for q, (other, other_groups) in enumerate(known):
                at = np.searchsorted(other, sums)
                at[at == len(other)] = 0
                hit = other[at] == sums
                again |= np.isin(mine, groups[hit])
                theirs, marks = out[q]
                out[q] = (theirs, marks | np.isin(theirs, other_groups[at[hit]]))
            known.append((sums[order], groups[order]))
        out.append((mine, again))
    return [again for _, again in out]


def _intervals(starts: np.ndarray, again: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(again)
    if not len(at):
        return at, at
    s = starts[at]
    head = np.append(True, s[1:] != s[:-1] + 1)
    return s[head], s[np.append(np.flatnonzero(head)[1:], len(s)) - 1] + length


def _key() -> Column:
    return F.xxhash64(F.lit("text"), F.col("doc_id"), F.coalesce("text", F.lit("")))


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(node, begins, ends): byte spans of repeated windows, some of them overlapping, by text key."""
    n_parts = parts(docs.sparkSession)
    keyed = docs.select(_key().alias("node"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") >= length)

    def post(batches):
        held, size = [], 0

        def flush():
            node, place, key, ctx = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ctx, key))
            node, place, key, ctx = node[order], place[order], key[order], ctx[order]
            head = np.append(True, (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1]))
            at = np.flatnonzero(head)
            place[at[np.diff(np.append(at, len(key))) > 1]] |= FULL
            known, known_place = node[~head], place[~head]
            order = np.argsort(known.view(np.uint64))
            known, known_place = known[order], known_place[order]
            k, k_known = np.diff(deal(key[at], n_parts)), np.diff(deal(known.view(np.uint64), n_parts))
            return pa.RecordBatch.from_arrays(
                [pa.array(range(n_parts), pa.int32()), *(lists(x[at].view(np.int64), k, pa.int64()) for x in (node, place, key, ctx)),
                 *(lists(x, k_known, pa.int64()) for x in (known, known_place))],
                names=["part", "nodes", "places", "keys", "contexts", "known", "known_places"])

        for batch in slices(batches, limit=CHUNK):
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            data, offsets = column(batch, "text")
            whole = [(offsets, 0)] if len(batch) > 1 else [(np.array([c, min(c + CHUNK, offsets[1])]), c - offsets[0])
                                                           for c in range(int(offsets[0]), int(offsets[1]) - length + 1, CHUNK - length + 1)]
            for ends, shift in whole:
                text, s, e, _, key, ctx = runs(data, ends, length)
                s, e = s + shift, e + shift
                held.append((nodes[text], (s << 24) | ((e - s) << 12), key, ctx))
                size += len(text)
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def by_node(node, place, key):
        order = np.argsort(node, kind="stable")
        node, place, key = node[order], place[order], key[order]
        heads = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else order
        ends = np.append(heads[1:], len(node))
        for at in range(0, len(heads), 8192):
            lo, hi = heads[at : at + 8192], ends[at : at + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(node[lo]), *(lists(x[lo[0] : hi[-1]], hi - lo, pa.int64()) for x in (place, key))],
                                             names=["node", "places", "keys"])

    def judge(batches):
        cols = [[np.zeros(0, np.int64)] for _ in range(4)]
        for batch in batches:
            known, place = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("known", "known_places"))
            yield from by_node(known, (place << 2) | 1, np.zeros_like(known))
            for c, name in zip(cols, ("nodes", "places", "keys", "contexts"), strict=True):
                c.append(batch.column(name).flatten().to_numpy(zero_copy_only=False))
        node, place, key, ctx = (np.concatenate(c) for c in cols)
        order = np.lexsort((ctx, key))
        node, place, key, ctx = node[order], place[order], key[order], ctx[order]
        if not len(key):
            return
        k_head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        c_head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])))
        c_size = np.diff(np.append(c_head, len(key)))
        full = np.repeat((c_size > 1) | (np.bitwise_or.reduceat(place, c_head) & FULL > 0), c_size)
        contexts_of_key = np.add.reduceat(np.isin(np.arange(len(key)), c_head).astype(np.int64), k_head)
        several = np.repeat(contexts_of_key > 1, np.diff(np.append(k_head, len(key))))
        first = np.zeros(len(key), bool)
        first[c_head] = True
        ask = several & first
        rows = np.flatnonzero(full | ask)
        yield from by_node(node[rows], ((place[rows] & ~FULL) << 2) | full[rows] | 2 * ask[rows], key[rows])

    found = materialise(keyed.mapInArrow(post, "part int, nodes array<bigint>, places array<bigint>, keys array<bigint>, contexts array<bigint>, "
                                          "known array<bigint>, known_places array<bigint>")
                        .repartitionById(n_parts, F.col("part")).mapInArrow(judge, "node bigint, places array<bigint>, keys array<bigint>"), "runs")
    asked = found.where("exists(places, p -> (p & 2) = 2)")
    bitmap = docs.sparkSession.sparkContext.broadcast(wanted_bitmap(asked.select("node")))

    def wanted(batches):
        words = bitmap.value
        for batch in batches:
            ids = batch.column("node").to_numpy(zero_copy_only=False)
            u = ids.view(np.uint64)
            rows = np.flatnonzero((words[u >> np.uint64(64 - WANTED_BITS)] >> (u & np.uint64(63))) & np.uint64(1) == 1)
            rows = rows[np.unique(ids[rows], return_index=True)[1]]
            yield batch.take(pa.array(rows))

    gathered = asked.groupBy("node").agg(F.flatten(F.collect_list("places")).alias("places"), F.flatten(F.collect_list("keys")).alias("keys"))
    texts = keyed.mapInArrow(wanted, "node bigint, text string").dropDuplicates(["node"]).join(gathered, "node")

    def cut(batches):
        for batch in slices(batches, limit=CHUNK):
            data, offsets = column(batch, "text")
            owner = np.repeat(np.arange(len(batch)), np.diff(batch.column("places").offsets.to_numpy()))
            place = batch.column("places").flatten().to_numpy(zero_copy_only=False)
            key = batch.column("keys").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            need = np.flatnonzero(place & 2)
            need = need[np.argsort(key[need])]
            owner, place, key = owner[need], place[need], key[need]
            s, width = place >> 26, (place >> 14) & 4095
            size = width + length
            begin = offsets[owner] + s
            at = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            blob = data[at]
            ends = np.concatenate([[0], np.cumsum(size)])
            deals = deal(key, n_parts)
            k = np.diff(deals)
            nodes = batch.column("node").to_numpy(zero_copy_only=False)[owner]
            blobs = [blob[ends[a] : ends[b]].tobytes() for a, b in zip(deals[:-1], deals[1:], strict=True)]
            some = np.flatnonzero(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n_parts), pa.int32()), *(lists(x, k, pa.int64()) for x in (nodes, place, key.view(np.int64))), pa.array(blobs, pa.binary())],
                names=["part", "nodes", "places", "keys", "bytes"]).take(pa.array(some))

    def compare(batches):
        cols, blobs = [[np.zeros(0, np.int64)] for _ in range(3)], [np.zeros(0, np.uint8)]
        for batch in batches:
            for c, name in zip(cols, ("nodes", "places", "keys"), strict=True):
                c.append(batch.column(name).flatten().to_numpy(zero_copy_only=False))
            blobs += [np.frombuffer(b, np.uint8) for b in batch.column("bytes").to_pylist()]
        node, place, key = (np.concatenate(c) for c in cols)
        blob = np.concatenate(blobs)
        if not len(key):
            return
        size = ((place >> 14) & 4095) + length
        begin = np.cumsum(size) - size
        order = np.argsort(key, kind="stable")
        key_head = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        key_end = np.append(key_head[1:], len(order))
        sizes = np.concatenate([[0], np.cumsum(size[order])])
        at = 0
        while at < len(key_head):
            to = at + 1
            while to < len(key_head) and sizes[key_end[to]] - sizes[key_head[at]] <= PIECE:
                to += 1
            sel = order[key_head[at] : key_end[to - 1]]
            pieces, rows, lo = [], [], 0
            while lo < len(sel):
                hi = lo + max(1, int(np.searchsorted(np.cumsum(size[sel[lo:]]), PIECE, "right")))
                part = sel[lo:hi]
                where = np.repeat(begin[part], size[part]) + np.arange(size[part].sum()) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
                pieces.append((blob[where], np.cumsum(size[part]) - size[part], size[part] - length + 1))
                rows.append(part)
                lo = hi
            out_node, out_s, out_e = [], [], []
            for (_, _, many), part, again in zip(pieces, rows, repeated_windows(pieces, length), strict=True):
                first = np.cumsum(many) - many
                hit = np.add.reduceat(again.astype(np.int64), first) > 0
                for q in np.flatnonzero(hit & (place[part] & 1 == 0)).tolist():
                    s, e = _intervals(np.arange(many[q]) + (place[part[q]] >> 26), again[first[q] : first[q] + many[q]], length)
                    out_node.append(np.full(len(s), node[part[q]]))
                    out_s.append(s)
                    out_e.append(e)
            if out_node:
                n, s, e = np.concatenate(out_node), np.concatenate(out_s), np.concatenate(out_e)
                by = np.argsort(n, kind="stable")
                n, s, e = n[by], s[by], e[by]
                heads = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
                k = np.diff(np.append(heads, len(n)))
                yield pa.RecordBatch.from_arrays([pa.array(n[heads]), lists(s, k, pa.int64()), lists(e, k, pa.int64())], names=["node", "begins", "ends"])
            at = to

    edges = (texts.mapInArrow(cut, "part int, nodes array<bigint>, places array<bigint>, keys array<bigint>, bytes binary")
             .repartitionById(n_parts, F.col("part")).mapInArrow(compare, "node bigint, begins array<bigint>, ends array<bigint>"))
    whole = (found.select("node", F.expr("filter(places, p -> (p & 1) = 1)").alias("p")).where("size(p) > 0")
             .select("node", F.expr("transform(p, x -> shiftright(x, 26))").alias("begins"),
                     F.expr(f"transform(p, x -> shiftright(x, 26) + (shiftright(x, 14) & 4095) + {length})").alias("ends")))
    return (whole.unionByName(edges).groupBy("node")
            .agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends")))


def removed_spans(begins, ends) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes."""
    b, e = np.array(begins, np.int64), np.array(ends, np.int64)
    if not len(b):
        return b, e
    order = np.argsort(b, kind="stable")
    b, e = b[order], np.maximum.accumulate(e[order])
    head = np.append(True, b[1:] > e[:-1])
    return b[head], e[np.append(np.flatnonzero(head)[1:], len(b)) - 1]


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc, kept, n_bytes, n_removed, n_spans, kept_sha256, begins, ends): doc holds all columns but text, kept the bytes
    that stay, begins and ends the removed runs."""
    if not GRAM < length <= 255:
        raise ValueError(f"length must be above {GRAM} and at most 255")
    spans = materialise(repeated_spans(docs, length), "spans")
    bitmap = docs.sparkSession.sparkContext.broadcast(wanted_bitmap(spans.select("node")))

    def flag(batches):
        words = bitmap.value
        for batch in batches:
            u = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
            hit = (words[u >> np.uint64(64 - WANTED_BITS)] >> (u & np.uint64(63))) & np.uint64(1) == 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=["doc", "node", "text", "hit"])

    def apply(batches):
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            kept, sizes, removed, b_all, e_all = [], [], [], [], []
            for t, b, e in zip(texts, batch.column("begins").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                t = t or b""
                b, e = removed_spans(b or [], e or [])
                edges = np.concatenate([[0], np.stack([b, e], 1).ravel(), [len(t)]]).tolist()
                kept.append(b"".join(t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                sizes.append(len(t))
                removed.append(int((e - b).sum()))
                b_all.append(b.tolist())
                e_all.append(e.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array([len(b) for b in b_all], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                 pa.array(b_all, pa.list_(pa.int64())), pa.array(e_all, pa.list_(pa.int64()))],
                names=["doc", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "begins", "ends"])

    keyed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"), _key().alias("node"), "text")
    flagged = keyed.mapInArrow(flag, T.StructType([*keyed.schema.fields, T.StructField("hit", T.BooleanType())]))
    none = F.lit(None).cast("array<bigint>")
    rows = (flagged.where("hit").join(spans, "node", "left").select("doc", "text", "begins", "ends")
            .unionByName(flagged.where("NOT hit").select("doc", "text", none.alias("begins"), none.alias("ends"))))
    places = T.ArrayType(T.LongType())
    told = [("kept", T.BinaryType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()),
            ("begins", places), ("ends", places)]
    return rows.mapInArrow(apply, T.StructType([rows.schema["doc"], *(T.StructField(n, t) for n, t in told)]))


def suffix_dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id and what remove_repeats tells of every text."""
    found = remove_repeats(docs.select("doc_id", "text"), length)
    return found.select("doc.doc_id", *found.columns[1:])
