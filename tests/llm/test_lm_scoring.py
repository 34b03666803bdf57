import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.test_text_ops import ODD, docs
from tidemark.llm import lm_scoring as lm
from tidemark.llm.registry import QUERIES
from tidemark.llm.text import Words, column

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b < 91 else b for b in (t or "").encode()))


def check_base(rows, texts):
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in words(texts[i]))
    c["end"] = len(train)
    n, v = sum(c.values()), len([x for x in c.values() if x])
    for r in rows:
        w = [*words(texts[r.doc_id]), "end"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.held_out == (r.doc_id not in train)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0


def test_base_brute_and_model_beats_bytes(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lm.lm_scoring(d).collect()
    assert len(rows) == 200
    check_base(rows, {r.doc_id: r.text for r in d.collect()})
    held = [r for r in rows if r.held_out]
    assert np.mean([r.bits_per_byte for r in held]) < 4


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = lm.lm_scoring(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_odd_texts(spark):
    texts = dict(enumerate(ODD * 3))
    rows = lm.lm_scoring(docs(spark, ODD * 3)).collect()
    assert len(rows) == len(texts)
    check_base(rows, texts)
    assert lm.lm_scoring(docs(spark, [None])).first().n_tokens == 1
    assert lm.lm_scoring(docs(spark, [None]).limit(0)).count() == 0


def test_lines_are_counted_whatever_the_counts():
    """Words of no, one and more occurrences, in chunks."""
    r = np.random.default_rng(5)
    every = sorted({bytes(r.integers(97, 100, r.integers(1, 7)).tolist()) for _ in range(300)})
    n = r.choice([0, 1, 1, 5], len(every))
    data, starts = lm.spell(b"".join(w + b" " for w in every))
    keys, seen = lm.count_lines(data, starts, n)
    want: dict = {}
    for i, w in enumerate(every):
        own, at = lm.spell(w + b" ")
        for half, by_order in enumerate(lm.line_keys(own, at)):
            for ks in by_order:
                for k, b in zip(ks.tolist(), own.tolist(), strict=True):
                    want.setdefault(k, np.zeros(16))[b >> 4 if half == 0 else b & 15] += n[i]
    assert keys.tolist() == sorted(want) and (seen == np.array([want[k] for k in sorted(want)])).all()


def test_learning_in_one_pass_beats_its_start():
    r = np.random.default_rng(6)
    every = [bytes(r.integers(97, 110, r.integers(2, 9)).tolist()) for _ in range(3000)]
    data, starts = lm.spell(b"".join(w + b" " for w in every))
    n = np.ones(len(every), np.int64)
    lines = lm.Lines(*lm.count_lines(data, starts, n))
    before = lm.Mixer.over(lines).log10(data, starts, 1.0).sum()
    m = lm.Mixer.over(lines)
    told, visits = m.learn(data, starts, n)
    assert m.log10(data, starts, 1.0).sum() > before and visits.sum() == 8 * len(data) and m.seen.sum() > visits.sum() and len(told) == len(every)


def test_kinds_fitted_over_all_documents(spark):
    """The same parting as of a fit on the driver, from documents that are not all in the start."""
    r = np.random.default_rng(2)
    texts = ["".join(r.choice(list("abcd " if i % 2 else "wxyz "), 300).tolist()) for i in range(80)] + [None, ""]
    rows = docs(spark, texts).selectExpr("doc_id", "coalesce(text, '') as text", "true as train")
    data = np.frombuffer("".join(texts[:80]).encode(), np.uint8)
    found = lm.fit_kinds(rows).of(data, np.arange(81) * 300)
    assert not set(found[::2]) & set(found[1::2])


def test_bits_are_a_distribution():
    """The probabilities of all bytes after a prefix sum to one."""
    r = np.random.default_rng(0)
    m = lm.Mixer([r.integers(0, 9, 1 << b).astype(np.float16) for b in lm.TABLE_BITS], [r.integers(0, 9, 1 << b).astype(np.float16) for b in lm.TABLE_BITS])
    ready, total, quick = lm.Ready(m), 0.0, 0.0
    for b in range(256):
        data = np.array([97, 98, b], np.uint8)
        out = sum(math.log(float(p if bit[2] else 1 - p)) for slot, bit, so_far in lm.slots(data, np.array([0]))
                  for p in [m.refine(m.mixed(*m.inputs(slot)), so_far)[2]])
        total += math.exp(out)
        quick += math.exp(sum(math.log(p if bit[2] else 1 - p) for slot, bit, so_far in lm.slots(data, np.array([0])) for p in [float(ready.probability(slot, so_far)[2])]))
    assert abs(total - 1) < 1e-6
    assert abs(quick - 1) < 1e-4


def test_ready_scores_as_the_mixer():
    r = np.random.default_rng(1)
    m = lm.Mixer([r.integers(0, 9, 1 << b).astype(np.float16) for b in lm.TABLE_BITS], [r.integers(0, 9, 1 << b).astype(np.float16) for b in lm.TABLE_BITS])
    data, starts = lm.spell(b"one three fifteen " + "été ".encode())
    assert np.allclose(lm.Ready(m).log10(data, starts), m.log10(data, starts), rtol=2e-3)


def test_refined_words_are_a_distribution():
    """Over all listed words and the end, the counts' shares sum to what spelling doesn't get."""
    counts = np.array([[5, 0, 1, 0, 0, 0], [2, 3, 4, 0, 0, 9]])
    x = lm.Refined(counts.sum(0), 7)
    x.shares = np.array([0.5, 0.3, 0.2])
    never = np.full(2, -300.0)
    each = 10.0 ** x.log10(counts, never)
    filled = counts.sum(0) > 0
    assert np.allclose(each.sum(0)[filled] + 10.0 ** x.end(-300.0), 0.8)
    assert np.isfinite(x.log10(counts * 0, np.full(2, -5000.0))).all()


def test_kinds_part_two_alphabets():
    r = np.random.default_rng(2)
    texts = [bytes(r.choice(list(b"abcd " if i % 2 else b"wxyz "), 300).tolist()) for i in range(80)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.arange(81) * 300
    counts = lm.pair_counts(data, offsets)
    assert np.allclose(counts.sum(1), 300)
    found = lm.Kinds(counts).of(data, offsets)
    assert not set(found[::2]) & set(found[1::2])
    assert (lm.Kinds(counts).of(data, np.array([0, 0, 300, 300])).shape) == (3,)


def test_every_context_has_its_own_counts(spark):
    """Lines of more contexts than the hashed tables had, dealt to ranges, are told with the counts of a direct count."""
    r = np.random.default_rng(3)
    texts = [" ".join("".join(map(chr, r.integers(97, 123, r.integers(1, 9)))) for _ in range(200)) + " \x01a ab ab\x01" for _ in range(60)]
    rows = docs(spark, texts).selectExpr("text", "true as train")
    kinds = lm.Kinds(np.zeros((0, lm.PAIRS)))
    vocab = lm.materialise(lm.vocabulary(rows, 4, kinds), "vocabulary")
    edges = lm.between_ranges(vocab, 12000, 4)
    assert len(edges) == 3
    ranges = lm.materialise(lm.by_ranges(vocab, edges, 4), "ranges")
    told = lm.told_lines(ranges, 60, 4)
    count = Counter(w for t in texts for w in words(t))
    count[b""] = 60
    every = sorted(count)
    data, starts = lm.spell(b"".join(w + b" " for w in every))
    keys, seen = lm.count_lines(data, starts, np.array([count[w] for w in every]))
    straight, met = lm.Lines(keys, seen), set()
    by_range = ranges.where("part = -1").unionByName(told.where("range >= 0")).collect()
    for k in range(4):
        blob = b"".join(bytes(x.words) for x in by_range if x.range == k and x.words is not None)
        own, at = lm.spell(blob)
        lines = lm.range_lines(own, at, np.array([count[w] for w in blob.split()]), [lm.lines_of(x["keys"], x.seen) for x in by_range if x.range == k and x.words is None])
        place = straight.find(lines.keys[:-1])
        assert (straight.keys[place] == lines.keys[:-1]).all() and set(lm.count_lines(own, at, np.ones(len(at)))[0]) <= set(lines.keys[:-1])
        assert (lines.zeros[:-1] == straight.zeros[place]).all() and (lines.ones[:-1] == straight.ones[place]).all()
        met |= set(blob.split())
    assert met == set(every) - {b""}
    prefix = Counter(w[:k] for w, n in count.items() for k in range(len(w) + 1) for _ in range(n))
    whole = dict(zip(keys.tolist(), seen.sum(1), strict=True))
    first = next(lm.line_keys(data, starts))[4]
    for w, at in zip(every, starts, strict=True):
        for k in range(len(w) + 1):
            assert whole[int(first[at + k])] == prefix[w[:k]]


def test_score_reference(spark, monkeypatch):
    """Scores from the learned weights, with counts taken and words spelled in one place, word by word."""
    told = {}

    def keep(name, f):
        monkeypatch.setattr(lm, name, lambda *a: told.setdefault(name, f(*a)))

    keep("fit_kinds", lm.fit_kinds)
    keep("learned_mixer", lm.learned_mixer)
    r = np.random.default_rng(7)
    texts = [" ".join("".join(r.choice(list("abcde" if i % 2 else "vwxyz"), r.integers(1, 5)).tolist()) for _ in range(r.integers(0, 60))) for i in range(120)] + ODD
    rows = {x.doc_id: x.score for x in lm.lm_scoring(docs(spark, texts)).collect()}
    kinds, (learned, shares) = told["fit_kinds"], told["learned_mixer"]
    every = sorted({w for t in texts for w in words(t)})
    place = {w: i for i, w in enumerate(every)}
    counts, n_train = np.zeros((len(every), lm.CLASSES), np.int64), 0
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            n_train += 1
            raw = np.frombuffer((t or "").encode(), np.uint8)
            k = kinds.of(raw, np.array([0, len(raw)]))[0]
            for w in words(t):
                counts[place[w], k] += 1
    data, starts = lm.spell(b"".join(w + b" " for w in [*every, b""]))
    n = np.append(counts.sum(1), n_train)
    spelled = lm.Mixer.over(lm.Lines(*lm.count_lines(data, starts, n)), learned).log10(data, starts)
    refined = lm.Refined(counts.sum(0), n_train)
    refined.shares = shares
    by = refined.log10(counts, spelled[:-1])
    for i, t in enumerate(texts):
        of = np.log10(kinds.prior) + (by[[place[w] for w in words(t)]].sum(0) if words(t) else 0)
        want = np.logaddexp.reduce(of * np.log(10)) / np.log(10) + refined.end(spelled[-1])
        assert abs(rows[i] - want) < 0.01 + 2e-3 * abs(want), (i, rows[i], want)


def stream(text):
    """(tail, nearest byte first, word) of each word of a text and of its end, with stops before it."""
    out, before = [], b"    "
    for w in [*words(text), b""]:
        out.append((before[-2:-5:-1], w))
        before += w + b" "
    return out


def test_borders_plainly():
    texts = [t or "" for t in ODD] + ["Ab c déf  g", "", "x", "\nhello a b\tworld "]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    data, offsets = column(batch, "text")
    keys = lm.borders(Words(data, offsets), data)
    both = [x for t in texts for x in stream(t)]
    both = [x for x in both if x[1]] + [x for x in both if not x[1]]
    assert keys.tolist() == [int.from_bytes(t[:1] + (w + b"  " + b" ")[:3] + t[1:], "big") for t, w in both]
    spelled, starts, tails = lm.spell_borders(keys)
    assert tails.tolist() == [list(t) for t, _ in both]
    assert spelled.tobytes() == b"".join((w + b" ")[:3] for _, w in both) and starts.tolist() == np.cumsum([0] + [min(3, len(w) + 1) for _, w in both])[:-1].tolist()


def test_contexts_reach_across_words(spark):
    """What follows a word is told by it: the same words in another order are less likely, and more so than by words alone."""
    r = np.random.default_rng(8)
    follow = {"alpha": "qzzx", "gamma": "vjjk", "sigma": "wyyf"}
    pairs = lambda a: " ".join(f"{x} {follow[x]}" for x in a)
    texts = [pairs(r.choice(list(follow), 40)) for _ in range(80)]
    held = [i for i in range(80) if zlib.crc32(str(i).encode()) % 7 == 2]
    other = dict(zip(follow, [*follow.values()][1:] + [*follow.values()][:1], strict=True))
    for i in held[::2]:
        texts[i] = " ".join(x if x in follow else other[texts[i].split()[k - 1]] for k, x in enumerate(texts[i].split()))
    score = {a: {x.doc_id: x.bits_per_byte for x in lm.lm_scoring(docs(spark, texts), across=a).collect()} for a in (False, True)}
    right, wrong = held[1::2], held[::2]
    assert np.mean([score[True][i] for i in right]) < 0.8 * np.mean([score[False][i] for i in right])
    assert np.mean([score[True][i] for i in wrong]) > 1.2 * np.mean([score[True][i] for i in right])


def test_query_reads_across_words(spark):
    """The query's held-out scores are those of contexts across words, better than of contexts that end at the word."""
    held = lambda df: sum(r.score for r in df.where("held_out").collect())
    sf = "/root/testdata/sf0.01"
    assert held(QUERIES["op3_lm_scoring"](spark, sf)) > held(lm.lm_scoring(spark.read.parquet(f"{sf}/documents.parquet")))


def test_score_reference_across_words(spark, monkeypatch):
    """Scores from the learned weights, with bits counted and every word spelled after the text before it, in one place."""
    told = {}

    def keep(name, f):
        monkeypatch.setattr(lm, name, lambda *a: told.setdefault(name, f(*a)))

    keep("fit_kinds", lm.fit_kinds)
    keep("learned_mixer", lm.learned_mixer)
    r = np.random.default_rng(9)
    texts = [" ".join("".join(r.choice(list("abcde" if i % 2 else "vwxyz"), r.integers(1, 7)).tolist()) for _ in range(r.integers(0, 60))) for i in range(120)] + ODD
    rows = {x.doc_id: x.score for x in lm.lm_scoring(docs(spark, texts), across=True).collect()}
    assert len(rows) == len(texts)
    kinds, (learned, shares) = told["fit_kinds"], told["learned_mixer"]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    every = sorted({w for t in texts for w in words(t)})
    place = {w: i for i, w in enumerate(every)}
    counts = np.zeros((len(every), lm.CLASSES), np.int64)
    for i in train:
        raw = np.frombuffer((texts[i] or "").encode(), np.uint8)
        for w in words(texts[i]):
            counts[place[w], kinds.of(raw, np.array([0, len(raw)]))[0]] += 1

    def laid(units):
        data, starts = lm.spell(b"".join(w + b" " for _, w in units))
        return data, starts, np.array([list(t) for t, _ in units], np.uint8)

    data, starts, tails = laid([x for i in train for x in stream(texts[i])])
    m = lm.Mixer.over(lm.Lines(*lm.count_lines(data, starts, np.ones(len(starts), np.int64), tails=tails)), learned)
    refined = lm.Refined(counts.sum(0), len(train))
    refined.shares = shares
    for i, t in enumerate(texts):
        data, starts, tails = laid(stream(t))
        out = np.zeros(len(data))
        for slot, bit, so_far in lm.slots(data, starts, m.lines, None, tails):
            p = m.refine(m.mixed(*m.inputs(slot)), so_far)
            out += np.log(np.where(bit == 1, p, 1 - p))
        spelled = np.add.reduceat(out, starts) / np.log(10)
        of = np.log10(kinds.prior) + (refined.log10(counts[[place[w] for w in words(t)]], spelled[:-1]).sum(0) if words(t) else 0)
        want = np.logaddexp.reduce(of * np.log(10)) / np.log(10) + refined.end(spelled[-1])
        assert abs(rows[i] - want) < 0.01 + 2e-3 * abs(want), (i, rows[i], want)
