import random
import re

import pytest

import tidemark.llm.ngram_join as nj
from tests.llm.test_text_ops import ODD, docs
from tidemark.llm.components import components


def brute(texts, width, percent):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b < 91 else b for b in (t or "").encode()))
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("abcdefgh")
    texts = list(ODD) + ["same  Text here", "same text\nHERE", "a b", "A b"]
    passage = [word() for _ in range(30)]
    for _ in range(25):
        base = [word() for _ in range(r.choice([3, 8, 12, 20, 40, 90, 200]))]
        if r.random() < 0.5:
            base[2:2] = passage
        for _ in range(r.choice([1, 2, 3, 9])):
            copy = list(base)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    base = [word() for _ in range(80)]
    for i in range(70):  # a large group of near copies
        copy = list(base)
        copy[r.randrange(80)] = word()
        if i % 3 == 0:
            copy[r.randrange(80)] = word()
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("width,percent,block,often", [(3, 90, 1000, 32), (5, 80, 7, 3), (3, 90, 16, 2)])
def test_components_brute(spark, monkeypatch, width, percent, block, often):
    monkeypatch.setattr(nj, "BLOCK", block)
    monkeypatch.setattr(nj, "FREQUENT", often)
    monkeypatch.setattr(nj, "STAR", 20)
    monkeypatch.setattr(nj, "FLUSH", 500)
    texts = corpus(width + block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_join(docs(spark, texts), width, percent).collect()}
    assert got == brute(texts, width, percent)


@pytest.mark.parametrize("light", [1, 40, 10**9])
def test_every_boundary_gives_the_same(spark, monkeypatch, light):
    monkeypatch.setattr(nj, "boundary", lambda *a: light)
    texts = corpus(77)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_join(docs(spark, texts), 3, 90).collect()}
    assert got == brute(texts, 3, 90)


def test_repeated_rows_and_empty_table(spark):
    d = docs(spark, ["one two three four"] * 3 + [None])
    assert [r.component_id for r in nj.ngram_join(d.union(d)).orderBy("doc_id").collect()] == [0] * 6 + [3] * 2
    assert nj.ngram_join(d.limit(0)).count() == 0


def test_components_of_chains(spark):
    r = random.Random(1)
    ids = [r.getrandbits(60) for _ in range(300)]
    rows = [(ids[i], ids[i + 1]) for i in range(299) if i % 50 != 49]
    got = {x.node: x.root for x in components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    for c in range(6):
        assert len({got[x] for x in ids[c * 50:(c + 1) * 50]}) == 1
    assert len(set(got.values())) == 6
