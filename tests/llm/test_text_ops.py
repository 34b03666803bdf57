import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.token_counts import token_counts

ODD = [None, "", " ", "\n\n", "one", "ÀÉ über naïve", "A" * 5000, " lead and trail ", "tab\tand\x0bvt\x0cff\rcr", "x\x85y\xa0z  w", "<|endoftext|> a<|startoftext|>b it's I'LL 12 3.5", "é ́x"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def docs(spark, texts, **k):
    return spark.createDataFrame([(i, t, None, None, None, "z") for i, t in enumerate(texts)], DOCS).repartition(3)


@pytest.mark.parametrize("sep,pattern", [(tx.SPACE, rb"[^\x20\x09-\x0D]+"), (tx.NOT_ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(monkeypatch, sep, pattern):
    monkeypatch.setattr(tx, "PIECE", 16)
    r = random.Random(4)
    texts = ODD + ["".join(r.choice("aB é.\n1|") for _ in range(r.randrange(80))) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)}).slice(2)
    w = tx.Words(*tx.column(batch, "text"), sep)
    seen, data = {}, tx.column(batch, "text")[0]
    lower = lambda b: bytes(x + 32 if 65 <= x < 91 else x for x in b)
    for i, t in enumerate(texts[2:]):
        want = re.findall(pattern, lower((t or "").encode()))
        got = [lower(bytes(data[s:e])) for s, e in zip(w.start[w.lo[i]:w.hi[i]], w.end[w.lo[i]:w.hi[i]])]
        assert got == want
        for h, x in zip(w.hash[w.lo[i]:w.hi[i]].tolist(), want):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    assert (tx.grams(w.hash, 3) == tx.gram(w.hash, np.arange(len(w.hash) - 2), 3)).all()


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("frequent", [0, 5, 1 << 17])
def test_token_counts_equal_library(spark, monkeypatch, file, frequent):
    """With all, few and no pre-tokens joined by shuffle."""
    import tidemark.llm.token_counts as tc
    from tokenizers import Tokenizer

    monkeypatch.setattr(tc, "FREQUENT", frequent)
    t = Tokenizer.from_file(public_tokenizers.path(file))
    r = random.Random(1)
    texts = ODD + ["".join(r.choice(["the", " ", "'s", "é", "123", "\n", "<|endoftext|>", "?!", "ing", " ", "\x1c"]) for _ in range(60)) for _ in range(60)]
    got = {x.doc_id: x for x in token_counts(docs(spark, texts), public_tokenizers.path(file), 20).collect()}
    for i, s in enumerate(texts):
        n = len(t.encode(s or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((s or "").encode()), n > 20)


def test_token_counts_counts_each_piece_once(spark):
    from tidemark.llm.token_counts import distinct_pieces

    texts = ["a bb a", None, "bb " + "c" * 300, "", "a"]
    got = sorted(map(tuple, distinct_pieces(docs(spark, texts), public_tokenizers.path("word_bpe_49k.json")).select("piece", "freq").collect()))
    assert got == [(b"a", 3), (b"bb", 2)]


def test_token_counts_repeated_rows(spark):
    """Rows of one id and text each get their whole count."""
    path = public_tokenizers.path("word_bpe_49k.json")
    d = docs(spark, ["zyxq vut zyxq", "of the"])
    one = {x.doc_id: x.n_tokens for x in token_counts(d, path).collect()}
    assert sorted((x.doc_id, x.n_tokens) for x in token_counts(d.unionByName(d), path).collect()) == sorted(list(one.items()) * 2)


def test_token_counts_empty_table(spark):
    assert token_counts(docs(spark, [""]).limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def brute_hits(text, items, width=10):
    words = lambda s: [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b < 91 else b for b in (s or "").encode()))]
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(width, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == x[k:k + n]:
                    hit |= set(range(p, p + n))
                    found.add(item)
    return len(w), len(hit), len(found - {None})


def test_decontaminate_compares_words(monkeypatch):
    """Where all windows have one hash, only those of the same words are found."""
    import tidemark.llm.decontaminate as dc

    monkeypatch.setattr(dc, "gram", lambda h, at, n: np.zeros(len(at), np.uint64))
    win = dc.Windows([(1, "One two three"), (2, "one four three"), (3, "ONE two three"), (4, "one two")], 3)
    win.set_rarity({})
    texts = pa.RecordBatch.from_pydict({"text": ["x one TWO three", "one four tree", "one fore three", "One two thre"]})
    assert dc.scan(texts, win)[2].tolist() == [[0, 0], [0, 2], [0, 3], [3, 3]]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_decontaminate_brute(spark, monkeypatch, limit):
    """Both ways, the items broadcast and joined."""
    import tidemark.llm.decontaminate as dc

    monkeypatch.setattr(dc, "BLOCK_BYTES", limit)
    r = random.Random(7)
    word = lambda: r.choice(["a", "b", "c", "dd", "É", "x1"])
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 12, 14])) )) for i in range(12)] + [(None, "a b c"), (3, None), (4, ""), (4, "b b")]
    texts = ODD + [", ".join(word() for _ in range(60)) + " " + (r.choice(items)[1] or "").upper() for _ in range(40)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    wide = docs(spark, texts).withColumns({c: F.lit(1) for c in ("n_words", "spans", "items", "doc", "k1", "word", "window")})
    rows = decontaminate(wide.unionByName(wide), bench).collect()
    assert len(rows) == 2 * len(texts)
    for x in rows:
        assert (x.n_words, x.n_hit, x.n_items) == brute_hits(texts[x.doc_id], items)
    assert len({(x.doc_id, x.items_sha256) for x in rows}) == len(texts)
    none = decontaminate(docs(spark, texts), bench.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(texts)


def test_decontaminate_ways_agree_at_scale(spark, monkeypatch):
    """The two ways on the documents and items of sf0.001, digests of item ids included."""
    import tidemark.llm.decontaminate as dc

    d, b = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    want = sorted(map(tuple, decontaminate(d, b).collect()))
    monkeypatch.setattr(dc, "BLOCK_BYTES", 0)
    assert sorted(map(tuple, decontaminate(d, b).collect())) == want and any(r[5] for r in want)
