import random
from collections import Counter

import numpy as np
import pytest

import tidemark.llm.suffix_dedup as sd
from tests.llm.test_text_ops import ODD, docs


def brute(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        mask = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - n + 1):
            if seen[d[i:i + n]] > 1:
                mask[i + 1:i + 1 + n] = True
        out.append((len(d), int(mask.sum()), int((mask[1:] & ~mask[:-1]).sum()), bytes(b for b, m in zip(d, mask[1:]) if not m)))
    return out


def test_suffix_array_and_prefixes():
    r = random.Random(1)
    for text in (b"banana", b"\0\0a\0\0", b"ab" * 300, bytes(r.choice(b"ab") for _ in range(2000)), b"x", bytes(200)):
        buf = np.frombuffer(text, np.uint8)
        sa, rank = sd.suffix_array(buf)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        got = sd.common_prefixes(buf, sa, rank, np.zeros(0, np.int64), 10**6)
        for k in range(1, len(sa)):
            a, b = text[sa[k]:], text[sa[k - 1]:]
            want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert got[sa[k]] == want


@pytest.mark.parametrize("piece,flush", [(1 << 20, 1 << 20), (900, 300)])
def test_removed_brute(spark, monkeypatch, piece, flush):
    monkeypatch.setattr(sd, "PIECE", piece)
    monkeypatch.setattr(sd, "FLUSH", flush)
    monkeypatch.setattr(sd, "CHUNK", flush)
    r = random.Random(piece)
    word = lambda: "".join(r.choice("aeinsté") for _ in range(r.randrange(1, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    shared = [say(40) for _ in range(4)]
    texts = list(ODD) + ["Est " * 90, "Est " * 200, "ab" * 150, say(100)]
    for _ in range(60):
        texts.append(" ".join(r.choice([say(30), say(5), r.choice(shared), r.choice(shared)[r.randrange(60):]]) for _ in range(4)))
    texts += [texts[-1], texts[-2][:220], texts[-3] + "tail"]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in sd.suffix_dedup(docs(spark, texts), 100).collect()}
    want = brute(texts, 100)
    for i in range(len(texts)):
        assert got[i] == want[i], i


def test_repeated_rows_and_empty(spark):
    d = docs(spark, ["x" * 50 + " y" * 100, None, "short"])
    assert {(r.doc_id, r.n_removed > 0) for r in sd.suffix_dedup(d.union(d), 200).collect()} == {(0, True), (1, False), (2, False)}
    assert sd.suffix_dedup(d.limit(0)).count() == 0
