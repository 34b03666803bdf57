import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_ngram_join import brute as brute_join
from tests.llm.test_suffix_dedup import brute as brute_suffix
from tests.llm.test_text_ops import ODD, brute_hits, docs
from tidemark.llm import language_id as li

SF = "/root/testdata/sf0.01"


def test_fast_equals_plain_and_gradients():
    r = np.random.default_rng(1)
    net = li.Network(["a", "b", "c"])
    x = r.integers(0, 256, (6, li.WINDOW)).astype(np.uint8)
    y = r.integers(0, 3, 6)
    plain = li.softmax(net.pooled(x)[0] @ net.out + net.out_bias)
    assert np.allclose(net.fast().probabilities(x), plain, atol=1e-5)
    loss = lambda: -np.log(li.softmax(net.pooled(x)[0].astype(np.float64) @ net.out + net.out_bias)[np.arange(6), y]).mean()
    g = net.gradients(x, y)
    before = loss()
    net.out -= 1e-3 * g[-2]
    assert loss() < before


def test_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = li.language_id(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 150 < len(held) < 350
    assert sum(r.lang_pred == r.lang for r in held) >= 0.9 * len(held)


def test_odd_texts(spark):
    base = docs(spark, ODD + ["123 456", "the cat sat on the mat"])
    none = li.language_id(base).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in none) and len(none) == len(ODD) + 2
    got = {r.doc_id: r for r in li.language_id(base.withColumn("lang", F.lit("en"))).collect()}
    for i, t in enumerate(ODD + ["123 456"]):
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= got[i].score <= 1
    assert li.language_id(base.limit(0)).count() == 0


def test_stages_brute(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 250").withColumn("score", F.lit(1)).cache()
    assert cp.keep_language(spark, d, SF).columns == d.columns
    texts = [r.text for r in d.orderBy("doc_id").collect()]
    root = brute_join(texts, 5, 80)
    kept = cp.drop_near_duplicates(spark, d.union(d), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(250) if root[i][1] == i]
    want = brute_suffix(texts, 200)
    for r in cp.remove_repeats(spark, d, SF).collect():
        assert r.text.encode() == want[r.doc_id][3].decode(errors="ignore").encode()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:5]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = {r.doc_id for r in cp.drop_benchmark(spark, d, str(tmp_path)).collect()}
    assert clean == {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]}


def test_run(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "lang", "source", "n_chars", "position"} <= set(out.columns) and 50 < out.count() < 200
    empty = docs(spark, [None]).limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_prediction_brute(spark):
    """The query's languages and scores, window by window through the plain network."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = li.train(d)
    texts = {r.doc_id: (r.text or "").encode() for r in d.collect()}
    for r in li.language_id(d).collect():
        t = texts[r.doc_id]
        parts = [t[i:i + li.WINDOW] for i in range(0, len(t), li.WINDOW)]
        x = np.stack([np.frombuffer(p.ljust(li.WINDOW, b"\0"), np.uint8) for p in parts])
        p = np.average(li.softmax(net.pooled(x)[0] @ net.out + net.out_bias), 0, [len(q) for q in parts])
        assert r.lang_pred == net.classes[p.argmax()] and abs(r.score - p.max()) < 1e-4


def test_mixing_stage_brute(spark):
    from collections import Counter

    from tests.llm.test_native_ops import brute_pfair

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("slot", F.lit("x"))
    rows = cp.mix(spark, d, SF).collect()
    n = Counter(r.source for r in d.collect())
    want = brute_pfair({s: k**0.5 for s, k in n.items()}, {s: -(-k // 16) for s, k in n.items()})
    assert len(rows) == d.count() and all(r.slot == want[r.source, r.src_rank // 16] for r in rows)
