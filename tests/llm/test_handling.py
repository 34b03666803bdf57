"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names, for every operator that gives a row a document."""

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tests.llm.test_text_ops import ODD, docs
from tidemark.llm import decontaminate, language_id, license_scan, line_dedup, lm_scoring, mixing, ngram_join, quality_rules, suffix_dedup, token_counts

LONG = " ".join(f"word{i % 5000}" for i in range(120_000))


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, None), (None, 0), (1, 0)], "doc_id bigint, quality int")


def items(spark):
    return spark.createDataFrame([(1, "one"), (None, "word1 word2"), (2, None), (2, "")], "item_id bigint, text string")


#: Name: (the operator, names that it uses, whether repeated rows give the same row each).
OPS = {
    "op1": (lambda s, d: ngram_join.ngram_join(d, 3, 90), ("n_shingles", "component_id", "node", "root", "a", "b"), True),
    "op2": (lambda s, d: quality_rules.quality_rules(d, labels(s)), ("n_words", "kept", "rule", "w", "t", "h1", "quality"), True),
    "op3": (lambda s, d: lm_scoring.lm_scoring(d), ("score", "block", "train", "held_out", "part"), True),
    "op4": (lambda s, d: token_counts.token_counts(d, public_tokenizers.path("word_bpe_49k.json")), ("n_tokens", "n_bytes", "over_limit"), True),
    "op5": (lambda s, d: language_id.language_id(d), ("score", "lang_pred", "doc", "held_out", "w0"), True),
    "op6": (lambda s, d: suffix_dedup.suffix_dedup(d, 200), ("node", "begins", "kept", "doc", "hit"), True),
    "op7": (lambda s, d: line_dedup.line_dedup(d).select("doc.doc_id", "n_units", "n_removed"), ("kept", "gone", "u", "d1", "doc"), False),
    "op8": (lambda s, d: license_scan.license_scan(d), ("labels", "w", "norm", "score", "base"), True),
    "op9": (lambda s, d: mixing.mix_sources(d).drop("text"), ("slot", "block", "s", "o", "doc", "position"), False),
    "op10": (lambda s, d: decontaminate.decontaminate(d, items(s)), ("n_words", "items", "spans", "doc"), True),
}


@pytest.mark.parametrize("name", OPS)
def test_rows(spark, name):
    op, names, alike = OPS[name]
    texts = [*ODD, LONG]
    base = docs(spark, texts)
    for c in names:
        base = base.withColumn(c, F.lit(3))
    odd = base.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("bigint"))
    df = base.unionByName(base).unionByName(odd)
    rows = op(spark, df).collect()
    assert len(rows) == 2 * len(texts) + 3 and sum(r.doc_id is None for r in rows) == 3
    if alike:
        for i in range(len(texts)):
            a, b = [r for r in rows if r.doc_id == i]
            assert all(x == (pytest.approx(y, rel=1e-9) if isinstance(y, float) else y) for x, y in zip(a, b, strict=True))
    assert op(spark, df.limit(0)).count() == 0
    assert op(spark, docs(spark, [None])).count() == 1
