"""The opN_ queries, thin over their operators, and the SQL of those that SQL can express."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, license_scan, line_dedup, lm_scoring, mixing, ngram_join, quality_rules, suffix_dedup, token_counts
from tidemark.llm.session import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    small_batches(spark)
    df, cores = spark.read.parquet(f"{sf}/{name}.parquet"), spark.sparkContext.defaultParallelism
    if name == "documents" and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)  # one small file is one task
    return df


@query()
def op3_lm_scoring(spark, sf):
    return lm_scoring.lm_scoring(table(spark, sf, "documents"), across=True)


@query()
def op4_token_counts(spark, sf):
    return token_counts.token_counts(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k + 1 : k + least(len(w), 10)], ' ') AS g
   FROM (SELECT item_id, w, unnest(range(len(w) - least(len(w), 10) + 1)) AS k FROM b WHERE len(w) > 0)),
 n AS (SELECT DISTINCT n FROM i),
 g AS (SELECT doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, n WHERE len(w) >= n)),
 h AS (SELECT g.doc_id, g.n, g.k, i.item_id FROM g JOIN i ON g.n = i.n AND g.g = i.g),
 p AS (SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM (SELECT doc_id, k, unnest(range(n)) AS o FROM (SELECT DISTINCT doc_id, n, k FROM h)) GROUP BY doc_id),
 s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
   FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)
""")
def op10_decontamination(spark, sf):
    return decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


SHINGLES = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
   ELSE list_transform(range(len(w) - 2), lambda k : array_to_string(w[k + 1 : k + 3], ' ')) END) AS g FROM d),"""


@query("WITH RECURSIVE" + SHINGLES.strip().removeprefix("WITH") + r"""
 e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
 f AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n + b.n) AS t FROM e a JOIN f USING (x) JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p WHERE 100 * i >= 90 * (t - i)),
 r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM s JOIN r ON r.a = s.doc_id GROUP BY ALL
""")
def op1_ngram_join(spark, sf):
    return ngram_join.ngram_join(table(spark, sf, "documents"), 3, 90)


@query()
def op2_quality_rules(spark, sf):
    return quality_rules.quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op5_language_id(spark, sf):
    return language_id.language_id(table(spark, sf, "documents"))


@query("""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 400) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
 x AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(s)) AS n FROM w) WHERE n > 1),
 g AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM x),
 t AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
 r AS (SELECT doc_id, k, min(i) AS b, max(i) + 200 AS e FROM t GROUP BY ALL),
 z AS (SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, list(b ORDER BY b) AS bs, list(e ORDER BY b) AS es FROM r GROUP BY doc_id),
 y AS (SELECT d.doc_id, d.h, coalesce(z.n_removed, 0) AS n_removed, coalesce(z.n_spans, 0) AS n_spans,
   list_concat([0], coalesce(z.es, [])) AS f, list_concat(coalesce(z.bs, []), [length(d.h) // 2]) AS u FROM d LEFT JOIN z USING (doc_id)),
 q AS (SELECT doc_id, string_agg(substr(h, CAST(2 * f[j] + 1 AS BIGINT), CAST(2 * (u[j] - f[j]) AS BIGINT)), '' ORDER BY j) AS kept
   FROM (SELECT doc_id, h, f, u, unnest(range(1, len(f) + 1)) AS j FROM y) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM y JOIN q USING (doc_id)
""")
def op6_suffix_dedup(spark, sf):
    d = suffix_dedup.suffix_dedup(table(spark, sf, "documents"), 200)
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query(r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, regexp_extract(text, '^[\x20\x09-\x0D]*') AS head,
   list_filter(regexp_extract_all(regexp_replace(text, '^[\x20\x09-\x0D]*', ''), '(?s).*?(?:[.!?][\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*|$)'), lambda x : x <> '') AS us FROM documents),
 w AS (SELECT rid, doc_id, u, t, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
   FROM (SELECT rid, doc_id, unnest(us) AS t, unnest(range(len(us))) AS u FROM d)),
 c AS (SELECT rid, doc_id, u, e - len(w) AS s, e FROM (SELECT *, sum(len(w)) OVER (PARTITION BY rid ORDER BY u) AS e FROM w)),
 f AS (SELECT rid, flatten(list(w ORDER BY u)) AS f FROM w GROUP BY rid),
 p AS (SELECT a.rid, a.doc_id, a.u, b.u AS v, a.s, b.e FROM c a ASOF JOIN c b ON a.rid = b.rid AND a.s + 25 <= b.e),
 k AS (SELECT p.*, md5(array_to_string(f[CAST(s + 1 AS BIGINT) : CAST(e AS BIGINT)], ' ')) AS k FROM p JOIN f USING (rid)),
 r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, rid, u) > 1 AS later FROM k),
 g AS (SELECT DISTINCT rid, unnest(range(u, v + 1)) AS u FROM r WHERE later),
 n AS (SELECT rid, count(*) AS n_units, count(g.u) AS n_removed, coalesce(string_agg(t, '' ORDER BY u) FILTER (g.u IS NULL), '') AS kept FROM w LEFT JOIN g USING (rid, u) GROUP BY rid),
 o AS (SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(head, '') || coalesce(kept, '') AS kept FROM d LEFT JOIN n USING (rid))
SELECT doc_id, n_units, n_removed, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM o
""")
def op7_line_dedup(spark, sf):
    d = line_dedup.line_dedup(table(spark, sf, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return d.select("doc.doc_id", "n_units", "n_removed", F.length(kept).cast("bigint").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


@query()
def op8_license_scan(spark, sf):
    return license_scan.license_scan(table(spark, sf, "documents"))


@query()
def op9_source_mixing(spark, sf):
    return mixing.mix_sources(table(spark, sf, "documents").select("doc_id", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLE | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
