"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark passages, mixing.

Every stage takes the documents its predecessor kept and returns the columns of documents (the last adds its own).
An empty table goes through; null texts are `und` and go at the first stage; repeated rows count as copies.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, mixing, ngram_join, suffix_dedup
from tidemark.llm.session import materialise, small_batches

#: Least probability of the predicted language.
LEAST_SCORE = 0.4


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language, and those whose language is unsure."""
    small_batches(spark)
    found = language_id.identify(docs, language_id.train(docs))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component at five words and similarity 0.8: that of the smallest doc_id."""
    small_batches(spark)
    kept = ngram_join.ngram_join(docs, 5, 80).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").dropDuplicates(["doc_id", "text"])


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 200 bytes or more that occur elsewhere; a cut character goes with its passage."""
    small_batches(spark)
    found = suffix_dedup.remove_repeats(docs, 200)
    text = F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(F.try_validate_utf8(F.col("kept").cast("string")))
    clean = F.coalesce(text, F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", ""))
    return found.select(*[clean.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item, or all of a shorter one."""
    small_batches(spark)
    found = decontaminate.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("NOT contaminated").select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds src_rank, block, slot and position; sources are weighted by the square root of their size."""
    small_batches(spark)
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
]
#: The network and the schedule are not SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
