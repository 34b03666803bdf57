"""Session helpers: partition counts, and tables written where every executor can read them."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def parts(spark: SparkSession) -> int:
    """Partitions that keyed work is dealt to; the session's setting follows the size of the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: fewer rows in an Arrow batch keep its copies on both sides small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset, as in tests, the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    return where.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage, and survives lost executors."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

