"""Connected components of a link table, by hooking to smaller neighbours and contracting the links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); root is one node of the component, the same for all of it.

    Each round points every label at its least smaller neighbour, follows two more pointers, and keeps the
    links between labels that still differ. Node numbers should be hash-like: chains of them are then short.
    Links and labels stay in tables; only their emptiness is asked for. Rounds are cut by written tables.
    """
    live = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels = live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not live.isEmpty():
        up = live.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("y"))
        step = up.select(F.col("x").alias("y"), F.col("y").alias("z"))
        for _ in range(2):
            up = up.join(step, "y", "left").select("x", F.coalesce("z", "y").alias("y"))
        up = materialise(up, "parents")
        to = lambda df, c: df.join(up.select(F.col("x").alias(c), F.col("y").alias("_" + c)), c, "left").withColumn(c, F.coalesce("_" + c, c)).drop("_" + c)
        labels = materialise(to(labels, "root"), "labels")
        live = materialise(to(to(live, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    return labels
