"""Keys of any number, with tasks of bounded rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one task is dealt, about.
TASK_ROWS = 250_000


def tasks_for(rows: int, df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def distinct_rows(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Distinct rows, dealt by all columns before they are hashed: a task that reads much holds no table of it. Rows are counted if not given."""
    return df.repartition(tasks_for(df.count() if rows is None else rows, df), *df.columns).distinct()


def range_of(key: Column, bounds: list) -> Column:
    """Number of the sorted bounds at or below a key; 0 for null."""
    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= bounds[mid], within(mid + 1, hi)).otherwise(within(lo, mid))

    return within(0, len(bounds))
