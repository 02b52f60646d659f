"""Most frequent values of a column with very many distinct values, exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent non-null values with their exact counts.

    Result: value, n, most frequent first; among equal counts the least value
    comes first, so the result is the same however rows are spread. Fewer than k
    distinct values give fewer rows, an empty table none. Repeated rows count
    each time. Other columns are ignored, whatever their names.

    Hash aggregation combines on the map side, so a value holding a third of all
    rows sends one row a task; it spills to disk beyond its memory, so the number
    of distinct values is not bounded. The ordered limit keeps k rows in each
    partition and merges those alone.
    """
    counts = df.select(F.col(column).alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("value")).limit(k)


def values_above(df: DataFrame, column: str, share: float) -> DataFrame:
    """Values held by at least a share of all rows of df, rows with a null value included in the total.

    Result: value, n. At most 1/share values can qualify, so top_values() with
    that k loses none.
    """
    total = df.count()
    return top_values(df, column, int(1 / share) + 1).filter(F.col("n") >= F.lit(share * total - 1e-9 * max(total, 1)))
