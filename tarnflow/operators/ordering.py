"""Sorting, limits and top-k, over all rows or within partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sorted_by(df: DataFrame, *order: Column | str, scope: str = "global") -> DataFrame:
    return df.orderBy(*order) if scope == "global" else df.sortWithinPartitions(*order)


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(n) if offset else df.limit(n)


def sorted_limit_by(df: DataFrame, *order: Column | str, n: int, offset: int = 0, scope: str = "global") -> DataFrame:
    """The ``n`` rows after ``offset`` in order: each task keeps its best rows only. By partition if asked for."""
    if scope == "global":
        return limit(df.orderBy(*order), n, offset)
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    ranked = df.withColumn("__part", F.spark_partition_id()).withColumn("__rank", rank)
    return ranked.where((F.col("__rank") > offset) & (F.col("__rank") <= offset + n)).drop("__part", "__rank")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows of each key; Spark's rank limit trims rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", rank).where(F.col("place") <= k)
