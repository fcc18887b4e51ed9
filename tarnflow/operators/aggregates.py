"""Folds, reductions and two-pass scans. Catalyst combines partial results before each shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.operators.transforms import as_column


def _named(named: dict[str, Column | str]) -> list[Column]:
    return [as_column(c).alias(n) for n, c in named.items()]


def fold(df: DataFrame, **named: Column | str) -> DataFrame:
    """Global aggregates in one row; no row at all for an empty input."""
    return df.agg(*_named(named), F.count(F.lit(1)).alias("__rows")).where("__rows > 0").drop("__rows")


def keyed_fold(df: DataFrame, keys: list[str], **named: Column | str) -> DataFrame:
    return df.groupBy(*keys).agg(*_named(named))


def extreme_element(df: DataFrame, keys: list[str], value: str, order_by: list[str], largest: bool) -> DataFrame:
    """The whole row with the largest or smallest value of each key; of equal ones the first by ``order_by``.

    One aggregate over structs, so it combines before the shuffle; for the largest of a type without
    negatives a pass for the value comes first. A null value never wins over another.
    """
    rest = [c for c in df.columns if c not in keys]
    row, tie = F.struct(*rest), [F.col(c) for c in order_by]
    kind = df.schema[value].dataType
    v = F.col(value)
    if not largest:
        rank = v
    elif isinstance(kind, T.IntegralType):
        rank = F.bitwise_not(v)  # falls as the value grows, and can't overflow
    elif isinstance(kind, (T.FractionalType, T.DecimalType)):
        rank = F.negative(v)
    else:
        rank = None
    if rank is not None:
        out = df.groupBy(*keys).agg(F.min_by(row, F.struct(v.isNull(), rank, *tie)).alias("__row"))
        return out.select(*keys, "__row.*").select(*df.columns)
    best = df.groupBy(*keys).agg(F.max(value).alias("__best"))
    named = best.toDF(*[f"__{k}" for k in keys], "__best")
    same = v.eqNullSafe(F.col("__best"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = df.join(named, same, "left_semi").groupBy(*keys).agg(F.min_by(row, F.struct(*tie)).alias("__row"))
    return out.select(*keys, "__row.*").select(*df.columns)


def fold_scan(df: DataFrame, keys: list[str], **named: Column | str) -> DataFrame:
    """Every row with the final aggregates of its key, or of all rows without keys.

    The aggregates come from a partial/final aggregation and are joined back, rather than from a window
    that would sort each key in one task.
    """
    if not keys:
        total = df.agg(F.struct(*_named(named)).alias("__total")).scalar()
        return df.withColumn("__total", total).select(*df.columns, "__total.*")
    total = keyed_fold(df, keys, **named)
    renamed = total.toDF(*[f"__{k}" for k in keys], *named)
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = one if same is None else same & one
    return df.join(renamed, same).drop(*[f"__{k}" for k in keys])


def distinct_sets(df: DataFrame, grouping: str, keys: list[str], **named: Column | str) -> DataFrame:
    """``cube``, ``rollup`` or ``groupBy`` over the keys."""
    return getattr(df, grouping)(*keys).agg(*_named(named))
