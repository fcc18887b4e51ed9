"""Union, distinct, zip, route and distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.transforms import as_column
from tarnflow.storage import materialize


def merge(*flows: DataFrame) -> DataFrame:
    out = flows[0]
    for other in flows[1:]:
        out = out.unionByName(other)
    return out


def merge_tagged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides, told apart by ``side``; columns that one side lacks are null there."""
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")), allowMissingColumns=True)


def unique(df: DataFrame) -> DataFrame:
    return df.distinct()


def unique_by_key(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The first row of each key by ``order_by``, as an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order_by)).alias("__row"))
    return out.select(*keys, "__row.*").select(*df.columns)


def ranged(df: DataFrame, order_by: list[str | Column]) -> DataFrame:
    """Rows dealt out by range of their order, with ``__part``, the number of the range; written, so that ranges stay."""
    return materialize(df.repartitionByRange(*order_by).withColumn("__part", F.spark_partition_id()), "ranged")


def offset_by_part(parts: DataFrame, order_by: list[str | Column], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all rows before, from sums within a range and of the ranges before, of which there is a row each."""
    from pyspark.sql.window import Window

    sums = parts.groupBy("__part").agg(F.sum(value).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("__part"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("__offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return parts.join(F.broadcast(offsets), "__part").withColumn(name, total.cast("long")).drop("__part", "__offset")


def number_rows(df: DataFrame, order_by: list[str | Column], name: str = "position") -> DataFrame:
    """Rows with their places 0, 1, ... in a total order.

    Sorted by range over all partitions; places are offsets of partitions, of which there are few, plus
    places within them. No task sees more than its partition.
    """
    return offset_by_part(ranged(df.withColumn("__one", F.lit(1)), order_by), order_by, "__one", name).drop("__one")


def zip_flows(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Pairs by place in each side's order; as many as the shorter side has. ``position`` is kept."""
    return number_rows(left, left_order).join(number_rows(right, right_order), "position")


def split(df: DataFrame, n: int) -> list[DataFrame]:
    """``n`` flows over the same rows; the plan is shared, and Spark reuses equal exchanges."""
    return [df] * n


def route(df: DataFrame, *predicates: Column | str) -> list[DataFrame]:
    """A flow for each predicate with the rows for which it is the first that is true; other rows are in none."""
    tag = F.lit(None).cast("int")
    for k in reversed(range(len(predicates))):
        tag = F.when(as_column(predicates[k]), F.lit(k)).otherwise(tag)
    tagged = df.withColumn("__route", tag)
    return [tagged.where(F.col("__route") == k).drop("__route") for k in range(len(predicates))]


def broadcast_rows(df: DataFrame, replicas: int) -> DataFrame:
    """Every row once for each of ``replicas``, told apart by ``replica``."""
    return df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))


def shuffle(df: DataFrame, n: int | None = None) -> DataFrame:
    """Rows dealt out evenly."""
    return df.repartition(n) if n else df.repartition(F.rand())


def replication(df: DataFrame, n: int) -> DataFrame:
    """At most ``n`` tasks from here on."""
    return df.coalesce(n)


def repartition_by(df: DataFrame, n: int, target: Column | str) -> DataFrame:
    """Rows sent to the partition that an integer expression names, modulo ``n``."""
    return df.repartitionById(n, F.pmod(as_column(target).cast("int"), F.lit(n)))
