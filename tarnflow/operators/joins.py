"""Equi-joins with null-safe keys, interval joins, as-of joins."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

#: Names of strategies and Spark's hints for them. Without one, Spark chooses by size. A side that is broadcast is always
#: looked up by hash: sorting it as well would give the same rows later.
STRATEGIES = {None: None, "hash": "SHUFFLE_HASH", "sort_merge": "MERGE", "broadcast_right": "BROADCAST", "broadcast_right_sort_merge": "BROADCAST"}
#: A side is broadcast on request only up to this estimated size.
MAX_BROADCAST = 256 << 20
#: A key with more pairs than this is dealt over a grid of cells with about so many rows of either side.
HOT_PAIRS, CELL_ROWS = 1 << 20, 1 << 10


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _comparable(a: DataType, b: DataType) -> bool:
    return a == b or isinstance(a, IntegralType) and isinstance(b, IntegralType)


def _salt(df: DataFrame, parts: str) -> Column:
    """A number below ``parts`` by the row's values, so that a task run again deals its rows as before."""
    cols = [c for c in df.columns if not any(k in df.schema[c].dataType.simpleString() for k in ("map<", "variant"))]
    return F.pmod(F.xxhash64(*cols) if cols else F.lit(0), F.col(parts)).cast("int")


def _same(keys: list[tuple[str, str]]) -> Column:
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in keys])


def _deal(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Both sides without hot keys; and both sides' rows of hot keys with the cells, ``__x`` and ``__y``, in one of which each pair meets.

    Pairs of a key grow with the product of its rows, and a task has whole keys. Rows of a hot key are cut into parts on
    either side, and each part is sent to the cells that it shares with the parts of the other side.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    count = lambda df, cols, l, r: df.select(*[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)], F.lit(l).alias("__l"), F.lit(r).alias("__r"))  # noqa: E731, E741
    rows = count(left, [a for a, _ in keys], 1, 0).union(count(right, [b for _, b in keys], 0, 1)).groupBy(*names).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
    parts = [F.ceil(F.col(c) / CELL_ROWS).cast("int").alias(c) for c in ("__l", "__r")]
    hot = F.broadcast(rows.where(F.col("__l").cast("double") * F.col("__r") > HOT_PAIRS).select(*names, *parts))
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)

    def split(df: DataFrame, cols: list[str], mine: str, other: str, cell: str) -> tuple[DataFrame, DataFrame]:
        on = _same(list(zip(cols, names, strict=True)))
        dealt = df.join(hot, on).withColumn("__i", _salt(df, mine)).withColumn("__j", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        i, j = ("__i", "__j") if mine == "__l" else ("__j", "__i")
        # structs with the same values are equal, nulls included
        return df.join(hot, on, "left_anti"), dealt.select(*df.columns, F.struct(*names, *[F.coalesce(c, F.lit(0)).alias(c[-1]) for c in (i, j)]).alias(cell)).repartition(tasks, cell)

    x, hot_x = split(left, [a for a, _ in keys], "__l", "__r", "__x")
    y, hot_y = split(right, [b for _, b in keys], "__r", "__l", "__y")
    return x, y, hot_x, hot_y


def equi_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", strategy: str | None = None, right_prefix: str = "r_") -> DataFrame:
    """Rows whose keys are equal, null keys included.

    Columns are ``k0, k1, ...`` (the key of either side), the left ones, and the right ones under
    ``right_prefix``. ``how`` is inner, left, right, full, left_semi or left_anti. A broadcast that is asked
    for is only given if the right side is small enough by estimate. Keys with very many pairs, such as null, are
    dealt over many tasks whatever the strategy; as they have rows on both sides, an outer join leaves none of them unmatched.
    """
    hint = STRATEGIES[strategy]
    if hint == "BROADCAST" and (how in ("right", "full") or estimated_bytes(right) > MAX_BROADCAST):
        hint = None
    hinted = lambda df: df.hint(hint) if hint else df
    ours, theirs = {c: f"__a{i}" for i, c in enumerate(left.columns)}, {c: f"__b{i}" for i, c in enumerate(right.columns)}
    x, y, pairs = left.toDF(*ours.values()), right.toDF(*theirs.values()), [(ours[a], theirs[b]) for a, b in keys]
    if how in ("left_semi", "left_anti"):
        return x.join(hinted(y), _same(pairs), how).toDF(*left.columns)
    names = [F.coalesce(a, b).alias(f"k{i}") for i, (a, b) in enumerate(pairs)] + [F.col(a).alias(c) for c, a in ours.items()] + [F.col(b).alias(right_prefix + c) for c, b in theirs.items()]
    if left.isStreaming or right.isStreaming or not all(_comparable(x.schema[a].dataType, y.schema[b].dataType) for a, b in pairs):
        return x.join(hinted(y), _same(pairs), how).select(*names)
    x, y, hot_x, hot_y = _deal(x, y, pairs)
    met = hot_x.join(hot_y.hint("SHUFFLE_HASH" if hint == "SHUFFLE_HASH" else "MERGE"), F.col("__x") == F.col("__y"))
    return x.join(hinted(y), _same(pairs), how).select(*names).union(met.select(*names))


def interval_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, lower: int, upper: int, keys: list[tuple[str, str]] = (), right_prefix: str = "r_") -> DataFrame:
    """Pairs with ``l - lower <= r <= l + upper``, and equal keys if given; ``ts`` is the later time of a pair.

    Times are integers. Time is cut into buckets as wide as the interval, so that a left row meets at most two
    buckets and the range join becomes an equi-join with a filter. Buckets don't grow more as time gets denser, so
    those with very many pairs are dealt over many tasks.
    """
    if lower + upper < 0:
        raise ValueError("the interval is empty")
    width = max(1, lower + upper)
    ours, theirs = {c: f"__a{i}" for i, c in enumerate(left.columns)}, {c: f"__b{i}" for i, c in enumerate(right.columns)}
    lt, rt = F.col(ours[left_ts]), F.col(theirs[right_ts])
    x = left.toDF(*ours.values()).withColumn("__from", F.explode(F.sequence(F.floor((lt - lower) / width), F.floor((lt + upper) / width))))
    y = right.toDF(*theirs.values()).withColumn("__at", F.floor(rt / width))
    pairs = [("__from", "__at"), *[(ours[a], theirs[b]) for a, b in keys]]
    near = rt.between(lt - lower, lt + upper)
    names = [F.col(a).alias(c) for c, a in ours.items()] + [F.col(b).alias(right_prefix + c) for c, b in theirs.items()]
    if left.isStreaming or right.isStreaming or not all(_comparable(x.schema[a].dataType, y.schema[b].dataType) for a, b in pairs):
        out = x.join(y, _same(pairs) & near).select(*names)
    else:
        x, y, hot_x, hot_y = _deal(x, y, pairs)
        met = hot_x.join(hot_y.hint("MERGE"), (F.col("__x") == F.col("__y")) & near)
        out = x.join(y, _same(pairs) & near).select(*names).union(met.select(*names))
    return out.withColumn("ts", F.greatest(F.col(left_ts), F.col(right_prefix + right_ts)))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, value: str, name: str) -> DataFrame:
    """Each left row with the right ``value`` of the latest time at or before its own, of equal keys.

    One pass over the union in time order: a running last value per key, no pairs.
    """
    from pyspark.sql.window import Window

    cols = left.columns
    a = left.select(F.struct(*cols).alias("row"), *keys, F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    b = right.select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), *keys, F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    running = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn(name, F.last(F.when(F.col("__side") == 0, F.struct("__v")), True).over(running)["__v"])
    return out.where("__side = 1").select("row.*", name)
