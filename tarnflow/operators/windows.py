"""Window descriptions, the rows they assign, and aggregation over them.

A description adds integer columns to each row for the window it is in (``win``; several rows if it is in
several windows) and says which windows are complete. Aggregates are Spark's own, so they combine
before the shuffle. Without keys, rows are ordered by range over all tasks, and what a range needs of those
before it (a count, a time) is carried in a row per range.

A description of one's own is any object with ``assign(df, keys, order_by)``, which adds ``win``, and
``complete(out, keys)``, which gets a row per window with its count ``__n``; an accumulator of one's own is any
aggregate expression, or a function of a window's rows given to ``window_to_arrow``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.operators.combine import number_rows, offset_by_part, ranged
from tarnflow.operators.transforms import as_column


def _keys(keys: list[str]) -> list[Column]:
    return [F.col(k) for k in keys] or [F.lit(0)]


def _numbered(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Rows with their places in their key; without keys they are numbered by range, in as many tasks as there are."""
    if not keys:
        return number_rows(df, order_by, "__rn")
    return df.withColumn("__rn", (F.row_number().over(Window.partitionBy(*_keys(keys)).orderBy(*order_by)) - 1).cast("long"))


@dataclass(frozen=True)
class CountWindow:
    """``size`` rows of a key in order, a new window every ``slide`` rows.

    Only full windows count; with ``exact=False`` the first that isn't full at the end does too. A slide
    above the size leaves no gaps: windows then follow one another.
    """

    size: int
    slide: int
    exact: bool = True

    @classmethod
    def tumbling(cls, size: int) -> CountWindow:
        return cls(size, size)

    @classmethod
    def sliding(cls, size: int, slide: int) -> CountWindow:
        return cls(size, slide)

    def assign(self, df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
        slide = min(self.slide, self.size)
        numbered = _numbered(df, keys, order_by)
        first = F.greatest(F.lit(0), F.ceil((F.col("__rn") - self.size + 1) / slide)).cast("long")
        if slide == self.size:
            return numbered.withColumn("win", F.floor(F.col("__rn") / slide).cast("long")).drop("__rn")
        return numbered.withColumn("win", F.explode(F.sequence(first, F.floor(F.col("__rn") / slide).cast("long")))).drop("__rn")

    def complete(self, out: DataFrame, keys: list[str]) -> DataFrame:
        if self.exact:
            return out.where(F.col("__n") == self.size)
        least = F.min(F.when(F.col("__n") < self.size, F.col("win")))
        open_ = least.over(Window.partitionBy(*_keys(keys))) if keys else out.agg(least).scalar()
        return out.withColumn("__open", open_).where((F.col("__n") == self.size) | (F.col("win") == F.col("__open"))).drop("__open")


@dataclass(frozen=True)
class LastKWindow:
    """For each row of a key, in order, the window of the last ``k`` rows up to it."""

    k: int

    def assign(self, df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
        rows = F.count(F.lit(1))
        numbered = _numbered(df, keys, order_by)
        numbered = numbered.withColumn("__max", (rows.over(Window.partitionBy(*_keys(keys))) if keys else df.agg(rows).scalar()) - 1)
        return numbered.withColumn("win", F.explode(F.sequence(F.col("__rn"), F.least(F.col("__rn") + self.k - 1, F.col("__max"))))).drop("__rn", "__max")

    def complete(self, out: DataFrame, keys: list[str]) -> DataFrame:
        return out


@dataclass(frozen=True)
class AllWindow:
    """All rows of a key."""

    def assign(self, df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
        return df.withColumn("win", F.lit(0).cast("long"))

    def complete(self, out: DataFrame, keys: list[str]) -> DataFrame:
        return out


@dataclass(frozen=True)
class EventTimeWindow:
    """Windows ``[start, start + size)`` on an integer time column, a new one every ``slide``.

    ``align='first'`` anchors them at the first time of each key, so none starts before it; ``'epoch'`` at
    multiples of the slide. A slide above the size leaves gaps, whose rows are in no window. Windows without
    rows don't appear. ``win`` is the start.
    """

    size: int
    slide: int
    ts: str = "ts"
    align: str = "first"

    @classmethod
    def tumbling(cls, size: int, **more) -> EventTimeWindow:
        return cls(size, size, **more)

    @classmethod
    def sliding(cls, size: int, slide: int, **more) -> EventTimeWindow:
        return cls(size, slide, **more)

    def anchored(self, df: DataFrame, keys: list[str], anchors: DataFrame | None = None) -> DataFrame:
        if self.align == "epoch":
            return df.withColumn("__anchor", F.lit(0).cast("long"))
        if anchors is None:
            anchors = df.groupBy(*keys).agg(F.min(self.ts).alias("__anchor"))
        if not keys:
            return df.withColumn("__anchor", anchors.select("__anchor").scalar())
        named = anchors.toDF(*[f"__{k}" for k in keys], "__anchor")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        return df.join(named, same).drop(*[f"__{k}" for k in keys])

    def assign(self, df: DataFrame, keys: list[str], order_by: list[str], anchors: DataFrame | None = None) -> DataFrame:
        based = self.anchored(df, keys, anchors)
        d = (F.col(self.ts) - F.col("__anchor")).cast("long")
        last = F.floor(d / self.slide).cast("long")
        if self.slide == self.size:
            return based.withColumn("win", F.col("__anchor") + last * self.slide).drop("__anchor")
        first = (F.floor((d - self.size) / self.slide) + 1).cast("long")
        if self.align == "first":
            first = F.greatest(F.lit(0).cast("long"), first)
        inside = based.withColumn("__a", first).withColumn("__b", last).where("__a <= __b")
        starts = F.transform(F.sequence("__a", "__b"), lambda k: F.col("__anchor") + k * self.slide)
        return inside.withColumn("win", F.explode(starts)).drop("__a", "__b", "__anchor")

    def complete(self, out: DataFrame, keys: list[str]) -> DataFrame:
        return out


@dataclass(frozen=True)
class SessionWindow:
    """Runs of rows of a key that are at most ``gap`` apart on an integer time column; ``win`` is the first time."""

    gap: int
    ts: str = "ts"

    def assign(self, df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
        if not keys:
            return self._all(df)
        w = Window.partitionBy(*_keys(keys)).orderBy(self.ts)
        opens = (F.col(self.ts) - F.lag(self.ts).over(w) > self.gap) | F.lag(self.ts).over(w).isNull()
        begun = df.withColumn("__start", F.when(opens, F.col(self.ts)))
        return begun.withColumn("win", F.last("__start", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")

    def _all(self, df: DataFrame) -> DataFrame:
        """Sessions over all rows: within ranges of time, with the last time and the last start of the ranges before."""
        parts = ranged(df, [self.ts])
        inside, before = Window.partitionBy("__part").orderBy(self.ts), Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        ends = parts.groupBy("__part").agg(F.max(self.ts).alias("__end"))
        ends = ends.select("__part", F.last("__end", True).over(before).alias("__was"))  # a row per range
        parts = parts.join(F.broadcast(ends), "__part")
        last = F.coalesce(F.lag(self.ts).over(inside), F.col("__was"))
        parts = parts.withColumn("__start", F.when(last.isNull() | (F.col(self.ts) - last > self.gap), F.col(self.ts)))
        starts = parts.groupBy("__part").agg(F.max("__start").alias("__open")).select("__part", F.last("__open", True).over(before).alias("__carried"))
        parts = parts.join(F.broadcast(starts), "__part")
        own = F.last("__start", True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        return parts.withColumn("win", F.coalesce(own, F.col("__carried"))).drop("__part", "__was", "__start", "__carried")

    def complete(self, out: DataFrame, keys: list[str]) -> DataFrame:
        return out


@dataclass(frozen=True)
class TransactionWindow:
    """One open window per key that a row commits or discards; that row is in it. What no row commits is lost.

    ``commit`` and ``discard`` are conditions on a row; ``commit`` is looked at first. ``win`` counts the
    commits and discards before.
    """

    commit: Column | str
    discard: Column | str = "false"

    def assign(self, df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
        commits = F.coalesce(as_column(self.commit), F.lit(False))
        ends = commits | F.coalesce(as_column(self.discard), F.lit(False))
        tagged = df.withColumn("__commit", commits).withColumn("__ends", ends.cast("long"))
        if not keys:
            return offset_by_part(ranged(tagged, order_by), order_by, "__ends", "win").drop("__ends")
        before = Window.partitionBy(*_keys(keys)).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
        return tagged.withColumn("win", F.coalesce(F.sum("__ends").over(before), F.lit(0))).drop("__ends")

    def complete(self, out: DataFrame, keys: list[str]) -> DataFrame:
        return out.where("__committed")


def _framed(df: DataFrame, keys: list[str], window: LastKWindow, order_by: list[str], named: dict[str, Column | str]) -> DataFrame | None:
    """Last-k windows as row frames, without copying rows; None for expressions over aggregates, which have no frame."""
    frame = Window.partitionBy(*_keys(keys)).orderBy(*order_by).rowsBetween(-(window.k - 1), 0)
    place = F.row_number().over(Window.partitionBy(*_keys(keys)).orderBy(*order_by)) - 1
    try:
        return df.select(*keys, place.cast("long").alias("win"), *[as_column(c).over(frame).alias(n) for n, c in named.items()])
    except AnalysisException:
        return None


def aggregate(df: DataFrame, keys: list[str], window, order_by: list[str], **named: Column | str) -> DataFrame:
    """``keys, win`` and the aggregates of each complete window."""
    if keys and isinstance(window, LastKWindow) and (framed := _framed(df, keys, window, order_by, named)) is not None:
        return framed
    assigned = window.assign(df, keys, order_by)
    extra = [F.count(F.lit(1)).alias("__n")]
    if isinstance(window, TransactionWindow):
        extra.append(F.bool_or("__commit").alias("__committed"))
    out = assigned.groupBy(*keys, "win").agg(*[as_column(c).alias(n) for n, c in named.items()], *extra)
    return window.complete(out, keys).drop("__n", "__committed")


def ordered_list(value: Column | str, order_by: list[str]) -> Column:
    """The values of a window as a list in order."""
    pair = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)], as_column(value).alias("v"))
    return F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["v"])


def first_value(value: str, order_by: list[str]) -> Column:
    return F.min_by(value, F.struct(*order_by))


def last_value(value: str, order_by: list[str]) -> Column:
    return F.max_by(value, F.struct(*order_by))


def min_by_key(row: Column, key: str, order_by: list[str]) -> Column:
    """The row with the least key, the first of equal ones."""
    return F.min_by(row, F.struct(key, *order_by))


def max_by_key(row: Column, key: str, order_by: list[str]) -> Column:
    """The row with the greatest numeric key, the first of equal ones by numeric order columns."""
    return F.max_by(row, F.struct(F.col(key), *[-F.col(c) for c in order_by]))


def window_join(left: DataFrame, right: DataFrame, keys: list[str], window: EventTimeWindow, right_prefix: str = "r_") -> DataFrame:
    """All pairs of the two sides in one key and window; first-aligned windows start at the first time of either side."""
    anchors = None
    if window.align == "first":
        both = left.select(*keys, window.ts).unionByName(right.select(*keys, window.ts))
        anchors = both.groupBy(*keys).agg(F.min(window.ts).alias("__anchor"))
    l = window.assign(left, keys, [], anchors)  # noqa: E741
    r = window.assign(right, keys, [], anchors)
    r = r.toDF(*[c if c == "win" else right_prefix + c for c in r.columns])
    same = reduce(lambda a, b: a & b, [l[k].eqNullSafe(r[right_prefix + k]) for k in keys], l["win"] == r["win"])
    return l.join(r, same).drop(r["win"])


def window_to_arrow(df: DataFrame, keys: list[str], window, order_by: list[str], fn, schema) -> DataFrame:
    """Each window as an Arrow table given to ``fn``, which returns a table; a window must fit in a task."""
    assigned = window.assign(df, keys, order_by)
    return assigned.groupBy(*keys, "win").applyInArrow(lambda table: fn(table.sort_by([(c, "ascending") for c in order_by]) if order_by else table), schema)
