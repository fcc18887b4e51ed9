"""Running state over ordered rows: SQL frames where they say it, else closures over a sorted stream.

Closures get the rows of a key in order, one by one, with a state of their own for each key. Rows are
sorted on disk if need be and stream through, so a key of any length needs the memory of its state. Values are
Python's own, straight from Arrow: integers of any size stay integers, nulls are None, times carry their zone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.operators.transforms import arrow_schema, as_column


def running(df: DataFrame, keys: list[str], order_by: list[str], **named: Column | str) -> DataFrame:
    """Each row with aggregates of the rows of its key up to it."""
    frame = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *[as_column(c).over(frame).alias(n) for n, c in named.items()])


def _same_key(row: dict, keys: list[str]) -> tuple:
    """Key values that compare equal to themselves, NaN too."""
    return tuple("NaN" if row[k] != row[k] else row[k] for k in keys)


def rich_flat_map(df: DataFrame, keys: list[str], order_by: list[str], make: Callable[[], Callable[[dict], Iterable[dict]]], schema, at_end: bool = False, scope: str = "global") -> DataFrame:
    """``make()`` gives each key a function from a row to rows; with ``at_end`` it is called with None once more after the last row.

    Without keys one function sees all rows in order, in one task. With ``scope='partition'`` each task has a function of
    its own over its rows instead, which keeps the tasks there are.
    """
    dealt = df if scope == "partition" else df.repartition(*keys) if keys else df.repartition(1)
    ordered = dealt.sortWithinPartitions(*keys, *order_by) if [*keys, *order_by] else dealt
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                key = _same_key(row, keys)
                if step is None or key != current:
                    if step is not None and at_end:
                        out += step(None)
                    current, step = key, make()
                out += step(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, out_schema)
        if step is not None and at_end:
            last = list(step(None))
            if last:
                yield pa.RecordBatch.from_pylist(last, out_schema)

    return ordered.mapInArrow(run, schema)


def rich_map(df: DataFrame, keys: list[str], order_by: list[str], make: Callable[[], Callable[[dict], dict]], schema) -> DataFrame:
    def wrap():
        fn = make()
        return lambda row: [fn(row)]

    return rich_flat_map(df, keys, order_by, wrap, schema)


def rich_filter_map(df: DataFrame, keys: list[str], order_by: list[str], make: Callable[[], Callable[[dict], dict | None]], schema) -> DataFrame:
    def wrap():
        fn = make()
        return lambda row: [x for x in (fn(row),) if x is not None]

    return rich_flat_map(df, keys, order_by, wrap, schema)


def rich_map_custom(df: DataFrame, keys: list[str], order_by: list[str], make: Callable[[], Callable[[dict | None], Iterable[dict]]], schema) -> DataFrame:
    """Like ``rich_flat_map``, and the function also sees the end of its key, as None."""
    return rich_flat_map(df, keys, order_by, make, schema, at_end=True)


def fold_rows(df: DataFrame, keys: list[str], order_by: list[str], zero: Callable[[], object], step: Callable[[object, dict], object], finish: Callable[[object], dict], schema) -> DataFrame:
    """An arbitrary fold in order, one row per key with the key's columns and what ``finish`` returns; no rows, no result."""

    def make():
        state = {"value": zero(), "key": None}

        def fn(row):
            if row is None:
                return [state["key"] | finish(state["value"])]
            state["key"] = {k: row[k] for k in keys}
            state["value"] = step(state["value"], row)
            return []

        return fn

    return rich_flat_map(df, keys, order_by, make, schema, at_end=True)


def commit_after(df: DataFrame, keys: list[str], order_by: list[str], ts: str, close: str, schema, fold: Callable[[list[dict]], dict | None]) -> DataFrame:
    """Transaction windows that close by time: a row whose ``close`` isn't null sets when its window ends.

    The window commits at the first row later than that, which opens the next one, or at the end of its key;
    one without a time to close is lost at the end. ``fold`` makes a row, or None, from a window's rows.
    """

    def make():
        rows: list[dict] = []
        until: list = [None]

        def emit():
            result = fold(list(rows)) if until[0] is not None else None
            rows.clear()
            until[0] = None
            return [] if result is None else [result]

        def fn(row):
            if row is None:
                return emit()
            out = emit() if until[0] is not None and row[ts] > until[0] else []
            rows.append(row)
            if row[close] is not None:
                until[0] = row[close]
            return out

        return fn

    return rich_flat_map(df, keys, order_by, make, schema, at_end=True)


def reorder(df: DataFrame, ts: str, *tie: str) -> DataFrame:
    """Rows in order of time."""
    return df.orderBy(ts, *tie)


def add_timestamps(df: DataFrame, ts: Column | str, delay: str | None = None, name: str = "ts") -> DataFrame:
    """A time column and, with ``delay``, a watermark that trails the latest time by it."""
    out = df.withColumn(name, as_column(ts))
    return out.withWatermark(name, delay) if delay else out


def drop_timestamps(df: DataFrame, name: str = "ts") -> DataFrame:
    return df.drop(name)
