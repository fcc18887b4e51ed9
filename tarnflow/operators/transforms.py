"""Stateless row transforms. Expressions stay in the JVM; closures work on pandas batches."""

from __future__ import annotations

import asyncio
from collections.abc import Awaitable, Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def as_column(x: Column | str) -> Column:
    """A column from a column or a SQL expression."""
    return F.expr(x) if isinstance(x, str) else x


def arrow_schema(schema: StructType | str) -> pa.Schema:
    """The Arrow schema of a Spark schema or its DDL."""
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def map_columns(df: DataFrame, keep: list[str] = (), **named: Column | str) -> DataFrame:
    return df.select(*keep, *[as_column(c).alias(n) for n, c in named.items()])


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """A closure over pandas batches, Arrow in and out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def filter_map(df: DataFrame, name: str, expr: Column | str) -> DataFrame:
    """Add a column and keep the rows on which it isn't null."""
    return df.withColumn(name, as_column(expr)).where(F.col(name).isNotNull())


def flat_map(df: DataFrame, name: str, array: Column | str) -> DataFrame:
    """A row for each element of an array; rows with an empty or null one vanish."""
    return df.withColumn(name, F.explode(as_column(array)))


def flatten(df: DataFrame, name: str) -> DataFrame:
    return flat_map(df, name, F.col(name))


def inspect(df: DataFrame, observation, **measures: Column) -> DataFrame:
    """Tap a flow: aggregates of the rows that pass, readable from ``observation`` after an action."""
    return df.observe(observation, *[c.alias(n) for n, c in measures.items()])


def map_memo(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.Series], name: str, kind: str) -> DataFrame:
    """A costly function of ``keys``, run once for each distinct key over the whole cluster and joined back."""
    fields = df.select(*keys).schema
    distinct = df.select(*keys).distinct()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` {kind}"])
    return _joined_back(df, keys, map_batches(distinct, lambda batch: batch.assign(**{name: fn(batch)}), schema), name)


def _joined_back(df: DataFrame, keys: list[str], done: DataFrame, name: str) -> DataFrame:
    renamed = done.toDF(*[f"__{k}" for k in keys], name)
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = one if same is None else same & one
    return df.join(renamed, same, "left").drop(*[f"__{k}" for k in keys])


def map_async(df: DataFrame, fn: Callable[[dict], Awaitable[dict]], schema, concurrency: int = 4) -> DataFrame:
    """A coroutine per row with at most ``concurrency`` in flight in a task; rows keep their order, integers and nulls stay what they are."""

    async def gather(rows: list[dict]) -> list[dict]:
        gate = asyncio.Semaphore(concurrency)

        async def one(row: dict) -> dict:
            async with gate:
                return await fn(row)

        return await asyncio.gather(*(one(r) for r in rows))

    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield pa.RecordBatch.from_pylist(asyncio.run(gather(batch.slice(at, 1024).to_pylist())), out_schema)

    return df.mapInArrow(run, schema)


def map_async_memo(df: DataFrame, keys: list[str], fn: Callable[[dict], Awaitable], name: str, kind: str, concurrency: int = 4) -> DataFrame:
    """A coroutine of ``keys``, awaited once for each distinct key over the whole cluster and joined back."""
    distinct = df.select(*keys).distinct()

    async def each(row: dict) -> dict:
        return {**row, name: await fn(row)}

    schema = StructType([*distinct.schema.fields, *StructType.fromDDL(f"`{name}` {kind}").fields])
    return _joined_back(df, keys, map_async(distinct, each, schema, concurrency), name)
