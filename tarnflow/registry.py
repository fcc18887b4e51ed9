"""Registration of queries, each beside the SQL that it must agree with, and what several catalogs share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.flow import Engine, Flow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR = 3_600_000_000
DAY = 24 * HOUR


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def flow(spark: SparkSession, sf_dir: str, table: str) -> Flow:
    return Engine(spark).parquet(f"{sf_dir}/{table}.parquet")


def micros(column: str) -> Column:
    """Microseconds since the epoch of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def money(column: str) -> str:
    """An exact sum of two-digit decimals, as SQL for either engine."""
    return f"cast(sum(cast({column} as decimal(18,2))) as double)"


def events(spark, sf_dir) -> Flow:
    return Flow(flow(spark, sf_dir, "events").df.select("event_id", micros("ts").alias("ts"), "user_id", "event_type", "value"))


EVENTS = "e AS (SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value FROM events)"
