"""Sinks: collections, channels, files, caches and side effects."""

from __future__ import annotations

import queue
from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row

from tarnflow.sources.readers import _need
from tarnflow.storage import materialize


def collect_vec(df: DataFrame) -> list[Row]:
    """All rows on the driver; for results of a size that it holds."""
    return df.collect()


def collect(df: DataFrame, container: Callable = list):
    """All rows in a container; rows of one column as their values, of two for a mapping as pairs."""
    if len(df.columns) == 1:
        return container(r[0] for r in df.toLocalIterator())
    return container(tuple(r) for r in df.toLocalIterator())


def collect_all(df: DataFrame, container: Callable = list):
    """The container sent to every executor, as a broadcast variable."""
    return df.sparkSession.sparkContext.broadcast(collect(df, container))


def collect_count(df: DataFrame) -> int:
    return df.count()


def collect_channel(df: DataFrame) -> Iterator[Row]:
    """Rows one by one, partition after partition."""
    return df.toLocalIterator(prefetchPartitions=True)


def collect_channel_parallel(df: DataFrame, fn: Callable[[Iterator[Row]], None]) -> None:
    """``fn`` consumes the rows of each partition where they are."""
    df.foreachPartition(fn)


def for_each(df: DataFrame, fn: Callable[[Row], None]) -> None:
    df.foreach(fn)


def stream_channel(df: DataFrame, checkpoint: str, size: int = 1024, mode: str = "append", **trigger):
    """A streaming query and the bounded queue that its rows go to on the driver."""
    out: queue.Queue = queue.Queue(size)

    def put(batch: DataFrame, _: int) -> None:
        for row in batch.toLocalIterator():
            out.put(row)

    query = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    return query, out


def write_csv(df: DataFrame, path: str, append: bool = False, one: bool = False, header: bool = True) -> None:
    """Part files in a folder, or one; each has a header."""
    (df.coalesce(1) if one else df).write.mode("append" if append else "errorifexists").csv(path, header=header)


def write_parquet(df: DataFrame, path: str, append: bool = False, one: bool = False) -> None:
    (df.coalesce(1) if one else df).write.mode("append" if append else "errorifexists").option("compression", "snappy").parquet(path)


def write_avro(df: DataFrame, path: str, append: bool = False, one: bool = False) -> None:
    """By Spark's own writer where it is on the class path, else by ``tarnflow.sources.avro``."""
    df = df.coalesce(1) if one else df
    try:
        _need(df.sparkSession, "avro")
    except RuntimeError:
        from tarnflow.sources import avro as own

        own.write(df, path, append)
        return
    df.write.mode("append" if append else "errorifexists").format("avro").save(path)


def write_kafka(df: DataFrame, servers: str, topic: str, source: str = "kafka", **options) -> None:
    """Rows with a ``value`` (and a ``key``) to a topic. Needs Spark's Kafka package, or another ``source`` with its options."""
    _need(df.sparkSession, source)
    df.write.format(source).mode("append").option("kafka.bootstrap.servers", servers).option("topic", topic).options(**options).save()


def stream_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, mode: str = "append", trigger: dict | None = None, source: str = "kafka", **options):
    """The same for a stream, as a running query; messages of a failed micro-batch may come twice."""
    _need(df.sparkSession, source)
    out = df.writeStream.format(source).outputMode(mode).option("checkpointLocation", checkpoint).option("kafka.bootstrap.servers", servers).option("topic", topic)
    return out.options(**options).trigger(**(trigger or {"availableNow": True})).start()


LEVELS = {"memory": StorageLevel.MEMORY_ONLY, "memory_and_disk": StorageLevel.MEMORY_AND_DISK, "disk": StorageLevel.DISK_ONLY}


def cache(df: DataFrame, where: str = "memory_and_disk") -> DataFrame:
    """The frame kept for reuse: on executors, or with ``where='shared'`` in the shared folder, which survives them."""
    return materialize(df, "cache") if where == "shared" else df.persist(LEVELS[where])


def collect_cache(df: DataFrame, where: str = "shared") -> DataFrame:
    """Run the flow now and keep its rows."""
    out = cache(df, where)
    if where != "shared":
        out.count()
    return out


def custom(df: DataFrame, source: type, mode: str = "append", **options) -> None:
    """To a Python ``DataSource`` class with a writer."""
    df.sparkSession.dataSource.register(source)
    df.write.format(source.name()).mode(mode).options(**options).save()
