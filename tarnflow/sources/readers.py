"""Sources: files, iterators, generators, queues and user-defined ones."""

from __future__ import annotations

import queue
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnflow.storage import shared_dir


def rows(spark: SparkSession, values: Iterable, schema) -> DataFrame:
    """Rows of an iterator in memory."""
    return spark.createDataFrame(list(values), schema)


def integers(spark: SparkSession, start: int, end: int, tasks: int | None = None, name: str = "value") -> DataFrame:
    return spark.range(start, end, 1, tasks).toDF(name) if tasks else spark.range(start, end).toDF(name)


def parallel(spark: SparkSession, peers: int, make: Callable[[int, int], Iterable[dict]], schema) -> DataFrame:
    """``make(index, peers)`` runs in each of ``peers`` tasks and yields its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for index in batch["id"].tolist():
                out = []
                for row in make(index, peers):
                    out.append(row)
                    if len(out) == 10_000:
                        yield pd.DataFrame(out)
                        out = []
                if out:
                    yield pd.DataFrame(out)

    return spark.range(0, peers, 1, peers).mapInPandas(run, schema)


def text(spark: SparkSession, path: str) -> DataFrame:
    """Lines as ``value``, without their ends; large files are split between tasks."""
    return spark.read.text(path)


def csv(spark: SparkSession, path: str, schema, *, header: bool = True, delimiter: str = ",", quote: str = '"', double_quote: bool = True, escape: str | None = None, comment: str | None = None, terminator: str | None = None, trim: bool = False, flexible: bool = False, quoting: bool = True, multiline: bool = False) -> DataFrame:
    """Records by position against ``schema``. A record that doesn't fit fails the read, or with ``flexible`` gives nulls."""
    options = {
        "header": header, "sep": delimiter, "quote": quote if quoting else "\u0000", "escape": escape or (quote if double_quote else "\\"),
        "ignoreLeadingWhiteSpace": trim, "ignoreTrailingWhiteSpace": trim, "mode": "PERMISSIVE" if flexible else "FAILFAST",
        "enforceSchema": True, "multiLine": multiline,
    }
    if comment:
        options["comment"] = comment
    if terminator:
        options["lineSep"] = terminator
    return spark.read.schema(schema).options(**options).csv(path)


def parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A table with its filters and columns pushed into the scan; with ``schema`` its fields are checked first."""
    df = spark.read.parquet(path)
    if schema is not None:
        check_schema(df, schema)
        df = df.select(*schema.names)
    return df


def check_schema(df: DataFrame, schema: StructType) -> None:
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name)} is not {f.dataType}" for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("columns don't fit: " + "; ".join(wrong))


def typed(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns cast to a schema; values that don't fit become null."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


def _need(spark: SparkSession, kind: str) -> None:
    """Formats whose jars a deployment adds, or that a Python class registers; a clear error where they are missing."""
    state = spark._jsparkSession.sessionState()
    try:
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource(kind, state.conf())
    except Exception as error:
        if kind in ("avro", "kafka") or not state.dataSourceManager().dataSourceExists(kind):
            raise RuntimeError(f"the {kind} data source isn't on Spark's class path; start Spark with its package") from error


def avro(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Avro files by Spark's own reader where it is on the class path, else by the one in ``tarnflow.sources.avro``."""
    try:
        _need(spark, "avro")
    except RuntimeError:
        from tarnflow.sources import avro as own

        return own.read(spark, path)
    reader = spark.read.format("avro")
    return (reader.option("avroSchema", schema) if schema else reader).load(path)


def kafka(spark: SparkSession, servers: str, topics: list[str], stream: bool = True, source: str = "kafka", **options) -> DataFrame:
    """Messages of topics; offsets are kept by the query's checkpoint.

    Needs Spark's Kafka package, or as ``source`` the name of another data source that takes the same options.
    """
    _need(spark, source)
    reader = spark.readStream if stream else spark.read
    return reader.format(source).option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).options(**options).load()


def files_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """A stream of the files that appear in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).format(kind).load(path)


class Channel:
    """A program-fed bounded queue as a stream: rows sent are written to a folder, which the stream reads."""

    def __init__(self, spark: SparkSession, schema: StructType | str, size: int = 1024):
        self.spark, self.size = spark, size
        self.schema = spark.createDataFrame([], schema).schema
        self.path = f"{shared_dir(spark)}/channel-{uuid.uuid4().hex}"
        self.waiting: queue.Queue = queue.Queue(size)
        spark.createDataFrame([], self.schema).write.mode("append").parquet(self.path)

    def send(self, row: tuple) -> None:
        self.waiting.put(row)
        if self.waiting.qsize() >= self.size:
            self.flush()

    def flush(self) -> None:
        rows = []
        while not self.waiting.empty():
            rows.append(self.waiting.get())
        if rows:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    close = flush

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def frame(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def custom(spark: SparkSession, source: type, **options) -> DataFrame:
    """Rows of a Python ``DataSource`` class."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load()


def custom_stream(spark: SparkSession, source: type, **options) -> DataFrame:
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).options(**options).load()


def from_json(df: DataFrame, column: str, schema: str, name: str) -> DataFrame:
    return df.withColumn(name, F.from_json(column, schema))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
