"""Cutting lineage through the session's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder if all runs in one process, else an error."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tarnflow-core-")
    return _own[app]


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """The frame as written to, and read back from, the shared folder: a lost executor recomputes nothing before it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, parts: int) -> tuple[DataFrame, str]:
    """The frame written to the shared folder in ``parts`` files by a hash of ``key``, so that joins on it needn't shuffle it again, and the name of its table for ``drop``."""
    spark, name = df.sparkSession, f"cut_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name), name


def drop(spark: SparkSession, *names: str) -> None:
    """Delete tables made by ``bucketed`` and their files."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames made by ``materialize`` that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
