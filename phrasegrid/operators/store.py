"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors all see. Only a session in one process, which has no
    other machines, may leave it unset and has a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), f"phrasegrid-{spark.sparkContext.applicationId}")
    return found.rstrip("/")


_own = threading.local()


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of what this thread stores inside."""
    before, _own.paths = getattr(_own, "paths", None), []
    try:
        yield _own.paths
    finally:
        _own.paths = before


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it back, so that later plans start from the table and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if getattr(_own, "paths", None) is not None:
        _own.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, name: str) -> DataFrame:
    """A table that comes in fewer pieces than there are cores, stored anew in as many if they take it at once (1 to 32 MB
    each); others as they are, since larger ones come in more."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    few = 1 << 20 <= size <= cores * (32 << 20) and df.rdd.getNumPartitions() < cores
    return stored(df.repartition(cores), name) if few else df


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def present(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    fs, p = _path(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if it isn't there."""
    fs, p = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole: it has its name only once it is complete. An existing one isn't replaced."""
    fs, p = _path(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    part = _path(spark, f"{path}.{uuid.uuid4().hex}.part")[1]
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(part, p):
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
