"""What the operators share: input, saved intermediate tables, row keys and Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at a time; longer single texts go alone.
BATCH_BYTES = 8_000_000


#: Bytes from which a table that comes in too few pieces is dealt out, and at most for each core.
SPREAD_LEAST, SPREAD_MOST = 1 << 20, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One that comes in fewer pieces than there are cores, and is no larger than they take at once, is stored anew
    in as many, so that the work on its rows isn't left to a few tasks; larger ones come in more."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if SPREAD_LEAST <= _size(df) <= SPREAD_MOST * cores and df.rdd.getNumPartitions() < cores:
        return saved(df.repartition(cores), name)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors all see. Only a session in one process, as in
    tests, may leave it unset and has a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), f"checkpoints-{spark.sparkContext.applicationId}")
    return found.rstrip("/")


def _size(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: a lost executor then costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def saved_together(tables: list[DataFrame]) -> DataFrame:
    """Saved tables of one schema as one, by a single read of their folders."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(_places[t] for t in tables))


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables. Only for those whose every use has itself been written."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_places.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def whole(text: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))


def crc_of(key: Column) -> Column:
    """crc32 of the id as decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def text_slices(texts: list, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts a batch of texts into runs [start, end) of about ``most`` bytes, at least one text each."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if texts:
        yield start, len(texts)
