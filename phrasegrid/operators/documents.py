"""Sets of documents as bitmaps: which documents have a word for every token of a phrase."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of one bitmap, as Spark's bitmap functions have it.
BITS = 32768


def documents_of(held: Callable[[list[str]], DataFrame], words: list[tuple[str, int]], phrases: dict[int, set[int]], at_once: int) -> DataFrame:
    """(bucket, docs): bitmaps of the documents that have, for some phrase, a word of each of its keys.

    ``held`` gives the (word, doc_id) of some words; ``words`` are (word, key), looked up ``at_once`` words at a time; ``phrases``
    have their keys. Documents are numbers; a bucket has :data:`BITS` of them. A bitmap's aggregation sorts its rows, so each
    document comes to it once a key, however often it has the words.
    """
    distinct, rows = sorted({w for w, _ in words}), None
    for lo in range(0, max(len(distinct), 1), at_once):
        some = distinct[lo : lo + at_once]
        own = [x for x in words if some and some[0] <= x[0] <= some[-1]]
        table = pa.table({"word": pa.array([w for w, _ in own], pa.string()), "key": pa.array([k for _, k in own], pa.int32())})
        docs = held(some)
        part = docs.join(F.broadcast(docs.sparkSession.createDataFrame(table)), "word").select("key", "doc_id")
        rows = part if rows is None else rows.unionByName(part)
    by_key: dict[int, list[int]] = {}
    for p, keys in phrases.items():
        for k in keys:
            by_key.setdefault(k, []).append(p)
    of_key = rows.distinct().groupBy("key", F.bitmap_bucket_number("doc_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("docs"))
    at = F.create_map(*(F.lit(x) for k, ps in by_key.items() for x in (k, ps)))
    size = F.create_map(*(F.lit(x) for p, keys in phrases.items() for x in (p, len(keys))))
    both = of_key.select("bucket", "docs", F.explode(at[F.col("key")]).alias("phrase")).groupBy("phrase", "bucket")
    both = both.agg(F.bitmap_and_agg("docs").alias("docs"), F.count("*").alias("keys")).filter(F.col("keys") == size[F.col("phrase")])
    return both.groupBy("bucket").agg(F.bitmap_or_agg("docs").alias("docs"))


def expanded(sets: DataFrame) -> DataFrame:
    """(doc_id) of the bits that are set in (bucket, docs)."""
    digits = sets.filter(F.bitmap_count("docs") > 0).select("bucket", F.posexplode(F.split(F.hex("docs"), "")).alias("nth", "digit")).filter(~F.col("digit").isin("", "0"))
    # Of a byte's two digits the first has the upper four bits.
    first = F.floor(F.col("nth") / 2) * 8 + F.when(F.col("nth") % 2 == 0, 4).otherwise(0)
    bits = digits.select("bucket", first.alias("first"), F.conv("digit", 16, 10).cast("int").alias("value"), F.explode(F.array(*map(F.lit, range(4)))).alias("bit"))
    place = bits.filter(F.floor(F.col("value") / F.pow(F.lit(2), F.col("bit"))) % 2 == 1).select("bucket", (F.col("first") + F.col("bit")).alias("place"))
    # Numbers above zero fill buckets from 1 on, others those from 0 down.
    above = (F.col("bucket") - 1) * BITS + F.col("place") + 1
    return place.select(F.when(F.col("bucket") > 0, above).otherwise(F.col("bucket") * BITS - F.col("place")).cast("long").alias("doc_id"))
