"""Document lists: groups, sort keys, focus, samples and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lang.sort import SortBy
from .store import stored


def best_per_document(results: DataFrame) -> DataFrame:
    """(doc_id, best_score, best_pos, n_results)."""
    top = F.max(F.struct(F.round("score", 6).alias("score"), (-F.col("found")[0]["pos"]).alias("neg")))
    return results.groupBy("doc_id").agg(top.alias("t"), F.count("*").alias("n_results")).select("doc_id", F.col("t.score").alias("best_score"), (-F.col("t.neg")).alias("best_pos"), "n_results")


def keys(sort: SortBy) -> list[Column]:
    """Sort columns of one key; what a document lacks comes last either way."""
    column = {"path": "path", "path-date": "path_date", "mod-time": "mod_time", "score": "best_score", "fuzzy-ranking": "ranking"}[sort.by]
    first = F.col(column).desc_nulls_last() if sort.descending else F.col(column).asc_nulls_last()
    tie = F.col("path").desc() if sort.descending and sort.by == "path-date" else F.col("path").asc()
    return [first, tie] if sort.by != "score" else [first, F.col("best_pos").asc_nulls_last(), F.col("path").asc()]


def focused_keys(sort: SortBy, focus: list[str] = ()) -> list[Column]:
    """Sort columns of a key, focused paths first in the order they were focused, each by its latest time."""
    if not focus:
        return keys(sort)
    at = F.create_map(*(x for p, i in {p: i for i, p in enumerate(focus)}.items() for x in (F.lit(p), F.lit(i))))
    return [F.try_element_at(at, F.col("path")).asc_nulls_last(), *keys(sort)]


def sort_documents(docs: DataFrame, sort: SortBy, focus: list[str] = ()) -> DataFrame:
    return docs.orderBy(*focused_keys(sort, focus))


def with_match(docs: DataFrame, results: DataFrame) -> DataFrame:
    return docs.join(results.select("doc_id").distinct(), "doc_id", "left_semi")


def without_match(docs: DataFrame, results: DataFrame) -> DataFrame:
    return docs.join(results.select("doc_id").distinct(), "doc_id", "left_anti")


def sample(results: DataFrame, n: int) -> DataFrame:
    """The n best results of each document."""
    from .search import ranked

    return ranked(results, n)


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds each row's number in a total order, from 1: a distributed sort, then a count of rows per partition and a
    running sum of those counts (one row per partition), so that no task sees all rows."""
    rows = df.orderBy(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row"))
    rows = stored(rows, "placed")
    counts = rows.groupBy("__part").agg(F.count("*").alias("n"))
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    place = F.col("__before") + F.col("__row").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(before), "__part").withColumn(name, place).drop("__part", "__row", "__before")


def focus_rank(docs: DataFrame, focus: DataFrame) -> DataFrame:
    """Position in the list by path, focused documents (path, at) first by their latest ``at``: for large focus lists."""
    latest = focus.groupBy("path").agg(F.max("at").alias("at"))
    return placed(docs.join(latest, "path", "left"), [F.col("at").asc_nulls_last(), F.col("path")])
