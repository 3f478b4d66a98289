"""Exact top-k search by inner product over a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved, saved_together

#: Cells of a dimension; a cell number takes one byte.
CELLS = 256
#: Bytes of the queries that one pass over the cells answers: they are broadcast.
PASS_BYTES = 32_000_000
#: Queries that are scanned at a time, and rows of a block of the scan.
QUERY_BLOCK, ROW_BLOCK = 2048, 4096
#: Exact vectors read per query in the first round; each round reads as many times more.
STEP, GROWTH = 8, 4


def _usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def _ranges(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vector, the least and largest value of every dimension: over all rows, one row per dimension."""
    flat = vectors.select(F.size("vector").alias("size"), F.posexplode("vector").alias("d", "x"))
    rows = flat.groupBy("size", "d").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("size", "d").collect()
    out: dict[int, tuple[list, list]] = {}
    for r in rows:
        lo, hi = out.setdefault(r["size"], ([], []))
        lo.append(r["lo"])
        hi.append(r["hi"])
    return {k: (np.array(lo, np.int64), np.array(hi, np.int64)) for k, (lo, hi) in out.items()}


def _width(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-(hi - lo + 1) // CELLS))


def _matrices(b: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a batch and vectors, by the vectors' length."""
    lists = b.column(at)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.r_[0, sizes])[:-1]
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[starts[rows][:, None] + np.arange(size)]


def top_k(
    table: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` the k largest integer inner products with other rows.

    The approximation file holds one cell number per component, cells being equal parts of the dimension's range, and no
    vectors; those are a table of their own. First the cells alone are scanned, the queries in blocks against all rows: two
    products with the cells' middles and half-widths bound every score from both sides, and a row whose upper bound is under
    the k-th best lower bound so far is out. Then exact vectors are read, for the rows left, in the order of their upper
    bounds: a few for each query, then more for those queries where the next bound still reaches the k-th score, until none
    does. Equal vectors tie, so of a vector that is very common only the least ids are in the file at all.

    Ties go to the smaller vec_id. A query's own row (all rows of its id, if ids repeat) is no candidate; other repeated
    rows each count, and each query row is answered by itself. Vectors null or with null or non-finite components take no
    part; vectors meet only those of their length, empty ones none; rows without an id take no part. With fewer than k
    candidates all are returned. An empty table gives no rows. Components so large that a score may leave 64 bits are
    refused with a ValueError.
    """
    return exact_top(*approximate_candidates(table, is_query, k, id_col, vector_col, scale), k)


def approximate_candidates(table: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: int) -> tuple[DataFrame, DataFrame]:
    """Exact vectors (row, vec_id, query, vector), and what the scan of the cells leaves: query_row, row, upper, nth by upper
    bound. Every row that may be among a query's k best is there."""
    flagged = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("raw"), F.coalesce(is_query, F.lit(False)).alias("query"))
    flagged = flagged.filter("vec_id is not null").filter(_usable(F.col("raw"))).filter(F.size("raw") > 0)
    vectors = flagged.select(F.monotonically_increasing_id().alias("row"), "vec_id", "query", F.transform("raw", lambda x: F.floor(scale * x)).alias("vector"))
    vectors = saved(vectors, "vectors")
    ranges = _ranges(vectors)
    for size, (lo, hi) in ranges.items():
        if size * max(abs(int(x)) for x in (*lo, *hi)) ** 2 >= 1 << 63:
            raise ValueError("components are too large for scores of 64 bits")

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in _matrices(b, 2):
                lo, hi = ranges[x.shape[1]]
                cells = ((x - lo) // _width(lo, hi)).astype(np.uint8)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([c.tobytes() for c in cells], pa.binary())], ["row", "vec_id", "cells"])

    # Of equal vectors only the k least ids besides a query's own can be among its best, and of a repeated id k rows.
    ids = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    enough = vectors.select("row", "vec_id", "vector").withColumn("nth_id", ids).filter(F.col("nth_id") <= k + 1)
    enough = _first(enough, ["vector", "vec_id"], [F.col("row")], k)
    file = saved(enough.select("row", "vec_id", "vector").mapInArrow(approximate, "row long, vec_id long, cells binary"), "cells")
    queries = vectors.filter("query")
    passes = -(-(queries.agg(F.coalesce(F.sum(F.size("vector") * 8 + 16), F.lit(0))).first()[0]) // PASS_BYTES)
    queries = saved(queries.withColumn("pass", F.pmod(F.xxhash64("row"), F.lit(max(1, passes)))), "queries")
    # What a pass leaves is written before the next one, so plans don't grow with their number.
    left = []
    for n in range(passes):
        mine = table.sparkSession.sparkContext.broadcast(queries.filter(F.col("pass") == n).select("row", "vec_id", "vector").toArrow())  # about PASS_BYTES
        bounds = saved(file.mapInArrow(_scan(mine, ranges, k), BOUNDS), "bounds")
        # The k-th best lower bound of each query, of the tasks' own k best.
        lower = _first(_first(bounds, ["query_row", "part"], [F.desc("lower")], k), ["query_row"], [F.desc("lower")], k)
        least = lower.filter(F.col("nth") == k).select("query_row", F.col("lower").alias("least"))
        rows = bounds.join(least, "query_row", "left").filter(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).select("query_row", "row", "upper")
        left.append(saved(rows, "survivors"))
        discard(bounds)
        mine.destroy()
    every = saved_together(left) if left else table.sparkSession.createDataFrame([], "query_row long, row long, upper double")
    candidates = saved(_first(every, ["query_row"], [F.desc("upper"), F.col("row")]), "candidates")
    discard(file, queries, *left)
    return vectors, candidates


def exact_top(vectors: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from exact vectors of ``candidates``, read in the order of their upper bounds."""
    asking = vectors.filter("query").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("vector").alias("q"))
    best, start, end = None, 0, STEP
    due = candidates.filter(F.col("nth") <= end)
    while not due.isEmpty():
        got = due.select("query_row", "row").join(asking, "query_row").join(vectors.select("row", "vec_id", "vector"), "row")
        products = F.zip_with("q", "vector", lambda a, b: a * b)
        got = got.select("query_row", "query_id", "vec_id", F.aggregate(products, F.lit(0).cast("long"), lambda n, x: n + x).alias("score"))
        both = got if best is None else got.unionByName(best.select(*got.columns))
        last, best = best, saved(_first(both, ["query_row"], [F.desc("score"), F.col("vec_id")], k), "neighbours")
        if last is not None:
            discard(last)
        kth = best.filter(F.col("nth") == k).select("query_row", F.col("score").alias("least"))
        start, end = end, end + (end - start) * GROWTH
        # A bound that equals the k-th score may still be a tie of a smaller id.
        due = candidates.filter(F.col("nth").between(start + 1, end)).join(kth, "query_row", "left").filter(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
    if best is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.select("query_id", F.col("nth").alias("rank"), "vec_id", "score")


def _first(rows: DataFrame, keys: list[str], order: list[Column], k: int | None = None) -> DataFrame:
    """Rows numbered from 1 within their keys, the first k of them."""
    rows = rows.drop("nth").withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows if k is None else rows.filter(F.col("nth") <= k)


BOUNDS = "query_row long, row long, lower double, upper double, part int"


def _scan(shared, ranges: dict, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() // 64
        searches: dict[int, list[_Bounds]] = {}
        asked = shared.value.combine_chunks()
        for at, x in _matrices(pa.RecordBatch.from_arrays([c.combine_chunks() for c in asked.columns], asked.column_names), 2):
            rows, ids = (asked.column(i).to_numpy()[at] for i in (0, 1))
            blocks = [slice(lo, lo + QUERY_BLOCK) for lo in range(0, len(at), QUERY_BLOCK)]
            searches[x.shape[1]] = [_Bounds(rows[own], ids[own], x[own], *ranges[x.shape[1]], k) for own in blocks]
        for b in batches:
            for lo in range(0, b.num_rows, ROW_BLOCK):
                rows, ids, cells = b.slice(lo, ROW_BLOCK).columns
                raw, sizes = cells.to_pylist(), pc.binary_length(cells).to_numpy()
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    matrix = np.frombuffer(b"".join(raw[i] for i in own), np.uint8).reshape(-1, size)
                    for search in searches.get(int(size), ()):
                        q, c, lower, upper = search.add(ids.to_numpy()[own], matrix)
                        columns = [pa.array(search.rows[q]), pa.array(rows.to_numpy()[own][c]), pa.array(lower), pa.array(upper), pa.array(np.full(len(q), part, np.int32))]
                        if len(q):
                            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in BOUNDS.split(", ")])

    return scan


class _Bounds:
    """Bounds of some queries' scores from cells, and each query's k best lower bounds so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int):
        self.rows, self.ids = rows, ids
        self.lo, self.width = lo, _width(lo, hi)
        self.signed, self.size = queries.astype(np.float64), np.abs(queries).astype(np.float64)
        # Above 2**52 a double isn't exact; bounds then get a margin.
        most = float(self.size.sum(1).max(initial=0)) * float(max(np.abs(lo).max(), np.abs(hi).max()))
        self.margin = most * 1e-12 if most > 2**52 else 0.0
        self.best = np.full((len(ids), k), -np.inf)

    def add(self, ids: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, ...]:
        """Query numbers, row numbers, lower and upper bounds of the rows that may be among a query's k best."""
        half = (self.width - 1) / 2
        middle = self.signed @ (self.lo + cells.astype(np.int64) * self.width + half).T
        spread = (self.size @ half + self.margin)[:, None]
        middle[self.ids[:, None] == ids[None, :]] = -np.inf
        lower = middle - spread
        k = self.best.shape[1]
        some = np.partition(lower, lower.shape[1] - k, axis=1)[:, -k:] if lower.shape[1] > k else lower
        both = np.concatenate([self.best, some], 1)
        self.best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        q, c = np.nonzero((middle + spread >= self.best.min(1)[:, None]) & (middle > -np.inf))
        own = spread[q, 0]
        return q, c, middle[q, c] - own, middle[q, c] + own
