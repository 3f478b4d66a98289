"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, whole

#: A chunk ends at the first of these pairs of characters after MIN_CHUNK, so cuts follow the content and not the offset.
MIN_CHUNK, MAX_CHUNK = 400, 4000
BOUNDARY = r"[aeiou][stnr]|[b-d][aeiou]|[0-9][5-9]|[^\x00-\x7F]{2}"
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:{BOUNDARY}|\z)|.{{1,{MAX_CHUNK}}}"
SPACE = r"[\x20\x09-\x0D]+"


def chunk_key(chunk: Column) -> Column:
    """128 bits of a chunk: two hashes with different seeds."""
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit("second"), chunk).alias("b"))


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(whole(text), SPACE, "")


def chunks(text: Column) -> Column:
    """The content-defined pieces of a text in order; they join to the text again."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def clashing_keys(docs: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """Chunk keys that stand for more than one chunk text. Every chunk text is moved at most once per task that has it."""
    pieces = docs.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
    distinct = pieces.select(key(F.col("chunk")).alias("k"), "chunk").groupBy("k", "chunk").agg(F.lit(1).alias("one"))
    return distinct.groupBy("k").agg(F.count("*").alias("texts")).filter("texts > 1").select("k")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[Column], Column] = chunk_key) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space (``[\\x20\\x09-\\x0D]``) is deleted. Each text is cut into
    content-defined chunks; chunk texts are deduplicated and their 128-bit keys verified to stand for one text each. A
    document is then compared as the ordered list of its chunk identifiers, and its text isn't moved again. Where a key
    clashes (as a weak ``key`` does), the text of a chunk under that key goes with it, and only documents that have such a
    chunk are met with the clashing keys.

    Of equal texts the row with most code points in the original stays, then the smallest id; a null id comes after all
    others, and of rows repeated with the same id and text the first in the table stays. Null text counts as empty; all
    empty texts are one group. An empty table gives no rows; other columns aren't read. ``docs`` must read the same way
    twice, as a stored table does.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    base = base.select("row", "doc_id", F.char_length("text").alias("points"), normalised("text").alias("norm"))
    clashes = saved(clashing_keys(base, key), "clashing-keys")
    identifier = key
    if not clashes.isEmpty():
        held = base.select("row", F.explode(chunks(F.col("norm"))).alias("chunk")).select("row", key(F.col("chunk")).alias("k"))
        base = base.join(saved(held.join(clashes, "k").groupBy("row").agg(F.collect_set("k").alias("clash")), "clashing-rows"), "row", "left")
        identifier = lambda c: F.struct(key(c).alias("k"), F.when(F.array_contains("clash", key(c)), c).alias("chunk"))
    recipes = base.select("row", "doc_id", "points", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), identifier).alias("recipe"))
    recipes = saved(recipes, "recipes")
    # Larger is better: code points, then an id at all, then the smaller id, then the earlier row.
    rank = F.struct("points", F.col("doc_id").isNotNull().alias("has"), F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row"))
    groups = recipes.groupBy("recipe").agg(F.max(rank).alias("best"), F.count("*").alias("group_size"))
    groups = saved(groups, "groups")  # read again, so that the join below deals out both sides and can split a hot group
    return recipes.join(groups, "recipe").select(
        "doc_id",
        F.bitwise_not("best.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.bitwise_not("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )
