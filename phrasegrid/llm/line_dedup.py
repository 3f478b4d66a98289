"""Cross-site line deduplication: distinct-site spread by sketches, exact near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, whole

#: A line on at least this many sites, in as many different texts, is boilerplate.
MIN_SITES = 10
#: Shorter lines ("Yes.", "Chapter 2") repeat by chance and are left alone.
MIN_CHARS = 20
#: Registers of a sketch, as a power of two: 1.6 % standard error.
LG_REGISTERS = 12
#: Relative distance from the threshold within which the sketch isn't trusted: over ten standard errors.
MARGIN = 0.2
#: Parts that the rows of a line are dealt to which has over 1/HOT of all: one line may stand on a third of all pages.
SALTS, HOT = 64, 1000

SPACE = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(line, F.lit(SPACE))))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _long(line: Column, min_chars: int) -> Column:
    return F.char_length(F.btrim(line, F.lit(SPACE))) >= min_chars


def _met(lines: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """The rows of ``lines`` (key, ...) whose key is one of ``keys`` (key, n), each distinct.

    A key that has over 1/HOT of all that ``n`` counts is hot; there are fewer than HOT such keys, whatever the size, so they
    are broadcast. Rows of hot keys are dealt out by the column ``by``, and the key is there for each part. The plan is the
    same at every size: one join, which Spark does as it sees fit.
    """
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * HOT > F.lit(total)
    marks = keys.filter(is_hot).select("key", F.lit(True).alias("hot"))
    salts = F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    dealt = keys.select("key", F.explode(salts).alias("salt"))
    marked = lines.join(F.broadcast(marks), "key", "left")
    marked = marked.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(by), F.lit(SALTS).cast("long"))).otherwise(F.lit(0).cast("long"))).drop("hot")
    return marked.join(dealt, ["key", "salt"])


def spread_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, site_col: str = "source", text_col: str = "text", uncounted: DataFrame | None = None
) -> DataFrame:
    """(key, n): the lines that stand on at least ``min_sites`` distinct sites and in as many distinct texts, and how often.

    HyperLogLog sketches of the sites and of the texts per line key merge by aggregation, in every task first. Lines whose
    estimates are both clearly over the threshold are in, those with one clearly under it are out; the others are counted
    exactly. A null site is no site, and its texts don't count. Nor do the rows of ``uncounted`` (row: their places in
    ``docs``, by ``monotonically_increasing_id``). Lines are cut once, into a table of their keys.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(site_col).cast("string").alias("site"), F.col(text_col).alias("text"))
    rows = rows.select("row", "site", F.xxhash64(whole("text")).alias("page"), F.explode(_lines(whole("text"))).alias("line"))
    rows = rows.filter(_long(F.col("line"), min_chars) & F.col("site").isNotNull()).select("row", _key(F.col("line")).alias("key"), "site", "page")
    rows = rows if uncounted is None else rows.join(uncounted, "row", "left_anti")
    lines = saved(rows.select("key", "site", "page"), "lines")
    # Sketches are built only of keys that occur often enough; the count costs less than a sketch.
    often = saved(lines.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites), "often-lines")
    sketches = _met(lines, often, "site").groupBy("key", "salt").agg(F.hll_sketch_agg("site", LG_REGISTERS).alias("site"), F.hll_sketch_agg("page", LG_REGISTERS).alias("page"))
    sketches = saved(sketches, "sketches")
    merged = sketches.groupBy("key").agg(*(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("site", "page")))
    merged = saved(merged.select("key", F.least("site", "page").alias("least")).join(often, "key"), "line-sites")
    sure = merged.filter(F.col("least") > min_sites * (1 + MARGIN)).select("key", "n")
    near = saved(merged.filter(F.col("least").between(min_sites * (1 - MARGIN), min_sites * (1 + MARGIN))).select("key", "n"), "near-lines")
    exact = _met(lines, near, "site").groupBy("key").agg(F.countDistinct("site").alias("site"), F.countDistinct("page").alias("page"))
    exact = saved(exact.filter((F.col("site") >= min_sites) & (F.col("page") >= min_sites)).select("key").join(near, "key"), "exact-lines")
    out = saved(sure.unionByName(exact.select("key", "n")), "boilerplate")
    discard(lines, often, sketches, merged, near, exact)
    return out


def dedup_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, site_col: str = "source", text_col: str = "text", uncounted: DataFrame | None = None
) -> DataFrame:
    """``docs`` with boilerplate lines out of ``text_col``, and a column more: lines_removed.

    A line's key is the line without ASCII white space at its ends; lines under ``min_chars`` characters are never
    boilerplate. Boilerplate stands on ``min_sites`` sites in as many different texts, and goes from every document,
    whatever its share of it. The same text on many sites spreads nothing: exact copies of a page keep their lines. Near
    copies are different texts; ``uncounted`` may name their rows (row: the place in ``docs``), and sites and texts are
    counted without them.

    Null text stays null; empty texts and texts without line feeds are one line; a null site counts toward no spread, but
    its lines are cleaned. Repeated rows are cleaned alike. A column named lines_removed is replaced, others are kept,
    whatever their names. An empty table gives no rows. ``docs`` must read the same way twice.
    """
    keys = spread_lines(docs, min_sites, min_chars, site_col, text_col, uncounted)
    # The whole row is one column beside the operator's own, so no name can clash.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(text_col).alias("text"))
    lines = rows.select("row", F.posexplode(_lines(whole("text"))).alias("at", "line")).filter(_long(F.col("line"), min_chars))
    hits = _met(lines.select("row", "at", _key(F.col("line")).alias("key")), keys, "row").groupBy("row").agg(F.collect_list("at").alias("gone"))
    hits = saved(hits, "line-hits")
    discard(keys)
    # The texts move once, at every size, and both sides can spill.
    joined = rows.join(hits.hint("merge"), "row", "left")
    parts = _lines(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone")
    kept = F.transform(F.array(parts), lambda p: F.array_join(F.transform(left, lambda i: p[i]), "\n"))[0]
    joined = joined.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    others = [F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns if c != "lines_removed"]
    return joined.select(*others, removed.alias("lines_removed"))
