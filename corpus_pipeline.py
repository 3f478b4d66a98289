"""A corpus from raw documents to training sequences: reject, clean, deduplicate, pack.

Each stage takes the documents that the one before kept and returns those it keeps, with the same columns; the last one
returns sequences. Only the packing of tokens can't be said in SQL, nor the network's scores, so there is no ORACLE_SQL;
the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasegrid.llm.common import saved, table
from phrasegrid.llm.line_dedup import dedup_lines
from phrasegrid.llm.near_dedup import near_duplicates
from phrasegrid.llm.packing import pack
from phrasegrid.llm.queries import tokenizer_path
from phrasegrid.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, trained on ``labels``, doesn't reject."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on many sites; n_chars follows the text. None is dropped.

    Sites and texts are counted over one document of each group of near-duplicates, so that the lines of copies aren't
    boilerplate for being copied; lines that are go from every document, whatever their share of it.
    """
    clean = dedup_lines(docs, uncounted=_later_copies(docs))
    n_chars = F.when(F.col("lines_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(*docs.columns)


def _later_copies(docs: DataFrame) -> DataFrame:
    """The places (row) of all but the first document of each group of near-duplicates, written once."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "text")
    return saved(near_duplicates(rows, id_col="row").filter("not kept").select(F.col("doc_id").alias("row")), "later-copies")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the first in the table; null, empty and wordless texts have none and stay.

    Rows are told apart by their place, so documents without an id and those that share one are judged like others.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    return rows.join(_later_copies(docs).hint("merge"), "row", "left_anti").select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens packed into sequences of at most 4096."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
