"""Token counts of the documents in flat token files, found by their separators alone."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import load_ranks, shared_encoder
from .common import saved, shared_dir, text_slices

#: Bytes of a block, about.
BLOCK = 1 << 17
#: Blocks that one window of the prefix scan holds, where they come without splits.
RUN = 4096

#: ``split`` and ``block`` order the blocks of a file; ``ended`` marks a byte that may stand beyond the file's end.
BLOCKS = "file string, split long, block long, data binary, ended boolean, size long"


def _marker(eod: int, width: int) -> int:
    """A byte that occurs in no ``eod``: files can be cut after it without cutting one. High ones are rare, as common ids are
    small: about one id in 256 has it."""
    own = eod.to_bytes(width, "little")
    return next(b for b in range(255, 0, -1) if b not in own)


def read_flat(spark: SparkSession, path: str, eod: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Blocks of the flat token files at ``path``, read by byte ranges through Spark, whatever the files' sizes.

    Spark's line reader cuts ranges where a byte ends that no ``eod`` has, and the lines are laid end to end again. A range
    starts anywhere in an id, so blocks do; only 2 GB without that byte are too long for it.
    """
    marker = _marker(eod, width)
    lines = spark.read.option("lineSep", chr(marker)).option("encoding", "ISO-8859-1").option("recursiveFileLookup", True).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(data: bytes, ended: bool = False) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*at[:2], k, data, ended, at[2]), kinds, strict=True)], NAMES)

        def last() -> Iterator[pa.RecordBatch]:
            nonlocal k
            yield out(data[:-1])
            k += 1
            yield out(data[-1:], True)

        at, data, k = None, b"", 0
        for b in batches:
            for own, lines in _by_split(b):
                if own != at:
                    if at is not None:
                        yield from last()
                    at, data, k = own, b"", 0
                for some in _groups(lines, block):
                    if len(data) >= block:
                        yield out(data)
                        data, k = b"", k + 1
                    data += _rejoined(some, marker)
        if at is not None:
            yield from last()

    return lines.mapInArrow(join, BLOCKS)


NAMES = [f.split()[0] for f in BLOCKS.split(", ")]


def _by_split(b: pa.RecordBatch) -> Iterator[tuple[tuple, pa.Array]]:
    """Runs of lines of one range of a file: (file, split, size) and the lines."""
    files, splits, sizes, lines = b.columns
    change = np.flatnonzero(np.diff(splits.to_numpy()) != 0) + 1
    if len(set(files.unique().to_pylist())) > 1:
        codes = files.dictionary_encode().indices.to_numpy()
        change = np.union1d(change, np.flatnonzero(np.diff(codes) != 0) + 1)
    for lo, hi in zip([0, *change.tolist()], [*change.tolist(), b.num_rows], strict=True):
        if hi > lo:
            yield (files[lo].as_py(), splits[lo].as_py(), sizes[lo].as_py()), lines.slice(lo, hi - lo)


def _groups(lines: pa.Array, block: int) -> Iterator[pa.Array]:
    """Lines in runs of about ``block`` bytes, one line at least."""
    ends = np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(lines):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + block, "right")))
        yield lines.slice(lo, hi - lo)
        lo = hi


def _rejoined(lines: pa.Array, marker: int) -> bytes:
    """Lines laid end to end, each with the byte that ended it."""
    ends = np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    out = np.empty(int(ends[-1]), np.uint8)
    is_end = np.zeros(len(out), bool)
    is_end[ends - 1] = True
    out[is_end] = marker
    out[~is_end] = np.frombuffer(b"".join(lines.to_pylist()), np.uint8)
    return out.tobytes()


def write_flat(docs: DataFrame, folder: str, path: str, pattern: str, eod: int, text_col: str = "text") -> int:
    """Writes the table as flat token files, one per partition: each text's ids and ``eod``, nothing else; the bytes of an id.

    An id takes two bytes if all fit, else four. The n-th document of partition p is the n-th of the file part-p.
    """
    encoder = shared_encoder(docs, path, pattern)
    width = 2 if max(eod, *load_ranks(path).values()) < 1 << 16 else 4

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            for lo, hi in text_slices(texts, 1_000_000):
                yield pa.RecordBatch.from_arrays([pa.array([np.array(ids, f"<u{width}").tobytes() for ids in e.encode_all(texts[lo:hi])], pa.binary())], ["ids"])

    # The separator is what Spark's writer ends its lines with, byte for byte.
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(work, "ids binary").select(F.col("ids").cast("string").alias("value"))
    separator = eod.to_bytes(width, "little").decode("iso-8859-1")
    rows.write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", 0).text(folder)
    return width


def _scan(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds, from the rows before in a key's order: separators (eods_in), tokens since the last (carry), whether any (seen)."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("part", F.sum((F.col("eods") > 0).cast("long")).over(w))
    df = df.withColumn("run", F.sum("tail").over(Window.partitionBy(*keys, "part").orderBy(order)))
    return df.withColumns(
        {
            "eods_in": F.sum("eods").over(w) - F.col("eods"),
            "carry": F.coalesce(F.lag("run").over(w), F.lit(0)),
            "seen": F.coalesce(F.lag("part").over(w) > 0, F.lit(False)),
        }
    )


def count_tokens(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """(file, position, n_tokens, complete): tokens of each document of each file, the separator not counted.

    Each block is searched for ``eod`` by vectorised comparisons, one for each place in an id at which it may start, as that
    isn't known yet; each gives the lengths between separators, what stands before the first and after the last. A prefix
    scan over those summaries (of the blocks of a split, then of the splits) finds the blocks' places in the file and so the
    comparison that counts, numbers the documents and hands each block the bytes that earlier blocks have left open. The
    tokens after a file's last separator are a document with ``complete`` false; there is none if nothing stands there.

    ``blocks`` are those of :func:`read_flat`, or have columns file, block, data (little-endian ids of ``width`` bytes, cut
    anywhere but inside an ``eod``). Separators side by side bound empty documents; null or empty data is an empty block;
    files without rows have no documents; a null file is a file; rows that repeat a block, and files that aren't a whole
    number of ids, are an error of the caller: the latter are refused.
    """
    if "split" not in blocks.columns:
        blocks = blocks.withColumns({"split": F.floor(F.col("block") / RUN), "ended": F.lit(False), "size": F.lit(None).cast("long")})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(f"<u{width}")
        i64 = pa.int64()
        for b in batches:
            sizes, phases = [], [[] for _ in range(width)]
            for data in b.column(3):
                raw = data.as_py() or b""
                sizes.append(len(raw))
                for phase in range(width):
                    skip = min(len(raw), -phase % width)
                    at = np.flatnonzero(np.frombuffer(raw, kind, (len(raw) - skip) // width, skip) == eod) * width + skip
                    head, tail = (int(at[0]), len(raw) - int(at[-1]) - width) if len(at) else (len(raw),) * 2
                    phases[phase].append({"eods": len(at), "head": head, "tail": tail, "inner": (np.diff(at) // width - 1).tolist()})
            found = pa.struct([("eods", i64), ("head", i64), ("tail", i64), ("inner", pa.list_(i64))])
            columns = [*b.columns[:3], b.column(4), b.column(5), pa.array(sizes, i64), pa.array([list(x) for x in zip(*phases, strict=True)], pa.list_(found))]
            yield pa.RecordBatch.from_arrays(columns, ["file", "split", "block", "ended", "size", "n", "phases"])

    found = blocks.select("file", F.col("split").cast("long"), F.col("block").cast("long"), "data", "ended", "size")
    found = found.mapInArrow(search, "file string, split long, block long, ended boolean, size long, n long, phases array<struct<eods:long,head:long,tail:long,inner:array<long>>>")
    found = saved(found, "block-summaries")  # the files are read once; the summaries are needed several times
    found = _aligned(_bounded(found), width)
    scanned = _scan(found, ["file", "split"], "block")
    last = F.max(F.struct("block", F.col("run"))).alias("last")
    runs = scanned.groupBy("file", "split").agg(F.sum("eods").alias("eods"), last).select("file", "split", "eods", F.col("last.run").alias("tail"))
    runs = _scan(runs, ["file"], "split").select(F.col("file").alias("f"), F.col("split").alias("s"), F.col("eods_in").alias("eods_up"), F.col("carry").alias("carry_up"), F.col("eods").alias("eods_run"), F.col("tail").alias("tail_run"))
    full = scanned.join(runs, F.col("file").eqNullSafe(F.col("f")) & (F.col("split") == F.col("s")))
    carry = F.col("carry") + F.when(F.col("seen"), 0).otherwise(F.col("carry_up"))
    lengths = F.concat(F.array(F.floor((carry + F.col("head")) / width)), "inner")
    done = full.filter("eods > 0").select("file", (F.col("eods_up") + F.col("eods_in")).alias("first"), F.posexplode(lengths).alias("nth", "n_tokens"))
    done = done.select("file", (F.col("first") + F.col("nth")).alias("position"), "n_tokens", F.lit(True).alias("complete"))
    ends = runs.groupBy("f").agg(F.max(F.struct("s", "eods_up", "eods_run", "carry_up", "tail_run")).alias("e")).select(F.col("f").alias("file"), "e.*")
    left = F.col("tail_run") + F.when(F.col("eods_run") > 0, 0).otherwise(F.col("carry_up"))
    left = F.when(left % width == 0, left / width).otherwise(F.raise_error(F.concat(F.lit("not a whole number of ids: "), F.coalesce("file", F.lit("")))))
    rest = ends.select("file", (F.col("eods_up") + F.col("eods_run")).alias("position"), left.cast("long").alias("n_tokens"), F.lit(False).alias("complete")).filter("n_tokens > 0")
    return done.unionByName(rest)


def _bounded(found: DataFrame) -> DataFrame:
    """Summaries without the byte after a file that doesn't end in the byte it is cut at."""
    ends = found.groupBy("file").agg(F.sum("n").alias("total"), F.max("size").alias("whole"), F.max("split").alias("last_split"))
    ends = ends.select(F.col("file").alias("f"), "last_split", (F.col("total") - F.coalesce("whole", "total")).alias("over"))
    rows = found.join(ends, F.col("file").eqNullSafe(F.col("f")))
    over = F.when(F.col("over").between(0, 1), F.col("over")).otherwise(F.raise_error(F.concat(F.lit("the ranges don't make up the file "), F.col("file"))))
    return rows.filter(~(F.col("ended") & (F.col("split") == F.col("last_split")) & (over == 1))).drop("f", "last_split", "over", "size", "ended")


def _aligned(found: DataFrame, width: int) -> DataFrame:
    """Summaries of the comparison that starts where ids do: by the bytes before, in the split and in the splits before."""
    own = F.sum("n").over(Window.partitionBy("file", "split").orderBy("block")) - F.col("n")
    splits = found.groupBy("file", "split").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.partitionBy("file").orderBy("split")) - F.col("total")
    splits = splits.select(F.col("file").alias("f"), F.col("split").alias("s"), before.alias("before"))
    rows = found.withColumn("own", own).join(splits, F.col("file").eqNullSafe(F.col("f")) & (F.col("split") == F.col("s")))
    phase = F.element_at("phases", ((F.col("own") + F.col("before")) % width + 1).cast("int"))
    return rows.select("file", "split", "block", phase.alias("p")).select("file", "split", "block", "p.*")


def document_token_counts(docs: DataFrame, path: str, pattern: str, eod: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, file, position, n_tokens): the table written as flat token files (:func:`write_flat`), which are then read by
    byte ranges and counted by :func:`count_tokens`; ``file`` is the number of the file.

    Null or empty text has 0 tokens; null ids stay null; repeated rows give a row each; an empty table gives no rows.
    ``docs`` must read the same way twice, as a stored table does; a row that the files don't have is an error.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    width = write_flat(docs, folder, path, pattern, eod, text_col)
    counts = count_tokens(read_flat(spark, folder, eod, width), eod, width)
    counts = counts.select(F.regexp_extract("file", r"part-(\d+)", 1).cast("long").alias("file"), "position", "n_tokens")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("doc_id", F.shiftright("row", 33).alias("file"), F.col("row").bitwiseAND((1 << 33) - 1).alias("position"))
    return _whole(rows.join(counts, ["file", "position"], "left"))


def _whole(rows: DataFrame) -> DataFrame:
    """The rows with their counts, or an error if one has none."""
    lost = F.raise_error(F.concat(F.lit("no tokens in the files for row "), F.col("position").cast("string"), F.lit(" of file "), F.col("file").cast("string")))
    return rows.select("doc_id", F.col("file").cast("string").alias("file"), "position", F.coalesce("n_tokens", lost.cast("long")).alias("n_tokens"))
