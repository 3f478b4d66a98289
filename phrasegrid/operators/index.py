"""The positional index: documents to tables of lines with their tokens, positions, words, postings, brackets and links."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import text as T
from . import links as L
from .dictionary import gram_rows
from .rank import placed
from .store import children, present, read_text, remove, stored, write_text

#: Tables of a stored run.
TABLES = ("lines", "positions", "postings", "words", "grams", "links", "pairs", "docs")


@dataclass(frozen=True)
class Index:
    """Tables of an indexed corpus.

    docs: path, search_mode, doc_id, doc_hash, title and what else the documents have (format, mod_time, last_used);
    lines: doc_id, line, start_pos, end_pos, page, line_in_page, nonspace, tokens; positions: doc_id, pos, line, word;
    words: word, word_ci, word_len; links: doc_id, start_pos, end_pos, typ, link; pairs: doc_id, open_pos, close_pos of
    matching brackets; only of a stored index grams: keys of the words, and held: word, doc_id, each once. Everything but docs
    is made from lines, the one table that texts are tokenized for. ``doc_id`` numbers contents: equal contents share one.
    """

    docs: DataFrame
    positions: DataFrame
    lines: DataFrame
    words: DataFrame
    links: DataFrame
    pairs: DataFrame | None = None
    grams: DataFrame | None = None
    held: DataFrame | None = None

    @staticmethod
    def of(docs: DataFrame, lines: DataFrame) -> Index:
        marked = lines.filter(F.exists("tokens", lambda w: w.isin(*BRACKETS)))
        return Index(docs, position_rows(lines), lines, word_rows(lines), L.link_rows(lines), bracket_pairs(position_rows(marked)))

    def write(self, path: str, mode: str = "overwrite") -> None:
        """Stores the index at ``path``, in place of one that is there or (``append``) as one more run of it.

        Lines are written first and the rest is made from them as stored, so texts are read and tokenized once; what doesn't
        wait for anything else is written at the same time. Positions are sorted by word across files and words by lower
        case, so that a look-up reads the pages of the files that have its words; a word with many places is spread over
        files by document. A run counts once a new manifest names it (see :class:`Manifest`).
        """
        spark = self.docs.sparkSession
        before = Manifest.read(spark, path)
        keep = before if mode == "append" else replace(before, runs=(), tombstones=())
        run = Run(uuid.uuid4().hex, 0)
        top = self._store(path, run.name, Index.read(spark, path).words if keep.runs else None)
        replace(keep, runs=(*keep.runs, run), next_id=max(before.next_id, top + 1)).commit(spark, path)
        compact(spark, path)

    def _store(self, path: str, name: str, known: DataFrame | None = None) -> int:
        """Writes a run's tables, words but for the ``known`` ones; returns the largest doc_id."""
        spark = self.docs.sparkSession
        at = lambda table: f"{path}/{table}/batch={name}"
        self.lines.write.parquet(at("lines"))
        lines = spark.read.schema(self.lines.schema).parquet(at("lines"))
        derived = Index.of(self.docs, lines)
        words = derived.words if known is None else derived.words.join(known.select("word"), "word", "left_anti")
        words = stored(words, "new-words")
        jobs = {
            "positions": sorted_positions(derived.positions),
            "postings": sorted_postings(lines),
            "words": words.repartitionByRange("word_ci", "word").sortWithinPartitions("word_ci", "word"),
            "grams": gram_rows(words).repartitionByRange("gram", "at").sortWithinPartitions("gram", "at"),
            "links": derived.links, "pairs": derived.pairs, "docs": self.docs,
        }
        in_parallel(spark, *(lambda df=df, table=table: df.write.parquet(at(table)) for table, df in jobs.items()))
        return spark.read.parquet(at("docs")).agg(F.coalesce(F.max(F.col("doc_id").cast("long")), F.lit(0))).first()[0]

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        """The runs at ``path`` that its manifest names, without documents that have been pruned."""
        manifest = Manifest.read(spark, path)
        if not manifest.runs:
            raise ValueError(f"no index at {path}")
        return manifest.index(spark, path, manifest.runs)

    def postings(self) -> DataFrame:
        return self.positions.select("word", "doc_id").distinct() if self.held is None else self.held

    def pages(self) -> DataFrame:
        return self.lines.groupBy("doc_id", "page").agg(F.count("*").alias("line_count"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))

    def doc_info(self) -> DataFrame:
        return self.lines.groupBy("doc_id").agg(F.countDistinct("page").alias("page_count"), F.count("*").alias("line_count"), F.max("end_pos").alias("max_pos"))

    def line_text(self) -> DataFrame:
        """Lines put together from their tokens again."""
        return self.lines.select("doc_id", "line", F.array_join("tokens", "").alias("line_text"))

    def brackets(self) -> DataFrame:
        return bracket_pairs(self.positions) if self.pairs is None else self.pairs

    def words_between(self, doc_id: Column | int, lo: int, hi: int) -> DataFrame:
        near = self.lines.filter((F.col("doc_id") == doc_id) & (F.col("start_pos") <= hi) & (F.col("end_pos") >= lo))
        return position_rows(near).filter(F.col("pos").between(lo, hi))

    def locations(self, at: DataFrame) -> DataFrame:
        """``at`` (doc_id, pos) with line, pos_in_line, page and line_in_page."""
        own = self.lines.select(F.col("doc_id").alias("d"), "line", "start_pos", "end_pos", "page", "line_in_page")
        rows = at.join(own, (F.col("doc_id") == F.col("d")) & F.col("pos").between(F.col("start_pos"), F.col("end_pos")))
        return rows.withColumn("pos_in_line", F.col("pos") - F.col("start_pos")).drop("d", "start_pos", "end_pos")

    def word_frequency(self, top: int | None = None) -> DataFrame:
        counts = self.positions.filter("word != ''").groupBy(T.ascii_lower(F.col("word")).alias("word_ci")).agg(F.count("*").alias("n"))
        return counts if top is None else counts.orderBy(F.desc("n"), "word_ci").limit(top)


#: Runs of a level that are merged into one of the next.
FANOUT = 8


@dataclass(frozen=True)
class Run:
    """Tables written together; ``level`` grows as runs are merged."""

    name: str
    level: int


@dataclass(frozen=True)
class Manifest:
    """What a stored index consists of: runs in the order they came, tables of pruned documents, the next free doc_id.

    Each change is a new file with the next number, and the last one holds; folders that it doesn't name are what an
    interrupted or replaced write has left, and go with the next change. One writer at a time.
    """

    version: int = 0
    runs: tuple[Run, ...] = ()
    tombstones: tuple[str, ...] = ()
    next_id: int = 1

    @staticmethod
    def read(spark: SparkSession, path: str) -> Manifest:
        versions = [int(n.removesuffix(".json")) for n in children(spark, f"{path}/manifest") if n.removesuffix(".json").isdigit()]
        if not versions:
            return Manifest()
        found = json.loads(read_text(spark, f"{path}/manifest/{max(versions)}.json"))
        return Manifest(max(versions), tuple(Run(**r) for r in found["runs"]), tuple(found["tombstones"]), found["next_id"])

    def commit(self, spark: SparkSession, path: str) -> Manifest:
        new = replace(self, version=self.version + 1)
        text = json.dumps({"runs": [{"name": r.name, "level": r.level} for r in new.runs], "tombstones": new.tombstones, "next_id": new.next_id})
        write_text(spark, f"{path}/manifest/{new.version}.json", text)
        for old in children(spark, f"{path}/manifest"):
            if old != f"{new.version}.json":
                remove(spark, f"{path}/manifest/{old}")
        names = {t: {r.name for r in new.runs} for t in TABLES} | {"tombstones": set(new.tombstones)}
        for table, own in names.items():
            for folder in children(spark, f"{path}/{table}"):
                if folder.removeprefix("batch=") not in own:
                    remove(spark, f"{path}/{table}/{folder}")
        return new

    def dead(self, spark: SparkSession, path: str) -> DataFrame | None:
        """doc_ids that have been pruned."""
        return spark.read.parquet(*(f"{path}/tombstones/batch={t}" for t in self.tombstones)).select("doc_id").distinct() if self.tombstones else None

    def index(self, spark: SparkSession, path: str, runs: tuple[Run, ...]) -> Index:
        table = lambda name: spark.read.parquet(*(f"{path}/{name}/batch={r.name}" for r in runs))
        dead = self.dead(spark, path)
        live = lambda name: table(name) if dead is None else table(name).join(dead, "doc_id", "left_anti")
        return Index(live("docs"), live("positions"), live("lines"), table("words"), live("links"), live("pairs"), table("grams"), live("postings"))


def committed(spark: SparkSession, path: str) -> list[str]:
    """Runs of a stored index, by name."""
    return sorted(r.name for r in Manifest.read(spark, path).runs)


def compact(spark: SparkSession, path: str) -> None:
    """Merges FANOUT runs of a level into one of the next, the lowest level first, until no level has as many. Documents that
    have been pruned are left out; once no run is older than a tombstone table, that goes, too. So a row is rewritten once
    a level, and the number of runs grows with the logarithm of the number of appends."""
    while True:
        manifest = Manifest.read(spark, path)
        by_level: dict[int, list[Run]] = {}
        for r in manifest.runs:
            by_level.setdefault(r.level, []).append(r)
        full = next((sorted_ for _, sorted_ in sorted(by_level.items()) if len(sorted_) >= FANOUT), None)
        if full is None:
            return
        merge(spark, path, tuple(full))


def merge(spark: SparkSession, path: str, runs: tuple[Run, ...]) -> None:
    """Writes some runs as one, without pruned documents, and names it in their place."""
    manifest = Manifest.read(spark, path)
    merged = Run(uuid.uuid4().hex, max(r.level for r in runs) + 1)
    whole = manifest.index(spark, path, runs)
    others = tuple(r for r in manifest.runs if r not in runs)
    known = manifest.index(spark, path, others).words if others else None
    whole._store(path, merged.name, known)
    # All rows are new: nothing is left that a tombstone could hide.
    tombstones = manifest.tombstones if others else ()
    replace(manifest, runs=(*others, merged), tombstones=tombstones).commit(spark, path)


def bury(spark: SparkSession, path: str, gone: DataFrame) -> None:
    """Prunes documents (doc_id) from the index at ``path`` by writing their ids; nothing else is rewritten, but for the ids
    pruned before once they are in FANOUT tables."""
    manifest = Manifest.read(spark, path)
    name, ids = uuid.uuid4().hex, gone.select(F.col("doc_id").cast("long").alias("doc_id"))
    together = len(manifest.tombstones) >= FANOUT
    ids = ids.unionByName(manifest.dead(spark, path)) if together else ids
    ids.distinct().write.parquet(f"{path}/tombstones/batch={name}")
    replace(manifest, tombstones=(*(() if together else manifest.tombstones), name)).commit(spark, path)


def prune_stored(spark: SparkSession, path: str, keep: int) -> None:
    """Prunes the least recently used contents (see :func:`touch`) of the index at ``path`` beyond ``keep``."""
    docs = Index.read(spark, path).docs.select("doc_id", "doc_hash").distinct()
    used = docs.join(last_used(spark, path), "doc_hash", "left").groupBy("doc_id").agg(F.max("last_used").alias("last_used"))
    bury(spark, path, least_recently_used(used, keep))


def in_parallel(spark: SparkSession, *jobs: Callable[[], None]) -> None:
    """Runs Spark jobs that don't wait for each other; the first error is raised once all have ended."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        done = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    for d in done:
        d.result()


def sorted_positions(positions: DataFrame) -> DataFrame:
    """Positions in files by ranges of words, sorted by word, document and place; a word with many places fills several."""
    order = ["word", "doc_id", "pos"]
    return positions.repartitionByRange(*order).sortWithinPartitions(*order)


def sorted_postings(lines: DataFrame) -> DataFrame:
    """(word, doc_id), each once, in files by ranges of words, sorted. Equal rows meet in the exchange that sorts them."""
    order = ["word", "doc_id"]
    rows = lines.select(F.explode(F.array_distinct("tokens")).alias("word"), "doc_id")
    return rows.repartitionByRange(*order).dropDuplicates(order).sortWithinPartitions(*order)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 512)


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paged: bool | Column = False, listed: bool = False) -> DataFrame:
    """(doc_id, line, start_pos, end_pos, page, line_in_page, nonspace, tokens): lines in order, without a shuffle or a window.

    Each line is tokenized once. Positions run through the document: its lines' tokens are laid end to end, and the place of
    each line's first one is its start. A line without tokens has one empty word; a text without lines is one such line.
    Where ``paged``, pages are parted by form feeds. A task tokenizes about :data:`BYTES_AT_ONCE` of texts at a time, or one
    longer text. With ``listed``, the first line of each such lot has the lot's distinct words in a column of that name, and
    others have null: :func:`listed_words` makes the dictionary of these, without a look at the tokens.
    """
    return _tokenized(docs, id_col, text_col, paged, f"{LINE}, {LISTED}" if listed else LINE)


def document_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word, n, end_pos): each row's distinct words, how often it has them, and its last position, without a shuffle."""
    return _tokenized(docs, id_col, text_col, False, WORD)


def _tokenized(docs: DataFrame, id_col: str, text_col: str, paged: bool | Column, kind: str) -> DataFrame:
    # Bytes that aren't text become what stands for them, as columns have it, and that a space. The last byte is a mark.
    text = F.replace(F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit(""))), F.lit("\ufffd"), F.lit(" "))
    flag = F.lit(paged) if isinstance(paged, bool) else F.coalesce(paged, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.concat(text, F.lit("\0")).cast("binary").alias("text"), flag.alias("paged"))
    fields = [StructField("doc_id", rows.schema["doc_id"].dataType), *StructType.fromDDL(kind)]
    return rows.mapInArrow(_line_batches(kind), StructType(fields))


LINE = "line int, start_pos int, end_pos int, page int, line_in_page int, nonspace long, tokens array<string>"
LISTED = "listed array<string>"
WORD = "word string, n int, end_pos int"
BYTES_AT_ONCE = 4 << 20


def _line_batches(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes rows of a kind of batches of (doc_id, text, paged), by columns of bytes; workers needn't have this package.

    Tokens are cut as :data:`T.TOKEN` says: where the class of a byte changes, and at every character of no class.
    """
    at_once, longest = BYTES_AT_ONCE, T.LONGEST
    names = ["doc_id", *(c.split()[0] for c in kind.split(", "))]
    by_word, listed = kind == WORD, kind.endswith(LISTED)
    # Classes: 1 letters and digits, 2 blanks. Control characters are blanks.
    kinds, clean = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    clean[:32] = clean[127] = 32
    kinds[np.frombuffer((T.UPPER + T.LOWER + "0123456789").encode(), np.uint8)], kinds[32] = 1, 2
    blanks = np.array([int.from_bytes(c.encode()) for c in T.BLANKS if c != " "])

    def cuts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where tokens begin; one does at each of ``firsts``."""
        kind, lead = kinds[data], (data & 0xC0) != 0x80
        at = np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
        code = (data[at].astype(np.int64) << 16) + (data[at + 1].astype(np.int64) << 8) + data[at + 2]
        at = at[np.isin(code, blanks)]
        for k in range(3):
            kind[at + k] = 2
        begins = lead & (kind == 0)
        begins[1:] |= lead[1:] & (kind[1:] != kind[:-1])
        begins[firsts] = True
        starts = np.flatnonzero(begins)
        long = np.flatnonzero(np.diff(starts, append=len(data)) > longest)
        if len(long):
            ends = np.append(starts, len(data))
            starts = np.sort(np.concatenate([starts, *((starts[i] + np.flatnonzero(lead[starts[i] : ends[i + 1]]))[longest::longest] for i in long)]))
        return starts

    def lines(ids: pa.Array, data: np.ndarray, ends: np.ndarray, paged: np.ndarray) -> pa.RecordBatch:
        """Lines of texts that end before the marks at ``ends``."""
        feed, last = data == 10, np.zeros(len(data), bool)
        last[ends] = True
        if paged.any():
            last |= (data == 12) & np.repeat(paged, np.diff(ends, prepend=-1))
        stops = np.flatnonzero(feed | last)
        first = np.append(0, stops[:-1] + 1)
        after_feed = np.append(False, feed[stops[:-1]])
        # No empty line after a final line feed.
        kept = ~(last[stops] & (stops == first) & after_feed)
        crs = stops[feed[stops] & (stops > first)] - 1
        crs = crs[data[crs] == 13]
        inside = np.ones(len(data), bool)
        inside[stops] = inside[crs] = False
        place = np.append(0, np.cumsum(inside))
        doc = np.searchsorted(ends, stops)[kept]
        page = (np.cumsum(last[stops]) - last[stops])[kept]
        first, stop = place[first[kept]], place[stops[kept]]
        data = clean[data[inside]]
        starts = cuts(data, first[first < stop])
        before, after = np.searchsorted(starts, first), np.searchsorted(starts, stop)
        # An empty line's word is empty, and before all that follow.
        empty = first == stop
        offsets = np.append(np.insert(starts, before[empty], first[empty]), len(data)).astype(np.int32)
        sizes = np.maximum(after - before, 1)
        bounds = np.append(0, np.cumsum(sizes))
        words = np.append(0, np.cumsum(data[starts] != 32))
        strings = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        if by_word:
            return words_of(ids, strings, np.bincount(doc, sizes, len(ids)).astype(np.int64))
        nth, top = np.arange(len(doc)), np.searchsorted(doc, doc)
        start = bounds[:-1] - bounds[top]
        ints = (nth - top, start, start + sizes - 1, page - page[top], nth - np.searchsorted(page, page))
        columns = [ids.take(pa.array(doc)), *(pa.array(c.astype(np.int32)) for c in ints), pa.array(words[after] - words[before]), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), strings)]
        if listed:
            own = strings.unique()
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.full(len(doc), len(own))).astype(np.int32)), own, mask=pa.array(nth > 0)))
        return pa.RecordBatch.from_arrays(columns, names)

    def words_of(ids: pa.Array, strings: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
        """Each text's distinct words; a text has as many of the strings as its size says."""
        coded = strings.dictionary_encode()
        many = len(coded.dictionary)
        found, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * many + coded.indices.to_numpy(), return_counts=True)
        doc = found // many
        return pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), coded.dictionary.take(pa.array(found % many)), *(pa.array(c.astype(np.int32)) for c in (n, sizes[doc] - 1))], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, paged = batch.columns
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            lo = 0
            while lo < len(ids):
                done = ends[lo - 1] if lo else 0
                hi = max(int(np.searchsorted(ends, done + at_once)), lo + 1)
                some = b"".join(texts.slice(lo, hi - lo).to_pylist())
                yield lines(ids.slice(lo, hi - lo), np.frombuffer(some, np.uint8), ends[lo:hi] - done - 1, paged.slice(lo, hi - lo).to_numpy(zero_copy_only=False))
                lo = hi

    return work


def position_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, line, word) of lines with their tokens."""
    at = lines.select("doc_id", "line", "start_pos", F.posexplode("tokens").alias("nth", "word"))
    return at.select("doc_id", (F.col("start_pos") + F.col("nth")).alias("pos"), "line", "word")


def word_rows(lines: DataFrame) -> DataFrame:
    return dictionary_rows(lines.select(F.explode(F.array_distinct("tokens")).alias("word")))


def listed_words(lines: DataFrame) -> DataFrame:
    """The dictionary of lines that were made with ``listed``."""
    return dictionary_rows(lines.select(F.explode("listed").alias("word")))


def dictionary_rows(words: DataFrame) -> DataFrame:
    return words.distinct().select("word", T.ascii_lower(F.col("word")).alias("word_ci"), T.size(F.col("word")).alias("word_len"))


def with_hash(docs: DataFrame) -> DataFrame:
    """``docs`` with the hash of their content, unless they have one (as files do, of their bytes)."""
    return docs if "doc_hash" in docs.columns else docs.withColumn("doc_hash", content_hash(F.coalesce("text", F.lit(""))))


def build(docs: DataFrame, paged: bool = False, first_id: int = 1) -> Index:
    """``docs`` has path, text and optionally search_mode (multi or single), format (pdf texts are paged) and doc_hash.

    Rows of equal content share a doc_id and are indexed once: contents are numbered from ``first_id`` in the order of their
    hashes, so no two share a number. If a doc_id is given, it tells the rows apart instead.
    """
    docs = with_hash(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    if "search_mode" not in docs.columns:
        docs = docs.withColumn("search_mode", F.lit("multi"))
    pages = (F.col("format") == "pdf") if "format" in docs.columns and not paged else paged
    texts = docs
    if "doc_id" not in docs.columns:
        ids = placed(docs.select("doc_hash").distinct(), [F.col("doc_hash")], "doc_id").withColumn("doc_id", F.col("doc_id") + (first_id - 1))
        docs = docs.join(ids, "doc_hash")
        texts = docs.dropDuplicates(["doc_hash"])
    page = F.element_at(F.split("text", "\f", -1), 1)
    head = F.col("text") if pages is False else page if pages is True else F.when(pages, page).otherwise(F.col("text"))
    title = T.sanitize(F.try_element_at(T.lines(head), F.lit(1)))
    heads = docs.select("path", "search_mode", "doc_id", "doc_hash", title.alias("title"), *[c for c in ("format", "mod_time", "last_used") if c in docs.columns])
    return Index.of(heads, line_rows(texts, paged=pages))


def new_documents(docs: DataFrame, indexed: DataFrame) -> DataFrame:
    """Those of ``docs`` whose content isn't indexed yet."""
    return with_hash(docs).join(indexed.select("doc_hash").distinct(), "doc_hash", "left_anti")


def append(docs: DataFrame, path: str, paged: bool = False) -> None:
    """Indexes the documents whose content isn't in the index at ``path`` and adds them as one batch, or makes the index.

    Running it again adds nothing, and after a crash it starts anew: a run counts only when the manifest names it, which is
    last. Words that are there aren't added again, and numbers of pruned documents aren't used again. One writer at a time.
    """
    spark = docs.sparkSession
    manifest, fresh = Manifest.read(spark, path), with_hash(docs)
    if manifest.runs:
        fresh = new_documents(docs, Index.read(spark, path).docs)
    fresh = fresh.dropDuplicates(["doc_hash"])
    if not fresh.isEmpty() or not manifest.runs:
        build(fresh, paged, manifest.next_id).write(path, "append")


def least_recently_used(docs: DataFrame, keep: int, used_col: str = "last_used") -> DataFrame:
    """doc_ids beyond the ``keep`` most recently used; ties go to the smaller id."""
    rows = placed(docs.select("doc_id", used_col), [F.col(used_col).desc_nulls_last(), F.col("doc_id")])
    return rows.filter(F.col("place") > keep).select("doc_id")


def touch(spark: SparkSession, path: str, hashes: DataFrame) -> None:
    """Notes that the contents with these hashes (doc_hash) are used now, in a log beside the index at ``path``."""
    hashes.select("doc_hash").distinct().withColumn("last_used", F.current_timestamp()).write.mode("append").parquet(f"{path}/used")


def last_used(spark: SparkSession, path: str) -> DataFrame:
    """(doc_hash, last_used) of what has been used."""
    if not present(spark, f"{path}/used"):
        return spark.createDataFrame([], "doc_hash string, last_used timestamp")
    return spark.read.parquet(f"{path}/used").groupBy("doc_hash").agg(F.max("last_used").alias("last_used"))


def prune(index: Index, keep: int) -> Index:
    """The index without its least recently used documents, links included."""
    gone = least_recently_used(index.docs.groupBy("doc_id").agg(F.max("last_used").alias("last_used")), keep)
    docs, positions, lines, links, pairs = (df.join(gone, "doc_id", "left_anti") for df in (index.docs, index.positions, index.lines, index.links, index.brackets()))
    held = None if index.held is None else index.held.join(gone, "doc_id", "left_anti")
    return Index(docs, positions, lines, index.words, links, pairs, index.grams, held)


BRACKETS = "()[]{}"
#: Positions of a block of the bracket scan.
BRACKET_BLOCK = 4096


def bracket_pairs(positions: DataFrame) -> DataFrame:
    """(doc_id, open_pos, close_pos) of matching brackets, each kind by itself: an opening one's partner is the next
    bracket at its depth, if that closes.

    Both depths and partners are found in two levels: inside blocks of positions, then over what the blocks leave, which is
    one sum for each block, and of each depth at most a block's first and last bracket. No window spans a document's brackets.
    """
    kinds = F.create_map(*(F.lit(x) for o, c in ("()", "[]", "{}") for x in (o, o, c, o)))
    marks = positions.filter(F.col("word").isin(*BRACKETS)).select("doc_id", "pos", F.element_at(kinds, F.col("word")).alias("kind"), F.col("word").isin("(", "[", "{").alias("opens"))
    marks = marks.withColumn("block", F.floor(F.col("pos") / BRACKET_BLOCK))
    step = F.when(F.col("opens"), 1).otherwise(-1)
    sums = marks.groupBy("doc_id", "kind", "block").agg(F.sum(step).alias("change"))
    before = F.sum("change").over(Window.partitionBy("doc_id", "kind").orderBy("block")) - F.col("change")
    bases = sums.select("doc_id", "kind", "block", before.alias("base"))
    inside = F.sum(step).over(Window.partitionBy("doc_id", "kind", "block").orderBy("pos"))
    level = marks.withColumn("inside", inside).join(bases, ["doc_id", "kind", "block"])
    level = level.withColumn("depth", F.col("base") + F.col("inside") + F.when(F.col("opens"), 0).otherwise(1))
    own = Window.partitionBy("doc_id", "kind", "depth", "block").orderBy("pos")
    rows = level.withColumns({"next_pos": F.lead("pos").over(own), "next_opens": F.lead("opens").over(own), "nth": F.row_number().over(own)})
    near = rows.filter("opens and not next_opens").select("doc_id", F.col("pos").alias("open_pos"), F.col("next_pos").alias("close_pos"))
    # What is first or last in its block may have a partner in another one.
    edge = rows.filter("nth = 1 or next_pos is null").select("doc_id", "kind", "depth", "pos", "opens", F.col("next_pos").isNull().alias("last"))
    over = Window.partitionBy("doc_id", "kind", "depth").orderBy("pos")
    far = edge.withColumns({"next_pos": F.lead("pos").over(over), "next_opens": F.lead("opens").over(over)})
    far = far.filter("opens and last and not next_opens").select("doc_id", F.col("pos").alias("open_pos"), F.col("next_pos").alias("close_pos"))
    return near.unionByName(far)
