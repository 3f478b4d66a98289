"""Best-fit packing by minimum bin slack over a length histogram."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, text_slices
from .pieces import LATIN_LETTERS, LATIN_NUMBERS, WHITE, PieceCoder, is_latin

CAPACITY = 4096
END_ID = 1
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def word_bpe_coder(path: str) -> PieceCoder:
    """Ids of texts under a word-end BPE tokenizer file (lower case, white space dropped), as 32-bit numbers.

    The ids are those of the library as it loads the file, so a special token's own string stands for that token. For texts
    of U+0000 to U+00FF the tokenizer's cut is one pattern over the lower-cased text, and normal form C changes nothing; the
    words are then merged by the file's model, many at a time, each ending at an id with the word-end mark. Chunks between
    blanks that have other characters or a special token's string go through the whole tokenizer.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers import pre_tokenizers as pre

    full = Tokenizer.from_file(path)
    special = re.compile("|".join(re.escape(t.content) for t in full.get_added_tokens_decoder().values()) or r"(?!)")
    words = Tokenizer(full.model)
    words.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
    last = np.zeros(full.get_vocab_size(), bool)
    last[[i for w, i in full.get_vocab(with_added_tokens=False).items() if w.endswith("</w>")]] = True
    word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^{WHITE}{LATIN_LETTERS}{LATIN_NUMBERS}]+")

    def cut(text: str) -> list[str]:
        if is_latin(text) and not special.search(text):
            return word.findall(text.lower())
        out: list[str] = []
        for chunk in text.replace("\n", " ").split(" "):
            if is_latin(chunk) and not special.search(chunk):
                out += word.findall(chunk.lower())
            else:
                out.append(" " + chunk)  # no other piece holds a space
        return out

    def learn(new: list[str]) -> list[bytes]:
        found = {}
        plain = [w for w in new if w[0] != " "]
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(words.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer's words don't end in </w>")
            found.update(zip(some, (x.tobytes() for x in np.split(ids, ends[:-1])), strict=True))
        other = [w for w in new if w[0] == " "]
        found.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(other, full.encode_batch([w[1:] for w in other], add_special_tokens=False), strict=True))
        return [found[w] for w in new]

    return PieceCoder(cut, learn, re.compile("[ \n]"))


_coders: dict[str, PieceCoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens, with the piece's number among those of its length in its partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        if tokenizer not in _coders:
            _coders[tokenizer] = word_bpe_coder(tokenizer)
        coder, end = _coders[tokenizer], np.array([end_id], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in text_slices(texts, 1_000_000):
                yield cut_batch(doc_ids[lo:hi], [x + end for x in coder.ids(texts[lo:hi])], part, seen)

    def cut_batch(doc_ids: list, encoded: list[bytes], part: int, seen: np.ndarray) -> pa.RecordBatch:
        rows: list[tuple] = []
        for doc_id, ids in zip(doc_ids, encoded, strict=True):
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[at : at + 4 * capacity]
                n = len(own) // 4
                rows.append((doc_id, k, at // 4, n, zlib.crc32(own), part, seen[n]))
                seen[n] += 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths whose sum comes closest to ``room`` from below: subset sums as the bits of one integer.

    Lengths are taken from the longest down, so short ones are left for later bins; the search ends at an exact fill.
    """
    mask, bits, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4, ... copies at a time
            k = min(k, left)
            steps.append((length, k, bits))
            bits |= bits << length * k & mask
            left -= k
            k *= 2
        if bits >> room & 1:
            break
    at, used = bits.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            used[length] = used.get(length, 0) + k
    return used


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (times, [(length, copies), ...]), in order of making.

    Each bin is seeded with the longest length left and filled by :func:`fullest`; the combination is removed as often as
    the counts allow, which is what one bin at a time would choose again. Every entry uses up a length's last few copies
    or brings it below the copies a bin takes, so there are at most a few entries per length, however many pieces exist.
    """
    counts = {k: v for k, v in counts.items() if v}
    bins = []
    while counts:
        seed = max(counts)
        rest = dict(counts)
        rest[seed] -= 1
        use = fullest({k: v for k, v in rest.items() if v}, capacity - seed)
        use[seed] = use.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in use.items())
        bins.append((times, sorted(use.items(), reverse=True)))
        for k, n in use.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return bins


def slots(bins: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """For each run of equally used copies of a length: key (length, first rank), first bin, copies a bin, offset."""
    rows, base, taken = [], 0, {}
    for times, use in bins:
        offset = 0
        for length, copies in use:
            first = taken.get(length, 0)
            rows.append((length << 44 | first, base, copies, offset))
            taken[length] = first + copies * times
            offset += length * copies
        base += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 4))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens; one row per piece.

    A document is its token ids and ``end_id``; only longer ones are cut, the last piece taking what is left. Columns:
    doc_id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), sequence_id, offset.

    The plan needs the number of pieces of each length and no more: at most ``capacity`` counts reach the driver,
    whatever the corpus. Minimum bin slack runs on those, and each piece finds its place from its rank among the pieces
    of its length (a running number in its partition, plus the pieces in partitions before).

    Null or empty text is the end id alone; null ids stay null; rows repeated are packed once each; an empty table gives
    no rows; other columns aren't read. Of equal lengths, pieces are taken in the table's order.
    """
    if capacity >= 1 << 18:
        raise ValueError("capacity must be under 2**18")
    cut = saved(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    own = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = own.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = slots(minimum_bin_slack(counts, capacity))
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, copies, offset = shared.value
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            nth = rank - (keys[at] & (1 << 44) - 1) if len(at) else rank
            columns = [*b.columns[:5], pa.array(base[at] + nth // copies[at]), pa.array(offset[at] + nth % copies[at] * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
