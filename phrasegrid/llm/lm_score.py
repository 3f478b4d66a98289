"""Language-model scores: word counts as a base, prediction by partial matching over bytes as the model."""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of, discard, saved, text_slices

#: Ends every text in the model, and stands for the bytes before it; it occurs in no UTF-8 text.
END = 0xFF
#: Bytes of context of the model's deepest level.
ORDER = 5
#: Bytes of text that ask together for their distinct words and grams in the corpus counts.
CHUNK_BYTES = 16_000_000
#: Distinct grams that a chunk holds before it ends early, and that are scored at a time.
CHUNK_GRAMS, SCORE_ROWS = 4_000_000, 1_000_000

#: Rows of texts (some of a chunk's, compressed together), of its distinct words (with a token) and grams (with a code).
UNIFIED = "chunk long, ids array<long>, held array<boolean>, sizes array<long>, texts binary, token binary, code long, n long"


def grams(texts: list[bytes]) -> np.ndarray:
    """Each byte with the ORDER bytes before it as one number, text by text, each text with its start and end."""
    joined = np.frombuffer(b"".join(b"\xff" * ORDER + t + b"\xff" for t in texts), np.uint8).astype(np.int64)
    out = joined[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= joined[ORDER - k : len(joined) - k] << 8 * k
    keep = np.ones(len(out), bool)
    ends = np.cumsum([len(t) + 1 + ORDER for t in texts])[:-1]
    for k in range(ORDER):  # windows that run into the next text
        keep[ends - ORDER + k] = False
    return out[keep]


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with their summed counts."""
    order = np.argsort(code)
    code, n = code[order], n[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(first) else n


def _subtries(batches: Iterator[pa.RecordBatch], least: int = SCORE_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and counts, which come in order of their last three bytes of context, cut only where those change."""
    some, rows, enough = [], 0, least
    for b in batches:
        some.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        rows += b.num_rows
        if rows >= enough:
            code, n = (np.concatenate(x) for x in zip(*some, strict=True))
            end = np.searchsorted(_three(code), _three(code[-1]))
            if end:
                yield code[:end], n[:end]
            some, rows = [(code[end:], n[end:])], len(code) - end
            enough = max(least, 2 * rows)
    if rows:
        code, n = (np.concatenate(x) for x in zip(*some, strict=True))
        yield code, n


def _three(code):
    """The last three bytes of context: what a code's contexts of order 3 and more have in common."""
    return code >> 8 & 0xFFFFFF


def gram_scores(counts: DataFrame) -> DataFrame:
    """(code, score): the model's log10 probability of each gram of ``counts``, which has all grams once with their counts.

    A gram meets only contexts that end in its own last three bytes, besides those of orders 0 to 2. So grams are dealt by
    these bytes, and a task makes the trie of a range of them, whole, whatever it has been counted; order 2 is broadcast.
    """
    mask = lambda k: (1 << 8 * (k + 1)) - 1
    got = counts.filter("n > 0").groupBy(F.col("code").bitwiseAND(mask(2)).alias("code")).agg(F.sum("n").alias("n")).toArrow()  # at most 2**24 rows
    two = _summed(got.column("code").to_numpy(), got.column("n").to_numpy())
    shared, key = counts.sparkSession.sparkContext.broadcast(two), uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n in _subtries(batches):
            if key not in _models:
                _models.clear()
                _models[key] = Ppm({2: shared.value})
            seen = n > 0
            levels = {2: shared.value, ORDER: _summed(code[seen], n[seen])}
            for k in range(ORDER - 1, 2, -1):
                levels[k] = _summed(levels[k + 1][0] & mask(k), levels[k + 1][1])
            out = Ppm(levels, _models[key]).score(code)
            for lo in range(0, len(code), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(code[lo : lo + 100_000]), pa.array(out[lo : lo + 100_000])], ["code", "score"])

    three = F.shiftright("code", 8).bitwiseAND(0xFFFFFF)
    return counts.repartition(three).sortWithinPartitions(three).select("code", "n").mapInArrow(score, "code long, score float")


def ppm_base(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 probabilities [context, byte] of PPM of order 2, from counts by code.

    The trie's levels are the counts after two, one and no bytes; the shorter contexts' are sums of the longer's. In a
    context of total n and d distinct symbols a symbol of count c has c / (n + d) and escape d / (n + d) (method C); below
    an escape, symbols already offered are excluded from counts, and the last level shares evenly among those left. When
    all 256 have been offered there is no escape. Each context's probabilities sum to 1. 64 MB, whatever the corpus.
    """
    two = np.zeros(1 << 24, np.float32)
    two[code] = n
    two = two.reshape(256, 256, 256)
    one = two.sum(0, dtype=np.float64)
    zero = one.sum(0)
    table = np.empty((256, 256, 256), np.float32)
    for last in range(256):
        rest = np.ones((256, 1))
        seen = np.zeros((256, 256), bool)
        p = np.zeros((256, 256))
        for counts in (two[:, last], one[last][None], zero[None]):
            c = np.where(seen, 0, counts).astype(np.float64)
            total, distinct = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            seen = seen | (c > 0)
            full = seen.all(1, keepdims=True)
            with np.errstate(invalid="ignore", divide="ignore"):
                share = np.where(total > 0, 1 / (total + np.where(full, 0, distinct)), 0)
            p += rest * c * share
            rest = rest * np.where(total > 0, np.where(full, 0, distinct * share), 1)
        left = (~seen).sum(1, keepdims=True)
        p += np.where(seen, 0, rest / np.maximum(left, 1))
        table[:, last] = np.log10(p)
    return table.reshape(-1)


class Index:
    """Numbers of fixed keys by open addressing in arrays; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.number = np.full(1 << self.bits, -1, np.int32)
        at, left = self._first(keys), np.arange(len(keys))
        while len(left):
            free = self.slots[at] == -1
            self.slots[at[free]] = keys[left[free]]  # the last of several keys stays
            own = self.slots[at] == keys[left]
            self.number[at[own]] = left[own]
            at, left = (at[~own] + 1) & ((1 << self.bits) - 1), left[~own]

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._first(keys)
        there = self.slots[at]
        out = np.where(there == keys, self.number[at], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            at_left = (at[left] + 1) & ((1 << self.bits) - 1)
            at[left] = at_left
            there = self.slots[at_left]
            hit = there == keys[left]
            out[left[hit]] = self.number[at_left[hit]]
            left = left[~hit & (there != -1)]
        return out


class Ppm:
    """PPM: a trie of byte contexts with method C escapes and symbol exclusion, pretrained.

    ``levels`` has (code, n) for each order from 2 on. A byte's code at a level holds its context above the low 8 bits, so
    the level's nodes are runs of equal contexts. Coming from a longer context, a level leaves out the bytes offered
    there: its total is n - a + d - e, with n and d the level's own total and distinct bytes, a what it counts of the e
    bytes of the longer context. A byte kept at a level is kept at all shallower ones, so those sums need one level at a
    time and are made once. Orders 0 to 2 are a whole table (:func:`ppm_base`), taken from ``base`` if that is given, a
    model with the same level 2; the deeper levels may then be those under some contexts of order 3 only, for their grams.
    """

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray]], base: Ppm | None = None):
        code, n = levels[2]
        if base:
            self.table, self.seen, self.whole, self.escape, total, distinct = base.table, base.seen, base.whole, base.escape, *base.two
        else:
            self.table = ppm_base(code, n)
            self.seen = np.zeros(1 << 24, bool)
            self.seen[code] = True
            total = np.bincount(code >> 8, n, 1 << 16)
            distinct = np.bincount(code >> 8, minlength=1 << 16)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.whole = np.log10(total + distinct).astype(np.float32)
                self.escape = np.log10(distinct / (total + distinct)).astype(np.float32)
        self.two = total, distinct
        shorter = (None, n, total, distinct)  # at order 2 a context is its own number
        self.levels = {}
        for k in range(3, max(levels) + 1):
            code, n = levels[k]
            node, first = np.unique(code >> 8, return_index=True)
            of = np.repeat(np.arange(len(node)), np.diff(np.r_[first, len(code)]))
            total, distinct = np.bincount(of, n, len(node)), np.bincount(of, minlength=len(node))
            index, up_n, up_total, up_distinct = shorter
            up = node & (1 << 8 * (k - 1)) - 1
            up = up if index is None else index["nodes"].find(up)
            short = code & (1 << 8 * k) - 1
            counted = np.bincount(of, self._two(levels[2], short) if index is None else up_n[index["pairs"].find(short)], len(node))
            left = up_total[up] - counted + up_distinct[up] - distinct
            with np.errstate(divide="ignore", invalid="ignore"):
                level = {
                    "pairs": Index(code), "nodes": Index(node), "n": np.log10(n).astype(np.float32),
                    "p": (np.log10(n) - np.log10(total + distinct)[of]).astype(np.float32),
                    "escape": np.log10(distinct / (total + distinct)).astype(np.float32),
                    "left": np.where(left > 0, np.log10(left), 0).astype(np.float32),  # log of the shorter level's total
                    "pass": np.where(left > 0, np.log10((up_distinct[up] - distinct) / left), 0).astype(np.float32),  # its escape
                }
            self.levels[k] = level
            shorter = (level, n, total, distinct)

    @staticmethod
    def _two(level: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
        """Counts at order 2 of codes that all occur there."""
        code, n = level
        return n[np.searchsorted(code, codes)]

    def score(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after the others."""
        out = np.empty(len(gram), np.float32)
        left, so_far, longer = np.arange(len(gram)), np.zeros(len(gram), np.float32), None
        came = np.full(len(gram), -1)  # the longer context's node, if it is one
        for k in sorted(self.levels, reverse=True):
            level = self.levels[k]
            gram = gram & (1 << 8 * (k + 1)) - 1
            pair = level["pairs"].find(gram)
            hit = pair >= 0
            own = level["p"][pair[hit]]
            if longer:
                own = np.where(came[hit] >= 0, level["n"][pair[hit]] - _at(longer["left"], came[hit]), own)
            out[left[hit]] = so_far[hit] + own
            left, gram, came, so_far = (x[~hit] for x in (left, gram, came, so_far))
            node = level["nodes"].find(gram >> 8)
            escape = _at(level["escape"], node)
            so_far = so_far + (np.where(came >= 0, _at(longer["pass"], came), escape) if longer else escape)
            came, longer = node, level
        gram = gram & (1 << 24) - 1
        plain, seen = self.table[gram], self.seen[gram]
        context = gram >> 8
        within = np.where(seen, plain + self.whole[context] - _at(longer["left"], came), _at(longer["pass"], came) + plain - self.escape[context])
        out[left] = so_far + np.where(came >= 0, within, plain)
        return out


def _at(values: np.ndarray, index: np.ndarray) -> np.ndarray:
    """values[index], 0 where the index is -1."""
    return np.where(index >= 0, values[index], 0).astype(np.float32) if len(values) else np.zeros(len(index), np.float32)


_models: dict[str, Ppm] = {}


class _Chunk:
    """Documents that ask together for their distinct words and grams."""

    def __init__(self, name: int):
        self.name, self.bytes = name, 0
        self.number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.learnt = np.zeros(0, np.int64)
        self.code, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: dict[bool, list[bytes]] = {True: [], False: []}
        self.parts: list[tuple[list[int | None], list[bool], list[int], bytes]] = []

    def add(self, ids: list[int | None], held: list[bool], texts: list[bytes]) -> None:
        split = [t.split() for t in texts]
        sizes = np.array([len(x) for x in split], np.int64)
        own = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(split)), np.int32, int(sizes.sum()))
        counts = np.bincount(own[np.repeat(~np.array(held, bool), sizes)], minlength=len(self.number))
        counts[: len(self.learnt)] += self.learnt
        self.learnt = counts
        for t, h in zip(texts, held, strict=True):
            self.new[bool(h)].append(t)
        self.parts.append((ids, held, [len(t) for t in texts], _zipped(b"".join(texts))))
        self.bytes += sum(map(len, texts))
        if sum(len(t) for x in self.new.values() for t in x) >= 3_000_000:
            self.count()

    def count(self) -> None:
        """Adds the grams of the texts since the last time; those of held-out texts count nothing but are asked for."""
        for held, texts in self.new.items():
            for lo, hi in text_slices(texts, 3_000_000):
                own, times = np.unique(grams(texts[lo:hi]), return_counts=True)
                self.code, self.n = _summed(np.r_[self.code, own], np.r_[self.n, times * (not held)])
        self.new = {True: [], False: []}

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The documents, then the distinct words and the distinct grams with their counts in training documents."""
        self.count()
        for at in range(0, len(self.parts), 8):
            ids, held, sizes, texts = zip(*self.parts[at : at + 8], strict=True)
            yield self._batch(len(ids), ids=ids, held=held, sizes=sizes, texts=texts)
        self.parts = []
        tokens = iter(self.number)
        for at in range(0, len(self.number), 20_000):
            some = list(itertools.islice(tokens, 20_000))
            yield self._batch(len(some), token=some, n=self.learnt[at : at + 20_000])
        for at in range(0, len(self.code), 100_000):
            some = self.code[at : at + 100_000]
            yield self._batch(len(some), code=some, n=self.n[at : at + 100_000])

    def _batch(self, rows: int, **columns) -> pa.RecordBatch:
        columns["chunk"] = np.full(rows, self.name)
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in ROWS], schema=ROWS)


FOUND = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
FOUND_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
#: UNIFIED in Arrow.
ROWS = pa.schema(
    [
        ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())),
        ("texts", pa.binary()), ("token", pa.binary()), ("code", pa.int64()), ("n", pa.int64()),
    ]
)


def _zipped(raw: bytes) -> bytes:
    """zstd after the length."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzipped(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, sizes: list[int]) -> list[bytes]:
    whole, ends = _unzipped(packed), itertools.accumulate(sizes)
    return [whole[e - n : e] for e, n in zip(ends, sizes, strict=True)]


def _planes(values: np.ndarray) -> bytes:
    """Numbers, compressed byte by byte of significance."""
    return _zipped(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def _from_planes(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(_unzipped(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(-1)


#: Answers to a chunk, many a row: words and their counts (and what the first place of each word sums to), or codes and scores.
ANSWERS = "chunk long, tokens binary, codes binary, found binary, total long, words long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of several batches by chunk, the first column."""
    some, rows = [], 0
    for b in itertools.chain(batches, [None]):
        if b is not None:
            some.append(b)
            rows += b.num_rows
        if rows and (b is None or rows >= SCORE_ROWS):
            whole = pa.Table.from_batches(some)
            chunk = whole.column(0).to_numpy()
            order = np.argsort(chunk, kind="stable")
            whole, chunk = whole.take(pa.array(order)), chunk[order]
            starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
            for lo, hi in zip(starts, [*starts[1:], len(chunk)], strict=True):
                yield int(chunk[lo]), whole.slice(lo, hi - lo)
            some, rows = [], 0


def _answer(*row) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in ANSWERS.split(", ")])


def _pack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of chunk, token, c, nth."""
    for chunk, rows in _runs(batches):
        c, nth = rows.column(2).to_numpy(), rows.column(3).to_numpy()
        first = (nth == 1) & (c > 0)
        tokens = b" ".join(rows.column(1).to_pylist())  # words have no spaces
        yield _answer(chunk, _zipped(tokens), None, _planes(c), int(c[first].sum()), int(first.sum()))


def _pack_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of chunk, code, score."""
    for chunk, rows in _runs(batches):
        code = rows.column(1).to_numpy()
        order = np.argsort(code)
        yield _answer(chunk, None, _planes(np.diff(code[order], prepend=0)), _planes(rows.column(2).to_numpy()[order]), 0, 0)


def lm_scores(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that aren't ``held_out`` (default: crc32 of the id as text, mod 7, is 2), all of them and whole.

    ``score`` is the log10 probability of the text's bytes (A-Z lower-cased) and an end mark under PPM with contexts of
    at most ORDER bytes, pretrained: grams are counted over the whole corpus and all are kept, at every order, in a
    distributed table; the driver gets the counts of order 2 only, at most 2**24, and broadcasts them.

    ``base_score`` sums log10((c + 1) / (N + V + 1)) over words and the end, c being the token's corpus count.

    Neither words nor grams have a bound, so they are looked up by joins: documents are taken in chunks, a chunk asks once
    for each of its distinct words and grams, and gets counts and scores back. A frequent one has one row per chunk, not
    one per place.

    Null text is empty: its one token is the end. A null id counts as the empty text for ``held_out``. Repeated rows give a
    row each. Without training rows N = V = 0 and bytes are even. An empty table gives no rows; other columns aren't read.
    """
    held = crc_of(F.col(id_col)) % 7 == 2 if held_out is None else held_out
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("binary").alias("text"))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = itertools.count(TaskContext.get().partitionId() << 32)
        chunk = _Chunk(next(names))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                ids, held = some.column(0).to_pylist(), some.column(1).to_pylist()
                texts = [(t or b"").lower() for t in some.column(2).to_pylist()]
                for at, end in text_slices(texts, 500_000):
                    chunk.add(ids[at:end], held[at:end], texts[at:end])
                    if chunk.bytes >= chunk_bytes or len(chunk.code) >= CHUNK_GRAMS:
                        yield from chunk.rows()
                        chunk = _Chunk(next(names))
        yield from chunk.rows()

    both = saved(base.mapInArrow(chunked, UNIFIED), "words-and-texts")
    texts = both.filter("texts is not null").select("chunk", "ids", "held", "sizes", "texts")
    asked = both.filter("token is not null").select("chunk", "token", "n")
    # Counts by themselves, joined back: a common word has a row in every chunk, and such a join can be split.
    words = saved(asked.groupBy("token").agg(F.sum("n").alias("c"), F.min("chunk").alias("first")), "tokens")
    known = asked.select("chunk", "token").join(words, "token").select("chunk", "token", "c", F.when(F.col("chunk") == F.col("first"), 1).otherwise(2).alias("nth"))
    known = saved(known.mapInArrow(_pack_counts, ANSWERS), "word-counts")
    discard(words)
    ends = base.filter("not held_out").count()
    total = known.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    n_all, n_distinct = int(total[0]) + ends, int(total[1]) + (ends > 0)
    own_end = np.log10((ends + 1) / (n_all + n_distinct + 1))

    places = both.filter("code is not null").select("chunk", "code", "n")
    counts = saved(places.groupBy("code").agg(F.sum("n").alias("n")), "gram-counts")
    scores = saved(gram_scores(counts), "gram-scores")
    discard(counts)
    scored = places.select("chunk", "code").join(scores.hint("shuffle_hash"), "code")
    answers = known.unionByName(scored.select("chunk", "code", "score").mapInArrow(_pack_scores, ANSWERS))

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        tokens, c, code, score = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for words, keys, values in zip(*(right.column(x).to_pylist() for x in ("tokens", "codes", "found")), strict=True):
            if keys is None:
                tokens += _unzipped(words).split()
                c.append(_from_planes(values, np.int64))
            else:
                code.append(np.cumsum(_from_planes(keys, np.int64)))
                score.append(_from_planes(values, np.float32))
        c, score, index = np.concatenate(c), np.concatenate(score), Index(np.concatenate(code))
        number = dict(zip(tokens, range(len(c)), strict=True))
        logs, is_known = np.log10((c + 1) / (n_all + n_distinct + 1)), c > 0
        out: dict[str, list] = {f.split()[0]: [] for f in FOUND.split(", ")}
        for ids, held, sizes, packed in zip(*(left.column(x).to_pylist() for x in ("ids", "held", "sizes", "texts")), strict=True):
            texts = _unpacked(packed, sizes)
            split = [t.split() for t in texts]
            n = np.array([len(x) for x in split], np.int64)
            own = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(split)), np.int32, int(n.sum()))
            to = np.cumsum(n)
            base_sum, known_sum = np.r_[0, np.cumsum(logs[own])], np.r_[0, np.cumsum(is_known[own])]
            starts = np.cumsum([0, *(x + 1 for x in sizes[:-1])])
            out["doc_id"] += ids
            out["held_out"] += held
            out["n_tokens"] += (n + 1).tolist()
            out["n_known"] += (known_sum[to] - known_sum[to - n] + (ends > 0)).tolist()
            out["train_tokens"] += [n_all] * len(ids)
            out["base_score"] += (base_sum[to] - base_sum[to - n] + own_end).tolist()
            out["score"] += np.add.reduceat(score[index.find(grams(texts))], starts, dtype=np.float64).tolist()
        return pa.table({name: pa.array(out[name], kind) for name, kind in zip(out, FOUND_TYPES, strict=True)})

    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, FOUND)
