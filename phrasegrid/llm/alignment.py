"""Cross-tokenizer alignment: packed bitsets of token ends, their common cuts, and the links between tokens."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, text_slices
from .pieces import is_latin

#: Text bytes of a chunk, which asks once for each of its distinct id pairs.
CHUNK_BYTES = 8_000_000
#: Distinct segments that a worker keeps from one chunk to the next.
KNOWN = 500_000
#: Bits of a B id in a pair's code.
SHIFT = 20

# Fixed value: the pattern that byte-level tokenizers cut by.
BYTE_LEVEL_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A cut before a blank between two characters that no tokenizer takes for white space: a token of either ends there.
_SEGMENT = re.compile(r"(?<=\S) (?=\S)")
#: A text where some blank has white space beside it, or ends it.
_ODD = re.compile(r"\s | \s| \Z")
#: A segment that others may stand before and after. U+2581 stands for a blank in sentence pieces.
_PLAIN = re.compile(r"(?s) [^\s▁](?:.*[^\s▁])?")

CHUNK = "chunk long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, n_segments array<long>, segments binary, places binary, n_places binary"
ASKED = "code long, n long"
FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Bitset:
    """A packed set of places, with its rank and its members."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bitset:
        marks = np.zeros(-(-size // 64) * 64, np.uint8)
        marks[places] = 1
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def __and__(self, other: Bitset) -> Bitset:
        return Bitset(self.words & other.words)

    def __or__(self, other: Bitset) -> Bitset:
        return Bitset(self.words | other.words)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many members lie before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """All members, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def aligned(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the byte ends of two tokenizations of the same bytes: the shared cuts (last bytes), the number of A and of B
    tokens up to each, and the A and B numbers of all overlapping tokens.

    Between two neighbouring ends of either, one A token and one B token lie, so each end stands for one link.
    """
    a, b = Bitset.of(ends_a - 1, size), Bitset.of(ends_b - 1, size)
    cuts, ends = (a & b).select(), (a | b).select()
    return cuts, a.rank(cuts) + 1, b.rank(cuts) + 1, a.rank(ends), b.rank(ends)


def byte_level() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable ones stand for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _ranked(file: dict, tokens: list[bytes]):
    """An encoder by ranks that gives a byte-level tokenizer's ids, if its merges make tokens in the order of their ids and it
    cuts by the usual pattern; None if not. It is several times as fast."""
    import tiktoken

    merged = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"])]
    ids = [file["model"]["vocab"][m] for m in merged]
    pre = file["pre_tokenizer"]
    usual = pre["type"] == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not file["normalizer"] and not file["model"].get("ignore_merges")
    if not usual or ids != sorted(ids) or len(set(ids)) < len(ids) or set(range(len(tokens))) - set(ids) != {i for i, t in enumerate(tokens) if len(t) == 1} or any(i < 256 for i in ids):
        return None
    return tiktoken.Encoding("by-rank", pat_str=BYTE_LEVEL_CUT, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


class _Growing:
    """Whole numbers that more are added to, in one array."""

    def __init__(self):
        self.held, self.size = np.zeros(1024, np.int64), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(len(self.held), len(values)), np.int64)])
        self.held[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.size]


class Aligner:
    """Aligns texts under a byte-level tokenizer file (A) and a sentence-piece model (B, which puts a blank before).

    Texts are taken in segments; each distinct one is aligned once and has a number in ``known``: its tokens of A (-1 if A's
    or B's bytes aren't the segment's) and B, its groups, their text with a semicolon after each, and its links' codes.
    """

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        to_byte = byte_level()
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for t, i in vocab.items():
            self.bytes_a[i] = bytes(map(to_byte.__getitem__, t))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.ranks = _ranked(json.loads(self.a.to_str()), self.bytes_a)
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # Texts can be cut at blanks if no piece goes on after one.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces) and json.loads(self.a.to_str())["pre_tokenizer"].get("use_regex", False)
        # Ids as they stand in a group's text: of A and B, inside a list and at its end.
        self.words = [f"{i}{end}" for ids, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for end in ends for i in range(len(ids))]
        self.lengths = np.array(list(map(len, self.words)), np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.n_a, self.n_b, self.n_groups, self.n_links, self.codes = (_Growing() for _ in range(5))

    def fresh(self) -> None:
        """Forgets all segments if there are more than KNOWN, so that memory is bounded; numbers are new then."""
        if len(self.known) > KNOWN:
            self.forget()

    def segments(self, text: str) -> list[str]:
        """Space and text, cut where a token of either surely ends; each starts with a blank."""
        text = " " + text
        if not self.cuts:
            return [text]
        if not _ODD.search(text):
            return [" " + x for x in text[1:].split(" ")]
        if "\0" not in text:
            return _SEGMENT.sub("\0 ", text).split("\0")
        at = [0, *(m.start() for m in _SEGMENT.finditer(text))]
        return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]

    def _a_ids(self, texts: list[str]) -> list[int]:
        """A's ids of texts side by side."""
        if self.ranks is not None and all(map(is_latin, texts)):
            return list(itertools.chain.from_iterable(map(self.ranks.encode_ordinary, texts)))
        return [i for e in self.a.encode_batch(texts, add_special_tokens=False) for i in e.ids]

    def numbers(self, segments: list[str]) -> list[int]:
        """The numbers of segments; new ones are aligned, a megabyte at a time."""
        found = list(map(self.known.get, segments))
        if None not in found:
            return found
        new = list(dict.fromkeys(s for s, n in zip(segments, found, strict=True) if n is None))
        # Segments between two blanks are encoded side by side, as both tokenizers cut there; others by themselves.
        plain = [s for s in new if self.cuts and _PLAIN.fullmatch(s)]
        for some in ([s for s in plain if is_latin(s)], [s for s in plain if not is_latin(s)]):
            for lo, hi in text_slices(some, 500_000):
                own = some[lo:hi]
                joined = ["".join(own[x:y]) for x, y in text_slices(own, 500)]
                raw = "".join(joined).encode()
                a = self._a_ids(joined)
                b = list(itertools.chain.from_iterable(self.b.encode([x[1:] for x in joined], num_threads=1)))
                if b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b)):
                    self._add(own, a, b)
        rest = [s for s in new if s not in self.known]
        for lo, hi in text_slices(rest, 1_000_000):
            self._each(rest[lo:hi])
        return [self.known[s] if n is None else n for s, n in zip(segments, found, strict=True)]

    def _each(self, new: list[str]) -> None:
        ids_a = [e.ids for e in self.a.encode_batch(new, add_special_tokens=False)]
        ids_b = self.b.encode([s[1:] for s in new], num_threads=1)
        raw = [s.encode() for s in new]
        same = [b"".join(map(self.bytes_a.__getitem__, x)) == r == b"".join(map(self.bytes_b.__getitem__, y)) for x, y, r in zip(ids_a, ids_b, raw, strict=True)]
        good = [k for k, ok in enumerate(same) if ok]
        if good:
            self._add([new[k] for k in good], [i for k in good for i in ids_a[k]], [i for k in good for i in ids_b[k]])
        bad = [s for s, ok in zip(new, same, strict=True) if not ok]
        self._number(bad, [""] * len(bad), -np.ones(len(bad), np.int64), *(np.zeros(len(bad), np.int64) for _ in range(3)))

    def _number(self, new: list[str], texts: list[str], *columns: np.ndarray) -> None:
        self.known.update(zip(new, range(len(self.texts), len(self.texts) + len(new)), strict=True))
        self.texts += texts
        for column, values in zip((self.n_a, self.n_b, self.n_groups, self.n_links), columns, strict=True):
            column.add(values)

    def _add(self, new: list[str], ids_a: list[int], ids_b: list[int]) -> None:
        """Aligns segments whose bytes the tokens of both give back, by the bits of them all."""
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.cumsum([len(s.encode()) for s in new])
        cuts, up_a, up_b, link_a, link_b = aligned(ends_a, ends_b, int(ends[-1]))
        self.codes.add((a[link_a] << SHIFT) | b[link_b])
        # A segment ends at a cut and at a link's end; after how many of each:
        to_group = np.searchsorted(cuts, ends - 1) + 1
        to_link = to_group + np.searchsorted(np.setxor1d(ends_a, ends_b, assume_unique=True), ends)
        to_a, to_b = up_a[to_group - 1], up_b[to_group - 1]
        # The groups' text: each token of A after the B tokens of the groups before it, each of B after the A tokens up to its own.
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[up_a - 1] = last_b[up_b - 1] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.r_[0, up_b][group_a]] = a + last_a * len(self.bytes_a)
        order[np.arange(len(b)) + up_a[group_b]] = b + last_b * len(self.bytes_b) + 2 * len(self.bytes_a)
        text = "".join(map(self.words.__getitem__, order.tolist()))
        stops = np.r_[0, np.cumsum(self.lengths[order])[to_a + to_b - 1]].tolist()
        each = lambda to: np.diff(to, prepend=0)
        self._number(new, [text[x:y] for x, y in itertools.pairwise(stops)], each(to_a), each(to_b), each(to_group), each(to_link))

    def links(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many links each segment has, and the codes of all of them."""
        sizes = self.n_links.values[numbers]
        starts = (np.cumsum(self.n_links.values) - self.n_links.values)[numbers]
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return sizes, self.codes.values[np.repeat(starts, sizes) + within]


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers under 2**32 by byte planes, compressed."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Chunk:
    """Documents whose segments are looked up together."""

    def __init__(self, name: int, aligner: Aligner):
        self.name, self.bytes, self.aligner = name, 0, aligner
        aligner.fresh()
        self.columns: dict[str, list] = {c: [] for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "groups", "n_segments")}
        self.segments: list[np.ndarray] = []

    def add(self, ids: list, texts: list[str | None]) -> None:
        of = self.aligner
        cut = [of.segments(t) if t else [] for t in texts]
        numbers = of.numbers(list(itertools.chain.from_iterable(cut)))
        self.bytes += sum(len(t.encode()) for t in texts if t)
        at, n = np.array(numbers, np.int64), np.array(list(map(len, cut)), np.int64)
        to = np.cumsum(n)
        total = lambda values: np.diff(np.r_[0, np.cumsum(values)][np.r_[0, to]])
        good = total(of.n_a.values[at] < 0) == 0  # otherwise there are bytes that one of the tokenizers doesn't give back
        for name, column in (("n_a", of.n_a), ("n_b", of.n_b), ("n_groups", of.n_groups), ("n_links", of.n_links)):
            self.columns[name] += np.where(good, total(column.values[at]), 0).tolist()
        words = list(map(of.texts.__getitem__, numbers))
        self.columns["groups"] += [hashlib.sha256("".join(words[lo:hi])[:-1].encode()).hexdigest() if ok and hi > lo else "" for lo, hi, ok in zip((to - n).tolist(), to.tolist(), good.tolist(), strict=True)]
        self.columns["ids"] += ids
        self.columns["n_segments"] += np.where(good, n, 0).tolist()
        self.segments.append(at[np.repeat(good, n)])

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The documents in one row; then the distinct id pairs with how many links hold them, in rows of their own."""
        if not self.columns["ids"]:
            return
        used, at, times = np.unique(np.concatenate(self.segments), return_inverse=True, return_counts=True)
        sizes, codes = self.aligner.links(used)
        distinct, place = np.unique(codes, return_inverse=True)
        n = np.zeros(len(distinct), np.int64)
        np.add.at(n, place, np.repeat(times, sizes))
        kinds = {f.name: f.type for f in _SCHEMA}
        whole = {"chunk": [self.name], **{k: [v] for k, v in self.columns.items()}, "segments": [_pack(at)], "places": [_pack(place)], "n_places": [_pack(sizes)], "code": [None], "n": [None]}
        yield pa.RecordBatch.from_arrays([pa.array(whole[k], t) for k, t in kinds.items()], list(kinds))
        for lo in range(0, len(distinct), 10_000):
            part = {"chunk": np.full(len(distinct[lo : lo + 10_000]), self.name), "code": distinct[lo : lo + 10_000], "n": n[lo : lo + 10_000]}
            yield pa.RecordBatch.from_arrays([pa.array(part[k], t) if k in part else pa.nulls(len(part["n"]), t) for k, t in kinds.items()], list(kinds))


_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("ids", pa.list_(pa.int64()))]
    + [(c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups", pa.list_(pa.string())), ("n_segments", pa.list_(pa.int64())), ("segments", pa.binary()), ("places", pa.binary()), ("n_places", pa.binary()), ("code", pa.int64()), ("n", pa.int64())]
)

_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    key = (path_a, path_b)
    if key not in _aligners:
        _aligners[key] = Aligner(path_a, path_b)
    return _aligners[key]


def token_links(text: str, aligner: Aligner) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]]:
    """A text's groups of A and B ids, and its linked id pairs, in order; none of either if it has no tokens."""
    aligner.fresh()
    at = np.array(aligner.numbers(aligner.segments(text)) if text else [], np.int64)
    if (aligner.n_a.values[at] < 0).any():
        return [], []
    number = lambda x: [int(i) for i in x.split(",")]
    groups = [tuple(map(number, g.split("|"))) for k in at.tolist() for g in aligner.texts[k].split(";")[:-1]]
    return groups, [(c >> SHIFT, c & (1 << SHIFT) - 1) for c in aligner.links(at)[1].tolist()]


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Space and text are encoded by a byte-level tokenizer file (A) and by a sentence-piece model (B), special tokens'
    strings as plain text. Bits mark the bytes where tokens end: where both do, groups end, and ranks of the cuts give the
    groups' tokens; each place where either ends is one link of an A and a B token that overlap. A pair of ids counts as
    often as links hold it in the corpus. ``n_best`` has the links whose pair is a commonest of its B id, ``count_sum`` the
    sum of all links' counts; groups_sha256 is over ``a1,a2|b1;a3|b2,b3``.

    Texts are cut at blanks where tokens of both end, and each distinct segment is aligned once for a chunk of documents
    (or longer, in a bounded memo). Pairs have no bound, so a chunk asks for each of its distinct ones by a join; only the
    highest count of each B id, a table no longer than B's vocabulary, may be broadcast.

    Null and empty texts, and texts whose tokens of A or B don't join to space and text, have no tokens: zeros and an empty
    groups_sha256. Null ids stay null, repeated rows give a row each, an empty table gives no rows; other columns aren't read.
    """

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = _aligner(path_a, path_b)
        names = itertools.count(TaskContext.get().partitionId() << 32)
        chunk = _Chunk(next(names), aligner)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                ids, texts = some.column(0).to_pylist(), some.column(1).to_pylist()
                for at, end in text_slices([t or "" for t in texts], 500_000):
                    chunk.add(ids[at:end], texts[at:end])
                    if chunk.bytes >= chunk_bytes:
                        yield from chunk.rows()
                        chunk = _Chunk(next(names), aligner)
        yield from chunk.rows()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = saved(base.mapInArrow(chunked, f"{CHUNK}, {ASKED}"), "aligned")
    texts = both.filter("ids is not null").drop("code", "n")
    asked = both.filter("code is not null").select("chunk", "code", "n")
    counts = saved(asked.groupBy("code").agg(F.sum("n").alias("count")), "pair-counts")
    b_id = F.col("code").bitwiseAND((1 << SHIFT) - 1)
    highest = saved(counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("highest")), "highest-counts")
    graded = counts.withColumn("b", b_id).join(highest, "b").select("code", "count", (F.col("count") == F.col("highest")).alias("best"))
    # Stored, so that the join deals out both sides and can split.
    graded = saved(graded, "graded-pairs")
    answers = asked.select(F.col("chunk").alias("asker"), "code").join(graded, "code")
    discard(counts, highest)

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {f.split()[0]: [] for f in FOUND.split(", ")}
        order = np.argsort(right.column("code").to_numpy())
        count = right.column("count").to_numpy()[order]
        best = right.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        for row in left.to_pylist():
            at, place, sizes = (_unpack(row[k]) for k in ("segments", "places", "n_places"))
            of = np.r_[0, np.cumsum(sizes)]
            ends = np.cumsum(np.array(row["n_segments"], np.int64))
            for name, values in (("n_best", best), ("count_sum", count)):
                each = np.r_[0, np.cumsum(values[place])]
                sums = np.r_[0, np.cumsum((each[of[1:]] - each[of[:-1]])[at])]
                out[name] += (sums[ends] - sums[np.r_[0, ends[:-1]]]).tolist()
            for to, name in (("doc_id", "ids"), ("n_a", "n_a"), ("n_b", "n_b"), ("n_groups", "n_groups"), ("n_links", "n_links"), ("groups_sha256", "groups")):
                out[to] += row[name]
        kinds = {f.split()[0]: pa.string() if f.endswith("string") else pa.int64() for f in FOUND.split(", ")}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return texts.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(finish, FOUND)
