"""Byte-level BPE encoding and decoding with a two-tier lookup."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .pieces import LATIN_LETTERS, LATIN_NUMBERS, WHITE, PieceCoder, is_latin

_FACTOR = np.uint64(0x9E3779B97F4A7C15)

#: No match of the pre-tokenizer's pattern crosses such a place.
GAP = re.compile(f"(?<=[^{WHITE}])(?= [^{WHITE}])")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _hash(keys: Iterable[bytes], n: int) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, n)


class PerfectHash:
    """A minimal perfect hash of fixed keys by levels: n keys have the numbers 0 to n - 1.

    Each level hashes the keys left over to twice as many places; a key alone on its place takes the next number, the
    others go on. A look-up reads the levels in turn until a place is taken, and compares the key stored there.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        self.levels: list[np.ndarray] = []
        self.keys: list[bytes] = []
        self.values: list[int] = []
        left, h = np.arange(len(keys)), _hash(keys, len(keys))
        while len(left):
            at = self._place(h[left], len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left))[at] == 1
            numbers = np.full(2 * len(left), -1, np.int32)
            numbers[at[alone]] = len(self.keys) + np.arange(alone.sum())
            self.levels.append(numbers)
            self.keys += [keys[i] for i in left[alone]]
            self.values += [values[i] for i in left[alone]]
            left = left[~alone]

    def _place(self, h: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (h ^ np.uint64(level * 0xD1B54A32D192ED03 % 2**64)) * _FACTOR
        x = (x ^ (x >> np.uint64(32))) * _FACTOR
        return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int | None]:
        """The value of each key; None if it isn't one."""
        h = _hash(keys, len(keys))
        number = np.full(len(keys), -1, np.int32)
        for level, numbers in enumerate(self.levels):
            at = numbers[self._place(h, level, len(numbers))]
            number = np.where(number < 0, at, number)
        own, values = self.keys, self.values
        return [values[i] if i >= 0 and own[i] == k else None for i, k in zip(number.tolist(), keys, strict=True)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the pair of least rank merges first, the leftmost of equals, by a heap over linked parts."""
    n = len(piece)
    end, before, get = list(range(1, n + 1)), list(range(-1, n)), ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != e:  # a part of it has merged otherwise meanwhile
            continue
        end[i], end[j] = e, 0
        if e < n:
            before[e] = i
            if (r := get(piece[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        p = before[i]
        if p >= 0 and (r := get(piece[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Encodes and decodes by fixed ranks; every single byte must have one.

    ``pattern`` is the pre-tokenizer's. Texts of U+0000 to U+00FF are cut by an equal pattern with the classes written
    out, which a faster engine runs, if the pattern allows it.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.whole = PerfectHash(list(ranks), list(ranks.values()))
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.word_of = {v: str(v).encode() for v in ranks.values()}
        full = regex.compile(pattern)
        self.coder = PieceCoder(self._cutter(pattern, full), self._learn, GAP)

    @staticmethod
    def _cutter(pattern: str, full) -> Callable[[str], list[str]]:
        latin = _latin_form(pattern)
        if latin is None:
            return full.findall
        return lambda text: latin.findall(text) if is_latin(text) else full.findall(text)

    def _learn(self, new: list[str]) -> list[bytes]:
        pieces = [p.encode() for p in new]
        return [np.array([v] if v is not None else merge(p, self.ranks), "<u4").tobytes() for p, v in zip(pieces, self.whole.find(pieces), strict=True)]

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        for ids in self.coder.ids(texts):
            yield np.frombuffer(ids, "<u4").tolist()

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        """Number of ids, sha256 of their decimal words, sha256 of the bytes they decode to."""
        words = b" ".join(map(self.word_of.__getitem__, ids))
        return len(ids), hashlib.sha256(words).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def _latin_form(pattern: str) -> re.Pattern | None:
    """The pattern with its classes written out for U+0000 to U+00FF, if it has none but ``\\p{L} \\p{N} \\s \\S``."""
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{WHITE}{LATIN_LETTERS}{LATIN_NUMBERS}]")
    for name, chars in ((r"\p{L}", LATIN_LETTERS), (r"\p{N}", LATIN_NUMBERS), (r"\s", WHITE)):
        out = out.replace(name, f"[{chars}]")
    out = out.replace(r"\S", f"[^{WHITE}]")
    return None if "\\" in out or "[[" in out or "[^[" in out else re.compile(out)


_encoders: dict[tuple, Encoder] = {}


def shared_encoder(docs: DataFrame, path: str, pattern: str) -> Callable[[], Encoder]:
    """A function that gives a worker its encoder; the ranks are sent once, a vocabulary's fixed size."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    key = (path, pattern)

    def get() -> Encoder:
        if key not in _encoders:
            _encoders[key] = Encoder(ranks.value, pattern)
        return _encoders[key]

    return get


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, bytes): the ids of each whole text and the bytes they decode to. Null text has no ids."""
    encoder = shared_encoder(docs, path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in text_slices(texts, 1_000_000):
                all_ids = list(e.encode_all(texts[lo:hi]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(all_ids, pa.list_(pa.int32())), pa.array(map(e.decode, all_ids), pa.binary())], ["doc_id", "ids", "bytes"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, ids array<int>, bytes binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, over whole texts.

    Each match of ``pattern`` is encoded by itself: a minimal perfect hash finds those that are one token, a heap over
    linked bytes merges the others. Null text is empty (no ids); null ids stay null; repeated rows give a row each; an
    empty table gives no rows; other columns aren't read. No step keeps more than one text and a bounded memo.
    """
    encoder = shared_encoder(docs, path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = [e.digest(ids) for lo, hi in text_slices(texts, 1_000_000) for ids in e.encode_all(texts[lo:hi])]
            columns = zip(*rows, strict=True) if rows else [[], [], []]
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
