"""Fill-in-middle transformation: texts cut at unit boundaries into prefix, middle and suffix, and put together again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices, whole

#: Marks of prefix, suffix and middle. The first character of each stands nowhere else in any of them.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, those that stay plain, and of the others those whose suffix comes first.
PLAIN, SPM = 10, 20

MADE = "form string, n long, prefix_chars long, middle_chars long, output binary"
_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())


def char_classes(points: np.ndarray) -> np.ndarray:
    """Every code point is a unit."""
    return np.arange(len(points)) & 1


def word_classes(points: np.ndarray) -> np.ndarray:
    """Units are runs of white space (ASCII) and runs of other code points."""
    return (points == 32) | ((points >= 9) & (points <= 13))


def line_classes(points: np.ndarray) -> np.ndarray:
    """Units are lines with their line feeds."""
    return np.r_[0, np.cumsum(points[:-1] == 10)] if len(points) else points


UNITS = {"char": char_classes, "word": word_classes, "line": line_classes}


def boundaries(points: np.ndarray, unit: str = "char") -> np.ndarray:
    """Where units begin, and the end: places where neighbouring code points are of different classes."""
    if not len(points):
        return np.zeros(1, np.int64)
    classes = UNITS[unit](points)
    return np.r_[0, np.flatnonzero(classes[1:] != classes[:-1]) + 1, len(points)]


def cut(text: bytes, ranks: tuple[int, int], unit: str = "char") -> tuple[int, list[bytes]]:
    """The number of code points, and prefix, middle and suffix between the boundaries that the two numbers choose.

    Bytes that aren't UTF-8 are a code point each, and come back as they are.
    """
    points = np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")
    at = boundaries(points, unit)
    lo, hi = sorted(int(at[r % len(at)]) for r in ranks)
    piece = lambda x: x.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")
    return len(points), [piece(points[:lo]), piece(points[lo:hi]), piece(points[hi:])]


def _check(marks: tuple[str, str, str]) -> None:
    """Marks must be found again in any output, so none may overlap another or a text's end."""
    if len(set(marks)) < 3 or any(not m or any(m.find(x[0], 1) >= 0 for x in marks) for m in marks) or any(a != b and a.startswith(b) for a in marks for b in marks):
        raise ValueError("marks must differ, and their first characters stand at their beginnings only")


def fill_in_middle(
    docs: DataFrame, seed: int = 1, marks: tuple[str, str, str] = MARKS, plain: int = PLAIN, spm: int = SPM, unit: str = "char", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output.

    ``n`` counts code points. Four numbers come from the sha256 of ``seed:doc_id``: the first two choose the boundaries of
    units (char, word or line) where the prefix and the middle end, the third whether the text stays ``plain``, the fourth
    whether the suffix comes first (spm: suffix, prefix, middle) or not (psm: prefix, suffix, middle), each after its mark.

    Empty texts and texts with a mark stay plain; null text is empty, and a null id counts as the empty text in the hash.
    plain rows have null prefix_chars and middle_chars. Repeated rows give a row each, alike. An empty table gives no rows;
    other columns aren't read. Nothing is shuffled; a task holds some megabytes of texts, or one longer text.
    """
    _check(marks)
    p, s, m = (x.encode() for x in marks)

    def one(key: bytes, text: bytes) -> tuple:
        h1, h2, h3, h4 = np.frombuffer(key, ">u4")[:4].tolist()
        n, (prefix, middle, suffix) = cut(text, (h1, h2), unit)
        if not text or h3 % 100 >= 100 - plain or p in text or s in text or m in text:
            return "plain", n, None, None, text
        length = lambda x: len(x.decode("utf-8", "surrogateescape"))
        form, parts = ("spm", (s, suffix, p, prefix, m, middle)) if h4 % 100 < spm else ("psm", (p, prefix, s, suffix, m, middle))
        return form, n, length(prefix), length(middle), b"".join(parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(2).to_pylist()]
            for lo, hi in text_slices(texts):
                keys = b.column(1).slice(lo, hi - lo).to_pylist()
                columns = zip(*map(one, keys, texts[lo:hi]), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], ["doc_id", *(x.split()[0] for x in MADE.split(", "))])

    doc_id = F.col(id_col).cast("long")
    key = F.unhex(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256))
    rows = docs.select(doc_id.alias("doc_id"), key.alias("key"), F.col(text_col).cast("binary").alias("text"))
    made = rows.mapInArrow(work, f"doc_id long, {MADE}")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of."""
    _check(marks)
    p, s, m = map(F.lit, marks)
    after = lambda mark: F.split_part(output, mark, F.lit(2))
    before = lambda text, mark: F.split_part(text, mark, F.lit(1))
    middle = after(m)
    psm = F.concat(before(after(p), s), middle, before(after(s), m))
    spm = F.concat(before(after(p), m), middle, before(after(s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, and the sha256 of the output and of the text
    restored from it."""
    made = fill_in_middle(docs, **options)
    marks = options.get("marks", MARKS)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(whole("output"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form"), marks), 256).alias("restored_sha256"),
    )
