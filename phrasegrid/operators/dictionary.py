"""Words that may fit a search word, found by keys: a stored table of the words' pairs of letters, and the sorted dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Words of up to so many characters have their single characters as keys, too.
SHORT = 7
#: Search words of up to so many characters are compared with words that lie inside them by equality.
INSIDE = 24


def gram_rows(words: DataFrame) -> DataFrame:
    """(gram, at, size, word, word_ci, word_len): every pair of neighbouring characters of a word in lower case and where it
    stands, of short words each character, too. Words that start outside ASCII fit only their equals and have no keys."""
    plain = words.filter((F.col("word") != "") & (F.substring("word", 1, 1) < F.lit("\x80")) & ~F.col("word").startswith(" "))
    size = F.char_length("word_ci")
    rows = plain.select("word", "word_ci", "word_len", size.alias("size"), F.explode(F.sequence(F.lit(0), size - 1)).alias("at"))
    pair, single = (F.substring(F.col("word_ci"), F.col("at") + 1, F.lit(n)) for n in (2, 1))
    grams = F.when(F.col("at") == F.col("size") - 1, F.when(F.col("size") <= SHORT, F.array(single)).otherwise(F.array().cast("array<string>"))).when(F.col("size") <= SHORT, F.array(pair, single)).otherwise(F.array(pair))
    return rows.select(F.explode(grams).alias("gram"), "at", "size", "word", "word_ci", "word_len")


def _apart(s: str, edits: int) -> Column | None:
    """Keys of words at most ``edits`` edits from ``s``: of edits + 1 pieces one is in the word as it is, and at most so far
    from its place. None if the pieces are too short to tell."""
    n, out = len(s), []
    cuts = [n * j // (edits + 1) for j in range(edits + 2)]
    for at, end in zip(cuts, cuts[1:], strict=False):
        if end == at or end - at == 1 and n + edits > SHORT:
            return None
        near = (F.col("gram") == s[at : min(end, at + 2)]) & F.col("at").between(at - edits, at + edits)
        out.append(near & F.col("size").between(n - edits, n + edits))
    return reduce(Column.__or__, out)


def keys(match: str, s: str | None, edits: int) -> tuple[Column | None, Column | None] | None:
    """Conditions on the table of keys and on the dictionary that together all words meet which fit a search word; None if
    only the whole dictionary will do."""
    if match == "spaces" or s is None:
        return None, F.col("word_ci").startswith(" ")
    ci = T.py_lower(s)
    if match in ("exact", "prefix"):
        own = F.col("word_ci") == ci if match == "exact" else F.col("word_ci").startswith(ci)
        return None, own
    same = F.col("word_ci") == ci
    if len(ci) < 2:
        return None
    if match == "suffix":
        return F.col("gram") == ci[-2:], same
    middle = len(ci) // 2 - 1
    grams = F.col("gram") == ci[middle : middle + 2]  # words that hold the search word
    if len(ci) <= INSIDE:
        inside = F.col("word_ci").isin(sorted({ci[a:b] for a in range(len(ci)) for b in range(a + 1, len(ci) + 1)}))
    else:
        inside = same
        grams = grams | F.col("gram").isin(sorted({ci[a : a + 2] for a in range(len(ci) - 1)})) & (F.col("at") == 0)
    if len(s.encode()) > edits:
        near = _apart(s, edits)
        if near is None:
            return None
        grams = grams | near
    return grams, inside


def possible(words: DataFrame, grams: DataFrame | None, asked: list[tuple[str, str | None]], edits: int) -> DataFrame:
    """(word, word_ci, word_len): all words of the dictionary that may fit any of the search words (match, word), each once."""
    found = [keys(match, s, edits) for match, s in asked]
    if grams is None or None in found:
        return words
    by_gram, by_word = ([x[i] for x in found if x[i] is not None] for i in (0, 1))
    columns = ["word", "word_ci", "word_len"]
    out = words.filter(reduce(Column.__or__, by_word)).select(*columns)
    if by_gram:
        out = out.unionByName(grams.filter(reduce(Column.__or__, by_gram)).select(*columns)).distinct()
    return out
