"""Tokens, words and the predicates between a search word and an indexed one, as columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Runs of ASCII letters and digits, runs of blanks, or single characters; long runs come in pieces of 500.
TOKEN = r"[A-Za-z0-9]{1,500}|[ \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{205F}\x{3000}]{1,500}|(?s:.)"
_PY_TOKEN = re.compile("[A-Za-z0-9]{1,500}|[   -  -  　]{1,500}|.", re.DOTALL)
#: The same by parts: blanks, and characters of a piece.
BLANKS = " \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a\u205f\u3000"
LONGEST = 500


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(c, UPPER, LOWER)


def py_lower(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def sanitize(c: Column) -> Column:
    """Control characters and what stands for undecodable bytes become spaces."""
    return F.regexp_replace(c, "[\\x00-\\x1F\\x7F�]", " ")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(sanitize(c), F.lit(TOKEN), F.lit(0))


def py_tokens(s: str) -> list[str]:
    return _PY_TOKEN.findall(re.sub("[\x00-\x1f\x7f�]", " ", s))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def lines(text: Column) -> Column:
    """Lines of a text; none of an empty one, and no empty one after a final line feed."""
    return let(F.split(text, "\r?\n", -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def is_space(w: str) -> bool:
    return w[:1] in (" ", "\t", "\n", "\r") and w != ""


def size(c: Column) -> Column:
    return F.octet_length(c)


def matches(kind: str, s: str, w: Column, wci: Column, max_edits: int = 2) -> Column:
    """Whether an indexed word ``w`` (``wci`` in lower case) fits a search word, by kind of match.

    kind: fuzzy, exact, prefix, suffix or spaces. All but fuzzy are case-sensitive if ``s`` has capitals. Words that start
    outside ASCII must be equal, whatever the kind.
    """
    if kind == "spaces":
        return w.startswith(" ")
    ci = py_lower(s)
    if kind == "fuzzy":
        k = max_edits + 1
        near = F.lit(False)
        if len(s.encode()) >= k:
            near = (size(w) >= k) & F.substring(wci, 1, 3).contains(ci[:1]) & (F.levenshtein(F.lit(s), wci, max_edits) >= 0)
        fit = wci.contains(ci) | ((size(w) >= 2) & F.lit(ci).contains(wci)) | near
    else:
        side, own = (wci, ci) if s == ci else (w, s)
        fit = {"exact": side == own, "prefix": side.startswith(own), "suffix": side.endswith(own)}[kind]
    plain = F.substring(w, 1, 1) < F.lit("\x80")
    out = (w != "") & F.when(plain, fit).otherwise(w == s)
    # Implied by the above, and a condition that a sorted table can be searched by.
    return out & (wci == ci) if kind == "exact" else out & wci.startswith(ci) if kind == "prefix" else out
