"""The relevance score of a match as one column expression."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..lang.search import Phrase


def phrase_brackets(phrase: Phrase) -> list[tuple[int, int]]:
    """Token numbers of the matching brackets inside a phrase, each kind by itself."""
    pairs, open_at = [], {c: [] for c in "([{"}
    for i, t in enumerate(phrase):
        if t.word in open_at:
            open_at[t.word].append(i)
        elif t.word in (")", "]", "}") and open_at[{")": "(", "]": "[", "}": "{"}[t.word]]:
            pairs.append((open_at[{")": "(", "]": "[", "}": "{"}[t.word]].pop(), i))
    return pairs


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


#: Kinds of match of a search and a found word, by number: the first that fits counts.
KINDS = ("exact", "ci_exact", "sf", "fs", "ci_sf", "ci_fs", "edits")
EXACT, CI_EXACT, SF, FS, CI_SF, CI_FS, EDITS = range(7)
#: Bits of a match's code: the kind, the found word's size in bytes, and the edits.
KIND_BITS, SIZE_BITS = 3, 14
SAME_CASE, INSIDE = 1.10, 0.8


def match_code(s: str | None, w: Column, wci: Column) -> Column:
    """A pair of search word and found word as one number: kind, size of the found word, edits. Explicit spaces are exact,
    and of size 1 whatever their length."""
    if s is None:
        return F.lit(EXACT | 1 << KIND_BITS)
    ci = T.py_lower(s)
    kind = (
        F.when(w == s, EXACT).when(wci == ci, CI_EXACT).when(w.contains(s), SF).when(F.lit(s).contains(w), FS)
        .when(wci.contains(ci), CI_SF).when(F.lit(ci).contains(wci), CI_FS).otherwise(EDITS)
    )
    edits = F.when(kind == EDITS, F.levenshtein(F.lit(ci), wci)).otherwise(0)
    return kind.bitwiseOR(F.shiftleft(T.size(w), KIND_BITS)).bitwiseOR(F.shiftleft(edits, KIND_BITS + SIZE_BITS)).cast("int")


def _decoded(code: int) -> tuple[int, int]:
    """Kind and size of the found word."""
    return code & (1 << KIND_BITS) - 1, code >> KIND_BITS & (1 << SIZE_BITS) - 1


@dataclass(frozen=True)
class Match:
    """Where a token's word was found, and the pair's code; null past a phrase's end."""

    pos: Column
    code: Column

    @property
    def kind(self) -> Column:
        return self.code.bitwiseAND((1 << KIND_BITS) - 1)

    @property
    def size(self) -> Column:
        return F.shiftright(self.code, KIND_BITS).bitwiseAND((1 << SIZE_BITS) - 1)

    @property
    def edits(self) -> Column:
        return F.shiftright(self.code, KIND_BITS + SIZE_BITS)


def _sums(own: list[Column], found: list[Match]) -> dict[str, Column]:
    """Sums over the pairs: found sizes, and of each kind the size it counts by (the search word's where that lies inside)."""
    add = lambda value, kind: reduce(Column.__add__, (F.coalesce(F.when(m.kind == kind, value(o, m)), F.lit(0)) for o, m in zip(own, found, strict=True))).cast("double")
    by_found, by_own = (lambda o, m: m.size), (lambda o, m: o)
    out = {name: add(by_own if k in (SF, CI_SF) else by_found, k) for k, name in enumerate(KINDS) if k != EDITS}
    out |= {"fuzzy_s": add(by_own, EDITS), "fuzzy_f": add(by_found, EDITS), "edits": add(lambda o, m: m.edits, EDITS)}
    return out | {"f": reduce(Column.__add__, (F.coalesce(m.size, F.lit(0)) for m in found)).cast("double")}


def search_size(phrase: Phrase) -> dict[str, float]:
    """What a score takes from the phrase alone: tokens, bytes of the search words, and the weight of case."""
    s = sum(1 if t.word is None else len(t.word.encode()) for t in phrase)
    return {"n": float(len(phrase)), "s": float(s), "case": SAME_CASE if any(t.word and re.search("[A-Z]", t.word) for t in phrase) else 1.0}


def score(size: Column, own: list[Column], found: list[Match], brackets: Column | int = 0, max_dist: int = 50) -> Column:
    """Score of the words found for a phrase's tokens: ``size`` as of :func:`search_size`, ``own`` the search words' sizes.

    Each pair of search and found word adds to the first kind it fits: equal, equal but for case, one inside the other
    (both ways, with and without case), else by edits. Closeness, order, distinct places and brackets scale the sum.
    Matches past the phrase's end are null.
    """
    n, s, case, sums = size["n"], size["s"], size["case"], _sums(own, found)
    total = s + sums["f"]
    pos = [m.pos for m in found]
    distinct = F.size(F.array_distinct(F.array_compact(F.array(*pos))))
    steps = list(zip(pos, pos[1:], strict=False))
    dist = sum((F.coalesce(F.abs(b - a), F.lit(0)) for a, b in steps), F.lit(0))
    back = sum((F.when(b < a, 1).otherwise(0) for a, b in steps), F.lit(0))
    mean = F.when(distinct == 1, 0.0).otherwise(dist / F.greatest(distinct - 1, F.lit(1)))
    near = F.when(mean <= 1, 1.0).otherwise(1 - 0.20 * mean / max_dist)
    parts = (
        case * 2 * _ratio(sums["exact"], total)
        + 2 * _ratio(sums["ci_exact"], total)
        + case * _ratio(sums["sf"], sums["f"])
        + case * INSIDE * _ratio(sums["fs"], s)
        + _ratio(sums["ci_sf"], sums["f"])
        + INSIDE * _ratio(sums["ci_fs"], s)
        + F.when(sums["fuzzy_s"] > 0, 2 * _ratio(sums["fuzzy_f"], total) * (1 - _ratio(sums["edits"], sums["fuzzy_s"]))).otherwise(0.0)
    )
    b = F.lit(brackets) if isinstance(brackets, int) else brackets
    return (1 + 0.1 * n) * (1 + 0.1 * distinct / n) * (1 - 0.1 * back / n) * (1 + 0.1 * b) * near * parts


@dataclass(frozen=True)
class Bound:
    """What limits the score of a chain that has some of a phrase's words: the phrase's own sizes, and for each token the least
    size of its words and the most that one adds over each of the three denominators."""

    n: int
    s: float
    case: float
    own: tuple[float, ...]
    least: tuple[float, ...]
    total: tuple[float, ...]
    found: tuple[float, ...]
    search: tuple[float, ...]
    brackets: int

    @staticmethod
    def of(phrase: Phrase, codes: list[list[int] | None]) -> Bound:
        """``codes`` of all words that each token fits, None if they are too many to know."""
        size = search_size(phrase)
        case, own = size["case"], [1.0 if t.word is None else float(len(t.word.encode())) for t in phrase]
        columns = []
        for o, known in zip(own, codes, strict=True):
            if known is None:  # an edit adds one character at most
                columns.append((1.0, 2 * case * (o + 16), case * o, case * INSIDE * o))
                continue
            least, total, found, search = math.inf, 0.0, 0.0, 0.0
            for kind, f in set(map(_decoded, known)):
                least = min(least, f)
                total = max(total, {EXACT: 2 * case * f, CI_EXACT: 2 * f, EDITS: 2 * f}.get(kind, 0))
                found = max(found, {SF: case * o, CI_SF: o}.get(kind, 0))
                search = max(search, {FS: case * INSIDE * f, CI_FS: INSIDE * f}.get(kind, 0))
            columns.append((0.0 if least == math.inf else float(least), total, found, search))
        return Bound(len(phrase), size["s"], case, tuple(own), *map(tuple, zip(*columns, strict=True)), len(phrase_brackets(phrase)))

    def most(self, found: list[Match], max_dist: int = 50) -> Column:
        """No completion of the first words ``found`` scores higher: sizes to come are the least, gains the most, and they
        stand next to each other, in order, at places of their own, and all brackets match."""
        k = len(found)
        sums = _sums([F.lit(o) for o in self.own[:k]], found)
        f = F.greatest(sums["f"] + sum(self.least[k:]), F.lit(1.0))
        total = f + self.s
        fuzzy_s = sums["fuzzy_s"] + sum(self.own[k:])
        kept = F.greatest(F.lit(0.0), 1 - F.when(fuzzy_s > 0, sums["edits"] / fuzzy_s).otherwise(0.0))
        parts = (
            (2 * self.case * sums["exact"] + 2 * sums["ci_exact"] + 2 * sums["fuzzy_f"] * kept + sum(self.total[k:])) / total
            + (self.case * sums["sf"] + sums["ci_sf"] + sum(self.found[k:])) / f
            + (self.case * INSIDE * sums["fs"] + INSIDE * sums["ci_fs"] + sum(self.search[k:])) / self.s
        )
        pos = [m.pos for m in found]
        steps = list(zip(pos, pos[1:], strict=False))
        distinct = F.size(F.array_distinct(F.array(*pos))) + (self.n - k)
        back = sum((F.when(b < a, 1).otherwise(0) for a, b in steps), F.lit(0))
        mean = sum((F.abs(b - a) for a, b in steps), F.lit(0)) / max(self.n - 1, 1)
        near = F.when(mean <= 1, 1.0).otherwise(1 - 0.20 * mean / max_dist)
        return (1 + 0.1 * self.n) * (1 + 0.1 * distinct / self.n) * (1 - 0.1 * back / self.n) * (1 + 0.1 * self.brackets) * near * parts


def candidate_score(s: str, w: Column, wci: Column) -> Column:
    """How well a first word fits by itself, for keeping the best."""
    ci, ls = T.py_lower(s), float(len(s.encode()))
    return (
        F.when(w == s, 1.0).when(wci == ci, 0.9).when(w.contains(s), ls / T.size(w)).when(wci.contains(ci), 0.9 * ls / T.size(w))
        .otherwise(1 - F.levenshtein(F.lit(ci), wci) / ls)
    )
