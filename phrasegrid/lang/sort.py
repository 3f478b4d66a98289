"""Sort specifications: ``TYPE,ORDER``."""

from __future__ import annotations

from dataclasses import dataclass

TYPES = ("path", "path-date", "mod-time", "score", "fuzzy-ranking")


class SortError(ValueError):
    """The specification can't be read."""


@dataclass(frozen=True)
class SortBy:
    by: str
    descending: bool = False

    def __str__(self) -> str:
        return f"{self.by},{'desc' if self.descending else 'asc'}"


def parse_sort(text: str, no_score: bool = False) -> SortBy:
    by, comma, order = (x.strip().lower() for x in text.partition(","))
    if not comma:
        raise SortError("expected TYPE,ORDER")
    if by not in TYPES[:4]:
        raise SortError(f"unrecognized sort type: {by}")
    if by == "score" and no_score:
        raise SortError("score can't be used without a search")
    if order not in ("asc", "desc"):
        raise SortError(f"unrecognized sort order: {order}")
    return SortBy(by, order == "desc")


def parse_sorts(text: str) -> tuple[SortBy, SortBy]:
    """``with search; without search``."""
    first, semi, second = text.partition(";")
    if not semi:
        raise SortError("expected two sort keys with ; between")
    return parse_sort(first), parse_sort(second, no_score=True)
