"""Texts to token ids by way of pieces: a bounded memo for those seen, batches for those that are new."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: Characters of a text that are cut into pieces at a time.
SEGMENT = 1_000_000

# The letters and numbers of U+0000 to U+00FF, and Unicode white space.
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LATIN_NUMBERS = "0-9²³¹¼½¾"
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def is_latin(text: str) -> bool:
    """Whether all characters are in U+0000 to U+00FF."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def segments(text: str, gap: re.Pattern, size: int = SEGMENT) -> Iterator[str]:
    """The text in parts of about ``size`` characters, each but the first starting where ``gap`` matches."""
    at = 0
    while len(text) - at > size and (m := gap.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class PieceCoder:
    """Encodes texts as the joined ids (bytes) of their pieces.

    ``cut`` gives a text's pieces; ``learn`` the ids of new pieces, many at a time. At most ``most`` pieces are kept;
    beyond, the memo starts afresh, so results never depend on it. Long pieces aren't kept.
    """

    def __init__(self, cut: Callable[[str], list[str]], learn: Callable[[list[str]], list[bytes]], gap: re.Pattern, most: int = 1_000_000, longest: int = 100):
        self.cut, self.learn, self.gap, self.most, self.longest = cut, learn, gap, most, longest
        self.memo: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; texts together should be a few million characters at most, or one."""
        out = []
        held: list[list[str]] = []
        for text in texts:
            if len(text) > SEGMENT:
                out += self._resolve(held)
                held = []
                out.append(b"".join(self._resolve([self.cut(part)])[0] for part in segments(text, self.gap)))
            else:
                held.append(self.cut(text))
        return out + self._resolve(held)

    def _resolve(self, cuts: list[list[str]]) -> list[bytes]:
        memo = self.memo
        found = [list(map(memo.get, pieces)) for pieces in cuts]
        new = {p for pieces, ids in zip(cuts, found, strict=True) if None in ids for p, i in zip(pieces, ids, strict=True) if i is None}
        if new:
            new = list(new)
            learnt = dict(zip(new, self.learn(new), strict=True))
            found = [[learnt[p] if i is None else i for p, i in zip(pieces, ids, strict=True)] if None in ids else ids for pieces, ids in zip(cuts, found, strict=True)]
            if len(memo) + len(new) > self.most:
                memo.clear()
            memo.update((p, i) for p, i in learnt.items() if len(p) <= self.longest)
        return [b"".join(ids) for ids in found]
