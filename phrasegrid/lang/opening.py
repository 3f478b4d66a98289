"""Commands to open documents with: templates by extension."""

from __future__ import annotations

import shlex
from dataclasses import dataclass

FIELDS = ("path", "page_num", "line_num", "search_word")


class OpeningError(ValueError):
    """The specification can't be used."""


@dataclass(frozen=True)
class Opening:
    ext: str
    kind: str  # foreground or terminal
    command: str


def _pieces(command: str) -> list[tuple[bool, str]]:
    """(is a field, text) in order; ``{{`` is a brace."""
    out, i, text = [], 0, ""
    while i < len(command):
        if command.startswith("{{", i):
            text, i = text + "{", i + 2
        elif command[i] == "{":
            end = command.find("}", i)
            if end < 0:
                raise OpeningError("unclosed {")
            name = command[i + 1 : end]
            if name not in FIELDS:
                raise OpeningError(f"unknown field: {name}")
            out += [(False, text), (True, name)]
            text, i = "", end + 1
        else:
            text, i = text + command[i], i + 1
    return [p for p in [*out, (False, text)] if p[1]]


def parse_opening(text: str) -> Opening:
    """``ext:kind=command``; page numbers are for PDF only, line numbers for the others."""
    head, equals, command = text.partition("=")
    ext, colon, kind = (x.strip().lower() for x in head.partition(":"))
    if not equals or not colon or not ext:
        raise OpeningError("expected ext:kind=command")
    ext = ext.lstrip(".")
    if kind not in ("foreground", "terminal", "background", "detached"):
        raise OpeningError(f"unknown kind: {kind}")
    names = {n for is_field, n in _pieces(command) if is_field}
    if "path" not in names:
        raise OpeningError("the command has no {path}")
    if ext == "pdf" and "line_num" in names or ext != "pdf" and {"page_num", "search_word"} & names:
        raise OpeningError("a field doesn't fit the extension")
    return Opening("." + ext, kind, command)


def fill(opening: Opening, values: dict[str, str | int]) -> str:
    """The command with shell-quoted values; a missing page, line or word is 1 or empty."""
    given = {"page_num": 1, "line_num": 1, "search_word": ""} | values
    return "".join(shlex.quote(str(given[text])) if is_field else text for is_field, text in _pieces(opening.command))
