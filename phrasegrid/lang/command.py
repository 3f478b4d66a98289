"""Session commands as text, one a line."""

from __future__ import annotations

from dataclasses import dataclass

from .sort import parse_sorts

#: Commands without an argument, and with one.
PLAIN = (
    "clear search", "clear filter", "mark listed", "unmark listed", "unmark all", "drop listed", "drop unlisted", "drop marked", "drop unmarked",
)
WITH_TEXT = ("search", "filter", "narrow level", "mark", "unmark", "drop", "drop all except", "sort by", "path fuzzy rank", "focus", "split screen", "hide-pane", "show-pane")


class CommandError(ValueError):
    """The line isn't a command."""


@dataclass(frozen=True)
class Command:
    name: str
    text: str = ""

    def __str__(self) -> str:
        if self.name == "comment":
            return f"# {self.text}" if self.text else "#"
        return f"{self.name}: {self.text}" if self.name in WITH_TEXT else self.name


def parse_command(line: str) -> Command:
    line = line.strip()
    if line.startswith("#"):
        return Command("comment", line[1:].strip())
    bare = " ".join(line.lower().split())
    if bare in PLAIN:
        return Command(bare)
    name, colon, text = line.partition(":")
    name, text = " ".join(name.lower().split()), text.strip()
    if not colon or name not in WITH_TEXT:
        raise CommandError(f"unknown command: {line}")
    if name == "narrow level" and not (len(text) == 1 and text.isdigit()):
        raise CommandError("narrow level takes a digit")
    if name == "sort by":
        text = "; ".join(map(str, parse_sorts(text)))
    elif name not in ("search", "filter", "path fuzzy rank") and not text:
        raise CommandError(f"{name} takes an argument")
    return Command(name, text)


def parse_script(text: str) -> list[Command]:
    """Commands of a script; blank lines and those that start with ; are skipped, errors name the line."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        if line.strip() and not line.lstrip().startswith(";"):
            try:
                out.append(parse_command(line))
            except ValueError as e:
                raise CommandError(f"line {n}: {e}") from e
    return out
