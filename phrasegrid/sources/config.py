"""Configuration files: one argument a line."""

from __future__ import annotations

import os


def find_config(start: str, name: str = ".phrasegrid", home: str | None = None) -> str | None:
    """The nearest file of that name in a folder or above, else the user's."""
    at = os.path.abspath(start)
    while True:
        if os.path.isfile(path := os.path.join(at, name)):
            return path
        if at == os.path.dirname(at):
            break
        at = os.path.dirname(at)
    base = home or os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    path = os.path.join(base, name.lstrip("."), "config")
    return path if os.path.isfile(path) else None


def read_config(path: str) -> list[str]:
    """Arguments of a file: lines trimmed, blank ones and those that start with # left out."""
    with open(path) as f:
        return [x for x in map(str.strip, f) if x and not x.startswith("#")]


def with_config(argv: list[str], cwd: str) -> list[str]:
    """Arguments with those of the configuration first: ``--config FILE`` names it, ``--no-config`` has none."""
    if "--no-config" in argv:
        return [a for a in argv if a != "--no-config"]
    for i, a in enumerate(argv):
        if a == "--config" and i + 1 < len(argv):
            return read_config(argv[i + 1]) + argv[:i] + argv[i + 2 :]
        if a.startswith("--config="):
            return read_config(a.partition("=")[2]) + argv[:i] + argv[i + 1 :]
    found = find_config(cwd)
    return (read_config(found) if found else []) + argv
