"""A folder of saved scripts."""

from __future__ import annotations

import os

from ..lang.command import parse_script

EXTENSION = ".script"


def script_dir(given: str | None = None) -> str:
    base = os.environ.get("XDG_DATA_HOME") or os.path.expanduser("~/.local/share")
    return given or os.path.join(base, "phrasegrid", "scripts")


def list_scripts(folder: str) -> list[str]:
    """Names of the scripts in a folder, without those below it; none if it isn't there."""
    if not os.path.isdir(folder):
        return []
    return sorted(n for n in os.listdir(folder) if n.endswith(EXTENSION) and os.path.isfile(os.path.join(folder, n)))


def find_script(name: str, folder: str) -> str:
    """The path of a script: a file of that name, else one in the folder, its extension left out or not."""
    for path in (name, os.path.join(folder, name), os.path.join(folder, name + EXTENSION)):
        if os.path.isfile(path):
            return path
    raise ValueError(f"no script {name}")


def save_script(name: str, text: str, folder: str) -> str:
    """Writes commands under a name, if they can be read; the path."""
    if os.path.basename(name) != name or not name.removesuffix(EXTENSION):
        raise ValueError(f"not a script's name: {name}")
    parse_script(text)
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name.removesuffix(EXTENSION) + EXTENSION)
    with open(path, "w") as f:
        f.write(text)
    return path
