"""Paths: extensions, globs, normal forms, common prefixes and dates."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_lower

# Extensions of multi-line and single-line text, of page formats and of convertible formats.
MULTI_LINE = ("txt", "md", "pdf", "epub", "odt", "docx", "fb2", "ipynb", "html", "htm")
SINGLE_LINE = ("log", "csv", "tsv")
PDF = (".pdf",)
CONVERTIBLE = (".epub", ".odt", ".docx", ".fb2", ".ipynb", ".html", ".htm")
# Months.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def extension(path: Column) -> Column:
    """From the last dot of the last part on, in lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def py_extension(path: str) -> str:
    m = re.search(r"\.[^./]*$", path)
    return m[0].lower() if m else ""


def extension_list(text: str) -> list[str]:
    """Extensions of a comma-separated list, trimmed, without leading dots, in lower case, none empty."""
    return [e for e in (py_lower(x.strip()).lstrip(".") for x in text.split(",")) if e]


def file_format(path: Column) -> Column:
    ext = extension(path)
    texts = [f".{e}" for e in (*MULTI_LINE, *SINGLE_LINE) if f".{e}" not in PDF + CONVERTIBLE]
    return F.when(ext.isin(*PDF), "pdf").when(ext.isin(*CONVERTIBLE), "convertible").when(ext.isin(*texts), "text").otherwise("other")


def normalize(path: str, cwd: str = "/") -> str:
    """Absolute, without ``.``, ``..`` and repeated slashes, by the text alone."""
    out = posixpath.normpath(posixpath.join(cwd, path))
    return "/" + out.lstrip("/")


def folded(path: Column) -> Column:
    """A path column without ``.``, ``..`` and repeated slashes, by the text alone: parts are laid on a stack, and ``..``
    takes the last one off. Nothing is above the root; a relative path keeps those ``..`` that lead out of it."""
    absolute = path.startswith("/")
    keep = lambda stack, part: F.concat(stack, F.array(part))
    up = lambda stack: F.when((F.size(stack) > 0) & (F.element_at(stack, -1) != ".."), F.slice(stack, 1, F.size(stack) - 1)).when(absolute, stack).otherwise(keep(stack, F.lit("..")))
    step = lambda stack, part: F.when(part.isin("", "."), stack).when(part == "..", up(stack)).otherwise(keep(stack, part))
    parts = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(parts, "/"))


def relative(path: Column, cwd: str) -> Column:
    root = cwd.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path)


def common_prefix(strings: Column) -> Column:
    """Longest common prefix of an array of strings: that of its least and its greatest."""
    lo, hi = F.array_min(strings), F.array_max(strings)
    n = F.least(F.char_length(lo), F.char_length(hi))
    sizes = F.sequence(F.lit(0), n)
    return F.substring(lo, F.lit(1), F.array_max(F.filter(sizes, lambda k: F.substring(lo, F.lit(1), k) == F.substring(hi, F.lit(1), k))))


def glob_regex(pattern: str) -> tuple[str, bool]:
    """A glob as an anchored regular expression, and whether case counts.

    ``*`` and ``?`` stop at slashes, ``**`` doesn't; a leading dot of a part must be written; ``[...]`` is a set with
    ``!`` or ``^`` for its complement; ``\\c`` anywhere ignores case; another ``\\x`` is x itself. An empty pattern
    matches everything.
    """
    case = glob_parts(pattern)[1]
    if glob_parts(pattern)[0] == [""]:
        return ".*", case
    out, i, start = [], 0, True
    while i < len(pattern):
        c = pattern[i]
        dot = r"(?!\.)" if start else ""
        start = False
        if c == "\\" and i + 1 < len(pattern):
            i += 2
            if pattern[i - 1] == "c":
                start = dot != ""
            else:
                out.append(re.escape(pattern[i - 1]))
            continue
        if pattern.startswith("**", i):
            while pattern.startswith("*", i):
                i += 1
            if pattern.startswith("/", i):
                out.append(rf"(?:{dot}[^/]+/)*" if dot else "(?:.*/)?")
                i, start = i + 1, True
            else:
                out.append(rf"{dot}(?:(?!/\.).)*")
            continue
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(f"{dot}[^/]*")
        elif c == "?":
            out.append(f"{dot}[^/]")
        elif close > 0:
            inner = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            inner = "^/" + inner[1:] if inner[0] in "!^" else inner
            out.append(f"{dot}[{inner}]")
            i = close
        else:
            out.append(re.escape(c))
            start = c == "/"
        i += 1
    return "^" + "".join(out) + "$", case


def glob_parts(pattern: str) -> tuple[list[str], bool]:
    """A glob's parts between slashes, without marks for case, and whether case counts."""
    marks = re.compile(r"\\(.)", re.DOTALL)
    bare = marks.sub(lambda m: "" if m[1] == "c" else m[0], pattern)
    return bare.split("/"), "c" not in marks.findall(pattern)


def glob_match(path: Column, pattern: str) -> Column:
    regex, case = glob_regex(pattern)
    return path.rlike(regex if case else "(?i)" + regex)


def _dates() -> list[tuple[str, str, str, str]]:
    """Patterns of dates in names: (regular expression, year, month, day group), in order of preference."""
    year, month, day = r"(\d{4})", r"([01]\d)", r"([0-3]\d)"
    end, sep, gap = r"(?:$|\D)", r"\D", "[^A-Za-z0-9]?"
    out = [(year + sep + month + sep + day + end, "1", "2", "3")]
    for names in ("|".join(m[:3] for m in MONTHS), "|".join(MONTHS)):
        out.append((f"{day}{gap}({names}){gap}{year}{end}", "3", "2", "1"))
        out.append((f"{year}{gap}({names}){gap}{day}{end}", "1", "2", "3"))
    return [*out, (year + month + day, "1", "2", "3")]


def path_date(path: Column) -> Column:
    """The date in a path: the match that starts furthest right, the earlier pattern of equals; null if it isn't a date.

    Forms: yyyy mm dd with one other character (no digit) at both places, dd month yyyy and yyyy month dd with a month's name
    or its first three letters and at most one such character at each, and yyyymmdd. No digit may stand before a date, nor
    after one of the first kinds. Of one pattern, a date at the very start goes before others.
    """
    found = []
    for i, (regex, y, m, d) in enumerate(_dates()):
        whole = rf"(?is)(^|.*\D){regex}"
        groups = [F.regexp_extract(path, whole, int(g) + 1) for g in (y, m, d)]
        month = F.lower(F.substring(groups[1], 1, 3))
        number = F.array_position(F.array(*(F.lit(x[:3]) for x in MONTHS)), month).cast("string")
        month = F.when(month.rlike("[a-z]"), F.lpad(number, 2, "0")).otherwise(month)
        start = F.when(path.rlike(whole), F.char_length(F.regexp_extract(path, whole, 1)))
        found.append(F.struct(start.alias("start"), F.lit(-i).alias("order"), F.concat(groups[0], F.lit("-"), month, F.lit("-"), groups[2]).alias("text")))
    best = F.array_max(F.filter(F.array(*found), lambda x: x["start"].isNotNull()))
    return F.try_to_date(best["text"], "yyyy-MM-dd")
