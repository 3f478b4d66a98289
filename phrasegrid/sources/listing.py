"""File trees listed by tasks: the folders of a level are a table, and what is in them the next one.

The rules are those of :mod:`.files`: links are followed, hidden names are for the top or on request, what can't be read is
passed over. Only patterns and the number of levels are on the driver, no names but those that were given.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.store import stored
from ..params import DEFAULTS, Params

ENTRIES = "base string, path string, name string, folder boolean"


def _kinds(rows: list[tuple[str, str, str]]) -> pd.DataFrame:
    """(base, path, name, folder) of what is a file or a folder."""
    out = [(base, path, name, os.path.isdir(path)) for base, path, name in rows if os.path.isfile(path) or os.path.isdir(path)]
    return pd.DataFrame(out, columns=["base", "path", "name", "folder"])


def _given(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """The paths of a list that are there; each is its own base."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _kinds([(p, p, os.path.basename(p.rstrip("/"))) for p in b["path"]])

    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return rows.mapInPandas(look, ENTRIES)


def _inside(folders: DataFrame, fits: Callable[[str], bool]) -> DataFrame:
    """What is in folders (base, path) under a name that fits, listed by tasks."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for base, folder in zip(b["base"], b["path"], strict=True):
                try:
                    names = sorted(os.listdir(folder))
                except OSError:
                    continue
                yield _kinds([(base, os.path.join(folder, n), n) for n in names if fits(n)])

    return folders.select("base", "path").repartition("path").mapInPandas(look, ENTRIES)


def _below(top: DataFrame, params: Params) -> list[DataFrame]:
    """Stored tables (base, path) of all files at and under the paths of ``top``, a level each."""
    shown = (lambda n: True) if params.scan_hidden else (lambda n: not n.startswith("."))
    level, out = stored(top, "level"), []
    for depth in range(params.max_depth + 1):
        out.append(level.filter("not folder").select("base", "path"))
        folders = level.filter("folder")
        if depth == params.max_depth or folders.isEmpty():
            break
        level = stored(_inside(folders, shown), "level")
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def globbed(spark: SparkSession, pattern: str, params: Params = DEFAULTS, cwd: str | None = None) -> DataFrame:
    """(path): files that fit a glob, found part by part: only folders that fit so far are listed. From ``**`` on, what is
    below such a folder is compared with the rest of the pattern."""
    parts, case = P.glob_parts(pattern)
    flags = "(?s)" if case else "(?si)"
    at = _given(spark, ["/" if pattern.startswith("/") else cwd or os.getcwd()])
    for i, part in enumerate(parts):
        if part in ("", "."):
            at = at.filter("folder")
        elif part == "..":
            up = at.filter("folder").select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()
            at = up.select("path", F.when(F.col("path") == "", "/").otherwise(F.col("path")).alias("base")).select("base", F.col("base").alias("path"), F.lit("").alias("name"), F.lit(True).alias("folder"))
        elif part == "**":
            rest = flags + P.glob_regex("/".join(parts[i:]))[0]
            top = at.filter("folder").withColumn("base", F.col("path"))
            found = _union(_below(top, Params(max_depth=params.max_depth, scan_hidden=True)))
            start = F.when(F.col("base").endswith("/"), F.char_length("base")).otherwise(F.char_length("base") + 1)
            return found.filter(F.substr("path", start + 1).rlike(rest)).select("path").distinct()
        else:
            fits = re.compile(flags + P.glob_regex(part)[0])
            at = _inside(at.filter("folder"), lambda n, fits=fits: fits.fullmatch(n) is not None)
    return at.filter("not folder").select("path").distinct()


def collected(
    spark: SparkSession,
    paths: Iterable[str] = (),
    exts: Iterable[str] = P.MULTI_LINE,
    single_line_exts: Iterable[str] = P.SINGLE_LINE,
    globs: Iterable[str] = (),
    single_line_globs: Iterable[str] = (),
    params: Params = DEFAULTS,
    excluded: Iterable[str] = (),
    single_line: bool = False,
    cwd: str | None = None,
) -> DataFrame:
    """(path, search_mode) of all files asked for, each once; single-line wins. A file named outright needs no extension.

    The arguments are those of :func:`.files.collect`, and so are the files; here tasks list the folders.
    """
    cwd = cwd or os.getcwd()
    paths, globs, single_line_globs = list(paths), list(globs), list(single_line_globs)
    if not paths and not globs and not single_line_globs:
        paths = [cwd]
    multi, single = ([f".{e}" for e in x] for x in (exts, single_line_exts))
    ext = P.extension(F.col("path"))
    by_ext = F.when(ext.isin(*single), "single").otherwise("multi")
    found = []
    if paths:
        rows = _union(_below(_given(spark, [P.normalize(p, cwd) for p in paths]), params))
        found.append(rows.filter((F.col("path") == F.col("base")) | ext.isin(*multi, *single)).select("path", by_ext.alias("search_mode")))
    found += [globbed(spark, g, params, cwd).select("path", by_ext.alias("search_mode")) for g in globs]
    found += [globbed(spark, g, params, cwd).select("path", F.lit("single").alias("search_mode")) for g in single_line_globs]
    drop = [e for x in excluded for e in {"pdf": P.PDF, "convertible": P.CONVERTIBLE}[x]]
    mode = F.lit("single") if single_line else F.max("search_mode")  # of the two, single is the greater
    out = _union(found).filter(~ext.isin(*drop)) if drop else _union(found)
    return out.groupBy("path").agg(mode.alias("search_mode"))
