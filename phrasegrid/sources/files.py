"""Document sources: file trees, globs, path lists, texts and tables."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..params import DEFAULTS, Params


def walk(root: str, params: Params = DEFAULTS, depth: int = 0) -> Iterator[str]:
    """Files under a path, links followed; hidden names only at the top or on request; what can't be read is passed over."""
    if depth > params.max_depth:
        return
    name = os.path.basename(root.rstrip("/"))
    if depth and name.startswith(".") and not params.scan_hidden:
        return
    if os.path.isfile(root):
        yield root
    elif os.path.isdir(root):
        for n in _names(root):
            yield from walk(os.path.join(root, n), params, depth + 1)


def collect(
    paths: Iterable[str] = (),
    exts: Iterable[str] = P.MULTI_LINE,
    single_line_exts: Iterable[str] = P.SINGLE_LINE,
    globs: Iterable[str] = (),
    single_line_globs: Iterable[str] = (),
    params: Params = DEFAULTS,
    excluded: Iterable[str] = (),
    single_line: bool = False,
    cwd: str | None = None,
) -> list[tuple[str, str]]:
    """(path, search_mode) of all files asked for, by path; single-line wins. A file named outright needs no extension.

    ``excluded`` has formats left out: pdf, convertible. Without paths and globs it is the current folder. The list is of
    names, as the caller's file system gives them; texts are read by Spark.
    """
    cwd = cwd or os.getcwd()
    full = lambda p: P.normalize(p, cwd)
    paths, globs, single_line_globs = list(paths), list(globs), list(single_line_globs)
    if not paths and not globs and not single_line_globs:
        paths = [cwd]
    multi, single = ({"." + e for e in x} for x in (exts, single_line_exts))
    found: dict[str, str] = {}
    for p in map(full, paths):
        for f in walk(p, params):
            ext = P.py_extension(f)
            if f == p or ext in multi | single:
                found[f] = "single" if ext in single else "multi"
    for pattern, mode in [*((g, "multi") for g in globs), *((g, "single") for g in single_line_globs)]:
        for f in _glob(pattern, params, cwd):
            found[f] = "single" if mode == "single" or P.py_extension(f) in single else found.get(f, "multi")
    drop = {e for x in excluded for e in {"pdf": P.PDF, "convertible": P.CONVERTIBLE}[x]}
    return sorted((f, "single" if single_line else m) for f, m in found.items() if P.py_extension(f) not in drop)


def _glob(pattern: str, params: Params, cwd: str) -> Iterator[str]:
    """Files that fit a glob, found part by part: only folders that fit so far are read. From ``**`` on, what is below such
    a folder (no deeper than asked) is compared with the rest of the pattern."""
    parts, case = P.glob_parts(pattern)
    at = ["/"] if pattern.startswith("/") else [cwd]
    compiled = lambda glob: re.compile(P.glob_regex(glob)[0], re.DOTALL if case else re.DOTALL | re.IGNORECASE)
    for i, part in enumerate(parts):
        if part in ("", "."):
            at = [d for d in at if os.path.isdir(d)]
        elif part == "..":
            at = sorted({os.path.dirname(d) for d in at if os.path.isdir(d)})
        elif part == "**":
            fits = compiled("/".join(parts[i:]))
            open_ = Params(max_depth=params.max_depth, scan_hidden=True)
            return (f for d in at if os.path.isdir(d) for f in walk(d, open_) if fits.fullmatch(os.path.relpath(f, d)))
        else:
            fits = compiled(part)
            at = [os.path.join(d, n) for d in at if os.path.isdir(d) for n in _names(d) if fits.fullmatch(n)]
    return (f for f in at if os.path.isfile(f))


def _names(folder: str) -> list[str]:
    try:
        return sorted(os.listdir(folder))
    except OSError:
        return []


def paths_from(spark: SparkSession, files: Iterable[str]) -> list[str]:
    """Paths listed one a line in files, ``-`` being standard input."""
    out = []
    for f in files:
        out += sys.stdin.read().splitlines() if f == "-" else [r[0] for r in spark.read.text(f).collect()]
    return [x for x in out if x.strip()]


def raw_files(spark: SparkSession, files: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """(path, search_mode, content, doc_hash, mod_time, format) of collected files, a list or a table; the hash is of the bytes.

    Files are read where their rows are, empty ones, too; those that can't be read are passed over.
    """
    if not isinstance(files, DataFrame):
        files = spark.createDataFrame(files, "path string, search_mode string")
    rows = files.mapInPandas(_read, "path string, search_mode string, content binary, mod_time timestamp")
    return rows.select("path", "search_mode", "content", F.sha2("content", 512).alias("doc_hash"), "mod_time", P.file_format(F.col("path")).alias("format"))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, mode in zip(b["path"], b["search_mode"], strict=True):  # a file at a time
            try:
                with open(path, "rb") as f:
                    row = (path, mode, f.read(), pd.Timestamp.fromtimestamp(os.fstat(f.fileno()).st_mtime))
            except OSError:
                continue
            yield pd.DataFrame([row], columns=["path", "search_mode", "content", "mod_time"])


EXTRACTED = "path string, search_mode string, text string, error string, doc_hash string, mod_time timestamp, format string"
#: Seconds that a converter may take for one file.
CONVERT_SECONDS = 300


def extracted(raw: DataFrame) -> DataFrame:
    """``raw`` with the text of each file in place of its bytes, and what went wrong (error), if anything did; then there is
    no text. Bytes that aren't UTF-8 become U+FFFD."""
    columns = [c.split()[0] for c in EXTRACTED.split(", ")]
    is_text = F.col("format").isin("text", "other")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    plain = raw.filter(is_text).withColumns({"text": text, "error": F.lit(None).cast("string")}).select(*columns)
    return plain.unionByName(raw.filter(~is_text).mapInPandas(convert, EXTRACTED))


def texts_of(raw: DataFrame) -> DataFrame:
    """``raw`` with the text of each file in place of its bytes, without files whose text can't be had (see
    :func:`extracted`): they aren't indexed, so they are tried again."""
    return extracted(raw).filter("error is null").drop("error")


def read_files(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """Documents (path, search_mode, text, doc_hash, mod_time, format) of collected files."""
    return texts_of(raw_files(spark, files))


def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Text of PDF (pages parted by form feeds) and convertible formats, by the tools on the executor; HTML without them."""
    for b in batches:
        b = b.copy()
        b["text"], b["error"] = zip(*(_extract(p, bytes(c)) for p, c in zip(b["path"], b["content"], strict=True)), strict=True) if len(b) else ([], [])
        yield b[[c.split()[0] for c in EXTRACTED.split(", ")]]


def _extract(path: str, content: bytes) -> tuple[str | None, str | None]:
    """A file's text, or why there is none: the tool isn't there, fails or takes too long."""
    ext = P.py_extension(path)
    if ext in P.PDF:
        command = ["pdftotext", "-", "-"]
    else:
        command = ["pandoc", "--from", {".htm": "html"}.get(ext, ext[1:]), "--to", "plain", "--wrap", "none"]
    error = f"{command[0]} not found"
    if shutil.which(command[0]):
        try:
            done = subprocess.run(command, input=content, capture_output=True, timeout=CONVERT_SECONDS)
        except subprocess.TimeoutExpired:
            error = f"{command[0]} took more than {CONVERT_SECONDS} seconds"
        except OSError as e:
            error = f"{command[0]}: {e.strerror}"
        else:
            if done.returncode == 0:
                return done.stdout.decode("utf-8", "replace"), None
            error = f"{command[0]} ended with {done.returncode}: {done.stderr.decode('utf-8', 'replace').strip()[:200]}"
    if ext in (".html", ".htm"):
        return html_text(content.decode("utf-8", "replace")), None
    return None, f"failed to extract text: {error}"


def html_text(html: str) -> str:
    from html.parser import HTMLParser

    out: list[str] = []

    class Reader(HTMLParser):
        quiet = 0

        def handle_starttag(self, tag, attrs):
            self.quiet += tag in ("script", "style")
            if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
                out.append("\n")

        def handle_endtag(self, tag):
            self.quiet -= tag in ("script", "style") and self.quiet > 0

        def handle_data(self, data):
            if not self.quiet:
                out.append(data)

    Reader().feed(html)
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def read_stdin(spark: SparkSession, single_line: bool = False) -> DataFrame:
    """Standard input as one document."""
    docs = from_texts(spark, [("<stdin>", sys.stdin.read())], "single" if single_line else "multi")
    return docs.withColumns({"doc_hash": F.sha2("text", 512), "mod_time": F.current_timestamp(), "format": F.lit("text")})


def from_texts(spark: SparkSession, rows: list[tuple[str, str]], mode: str = "multi") -> DataFrame:
    return spark.createDataFrame([(p, mode, t) for p, t in rows], "path string, search_mode string, text string")


def from_table(table: DataFrame, path: Column, text_col: str = "text", single_line_exts: Iterable[str] = P.SINGLE_LINE) -> DataFrame:
    """A table's rows as documents: ``path`` is a column expression, the mode goes by its extension."""
    mode = F.when(P.extension(F.col("path")).isin(*(f".{e}" for e in single_line_exts)), "single").otherwise("multi")
    return table.withColumn("path", path).withColumn("search_mode", mode).withColumnRenamed(text_col, "text")
