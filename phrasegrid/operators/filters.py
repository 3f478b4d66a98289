"""Filters applied to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..lang.filter import Filter, contents
from ..lang.search import Token, phrases
from ..params import DEFAULTS, Params
from .index import Index
from .search import exists

COMPARE = {"=": "__eq__", "<=": "__le__", ">=": "__ge__", "<": "__lt__", ">": "__gt__"}


def _fits(t: Token, params: Params):
    return lambda p: T.matches(t.match, t.word or " ", p, T.ascii_lower(p), params.max_fuzzy_edit_dist)


def path_fuzzy(path: Column, expression: str, params: Params = DEFAULTS) -> Column:
    """Whether every token of some phrase fits some part of the path, in any order."""
    parts = T.tokens(path)
    any_phrase = F.lit(False)
    for phrase in phrases(expression):
        every = F.lit(True)
        for t in phrase:
            every = every & F.exists(parts, _fits(t, params))
        any_phrase = any_phrase | (every if phrase else F.lit(False))
    return any_phrase


def condition(f: Filter, cwd: str = "/", params: Params = DEFAULTS, flags: dict[str, str] | None = None) -> Column:
    """The filter over columns path, path_date and mod_time, and a flag column for each content expression."""
    if f.op == "all":
        return F.lit(True)
    if f.op in ("and", "or"):
        a, b = (condition(p, cwd, params, flags) for p in f.parts)
        return a & b if f.op == "and" else a | b
    if f.op == "not":
        return ~condition(f.parts[0], cwd, params, flags)
    if f.op in ("path-date", "mod-date"):
        day = F.col("path_date") if f.op == "path-date" else F.to_date("mod_time")
        return F.coalesce(getattr(day, COMPARE[f.compare])(F.lit(f.value).cast("date")), F.lit(False))
    if f.op == "path-fuzzy":
        return path_fuzzy(P.relative(F.col("path"), cwd), f.value, params)
    if f.op == "path-glob":
        return P.glob_match(P.relative(F.col("path"), cwd), f.value)
    if f.op == "ext":
        return P.extension(F.col("path")) == f.value
    return F.coalesce(F.col((flags or {})[f.value]), F.lit(False))


def apply_filter(docs: DataFrame, f: Filter, index: Index | None = None, cwd: str = "/", params: Params = DEFAULTS) -> DataFrame:
    """Documents that pass. Each content expression becomes a flag joined to the documents, so that not and or work."""
    flags: dict[str, str] = {}
    out = docs if "path_date" in docs.columns else docs.withColumn("path_date", P.path_date(F.col("path")))
    for text in dict.fromkeys(contents(f)):
        flags[text] = f"__content{len(flags)}"
        out = out.join(exists(index, text, params).withColumn(flags[text], F.lit(True)), "doc_id", "left")
    return out.filter(condition(f, cwd, params, flags)).drop(*flags.values())
