"""Links in text lines: bare URLs, Markdown targets and wiki names."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T

# What ends a link, besides spaces and the end of the line; the schemes of URLs.
STOPS = ["", "]", ")", "|", '"', "<", ">", "{", "}", "^", "\\"]
SCHEMES = ["http", "https", "file"]
FOUND = "array<struct<typ:string,first:int,last:int>>"


def has_link(tokens: Column) -> Column:
    """Whether a line can have a link: a lower-case scheme with ``:`` and ``/``, or both square brackets."""
    url = F.arrays_overlap(tokens, F.array(*map(F.lit, SCHEMES))) & F.array_contains(tokens, ":") & F.array_contains(tokens, "/")
    return url | (F.array_contains(tokens, "[") & F.array_contains(tokens, "]"))


def _fold(tokens: Column) -> Column:
    """Links of a line from left to right: at most one is open; what ends it isn't looked at for a new one."""
    at = lambda i: F.when((i >= 0) & (i < F.size(tokens)), F.get(tokens, i)).otherwise("")

    def start(i: Column) -> Column:
        url = T.ascii_lower(at(i)).isin(*SCHEMES) & (at(i + 1) == ":") & (at(i + 2) == "/") & (at(i + 3) == "/")
        return (
            F.when(url, "url")
            .when((at(i - 2) == "]") & (at(i - 1) == "("), "markdown")
            .when((at(i - 2) == "[") & (at(i - 1) == "["), "wiki")
        )

    def step(state: Column, i: Column) -> Column:
        w = at(i)
        ends = w.startswith(" ") | w.isin(*STOPS)
        closed = F.concat(state["found"], F.array(F.struct(state["typ"].alias("typ"), state["first"].alias("first"), (i - 1).alias("last"))))
        opens = start(i)
        is_open, new = state["typ"].isNotNull(), opens.isNotNull()
        return F.struct(
            F.when(is_open & ends, F.lit(None)).when(is_open, state["typ"]).otherwise(opens).alias("typ"),
            F.when(is_open, state["first"]).when(new, i).otherwise(F.lit(-1)).cast("int").alias("first"),
            F.when(is_open & ends, closed).otherwise(state["found"]).cast(FOUND).alias("found"),
        )

    def finish(state: Column) -> Column:
        last = F.array(F.struct(state["typ"].alias("typ"), state["first"].alias("first"), (F.size(tokens) - 1).alias("last")))
        return F.when(state["typ"].isNotNull(), F.concat(state["found"], last)).otherwise(state["found"]).cast(FOUND)

    zero = F.struct(F.lit(None).cast("string").alias("typ"), F.lit(-1).alias("first"), F.array().cast(FOUND).alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), zero, step, finish)


def link_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos, typ, link) of lines with their tokens; only lines that can have a link are folded."""
    found = lines.filter(has_link(F.col("tokens"))).select("doc_id", F.col("start_pos").alias("at"), "tokens", F.explode(_fold(F.col("tokens"))).alias("l"))
    link = F.array_join(F.slice("tokens", F.col("l.first") + 1, F.col("l.last") - F.col("l.first") + 1), "")
    return found.select("doc_id", (F.col("at") + F.col("l.first")).cast("int").alias("start_pos"), (F.col("at") + F.col("l.last")).cast("int").alias("end_pos"), F.col("l.typ").alias("typ"), link.alias("link"))


def nearest_link(results: DataFrame, links: DataFrame) -> DataFrame:
    """For each result (result_id, doc_id, lo, hi) the link to open: the next one after the middle, or the one before if
    that contains the middle or is at most half as far. Results in documents without links have none.

    Results and links of a document lie in one sorted run, where the last link before and the first after are a running
    maximum from either end; no result meets all links.
    """
    link = F.struct("start_pos", "end_pos", "typ", "link")
    none = F.lit(None)
    mid = F.floor((F.col("lo") + F.col("hi")) / 2)
    rows = results.select("doc_id", mid.alias("at"), F.lit(1).alias("asks"), "result_id", none.cast("struct<start_pos:int,end_pos:int,typ:string,link:string>").alias("l"))
    rows = rows.unionByName(links.select("doc_id", F.col("start_pos").cast("long").alias("at"), F.lit(0).alias("asks"), none.cast(results.schema["result_id"].dataType).alias("result_id"), link.alias("l")))
    own = Window.partitionBy("doc_id")
    before = F.last("l", True).over(own.orderBy("at", "asks"))
    after = F.last("l", True).over(own.orderBy(F.desc("at"), F.desc("asks")))  # a link at the middle itself comes before
    rows = rows.select("result_id", "asks", "at", before.alias("b"), after.alias("a")).filter("asks = 1")
    back, ahead = F.col("at") - F.col("b.start_pos"), F.col("a.start_pos") - F.col("at")
    use_b = F.col("b").isNotNull() & (F.col("a").isNull() | (F.col("b.end_pos") >= F.col("at")) | (2 * back <= ahead))
    pick = F.when(use_b, F.col("b")).otherwise(F.col("a"))
    return rows.select("result_id", pick["start_pos"].alias("start_pos"), pick["typ"].alias("typ"), pick["link"].alias("link")).filter("start_pos is not null")


# Folders that mark the root of a project or of a vault of notes.
ROOT_MARKERS = (".git", ".hg", ".svn", ".obsidian", ".logseq", ".tangent")


def project_root(folder: str) -> str:
    """The nearest folder from ``folder`` up that holds a marker, or a home folder; ``folder`` itself if none can be read or
    has one. A look at the caller's file system."""
    at = os.path.abspath(folder)
    while at != os.path.dirname(at):
        if os.path.dirname(at) == "/home":
            return at
        try:
            names = os.listdir(at)
        except OSError:
            break
        if set(names) & set(ROOT_MARKERS):
            return at
        at = os.path.dirname(at)
    return folder


def resolved(links: DataFrame, docs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, start_pos, typ, link, target): the links of ``docs`` (path, doc_id, root) and what each leads to.

    A URL is its own target. A Markdown target starts at the root if it starts with a slash, else at the document's folder.
    A wiki name leads to one of ``files`` (path) below the root that ends in it but for an extension, the document's own
    extension first, then the least; if none does, to such a file beside the others. One that starts with a dot is a path.
    """
    folder, own = F.regexp_replace("path", "/[^/]*$", ""), F.regexp_extract("path", r"(\.[^./]*)$", 1)
    rows = docs.select("path", "doc_id", "root").join(links, "doc_id").withColumns({"folder": folder, "ext": own, "name": F.regexp_replace("link", "^/", "")})
    rows = rows.withColumn("key", F.when(F.col("typ") == "wiki", F.regexp_extract("name", "([^/]*)$", 1)))
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    known = files.select(F.col("path").alias("file"), bare.alias("bare"), F.regexp_extract(bare, "([^/]*)$", 1).alias("last"))
    # Each end of a file's name is a key, as a name in a link may be the end of a longer one.
    ends = known.filter("last != ''").withColumn("size", F.explode(F.sequence(F.lit(1), F.char_length("last")))).withColumn("end", F.expr("right(last, size)"))
    inside = F.col("file").startswith(F.concat(F.col("root"), F.lit("/"))) & F.col("bare").endswith(F.col("name"))
    hits = rows.filter(F.col("key") != "").join(ends, (F.col("key") == F.col("end")) & inside)
    rank = F.struct((~F.col("file").endswith(F.concat("name", "ext"))).alias("other"), "file")
    best = hits.groupBy("path", "doc_id", "start_pos").agg(F.min(rank)["file"].alias("hit"))
    rows = rows.join(best, ["path", "doc_id", "start_pos"], "left")
    beside = F.concat_ws("/", F.when(F.col("name").startswith("."), F.col("folder")).otherwise(F.col("root")), F.concat("name", "ext"))
    wiki = F.when(F.col("name").startswith("."), beside).otherwise(F.coalesce("hit", beside))
    target = F.when(F.col("typ") == "url", F.col("link")).when(F.col("typ") == "markdown", resolve_markdown(F.col("link"), F.col("folder"), F.col("root"))).otherwise(wiki)
    target = F.when(F.col("typ") == "wiki", P.folded(target)).otherwise(target)
    return rows.select("path", "start_pos", "typ", "link", target.alias("target"))


def resolve_markdown(link: Column, base_dir: Column, root: Column) -> Column:
    """A Markdown target as a path: from the root if it starts with a slash, else from the document's folder."""
    bare = F.regexp_replace(link, "#.*$", "")
    joined = F.when(bare.startswith("/"), F.concat(root, bare)).otherwise(F.concat_ws("/", base_dir, bare))
    return P.folded(joined)
