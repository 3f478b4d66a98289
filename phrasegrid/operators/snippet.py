"""Presentation: spans, context lines, labels, marked text, wrapping and unique words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..params import DEFAULTS, Params
from .index import Index


def result_id() -> Column:
    """What tells results apart: document, phrase and places."""
    return F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("phrase_id").cast("string"), F.array_join(F.col("found.pos").cast("array<string>"), ","))


def spans(results: DataFrame, index: Index) -> DataFrame:
    """Results with first_line and last_line of their words."""
    keyed = results.withColumn("result_id", result_id())
    return keyed.withColumns({"first_line": F.array_min("found.line"), "last_line": F.array_max("found.line")})


def with_context(spanned: DataFrame, index: Index, n_search: int, params: Params = DEFAULTS) -> DataFrame:
    """Grows each span by a line on both sides while it has too few words, counted from the search's own."""
    lines = index.lines.select("doc_id", "line", "nonspace")
    last = lines.groupBy("doc_id").agg(F.max("line").alias("max_line"))
    out = spanned.join(last, "doc_id").withColumn("__n", F.lit(n_search))
    for _ in range(params.snippet_max_lines):
        grow = F.col("__n") < params.snippet_min_tokens
        for side, edge, ok in (("up", F.col("first_line") - 1, F.col("first_line") > 0), ("down", F.col("last_line") + 1, F.col("last_line") < F.col("max_line"))):
            own = lines.select(F.col("doc_id").alias("d"), F.col("line").alias("l"), F.col("nonspace").alias(side))
            out = out.join(own, (F.col("doc_id") == F.col("d")) & (edge == F.col("l")) & grow & ok, "left").drop("d", "l")
        out = out.withColumns(
            {
                "first_line": F.when(F.col("up").isNotNull(), F.col("first_line") - 1).otherwise(F.col("first_line")),
                "last_line": F.when(F.col("down").isNotNull(), F.col("last_line") + 1).otherwise(F.col("last_line")),
                "__n": F.col("__n") + F.coalesce("up", F.lit(0)) + F.coalesce("down", F.lit(0)),
            }
        ).drop("up", "down")
    return out.drop("__n", "max_line")


def word_grid(spanned: DataFrame, index: Index) -> DataFrame:
    """(result_id, line, pos, word, marked): every token of the spans, found ones marked."""
    asked = spanned.select("result_id", "doc_id", F.col("found.pos").alias("at"), F.explode(F.sequence("first_line", "last_line")).alias("line"))
    rows = asked.join(index.lines.select("doc_id", "line", "start_pos", "tokens"), ["doc_id", "line"])
    rows = rows.select("result_id", "line", "at", "start_pos", F.posexplode("tokens").alias("nth", "word")).withColumn("pos", F.col("start_pos") + F.col("nth"))
    return rows.select("result_id", "line", "pos", "word", F.array_contains("at", F.col("pos")).alias("marked"))


def marked_lines(spanned: DataFrame, index: Index, left: str = "[", right: str = "]") -> DataFrame:
    """(result_id, line, text): lines of the spans with the found words between marks."""
    word = F.when(F.col("marked"), F.concat(F.lit(left), F.col("word"), F.lit(right))).otherwise(F.col("word"))
    grouped = word_grid(spanned, index).groupBy("result_id", "line").agg(F.array_sort(F.collect_list(F.struct("pos", word.alias("w")))).alias("t"))
    return grouped.select("result_id", "line", F.array_join(F.col("t.w"), "").alias("text"))


def label(fmt: Column, page: Column, line_in_page: Column) -> Column:
    """Page and line for PDF, line for text, nothing for converted formats; numbers from 1."""
    line = (line_in_page + 1).cast("string")
    return F.when(fmt == "pdf", F.concat(F.lit("Page "), (page + 1).cast("string"), F.lit(", Line "), line)).when(fmt == "text", line)


def most_unique_word(results: DataFrame, index: Index) -> DataFrame:
    """(result_id, word): the found word that the fewest words of its page contain, without case; the first of equals."""
    keyed = results.withColumn("result_id", result_id())
    found = keyed.select("result_id", "doc_id", F.posexplode("found").alias("nth", "f")).select("result_id", "doc_id", "nth", F.col("f.line").alias("line"), F.col("f.word").alias("word"))
    lines = index.lines.join(keyed.select("doc_id").distinct(), "doc_id", "left_semi")
    found = found.join(lines.select("doc_id", "line", "page"), ["doc_id", "line"])
    counts = lines.select("doc_id", "page", F.explode("tokens").alias("word")).groupBy(F.col("doc_id").alias("d"), F.col("page").alias("p"), T.ascii_lower(F.col("word")).alias("ci")).agg(F.count("*").alias("n"))
    sums = found.join(counts, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & F.col("ci").contains(T.ascii_lower(F.col("word")))).groupBy("result_id", "nth", "word").agg(F.sum("n").alias("n"))
    return sums.groupBy("result_id").agg(F.min(F.struct("n", "nth", "word"))["word"].alias("word"))


def wrap(words: list[tuple[str, bool]], width: int) -> list[list[tuple[str, bool]]]:
    """Words (text, marked) in rows of at most ``width`` characters; a word longer than a row is broken."""
    rows: list[list[tuple[str, bool]]] = [[]]
    room = width
    for text, marked in words:
        if len(text) > room and len(text) <= width:
            rows.append([])
            room = width
        while text:
            if not room:
                rows.append([])
                room = width
            rows[-1].append((text[:room], marked))
            text, room = text[room:], room - min(len(text), room)
    return rows


def render(path: str, results: list[list[tuple[str | None, list[tuple[str, bool]]]]], params: Params = DEFAULTS, underline: bool = False, color: bool = False) -> str:
    """A document's snippets as text: its path, then each result's labelled, wrapped lines, a blank line between results;
    found words underlined or coloured."""
    out = [path]
    for i, lines in enumerate(results):
        if i:
            out.append("")
        for name, words in lines:
            head = f"{name}: " if name else ""
            for n, row in enumerate(wrap(words, max(1, params.print_width - len(head)))):
                lead = head if n == 0 else " " * len(head)
                out.append(lead + "".join(f"\x1b[32m{w}\x1b[0m" if m and color else w for w, m in row))
                if underline and any(m for _, m in row):
                    out.append(" " * len(lead) + "".join(("^" if m else " ") * len(w) for w, m in row).rstrip())
    return "\n".join(out)


def complete(prefix: str, names: DataFrame, col: str = "name") -> DataFrame:
    """(choices, completion): names that start with a prefix, and what all of them start with."""
    from ..functions.paths import common_prefix

    fits = names.filter(F.col(col).startswith(prefix)).agg(F.count("*").alias("choices"), F.min(col).alias("lo"), F.max(col).alias("hi"))
    return fits.select("choices", common_prefix(F.array("lo", "hi")).alias("completion"))


def top_lines(index: Index, n: int) -> DataFrame:
    """(doc_id, line, line_text, nth): each document's first n lines; lines are numbered from 0 without gaps."""
    return index.line_text().filter(F.col("line") < n).withColumn("nth", F.col("line") + 1)
