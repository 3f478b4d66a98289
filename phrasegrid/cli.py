"""Non-interactive entry: index, search, filter, script and list documents; exit code 1 if nothing is printed."""

from __future__ import annotations

import argparse
import itertools
import os
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths as P
from .lang.command import Command
from .lang.filter import parse_filter
from .lang.opening import fill, parse_opening
from .lang.search import is_empty, phrases
from .lang.sort import parse_sort
from .operators import index as I
from .operators import links as L
from .operators import rank, snippet
from .operators.cancel import Stop
from .operators.index import Index, build
from .operators.session import State, run_script
from .operators.store import stored
from .params import Params
from .sources import files
from .sources.config import with_config
from .sources.listing import collected
from .sources.scripts import find_script, list_scripts, save_script, script_dir


class UsageError(ValueError):
    """Arguments that don't go together."""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="phrasegrid")
    p.add_argument("paths", nargs="*")
    for name in ("exts", "single-line-exts", "add-exts", "single-line-add-exts", "filter", "search", "sample", "script", "sort", "sort-no-score", "index-path", "paths-from", "script-dir", "save-script", "complete"):
        p.add_argument(f"--{name}")
    for name in ("glob", "single-line-glob", "open-with"):
        p.add_argument(f"--{name}", action="append", default=[])
    for name in ("hidden", "single-line", "no-pdftotext", "no-pandoc", "index-only", "underline", "color", "list-scripts", "links", "debug", "stdin"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("-l", "--files-with-match", action="store_true")
    p.add_argument("--files-without-match", action="store_true")
    ints = {"max-depth": 100, "max-fuzzy-edit-dist": 2, "max-token-search-dist": 50, "max-linked-token-search-dist": 2, "tokens-per-search-scope-level": 100, "samples-per-doc": 5, "cache-limit": 10000}
    ints |= {"search-result-print-text-width": 80, "search-result-print-snippet-min-size": 10, "search-result-print-snippet-max-add-lines": 2}
    for name, default in ints.items():
        p.add_argument(f"--{name}", type=int, default=default)
    return p


def validate(a: argparse.Namespace) -> None:
    for x, y in (("search", "sample"), ("files_with_match", "files_without_match"), ("script", "search"), ("script", "sample"), ("script", "filter")):
        if getattr(a, x) and getattr(a, y):
            raise UsageError(f"--{x} and --{y} can't be used together")
    if a.stdin and (a.paths or a.glob or a.single_line_glob):
        raise UsageError("--stdin is a document by itself")
    if a.save_script and not a.script:
        raise UsageError("--save-script needs a --script")
    if not any((a.search, a.sample, a.filter, a.script, a.index_only, a.files_with_match, a.files_without_match, a.links, a.complete is not None)):
        raise UsageError("nothing to do: give a search, sample, filter, script or --index-only")


def params_of(a: argparse.Namespace) -> Params:
    return Params(
        max_token_search_dist=a.max_token_search_dist, max_linked_token_search_dist=a.max_linked_token_search_dist, max_fuzzy_edit_dist=a.max_fuzzy_edit_dist, samples_per_doc=a.samples_per_doc,
        tokens_per_search_scope_level=a.tokens_per_search_scope_level, max_depth=a.max_depth, scan_hidden=a.hidden, cache_limit=a.cache_limit, print_width=a.search_result_print_text_width,
        snippet_min_tokens=a.search_result_print_snippet_min_size, snippet_max_lines=a.search_result_print_snippet_max_add_lines,
    )


def gather(spark: SparkSession, a: argparse.Namespace, params: Params) -> DataFrame:
    exts = P.extension_list(a.exts) if a.exts is not None else list(P.MULTI_LINE)
    single = P.extension_list(a.single_line_exts) if a.single_line_exts is not None else list(P.SINGLE_LINE)
    exts += P.extension_list(a.add_exts or "")
    single += P.extension_list(a.single_line_add_exts or "")
    paths = a.paths + (files.paths_from(spark, a.paths_from.split(",")) if a.paths_from else [])
    excluded = [name for flag, name in ((a.no_pdftotext, "pdf"), (a.no_pandoc, "convertible")) if flag]
    return collected(spark, paths, exts, single, a.glob, a.single_line_glob, params, excluded, a.single_line)


def documents(spark: SparkSession, a: argparse.Namespace, params: Params) -> Index:
    """The index of the files asked for. With --index-path, contents that it has are neither converted nor tokenized again;
    new ones are added, all are noted as used, and beyond --cache-limit the least recently used contents go."""
    if a.stdin:
        return build(files.read_stdin(spark, a.single_line))
    raw = files.raw_files(spark, gather(spark, a, params))
    if not a.index_path:
        texts = stored(files.texts_of(raw), "texts")  # files are converted once
        _tell_failed(raw.select("path"), texts.select("path"), "path")
        return build(texts)
    own = stored(raw.select("path", "search_mode", "doc_hash", "mod_time", "format"), "files")  # files are hashed once
    new = own
    if I.committed(spark, a.index_path):
        new = I.new_documents(own, Index.read(spark, a.index_path).docs)
    new = new.groupBy("doc_hash").agg(F.min("path").alias("path")).select("path")
    I.append(files.texts_of(raw.join(new, "path", "left_semi")), a.index_path)
    I.touch(spark, a.index_path, own)
    index = Index.read(spark, a.index_path)
    _tell_failed(own.select("path", "doc_hash"), index.docs.select("doc_hash"), "doc_hash")
    if index.docs.select("doc_id").distinct().count() > params.cache_limit:
        I.prune_stored(spark, a.index_path, params.cache_limit)
        index = Index.read(spark, a.index_path)
    contents = index.docs.select("doc_hash", "doc_id", "title").dropDuplicates(["doc_hash"])
    docs = own.join(contents, "doc_hash")
    only = lambda df: df.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return Index(docs, only(index.positions), only(index.lines), index.words, only(index.links), only(index.brackets()), index.grams, None if index.held is None else only(index.held))


def _tell_failed(asked: DataFrame, had: DataFrame, key: str) -> None:
    """Names the files on standard error whose text couldn't be had; the next run tries them again."""
    for r in asked.join(had, key, "left_anti").select("path").orderBy("path").toLocalIterator():
        print(f"no text: {r.path}", file=sys.stderr)


def run(spark: SparkSession, argv: list[str], out=sys.stdout) -> int:
    """Prints to ``out`` and returns the exit code: 0, or 1 if nothing was printed."""
    a = parser().parse_args(with_config(argv, os.getcwd()))
    scripts = script_dir(a.script_dir)
    if a.list_scripts:
        return _print(list_scripts(scripts), out)
    validate(a)
    openings = [parse_opening(x) for x in a.open_with]
    params = params_of(a)
    index = documents(spark, a, params)
    if a.index_only:
        return 0
    state = State.start(index, os.getcwd(), params)
    if a.script:
        with open(find_script(a.script, scripts)) as f:
            text = f.read()
        state = run_script(state, text).state
        if a.save_script:
            save_script(a.save_script, text, scripts)
    expression = a.search or a.sample or ""
    if a.filter:
        parse_filter(a.filter)
        state = state.run(Command("filter", a.filter))
    if not is_empty(expression):
        state = state.run(Command("search", expression))
    if a.sort or a.sort_no_score:
        both = [str(parse_sort(a.sort or "score,desc")), str(parse_sort(a.sort_no_score or "path,asc", no_score=True))]
        state = state.run(Command("sort by", "; ".join(both)))
    searched = not is_empty(state.search_text)
    if a.complete is not None:
        return _print([r.completion for r in snippet.complete(a.complete, state.listed(), "path").filter("choices > 0").toLocalIterator()], out)
    if a.links:
        return _print(_links(spark, state, index), out)
    if a.files_without_match:
        return _print((r.path for r in state.unlisted().select("path").orderBy("path").toLocalIterator()), out)
    if a.files_with_match or not searched:
        return _print((r.path for r in state.ordered().select("path").toLocalIterator()), out)
    return _print(_blocks(state, index, params.samples_per_doc if a.sample else None, params, a.underline, a.color, a.debug, openings), out)


def _print(lines: Iterable[str], out) -> int:
    some = False
    for x in lines:
        print(x, file=out)
        some = True
    return 0 if some else 1


def _links(spark: SparkSession, state: State, index: Index) -> Iterator[str]:
    """Path, kind, link and target of the listed documents' links, tab-separated, in order."""
    listed = state.listed().select("path", "doc_id")
    folders = [r[0] for r in listed.select(F.regexp_replace("path", "/[^/]*$", "")).distinct().toLocalIterator()]
    roots = spark.createDataFrame([(d, L.project_root(d)) for d in folders], "folder string, root string")
    docs = listed.withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).join(roots, "folder")
    found = L.resolved(index.links, docs, index.docs.select("path"))
    for r in found.orderBy("path", "start_pos").toLocalIterator():
        yield f"{r.path}\t{r.typ}\t{r.link}\t{r.target}"


def _blocks(state: State, index: Index, n: int | None, params: Params, underline: bool, color: bool, debug: bool = False, openings: list | None = None) -> Iterator[str]:
    """The documents' snippets in order, one text each, a document at a time: rows come sorted, and none are gathered."""
    size = min(sum(t.word is not None for t in p) for p in phrases(state.search_text) if p)
    spanned = snippet.with_context(snippet.spans(state.shown_results(n), index), index, size, params)
    grid = snippet.word_grid(spanned, index).groupBy("result_id", "line").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "marked"))).alias("words"))
    places = index.lines.select("doc_id", "line", "page", "line_in_page")
    rows = spanned.select("result_id", "doc_id", "rank", F.round("score", 6).alias("score")).join(grid, "result_id").join(places, ["doc_id", "line"])
    order = rank.placed(state.ordered_columns(), state.ordered_keys())
    kind = F.col("format") if "format" in order.columns else F.lit("text")
    labelled = order.join(rows, "doc_id").withColumn("label", snippet.label(kind, F.col("page"), F.col("line_in_page")))
    commands = {o.ext: o for o in openings or []}
    for _, own in itertools.groupby(labelled.orderBy("place", "rank", "line").toLocalIterator(), lambda r: r.place):
        own = list(own)
        results = [list(x) for _, x in itertools.groupby(own, lambda r: r.rank)]
        blocks = [[(r.label, [(w.word, w.marked) for w in r.words]) for r in x] for x in results]
        if debug:
            blocks = [[(None, [(f"(Score: {x[0].score:f})", False)]), *b] for x, b in zip(results, blocks, strict=True)]
        text = snippet.render(own[0].path, blocks, params, underline, color)
        if o := commands.get(P.py_extension(own[0].path)):
            text += "\n" + fill(o, {"path": own[0].path, "page_num": own[0].page + 1, "line_num": own[0].line_in_page + 1, "search_word": next((w.word for r in own for w in r.words if w.marked), "")})
        yield text + "\n"


def main() -> int:
    spark = SparkSession.builder.appName("phrasegrid").getOrCreate()
    argv = sys.argv[1:]
    a, _ = parser().parse_known_args(argv)
    if not (a.paths or a.glob or a.single_line_glob or a.paths_from or a.stdin or sys.stdin.isatty()):
        argv.append("--stdin")  # nothing named and something piped in
    stop = Stop(spark)
    try:
        with stop.jobs():
            return run(spark, argv)
    except KeyboardInterrupt:
        stop()
        return 130
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
