"""Sessions: an immutable state changed by commands, with history."""

from __future__ import annotations

import threading
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..lang.command import Command, parse_command, parse_script
from ..lang.filter import Filter, parse_filter, same_filter
from ..lang.search import is_empty, same
from ..lang.sort import SortBy, parse_sorts
from ..params import DEFAULTS, Params
from . import rank
from .cancel import Cancelled, Stop
from .filters import apply_filter
from .index import Index, append, with_hash
from .search import fuzzy_rank, ranked, search
from .store import recorded, remove, stored

#: Every so many versions of a history keep their state; others are made again from the one before.
KEEP_EVERY = 5


@dataclass(frozen=True)
class State:
    """docs: all documents (path, doc_id, ...); passing: paths that pass the filter; searched: paths with an entry in
    results; scopes: doc_id, lo, hi of narrowed documents (an empty interval if nothing is left)."""

    index: Index
    docs: DataFrame
    passing: DataFrame
    searched: DataFrame
    results: DataFrame
    marked: DataFrame
    scopes: DataFrame | None = None
    filter_text: str = ""
    filter: Filter = field(default_factory=lambda: Filter("all"))
    search_text: str = ""
    sort: SortBy = SortBy("score", True)
    sort_no_score: SortBy = SortBy("path")
    ranking: DataFrame | None = None
    focus: tuple[str, ...] = ()
    split: str = ""
    hidden_panes: frozenset = frozenset()
    cwd: str = "/"
    params: Params = DEFAULTS

    @staticmethod
    def start(index: Index, cwd: str = "/", params: Params = DEFAULTS) -> State:
        docs = index.docs if "path_date" in index.docs.columns else index.docs.withColumn("path_date", P.path_date(F.col("path")))
        none = docs.select("path").limit(0)
        return State(index, docs, docs.select("path"), none, search(index, "", params), none, cwd=cwd, params=params)

    def listed(self) -> DataFrame:
        """Documents shown: those that pass, and with a search those with results."""
        out = self.docs.join(self.passing, "path", "left_semi")
        if is_empty(self.search_text):
            return out
        best = rank.best_per_document(self.results)
        return out.join(self.searched, "path", "left_semi").join(best, "doc_id")

    def ordered(self) -> DataFrame:
        """Listed documents in order."""
        return self.ordered_columns().orderBy(*self.ordered_keys())

    def ordered_columns(self) -> DataFrame:
        """Listed documents with the columns that :meth:`ordered_keys` sorts by."""
        out = self.listed()
        return out if self.ranking is None else out.join(self.ranking, "path", "left")

    def ordered_keys(self) -> list[Column]:
        sort = self.sort_no_score if is_empty(self.search_text) else self.sort
        return rank.focused_keys(sort if self.ranking is None else SortBy("fuzzy-ranking"), list(self.focus))

    def shown_results(self, n: int | None = None) -> DataFrame:
        return ranked(self.results.join(self.listed().select("doc_id").distinct(), "doc_id", "left_semi"), n)

    def unlisted(self) -> DataFrame:
        return self.docs.join(self.listed().select("path"), "path", "left_anti")

    def _refresh(self) -> State:
        """Searches those passing documents that have no entry yet, within their scope of now."""
        if is_empty(self.search_text):
            return self
        new = self.docs.join(self.passing, "path", "left_semi").join(self.searched, "path", "left_anti")
        found = search(self.index, self.search_text, self.params, self.scopes, new.select("doc_id"))
        return replace(self, results=self.results.unionByName(stored(found, "found")).dropDuplicates(["doc_id", "phrase_id", "found"]), searched=self.searched.unionByName(new.select("path")))

    def run(self, command: Command) -> State:
        """The state after a command; tables that it changes are written, so plans don't grow with the history."""
        new = self._changed(command)
        tables = {f.name: getattr(new, f.name) for f in fields(new) if isinstance(getattr(new, f.name), DataFrame)}
        return replace(new, **{k: stored(v, k) for k, v in tables.items() if v is not getattr(self, k)})

    def _changed(self, command: Command) -> State:
        name, text = command.name, command.text
        if name in ("search", "clear search"):
            if same(text, self.search_text):
                return self
            none = self.docs.select("path").limit(0)
            return replace(self, search_text=text, results=self.results.limit(0), searched=none)._refresh()
        if name in ("filter", "clear filter"):
            f = parse_filter(text)
            if same_filter(f, self.filter):
                return self
            passing = stored(apply_filter(self.docs, f, self.index, self.cwd, self.params).select("path"), "passing")
            return replace(self, filter=f, filter_text=text, passing=passing)._refresh()
        if name == "narrow level":
            return self._narrow(int(text))
        one = self.docs.filter(F.col("path") == text).select("path")
        if name in ("mark", "mark listed"):
            return replace(self, marked=self.marked.unionByName(one if name == "mark" else self.listed().select("path")).distinct())
        if name in ("unmark", "unmark listed", "unmark all"):
            gone = {"unmark": one, "unmark listed": self.listed().select("path"), "unmark all": self.docs.select("path")}[name]
            return replace(self, marked=self.marked.join(gone, "path", "left_anti"))
        if name.startswith("drop"):
            every = self.docs.select("path")
            listed = self.listed().select("path")
            keep = {
                "drop": lambda: every.join(one, "path", "left_anti"), "drop all except": lambda: one,
                "drop marked": lambda: every.join(self.marked, "path", "left_anti"), "drop unmarked": lambda: self.marked,
                "drop listed": lambda: every.join(listed, "path", "left_anti"), "drop unlisted": lambda: listed,
            }[name]()
            return self._keep(keep)
        if name == "sort by":
            a, b = parse_sorts(text)
            return replace(self, sort=a, sort_no_score=b, focus=(), ranking=None)
        if name == "path fuzzy rank":
            items = self.listed().select("path", P.relative(F.col("path"), self.cwd).alias("item"))
            best = fuzzy_rank(items, text, self.params)
            at = items.join(best, "item").withColumn("ranking", -F.col("score"))
            return replace(self, ranking=at.select("path", "ranking"), focus=())
        if name == "focus":
            return replace(self, focus=(*self.focus, text))
        if name == "split screen":
            return replace(self, split=text)
        if name in ("hide-pane", "show-pane"):
            return replace(self, hidden_panes=self.hidden_panes | {text} if name == "hide-pane" else self.hidden_panes - {text})
        return self

    def _keep(self, paths: DataFrame) -> State:
        of = lambda df: df.join(paths, "path", "left_semi")
        docs = of(self.docs)
        results = self.results.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        return replace(self, docs=docs, passing=of(self.passing), searched=of(self.searched), marked=of(self.marked), results=results)

    def _narrow(self, level: int) -> State:
        """Scopes around the results, within the scopes before; documents without results that are shown get none."""
        if not level:
            return replace(self, scopes=None)
        reach = level * self.params.tokens_per_search_scope_level
        shown = self.results.join(self.listed().select("doc_id").distinct(), "doc_id", "left_semi")
        ends = self.index.doc_info().select("doc_id", "max_pos")
        around = shown.select("doc_id", F.array_min("found.pos").alias("a"), F.array_max("found.pos").alias("b")).join(ends, "doc_id")
        around = around.select("doc_id", F.greatest(F.lit(0), F.col("a") - reach).alias("lo"), F.least("max_pos", F.col("b") + reach).alias("hi"))
        merged = union_intervals(around)
        if self.scopes is not None:
            merged = intersect_intervals(merged, self.scopes)
        empty = self.docs.select("doc_id").distinct().join(merged.select("doc_id").distinct(), "doc_id", "left_anti")
        return replace(self, scopes=merged.unionByName(empty.select("doc_id", F.lit(0).alias("lo"), F.lit(-1).alias("hi"))))

    def same_as(self, other: State) -> bool:
        """Whether paths, filter, search, marks and results agree."""
        pairs = [(s.docs.select("path"), s.passing, s.marked, s.results.select("doc_id", F.round("score", 6), "found")) for s in (self, other)]
        texts = (self.filter_text, self.search_text) == (other.filter_text, other.search_text)
        return texts and all(a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() for a, b in zip(*pairs, strict=True))


def union_intervals(rows: DataFrame) -> DataFrame:
    """(doc_id, lo, hi) with overlapping and adjoining intervals of a document merged."""
    order = Window.partitionBy("doc_id").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.coalesce((F.col("lo") > before + 1).cast("int"), F.lit(1)))
    grouped = marked.withColumn("g", F.sum("new").over(order))
    return grouped.groupBy("doc_id", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("g")


def intersect_intervals(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, lo, hi) that are in an interval of both. The places where intervals open and close lie in one run, and
    running sums tell how many of either are open from one place to the next; no interval meets another."""
    one = lambda df, here, there: [df.select("doc_id", place.alias("at"), F.lit(n * here).alias("a"), F.lit(n * there).alias("b")) for place, n in ((F.col("lo").cast("long"), 1), (F.col("hi").cast("long") + 1, -1))]
    whole = [df.filter("lo <= hi") for df in (a, b)]
    events = reduce(DataFrame.unionByName, [*one(whole[0], 1, 0), *one(whole[1], 0, 1)])
    places = events.groupBy("doc_id", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy("doc_id").orderBy("at")
    run = places.select("doc_id", "at", F.sum("a").over(order).alias("a"), F.sum("b").over(order).alias("b"), F.lead("at").over(order).alias("end"))
    return run.filter("a > 0 and b > 0").select("doc_id", F.col("at").alias("lo"), (F.col("end") - 1).alias("hi"))


class History:
    """Versions of a session: a command each, committed or not. Every KEEP_EVERY-th state is held; others are replayed."""

    def __init__(self, start: State):
        self.versions: list[tuple[Command | None, bool]] = [(None, True)]
        self.states: dict[int, State] = {0: start}
        self.at = 0

    @property
    def state(self) -> State:
        return self._state(self.at)

    def _state(self, n: int) -> State:
        if n not in self.states:
            self.states[n] = self._state(n - 1).run(self.versions[n][0])
        out = self.states[n]
        for k in [k for k in self.states if k and k % KEEP_EVERY and k != n]:
            del self.states[k]
        return out

    def run(self, command: Command | str, committed: bool = True) -> State:
        """Adds a version after the current one. A search or filter not yet committed is replaced by the next of its kind."""
        command = parse_command(command) if isinstance(command, str) else command
        last, done = self.versions[self.at]
        at = self.at
        kind = lambda c: c.name.split()[-1] if c else ""
        if self.at and not done and kind(last) == kind(command) and kind(command) in ("search", "filter") or last == command and kind(command) in ("search", "filter"):
            self.at -= 1
        before = list(self.versions), dict(self.states), at
        del self.versions[self.at + 1 :]
        self.states = {k: v for k, v in self.states.items() if k <= self.at}
        self.versions.append((command, committed))
        self.at += 1
        try:
            return self.state
        except BaseException:
            self.versions, self.states, self.at = before
            raise

    def undo(self) -> State:
        self.at = max(0, self.at - 1)
        return self.state

    def redo(self) -> State:
        self.at = min(len(self.versions) - 1, self.at + 1)
        return self.state

    def restart(self, start: State) -> State:
        """The same commands on another starting state, as after documents have changed."""
        self.states = {0: start}
        return self.state

    def add(self, spark: SparkSession, path: str, docs: DataFrame) -> State:
        """Documents (path, text, ...) that are new or have changed: their contents are added to the stored index at ``path``,
        their rows replace those of their paths in the starting state, and the commands run again."""
        append(docs, path)
        index = Index.read(spark, path)
        old = self.states[0].index
        ids = index.docs.select("doc_hash", "doc_id", "title").dropDuplicates(["doc_hash"])
        fresh = with_hash(docs).drop("text", "doc_id").join(ids, "doc_hash")
        kept = old.docs.join(fresh.select("path"), "path", "left_anti").drop("doc_id", "title").join(ids, "doc_hash")
        docs = stored(kept.unionByName(fresh, allowMissingColumns=True).withColumn("search_mode", F.coalesce("search_mode", F.lit("multi"))), "documents")
        new = replace(index, docs=docs)
        return self.restart(State.start(new, self.states[0].cwd, self.states[0].params))

    def edit(self, text: str) -> list[str]:
        """Replaces the history by commands of a text; if any fails nothing changes, and the lines come back with a note."""
        notes, failed, commands = [], False, []
        for line in text.splitlines():
            notes.append(line)
            if line.strip() and not line.lstrip().startswith(";"):
                try:
                    commands.append(parse_command(line))
                except ValueError as e:
                    failed = True
                    notes.append(f"; error: {e}")
        if not failed:
            self.versions, self.at = [(None, True), *((c, True) for c in commands)], len(commands)
            self.states = {0: self.states[0]}
        return notes if failed else []


class Live:
    """A session that answers the latest command: one that is still running when another comes is called off, its jobs are
    cancelled, the tables that it has written go, and the history is as if it had never been."""

    def __init__(self, history: History):
        self.history = history
        self._pool = ThreadPoolExecutor(1)
        self._lock = threading.Lock()
        self._stop: Stop | None = None

    @property
    def _spark(self) -> SparkSession:
        return self.history.states[0].docs.sparkSession

    def submit(self, command: Command | str, committed: bool = True) -> Future:
        """Starts a command; its future has the new state, or raises :class:`~.cancel.Cancelled` if another superseded it."""
        with self._lock:
            if self._stop:
                self._stop()
            self._stop = stop = Stop(self._spark)
            return self._pool.submit(inheritable_thread_target(self._spark)(self._run), command, committed, stop)

    def cancel(self) -> None:
        """Calls off what is running."""
        with self._lock:
            if self._stop:
                self._stop()

    def _run(self, command: Command | str, committed: bool, stop: Stop) -> State:
        with recorded() as paths:
            try:
                with stop.jobs():
                    return self.history.run(command, committed)
            except Cancelled:
                for path in paths:
                    remove(self._spark, path)
                raise


def run_script(start: State, text: str) -> History:
    history = History(start)
    for command in parse_script(text):
        history.run(command)
    return history
