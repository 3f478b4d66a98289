"""Phrase search: all phrases of an expression as one tree, whose levels are joined once each; scores, and the best
matches per start."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..lang.search import Phrase, Token, phrases
from ..params import DEFAULTS, Params
from .dictionary import possible
from .documents import documents_of, expanded
from .index import Index, bracket_pairs
from .score import Bound, Match, candidate_score, match_code, phrase_brackets, score, search_size
from .store import stored

#: Positions of one bucket of the proximity join.
BUCKET = 64
#: Words of a token that the driver takes to look them up in the sorted positions; more are joined from the dictionary.
MOST_WORDS = 500
#: Documents that a reader of positions is told by their ids.
FEW_DOCS = 500
#: More are joined if at most one of so many documents has words for all tokens of a phrase.
SELECTIVE = 4
#: Places from a token to the one before that are looked at one by one.
MOST_BESIDE = 8
#: Values of one condition that a Parquet reader compares with the pages' ranges one by one.
PUSHED = 10
RESULT = "doc_id long, phrase_id int, score double, found array<struct<pos:int,word:string,line:int>>"
#: How far a chain's bound may lie under the score to beat: scores are compared to six places.
TIE = 1e-6


def candidate_limit(word: str) -> int:
    """Words kept for a first token: more for longer ones, 500 at most."""
    return min(500, math.floor(2.5 ** min(len(word.encode()), 8)))


def matching_words(index: Index, token: Token, params: Params = DEFAULTS) -> DataFrame:
    """The words that fit a token, of those that its keys lead to."""
    near = possible(index.words, index.grams, [(token.match, token.word)], params.max_fuzzy_edit_dist)
    return near.filter(T.matches(token.match, token.word or " ", F.col("word"), F.col("word_ci"), params.max_fuzzy_edit_dist))


def candidates(index: Index, token: Token, params: Params = DEFAULTS) -> DataFrame:
    """(word, cscore): the best words for a first token; all runs of spaces for explicit spaces."""
    words = matching_words(index, token, params)
    if token.word is None:
        return words.select("word", F.lit(1.0).alias("cscore"))
    scored = words.select("word", candidate_score(token.word, F.col("word"), F.col("word_ci")).alias("cscore"))
    return scored.orderBy(F.desc(F.round("cscore", 9)), "word").limit(candidate_limit(token.word))


def window_of(token: Token, params: Params = DEFAULTS) -> tuple[int, int]:
    """From where to where a token may stand, relative to the one before."""
    if not token.linked_prev:
        return -params.max_token_search_dist, params.max_token_search_dist
    if token.match == "fuzzy":
        return -params.max_linked_token_search_dist, params.max_linked_token_search_dist
    return 1, 1


def among(column: Column, values: list) -> Column:
    """Whether a column has one of the values, said so that Parquet readers skip pages of a sorted table without any."""
    values = sorted(values)
    pushed = F.lit(False)
    for lo in range(0, len(values), PUSHED):
        pushed = pushed | column.isin(values[lo : lo + PUSHED])
    return pushed if len(values) <= PUSHED else column.isin(values) & pushed


@dataclass(frozen=True)
class Key:
    """What a token asks of the dictionary: all words that fit, or of a first token the best ones."""

    word: str | None
    match: str
    best: bool

    @property
    def limit(self) -> int:
        return candidate_limit(self.word) if self.best else MOST_WORDS + 1


@dataclass
class Node:
    """A token of one or more phrases with the same tokens before it. ``ends`` are the phrases that end here, ``below`` those
    that end here or further down."""

    level: int
    key: int
    window: tuple[int, int]
    children: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    below: list[int] = field(default_factory=list)

    @property
    def further(self) -> list[int]:
        return [p for p in self.below if p not in self.ends]


class Tree:
    """An expression's phrases by their common beginnings."""

    def __init__(self, found: list[tuple[int, Phrase]], params: Params = DEFAULTS):
        self.phrases = dict(found)
        self.keys: list[Key] = []
        self.nodes: list[Node] = []
        at: dict[tuple, int] = {}
        for phrase_id, phrase in found:
            up = None
            for level, token in enumerate(phrase):
                key = Key(token.word, token.match, not level and token.word is not None)
                if key not in self.keys:
                    self.keys.append(key)
                window = window_of(token, params) if level else (0, 0)
                place = (up, key, window)
                if place not in at:
                    at[place] = len(self.nodes)
                    self.nodes.append(Node(level, self.keys.index(key), window))
                    if up is not None:
                        self.nodes[up].children.append(at[place])
                up = at[place]
                self.nodes[up].below.append(phrase_id)
            self.nodes[up].ends.append(phrase_id)

    @property
    def depth(self) -> int:
        return 1 + max(n.level for n in self.nodes)

    def at(self, level: int) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if n.level == level]


def _by(column: Column, values: dict[int, Column]) -> Column:
    """The value for a small number, null if there is none."""
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(column == k, v).otherwise(out)
    return out


class Lookup:
    """Positions of a tree's tokens. All tokens are resolved in the dictionary by one job, whatever phrases they stand in."""

    def __init__(self, index: Index, tree: Tree, params: Params = DEFAULTS):
        self.index, self.tree, self.params = index, tree, params
        fits = [T.matches(k.match, k.word or " ", F.col("word"), F.col("word_ci"), params.max_fuzzy_edit_dist) for k in tree.keys]
        one = lambda i, k: F.struct(F.lit(i).alias("key"), _preference(k).alias("order"), match_code(k.word, F.col("word"), F.col("word_ci")).alias("code"))
        near = possible(index.words, index.grams, list(dict.fromkeys((k.match, k.word) for k in tree.keys)), params.max_fuzzy_edit_dist)
        rows = near.filter(reduce(Column.__or__, fits))
        rows = rows.select("word", F.explode(F.array_compact(F.array(*(F.when(f, one(i, k)) for i, (f, k) in enumerate(zip(fits, tree.keys, strict=True)))))).alias("m"))
        self.matched = rows.select("word", "m.key", "m.order", "m.code")
        nth = F.row_number().over(Window.partitionBy("key").orderBy("order", "word"))
        limits = F.element_at(F.array(*(F.lit(k.limit) for k in tree.keys)), F.col("key") + 1)
        known = self.matched.withColumn("nth", nth).filter(F.col("nth") <= MOST_WORDS + 1).filter(F.col("nth") <= limits)
        #: At most MOST_WORDS + 1 (word, code) of each token; one more than MOST_WORDS says that there may be more.
        self.words: list[list[tuple[str, int]]] = [[] for _ in tree.keys]
        for r in known.select("key", "word", "code").collect():
            self.words[r.key].append((r.word, r.code))
        #: Of an index that isn't stored, positions come from the lines each time, so they are read once for all tokens.
        self.found = None if index.held is not None else stored(self._from_lines(index.lines, list(range(len(tree.keys)))), "found-positions")
        self.docs = self._documents(self.found.select("word", "doc_id") if index.held is None else index.held)

    def _documents(self, held: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """What leaves positions out whose documents can't have any of the phrases.

        The documents of a token's words are bitmaps, those of a phrase's tokens meet in their intersection, before any position
        is read. A token with too many words to list is in no intersection. Where the phrases may be in a good part of the
        documents anyway, or one has a single token to go by, positions are taken as they are.
        """
        every = lambda at: at
        of = {p: {n.key for n in self.tree.nodes if p in n.below} for p in self.tree.phrases}
        own = {p: {k for k in keys if not self.many(k)} for p, keys in of.items()}
        if any(len(of[p]) < 2 or not own[p] for p in of):
            return every
        words = [(w, k) for k in sorted(set().union(*own.values())) for w, _ in self.words[k]]
        sets = documents_of(lambda some: held.filter(among(F.col("word"), some)), words, own, MOST_WORDS)
        few = [r.doc_id for r in expanded(sets).limit(FEW_DOCS + 1).collect()]
        if len(few) <= FEW_DOCS:
            return lambda at: at.filter(among(F.col("doc_id"), few))
        counts = sets.agg(F.sum(F.bitmap_count("docs")).alias("n"), F.lit(0).alias("nth")).unionByName(self.index.docs.agg(F.count("*").alias("n"), F.lit(1).alias("nth")))
        n, of_all = (r.n for r in counts.orderBy("nth").collect())
        if n * SELECTIVE > of_all:
            return every
        ids = stored(expanded(sets), "documents-of-phrases")
        return lambda at: at.join(ids, "doc_id", "left_semi")

    def many(self, key: int) -> bool:
        return len(self.words[key]) > MOST_WORDS

    def positions(self, keys: list[int]) -> DataFrame:
        """(key, code, doc_id, pos, line, word) of all words that fit the tokens, read once for all of them."""
        if self.found is not None:
            return self.docs(self.found.filter(F.col("key").isin(keys)))
        spark, at = self.index.positions.sparkSession, self.docs(self.index.positions)
        few = [(w, k, c) for k in keys if not self.many(k) for w, c in self.words[k]]
        distinct = sorted({w for w, _, _ in few})
        out = None
        for lo in range(0, max(len(distinct), 1), MOST_WORDS):
            some = distinct[lo : lo + MOST_WORDS]
            own = [x for x in few if some and some[0] <= x[0] <= some[-1]]
            columns = list(zip(*own, strict=True)) or [(), (), ()]
            table = pa.table({"word": pa.array(columns[0], pa.string()), "key": pa.array(columns[1], pa.int32()), "code": pa.array(columns[2], pa.int32())})
            part = at.filter(among(F.col("word"), some)).join(F.broadcast(spark.createDataFrame(table)), "word")
            out = part if out is None else out.unionByName(part, allowMissingColumns=False)
        large = [k for k in keys if self.many(k)]
        if large:
            out = out.unionByName(at.join(self.matched.filter(F.col("key").isin(large)).select("word", "key", "code"), "word"))
        return out.select("key", "code", "doc_id", "pos", "line", "word")

    def _from_lines(self, lines: DataFrame, keys: list[int]) -> DataFrame:
        """The same in one pass over the tokens of lines in no order. A token with more words than are listed is compared with
        each word that stands where it may (see :meth:`_beside`), so none is sent to where the dictionary has its word."""
        few: dict[str, list[tuple[int, int]]] = {}
        for k in keys:
            for w, c in [] if self.many(k) else self.words[k]:
                few.setdefault(w, []).append((k, c))
        kind = pa.list_(pa.struct([("key", pa.int32()), ("code", pa.int32())]))
        listed = [[{"key": k, "code": c} for k, c in x] for x in few.values()]
        table = lines.sparkSession.createDataFrame(pa.table({"word": pa.array(list(few), pa.string()), "listed": pa.array(listed, kind)}))
        # A token that isn't one character is ASCII, where this is the same as the dictionary's lower case, and fast.
        w, ci = F.col("word"), F.lower("word")
        fits, has = {}, {}
        for k in filter(self.many, keys):
            own = self.tree.keys[k]
            fit = T.matches(own.match, own.word or " ", w, ci, self.params.max_fuzzy_edit_dist)
            # Blanks are never part of another token.
            fit = ~w.startswith(" ") & fit if own.word and " " not in own.word else fit
            beside = self._beside(k, has)
            fits[k] = fit if beside is None else beside & fit
        # Each word has its line's tokens at hand until it is kept or not, inside one generated loop.
        at = lines.select("doc_id", "line", "start_pos", "tokens", *(c.alias(name) for name, c in has.items()))
        at = at.select("*", F.posexplode("tokens").alias("nth", "word")).filter(reduce(Column.__or__, fits.values(), w.isin(list(few))))
        more = [F.when(fit, F.struct(F.lit(k).alias("key"), match_code(self.tree.keys[k].word, w, ci).cast("int").alias("code"))) for k, fit in fits.items()]
        at = at.select("doc_id", (F.col("start_pos") + F.col("nth")).alias("pos"), "line", "word", F.array(*more).alias("more") if more else F.array().cast("array<struct<key:int,code:int>>").alias("more"))
        found = at.join(F.broadcast(table), "word", "left")
        every = F.concat(F.coalesce("listed", F.array().cast("array<struct<key:int,code:int>>")), F.array_compact("more"))
        return found.withColumn("m", F.explode(every)).select("m.key", "m.code", "doc_id", "pos", "line", "word")

    def _beside(self, key: int, has: dict[str, Column]) -> Column | None:
        """Whether a word of the token before may stand where this token's place in some phrase asks for one: in the line, or
        beyond its ends, where other lines' words aren't known. None if that may be anywhere, or is one of too many words.
        ``has`` gets columns of a line: whether it has any such word at all.

        No chain gets to other places, so they needn't be looked at, however many words the token fits.
        """
        up = {i: n for n in self.tree.nodes for i in n.children}
        nth, out = F.col("nth"), F.lit(False)
        for i, n in enumerate(self.tree.nodes):
            if n.key != key:
                continue
            lo, hi = n.window
            if i not in up or self.many(up[i].key) or hi - lo > MOST_BESIDE:
                return None
            before = [w for w, _ in self.words[up[i].key]]
            if before:
                has[f"has{i}"] = F.arrays_overlap("tokens", F.array(*map(F.lit, before)))
                beside = reduce(Column.__or__, (F.coalesce(F.get("tokens", nth - d).isin(before), F.lit(False)) for d in range(lo, hi + 1)))
                out = out | (nth < hi) | (nth >= F.size("tokens") + lo) | (F.col(f"has{i}") & beside)
        return out


def _preference(key: Key) -> Column:
    """Words of a token in order of preference: of first tokens the likest ones."""
    return -F.round(candidate_score(key.word, F.col("word"), F.col("word_ci")), 9).cast("double") if key.best else F.lit(0.0)


def _within(at: DataFrame, scopes: DataFrame | None, docs: DataFrame | None) -> DataFrame:
    """Positions in ``docs``; with ``scopes`` (doc_id, lo, hi) only inside them, in documents that have any.

    Where scopes open and close lies in one run with the positions, by document and place, and the number of open ones is a
    running sum, so a position doesn't meet each scope of its document.
    """
    if docs is not None:
        at = at.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    if scopes is None:
        return at
    names = at.columns
    rest = [c for c in names if c not in ("doc_id", "pos")]
    none = [F.lit(None).cast(at.schema[c].dataType).alias(c) for c in rest]
    event = lambda place, change: scopes.select("doc_id", place.cast("int").alias("pos"), change.alias("change"), *none)
    # A scope opens before its first position, and closes after its last; an empty one counts, but holds nothing.
    whole = F.col("lo") <= F.col("hi")
    events = event(F.col("lo"), whole.cast("int")).unionByName(event(F.col("hi") + 1, -whole.cast("int")))
    run = at.withColumn("change", F.lit(None).cast("int")).unionByName(events)
    order = Window.partitionBy("doc_id").orderBy("pos", F.col("change").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    scoped = scopes.select("doc_id").distinct().withColumn("scoped", F.lit(True))
    open_ = run.join(scoped, "doc_id", "left").withColumn("open", F.coalesce(F.sum("change").over(order), F.lit(0)))
    return open_.filter(F.col("change").isNull() & (F.col("scoped").isNull() | (F.col("open") > 0))).select(*names)


def starts(index: Index, token: Token, params: Params = DEFAULTS, scopes: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, line, word) of a first token's candidates. With ``scopes`` (doc_id, lo, hi), only inside them, in
    documents that have any."""
    lookup = Lookup(index, Tree([(0, (token,))], params), params)
    return _within(lookup.positions([0]).select("doc_id", "pos", "line", "word"), scopes, docs)


class Chains:
    """Combinations of words for all phrases of a tree, level by level.

    A level is one join, of all chains so far with the positions of all tokens that come next: on token, document and position
    bucket, a chain being sent to the one to three buckets its window touches, so no document has to be in one place, and
    the number of joins is the length of the longest phrase.
    """

    def __init__(self, index: Index, tree: Tree, params: Params = DEFAULTS, scopes: DataFrame | None = None, docs: DataFrame | None = None, by_line: bool = True):
        self.index, self.tree, self.params, self.by_line = index, tree, params, by_line
        self.lookup = Lookup(index, tree, params)
        self.scopes, self.docs = scopes, docs
        later = sorted({n.key for n in tree.nodes if n.level})
        self.next = self.lookup.positions(later).withColumn("b", F.floor(F.col("pos") / BUCKET)) if later else None

    def first(self) -> DataFrame:
        """(doc_id, node, pos0, line0, word0, code0, single, n_starts) of all first tokens."""
        roots = {self.tree.nodes[i].key: i for i in self.tree.at(0)}
        at = _within(self.lookup.positions(sorted(roots)), self.scopes, self.docs)
        at = at.withColumn("node", _by(F.col("key"), {k: F.lit(i) for k, i in roots.items()}))
        # Counted and joined, so that no task holds all starts of a document.
        counts = at.groupBy("doc_id", "node").agg(F.count("*").alias("n_starts"))
        if self.by_line:
            counts = counts.join(self.index.docs.groupBy("doc_id").agg(F.max(F.col("search_mode") == "single").alias("single")), "doc_id")
        else:
            counts = counts.withColumn("single", F.lit(False))
        return at.join(counts, ["doc_id", "node"]).select("doc_id", "node", "single", "n_starts", *(F.col(c).alias(f"{c}0") for c in ("pos", "line", "word", "code")))

    def extended(self, chain: DataFrame, level: int) -> DataFrame:
        """``chain`` with pos{level}, line{level}, word{level} and code{level}: every fitting word in the window of every child."""
        nodes = self.tree.nodes
        step = lambda i: F.struct(F.lit(i).alias("node"), F.lit(nodes[i].key).alias("key"), F.lit(nodes[i].window[0]).alias("lo"), F.lit(nodes[i].window[1]).alias("hi"))
        parents = {i: F.array(*map(step, nodes[i].children)) for i in self.tree.at(level - 1) if nodes[i].children}
        prev = F.col(f"pos{level - 1}")
        sent = chain.filter(F.col("node").isin(*parents)).withColumn("to", F.explode(_by(F.col("node"), parents)))
        sent = sent.withColumn("bucket", F.explode(F.sequence(F.floor((prev + F.col("to.lo")) / BUCKET), F.floor((prev + F.col("to.hi")) / BUCKET))))
        nxt = self.next.select(F.col("key").alias("k"), F.col("doc_id").alias("d"), "b", *(F.col(c).alias(f"{c}{level}") for c in ("pos", "line", "word", "code")))
        near = F.col(f"pos{level}").between(prev + F.col("to.lo"), prev + F.col("to.hi"))
        line = ~F.col("single") | (F.col(f"line{level}") == F.col("line0")) if self.by_line else F.lit(True)
        met = sent.join(nxt, (F.col("to.key") == F.col("k")) & (F.col("doc_id") == F.col("d")) & (F.col("bucket") == F.col("b")) & near & line)
        return met.withColumn("node", F.col("to.node")).drop("to", "bucket", "k", "d", "b")

    def complete(self, level: int, chain: DataFrame) -> DataFrame | None:
        """The chains of a level that are whole phrases."""
        ends = [i for i in self.tree.at(level) if self.tree.nodes[i].ends]
        if not ends:
            return None
        ids = {i: F.array(*map(F.lit, self.tree.nodes[i].ends)) for i in ends}
        rows = chain.filter(F.col("node").isin(*ends)).withColumn("phrase_id", F.explode(_by(F.col("node"), ids)))
        kinds = {"pos": "int", "line": "int", "word": "string", "code": "int"}
        more = {f"{c}{i}": F.lit(None).cast(t) for i in range(level + 1, self.tree.depth) for c, t in kinds.items()}
        return rows.withColumns(more) if more else rows

    def rows(self, cut=lambda chain, level: chain) -> DataFrame:
        """All chains that are whole phrases: doc_id, node, phrase_id, n_starts, pos0, ... ``cut`` may leave chains out of a
        level before the next one is joined."""
        out, chain = None, self.first()
        for level in range(self.tree.depth):
            if level:
                chain = self.extended(chain, level)
            done = self.complete(level, chain)
            if done is not None:
                out = done if out is None else out.unionByName(done)
            if 0 < level < self.tree.depth - 1:
                chain = cut(chain, level)
        return out

    def reached(self) -> DataFrame:
        """doc_ids with any whole phrase. After each token only the places are kept that some chain gets to, a position once for
        each node at most, so rows never exceed positions."""
        nodes, out = self.tree.nodes, None
        roots = {nodes[i].key: i for i in self.tree.at(0)}
        at = _within(self.lookup.positions(sorted(roots)), self.scopes, self.docs)
        at = at.select("doc_id", _by(F.col("key"), {k: F.lit(i) for k, i in roots.items()}).alias("node"), "pos")
        for level in range(self.tree.depth):
            if level:
                at = self._places(at, level)
            ends = [i for i in self.tree.at(level) if nodes[i].ends]
            if ends:
                done = at.filter(F.col("node").isin(*ends)).select("doc_id")
                out = done if out is None else out.unionByName(done)
        return out.distinct()

    def _places(self, at: DataFrame, level: int) -> DataFrame:
        nodes = self.tree.nodes
        parents = [i for i in self.tree.at(level - 1) if nodes[i].children]
        edge = lambda up, i: F.struct(F.lit(up).alias("up"), F.lit(i).alias("node"), F.lit(nodes[i].window[0]).alias("lo"), F.lit(nodes[i].window[1]).alias("hi"))
        by_key: dict[int, list[Column]] = {}
        for up in parents:
            for i in nodes[up].children:
                by_key.setdefault(nodes[i].key, []).append(edge(up, i))
        nxt = self.next.filter(F.col("key").isin(*by_key)).select("doc_id", "pos", "b", F.explode(_by(F.col("key"), {k: F.array(*v) for k, v in by_key.items()})).alias("to"))
        lo = min(nodes[i].window[0] for up in parents for i in nodes[up].children)
        hi = max(nodes[i].window[1] for up in parents for i in nodes[up].children)
        sent = at.filter(F.col("node").isin(*parents)).select(F.col("doc_id").alias("d"), F.col("node").alias("from"), F.col("pos").alias("p"))
        sent = sent.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("p") + lo) / BUCKET), F.floor((F.col("p") + hi) / BUCKET))))
        near = F.col("pos").between(F.col("p") + F.col("to.lo"), F.col("p") + F.col("to.hi"))
        met = nxt.join(sent, (F.col("doc_id") == F.col("d")) & (F.col("to.up") == F.col("from")) & (F.col("b") == F.col("bucket")) & near, "left_semi")
        return met.select("doc_id", F.col("to.node").alias("node"), "pos")


def combinations(index: Index, phrase: Phrase, params: Params = DEFAULTS, scopes: DataFrame | None = None, docs: DataFrame | None = None, by_line: bool = True) -> DataFrame:
    """All combinations of words for a phrase: doc_id, n_starts, pos0, line0, word0, pos1, ..."""
    return Chains(index, Tree([(0, phrase)], params), params, scopes, docs, by_line).rows()


def _bracketed(found: DataFrame, lookup: Lookup, tree: Tree) -> tuple[DataFrame, Column]:
    """Adds the number of each phrase's bracket pairs that are matching brackets in the text, as stored with the index, or as
    the places of the phrases' tokens have them, since these are all brackets of a kind of which a phrase has a pair."""
    own = {p: phrase_brackets(phrase) for p, phrase in tree.phrases.items()}
    total = F.lit(0)
    asked = {tree.phrases[p][i].word for p, pairs in own.items() for pair in pairs for i in pair}
    matching = lookup.index.brackets() if lookup.found is None or not asked else bracket_pairs(lookup.found.filter(F.col("word").isin(*asked)).select("doc_id", "pos", "word").distinct())
    for k in range(max(map(len, own.values()))):
        ends = [_by(F.col("phrase_id"), {p: F.col(f"pos{pairs[k][side]}") for p, pairs in own.items() if len(pairs) > k}) for side in (0, 1)]
        pairs = matching.select(F.col("doc_id").alias("bd"), F.col("open_pos").alias("bo"), F.col("close_pos").alias("bc"), F.lit(1).alias(f"pair{k}"))
        found = found.withColumns({"open": ends[0], "close": ends[1]})
        found = found.join(pairs, (F.col("doc_id") == F.col("bd")) & (F.col("open") == F.col("bo")) & (F.col("close") == F.col("bc")), "left").drop("bd", "bo", "bc", "open", "close")
        total = total + F.coalesce(f"pair{k}", F.lit(0))
    return found, total


def _best(rows: DataFrame, params: Params) -> DataFrame:
    """Of each phrase and start the best matches, as many as the starts of its document leave room for."""
    most = max(params.min_results_per_start, params.results_per_doc)
    room = F.greatest(F.lit(params.min_results_per_start), F.ceil(F.lit(params.results_per_doc) / F.col("n_starts")))
    order = Window.partitionBy("doc_id", "phrase_id", "pos0").orderBy(F.desc(F.round("score", 6)), "found")
    return rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).filter(F.col("nth") <= room)


class Search:
    """The matches of an expression's phrases."""

    def __init__(self, index: Index, tree: Tree, params: Params = DEFAULTS, scopes: DataFrame | None = None, docs: DataFrame | None = None):
        self.index, self.tree, self.params = index, tree, params
        self.chains = Chains(index, tree, params, scopes, docs)
        self.bounds = {p: self._bound(phrase) for p, phrase in tree.phrases.items()}

    def _bound(self, phrase: Phrase) -> Bound:
        known = []
        for level, t in enumerate(phrase):
            key = self.tree.keys.index(Key(t.word, t.match, not level and t.word is not None))
            known.append(None if self.chains.lookup.many(key) else [c for _, c in self.chains.lookup.words[key]])
        return Bound.of(phrase, known)

    def _scored(self, chains: DataFrame) -> DataFrame:
        """(doc_id, phrase_id, n_starts, pos0, score, found) of chains that are whole phrases."""
        found, pairs = _bracketed(chains, self.chains.lookup, self.tree)
        depth = self.tree.depth
        matches = [Match(F.col(f"pos{i}"), F.col(f"code{i}")) for i in range(depth)]
        sizes = {p: F.struct(*(F.lit(x).alias(n) for n, x in search_size(phrase).items())) for p, phrase in self.tree.phrases.items()}
        found = found.withColumn("size", _by(F.col("phrase_id"), sizes))
        own = {p: F.array(*(F.lit(float(t)) for t in self._lengths(phrase, depth))) for p, phrase in self.tree.phrases.items()}
        found = found.withColumn("own", _by(F.col("phrase_id"), own))
        value = score(F.col("size"), [F.col("own")[i] for i in range(depth)], matches, pairs, self.params.max_token_search_dist)
        hit = F.array(*(F.struct(F.col(f"pos{i}").alias("pos"), F.col(f"word{i}").alias("word"), F.col(f"line{i}").alias("line")) for i in range(depth)))
        return found.select("doc_id", "phrase_id", "n_starts", "pos0", value.alias("score"), F.slice(hit, F.lit(1), F.col("size.n").cast("int")).alias("found"))

    @staticmethod
    def _lengths(phrase: Phrase, depth: int) -> list[int]:
        sizes = [1 if t.word is None else len(t.word.encode()) for t in phrase]
        return sizes + [0] * (depth - len(sizes))

    def limit(self, chain: DataFrame, level: int) -> Column:
        """No chain's score may exceed this, whatever words complete it, for any phrase that it may become."""
        matches = [Match(F.col(f"pos{i}"), F.col(f"code{i}")) for i in range(level + 1)]
        best = {i: F.greatest(*x) if len(x) > 1 else x[0] for i in self.tree.at(level) if (x := [self.bounds[p].most(matches, self.params.max_token_search_dist) for p in self.tree.nodes[i].further])}
        return _by(F.col("node"), best)

    def rows(self) -> DataFrame:
        """(doc_id, phrase_id, score, found).

        Phrases of three or more tokens go in two rounds. The first carries on only the most promising chains of each start,
        and what it completes sets a score to beat, the last of as many as there is room for. The second leaves out chains
        whose bound is under that before the next token is joined; others can't be among the best.
        """
        cut = self._cut() if self.tree.depth > 2 else lambda chain, level: chain
        return _best(self._scored(self.chains.rows(cut)), self.params).select("doc_id", "phrase_id", "score", "found")

    def _promising(self, chain: DataFrame, level: int) -> DataFrame:
        room = F.greatest(F.lit(self.params.min_results_per_start), F.ceil(F.lit(self.params.results_per_doc) / F.col("n_starts")))
        order = Window.partitionBy("doc_id", "node", "pos0").orderBy(F.desc("limit"), *(f"pos{i}" for i in range(1, level + 1)))
        most = max(self.params.min_results_per_start, self.params.results_per_doc)
        ranked_ = chain.withColumn("limit", self.limit(chain, level)).withColumn("nth", F.row_number().over(order))
        return ranked_.filter(F.col("nth") <= most).filter(F.col("nth") <= room).drop("nth", "limit")

    def _cut(self):
        first = _best(self._scored(self.chains.rows(self._promising)), self.params)
        room = F.greatest(F.lit(self.params.min_results_per_start), F.ceil(F.lit(self.params.results_per_doc) / F.col("n_starts")))
        full = first.filter(F.col("nth") == room).select("doc_id", "phrase_id", "pos0", F.round("score", 6).alias("beat"))
        full = stored(full, "scores-to-beat")

        def cut(chain: DataFrame, level: int) -> DataFrame:
            # A node's chains are cut by the least score to beat of all its phrases, if each of them has one.
            nodes = {i: self.tree.nodes[i] for i in self.tree.at(level) if self.tree.nodes[i].children}
            at: dict[int, list[Column]] = {}
            for i, n in nodes.items():
                for p in n.further:
                    at.setdefault(p, []).append(F.struct(F.lit(i).alias("node"), F.lit(len(n.further)).alias("all")))
            marks = full.filter(F.col("phrase_id").isin(*at)).select("doc_id", "pos0", "beat", F.explode(_by(F.col("phrase_id"), {p: F.array(*x) for p, x in at.items()})).alias("n"))
            least = marks.groupBy("doc_id", "pos0", F.col("n.node").alias("node"), F.col("n.all").alias("all")).agg(F.min("beat").alias("beat"), F.count("*").alias("some"))
            least = least.filter(F.col("some") == F.col("all")).select("doc_id", "pos0", "node", "beat")
            kept = chain.filter(F.col("node").isin(*nodes)).join(least, ["doc_id", "pos0", "node"], "left")
            return kept.filter(F.col("beat").isNull() | (self.limit(chain, level) >= F.col("beat") - TIE)).drop("beat")

        return cut


def _tree(expression: str, params: Params) -> Tree | None:
    found = [(i, p) for i, p in enumerate(phrases(expression)) if p]
    return Tree(found, params) if found else None


def search(index: Index, expression: str, params: Params = DEFAULTS, scopes: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Matches of every phrase of an expression; empty phrases find nothing."""
    tree = _tree(expression, params)
    if tree is None:
        return index.docs.sparkSession.createDataFrame([], RESULT)
    return Search(index, tree, params, scopes, docs).rows()


def exists(index: Index, expression: str, params: Params = DEFAULTS) -> DataFrame:
    """doc_ids with any match, over whole documents whatever their mode."""
    tree = _tree(expression, params)
    return index.docs.select("doc_id").limit(0) if tree is None else Chains(index, tree, params, by_line=False).reached()


def ranked(results: DataFrame, n: int | None = None) -> DataFrame:
    """Results with their rank in the document: by score (to six places), then first position, then all positions."""
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 6)), F.col("found")[0]["pos"], F.col("found.pos"), "phrase_id")
    rows = results.withColumn("rank", F.row_number().over(order))
    return rows if n is None else rows.filter(F.col("rank") <= n)


def fuzzy_rank(items: DataFrame, expression: str, params: Params = DEFAULTS, item_col: str = "item") -> DataFrame:
    """(item, score, highlights): items whose tokens fit all tokens of a phrase anywhere; no rows if no phrase has any.

    The tokens' places are combined freely, as short strings allow; of equal scores the first places count.
    """
    parts = items.select(F.col(item_col).alias("item")).distinct().select("item", F.posexplode(T.tokens(F.col("item"))).alias("pos", "word"))
    parts = parts.withColumn("word_ci", T.ascii_lower(F.col("word")))
    found = None
    for phrase in phrases(expression):
        if not phrase:
            continue
        chain = None
        for i, t in enumerate(phrase):
            own = parts.filter(T.matches(t.match, t.word or " ", F.col("word"), F.col("word_ci"), params.max_fuzzy_edit_dist))
            own = own.select("item", F.col("pos").alias(f"pos{i}"), F.col("word").alias(f"word{i}"))
            chain = own if chain is None else chain.join(own, "item")
        n = range(len(phrase))
        matches = [Match(F.col(f"pos{i}"), match_code(t.word, F.col(f"word{i}"), T.ascii_lower(F.col(f"word{i}")))) for i, t in enumerate(phrase)]
        own = [F.lit(1.0 if t.word is None else float(len(t.word.encode()))) for t in phrase]
        size = F.struct(*(F.lit(x).alias(name) for name, x in search_size(phrase).items()))
        value = score(size, own, matches, 0, params.max_token_search_dist)
        rows = chain.select("item", value.alias("score"), F.array(*(f"pos{i}" for i in n)).alias("at"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return parts.select("item", F.lit(0.0).alias("score"), F.array("pos").alias("highlights")).limit(0)
    best = found.groupBy("item").agg(F.max(F.struct(F.round("score", 6).alias("score"), F.transform("at", lambda x: -x).alias("at"))).alias("b"))
    return best.select("item", F.col("b.score").alias("score"), F.array_distinct(F.transform("b.at", lambda x: -x)).alias("highlights"))
