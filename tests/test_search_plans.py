"""How searches run: rows and exchanges of phrase trees, bounded chains, stored brackets, interval sweeps."""

import os
import random
import re
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from phrasegrid.functions import paths as P
from phrasegrid.functions import text as T
from phrasegrid.lang.search import phrases
from phrasegrid.operators import index as I
from phrasegrid.operators import search as S
from phrasegrid.operators.cancel import Cancelled
from phrasegrid.operators.score import phrase_brackets
from phrasegrid.operators.session import History, Live, State, intersect_intervals
from phrasegrid.operators.store import stored
from phrasegrid.params import DEFAULTS, Params


def indexed(spark, texts, mode="multi"):
    return I.build(spark.createDataFrame([(k, f"/{k}", mode, t) for k, t in enumerate(texts)], "doc_id long, path string, search_mode string, text string"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def most_rows(df):
    """The most rows that any join of a query has made, as it ran."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec",):
            return walk(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(node.plan())
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(plan)
    return max(found, default=0)


def test_existence_never_has_more_rows_than_positions(spark):
    index = indexed(spark, [" ".join(["fox"] * 600), "one fox", "fox and fox and fox"])
    found = S.exists(index, "fox fox fox")
    assert {r[0] for r in found.collect()} == {0, 1, 2}
    assert most_rows(S.exists(index, "'fox 'fox 'fox")) <= index.positions.count()
    assert {r[0] for r in S.exists(index, "'fox 'and 'fox | 'one 'fox").collect()} == {1, 2}
    assert {r[0] for r in S.exists(index, "'one~fox").collect()} == {1}


def all_results(index, expression, params=DEFAULTS):
    """The same results by all combinations, without bounds."""
    tree = S._tree(expression, params)
    plain = S.Search(index, tree, params)
    return S._best(plain._scored(plain.chains.rows()), params).select("doc_id", "phrase_id", F.round("score", 6).alias("score"), "found")


def rows(df):
    return sorted((r.doc_id, r.phrase_id, round(r.score, 6), tuple((x.pos, x.word, x.line) for x in r.found)) for r in df.collect())


WORDS = ["the", "The", "then", "other", "and", "land", "of", "often", "fox", "box", "hello", "(", ")", "x"]


@pytest.mark.parametrize("expression", ["the and of", "'the 'and 'of 'fox", "the (and | of) ?fox box", r"\( the \) and", "^the~and of", "helo fax bix", "hello | the and | the and of"])
@pytest.mark.parametrize("mode", ["multi", "single"])
def test_bounds_keep_the_best_matches(spark, expression, mode):
    rng = random.Random(hash(expression) % 1000)
    texts = [" ".join(rng.choice(WORDS) + rng.choice(["", "", "", "\n"]) for _ in range(n)) for n in (5, 60, 150, 240)]
    index = indexed(spark, texts, mode)
    params = Params(max_token_search_dist=12, results_per_doc=12, min_results_per_start=2)
    assert rows(S.search(index, expression, params)) == rows(all_results(index, expression, params))


def test_bounds_join_fewer_rows(spark):
    rng = random.Random(1)
    index = indexed(spark, [" ".join(rng.choice(["the", "and", "of", "a", "b"]) for _ in range(400)) for _ in range(3)])
    bounded, plain = S.search(index, "'the 'and 'of"), all_results(index, "'the 'and 'of")
    assert rows(bounded) == rows(plain)
    assert most_rows(bounded) < most_rows(plain) / 2


def test_a_bound_is_never_under_a_score(spark):
    rng = random.Random(5)
    index = indexed(spark, [" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(3)])
    for expression in ("the and of", "helo fox box", r"\( the \)", "^th of~and"):
        search = S.Search(index, S._tree(expression, DEFAULTS), DEFAULTS)
        chains = search.chains.rows()
        limits = [search.bounds[0].most([S.Match(F.col(f"pos{i}"), F.col(f"code{i}")) for i in range(k)]).alias(f"limit{k}") for k in (1, 2, 3)]
        scored = search._scored(chains).select("doc_id", "score", F.transform("found", lambda x: x["pos"]).alias("at"))
        both = chains.select("doc_id", F.array(*(f"pos{i}" for i in range(search.tree.depth))).alias("at"), *limits).join(scored, ["doc_id", "at"])
        assert both.filter("limit1 < score - 1e-9 or limit2 < score - 1e-9 or limit3 < score - 1e-9").count() == 0 < both.count()


def test_phrases_share_their_beginnings(spark):
    index = indexed(spark, ["a the b", "c of a", "b and and c"])
    tree = S._tree("(a | b | c) (the | and | of)", DEFAULTS)
    assert len(tree.phrases) == 9 and len(tree.at(0)) == 3 and len(tree.at(1)) == 9 and tree.depth == 2 and len(tree.keys) == 6
    one, nine = plan_of(S.search(index, "a the")), plan_of(S.search(index, "(a | b | c) (the | and | of)"))
    exchanges = lambda plan: len(re.findall(r"Exchange hash", plan))
    assert exchanges(nine) == exchanges(one)
    assert {(r.doc_id, r.phrase_id) for r in S.search(index, "('a | 'b | 'c) ('the | 'and | 'of)").collect()} == {(0, 2), (0, 5), (1, 1), (1, 7), (2, 3), (2, 6)}


def test_a_token_with_very_many_words_is_joined(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_WORDS", 3)
    index = indexed(spark, [" ".join(f"w{i} x" for i in range(30))])
    assert S.Lookup(index, S._tree("'x ^w", DEFAULTS)).many(1)
    assert S.combinations(index, phrases("'x ^w")[0]).count() == sum(1 for i in range(30) for j in range(30) if abs((4 * i + 2) - 4 * j) <= 50)


def test_the_sql_order_of_phrases_is_kept(spark):
    index = indexed(spark, ["go left or right", "go up"])
    found = S.search(index, "'go (?up | 'left | 'right)")
    assert {(r.doc_id, r.phrase_id, len(r.found)) for r in found.collect()} == {(0, 0, 1), (1, 0, 1), (0, 1, 2), (0, 2, 2), (1, 3, 2)}


def test_brackets_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(I, "BRACKET_BLOCK", 5)
    rng = random.Random(7)
    texts = ["".join(rng.choice("()[]{}ab") for _ in range(n)) for n in (0, 3, 40, 200)] + ["(" * 30 + ")" * 40, "()" * 30, ")(" * 20]
    index = indexed(spark, texts)
    want = set()
    for d, text in enumerate(texts):
        tokens = re.findall(r"[ab]+|.", text)
        for kind in ("()", "[]", "{}"):
            stack = []
            for i, w in enumerate(tokens):
                if w == kind[0]:
                    stack.append(i)
                elif w == kind[1] and stack:
                    want.add((d, stack.pop(), i))
    assert {tuple(r) for r in index.brackets().collect()} == want
    assert phrase_brackets(phrases(r"\( \)")[0]) == [(0, 1)]


def test_searches_read_stored_brackets(spark, tmp_path):
    indexed(spark, ["x (a) (b c) d"]).write(str(tmp_path / "i"))
    index = I.Index.read(spark, str(tmp_path / "i"))
    assert index.pairs.count() == 2
    plan = plan_of(S.search(index, r"\( \)"))
    assert "struct<doc_id:bigint,open_pos:int,close_pos:int>" in plan and "depth" not in plan


def test_intervals_of_both(spark):
    rng = random.Random(3)

    def some():
        out, at = [], 0
        for _ in range(25):
            at += rng.randint(1, 6)
            out.append((rng.randrange(2), at, at + rng.randint(-1, 4)))
            at = max(at, out[-1][2]) + 1
        return out

    a, b = some(), some()
    inside = lambda rows_: {(d, p) for d, lo, hi in rows_ for p in range(lo, hi + 1)}
    frame = lambda rows_: spark.createDataFrame(rows_, "doc_id long, lo long, hi long")
    got = [tuple(r) for r in intersect_intervals(frame(a), frame(b)).collect()]
    assert inside(got) == inside(a) & inside(b) and len(inside(got)) == sum(hi - lo + 1 for _, lo, hi in got)


def test_scopes_hold_the_positions_inside_them(spark):
    index = indexed(spark, ["x y " * 40, "x y " * 5, "x"])
    scopes = spark.createDataFrame([(0, 10, 20), (0, 15, 30), (0, 100, 120), (1, 0, -1)], "doc_id long, lo long, hi long")
    got = sorted((r.doc_id, r.pos) for r in S.starts(index, phrases("'x")[0][0], scopes=scopes).collect())
    assert got == [(0, p) for p in range(0, 160, 4) if 10 <= p <= 30 or 100 <= p <= 120] + [(2, 0)]


def test_a_document_of_many_scopes_is_linear(spark):
    index = indexed(spark, ["x " * 3000])
    scopes = spark.range(3000).select(F.lit(0).cast("long").alias("doc_id"), F.col("id").alias("lo"), (F.col("id") + 2000).alias("hi"))
    found = S.starts(index, phrases("'x")[0][0], scopes=scopes)
    assert most_rows(found) <= 3 * 6000


@pytest.mark.parametrize(("path", "want"), [("/r/a/b/../../c.md", "/r/c.md"), ("/r/a/b/a/../../c.md", "/r/a/c.md"), ("/../x", "/x"), ("/", "/"), ("/a//./b/", "/a/b"), ("a/../../b", "../b"), ("../../b/.", "../../b"), ("", "")])
def test_paths_fold(spark, path, want):
    assert spark.range(1).select(P.folded(F.lit(path))).first()[0] == want


@pytest.mark.parametrize("expression", ["hello", "hel", "helo", "he", "Hello", "'hello", "^he", "lo$", "ox$", "é", "abcdefghijklmnopqrstuvwxyzabcdefgh", "a", "thereon", "HELLO", "~", "x-y"])
def test_keys_lead_to_all_words_that_fit(spark, tmp_path_factory, expression):
    rng = random.Random(2)
    words = ["hello", "Hello", "HELLO", "hallo", "hell", "he", "ello", "jello", "oh", "helloworld", "ab", "cde", "été", "é", "thereon", "therein", "thorn", "x", "yz", "ox", "fox", "  "]
    words += ["".join(rng.choice("helotrn") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    path = str(tmp_path_factory.getbasetemp() / "keys")
    if not os.path.isdir(path):
        indexed(spark, [" ".join(words)]).write(path)
    index = I.Index.read(spark, path)
    for token in phrases(expression)[0]:
        whole = index.words.filter(T.matches(token.match, token.word or " ", F.col("word"), F.col("word_ci")))
        assert {r.word for r in S.matching_words(index, token).collect()} == {r.word for r in whole.collect()}


def test_fuzzy_words_are_looked_up_by_keys(spark, tmp_path):
    indexed(spark, ["some words"]).write(str(tmp_path / "i"))
    plan = plan_of(S.matching_words(I.Index.read(spark, str(tmp_path / "i")), phrases("thereon")[0][0]))
    grams, words = (next(x for x in plan.splitlines() if f"struct<{c}:string" in x) for c in ("gram", "word"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(gram,", grams) and re.search(r"PushedFilters: \[.*In\(word_ci", words)


def test_a_later_command_supersedes_one_that_runs(spark, tmp_path):
    indexed(spark, ["the fox", "hen"]).write(str(tmp_path / "i"))
    index = I.Index.read(spark, str(tmp_path / "i"))
    nap = F.udf(lambda w: time.sleep(5) or True, "boolean")
    slow = replace(index, words=index.words.filter(nap("word")), grams=None)
    live = Live(History(State.start(slow)))
    first = live.submit("search: 'fox")
    deadline = time.monotonic() + 60
    while not spark.sparkContext.statusTracker().getActiveJobsIds() and time.monotonic() < deadline:
        time.sleep(0.1)
    begin = time.monotonic()
    second = live.submit("filter: path-glob:1")
    with pytest.raises(Cancelled):
        first.result(60)
    assert time.monotonic() - begin < 15
    assert [r.path for r in second.result(120).listed().collect()] == ["/1"]
    assert [str(c) for c, _ in live.history.versions[1:]] == ["filter: path-glob:1"] and live.history.at == 1
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    third = live.submit("search: 'hen")
    live.cancel()
    with pytest.raises(Cancelled):
        third.result(60)
    assert live.history.at == 1


def test_tables_of_a_superseded_command_go(spark, tmp_path):
    index = indexed(spark, ["the fox"])
    live, made = Live(History(State.start(index))), []

    def run(command, committed=True):
        made.append(stored(spark.range(3), "partial"))
        live.cancel()
        return made

    live.history.run = run
    with pytest.raises(Cancelled):
        live.submit("search: 'fox").result(60)
    (path,) = made[0].inputFiles()[:1] and {os.path.dirname(f.removeprefix("file://")) for f in made[0].inputFiles()}
    assert not os.path.exists(path)
