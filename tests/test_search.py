"""The operators against a plain simulation over small texts."""

import itertools
import math
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from phrasegrid.functions import numbers as N
from phrasegrid.functions.text import py_lower, py_tokens
from phrasegrid.lang.search import phrases
from phrasegrid.operators import filters, snippet
from phrasegrid.operators import index as I
from phrasegrid.operators import links as L
from phrasegrid.operators import search as S
from phrasegrid.operators.cancel import Cancelled, Stop
from phrasegrid.operators.score import phrase_brackets
from phrasegrid.operators.session import History, State, run_script
from phrasegrid.lang.filter import parse_filter
from phrasegrid.streaming.ingest import append_batch, index_stream

TEXTS = {
    "/c/one.txt": ("multi", "The quick (brown) fox\njumps over\n\nthe lazy dog. Hello, hello HELLO help"),
    "/c/two.log": ("single", "quick brown\nfox hello-world\nthe\tquick   fox"),
    "/c/three-2024-02-03.md": ("multi", "été café fox [x](a/b.md) [[note one]] see http://a.b/c?d e\n((a) b) (c"),
    "/c/empty.txt": ("multi", ""),
}


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, p, m, t) for i, (p, (m, t)) in enumerate(TEXTS.items())]
    return I.build(spark.createDataFrame(rows, "doc_id long, path string, search_mode string, text string"))


def tokens_of(text):
    out = []
    for n, line in enumerate(text.split("\n") if text else [""]):
        for w in py_tokens(line) or [""]:
            out.append((n, w))
    return out


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def fits(t, w):
    if not w:
        return False
    if t.word is None:
        return w[0] == " "
    s, sci, wci = t.word, py_lower(t.word), py_lower(w)
    if ord(w[0]) >= 128:
        return w == s
    if t.kind == "fuzzy":
        return sci in wci or (len(w) > 1 and wci in sci) or (len(s) > 2 and len(w) > 2 and sci[0] in wci[:3] and lev(s, wci) <= 2)
    a, b = (wci, sci) if s == sci else (w, s)
    return {"exact": a == b, "prefix": a.startswith(b), "suffix": a.endswith(b)}[t.kind]


def simulate(expression):
    out = set()
    for k, phrase in enumerate(phrases(expression)):
        for d, (mode, text) in enumerate(TEXTS.values()):
            toks = tokens_of(text)
            chains = [[i] for i, (_, w) in enumerate(toks) if phrase and fits(phrase[0], w)]
            for t in phrase[1:]:
                lo, hi = S.window_of(t)
                chains = [c + [j] for c in chains for j in range(max(0, c[-1] + lo), min(len(toks), c[-1] + hi + 1)) if fits(t, toks[j][1]) and (mode == "multi" or toks[j][0] == toks[c[0]][0])]
            out |= {(d, k, tuple(c)) for c in chains}
    return out


@pytest.mark.parametrize("expression", ["quick fox", "'hello", "hel", "'the~'quick", "the quick | café", "?lazy 'dog", "^hel", "lo$", "Hello", "helo", "hello-world", "fox~hello", "été", "'qui"])
def test_combinations(index, expression):
    got = set()
    for k, phrase in enumerate(phrases(expression)):
        if phrase:
            cols = [f"pos{i}" for i in range(len(phrase))]
            got |= {(r[0], k, tuple(r[1:])) for r in S.combinations(index, phrase).select("doc_id", *cols).collect()}
    assert got == simulate(expression)


def test_positions_and_lines(index):
    rows = sorted((r.doc_id, r.pos, r.line, r.word) for r in index.positions.collect())
    assert rows == sorted((d, i, n, w) for d, (_, t) in enumerate(TEXTS.values()) for i, (n, w) in enumerate(tokens_of(t)))
    assert {r.line_text for r in index.line_text().filter("doc_id = 0").collect()} == set(TEXTS["/c/one.txt"][1].split("\n"))


def test_scores(index):
    best = {r.doc_id: round(r.score, 6) for r in S.search(index, "fox").groupBy("doc_id").agg(F.max("score").alias("score")).collect()}
    assert best == {0: 1.21, 1: 1.21, 2: 1.21}
    two = S.ranked(S.search(index, "quick brown")).filter("doc_id = 1 and rank = 1").first()
    # Two exact words, one space apart: 1.2 * 1.1 * (1 - 0.2 * 2 / 50) * 1
    assert math.isclose(two.score, 1.2 * 1.1 * (1 - 0.2 * 2 / 50), abs_tol=1e-9)
    assert S.search(index, "'QUICK").count() == 0 and S.search(index, "()").count() == 0


def test_brackets(index):
    pairs = {(r.doc_id, r.open_pos, r.close_pos) for r in index.brackets().collect()}
    toks = [w for _, w in tokens_of(TEXTS["/c/three-2024-02-03.md"][1])]
    want, stack = set(), {c: [] for c in "([{"}
    for i, w in enumerate(toks):
        if w in stack and w:
            stack[w].append(i)
        elif w in (")", "]", "}") and stack[{")": "(", "]": "[", "}": "{"}[w]]:
            want.add((2, stack[{")": "(", "]": "[", "}": "{"}[w]].pop(), i))
    assert {p for p in pairs if p[0] == 2} == want
    assert phrase_brackets(phrases(r"\(a\) \[b\]")[0]) == [(0, 2), (3, 5)]
    plain, bonus = (S.search(index, e).filter("doc_id = 0").agg(F.max("score")).first()[0] for e in (r"\) brown \(", r"\( brown \)"))
    assert bonus > plain


def test_existence_ignores_mode(index):
    assert {r[0] for r in S.exists(index, "brown fox").collect()} == {0, 1}
    assert {r[0] for r in S.search(index, "'brown 'fox").select("doc_id").distinct().collect()} == {0}


def test_links(index):
    got = {(r.typ, r.link) for r in index.links.collect()}
    assert got == {("markdown", "a/b.md"), ("wiki", "note"), ("url", "http://a.b/c?d")}
    results = S.ranked(S.search(index, "'see")).select(F.lit(1).alias("result_id"), "doc_id", F.col("found")[0]["pos"].alias("lo"), F.col("found")[0]["pos"].alias("hi"))
    assert L.nearest_link(results, index.links).first().typ == "url"
    row = index.docs.sparkSession.range(1).select(L.resolve_markdown(F.lit("../x/./y.md#top"), F.lit("/p/q"), F.lit("/p")), L.resolve_markdown(F.lit("/z.md"), F.lit("/p/q"), F.lit("/p"))).first()
    assert tuple(row) == ("/p/x/y.md", "/p/z.md")


def test_links_end_and_resolve(spark, tmp_path):
    text = "http://a/b\\c d http://a/b`c d\n[x](../m.md#t) [y](/top.md) [[note]] [[sub/note]] [[.near]] [[lost]] [[ote]]"
    (tmp_path / "p/.git").mkdir(parents=True)
    (tmp_path / "p/d").mkdir()
    root = str(tmp_path / "p")
    assert L.project_root(f"{root}/d") == root
    index = I.build(spark.createDataFrame([(f"{root}/d/one.md", text)], "path string, text string"))
    files = spark.createDataFrame([(f"{root}/{x}",) for x in ("d/one.md", "a/note.txt", "z/note.md", "y/sub/note.txt", "other")] + [("/else/lost.md",)], "path string")
    docs = index.docs.select("path", "doc_id", F.lit(root).alias("root"))
    got = [(r.link, r.target.removeprefix(root)) for r in L.resolved(index.links, docs, files).orderBy("start_pos").collect()]
    assert got == [
        ("http://a/b", "http://a/b"), ("http://a/b`c", "http://a/b`c"), ("../m.md#t", "/m.md"), ("/top.md", "/top.md"), ("note", "/z/note.md"), ("sub/note", "/y/sub/note.txt"),
        (".near", "/d/.near.md"), ("lost", "/lost.md"), ("ote", "/z/note.md"),
    ]


def test_nearest_link_against_all_pairs(spark):
    rng = random.Random(2)
    links = [(d, p, p + rng.randint(1, 6), "url", f"{d}-{p}") for d in range(4) for p in sorted(rng.sample(range(200), 0 if d == 3 else 15))]
    results = [(n, rng.randrange(4), lo, lo + rng.randint(0, 5)) for n, lo in enumerate(rng.choices(range(200), k=120))]
    want = {}
    for n, d, lo, hi in results:
        mid = (lo + hi) // 2
        before, after = ([x for x in links if x[0] == d and (x[1] <= mid) == side] for side in (True, False))
        b, a = before[-1] if before else None, after[0] if after else None
        if b and (not a or b[2] >= mid or 2 * (mid - b[1]) <= a[1] - mid):
            want[n] = b[4]
        elif a:
            want[n] = a[4]
    frame = spark.createDataFrame(links, "doc_id long, start_pos int, end_pos int, typ string, link string")
    got = L.nearest_link(spark.createDataFrame(results, "result_id long, doc_id long, lo int, hi int"), frame)
    assert {r.result_id: r.link for r in got.collect()} == want


def test_filters(index):
    names = lambda text: {r.path for r in filters.apply_filter(index.docs, parse_filter(text), index, "/c").select("path").collect()}
    assert names("ext:log") == {"/c/two.log"}
    assert names("path-date:=2024-02-03") == {"/c/three-2024-02-03.md"}
    assert names("not content:fox") == {"/c/empty.txt"}
    assert names("path-fuzzy:\"'tow\"") == set() and names("path-fuzzy:\"'two\"") == {"/c/two.log"}
    assert names("path-glob:*.txt and not \"'dog\"") == {"/c/empty.txt"}
    assert names("") == set(TEXTS)


def test_fuzzy_rank(spark):
    items = spark.createDataFrame([("notes/fox hunt.md",), ("fox.md",), ("box",), ("cat",)], "item string")
    rows = S.fuzzy_rank(items, "fox").orderBy(F.desc("score"), "item").collect()
    assert [r.item for r in rows][:2] == ["fox.md", "notes/fox hunt.md"] and "cat" not in {r.item for r in rows}
    assert S.fuzzy_rank(items, "").count() == 0 and S.fuzzy_rank(items, "()").count() == 0


def test_session(index):
    state = State.start(index, "/c")
    paths = lambda s: {r.path for r in s.listed().select("path").collect()}
    h = run_script(state, "search: fox\nmark listed\nfilter: ext:txt\n")
    assert paths(h.state) == {"/c/one.txt"}
    assert {r.path for r in h.state.marked.collect()} == {"/c/one.txt", "/c/two.log", "/c/three-2024-02-03.md"}
    h.undo()
    assert len(paths(h.state)) == 3
    h.redo()
    h.run("clear filter")
    h.run("drop unmarked")
    assert "/c/empty.txt" not in {r.path for r in h.state.docs.collect()}
    h.run("focus: /c/two.log")
    assert h.state.ordered().first().path == "/c/two.log"
    h.run("path fuzzy rank:")
    assert len(paths(h.state)) == 3
    h.run("sort by: path,desc; path,asc")
    assert h.state.ordered().first().path == "/c/two.log"
    assert h.edit("search: (") == [] or h.edit("nonsense") == ["nonsense", "; error: unknown command: nonsense"]
    assert state.same_as(State.start(index, "/c"))


def test_narrowing(spark):
    docs = spark.createDataFrame([(0, "/a", "x\n" + "y\n" * 300 + "z x"), (1, "/b", "q")], "doc_id long, path string, text string")
    state = State.start(I.build(docs))
    for c in ("search: 'z", "narrow level: 1", "search: 'x"):
        state = run_script(state, c).state
    assert [r.found[0].pos for r in state.shown_results().collect()] == [303]
    state = run_script(state, "narrow level: 0\nsearch: 'x ").state
    assert state.shown_results().count() == 2


def test_history_overwrites_uncommitted(index):
    h = History(State.start(index))
    h.run("search: f", committed=False)
    h.run("search: fo", committed=False)
    h.run("search: fox")
    assert [str(c) for c, _ in h.versions[1:]] == ["search: fox"]


def test_snippets(index):
    found = S.ranked(S.search(index, "'jumps"), 1)
    spanned = snippet.with_context(snippet.spans(found, index), index, 1)
    row = spanned.first()
    assert (row.first_line, row.last_line) == (0, 3)
    text = {r.line: r.text for r in snippet.marked_lines(snippet.spans(found, index), index).collect()}
    assert text == {1: "[jumps] over"}
    assert snippet.wrap([("abc", False), (" ", False), ("defgh", True)], 4) == [[("abc", False), (" ", False)], [("defg", True)], [("h", True)]]
    assert snippet.render("/a", [[("1", [("x", True)]), ("2", [("y", False)])], [("3", [("z", True)])]], underline=True) == "/a\n1: x\n   ^\n2: y\n\n3: z\n   ^"
    assert snippet.most_unique_word(S.search(index, "'the 'lazy").limit(1), index).first().word == "lazy"


def test_prune_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([("/a", "one two"), ("/b", "two"), ("/c", "two")], "path string, text string")
    append_batch(docs, str(tmp_path / "i"))
    append_batch(docs, str(tmp_path / "i"))
    stored = I.Index.read(spark, str(tmp_path / "i"))
    assert stored.docs.count() == 2 and stored.positions.count() == 4
    used = stored.docs.withColumn("last_used", F.when(F.col("path") == "/a", 2).otherwise(1))
    kept = I.prune(I.Index(used, stored.positions, stored.lines, stored.words, stored.links), 1)
    assert [r.path for r in kept.docs.collect()] == ["/a"] and kept.positions.count() == 3
    src = tmp_path / "in"
    docs.write.json(str(src))
    q = index_stream(spark.readStream.schema("path string, text string").json(str(src)), str(tmp_path / "j"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert I.Index.read(spark, str(tmp_path / "j")).docs.count() == 2


def test_batches_share_words_and_survive_a_crash(spark, tmp_path, monkeypatch):
    frame = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    path = str(tmp_path / "i")
    append_batch(frame(("/a", "the fox")), path)
    broken = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with monkeypatch.context() as m:
        m.setattr(I.L, "link_rows", broken)
        with pytest.raises(RuntimeError):
            append_batch(frame(("/b", "a fox again")), path)
    append_batch(frame(("/b", "a fox again")), path)
    append_batch(frame(("/b", "a fox again"), ("/c", "no such")), path)
    index = I.Index.read(spark, path)
    assert S.search(index, "'fox").count() == 2 and index.words.count() == index.words.distinct().count()
    assert index.docs.count() == 3 and index.docs.select("doc_id").distinct().count() == 3 and {r[0] for r in index.docs.select("doc_id").collect()} == {1, 2, 3}
    pruned = I.prune(I.Index(index.docs.withColumn("last_used", F.col("doc_id")), index.positions, index.lines, index.words, index.links), 2)
    pruned.write(path)
    again = I.Index.read(spark, path)
    assert again.docs.count() == 2 and len(list((tmp_path / "i/lines").iterdir())) == 1


def test_sorted_positions_are_pruned(spark, tmp_path):
    I.build(spark.createDataFrame([(f"/{i}", f"word{i} common") for i in range(50)], "path string, text string")).write(str(tmp_path / "i"))
    index = I.Index.read(spark, str(tmp_path / "i"))
    plan = S.starts(index, phrases("'word7")[0][0])._jdf.queryExecution().toString()
    assert "EqualTo(word,word7)" in plan
    assert S.search(index, "'word7 'common").count() == 1
    many = S.among(F.col("word"), [f"word{i}" for i in range(40)] + ["é"])
    assert index.positions.filter(many).count() == 40


def test_documents_are_added_to_a_session(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    path = str(tmp_path / "i")
    append_batch(frame(("/a", "old fox"), ("/b", "hen")), path)
    h = run_script(State.start(I.Index.read(spark, path)), "search: 'fox")
    assert {r.path for r in h.state.listed().collect()} == {"/a"}
    h.add(spark, path, frame(("/a", "no longer"), ("/c", "new fox")))
    assert {r.path for r in h.state.listed().collect()} == {"/c"} and h.state.docs.count() == 3


def test_a_stop_ends_a_search(spark, index):
    stop = Stop(spark)
    with stop.jobs():
        assert S.search(index, "'fox").count()
    stop()
    with pytest.raises(Cancelled), stop.jobs():
        S.search(index, "'fox").count()
    slow, started = Stop(spark), threading.Event()
    threading.Thread(target=lambda: (started.wait(), time.sleep(2), slow())).start()
    nap = F.udf(lambda x: time.sleep(20) or x, "long")
    begin = time.monotonic()
    with pytest.raises(Cancelled), slow.jobs():
        started.set()
        spark.range(4).select(nap("id")).collect()
    assert time.monotonic() - begin < 15


def test_numbers(spark):
    row = spark.range(1).select(N.div_up(F.lit(7), 2), N.div_to_nearest(F.lit(7), 2), N.mebibytes(F.lit(3 << 20)), N.rotated(F.array(*map(F.lit, "abc")), 4), N.rotated(F.array().cast("array<int>"), 1)).first()
    assert tuple(row) == (4, 4, 3.0, ["b", "c", "a"], [])


def test_pages(spark):
    index = I.build(spark.createDataFrame([("/p", "a b\fc\n\fd")], "path string, text string"), paged=True)
    rows = sorted((r.page, r.line, r.line_in_page, r.start_pos, r.end_pos) for r in index.lines.collect())
    assert rows == [(0, 0, 0, 0, 2), (1, 1, 0, 3, 3), (2, 2, 0, 4, 4)]
    by_format = I.build(spark.createDataFrame([("/p.pdf", "a\fb", "pdf"), ("/p.txt", "a\fb", "text")], "path string, text string, format string"))
    assert sorted((r.page, r.line) for r in by_format.lines.collect()) == [(0, 0), (0, 0), (1, 1)] or by_format.docs.select("doc_id").distinct().count() == 1
    at = index.locations(spark.createDataFrame([(index.docs.first().doc_id, 2), (index.docs.first().doc_id, 3)], "doc_id long, pos int"))
    assert sorted((r.pos, r.line, r.pos_in_line, r.page, r.line_in_page) for r in at.collect()) == [(2, 0, 2, 0, 0), (3, 1, 0, 1, 0)]
    assert [r.word for r in index.words_between(index.docs.first().doc_id, 1, 3).orderBy("pos").collect()] == [" ", "b", "c"]


def test_candidate_limit():
    assert [S.candidate_limit("x" * n) for n in (1, 2, 3, 4, 5, 6, 7, 60)] == [2, 6, 15, 39, 97, 244, 500, 500]
    assert list(itertools.islice(phrases("a"), 1))
