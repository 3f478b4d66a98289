"""Whole searches, scripts and file lists with the answers known beforehand."""

import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from phrasegrid import cli
from phrasegrid.lang.command import parse_script
from phrasegrid.operators import index as I
from phrasegrid.operators import search as S
from phrasegrid.operators import snippet
from phrasegrid.operators.session import State
from phrasegrid.params import Params
from phrasegrid.sources import files
from phrasegrid.sources.listing import collected, globbed

# A text, and for each expression the lines (from 1) and found words of its five best results. The last one of
# "hel~word" has an equal, with the other space between the two words; of equals the one that comes first in the text's places counts.
TEXT = """abcd
abcdef
ABCD
ABCDEF
ABcd
ABcdEF

'abcd
'abcd'
^efgh
^^efgh
efgh$
efgh$$

abcd$
efgh$

hello world
hello   world

Hello world

HELLO WORLD
"""
ABCD = [[(1, "abcd")], [(3, "ABCD")], [(5, "ABcd")], [(8, "abcd")], [(9, "abcd")]]
ABCDEF = [[(2, "abcdef")], [(4, "ABCDEF")], [(6, "ABcdEF")]]
QUOTED = [[(8, "'abcd")], [(9, "'abcd")]]
HELLO = [[(18, "hello world")], [(19, "hello   world")], [(21, "Hello world")], [(23, "HELLO WORLD")]]
MATCHES = {
    "'abc": [], "'abcd": ABCD, r"\'abcd": [*QUOTED, [(8, "abcd"), (9, "'")], [(9, "abcd'")], [(6, "ABcdEF"), (8, "'")]], "'abcdef": ABCDEF, "''abcd": QUOTED, "'ABCD": [[(3, "ABCD")]], "'ABcd": [[(5, "ABcd")]],
    "^bcd": [], "^abcdef": ABCDEF, "^'abcd": QUOTED, "^ABCD": [[(3, "ABCD")], [(4, "ABCDEF")]], "^ABcd": [[(5, "ABcd")], [(6, "ABcdEF")]], "^abcd": ABCD,
    "bcd$": ABCD, "abcd$$": [[(15, "abcd$")]], "ef$": ABCDEF, "ABCD$": [[(3, "ABCD")]], "EF$": [[(4, "ABCDEF")], [(6, "ABcdEF")]],
    "hel~word": [*HELLO, [(18, "world"), (19, "hello   ")]], "'hello~world": HELLO, "'Hello~world": [[(21, "Hello world")]], "'Hello~World": [], "^hello~wo": HELLO, "^ello~wo": [], "lo~world$": HELLO, "lo~worl$": [],
}


@pytest.fixture(scope="module")
def text_index(spark):
    return I.build(spark.createDataFrame([(0, "/test.txt", TEXT)], "doc_id long, path string, text string"))


def test_kinds_of_match(spark, text_index):
    found = None
    for n, e in enumerate(MATCHES):
        own = snippet.spans(S.ranked(S.search(text_index, e), 5), text_index).withColumn("result_id", F.struct(F.lit(n).alias("n"), "rank"))
        found = own if found is None else found.unionByName(own)
    got = {}
    for r in snippet.word_grid(found, text_index).filter("marked").orderBy("result_id", "pos").collect():
        lines = got.setdefault(r.result_id.n, {}).setdefault(r.result_id.rank, {})
        lines[r.line + 1] = lines.get(r.line + 1, "") + r.word
    for n, (e, want) in enumerate(MATCHES.items()):
        assert sorted(list(x.items()) for x in got.get(n, {}).values()) == sorted(want), e


# Scripts over two equal documents, and which of them are listed then (scopes are a token a level).
CLEAR, GLOB = "clear filter", "filter: path-glob:test0.txt"
FIRST, SECOND, THIRD = "search: 'abcd", "search: 'efgh", "search: '0123"
SCRIPTS = [
    ([FIRST, "narrow level: 1", SECOND], "01"), ([FIRST, "narrow level: 1", THIRD], ""), ([FIRST, "narrow level: 1", "narrow level: 0", THIRD], "01"),
    ([FIRST, "narrow level: 1", THIRD, "narrow level: 1", SECOND], ""), ([FIRST, "narrow level: 2", THIRD, "narrow level: 2", SECOND], "01"), ([FIRST, "narrow level: 2", THIRD, "narrow level: 1", SECOND], "01"),
    ([FIRST, GLOB, SECOND, CLEAR], "01"), ([FIRST, "filter: path-glob:'test0.txt'", SECOND, CLEAR], "01"), ([FIRST, 'filter: path-glob:"test0.txt"', SECOND, CLEAR], "01"), ([FIRST, GLOB, "narrow level: 1", CLEAR], "01"),
    ([FIRST, GLOB, "narrow level: 1", SECOND, CLEAR], "0"), ([FIRST, GLOB, "narrow level: 1", CLEAR, SECOND], "0"), ([FIRST, GLOB, "narrow level: 1", CLEAR, SECOND, "narrow level: 0"], "0"),
    ([FIRST, GLOB, "narrow level: 1", CLEAR, SECOND, "narrow level: 0", SECOND], "01"), ([FIRST, GLOB, "narrow level: 1", CLEAR, "narrow level: 0", SECOND], "01"),
    ([FIRST, GLOB, "narrow level: 1", "narrow level: 0", CLEAR, SECOND], "01"), ([FIRST, GLOB, "narrow level: 1", "narrow level: 0", SECOND, CLEAR], "01"),
]


def test_scopes(spark, tmp_path):
    rows = [(i, f"/w/test{i}.txt", "abcd\nefgh\n0123\nijkl\n") for i in range(2)]
    I.build(spark.createDataFrame(rows, "doc_id long, path string, text string")).write(str(tmp_path / "i"))
    states = {(): State.start(I.Index.read(spark, str(tmp_path / "i")), "/w", Params(tokens_per_search_scope_level=1))}

    def after(script):
        if script not in states:
            states[script] = after(script[:-1]).run(parse_script(script[-1])[0])
        return states[script]

    for script, listed in SCRIPTS:
        assert {r.path for r in after(tuple(script)).listed().select("path").collect()} == {f"/w/test{i}.txt" for i in listed}, script


def test_printed(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "test1.txt").write_text("hello world\n")
    (tmp_path / "test2.txt").write_text("hello\n\nabcd\n\nabcdefgh\n\nhello world abcd\n")
    (tmp_path / "test3.txt").write_text("abcd\n")
    out = io.StringIO()
    assert cli.run(spark, ["--no-config", "--sample", "abcd", "--underline", "."], out) == 0
    assert [x.rstrip() for x in out.getvalue().splitlines()] == [
        f"{tmp_path}/test3.txt", "1: abcd", "   ^^^^", "",
        f"{tmp_path}/test2.txt", "1: hello", "2:", "3: abcd", "   ^^^^", "4:", "5: abcdefgh", "",
        "5: abcdefgh", "6:", "7: hello world abcd", "               ^^^^", "",
        "3: abcd", "4:", "5: abcdefgh", "   ^^^^^^^^", "6:", "7: hello world abcd", "",
    ]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    names = "no-ext empty-paths.txt paths single-path0.txt single-path1.txt test.ext0 test.log test.md test.txt test0/1234.md test0/abcd.txt test0/abcd/efgh.md test0/abcd/efgh.txt "
    names += "test1/5678.md test1/ijkl.txt test1/ijkl/mnop.md test1/ijkl/mnop.txt test2/1234.md test2/abcd/efgh.md miXeD-CaSe/AbCd.md"
    for name in names.split():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).touch()
    os.symlink(root / "test0/abcd/efgh.txt", root / "test2/abcd/efgh.txt")
    os.symlink("../test1/5678.md", root / "test2/56.md")
    os.symlink("../test1/ijkl", root / "test2/ijkl")
    os.symlink("test2", root / "test3")
    os.symlink("test.txt", root / "test-symlink.txt")
    return root


TOP = "empty-paths.txt single-path0.txt single-path1.txt test-symlink.txt test.txt"
DEEP = "test0/abcd.txt test0/abcd/efgh.txt test1/ijkl.txt test1/ijkl/mnop.txt test2/abcd/efgh.txt test2/ijkl/mnop.txt test3/abcd/efgh.txt test3/ijkl/mnop.txt"
MIXED = "miXeD-CaSe/AbCd.md"
# Globs and the files they find.
GLOBS = [
    ("*.log", "test.log"), ("*.txt", TOP), ("./*.txt", TOP), ("test1/../*.txt", TOP), (".", ""), ("..", ""), ("test0/", ""), ("test3", ""), ("test3/../*.txt", TOP),
    ("test3/abcd/*.txt", "test3/abcd/efgh.txt"), ("test3/ijkl/*.md", "test3/ijkl/mnop.md"), ("**/*.txt", f"{TOP} {DEEP}"), ("**/**/*.txt", f"{TOP} {DEEP}"), ("{root}/**/*.txt", f"{TOP} {DEEP}"),
    ("**/test[01]/*.txt", "test0/abcd.txt test1/ijkl.txt"), (MIXED, MIXED), ("mixed-case/abcd.md", ""), (r"\cmixed-case/abcd.md", MIXED), (r"mixed-\ccase/abcd.md", MIXED), (r"mixed-case/\cabcd.md", MIXED),
    (r"mixed-case/abcd.md\c", MIXED), ("MIXED-CASE/ABCD.MD", ""), (r"\cMIXED-CASE/ABCD.MD", MIXED), (r"MIX\cED-CASE/ABCD.MD", MIXED), (r"MIXED-CASE/ABCD.MD\c", MIXED), (r"\\cMixeD-CaSE/AbCd.mD", ""),
    (r"{root}/MIXED-case/*.MD\c", MIXED),
]


@pytest.mark.parametrize(("glob", "found"), GLOBS)
def test_globs(tree, glob, found):
    got = files.collect(globs=[glob.replace("{root}", str(tree))], cwd=str(tree))
    assert {os.path.relpath(f, tree) for f, _ in got} == set(found.split())


def test_globs_and_modes(tree):
    modes = lambda **x: {os.path.relpath(f, tree): m for f, m in files.collect(cwd=str(tree), **x)}
    assert modes(globs=["*.md", "*.log"], single_line_globs=["*.txt"]) == {"test.md": "multi", "test.log": "single"} | dict.fromkeys(TOP.split(), "single")
    assert modes(paths=["test.txt"], single_line_globs=["test.t*"]) == {"test.txt": "single"}
    assert set(modes(globs=["**/*.md"], params=Params(max_depth=1))) == {"test.md"}
    assert modes(paths=["."], params=Params(max_depth=0)) == {} and modes(paths=["test.txt"], params=Params(max_depth=0)) == {"test.txt": "multi"}
    assert len(modes(paths=["."])) == 28 and modes(paths=["."])["test.log"] == "single"


@pytest.mark.parametrize("globs", [GLOBS[:9], GLOBS[9:18], GLOBS[18:]])
def test_globs_by_tasks(spark, tree, globs):
    for glob, found in globs:
        got = globbed(spark, glob.replace("{root}", str(tree)), cwd=str(tree)).collect()
        assert {os.path.relpath(r.path, tree) for r in got} == set(found.split()), glob


def test_trees_by_tasks(spark, tree):
    (tree / ".shown/in").mkdir(parents=True)
    (tree / ".shown/in/x.md").write_text("x")
    for x in ({}, {"paths": [str(tree / "test3"), str(tree / "test.txt")]}, {"paths": [str(tree)], "params": Params(max_depth=1)}, {"globs": ["*.md", "*.log"], "single_line_globs": ["*.txt"]}, {"paths": [str(tree)], "params": Params(scan_hidden=True), "exts": ["md"]}, {"paths": [str(tree), str(tree / ".shown")], "single_line": True}, {"globs": ["**/*.md"], "params": Params(max_depth=1)}, {"paths": [str(tree / "none")]}):
        assert sorted(tuple(r) for r in collected(spark, cwd=str(tree), **x).collect()) == files.collect(cwd=str(tree), **x), x


def test_files_are_read_where_their_rows_are(spark, tree):
    (tree / "test2/bytes.txt").write_bytes(b"\xffx")
    listed = collected(spark, [str(tree)])
    want = {p: open(p, "rb").read() for p, _ in files.collect([str(tree)])}
    got = files.raw_files(spark, listed).collect()
    assert {r.path: bytes(r.content) for r in got} == want and len(want) > 20 and b"" in want.values()
    assert all(r.doc_hash == hashlib.sha512(want[r.path]).hexdigest() and r.mod_time for r in got)
    gone = spark.createDataFrame([(str(tree / "none.txt"), "multi")], "path string, search_mode string")
    assert files.raw_files(spark, gone).count() == 0
