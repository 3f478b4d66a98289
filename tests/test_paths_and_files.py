import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from phrasegrid.functions import paths as P
from phrasegrid.params import Params
from phrasegrid.sources import config, files


@pytest.mark.parametrize(
    ("path", "expected"),
    [("/", "/"), ("a", "/w/a"), ("./a/../b", "/w/b"), ("/a//b/", "/a/b"), ("../../..", "/"), ("/a/./b/..", "/a")],
)
def test_normalize(path, expected):
    assert P.normalize(path, "/w") == expected


@pytest.mark.parametrize(
    ("glob", "path", "fits"),
    [
        ("*.md", "a.md", True), ("*.md", "d/a.md", False), ("**/*.md", "d/e/a.md", True), ("**/*.md", "a.md", True), ("a/**", "a/b/c", True), ("?.md", "ab.md", False), ("[ab].md", "b.md", True),
        ("[!ab].md", "b.md", False), ("*", ".hidden", False), (".*", ".hidden", True), ("**/x", "a/.b/x", False), ("\\cA.MD", "a.md", True), ("\\*", "*", True), ("", "any/thing", True), ("a.c", "abc", False),
    ],
)
def test_glob(spark, glob, path, fits):
    assert spark.range(1).select(P.glob_match(F.lit(path), glob)).first()[0] is fits


@pytest.mark.parametrize(
    ("path", "expected"),
    [
        ("/x/2023-04-05.txt", "2023-04-05"), ("/x/20230405x", "2023-04-05"), ("/2020-01-01/2023 04 05", "2023-04-05"), ("/a 5 mar 2021", None), ("/a 05 mar 2021", "2021-03-05"),
        ("/2021-December-09.md", "2021-12-09"), ("/2021_02_30", None), ("/none", None), ("/12021-01-02", None), ("/2021-01-021", None), ("/2021-0102", None), ("/202101-02", None), ("/20210102345", "2021-01-02"),
        ("/x01feb2020y", "2020-02-01"), ("/01feb20203", None), ("/101feb2020", None), ("2019-05-06/2020-07-08", "2019-05-06"), ("/2019-05-06 20200708", "2020-07-08"),
    ],
)
def test_path_date(spark, path, expected):
    got = spark.range(1).select(P.path_date(F.lit(path))).first()[0]
    assert got == (dt.date.fromisoformat(expected) if expected else None)


def test_common_prefix_and_extensions(spark):
    row = spark.range(1).select(P.common_prefix(F.array(F.lit("abcd"), F.lit("abx"), F.lit("abcc"))), P.extension(F.lit("/a.b/c.TXT")), P.extension(F.lit("/a.b/c")), P.file_format(F.lit("x.pdf"))).first()
    assert tuple(row) == ("ab", ".txt", "", "pdf")
    assert P.extension_list(" .md, TXT,,") == ["md", "txt"]


def _tree(root):
    for name in ("a.txt", "b.log", "c.bin", ".h.md", "d/e.md", "d/f/g.txt", "d/.hid/x.md"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    os.symlink(root / "d", root / "link")


def test_collect(tmp_path):
    _tree(tmp_path)
    names = lambda found: sorted(os.path.relpath(p, tmp_path) for p, _ in found)
    assert names(files.collect([str(tmp_path)])) == ["a.txt", "b.log", "d/e.md", "d/f/g.txt", "link/e.md", "link/f/g.txt"]
    assert dict(files.collect([str(tmp_path)]))[str(tmp_path / "b.log")] == "single"
    assert names(files.collect([str(tmp_path / "c.bin")])) == ["c.bin"]
    assert names(files.collect([str(tmp_path)], params=Params(max_depth=1))) == ["a.txt", "b.log"]
    assert ".h.md" in names(files.collect([str(tmp_path)], params=Params(scan_hidden=True)))
    assert names(files.collect(globs=["**/*.md"], cwd=str(tmp_path))) == ["d/e.md", "link/e.md"]
    assert names(files.collect(globs=["D/**/*.TXT\\c"], cwd=str(tmp_path))) == ["d/f/g.txt"]
    both = files.collect(globs=["a.txt"], single_line_globs=["*.txt"], cwd=str(tmp_path))
    assert [m for _, m in both] == ["single"]


def test_read_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ntwo")
    (tmp_path / "p.html").write_text("<p>Hello <b>you</b></p><script>x</script>")
    rows = {os.path.basename(r.path): r for r in files.read_files(spark, files.collect([str(tmp_path)])).collect()}
    assert rows["a.txt"].text == "one\ntwo" and rows["a.txt"].search_mode == "multi"
    assert "Hello" in rows["p.html"].text and "script" not in rows["p.html"].text
    assert files.read_files(spark, []).count() == 0
    odd = "odd [1]{2},*?.txt"
    (tmp_path / odd).write_text("odd")
    (found,) = files.read_files(spark, files.collect([str(tmp_path / odd)])).collect()
    assert (os.path.basename(found.path), found.text) == (odd, "odd")


def test_config(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / ".phrasegrid").write_text("# note\n--exts\n md \n\n")
    assert config.with_config(["x"], str(tmp_path / "a/b")) == ["--exts", "md", "x"]
    assert config.with_config(["--no-config", "x"], str(tmp_path)) == ["x"]
    (tmp_path / "other").write_text("--hidden")
    assert config.with_config(["--config", str(tmp_path / "other"), "x"], str(tmp_path)) == ["--hidden", "x"]


def test_bytes_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"abc \xff\xfe def\n\xe2\x82 end")
    (row,) = files.read_files(spark, files.collect([str(tmp_path)])).collect()
    assert row.text == "abc �� def\n� end"


def test_failed_conversions_are_told_and_left_out(spark, tmp_path, monkeypatch):
    for name in ("a.pdf", "b.docx", "c.epub", "d.odt", "e.html"):
        (tmp_path / name).write_bytes(b"<p>some bytes</p>")
    tools = tmp_path / "tools"
    tools.mkdir()
    (tools / "pandoc").write_text('#!/bin/sh\nread x\ncase "$2" in docx) echo broken >&2; exit 3;; epub) sleep 30;; odt) echo fine;; *) exit 1;; esac\n')
    (tools / "pandoc").chmod(0o755)
    raw = files.raw_files(spark, files.collect([str(tmp_path)], exts=["pdf", "docx", "epub", "odt", "html"]))
    import pandas as pd

    monkeypatch.setenv("PATH", f"{tools}:/bin:/usr/bin")
    monkeypatch.setattr(files, "CONVERT_SECONDS", 2)
    batch = pd.DataFrame([(r.path, r.search_mode, bytes(r.content), r.doc_hash, r.mod_time, r.format) for r in raw.collect()], columns=raw.columns)
    (out,) = files.convert(iter([batch]))
    found = {os.path.basename(r.path): (r.text, r.error) for r in out.itertuples()}
    assert found["a.pdf"] == (None, "failed to extract text: pdftotext not found")
    assert found["b.docx"] == (None, "failed to extract text: pandoc ended with 3: broken")
    assert found["c.epub"] == (None, "failed to extract text: pandoc took more than 2 seconds")
    assert found["d.odt"] == ("fine\n", None) and found["e.html"] == ("some bytes", None)
    monkeypatch.undo()
    errors = {os.path.basename(r.path) for r in files.extracted(raw).filter("error is not null").collect()}
    assert errors >= {"a.pdf"} and {os.path.basename(r.path) for r in files.texts_of(raw).collect()} >= {"e.html"} - errors
