import io

import pytest
from pyspark.sql import functions as F

from phrasegrid import cli
from phrasegrid.lang.opening import OpeningError, fill, parse_opening


@pytest.fixture
def tree(tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("alpha beta\ngamma")
    (tmp_path / "b.md").write_text("beta only")
    monkeypatch.chdir(tmp_path)
    return tmp_path


def run(spark, *argv):
    out = io.StringIO()
    code = cli.run(spark, ["--no-config", *argv], out)
    return code, out.getvalue()


def test_listings_and_exit_codes(spark, tree):
    assert run(spark, "--search", "'beta", "-l", ".") == (0, f"{tree}/b.md\n{tree}/a.txt\n")  # equal scores: the earlier place first
    assert run(spark, "--search", "'alpha", "--files-without-match", ".") == (0, f"{tree}/b.md\n")
    assert run(spark, "--search", "'nothing", "-l", ".") == (1, "")
    assert run(spark, "--filter", "ext:md", ".") == (0, f"{tree}/b.md\n")


def test_snippets_and_scripts(spark, tree):
    code, text = run(spark, "--sample", "'alpha", "--underline", ".")
    assert code == 0 and text.splitlines()[:3] == [f"{tree}/a.txt", "1: alpha beta", "   ^^^^^"]
    (tree / "s").write_text("; a script\nsearch: 'beta\nfilter: ext:txt\n")
    assert run(spark, "--script", "s", "-l", ".") == (0, f"{tree}/a.txt\n")


def test_an_index_is_used_again(spark, tree, monkeypatch):
    from phrasegrid.sources import files

    made = []
    extract = files.texts_of
    monkeypatch.setattr(files, "texts_of", lambda raw: made.append(sorted(r.path for r in raw.select("path").collect())) or extract(raw))
    args = ("--index-path", str(tree / ".index"), "--search", "'beta", "-l", ".")
    assert run(spark, *args)[0] == 0 and [len(x) for x in made] == [2]
    (tree / "c.txt").write_text("a new beta")
    (tree / "d.txt").write_text("beta only")
    assert run(spark, *args) == (0, f"{tree}/b.md\n{tree}/d.txt\n{tree}/a.txt\n{tree}/c.txt\n") and made[1:] == [[f"{tree}/c.txt"]]
    (tree / "a.txt").unlink()
    assert f"{tree}/a.txt" not in run(spark, *args)[1] and made[2:] == [[]]
    assert run(spark, "--index-path", str(tree / ".index"), "--cache-limit", "2", "--index-only", "c.txt", "b.md") == (0, "")
    stored = cli.Index.read(spark, str(tree / ".index"))
    assert {r.title for r in stored.docs.collect()} == {"a new beta", "beta only"}


def test_stdin_links_scores_and_completion(spark, tree, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.StringIO("piped text"))
    assert run(spark, "--stdin", "--search", "'piped", "-l") == (0, "<stdin>\n")
    (tree / "l.md").write_text("see http://x.y/z and [t](b.md)")
    assert run(spark, "--links", "l.md") == (0, f"{tree}/l.md\turl\thttp://x.y/z\thttp://x.y/z\n{tree}/l.md\tmarkdown\tb.md\t{tree}/b.md\n")
    code, text = run(spark, "--search", "'alpha", "--debug", "--open-with", "txt:terminal=edit +{line_num} {path}", "a.txt")
    assert text.splitlines() == [f"{tree}/a.txt", "(Score: 1.210000)", "1: alpha beta", "2: gamma", f"edit +1 {tree}/a.txt", ""]
    assert run(spark, "--complete", f"{tree}/", ".") == (0, f"{tree}/\n") and run(spark, "--complete", f"{tree}/l", ".") == (0, f"{tree}/l.md\n")


def test_pages_are_labelled(spark, tree, monkeypatch):
    from phrasegrid.sources import files

    monkeypatch.setattr(files, "_extract", lambda path, content: "one\ftwo words\nthree")
    (tree / "p.pdf").write_bytes(b"%PDF")
    monkeypatch.setattr(files, "texts_of", lambda raw: raw.drop("content").withColumn("text", F.lit("one\ftwo words\nthree")))
    assert run(spark, "--search", "'words", "p.pdf")[1].splitlines()[:4] == [f"{tree}/p.pdf", "Page 1, Line 1: one", "Page 2, Line 1: two words", "Page 2, Line 2: three"]


def test_script_library(spark, tree):
    (tree / "s").write_text("search: 'beta\n")
    assert run(spark, "--script", "s", "--script-dir", "lib", "--save-script", "mine", "-l", ".")[0] == 0
    assert run(spark, "--script-dir", "lib", "--list-scripts") == (0, "mine.script\n")
    assert run(spark, "--script-dir", "lib", "--script", "mine", "-l", "b.md") == (0, f"{tree}/b.md\n")
    with pytest.raises(ValueError):
        run(spark, "--script-dir", "lib", "--script", "other", "-l", ".")


def test_validation(spark):
    for argv in (["--search", "a", "--sample", "b"], ["-l", "--files-without-match"], []):
        with pytest.raises(cli.UsageError):
            run(spark, *argv)


def test_openings():
    o = parse_opening("pdf:foreground=viewer --page {page_num} {path} {{x}")
    assert fill(o, {"path": "/a b", "page_num": 3}) == "viewer --page 3 '/a b' {x}"
    for bad in ("pdf=x {path}", "pdf:foreground=x", "txt:terminal=x {path} {page_num}", "txt:odd=x {path}", "txt:terminal=x {path} {no}", "txt:terminal={path"):
        with pytest.raises(OpeningError):
            parse_opening(bad)
