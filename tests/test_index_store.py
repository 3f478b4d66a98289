"""The stored index: manifest, merging of runs, tombstones, and a crash at each step."""

import json
import os

import pytest
from pyspark.sql import functions as F

from phrasegrid.lang.search import phrases
from phrasegrid.operators import index as I
from phrasegrid.operators import search as S


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def folders(path, table="docs"):
    return sorted(n for n in os.listdir(f"{path}/{table}") if not n.startswith("."))  # without checksums


def found(spark, path, expression="'fox"):
    index = I.Index.read(spark, path)
    return {r.path for r in index.docs.join(S.search(index, expression).select("doc_id").distinct(), "doc_id").collect()}


def test_many_appends_leave_few_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "FANOUT", 3)
    path = str(tmp_path / "i")
    for k in range(10):
        I.append(frame(spark, (f"/{k}", f"fox number{k} (x)")), path)
        assert len(folders(path)) <= 2 * 3
    assert all(folders(path, t) == folders(path) for t in I.TABLES) and len(folders(path, "manifest")) == 1
    assert found(spark, path) == {f"/{k}" for k in range(10)} and found(spark, path, "'number7") == {"/7"}
    index = I.Index.read(spark, path)
    assert index.words.count() == index.words.select("word").distinct().count() and index.brackets().count() == 10
    assert {r[0] for r in index.docs.select("doc_id").collect()} == set(range(1, 11))


def test_pruning_writes_tombstones_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    for k in range(3):
        I.append(frame(spark, (f"/{k}", f"fox {k} [[l]] (x)")), path)
    before = {t: folders(path, t) for t in I.TABLES}
    gone = I.Index.read(spark, path).docs.filter("path = '/2'")
    I.bury(spark, path, gone)
    assert {t: folders(path, t) for t in I.TABLES} == before and len(folders(path, "tombstones")) == 1
    index = I.Index.read(spark, path)
    assert found(spark, path) == {"/0", "/1"}
    assert [index.positions.filter("doc_id = 3").count(), index.links.filter("doc_id = 3").count(), index.brackets().filter("doc_id = 3").count()] == [0, 0, 0]
    # Its number isn't used again, and it may come back.
    I.append(frame(spark, ("/2", "fox 2 [[l]] (x)")), path)
    assert found(spark, path) == {"/0", "/1", "/2"} and I.Index.read(spark, path).docs.agg(F.max("doc_id")).first()[0] == 4
    monkeypatch.setattr(I, "FANOUT", 2)
    I.bury(spark, path, I.Index.read(spark, path).docs.filter("path = '/0'"))
    I.bury(spark, path, I.Index.read(spark, path).docs.filter("path = '/1'"))
    assert len(folders(path, "tombstones")) <= 2 and found(spark, path) == {"/2"}
    I.compact(spark, path)
    assert len(folders(path)) == 1 and not os.path.isdir(f"{path}/tombstones") or folders(path, "tombstones") == []
    assert found(spark, path) == {"/2"} and I.Index.read(spark, path).positions.select("doc_id").distinct().count() == 1


def test_the_least_recently_used_go(spark, tmp_path):
    path = str(tmp_path / "i")
    I.append(frame(spark, ("/a", "fox one"), ("/b", "fox two"), ("/c", "fox three")), path)
    I.touch(spark, path, I.Index.read(spark, path).docs.filter("path != '/b'"))
    I.prune_stored(spark, path, 2)
    assert found(spark, path) == {"/a", "/c"}


STEPS = ["line_rows", "word_rows", "sorted_positions", "bracket_pairs", "write_text"]


@pytest.mark.parametrize("step", STEPS)
def test_a_crash_at_any_step_leaves_what_was_there(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "i")
    I.append(frame(spark, ("/a", "the fox")), path)
    lost = lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost"))
    with monkeypatch.context() as m:
        m.setattr(I, step, lost)
        with pytest.raises(RuntimeError):
            I.append(frame(spark, ("/b", "a fox again")), path)
    assert found(spark, path) == {"/a"}
    I.append(frame(spark, ("/b", "a fox again")), path)
    assert found(spark, path) == {"/a", "/b"} and len(folders(path)) == 2 and {len(folders(path, t)) for t in I.TABLES} == {2}


def test_a_crash_while_merging(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    monkeypatch.setattr(I, "FANOUT", 2)
    I.append(frame(spark, ("/a", "the fox")), path)
    write, calls = I.write_text, []

    def second(*a):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("lost")
        write(*a)

    with monkeypatch.context() as m:
        m.setattr(I, "write_text", second)
        with pytest.raises(RuntimeError):
            I.append(frame(spark, ("/b", "a fox again")), path)
    assert found(spark, path) == {"/a", "/b"}
    I.append(frame(spark, ("/b", "a fox again"), ("/c", "fox three")), path)
    assert found(spark, path) == {"/a", "/b", "/c"}


def test_manifests_are_whole(spark, tmp_path):
    path = str(tmp_path / "i")
    I.append(frame(spark, ("/a", "the fox")), path)
    (name,) = folders(path, "manifest")
    held = json.loads((tmp_path / "i/manifest" / name).read_text())
    assert len(held["runs"]) == 1 and held["next_id"] == 2
    with pytest.raises(FileExistsError):
        I.write_text(spark, f"{path}/manifest/{name}", "{}")
    with pytest.raises(ValueError):
        I.Index.read(spark, str(tmp_path / "none"))


def test_positions_lie_in_ranges_of_words(spark, tmp_path):
    """A word that fills files is dealt to several; others are each in one, and files don't overlap but in their ends."""
    texts = [(f"/{k}", " ".join(f"w{k}{j % 50} common" for j in range(60))) for k in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        I.build(frame(spark, *texts)).write(str(tmp_path / "i"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    index = I.Index.read(spark, str(tmp_path / "i"))
    files = index.positions.groupBy(F.input_file_name().alias("file")).agg(F.min("word").alias("lo"), F.max("word").alias("hi"), F.count("*").alias("n")).orderBy("lo", "hi").collect()
    assert len(files) > 1 and all(a.hi <= b.lo or a.lo == b.lo for a, b in zip(files, files[1:], strict=False))
    assert max(f.n for f in files) < 0.6 * sum(f.n for f in files)
    rows = [tuple(r) for r in index.positions.select("word", "doc_id", "pos").collect()]
    assert len(rows) == len(set(rows)) == 40 * 239
    assert S.starts(index, phrases("'common")[0][0]).count() == 2400
