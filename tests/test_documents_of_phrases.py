"""Which documents can have a phrase is known from bitmaps before positions are read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from phrasegrid.operators import index as I
from phrasegrid.operators import search as S
from phrasegrid.operators.documents import documents_of, expanded


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """3000 documents; each has "common", every 700th "rare", every third "third"; ids below and above zero and far apart."""
    rows = [(k * 50 - 40_000, f"/{k}", " ".join(["common"] * 2 + ["third"] * (k % 3 == 0) + ["rare"] * (k % 700 == 0) + ["many words here"])) for k in range(3000)]
    path = str(tmp_path_factory.mktemp("index") / "i")
    built = I.build(spark.createDataFrame(rows, "doc_id long, path string, text string"))
    built.write(path)
    return built, I.Index.read(spark, path)


def rows(df):
    return sorted((r.doc_id, r.phrase_id, round(r.score, 6), tuple(x.pos for x in r.found)) for r in df.collect())


def test_bitmaps_hold_any_number(spark):
    rng = random.Random(5)
    ids = {0, 1, -1, 32767, 32768, 32769, -32767, -32768, -32769, 2**40} | {rng.randrange(-(10**6), 10**6) for _ in range(500)}
    held = spark.createDataFrame([("w", i) for i in ids], "word string, doc_id long")
    found = expanded(documents_of(lambda some: held.filter(F.col("word").isin(*some)), [("w", 0)], {0: {0}}, 10))
    assert sorted(r[0] for r in found.collect()) == sorted(ids)


def test_intersections_of_tokens_and_unions_of_phrases(spark):
    rng = random.Random(6)
    held = {(w, rng.randrange(-50_000, 50_000)) for w in "abcdef" for _ in range(20_000)}
    words = [("a", 0), ("b", 0), ("c", 1), ("d", 2), ("a", 2), ("none", 3)]
    phrases = {0: {0, 1}, 1: {1, 2}, 2: {0, 3}}
    of = lambda key: {d for w, d in held if (w, key) in words}
    want = (of(0) & of(1)) | (of(1) & of(2))
    table = spark.createDataFrame(sorted(held), "word string, doc_id long")
    got = expanded(documents_of(lambda some: table.filter(F.col("word").isin(*some)), words, phrases, 2))
    assert sorted(r[0] for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("expression", ["'rare~'many", "'common ('rare | 'third)", "comon rare here", "'nothing 'common"])
def test_searches_find_the_same(spark, corpus, expression):
    built, stored = corpus
    assert built.held is None and stored.held is not None
    assert rows(S.search(stored, expression)) == rows(S.search(built, expression))
    assert {r[0] for r in S.exists(stored, expression).collect()} == {r[0] for r in S.exists(built, expression).collect()}


def test_positions_are_read_for_the_rare_words_documents_only(spark, corpus):
    lookup = S.Lookup(corpus[1], S._tree("'common 'rare", S.DEFAULTS))
    read = lookup.positions([k for k, x in enumerate(lookup.tree.keys) if x.word == "common"])
    assert re.search(r"PushedFilters: \[.*(In|EqualTo)\(doc_id", plan_of(read))
    assert read.select("doc_id").distinct().count() == 5 and read.count() == 10


def test_larger_sets_are_joined_and_sets_of_most_documents_are_not(spark, corpus, monkeypatch):
    monkeypatch.setattr(S, "FEW_DOCS", 3)
    lookup = S.Lookup(corpus[1], S._tree("'common 'rare", S.DEFAULTS))
    assert lookup.positions([0]).count() == 10 and "LeftSemi" in plan_of(lookup.positions([0]))
    lookup = S.Lookup(corpus[1], S._tree("'common 'third", S.DEFAULTS))
    assert lookup.positions([0]).count() == 6000 and "LeftSemi" not in plan_of(lookup.positions([0]))


def test_pruned_documents_and_further_runs(spark, tmp_path):
    path = str(tmp_path / "i")
    one = spark.createDataFrame([("/a", "quick fox"), ("/b", "quick dog")], "path string, text string")
    I.append(one, path)
    I.append(spark.createDataFrame([("/c", "a quick red fox")], "path string, text string"), path)
    index = I.Index.read(spark, path)
    assert index.postings().count() == index.positions.select("word", "doc_id").distinct().count()
    assert len({r[0] for r in S.exists(index, "'quick 'fox").collect()}) == 2
    I.bury(spark, path, index.docs.filter("path = '/a'"))
    index = I.Index.read(spark, path)
    left = index.docs.join(S.exists(index, "'quick 'fox"), "doc_id").collect()
    assert [r.path for r in left] == ["/c"]
    assert index.postings().join(index.docs, "doc_id", "left_anti").count() == 0
