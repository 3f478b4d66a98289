"""Lines and tokens cut by columns of bytes, against plain regular expressions; what the catalogue's queries write."""

import random
import re

import pytest
from pyspark.sql import functions as F

from phrasegrid.functions import text as T
from phrasegrid.lang.search import phrases
from phrasegrid.operators import index as I
from phrasegrid.operators import search as S
from phrasegrid.operators.store import stored
from phrasegrid.plans import catalog, corpus


def plain_lines(doc_id, text, paged):
    out, start, line = [], 0, 0
    for page, part in enumerate((text or "").split("\f") if paged else [text or ""]):
        found = re.split("\r?\n", part)
        found = found[:-1] if len(found) > 1 and not found[-1] else found
        for k, content in enumerate(found):
            words = T.py_tokens(content) or [""]
            out.append((doc_id, line, start, start + len(words) - 1, page, k, sum(w != "" and not w.startswith(" ") for w in words), words))
            start, line = start + len(words), line + 1
    return out


def texts():
    rng = random.Random(7)
    parts = ["a", "Bc9", " ", "  ", "\t", "\r", "\n", "\r\n", "\f", "\n\n", "é", "　", "  ", " ", " ", "�", "\x00", "\x7f", "-", "()", "😀", "е", "あ", "x" * 501, " " * 1200, " " * 501]
    fixed = [None, "", "\n", "\r\n", "\r", "\f", "\f\f", "a\f\nb\n\f", "a\n\f", "\n\n", "a", "a\n", "a\r\r\n", "　", "x" * 500, "x" * 1000, "é" * 600]
    return fixed + ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(300)]


@pytest.mark.parametrize("at_once", [1, 300, 4 << 20])
def test_lines_are_what_regular_expressions_cut(spark, monkeypatch, at_once):
    monkeypatch.setattr(I, "BYTES_AT_ONCE", at_once)
    rows = [(i, t, i % 2 == 1) for i, t in enumerate(texts() * 2)]
    docs = spark.createDataFrame(rows, "id long, t string, p boolean").repartition(3)
    for paged, flag in ((False, lambda p: False), (True, lambda p: True), (F.col("p"), lambda p: p)):
        got = sorted(tuple(r) for r in I.line_rows(docs, "id", "t", paged).collect())
        assert got == sorted(x for i, t, p in rows for x in plain_lines(i, t, flag(p)))


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 'k' AS doc_id, cast(unhex('61FF62E28062') AS string) AS text")
    assert [(r.doc_id, r.tokens) for r in I.line_rows(docs).collect()] == [("k", ["a", " ", "b", " ", "b"])]
    assert I.line_rows(docs.limit(0)).collect() == []


@pytest.fixture
def tables(spark, tmp_path):
    text = F.expr("case when id % 7 = 0 then null else concat('the fox ', id, '\n(of) idiot the tété') end")
    spark.range(60).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(60).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(1).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["tokens_per_doc", "line_text", "postings", "content_dedup", "sort_focus", "title_line", "filter_ext"])
def test_queries_of_one_pass_build_no_index(spark, tables, monkeypatch, name):
    def fail(*_, **__):
        raise AssertionError("an index is built")

    for where in (catalog, corpus):
        monkeypatch.setattr(where, "index_for", fail)
    assert catalog.QUERIES[name](spark, tables).count() > 0


def test_searches_sort_no_positions_and_read_them_once(spark, tables, monkeypatch):
    def fail(*_, **__):
        raise AssertionError("all positions are sorted")

    monkeypatch.setattr(I, "sorted_positions", fail)
    written = []
    for where in (S, corpus):
        keep = where.stored
        monkeypatch.setattr(where, "stored", lambda df, name, keep=keep: written.append(name) or keep(df, name))
    assert catalog.QUERIES["phrase_same_line"](spark, tables).count() > 0
    assert written == ["lines", "words", "found-positions"]


def test_a_token_with_many_words_is_found_without_the_dictionary(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(f"/{i}", f"t{i} fox {i}t Tt (é)") for i in range(9)], "path string, text string")
    want = {e: sorted(map(repr, S.search(I.build(docs), e).collect())) for e in ("fox t", "'t0 t", "fox ?t 'fox")}
    monkeypatch.setattr(S, "MOST_WORDS", 3)
    for expression, rows in want.items():
        assert sorted(map(repr, S.search(I.build(docs), expression).collect())) == rows


def test_a_linked_token_with_many_words_is_looked_for_beside_the_one_before_only(spark, monkeypatch):
    rng = random.Random(3)
    parts = ["é", "t", "t1", "2t", "3t", " ", "fox", ",", "\n", "\r\n", "\n\n", "-"]
    docs = spark.createDataFrame([(f"/{i}", "".join(rng.choices(parts, k=rng.randrange(1, 60)))) for i in range(40)], "path string, text string")
    index = I.build(docs)
    index = I.Index.of(stored(index.docs, "docs"), stored(index.lines, "lines"))
    phrase = phrases("ét")[0]

    def found():
        chains = S.Chains(index, S.Tree([(0, phrase)]))
        return chains.lookup.found.filter("key = 1").count(), sorted((r.doc_id, r.pos0, r.pos1, r.word1, r.code1) for r in chains.rows().collect())

    every, want = found()
    monkeypatch.setattr(S, "MOST_WORDS", 3)
    beside, got = found()
    assert got == want and got and beside < every


def test_brackets_of_a_search_come_from_its_tokens_places(spark, monkeypatch):
    rng = random.Random(4)
    docs = spark.createDataFrame([(f"/{i}", "".join(rng.choices("()[] a\n", k=rng.randrange(1, 50)))) for i in range(30)], "path string, text string")
    index = I.build(docs)
    index = I.Index.of(stored(index.docs, "docs"), stored(index.lines, "lines"))
    expression = r"\( \)"
    with monkeypatch.context() as m:
        m.setattr(S, "bracket_pairs", lambda _: index.brackets())
        want = sorted(map(repr, S.search(index, expression).collect()))

    def fail(_):
        raise AssertionError("all lines are read for brackets")

    monkeypatch.setattr(I.Index, "brackets", fail)
    assert sorted(map(repr, S.search(index, expression).collect())) == want and want
