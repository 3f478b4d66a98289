"""Words of documents and of the dictionary are had where texts are tokenized."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from phrasegrid.operators import index as I
from phrasegrid.operators.documents import documents_of, expanded
from phrasegrid.plans import catalog, corpus

from .test_lines_by_bytes import plain_lines, texts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain_words(text):
    return [w for line in plain_lines(0, text, False) for w in line[-1]]


@pytest.mark.parametrize("at_once", [1, 300, 4 << 20])
def test_words_of_documents_and_of_the_dictionary(spark, monkeypatch, at_once):
    monkeypatch.setattr(I, "BYTES_AT_ONCE", at_once)
    rows = list(enumerate(texts() * 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in I.document_words(docs).collect())
    assert got == sorted((i, w, n, len(plain_words(t)) - 1) for i, t in rows for w, n in Counter(plain_words(t)).items())
    lines = I.line_rows(docs, listed=True)
    assert sorted(map(tuple, lines.drop("listed").collect())) == sorted(map(tuple, I.line_rows(docs).collect()))
    assert sorted(map(tuple, I.listed_words(lines).collect())) == sorted(map(tuple, I.word_rows(lines).collect()))
    assert I.document_words(docs.limit(0)).collect() == [] == I.listed_words(I.line_rows(docs.limit(0), listed=True)).collect()


def written(spark, path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("s").alias("source"), F.lit("en").alias("lang"))
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("ids", [lambda i: i, lambda i: i // 2 if i < 90 else i, lambda i: None if i % 3 == 0 else i % 40, lambda i: 7], ids=["unlike", "some shared", "null", "all shared"])
def test_queries_by_word_and_document(spark, tmp_path, ids):
    rows = [(ids(i), t) for i, t in enumerate(texts())]
    path, counts, last = written(spark, tmp_path, rows), {}, {}
    for i, t in rows:
        words = plain_words(t)
        counts.setdefault(i, Counter()).update(words)
        last[i] = max(last.get(i, 0), len(words) - 1)
    run = lambda name: sorted(map(repr, map(tuple, catalog.QUERIES[name](spark, path).collect())))
    assert run("postings") == sorted(repr((w, i)) for i, c in counts.items() for w in c)
    assert run("tokens_per_doc") == sorted(repr((i, sum(c.values()), len(c), last[i])) for i, c in counts.items())
    every = sum(counts.values(), Counter())
    assert run("distinct_words") == sorted(repr((w, n, sum(w in c for i, c in counts.items() if i is not None))) for w, n in every.items())


def test_postings_of_unlike_ids_shuffle_nothing(spark, tmp_path):
    path = written(spark, tmp_path, list(enumerate(texts())))
    assert "Exchange" not in plan_of(catalog.QUERIES["postings"](spark, path))


def test_the_dictionary_of_a_search_is_made_without_the_lines_tokens(spark, tmp_path, monkeypatch):
    plans = {}
    keep = corpus.stored
    monkeypatch.setattr(corpus, "stored", lambda df, name: plans.update({name: plan_of(df)}) or keep(df, name))
    index = corpus.index_for(spark, written(spark, tmp_path, list(enumerate(texts()))))
    assert "listed" in plans["words"] and "tokens" not in plans["words"]
    assert index.words.count() == I.word_rows(index.lines).count() and "listed" not in index.lines.columns


def test_a_document_comes_to_a_bitmap_once_a_key(spark):
    held = spark.createDataFrame([("w", 1)] * 50 + [("v", 1), ("v", 40_000)], "word string, doc_id long")
    sets = documents_of(lambda some: held, [("w", 0), ("v", 0)], {0: {0}}, 10)
    assert sorted(r.doc_id for r in expanded(sets).collect()) == [1, 40_000]
    bitmaps = next(x for x in plan_of(sets).split("\n") if "bitmap_construct_agg" in x)
    assert "SortAggregate" in bitmaps or "HashAggregate" in bitmaps
    assert any("HashAggregate(keys=[key" in x and "doc_id" in x and "functions=[]" in x for x in plan_of(sets).split("\n"))
