"""Toxicity, vector search and the pipeline."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from phrasegrid.llm import toxicity as tox
from phrasegrid.llm.vector_search import approximate_candidates, top_k

from .conftest import EDGES, rows_of


def test_gradients_are_right():
    net = tox.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = [b"alpha", b"beta", b"gamma"]
    ids, mask = tox._grid([np.array([0, 1, 2, 1]), np.array([2]), np.array([], int)])
    d = np.array([0.3, -0.7, 0.2])

    def loss():
        x = net.inputs(words)
        return float((net.logits({w: net.projected(x, "w", w) for w in "fb"}, ids, mask) * d).sum())

    tape = {}
    x = net.inputs(words, tape)
    net.logits({w: net.projected(x, "w", w) for w in "fb"}, ids, mask, tape)
    got = net.gradients(x, ids, mask, tape, d)

    def slope(values, at):
        before = values[at]
        values[at] = before + 1e-4
        up = loss()
        values[at] = before - 1e-4
        down = loss()
        values[at] = before
        return (up - down) / 2e-4

    for name in ("xwf", "hwb", "cwf", "xbb", "hbf", "hbb", "cbf", "query", "out", "bias"):
        at = tuple(0 for _ in net.p[name].shape)
        assert abs(slope(net.p[name], at) - got[name][at]) < 1e-6, name
    letter = ord("a")
    assert abs(slope(net.p["byte"], (letter, 0)) - got["byte"][letter, 0]) < 1e-6
    for name in ("word", "gram"):
        rows, g = got[name]
        assert abs(slope(net.p[name], (rows[0], 1)) - g[0, 1]) < 1e-6


def plain_score(model, text):
    """A text's score by loops over its windows, words and bytes, one step at a time."""
    p, sig = model.network.p, lambda v: 1 / (1 + np.exp(-v))

    def states(inputs, key):
        u, h = p[f"h{key}"], len(p[f"h{key}"])
        s, out = np.zeros(h), []
        for v in inputs if key[1] == "f" else inputs[::-1]:
            g, hu = v @ p[f"x{key}"] + p[f"c{key}"], s @ u
            z, r = sig(g[:h] + hu[:h]), sig(g[h : 2 * h] + hu[h : 2 * h])
            s = z * s + (1 - z) * np.tanh(g[2 * h :] + r * hu[2 * h :])
            out.append(s)
        return out if key[1] == "f" else out[::-1]

    words = re.findall(rb"[^\x00-\x20\x7F]{1,24}", text.lower().encode())
    vectors = []
    for w in words:
        chars = [p["byte"][c] for c in w]
        core = re.sub(rb"[^a-z\x80-\xff]", b"", w) or w
        marked, parts = b"^" + core + b"$", []
        for n in tox.LENGTHS:
            for k in range(len(marked) - n + 1):
                h = n
                for c in marked[k : k + n]:
                    h = (h ^ c) * 0x100000001B3 % 2**64
                parts.append(p["gram"][(h >> 20) % tox.GRAMS])
        part = np.sum(parts, 0) / len(parts) ** 0.5 if parts else np.zeros(tox.WIDTH)
        vectors.append(np.concatenate([p["word"][xxhash.xxh3_64_intdigest(core) % tox.WORDS], part, states(chars, "bf")[-1], states(chars, "bb")[0]]))
    evidence = []
    for at in range(0, max(len(words) - 48, 0) + 24 if len(words) > 48 else 1, 24):
        if own := vectors[at : at + 48]:
            both = np.concatenate([states(own, "wf"), states(own, "wb")], 1)
            e = np.exp(both @ p["query"] - max(both @ p["query"]))
            logit = (e / e.sum()) @ (both @ p["out"]) + p["bias"][0]
        else:
            logit = tox.NO_WORDS
        evidence.append(np.log1p(np.exp(logit)))
    x = np.log(np.array([sum(evidence), np.mean(evidence), max(evidence)]) + 1e-6)
    return sig(x @ model.weights + model.constant)


def test_scores_are_the_plain_recursion():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefg.1!é") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 5, 47, 48, 49, 72, 73, 96, 97, 300)] + ["x" * 100, " \n", "A b\tc" * 60]
    model = tox.Model()
    model.weights, model.constant = np.array([0.7, 0.2, 1.1]), 0.3
    assert np.allclose(model.scores(texts), [plain_score(model, t) for t in texts], atol=1e-5)
    assert np.allclose(model.scores(texts[::-1])[::-1], model.scores(texts), atol=1e-5)  # the memo changes nothing
    windows = [[words[0].encode().lower()] * 48, []]
    both = model.evidence(windows)
    assert np.isfinite(both).all()


def test_training_rows_are_whole_and_bounded(spark, monkeypatch):
    rows = [(i, f"w{i} " * (2000 if i == 3 else 100), "s") for i in range(1, 40)] + [(7, "again", "s")] * 5
    docs, labels = rows_of(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    bags, toxic = tox.training_rows(docs, labels, F.lit(True), "doc_id", "text", "toxic")
    assert len(bags) == 39 and toxic.sum() == 20 and max(map(len, bags)) == len(tox.window_starts(2000))
    monkeypatch.setattr(tox, "SAMPLE_BYTES", 4000)
    fewer, _ = tox.training_rows(docs, labels, F.lit(True), "doc_id", "text", "toxic")
    assert 2 <= len(fewer) < 20 and all(b in bags for b in fewer)
    # No document is read that is larger than the bound by itself, even the only one of its kind.
    huge, of_huge = rows_of(spark, [(1, "w " * 4000, "s"), (2, "v " * 10, "s")]), labels.filter("doc_id in (1, 2)")
    bags, toxic = tox.training_rows(huge, of_huge, F.lit(True), "doc_id", "text", "toxic")
    assert len(bags) == 1 and toxic.tolist() == [False]


def test_a_sample_holds_each_word_once_and_no_windows(spark):
    docs, labels = rows_of(spark, [(i, f"some words of {i} " * 50, "s") for i in range(1, 21)]), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    bags, _ = tox.training_rows(docs, labels, F.lit(True), "doc_id", "text", "toxic")
    words = [w for bag in bags for window in bag for w in window]
    assert len({id(w) for w in words}) == len(set(words)) == 23
    for bag in bags:
        assert list(bag) == [bag.words[a : a + tox.WINDOW] for a in tox.window_starts(200).tolist()]


def test_windows_cover_all_words():
    for n in (0, 1, 47, 48, 49, 72, 73, 1000):
        starts = tox.window_starts(n)
        assert {k for s in starts for k in range(s, min(n, s + tox.WINDOW))} == set(range(n)) and starts[-1] <= max(0, n - 1)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        bad = i % 4 == 0
        for _ in range(rng.randint(2, 6) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["vilely", "vilest", "Rotten", "rotted"])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns(spark, labelled, monkeypatch):
    monkeypatch.setattr(tox, "EPOCHS", 12)
    rows, labels = labelled
    both = EDGES + [(i + 100, t, s) for i, t, s in rows]
    docs = rows_of(spark, both)
    known = spark.createDataFrame([(i + 100, t) for i, t in labels] + [(None, 1), (100, None), (101, 0)], "doc_id long, toxic int")
    got = tox.toxicity(docs, known).collect()
    assert len(got) == len(both) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {i + 100: t for i, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    kept = tox.without_toxic(docs, known)
    assert kept.columns == docs.columns
    want = collections.Counter(r.doc_id for r in got if not r.predicted)
    assert collections.Counter(r.doc_id for r in kept.select("doc_id").collect()) == want


def test_toxicity_without_labels(spark, edges, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in tox.toxicity(edges, none).collect()} == {0.0}
    assert tox.toxicity(nothing, none).collect() == []


@pytest.mark.parametrize("size", [1, 7, 32])
def test_top_k(spark, size):
    rng = np.random.default_rng(size)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, size) / 2 + (rng.normal(size=size) if i % 3 else 0)]) for i in range(300)]
    rows += [(300, None), (350, [None] * size), (400, [float("nan")] * size), (450, [float("inf")] * size), (None, [1.0] * size), (1, rows[5][1]), (500, [1.0] * (size + 1)), (501, [2.0] * (size + 1)), (550, [])]
    rows += [(i, [9.0] * size) for i in range(600, 640)] + [(600, [9.0] * size)] * 9  # a common vector, and an id many times
    table = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in usable:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in usable if c != q and len(a) == len(b))[:5]
            want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    got = top_k(table, F.col("vec_id") % 50 == 0).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert top_k(table.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_few_exact_vectors_are_read(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(rng.normal(size=(4000, 32)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors, candidates = approximate_candidates(table, F.col("vec_id") % 50 == 0, 5, "vec_id", "embedding", 4096)
    assert "cells" not in vectors.columns and candidates.count() < 80 * 4000 / 20
    assert top_k(table, F.col("vec_id") % 50 == 0, scale=4096).count() == 400


def test_scores_beyond_64_bits_are_refused(spark):
    table = spark.createDataFrame([(0, [1e6]), (1, [1e17])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        top_k(table, F.col("vec_id") == 0)
    assert top_k(table.filter("vec_id = 0").union(spark.createDataFrame([(1, [-1e6])], table.schema)), F.col("vec_id") == 0).first().score == -((256 * 10**6) ** 2)


def test_pipeline_stages(spark, tmp_path, labelled, monkeypatch):
    monkeypatch.setattr(tox, "EPOCHS", 12)
    rows, labels = labelled
    rng = random.Random(2)
    line = "the very same boilerplate line stands on every site"
    docs = [(i, (t + "\n" + line if i % 3 else t), "en", f"s{i % 40}") for i, t, _ in rows]
    docs += [(1000 + i, docs[i][1], "en", "copy") for i in range(0, 60)] + [(2000, None, None, None), (None, "no id", "en", "s1")]
    for k in range(1, 30):
        words = rows[k][1].split()
        words[rng.randrange(len(words))] = "changed"
        docs.append((3000 + k, " ".join(words), "en", "near"))
    frame = spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, out = frame, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(str(tmp_path / name))
        docs = out[name] = spark.read.parquet(str(tmp_path / name))
        if k < 3:
            assert docs.columns == frame.columns
    truth = dict(labels)
    kept = {r.doc_id for r in out["toxicity"].collect()}
    assert sum(i in kept for i in truth if truth[i]) < 0.1 * 100 and sum(i in kept for i in truth if not truth[i]) > 0.95 * 300
    assert out["line_dedup"].count() == out["toxicity"].count()
    lined = [r for r in out["line_dedup"].collect() if r.text and line in r.text]
    assert not [r for r in lined if len(r.text) > 2 * len(line) + 10] and all(r.n_chars == len(r.text) for r in out["line_dedup"].filter("text is not null").collect())
    ids = {r.doc_id for r in out["near_dedup"].collect()}
    assert None in ids and 2000 in ids and not any(1000 + i in ids and i in ids for i in range(60))
    assert {r.doc_id for r in out["packing"].collect()} == ids
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out["packing"].count()


def test_pipeline_cleans_short_pages_but_keeps_copies(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))
    passage, copied = "\n".join(prose(12) for _ in range(5)), [prose(12) for _ in range(20)]
    pages = [prose(40) for _ in range(12)]
    rows = [(i, f"{passage}\n{own}", "en", f"s{i}") for i, own in enumerate(pages)]
    rows += [(100 + i, "\n".join(copied), "en", f"s{i}") for i in range(12)]
    rows += [(200 + i, "\n".join([*copied[:i], copied[i] + " changed", *copied[i + 1 :]]), "en", f"t{i}") for i in range(12)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert {i: got[i].text for i in range(12)} == dict(enumerate(pages)) and all(r.n_chars == len(r.text) for r in got.values())
    assert all(got[i].text == t for i, t, *_ in rows if i >= 100)


def test_pipeline_of_nothing_and_of_columns_with_clashing_names(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long, row long, doc string, kept boolean, gone long, score double, part int, lines_removed long"
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(7, text, "en", "a", 1, 1, "d", False, 1, 0.1, 1, 9), (7, text, "en", "b", 2, 2, "d", True, 1, 0.1, 1, 9), (None, text + " more", "en", "c", 3, 3, "d", None, 1, 0.1, 1, 9), (None, None, None, None, None, None, None, None, None, None, None, 9)]
    for data, left in ([], 0), (rows, 2):
        docs = spark.createDataFrame(data, names).coalesce(1)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
        assert out.count() == left
        assert corpus_pipeline.packing(spark, docs, str(tmp_path)).count() == len(data)
