"""Each operator on documents against a brute-force version: odd rows, no rows, and made-up corpora."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phrasegrid.llm.bpe import Encoder, PerfectHash, encode_digests, encoded, load_ranks, merge
from phrasegrid.llm.exact_dedup import chunks, exact_dedup
from phrasegrid.llm.graph import components
from phrasegrid.llm.license_scan import NOTICES, license_scan
from phrasegrid.llm.line_dedup import dedup_lines, spread_lines
from phrasegrid.llm.lm_score import Ppm, _subtries, grams, lm_scores
from phrasegrid.llm.lm_score import _summed as summed
from phrasegrid.llm.near_dedup import near_duplicates
from phrasegrid.llm.packing import fullest, minimum_bin_slack, pack, word_bpe_coder
from phrasegrid.llm.queries import ORACLES, pretokenizer, tokenizer_path
from phrasegrid.llm.token_counts import _whole, count_tokens, document_token_counts, read_flat, write_flat

from .conftest import EDGES, rows_of

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, rng):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus():
    """Documents with exact copies, near copies in chains, and passages in common."""
    rng = random.Random(9)
    texts = [prose(rng.randint(3, 120), rng) for _ in range(60)]
    for k in range(25):
        words = texts[k].split()
        for _ in range(rng.randint(1, 4)):
            words = list(words)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
            texts.append(" ".join(words))
    passage = prose(60, rng)
    texts += [prose(40, rng) + " " + passage for _ in range(20)] + ["short one"] * 3
    rng.shuffle(texts)
    return [(i, t, f"site{i % 7}") for i, t in enumerate(texts)]


def keyed(rows):
    return collections.Counter(map(tuple, rows))


# --- exact dedup


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for k, (i, t, _) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for norm, members in groups.items():
        keep = min(members)[3]
        out += [(rows[k][0], rows[keep][0], len(members), k == keep, hashlib.sha256(norm.encode()).hexdigest()) for *_, k in members]
    return keyed(out)


@pytest.mark.parametrize("rows", [EDGES, corpus()])
def test_exact_dedup(spark, rows):
    assert keyed(exact_dedup(rows_of(spark, rows)).collect()) == brute_exact(rows)


def test_exact_dedup_tells_clashing_chunks_apart(spark):
    rows = corpus()
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(3))
    assert keyed(exact_dedup(rows_of(spark, rows), key=weak).collect()) == brute_exact(rows)


def test_exact_dedup_of_nothing(nothing):
    assert exact_dedup(nothing).collect() == []


def test_chunks_follow_content(spark):
    text = prose(4000, random.Random(1)).replace(" ", "")
    a, b = (r[0] for r in spark.createDataFrame([(text,), ("start" + text,)], "t string").select(chunks(F.col("t"))).collect())
    assert "".join(a) == text and "".join(b) == "start" + text
    assert len(set(a) & set(b)) > len(a) * 0.8


# --- near dedup


def brute_near(rows, similarity=75):
    sets, node = [], {}
    for i, t, _ in rows:
        words = (t or "").encode().lower().split()
        s = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
        sets.append((i, s))
        node[i] = i
    find = lambda x: x if node[x] == x else find(node[x])
    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and None not in (i, j) and 100 * len(s & t) >= similarity * len(s | t):
                x, y = find(i), find(j)
                node[max(x, y)] = min(x, y)
    return keyed((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets)


@pytest.mark.parametrize("rows", [EDGES, corpus()])
def test_near_duplicates(spark, rows):
    assert keyed(near_duplicates(rows_of(spark, rows)).collect()) == brute_near(rows)


def test_near_duplicates_of_nothing(nothing):
    assert near_duplicates(nothing).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7), (None, 3)]
    node = {x: x for e in edges for x in e if x is not None}
    find = lambda x: x if node[x] == x else find(node[x])
    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            node[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


# --- line dedup


def brute_lines(rows, min_sites, min_chars=20):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    sites, texts = collections.defaultdict(set), collections.defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if s is not None:
                sites[strip(line)].add(s)
                texts[strip(line)].add(t or "")
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        hit = [len(strip(x)) >= min_chars and min(len(sites[strip(x)]), len(texts[strip(x)])) >= min_sites for x in lines]
        out.append((i, "\n".join(x for x, h in zip(lines, hit, strict=True) if not h) if any(hit) else t, sum(hit)))
    return keyed(out)


def lined():
    rng = random.Random(3)
    common = [(prose(8, rng), rng.randint(1, 24)) for _ in range(12)]
    rows = []
    for i in range(150):
        lines = [prose(rng.randint(2, 20), rng) for _ in range(rng.randint(1, 8))]
        lines += [c + rng.choice(["", " ", "\t"]) for c, n in common if i % 30 < n and rng.random() < 0.7]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{i % 30}"))
    return rows


def copies():
    """Pages of shared lines alone, pages of one shared line and more of their own, one text on many sites."""
    rng = random.Random(6)
    shared = [f"this line stands on every page number {k}" for k in range(4)]
    rows = [(i, "\n".join([*shared, str(i)] * 2), f"s{i}") for i in range(12)]
    rows += [(20 + i, f"{prose(30, rng)}\n{shared[0]} \r\n{prose(30, rng)}", f"t{i}") for i in range(12)]
    whole = "\n".join(prose(12, rng) for _ in range(5))
    return rows + [(40 + i, whole, f"u{i}") for i in range(12)] + [(60, "\n".join(shared * 3000), "v")]


@pytest.mark.parametrize(("rows", "sites"), [(EDGES, 2), (lined(), 10), (copies(), 10)])
def test_dedup_lines(spark, rows, sites):
    got = dedup_lines(rows_of(spark, rows), min_sites=sites)
    assert keyed(got.select("doc_id", "text", "lines_removed").collect()) == brute_lines(rows, sites)
    assert set(rows_of(spark, []).columns) < set(got.columns)


def test_dedup_lines_deals_out_keys_too_many_to_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = dedup_lines(rows_of(spark, lined()))
        assert keyed(got.select("doc_id", "text", "lines_removed").collect()) == brute_lines(lined(), 10)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_dedup_lines_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "a line that is on every site\nown " + str(i), f"s{i}", i, "k") for i in range(3)], "row long, text string, source string, `doc` long, `gone.x` string")
    got = dedup_lines(docs, min_sites=3)
    assert got.columns == [*docs.columns, "lines_removed"] and keyed(got.collect()) == keyed((i, f"own {i}", f"s{i}", i, "k", 1) for i in range(3))


def test_spread_near_the_threshold_is_exact(spark):
    rows = [(k, f"a line on exactly {n} sites of all\n{k}", f"site{k}") for n in range(6, 16) for k in range(n)]
    rows += [(k, f"a line on many sites in exactly {n} texts\n{k % n}", f"site{k}") for n in range(6, 16) for k in range(40)]
    assert spread_lines(rows_of(spark, rows), 10).count() == 12


def test_dedup_lines_of_nothing(nothing):
    assert dedup_lines(nothing).collect() == []


# --- licences


def brute_licence(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    rng = random.Random(4)
    rows = [*EDGES, (20, "MIT license, MIT LICENSE; apache\nlicense GENERAL public--license mit licenses", "a"), (21, "mit Kelvin K mit İ license", "a")]
    notice = NOTICES["bsd"].split()
    del notice[20:23]
    rows += [(30, prose(50, rng) + " " + " ".join(notice) + " " + prose(50, rng), "a"), (31, " ".join(notice[:8]) + " " + prose(30, rng), "a"), (32, NOTICES["mit"].upper(), "a")]
    got = license_scan(rows_of(spark, rows)).collect()
    assert keyed(tuple(r)[:6] for r in got) == keyed((i, *brute_licence(t)) for i, t, _ in rows)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[30] == "bsd" and labels[31] == "" and labels[32] == "mit" and all(0 <= r.score <= 1 for r in got)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_license_spans_are_verified(spark):
    words, cc = re.findall(r"\w+", NOTICES["mit"]), NOTICES["cc-by"]
    texts = [" ".join(words[:6] * 60), " ".join(words), " ".join(words[:40] + ["so", "to", "say"] + words[40:]), f"{cc} {cc} {cc}", " ".join(words[:6] * 9 + words), " ".join([*words, *words])]
    got = {r.doc_id: r for r in license_scan(rows_of(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert [(got[i].labels, got[i].n_notices) for i in range(6)] == [("", 0), ("mit", 1), ("mit", 1), ("cc-by", 3), ("mit", 1), ("mit", 2)]
    assert got[0].score < 0.2 and got[1].score == 1 and 0.9 < got[2].score < 1 and got[4].score == 1


def test_license_scan_is_its_sql_where_pieces_repeat(spark):
    import duckdb

    rng = random.Random(12)
    texts = ["licensed under cc by licensed under cc by", "this is free and unencumbered text " * 2 + "this is free and unencumbered software"]
    for notice in NOTICES.values():
        words = re.findall(r"\w+", notice)
        for _ in range(6):
            parts = [words[(a := rng.randrange(len(words))) : a + rng.randint(2, len(words))] for _ in range(rng.randint(1, 6))]
            texts.append(" ".join(" ".join(x) + " " + prose(rng.randint(0, 6), rng) for x in parts))
        texts += [" ".join(words * 3), " ".join([*words, *words[:30], *words])]
    got = license_scan(rows_of(spark, [(i, t, "a") for i, t in enumerate(texts)]))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = con.sql(ORACLES["op3_license_scan"])
    plain = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    rows = keyed(plain(r) for r in got.select(*want.columns).collect())
    assert rows == keyed(map(plain, want.fetchall()))
    labels = {r[0]: r[want.columns.index("labels")] for r in rows}
    assert labels[0] == labels[1] == ""


def test_license_scan_of_nothing(nothing):
    assert license_scan(nothing).collect() == []


# --- byte-level BPE and token counts


@pytest.fixture(scope="session")
def reference_bpe():
    import tiktoken

    ranks = load_ranks(tokenizer_path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=pretokenizer(), mergeable_ranks=ranks, special_tokens={})


def strange_texts():
    rng = random.Random(6)
    alphabet = "ab Ab'sé1中\n\t\r   \x1c\x85👍🏽'llst 9²٣_-́‍ÀßİǅΣς½\xa0'veE"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]


def test_encoder_is_the_library(reference_bpe):
    e = Encoder(load_ranks(tokenizer_path("byte_bpe_50k.tiktoken")), pretokenizer())
    for text, ids in zip(strange_texts(), e.encode_all(strange_texts()), strict=True):
        assert ids == reference_bpe.encode_ordinary(text) and e.decode(ids) == text.encode()
    long = "ab" * 700_000 + " c" * 300_000
    assert e.encode(long) == reference_bpe.encode_ordinary(long)


def test_perfect_hash_and_merge():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = PerfectHash(keys, list(range(5000)))
    assert h.find(keys) == list(range(5000)) and h.find([b"no", b""]) == [None, None] and sorted(h.values) == list(range(5000))
    assert PerfectHash([], []).find([b"a"]) == [None]
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b"abab": 3, b"ba": 4}
    assert merge(b"ababa", ranks) == [3, 0]


def test_encode_digests(edges, nothing, reference_bpe):
    args = (tokenizer_path("byte_bpe_50k.tiktoken"), pretokenizer())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in EDGES:
        ids = reference_bpe.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert keyed(encode_digests(edges, *args).collect()) == keyed(want)
    assert encode_digests(nothing, *args).collect() == []
    assert all(bytes(r.bytes).decode() == dict((i, t) for i, t, _ in EDGES)[r.doc_id] for r in encoded(edges.filter("doc_id = 7"), *args).collect())


def test_rows_without_a_count_are_an_error(spark):
    rows = spark.createDataFrame([(1, 0, 5, 3), (2, 0, 6, None)], "doc_id long, file long, position long, n_tokens long")
    assert [tuple(r) for r in _whole(rows.filter("doc_id = 1")).collect()] == [(1, "0", 5, 3)]
    with pytest.raises(Exception, match="row 6 of file 0"):
        _whole(rows).collect()


def test_document_token_counts(edges, nothing, reference_bpe):
    args = (tokenizer_path("byte_bpe_50k.tiktoken"), pretokenizer(), 50256)
    want = keyed((i, len(reference_bpe.encode_ordinary(t or ""))) for i, t, _ in EDGES)
    assert keyed(document_token_counts(edges, *args).select("doc_id", "n_tokens").collect()) == want
    assert document_token_counts(nothing, *args).collect() == []


@pytest.mark.parametrize(("eod", "width", "block"), [(4, 2, 1), (0, 2, 64), (257, 2, 40), (0, 4, 64), (70000, 4, 5000)])
def test_count_tokens_in_flat_files(spark, tmp_path, eod, width, block):
    """Files of any length read by ranges that start anywhere, with ids whose bytes look like the separator's."""
    rng = np.random.default_rng(block)
    want = []
    for k in range(4):
        ids = rng.choice([0, 1, 4, 255, 256, 257, 258, 1024, 65280, eod], 700 + k).astype(f"<u{width}")
        ids = np.r_[ids, eod].astype(f"<u{width}") if k % 2 else np.r_[ids, 257 - 256 * (eod == 257)].astype(f"<u{width}")
        ids.tofile(tmp_path / f"f{k}.bin")
        sizes = np.diff(np.r_[-1, np.flatnonzero(ids == eod), len(ids)]) - 1
        want += [(f"f{k}.bin", n, int(s), n < len(sizes) - 1) for n, s in enumerate(sizes) if n < len(sizes) - 1 or s]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "333")
        blocks = read_flat(spark, str(tmp_path), eod, width, block)
        assert blocks.select("file", "split").distinct().count() > 8
        got = count_tokens(blocks, eod, width).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert keyed((r.file.rpartition("/")[2], r.position, r.n_tokens, r.complete) for r in got) == keyed(want)


def test_flat_files_hold_the_ids_alone(spark, tmp_path, edges, reference_bpe):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    one = edges.coalesce(1)
    assert write_flat(one, str(tmp_path / "flat"), path, pretokenizer(), 50256) == 2
    want = [i for r in one.collect() for i in [*reference_bpe.encode_ordinary(r.text or ""), 50256]]
    (file,) = (tmp_path / "flat").glob("part-*")
    assert np.fromfile(file, "<u2").tolist() == want
    odd = tmp_path / "odd"
    odd.mkdir()
    (odd / "x").write_bytes(b"\x00\x01\x02")
    with pytest.raises(Exception, match="whole number"):
        count_tokens(read_flat(spark, str(odd), 9), 9).collect()


def test_count_tokens_of_long_runs(spark, monkeypatch):
    import phrasegrid.llm.token_counts as tc

    monkeypatch.setattr(tc, "RUN", 3)
    ids = np.array([1, 1, 9, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 9, 9, 1], "<u2")
    blocks = spark.createDataFrame([("f", k, bytearray(ids[k : k + 1].tobytes())) for k in range(len(ids))] + [(None, 0, None)], "file string, block long, data binary")
    got = sorted((r.position, r.n_tokens, r.complete) for r in count_tokens(blocks, 9).collect())
    assert got == [(0, 2, True), (1, 11, True), (2, 0, True), (3, 1, False)]


# --- packing


def test_word_bpe_is_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    full = Tokenizer.from_file(path)
    coder = word_bpe_coder(path)
    texts = [*strange_texts(), "<|endoftext|> a <|startoftext|>b", "The quick brown fox's ½ don't", "x<|endoftext|>'s\n<|ENDOFTEXT|> <|endoftext", "中<|endoftext|><|startoftext|>文 a", " <|endoftext|>"]
    for text, ids in zip(texts, coder.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == full.encode(text, add_special_tokens=False).ids


def check_packing(rows, got, capacity=4096):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, t, _ in rows:
        ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    assert keyed(tuple(r)[:5] for r in got) == keyed(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), math.ceil(sum(r.length for r in got) / capacity)


@pytest.mark.parametrize("rows", [EDGES, corpus() * 6])
def test_pack(spark, rows):
    n, least = check_packing(rows, pack(rows_of(spark, rows), tokenizer_path("word_bpe_49k.json")).collect())
    assert n <= least + 1


def test_pack_nothing(nothing):
    assert pack(nothing, tokenizer_path("word_bpe_49k.json")).collect() == []


def test_fullest_is_the_best_subset():
    rng = random.Random(8)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        use = fullest(counts, room)
        assert all(use[k] <= counts[k] for k in use) and sum(k * v for k, v in use.items()) == max(s for s in sums if s <= room)


def test_minimum_bin_slack_is_near_the_bound():
    rng = random.Random(1)
    counts = collections.Counter(min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20000))
    bins = minimum_bin_slack(dict(counts))
    used = collections.Counter()
    for times, use in bins:
        assert sum(k * n for k, n in use) <= 4096
        for k, n in use:
            used[k] += n * times
    assert used == counts
    assert sum(t for t, _ in bins) <= math.ceil(sum(k * n for k, n in counts.items()) / 4096) + 2


# --- language-model scores


def test_lm_scores(spark, nothing):
    rows = EDGES + [(i + 100, t, s) for i, t, s in corpus()]
    got = lm_scores(rows_of(spark, rows), chunk_bytes=3000).collect()
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    toks = [(i, [*(t or "").encode().lower().split(), None]) for i, t, _ in rows]
    counts = collections.Counter(w for i, ws in toks if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = keyed((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in toks)
    assert keyed((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    levels = summed_levels([(t or "").encode().lower() for i, t, _ in rows if not held(i)])
    model = Ppm(levels)
    texts = {i: t for i, t, _ in rows if i is not None}
    for r in got[:40]:
        if r.doc_id is not None:
            assert math.isclose(r.score, float(model.score(grams([(texts[r.doc_id] or "").encode().lower()])).astype(float).sum()), rel_tol=1e-5)
    assert lm_scores(nothing).collect() == []


def summed_levels(texts, entries=1 << 22):
    code, n = np.unique(grams(texts), return_counts=True)
    levels = {}
    for k in range(2, 6):
        a, b = summed(code & (1 << 8 * (k + 1)) - 1, n)
        keep = b * entries >= n.sum() if k > 2 else slice(None)
        levels[k] = a[keep], b[keep]
    return levels


@pytest.mark.parametrize("entries", [1 << 22, 300, 40])
def test_ppm_is_the_plain_recursion(entries):
    rng = np.random.default_rng(0)
    texts = [bytes(rng.choice(list(b"abcde "), 60)) for _ in range(30)]
    levels = summed_levels(texts, entries)
    nodes = collections.defaultdict(dict)
    for k, (code, n) in levels.items():
        for c, times in zip(code.tolist(), n.tolist(), strict=True):
            nodes[k, c >> 8][c & 255] = times
            if k == 2:
                for key in ((1, c >> 8 & 255), (0, 0)):
                    nodes[key][c & 255] = nodes[key].get(c & 255, 0) + times

    def plain(g):
        p, out = 1.0, set()
        for k in range(5, -1, -1):
            left = {s: c for s, c in nodes.get((k, (g >> 8) & (1 << 8 * k) - 1), {}).items() if s not in out}
            if left:
                total, kinds = sum(left.values()), len(left)
                if g & 255 in left:
                    return p * left[g & 255] / (total + kinds)
                p *= kinds / (total + kinds)
                out |= set(left)
        return p / (256 - len(out))

    model = Ppm(levels)
    test = grams([bytes(rng.choice(list(b"abcdefg "), 50)) for _ in range(10)])
    assert np.allclose(model.score(test), np.log10([plain(int(g)) for g in test]), atol=1e-5)
    for context in np.unique(test >> 8)[:20]:
        assert math.isclose((10.0 ** model.score(np.arange(256) | int(context) << 8).astype(float)).sum(), 1, abs_tol=1e-4)


def test_lm_scores_keep_rare_grams_of_large_corpora(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.choice(list(range(97, 123)) + [32] * 4, 250_000))) for _ in range(24)]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    got = lm_scores(rows_of(spark, rows), F.col("doc_id") >= 20).collect()
    code, n = np.unique(grams([t.encode() for t in texts[:20]]), return_counts=True)
    assert n.sum() > 1 << 22 and (n == 1).any()
    model = Ppm({k: summed(code & (1 << 8 * (k + 1)) - 1, n) for k in range(2, 6)})
    for r in got:
        assert math.isclose(r.score, float(model.score(grams([texts[r.doc_id].encode()])).astype(float).sum()), rel_tol=1e-6)


def test_subtries_are_whole():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 1 << 48, 3000) & ~(0xFFFFF0 << 8)
    code = code[np.argsort(code >> 8 & 0xFFFFFF)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x), pa.array(x + 1)], ["code", "n"]) for x in np.array_split(code, 100)]
    parts = list(_subtries(iter(batches), 50))
    assert len(parts) > 3 and all((n == c + 1).all() for c, n in parts) and (np.concatenate([c for c, _ in parts]) == code).all()
    ends = [set((c >> 8 & 0xFFFFFF).tolist()) for c, _ in parts]
    assert sum(map(len, ends)) == len(set.union(*ends))
