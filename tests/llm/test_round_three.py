"""SimHash, fill-in-middle and alignment against brute force: odd rows, no rows, and made-up corpora."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash

from phrasegrid.llm import alignment as A
from phrasegrid.llm import fill_in_middle as M
from phrasegrid.llm import simhash as H
from phrasegrid.llm.queries import tokenizer_path

from .conftest import EDGES, rows_of
from .test_documents import corpus, keyed

PATH_A, PATH_B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")

ODD = [
    (20, "a  b\tc\n d   é \x85x　y", "a"), (21, "▁ under", "a"), (22, " leading and trailing ", "b"), (23, "中文 字符 with words \x1c and\x1dmore", "b"), (24, "has <S> inside", "a"), (25, "👍🏽 <P", "a"),
    (26, "<s> </s> <|endoftext|> <0x0A> <unk>", "c"), (27, "ab\x00cd 'll we've    z", "c"), (28, "the cat the cat the cat sat", "a"), (29, "﻿ x", "a"), (30, "é ﬁ ½", "a"),
]


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def least_reachable(nodes, links):
    """The least id that each reaches."""
    at = {n: n for n in nodes}
    while True:
        new = dict(at)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == at:
            return at
        at = new


def simhash_rows(rows, radius=4):
    found = [(i, fingerprint(t)) for i, t, _ in rows]
    own = [(i, f) for i, f in found if i is not None]
    links = [(a, b) for (a, f), (b, g) in itertools.combinations(own, 2) if (f ^ g).bit_count() <= radius]
    at = least_reachable({i for i, _ in own}, links)
    return keyed((i, f"{f:016x}", at.get(i)) for i, f in found)


def got_simhash(df):
    return keyed(tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect())


def test_simhash_on_odd_rows(spark, edges, nothing):
    got = got_simhash(H.near_duplicates(edges))
    assert got == simhash_rows(EDGES)
    assert got[3, "0" * 16, 3] == got[4, "0" * 16, 3] == got[5, "0" * 16, 3] == 1
    assert H.near_duplicates(nothing).collect() == []


def near_texts():
    """Long texts and copies with a few words changed, so that fingerprints lie a few bits apart."""
    rng, rows = random.Random(3), [(i, t, s) for i, t, s in corpus()]
    for k in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(300)]
        for _ in range(8):
            words = list(words)
            words[rng.randrange(300)] = f"w{rng.randrange(500)}"
            rows.append((1000 + len(rows), " ".join(words), f"s{k}"))
    return rows


def test_simhash_links_what_brute_force_links(spark):
    rows = near_texts()
    want = simhash_rows(rows)
    assert len({x[2] for x in want}) < len({x[1] for x in want})  # some different fingerprints are linked
    assert got_simhash(H.near_duplicates(rows_of(spark, rows))) == want


@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_close_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)), base ^ np.uint64(0b10110111 << 40), base[:9] ^ np.uint64(0xFF)])
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
    assert set(zip(*(x.tolist() for x in H.close_pairs(fps, fps, True, radius)), strict=True)) == want
    half = len(fps) // 2
    want = {(i, j - half) for i in range(half) for j in range(half, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
    assert set(zip(*(x.tolist() for x in H.close_pairs(fps[:half], fps[half:], False, radius)), strict=True)) == want


@pytest.mark.parametrize("bucket", [4, 40])
def test_large_buckets_are_cut_further_and_dealt_in_parts(spark, monkeypatch, bucket):
    """With small buckets, fingerprints that share many bits go through the finer cut and through pairs of parts."""
    monkeypatch.setattr(H, "BUCKET", bucket)
    monkeypatch.setattr(H, "LANES", 64)
    rng = random.Random(8)
    start = rng.getrandbits(64)
    fps = {start}
    for _ in range(150):
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    edges = [tuple(r) for r in H.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    assert all(((u ^ v) % 2**64).bit_count() <= 4 or u != v for u, v in edges)
    want = least_reachable(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % 2**64).bit_count() <= 4])
    assert least_reachable(signed, edges) == want


# --- fill in middle


def fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle(spark, nothing):
    rows = EDGES + ODD + [(100 + k, f"text {k} of <some> length é", "a") for k in range(100)]
    made = M.fill_in_middle(rows_of(spark, rows))
    assert keyed(tuple(r) for r in made.collect()) == keyed(fim(i, t) for i, t, _ in rows)
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = keyed(tuple(r) for r in M.digests(rows_of(spark, rows)).collect())
    assert got == keyed((*fim(i, t)[:5], sha(fim(i, t)[5]), sha(t or "")) for i, t, _ in rows)
    assert M.digests(nothing).collect() == []


def test_units_end_at_changes_of_class():
    points = np.array([ord(c) for c in "ab  c\nd\n"], "<u4")
    assert M.boundaries(points).tolist() == list(range(9))
    assert M.boundaries(points, "word").tolist() == [0, 2, 4, 5, 6, 7, 8]
    assert M.boundaries(points, "line").tolist() == [0, 6, 8]
    assert M.boundaries(points[:0], "line").tolist() == [0]
    assert M.cut(b"one\ntwo\n", (0, 1), "line") == (8, [b"", b"one\n", b"two\n"])
    n, parts = M.cut(b"a\xff\xfeb\xe2\x82", (1, 3))
    assert n == 6 and parts == [b"a", b"\xff\xfe", b"b\xe2\x82"]


def test_marks_must_be_found_again():
    for marks in (("<P>", "<P>", "<M>"), ("P<", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            M._check(marks)


def test_other_units_and_marks_come_back(spark):
    rows = [(k, "first line\n second <P> line\n\nthird\tline" * (k % 3), "a") for k in range(40)]
    marks = ("[p", "[s", "[m")
    made = M.fill_in_middle(rows_of(spark, rows), unit="word", marks=marks, plain=0, spm=50)
    texts = {i: t for i, t, _ in rows}
    got = made.select("doc_id", "form", "output", M.restored(made["output"], made["form"], marks).alias("back")).collect()
    assert {r.form for r in got} == {"plain", "psm", "spm"} and all(r.back == texts[r.doc_id] for r in got)


# --- alignment


def plain_alignment(rows):
    """By whole texts, byte by byte."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    a.encode_special_tokens = True
    to_byte = {v: k for k, v in bytes_to_unicode().items()}
    token_a = lambda i: bytes(to_byte[c] for c in a.id_to_token(i))
    token_b = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, pairs = [], collections.Counter()
    for doc_id, text, _ in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        ta, tb = list(map(token_a, ids_a)), list(map(token_b, ids_b))
        if not text or not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            docs.append((doc_id, [], [], [], []))
            continue
        owner = lambda ts: [k for k, t in enumerate(ts) for _ in t]
        oa, ob = owner(ta), owner(tb)
        links = sorted(set(zip(oa, ob, strict=True)))
        ends = lambda ts: set(itertools.accumulate(map(len, ts)))
        cuts = sorted(ends(ta) & ends(tb))
        groups = []
        for lo, hi in itertools.pairwise([0, *cuts]):
            groups.append((sorted(set(oa[lo:hi])), sorted(set(ob[lo:hi]))))
        named = [(ids_a[x], ids_b[y]) for x, y in links]
        pairs.update(named)
        docs.append((doc_id, ids_a, ids_b, [([ids_a[x] for x in g], [ids_b[y] for y in h]) for g, h in groups], named))
    best = collections.Counter()
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    for doc_id, ids_a, ids_b, groups, named in docs:
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        yield doc_id, len(ids_a), len(ids_b), len(groups), len(named), sum(pairs[p] == best[p[1]] for p in named), sum(pairs[p] for p in named), hashlib.sha256(text.encode()).hexdigest() if ids_a else ""


def bytes_to_unicode():
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, n = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return out


@pytest.mark.parametrize("chunk_bytes", [300, 8_000_000])
def test_alignment(spark, nothing, chunk_bytes):
    rows = EDGES + ODD + corpus()[:40]
    got = keyed(tuple(r) for r in A.alignment(rows_of(spark, rows), PATH_A, PATH_B, chunk_bytes=chunk_bytes).collect())
    assert got == keyed(plain_alignment(rows))
    assert A.alignment(nothing, PATH_A, PATH_B).collect() == []


def test_alignment_of_documents_of_the_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, "") for r in docs.collect()]
    assert keyed(tuple(r) for r in A.alignment(docs, PATH_A, PATH_B, chunk_bytes=20_000).collect()) == keyed(plain_alignment(rows))


def test_segments_and_links_of_a_text():
    aligner = A.Aligner(PATH_A, PATH_B)
    assert aligner.segments("a b  c\td") == [" a", " b  c\td"]
    groups, links = A.token_links("Hello world", aligner)
    assert len(groups) <= len(links) and A.token_links("", aligner) == ([], []) and A.token_links("▁", aligner) == ([], [])
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(" \n\tab,.é中'0️1S\x85\xa0\x1c") for _ in range(rng.randint(1, 30)))
        whole = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
        groups, _ = A.token_links(text, aligner)
        assert ([i for g, _ in groups for i in g], [i for _, g in groups for i in g]) == whole, text


def test_a_memo_that_overflows_changes_nothing(monkeypatch):
    monkeypatch.setattr(A, "KNOWN", 3)
    small, large = A.Aligner(PATH_A, PATH_B), A.Aligner(PATH_A, PATH_B)
    for text in ("one two three four five", "two three one", "six seven one five", "five"):
        assert A.token_links(text, small) == A.token_links(text, large)
    assert len(small.known) <= 3


def test_bitset():
    rng = np.random.default_rng(1)
    places = np.unique(rng.integers(0, 1000, 300))
    s = A.Bitset.of(places, 1000)
    assert s.select().tolist() == places.tolist()
    assert s.rank(np.arange(1000)).tolist() == [int((places < k).sum()) for k in range(1000)]
    other = A.Bitset.of(np.arange(0, 1000, 3), 1000)
    assert set((s & other).select()) == set(places) & set(range(0, 1000, 3)) and set((s | other).select()) == set(places) | set(range(0, 1000, 3))


# --- passes of the vector search


@pytest.mark.parametrize("bytes_", [1, 700])
def test_vector_search_in_many_passes(spark, monkeypatch, bytes_):
    """However few queries a pass takes, the neighbours are those of brute force."""
    from pyspark.sql import functions as F

    from phrasegrid.llm import vector_search as V

    monkeypatch.setattr(V, "PASS_BYTES", bytes_)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)] + [(200, None), (250, [1.0] * 6), (250, [1.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in V.top_k(table, F.col("vec_id") % 25 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v]
    for q, v in dict(u for u in usable if u[0] % 25 == 0).items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q)[:5]
        want = [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
        assert sorted(got[q]) == sorted(want * (2 if q == 250 else 1))
