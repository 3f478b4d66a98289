"""SimHash near-duplicates: fingerprints compared by bit planes, inside buckets that no close pair can miss."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, text_slices
from .graph import components

WORDS = 4
#: Differing bits up to which fingerprints are linked.
RADIUS = 4
SEED = 42
#: Fingerprints of a bucket that are compared in one place; larger buckets are cut by more bits, then into pairs of parts.
BUCKET = 4096
#: Fingerprints that are compared at a time, as queries and as lanes of the bit planes.
LANES = 512
#: Bit planes after which blocks are looked at again, to be abandoned.
STRIDE = 16


def fingerprint_of(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of 64-bit hashes the bits that over half of them have; of an empty run none."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, starts[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * counts > sizes[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_hashes(text: bytes, n: int = WORDS) -> list[int]:
    """XXH64 of all shingles of n words (A-Z lower-cased, one space between), or of the whole of a shorter sequence."""
    import xxhash

    words = text.lower().split()
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    return [xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[n - 1 :], strict=False)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as a signed long) of each row's whole text; without words it is zero."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            out = np.zeros(len(texts), np.uint64)
            for lo, hi in text_slices(texts, 1_000_000):
                if hi - lo == 1:  # maybe long: its counts are added up part by part
                    h = np.array(shingle_hashes(texts[lo]), np.uint64)
                    counts = sum((np.unpackbits(h[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for k in range(0, len(h), 65536)), np.zeros(64, np.int64))
                    out[lo] = np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0]
                    continue
                each = [shingle_hashes(t) for t in texts[lo:hi]]
                sizes = np.array([len(x) for x in each], np.int64)
                hashes = np.fromiter(itertools.chain.from_iterable(each), np.uint64, int(sizes.sum()))
                out[lo:hi] = fingerprint_of(hashes, np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(work, "doc_id long, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row p has bit p of all fingerprints, 64 lanes a word."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    padded = np.zeros((64, -(-len(fps) // 64) * 64), np.uint8)
    padded[:, : len(fps)] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save sum of three words of lanes: sums and carries."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _over(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, many: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius."""
    over, equal = many, ~many
    for counter, bit in ((fours, radius & 4), (twos, radius & 2), (ones, radius & 1)):
        if bit:
            equal = equal & counter
        else:
            over, equal = over | (equal & counter), equal & ~counter
    return over


def close_pairs(queries: np.ndarray, lanes: np.ndarray, same: bool, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the queries and lanes that differ in at most ``radius`` bits (up to 7); of the same array only i < j.

    Four planes at a time are added to the lanes' counters; queries whose lanes have all gone over the radius are given up.
    """
    sliced, own = planes_of(lanes), planes_of(queries)
    rows = np.arange(len(queries))
    asked = np.unpackbits(own.view(np.uint8), axis=1, bitorder="little")[:, : len(queries)].astype(np.uint64) * np.uint64(2**64 - 1)
    shape = (len(queries), sliced.shape[1])
    gone = np.ones((len(queries), shape[1] * 64), np.uint8)
    gone[:, : len(lanes)] = np.tri(len(queries), len(lanes), dtype=np.uint8) if same else 0
    many = np.packbits(gone, axis=1, bitorder="little").view("<u8")
    ones, twos, fours = (np.zeros(shape, np.uint64) for _ in range(3))
    for at in range(0, 64, STRIDE):
        for p in range(at, at + STRIDE, 4):
            x = [sliced[k] ^ asked[k, rows, None] for k in range(p, p + 4)]
            ones, a = _add(ones, x[0], x[1])
            ones, b = _add(ones, x[2], x[3])
            twos, c = _add(twos, a, b)
            many, fours = many | (fours & c), fours ^ c
        over = _over(ones, twos, fours, many, radius)
        live = (~over).any(axis=1)
        rows, ones, twos, fours, many = rows[live], ones[live], twos[live], fours[live], many[live]
        if not len(rows):
            return rows, rows
    i, j = np.nonzero(np.unpackbits((~over)[live].view(np.uint8), axis=1, bitorder="little"))
    return rows[i], j


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a graph's edges as many as connect what they connect: every node with the least one it reaches."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            moved = np.flatnonzero(label != np.arange(n))
            return label[moved], moved


def bucket_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all fingerprints of a bucket which close ones connect, compared LANES by LANES."""
    i, j = [], []
    for a in range(0, len(fps), LANES):
        for b in range(a, len(fps), LANES):
            x, y = close_pairs(fps[a : a + LANES], fps[b : b + LANES], a == b, radius)
            x, y = spanning(x + a, y + b, len(fps))
            i.append(x)
            j.append(y)
    return spanning(np.concatenate(i), np.concatenate(j), len(fps)) if len(i) > 1 else (i[0], j[0])


def _linked(radius: int):
    """From rows of key, lo, hi, fp, sorted by the first three: edges between close fingerprints of a bucket.

    Small buckets that follow each other are compared together; what is close beyond one's own bucket is close, too.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, run = np.zeros((0, 4), np.int64), []

        def edges(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            fps = np.unique(fps)
            i, j = bucket_links(fps.view(np.uint64), radius)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(fps[i]), pa.array(fps[j])], ["u", "v"])

        for batch in itertools.chain(batches, [None]):
            rows = held
            if batch is not None:
                rows = np.concatenate([held, np.column_stack([c.to_numpy() for c in batch.columns])])
            cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist(), *([len(rows)] if batch is None else [])]
            for lo, hi in itertools.pairwise(bounds):
                if hi - lo < 2:
                    continue
                if sum(map(len, run)) + hi - lo > LANES and run:
                    yield from edges(np.concatenate(run))
                    run = []
                if hi - lo > LANES:
                    yield from edges(rows[lo:hi, 3])
                else:
                    run.append(rows[lo:hi, 3])
            held = rows[bounds[-1] :].copy()
        if run:
            yield from edges(np.concatenate(run))

    return work


def blocks(bits: int, n: int) -> list[tuple[int, int]]:
    """(offset, width) of n blocks of nearly equal width."""
    ends = [bits * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(ends)]


def _block(value: Column, block: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(value, block[0]).bitwiseAND(F.lit((1 << block[1]) - 1))


def _keys(value: Column, cut: list[tuple[int, int]]) -> Column:
    """A key for each pair of blocks: the pair's number, and the bits of both."""
    width = max(w for _, w in cut)
    pairs = itertools.combinations(cut, 2)
    return F.array(*(F.shiftleft(F.shiftleft(F.lit(k).cast("long"), width).bitwiseOR(_block(value, a)), width).bitwiseOR(_block(value, b)) for k, (a, b) in enumerate(pairs)))


def _rest(value: Column, key: Column, cut: list[tuple[int, int]]) -> Column:
    """The bits of the blocks that aren't in a key's pair, side by side."""
    width = max(w for _, w in cut)
    out = F.lit(None).cast("long")
    for k, pair in enumerate(itertools.combinations(cut, 2)):
        joined, at = F.lit(0).cast("long"), 0
        for block in (b for b in cut if b not in pair):
            joined = joined.bitwiseOR(F.shiftleft(_block(value, block), at))
            at += block[1]
        out = F.when(F.shiftrightunsigned(key, 2 * width) == k, joined).otherwise(out)
    return out


def _large(rows: DataFrame, name: str) -> DataFrame:
    return saved(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET), name)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect all of the distinct fingerprints (fp) which pairs of at most ``radius`` differing bits do.

    Of radius + 2 blocks such a pair shares two, so it meets in the bucket of these two blocks' bits. A bucket of over BUCKET
    fingerprints is cut by its other bits in the same way; what is large even then is dealt to tasks by pairs of parts. So
    no task has more than two parts, no pair is missed, and only connecting edges leave a task.
    """
    if not 0 <= radius <= 7:
        raise ValueError("the radius is from 0 to 7")
    cut = blocks(64, radius + 2)
    rows = distinct.select("fp", F.explode(_keys(F.col("fp"), cut)).alias("key"))
    large = _large(rows, "large-buckets")
    rest = 64 - 2 * max(w for _, w in cut)
    again = blocks(rest, radius + 2)
    width = 2 * max(w for _, w in again) + 8
    finer = rows.join(large.select("key"), "key").select("fp", "key", F.explode(_keys(_rest(F.col("fp"), F.col("key"), cut), again)).alias("more"))
    # Negative keys, so that they differ from those of the first cut.
    finer = saved(finer.select("fp", F.bitwise_not(F.shiftleft(F.col("key"), width).bitwiseOR(F.col("more"))).alias("key")), "finer-buckets")
    larger = _large(finer, "larger-buckets")
    zero = F.lit(0).cast("long")
    small = rows.join(large.select("key"), "key", "left_anti").unionByName(finer.join(larger.select("key"), "key", "left_anti"))
    parts = F.ceil(F.col("n") / BUCKET)
    part = F.pmod(F.xxhash64("fp"), parts)
    paired = finer.join(larger, "key").select("key", "fp", part.alias("part"), F.explode(F.sequence(zero, parts - 1)).alias("other"))
    met = small.select("key", zero.alias("lo"), zero.alias("hi"), "fp").unionByName(paired.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "fp"))
    dealt = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").select("key", "lo", "hi", "fp")
    return dealt.mapInArrow(_linked(radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id.

    A fingerprint's bit is 1 if over half the shingles' hashes have it: shingles of four words (A-Z lower-cased, parted by
    ASCII white space), repeats included; a shorter sequence is one. Fingerprints that differ in at most ``radius`` bits are
    linked, and a component is all that links reach, named by its least doc_id.

    Equal fingerprints become one node. Nodes that can be close meet in buckets, where bit planes are compared (see
    :func:`links`); components are found in tables.

    Null, empty and wordless texts have fingerprint zero and are linked like others. A row without an id takes no part: its
    component_id is null. Rows that share an id are one document. An empty table gives no rows; other columns aren't read.
    """
    rows = saved(fingerprints(docs, id_col, text_col), "fingerprints")
    usable = rows.filter("doc_id is not null")
    nodes = saved(usable.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    edges = saved(links(nodes.select("fp"), radius), "links")
    shared = usable.groupBy("doc_id").agg(F.min("fp").alias("u"), F.max("fp").alias("v")).filter("u < v")
    own = usable.join(shared.select("doc_id", "u"), "doc_id").select("u", F.col("fp").alias("v")).filter("u < v")
    found = components(edges.unionByName(own), "simhash-components").select(F.col("node").alias("fp"), "component")
    named = saved(nodes.join(found, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")), "named")
    # Saved, so that the join deals out both sides and can split a large component's nodes.
    least = saved(named.groupBy("component").agg(F.min("rep").alias("component_id")), "least-ids")
    of = saved(named.join(least, "component").select("fp", "component_id"), "component-ids")
    discard(edges, nodes, named, least)
    out = rows.join(of, "fp", "left")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
