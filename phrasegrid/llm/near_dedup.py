"""Near-duplicate detection by b-bit MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, text_slices
from .graph import components

WORDS = 5
#: Of shared shingles in all shingles, in hundredths.
SIMILARITY = 75
#: Minima, the low bits kept of each, and the rows of a band: a pair at similarity 0.75 shares no band once in 200,000.
MINIMA, BITS, ROWS = 128, 4, 4
#: Standard deviations of the estimate that a pair may lie below the threshold and still be compared in full.
SLACK = 5
#: Members of a bucket that one task compares with others.
BUCKET = 2000
#: Bits of the map whose differences bound a pair's differing shingles from below.
BITMAP = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)

FEATURES = "doc_id long, n_shingles long, class_a long, class_b long, signature array<long>, bands array<long>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (bytes apart from ``[\\x20\\x09-\\x0D]``, A-Z lower-cased) and the words of each text."""
    import xxhash

    known: dict[bytes, int] = {}
    out, sizes = [], []
    for t in texts:
        words = t.lower().split()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        sizes.append(len(words))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(sizes, np.int64)


def shingle_sets(texts: list[bytes], n: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: n words, or the whole of a shorter sequence."""
    hashes, sizes = word_hashes(texts)
    ends = np.cumsum(sizes)
    rolled = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        rolled = rolled * _MIX + hashes[k : k + len(rolled)]
    rolled = _mixed(rolled)
    for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        if size >= n:
            yield np.unique(rolled[end - size : end - n + 1])
        elif size:
            h = size
            for x in hashes[end - size : end].tolist():
                h = (h * int(_MIX) + x) % 2**64
            yield _mixed(np.array([h], np.uint64))
        else:
            yield hashes[:0]


def _constants() -> tuple[np.ndarray, np.ndarray]:
    seeds = _mixed(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * _MIX)
    return seeds[:MINIMA], seeds[MINIMA:] | np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each set under each of MINIMA permutations; sets aren't empty."""
    flip, factor = _constants()
    out = np.empty((len(sets), MINIMA), np.uint64)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= 16384):
            total += len(sets[end])
            end += 1
        block = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        work = np.empty_like(block)
        for i in range(MINIMA):
            np.bitwise_xor(block, flip[i], out=work)
            np.multiply(work, factor[i], out=work)
            out[at:end, i] = np.minimum.reduceat(work, starts)
        at = end
    return out


def packed(mins: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima as BITS planes of MINIMA bits: int64 words, plane by plane."""
    planes = [np.packbits((mins >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1) for b in range(BITS)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(mins), MINIMA // ROWS), np.uint64)
    for k in range(ROWS):
        keys = _mixed(keys * _MIX + mins[:, k::ROWS])
    return (keys + np.arange(keys.shape[1], dtype=np.uint64) * _MIX).view(np.int64)


def similarity_estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: agreeing lanes by bit counts, corrected for agreement by chance."""
    words = MINIMA // 64
    differ = []
    for w in range(words):
        lanes = None
        for p in range(BITS):
            x = a[p * words + w].bitwiseXOR(b[p * words + w])
            lanes = x if lanes is None else lanes.bitwiseOR(x)
        differ.append(F.bit_count(lanes))
    chance = 2.0**-BITS
    return (1 - sum(differ[1:], differ[0]) / MINIMA - chance) / (1 - chance)


def least_estimate(similarity: int = SIMILARITY) -> float:
    chance = 2.0**-BITS
    p = similarity / 100 + (1 - similarity / 100) * chance
    return similarity / 100 - SLACK * (p * (1 - p) / MINIMA) ** 0.5 / (1 - chance)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: set size, 128 bits of the set (null if empty), packed signature and band keys."""
    import hashlib

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or b"" for t in batch.column(1).to_pylist()]
            for lo, hi in text_slices(texts):
                sets = list(shingle_sets(texts[lo:hi]))
                full = [i for i, s in enumerate(sets) if len(s)]
                mins = minima([sets[i] for i in full]) if full else np.zeros((0, MINIMA), np.uint64)
                class_ = np.frombuffer(b"".join(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest() for i in full), np.int64).reshape(-1, 2)
                at = np.full(hi - lo, -1)
                at[full] = np.arange(len(full))
                take = pa.array(at, pa.int64(), mask=at < 0)
                lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(m).ravel()), m.shape[1]).cast(pa.list_(pa.int64())).take(take)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.ascontiguousarray(class_[:, k])).take(take) for k in (0, 1)), lists(packed(mins)), lists(band_keys(mins))],
                    ["doc_id", "n_shingles", "class_a", "class_b", "signature", "bands"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(work, FEATURES)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITMAP, bool)
    bits[(shingles % np.uint64(BITMAP)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def sets_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, shingles, bitmap): the full set of each row as sorted hashes, and its bits by hash value."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or b"" for t in batch.column(1).to_pylist()]
            for lo, hi in text_slices(texts):
                sets = list(shingle_sets(texts[lo:hi]))
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64)
                maps = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([bitmap(s) for s in sets])), BITMAP // 64).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), maps], ["rep", "shingles", "bitmap"])

    return docs.select(F.col(id_col).alias("rep"), F.col(text_col).cast("binary").alias("text")).mapInArrow(work, "rep long, shingles array<long>, bitmap array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough, as edges (u, v)."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select(F.col("a").alias("u"), F.col("b").alias("v"))


FILTERS = ("signature", "n", "private", "bitmap")


def private_shingles(sets: DataFrame) -> DataFrame:
    """(rep, n, private): set size, and how many of the shingles no other of the ``sets`` has."""
    shingles = sets.select("rep", F.explode("shingles").alias("s"))
    alone = shingles.groupBy("s").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")).filter("rep = other")
    counts = alone.groupBy("rep").agg(F.count("*").alias("private"))
    sizes = sets.groupBy("rep").agg(F.max(F.size("shingles")).cast("long").alias("n"))
    return sizes.join(counts, "rep", "left").select("rep", "n", F.coalesce("private", F.lit(0)).alias("private"))


def may_link(a: str, b: str, similarity: int) -> Column:
    """Whether two texts can be similar enough. Private shingles bound what they share and bitmaps what they differ in,
    both surely; signatures estimate the similarity."""
    size, private = (lambda x: F.col(f"n_{x}")), (lambda x: F.col(f"private_{x}"))
    shared = F.least(size(a) - private(a), size(b) - private(b))
    bound = 100 * shared >= similarity * (size(a) + size(b) - shared)
    apart = F.aggregate(F.zip_with(F.col(f"bitmap_{a}"), F.col(f"bitmap_{b}"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    bound = bound & (similarity_estimate(F.col(f"signature_{a}"), F.col(f"signature_{b}")) >= least_estimate(similarity))
    return bound & ((100 + similarity) * apart <= (100 - similarity) * (size(a) + size(b)))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    A text's set is its distinct shingles of five words (the whole sequence if it has fewer). Texts are linked when
    their sets share at least ``similarity`` hundredths; a component is all that links reach, named by its least doc_id,
    and the row with that id is kept.

    Method: rows with equal sets become one class. Each class has 128 minima; bands of four give candidates. In every
    bucket the members are first compared with the bucket's least one, then, after components of those links, members
    outside its component with all members in other components than their own and of about their size: pairs inside one
    component can't change it, and all others that may be links are compared. Both times pairs go that can't be links, because too many of their shingles occur in
    no other candidate or differ in a bitmap of hashes, or that the b-bit signatures' bit counts put far under the
    threshold; what is left is confirmed on full sets. A pair at exactly 0.75 is missed about 5 times in a million.

    Null or empty text has an empty set and is linked with nothing. A row without an id takes no part: component_id is
    null and the row is kept. Rows that share an id count as one document of all their texts. An empty table gives no
    rows; other columns aren't read.
    """
    rows = saved(features(docs, id_col, text_col), "features")
    usable = rows.filter("doc_id is not null and class_a is not null")
    classes = usable.groupBy("class_a", "class_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = saved(classes, "classes")
    reps = usable.join(classes.select("class_a", "class_b", F.col("rep").alias("doc_id")), ["class_a", "class_b", "doc_id"])
    reps = saved(reps.select(F.col("doc_id").alias("rep"), "signature", "bands").dropDuplicates(["rep", "signature"]), "reps")
    buckets = reps.select("rep", F.explode("bands").alias("band"))
    heads = buckets.groupBy("band").agg(F.min("rep").alias("head"), F.count("*").alias("members")).filter("members > 1")
    members = saved(buckets.join(heads, "band"), "buckets")
    own = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    sets = saved(sets_of(own.join(members.select("rep").distinct(), "rep", "left_semi"), "rep", "text"), "sets")
    known = saved(reps.select("rep", "signature").join(private_shingles(sets), "rep").join(sets.select("rep", "bitmap"), "rep"), "known")

    def fit(df: DataFrame, column: str, to: str) -> DataFrame:
        return df.join(known.select(F.col("rep").alias(column), *(F.col(c).alias(f"{c}_{to}") for c in FILTERS)), column)

    possible = may_link("a", "b", similarity)
    pairs = members.filter("rep != head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = saved(fit(fit(pairs, "a", "a"), "b", "b").filter(possible).select("a", "b").distinct(), "pairs")
    edges = saved(confirmed(pairs, sets, similarity), "links")
    # The least member of a bucket has been compared with all others; the rest matters where several components meet.
    found = components(edges)
    parted = members.filter("members > 2").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    parted = parted.join(found.select(F.col("node").alias("head"), F.col("component").alias("main")), "head", "left")
    parted = parted.select("band", "rep", "head", "members", F.coalesce("component", "rep").alias("part"), F.coalesce("main", "head").alias("main"))
    parted = parted.filter("rep != head")
    outside = saved(fit(parted.filter("part != main"), "rep", "a").filter(100 * (F.col("n_a") - F.col("private_a")) >= similarity * F.col("n_a")), "outside")
    beside = fit(parted.join(outside.select("band").distinct(), "band", "left_semi"), "rep", "b")
    # Sets that are similar enough are nearly of one size, so rows meet only those of their own and the next size classes; a
    # large bucket's are dealt to more tasks besides.
    size_class = lambda n: F.floor(F.log(F.col(n)) / F.log(F.lit(100.001 / similarity)))
    parts = F.ceil(F.col("members") / BUCKET)
    x = outside.withColumn("near", F.explode(F.sequence(size_class("n_a") - 1, size_class("n_a") + 1))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    x = x.select(F.col("band").alias("band_x"), F.col("near").alias("near_x"), F.col("salt").alias("salt_x"), F.col("rep").alias("x"), F.col("part").alias("part_x"), *(f"{c}_a" for c in FILTERS))
    y = beside.withColumns({"near": size_class("n_b"), "salt": F.pmod(F.xxhash64("rep"), parts)})
    y = y.select(F.col("band").alias("band_y"), F.col("near").alias("near_y"), F.col("salt").alias("salt_y"), F.col("rep").alias("y"), F.col("part").alias("part_y"), *(f"{c}_b" for c in FILTERS))
    meet = x.join(y, (F.col("band_x") == F.col("band_y")) & (F.col("near_x") == F.col("near_y")) & (F.col("salt_x") == F.col("salt_y")) & (F.col("part_x") != F.col("part_y")) & possible)
    rest = saved(meet.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "rest")
    edges = edges.unionByName(saved(confirmed(rest, sets, similarity), "more-links"))
    discard(pairs, outside, rest, known, sets, members, reps)
    # Classes that share an id (repeated ids) meet in it, as do a class's rep and its other rows.
    joins = usable.join(classes.filter("copies > 1"), ["class_a", "class_b"]).filter("doc_id != rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    final = components(edges.unionByName(joins))
    out = rows.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
