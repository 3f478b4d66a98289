"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of, saved, text_slices

#: Words of a window, and from one window's start to the next's: each word but the first few is in two.
WINDOW, STRIDE = 48, 24
#: At most so many labelled documents of each kind are learnt from, whole, and fewer if they have more bytes than this.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_BYTES = 1000, 3000, 24_000_000
#: Bytes of a word; a longer run is several words, end to end.
LONGEST = 24
#: Buckets of words and of parts of words, the parts' lengths in bytes, and the size of their vectors.
WORDS, GRAMS, LENGTHS, WIDTH = 1 << 14, 1 << 15, (4, 6), 12
#: Vectors of bytes, units each way over the bytes of a word and over the words of a window.
BYTE_WIDTH, BYTE_UNITS, UNITS = 8, 4, 12
EPOCHS, STEPS, BAGS, RATE = 30, 700, 24, 6e-3  # whichever of the first two ends sooner
#: Logit of a window without words: no evidence at all.
NO_WORDS = -15.0
#: Words whose inputs a worker keeps; beyond, it starts afresh.
KEPT_WORDS = 100_000
WORD = re.compile(rb"[^\x00-\x20\x7F]{1,%d}" % LONGEST)
NOT_LETTERS = re.compile(rb"[^a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    """Runs of anything but white space, in lower case: digits and marks stay, as spellings hide behind them."""
    return WORD.findall(text.lower().encode())


def window_starts(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover n words; one window at least."""
    return np.arange(max(1, -(-(n - WINDOW) // STRIDE) + 1)) * STRIDE


class Windows(Sequence):
    """A document's windows of words, cut as they are asked for, so that overlapping ones take no room."""

    def __init__(self, words: list[bytes]):
        self.words, self.starts = words, window_starts(len(words))

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, i: int) -> list[bytes]:
        at = int(self.starts[i])
        return self.words[at : at + WINDOW]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Windows) and self.words == other.words


def word_features(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """A word's bucket, all words' part buckets one after the other, and which word each part belongs to (ascending).

    Both go by the word's letters, if it has any: a mark beside or between them makes no other word.
    """
    import xxhash

    cores = [NOT_LETTERS.sub(b"", w) or w for w in words]
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % WORDS for w in cores), np.int64, len(words))
    sizes = np.array([len(w) + 2 for w in cores], np.int64)
    flat = np.frombuffer(b"".join(b"^" + w + b"$" for w in cores), np.uint8).astype(np.uint64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    grams, owners = [], []
    for n in LENGTHS:
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ flat[k : k + len(h)]) * np.uint64(0x100000001B3)
        keep = np.arange(len(h)) + n <= ends[: len(h)]
        grams.append(((h >> np.uint64(20)) % np.uint64(GRAMS)).astype(np.int64)[keep])
        owners.append(owner[: len(h)][keep])
    grams, owners = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, owners))
    order = np.argsort(owners, kind="stable")
    return bucket, grams[order], owners[order]


def byte_columns(words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The words' order from the longest down, and for each place the bytes there of those that reach it, in that order."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer(b"".join(words), np.uint8)
    begins = (np.cumsum(sizes) - sizes)[order]
    reach = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")
    return order, [flat[begins[:n] + t].astype(np.int64) for t, n in enumerate(reach.tolist())]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _cell(g: np.ndarray, state: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """A gated recurrent unit's update and reset gates, candidate, and what the reset gate let through, before it."""
    h, hu = len(u), state @ u
    zr = _sigmoid(g[:, : 2 * h] + hu[:, : 2 * h])
    z, r, through = zr[:, :h], zr[:, h:], hu[:, 2 * h :]
    return z, r, np.tanh(g[:, 2 * h :] + r * through), through


def _cell_back(d_new: np.ndarray, before: np.ndarray, cell: tuple, m, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gradients of a unit's inputs and of the state before; adds nothing where the mask is 0."""
    z, r, c, through = cell
    d_c = d_new * m * (1 - z) * (1 - c * c)
    d_z = -d_new * m * (c - before) * z * (1 - z)
    d_r = d_c * through * r * (1 - r)
    d_hu = np.concatenate([d_z, d_r, d_c * r], 1)
    return np.concatenate([d_z, d_r, d_c], 1), d_hu, d_new * (1 - m * (1 - z)) + d_hu @ u.T


def _recur(projected: np.ndarray, ids: np.ndarray, mask: np.ndarray, u: np.ndarray, forward: bool, tape: list | None) -> np.ndarray:
    """States [step, row, unit] of a gated recurrent layer over rows of ``projected``; where the mask is 0 a state stays."""
    (n, steps), h = ids.shape, len(u)
    state, states = np.zeros((n, h), u.dtype), np.empty((steps, n, h), u.dtype)
    for t in range(steps) if forward else range(steps - 1, -1, -1):
        z, r, c, through = _cell(projected[ids[:, t]], state, u)
        m = mask[:, t, None]
        if tape is not None:  # a copy, as the view would keep the other gates' sums
            tape.append((t, state, (z, r, c, through.copy()), m))
        states[t] = state + m * (1 - z) * (c - state)
        state = states[t]
    return states


def _back(tape: list, u: np.ndarray, d_states: np.ndarray, ids: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """From the gradient of the states that of ``projected`` (of so many rows) and of ``u``."""
    n, h = len(ids), len(u)
    d_u, d_state = np.zeros_like(u), np.zeros((n, h), u.dtype)
    d_all = np.empty((ids.shape[1], n, 3 * h), u.dtype)
    for t, before, cell, m in reversed(tape):
        d_all[t], d_hu, d_state = _cell_back(d_state + d_states[t], before, cell, m, u)
        d_u += before.T @ d_hu
    return _sum_rows(d_all.reshape(-1, 3 * h), ids.T.ravel(), rows), d_u


def _read(projected: np.ndarray, columns: list[np.ndarray], n: int, u: np.ndarray, forward: bool, tape: list | None) -> np.ndarray:
    """Last states of n rows, longest first, whose inputs at each place number rows of ``projected``."""
    state = np.zeros((n, len(u)), u.dtype)
    for ids in columns if forward else columns[::-1]:
        own = state[: len(ids)]
        z, _, c, _ = cell = _cell(projected[ids], own, u)
        if tape is not None:
            tape.append((ids, own.copy(), cell))
        own += (1 - z) * (c - own)
    return state


def _read_back(tape: list, u: np.ndarray, d_state: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """From the gradient of the last states that of ``projected`` (of so many rows) and of ``u``."""
    d_u, parts, at, d_state = np.zeros_like(u), [], [], d_state.copy()
    for ids, before, cell in reversed(tape):
        d_g, d_hu, d_state[: len(ids)] = _cell_back(d_state[: len(ids)], before, cell, 1, u)
        d_u += before.T @ d_hu
        parts.append(d_g)
        at.append(ids)
    if not parts:
        return np.zeros((rows, 3 * len(u)), u.dtype), d_u
    return _sum_rows(np.concatenate(parts), np.concatenate(at), rows), d_u


class Network:
    """Window logits. Two levels of bidirectional gated recurrent layers: one reads the bytes of each word, the other the
    words of a window, each as its own vector, the sum of its parts' vectors and its bytes' last states; softmax attention
    with a learnt query pools the states of the latter."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": f(WORDS, WIDTH, scale=0.1), "gram": f(GRAMS, WIDTH, scale=0.1), "query": f(2 * UNITS, scale=0.5), "out": f(2 * UNITS, scale=0.5), "bias": np.full(1, -2, np.float32)}
        self.p["byte"] = f(256, BYTE_WIDTH, scale=0.5)
        for level, d, h in (("b", BYTE_WIDTH, BYTE_UNITS), ("w", 2 * WIDTH + 2 * BYTE_UNITS, UNITS)):
            for way in "fb":
                key = level + way
                self.p |= {f"x{key}": f(d, 3 * h, scale=d**-0.5), f"h{key}": f(h, 3 * h, scale=h**-0.5), f"c{key}": np.zeros(3 * h, np.float32)}

    def projected(self, x: np.ndarray, level: str, way: str) -> np.ndarray:
        return x @ self.p[f"x{level}{way}"] + self.p[f"c{level}{way}"]

    def inputs(self, words: list[bytes], tape: dict | None = None) -> np.ndarray:
        """Each word's vector, its parts' and its bytes' last state in both ways."""
        bucket, grams, owners = word_features(words)
        counts = np.bincount(owners, minlength=len(words))
        parts = np.zeros((len(words), WIDTH), self.p["gram"].dtype)
        if len(grams):
            has = counts > 0
            parts[has] = np.add.reduceat(self.p["gram"][grams], (np.cumsum(counts) - counts)[has]) / np.sqrt(counts[has])[:, None]
        order, columns = byte_columns(words)
        tapes = {w: [] for w in "fb"} if tape is not None else {"f": None, "b": None}
        states = np.empty((len(words), 2 * BYTE_UNITS), self.p["byte"].dtype)
        states[order] = np.concatenate([_read(self.projected(self.p["byte"], "b", w), columns, len(words), self.p[f"hb{w}"], w == "f", tapes[w]) for w in "fb"], 1)
        if tape is not None:
            tape |= {"bytes": tapes, "features": (bucket, grams, owners, counts, order)}
        return np.concatenate([self.p["word"][bucket], parts, states], 1)

    def logits(self, projected: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """ids [windows, WINDOW] number rows of projected inputs; mask is 0 beyond a text's end."""
        ways = {w: [] for w in "fb"} if tape is not None else {"f": None, "b": None}
        states = np.concatenate([_recur(projected[w], ids, mask, self.p[f"hw{w}"], w == "f", ways[w]) for w in "fb"], 2)
        e = np.where(mask.T > 0, states @ self.p["query"], -1e9)
        a = np.exp(e - e.max(0)) * mask.T
        a = a / np.maximum(a.sum(0), 1e-9)
        if tape is not None:
            tape |= {"ways": ways, "states": states, "a": a, "pooled": np.einsum("tn,tnh->nh", a, states)}
        logits = np.einsum("tn,tn->n", a, states @ self.p["out"]) + self.p["bias"][0]
        return np.where(mask[:, 0] > 0, logits, NO_WORDS)

    def gradients(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, tape: dict, d_logit: np.ndarray) -> dict:
        """Of all parameters, from those of the logits; a window without words has no say."""
        p, g = self.p, {}
        d_logit = d_logit * (mask[:, 0] > 0)
        a, states, pooled = tape["a"], tape["states"], tape["pooled"]
        g["bias"], g["out"] = d_logit.sum(keepdims=True), pooled.T @ d_logit
        d_pooled = d_logit[:, None] * p["out"]
        d_e = a * (np.einsum("tnh,nh->tn", states, d_pooled) - (pooled * d_pooled).sum(1))
        g["query"] = np.einsum("tn,tnh->h", d_e, states)
        d_states = a[:, :, None] * d_pooled + d_e[:, :, None] * p["query"]
        d_x = np.zeros_like(x)
        for k, way in enumerate("fb"):
            d_proj, g[f"hw{way}"] = _back(tape["ways"].pop(way), p[f"hw{way}"], d_states[:, :, k * UNITS : (k + 1) * UNITS], ids, len(x))
            d_x += self._projection(g, "w" + way, d_proj, x)
        bucket, grams, owners, counts, order = tape["features"]
        g["word"] = _used_rows(d_x[:, :WIDTH], bucket)
        g["gram"] = _used_rows((d_x[:, WIDTH : 2 * WIDTH] / np.sqrt(np.maximum(counts, 1))[:, None])[owners], grams)
        g["byte"] = np.zeros_like(p["byte"])
        for k, way in enumerate("fb"):
            first = 2 * WIDTH + k * BYTE_UNITS
            d_proj, g[f"hb{way}"] = _read_back(tape["bytes"][way], p[f"hb{way}"], d_x[order, first : first + BYTE_UNITS], 256)
            g["byte"] += self._projection(g, "b" + way, d_proj, p["byte"])
        return g

    def _projection(self, g: dict, key: str, d_proj: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Adds the gradients of a projection of ``x`` to ``g``; that of ``x``."""
        g[f"c{key}"], g[f"x{key}"] = d_proj.sum(0), x.T @ d_proj
        return d_proj @ self.p[f"x{key}"].T


def _used_rows(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row numbers in order, and the sum of the rows of each."""
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    return at[first], np.add.reduceat(rows, first) if len(first) else rows


def _sum_rows(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, rows.shape[1]), np.float32)
    used, sums = _used_rows(rows, at)
    out[used] = sums
    return out


def _grid(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of windows, padded to WINDOW, and their mask."""
    ids, mask = np.zeros((len(sequences), WINDOW), np.int64), np.zeros((len(sequences), WINDOW), np.float32)
    for i, s in enumerate(sequences):
        ids[i, : len(s)], mask[i, : len(s)] = s, 1
    return ids, mask


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _evidence(logits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each document: all windows' evidence, the mean window's and the strongest window's, as logs."""
    s = _softplus(logits.astype(np.float64))
    total, most = np.add.reduceat(s, starts), np.maximum.reduceat(s, starts)
    n = np.diff(np.r_[starts, len(s)])
    return np.log(np.stack([total, total / n, most], 1) + 1e-6)


class Model:
    """The network and the weights that turn a document's windows into one score."""

    def __init__(self) -> None:
        self.network = Network()
        self.weights, self.constant = np.array([1.0, 0, 0]), 0.0
        self.flat: float | None = None
        self.memo: dict[bytes, np.ndarray] = {}

    def fit(self, bags: list[list[list[bytes]]], toxic: np.ndarray, seed: int = 11) -> Model:
        """``bags``: documents as lists of windows of words. A toxic document needs one toxic window, a clean one has none."""
        if not toxic.any() or toxic.all():
            self.flat = float(toxic.mean()) if len(toxic) else 0.0
            return self
        number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        coded = [[np.fromiter((number[w] for w in win), np.int32, len(win)) for win in bag] for bag in bags]
        vocabulary = list(number)
        rng, moments, step = np.random.default_rng(seed), {}, 0
        weight = np.where(toxic, min(4.0, (~toxic).sum() / toxic.sum()), 1.0)
        # Every fifth document sets the document weights instead.
        held = np.arange(len(bags)) % 5 == 4 if toxic[4::5].sum() >= 8 else np.zeros(len(bags), bool)
        train = np.flatnonzero(~held)
        epochs = min(EPOCHS, -(-STEPS // -(-len(train) // BAGS)))
        for epoch in range(epochs):
            order = rng.permutation(train)
            for at in range(0, len(order), BAGS):
                own = order[at : at + BAGS]
                windows = [w for i in own for w in coded[i]]
                starts = np.cumsum([0, *(len(coded[i]) for i in own[:-1])])
                local, inverse = np.unique(np.concatenate(windows) if any(map(len, windows)) else np.zeros(1, np.int64), return_inverse=True)
                cuts = np.cumsum([len(w) for w in windows])[:-1]
                ids, mask = _grid(np.split(inverse, cuts) if any(map(len, windows)) else windows)
                tape: dict = {}
                x = self.network.inputs([vocabulary[i] for i in local] if vocabulary else [b""], tape)
                z = self.network.logits(self._projected(x), ids, mask, tape).astype(np.float64)
                total = np.repeat(np.add.reduceat(_softplus(z), starts), np.diff(np.r_[starts, len(z)]))
                t, w = (np.repeat(v[own], np.diff(np.r_[starts, len(z)])) for v in (toxic, weight))
                d = np.where(t, -1 / np.expm1(np.maximum(total, 1e-6)), 1.0) * _sigmoid(z) * w / len(own)
                step += 1
                self._descend(self.network.gradients(x, ids, mask, tape, d.astype(np.float32)), moments, step, RATE * (1 - epoch / epochs))
        seen = np.flatnonzero(held) if held.any() else train
        self._weigh(np.concatenate([self.evidence(bags[i]) for i in seen]), toxic[seen])
        return self

    def _descend(self, gradients: dict, moments: dict, step: int, rate: float) -> None:
        """Adam; of the vector tables only the rows in use."""
        parts = {name: g if isinstance(g, tuple) else (slice(None), g) for name, g in gradients.items()}
        norm = np.sqrt(sum(float((g * g).sum()) for _, g in parts.values()))
        for name, (rows, g) in parts.items():
            g = g * min(1.0, 2 / (norm + 1e-9))
            m, v = moments.setdefault(name, (np.zeros_like(self.network.p[name]), np.zeros_like(self.network.p[name])))
            m[rows] = 0.9 * m[rows] + 0.1 * g
            v[rows] = 0.99 * v[rows] + 0.01 * g**2
            self.network.p[name][rows] -= rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.99**step)) + 1e-6)

    def _weigh(self, x: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic regression of the label on the evidence, kept near its start by a penalty."""
        mean, scale = x.mean(0), x.std(0) + 1e-3
        a = np.c_[(x - mean) / scale, np.ones(len(x))]
        w = np.zeros(4)
        for _ in range(30):
            p = _sigmoid(a @ w)
            hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([0.5] * 3 + [1e-3])
            w -= np.linalg.solve(hess, a.T @ (p - toxic) + np.r_[0.5 * w[:3], 1e-3 * w[3]])
        self.weights, self.constant = w[:3] / scale, w[3] - (w[:3] / scale) @ mean

    def _projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {w: self.network.projected(x, "w", w) for w in "fb"}

    def evidence(self, windows: list[list[bytes]]) -> np.ndarray:
        number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        ids, mask = _grid([np.fromiter((number[w] for w in win), np.int64, len(win)) for win in windows])
        x = self.network.inputs(list(number) or [b""])
        logits = [self.network.logits(self._projected(x), ids[lo : lo + 1024], mask[lo : lo + 1024]) for lo in range(0, len(ids), 1024)]
        return _evidence(np.concatenate(logits), np.zeros(1, np.int64))

    def _inputs(self, words: list[bytes]) -> np.ndarray:
        """Inputs of distinct words, those seen before from the memo."""
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > KEPT_WORDS:
            self.memo, new = {}, words
        fresh = [self.network.inputs(new[lo : lo + 8192]) for lo in range(0, len(new), 8192)]
        self.memo.update(zip(new, itertools.chain.from_iterable(fresh), strict=True))
        out = np.array([self.memo[w] for w in words]) if words else self.network.inputs([b""])
        if len(self.memo) > KEPT_WORDS:
            self.memo = {}
        return out

    def scores(self, texts: list[str], block: int = 1024) -> np.ndarray:
        """Scores of whole texts, from all their overlapping windows."""
        if self.flat is not None:
            return np.full(len(texts), self.flat)
        number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        sequences = []
        for t in texts:
            words = words_of(t)
            sequences.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        sizes = np.array([len(s) for s in sequences])
        begins = np.cumsum(sizes) - sizes
        flat = np.concatenate([*sequences, np.zeros(WINDOW, np.int32)])
        starts = [window_starts(n) for n in sizes]
        of = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        first = np.concatenate(starts)
        room = np.minimum(WINDOW, sizes[of] - first)
        logits = np.empty(len(of), np.float32)
        column = np.arange(WINDOW)
        projected = self._projected(self._inputs(list(number)))
        for lo in range(0, len(of), block):
            own = slice(lo, lo + block)
            ids = flat[np.minimum((begins[of[own]] + first[own])[:, None] + column, len(flat) - 1)]
            logits[own] = self.network.logits(projected, ids, (column < room[own][:, None]).astype(np.float32))
        return _sigmoid(_evidence(logits, np.flatnonzero(np.r_[True, of[1:] != of[:-1]])) @ self.weights + self.constant)


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str) -> tuple[list, np.ndarray]:
    """All windows of at most TOXIC_ROWS and CLEAN_ROWS labelled documents, first by a hash of the id, in a fixed order.

    Documents are taken whole and have SAMPLE_BYTES at most, half of it for each kind: one that doesn't fit into what is left,
    such as any that is larger than that by itself, is passed over, and later ones may still fit.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col) > 0).alias("toxic"))
    known = known.withColumn("at", F.xxhash64("doc_id", F.lit("sample")))
    # Only ids that documents have; of an id's rows the first. Ids alone are read for that.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    of = rows.select("row", "doc_id").join(known, "doc_id").groupBy("doc_id", "at", "toxic").agg(F.min("row").alias("row"))
    of = saved(of, "labelled")
    chosen = of.filter("toxic").orderBy("at", "doc_id").limit(TOXIC_ROWS).unionByName(of.filter("not toxic").orderBy("at", "doc_id").limit(CLEAN_ROWS))
    # At most TOXIC_ROWS + CLEAN_ROWS row numbers are broadcast.
    texts = rows.select("row", "text").join(F.broadcast(chosen), "row")
    texts = saved(texts.withColumn("size", F.octet_length(F.coalesce("text", F.lit("")))), "labelled-texts")
    used, rows_left = {True: 0, False: 0}, []
    for r in sorted(texts.select("doc_id", "at", "toxic", "size").collect(), key=lambda r: (r["at"], r["doc_id"])):
        if used[r["toxic"]] + r["size"] <= SAMPLE_BYTES // 2:
            used[r["toxic"]] += r["size"]
            rows_left.append(r["doc_id"])
    got = texts.filter(F.col("doc_id").isin(rows_left)).select("doc_id", "at", "text", "toxic").collect()
    got = sorted(got, key=lambda r: (r["at"], r["doc_id"]))
    toxic = np.array([r["toxic"] for r in got], bool)
    # Each distinct word is held once, and no text longer than it takes to cut it: the driver has little room.
    bags, once = [], {}
    for i, r in enumerate(got):
        got[i] = None
        bags.append(Windows([once.setdefault(w, w) for w in words_of(r["text"] or "")]))
    return bags, toxic


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    The network learns from labelled documents for which ``learn`` holds (a column over the id; default: crc32 of the id
    as text, mod 5, isn't 0): at most TOXIC_ROWS toxic and CLEAN_ROWS clean ones, whole, drawn by a hash of the id, and of at
    most SAMPLE_BYTES. The learning goes by documents: a toxic one needs a toxic window somewhere. Scores come from
    all overlapping windows of the whole text, and from nothing but the text: the total, mean and strongest evidence,
    weighed by logistic regression on documents that the network hasn't seen (on all, if those have few toxic ones).

    Null or empty text, and text of white space and control characters alone, is one window without evidence: a score near 0. A null id counts as the empty text for
    ``held_out``; null labels teach nothing, an id labelled twice is toxic if either says so, and of rows that share an id one
    is learnt from. ``docs`` must read the same way twice, as a stored table does. Without labels of both
    kinds every score is the share of toxic ones (0 without any). Equal texts get equal scores; repeated rows give a row
    each; an empty table gives no rows; other columns aren't read.
    """
    model = trained(docs, labels, learn, id_col, text_col, label_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            for lo, hi in text_slices(texts, 2_000_000):
                scores = np.clip(model.value.scores(texts[lo:hi]), 0, 1)
                columns = [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_of(F.col(id_col)) % 5 == 0).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`toxicity` predicts 0 for; other cases as there."""
    model, at = trained(docs, labels, learn, id_col, text_col, label_col), docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            for lo, hi in text_slices(texts, 2_000_000):
                yield b.slice(lo, hi - lo).filter(pa.array(model.value.scores(texts[lo:hi]) < 0.5))

    return docs.mapInArrow(work, docs.schema)


def trained(docs: DataFrame, labels: DataFrame, learn: Column | None, id_col: str, text_col: str, label_col: str):
    """The fitted model, broadcast: 2 MB of weights, a fixed size."""
    learn = crc_of(F.col(id_col)) % 5 != 0 if learn is None else learn
    bags, toxic = training_rows(docs, labels, learn, id_col, text_col, label_col)
    return docs.sparkSession.sparkContext.broadcast(Model().fit(bags, toxic))
