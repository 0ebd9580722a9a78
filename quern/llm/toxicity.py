"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text is read as words (runs of letters) in overlapping windows of ``STEPS`` words, one every ``STRIDE`` words, so that every
run of ``STEPS - STRIDE + 1`` words lies whole in one; a document's score is that of its worst window.  A word enters by itself (its log-odds among the labelled rows and a hashed
embedding) and by its characters (runs of 3 to 9 bytes with marks at both ends: greatest and mean log-odds and a mean
hashed embedding), so that unseen words with a known stem are seen, too.  Training is by multiple instances: a
document's label trains on the window that the network finds worst.

The network is fitted on the driver to a bounded sample of labelled rows (``MAX_POSITIVE`` and ``MAX_NEGATIVE`` rows, of
at most ``MAX_CHARS`` characters, picked by a hash of doc_id); rows held out are never among them.  Only text enters a
score.  All these windows of all texts are scored, to their ends.

Edge cases: a null text counts as empty; a text without letters scores 0; without labels of both kinds every score is
0; labels with nulls are left out; repeated rows score alike; one row for each row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.bytes import Block, blocks, mix, table

MAX_POSITIVE, MAX_NEGATIVE, MAX_CHARS = 1500, 3000, 20_000
STEPS, STRIDE, HIDDEN, BUCKETS, DEPTH = 24, 4, 6, 1 << 17, 3
#: Words from one window to the next in training, where each text's worst window alone counts.
TRAINED_STRIDE = 16
GRAMS = (3, 4, 5, 6, 8, 9)
THRESHOLD = 0.3
PRIOR, LEAST_ROWS = 5.0, 5

_letters = np.ones(256, bool)
_letters[65:91] = _letters[97:123] = _letters[128:] = False
NOT_LETTERS = _letters


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


# ---- words as numbers


def gram_hashes(block: Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character runs of each word (with a mark before and after it), and the word of each."""
    sizes = ends - starts + 2
    bounds = np.append(0, np.cumsum(sizes))
    word = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(bounds[-1]) - bounds[word]
    raw = np.full(bounds[-1], 94, np.uint8)  # ^
    inner = (place > 0) & (place < sizes[word] - 1)
    raw[inner] = block.data[(starts[word] + place - 1)[inner]]
    raw[(raw >= 65) & (raw <= 90)] |= 32
    raw[bounds[1:] - 1] = 36  # $
    values = table(7)[raw]
    hashes, words = [], []
    run = values.copy()
    for n in range(2, max(GRAMS) + 1):
        run[: len(run) - n + 1] = run[: len(run) - n + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + values[n - 1 :]
        if n in GRAMS:
            fits = np.flatnonzero(place + n <= sizes[word])
            hashes.append(mix(run[fits] + np.uint64(n)))
            words.append(word[fits])
    hashes, words = np.concatenate(hashes), np.concatenate(words)
    order = np.argsort(words, kind="stable")
    return (hashes[order] % np.uint64(BUCKETS)).astype(np.int64), words[order]


@dataclass
class Network:
    word_odds: dict[int, float] = field(default_factory=dict)
    gram_odds: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    p: dict[str, np.ndarray] = field(default_factory=dict)
    trained: bool = False

    def __post_init__(self) -> None:
        if not self.p:
            rng = np.random.default_rng(5)
            d, h = 3 + 2 * DEPTH, HIDDEN
            shape = {"word": (BUCKETS, DEPTH), "gram": (BUCKETS, DEPTH), "v": (2 * h,), "o": (2 * h,), "c": (1,)}
            for s in "fb":
                shape |= {f"w{s}": (d, 3 * h), f"u{s}": (h, 3 * h), f"b{s}": (3 * h,)}
            scale = {"word": 0.05, "gram": 0.05, "bf": 0.0, "bb": 0.0, "c": 0.0}
            self.p = {k: (rng.normal(size=n) * scale.get(k, 0.3)).astype(np.float32) for k, n in shape.items()}
        keys = np.array(sorted(self.word_odds), np.uint64)
        self._keys = keys
        self._odds = np.array([self.word_odds[int(k)] for k in keys], np.float32)

    def fixed(self, keys: np.ndarray, grams: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Of words the three inputs that training leaves alone."""
        out = np.zeros((len(keys), 3), np.float32)
        if len(self._keys):
            at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
            out[:, 0] = np.where(self._keys[at] == keys, self._odds[at], 0)
        first = np.searchsorted(of, np.arange(len(keys)))
        odds = self.gram_odds[grams]
        out[:, 1] = np.maximum.reduceat(odds, first)
        out[:, 2] = np.add.reduceat(odds, first) / np.bincount(of, minlength=len(keys))
        return out

    def inputs(self, keys: np.ndarray, grams: np.ndarray, of: np.ndarray) -> np.ndarray:
        first = np.searchsorted(of, np.arange(len(keys)))
        mean = np.add.reduceat(self.p["gram"][grams], first) / np.bincount(of, minlength=len(keys))[:, None]
        word = self.p["word"][(keys % np.uint64(BUCKETS)).astype(np.int64)]
        return np.hstack([self.fixed(keys, grams, of), word, mean]).astype(np.float32)

    def forward(self, x: np.ndarray, there: np.ndarray, keep: bool = False):
        """Logits of windows: ``x`` inputs (window, step, size), ``there`` which steps have a word."""
        states, kept = {}, {}
        b, steps = there.shape
        h3 = HIDDEN
        for s, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            w, u, bias = self.p[f"w{s}"], self.p[f"u{s}"], self.p[f"b{s}"]
            h = np.zeros((b, h3), np.float32)
            out = np.zeros((b, steps, h3), np.float32)
            memory = []
            for t in order:
                g, q = x[:, t] @ w + bias, h @ u
                zr = 0.5 + 0.5 * np.tanh(0.5 * (g[:, : 2 * h3] + q[:, : 2 * h3]))
                z, r = zr[:, :h3], zr[:, h3:]
                n = np.tanh(g[:, 2 * h3 :] + r * q[:, 2 * h3 :])
                m = there[:, t, None]
                new = np.where(m, n + z * (h - n), h)
                if keep:
                    memory.append((t, h, z, r, n, q[:, 2 * h3 :], m))
                out[:, t] = h = new
            states[s], kept[s] = out, memory
        both = np.concatenate([states["f"], states["b"]], 2)
        e = np.where(there, both @ self.p["v"], -1e9)
        a = np.exp(e - e.max(1, keepdims=True)) * there
        a /= np.maximum(a.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("bt,bth->bh", a, both)
        logit = pooled @ self.p["o"] + self.p["c"][0]
        return (logit, both, a, pooled, kept) if keep else logit

    def gradients(self, x: np.ndarray, there: np.ndarray, label: np.ndarray, weight: np.ndarray):
        """Of the weighted log loss: by parameter, and by input; the loss."""
        logit, both, a, pooled, kept = self.forward(x, there, keep=True)
        prob = 1 / (1 + np.exp(-logit))
        d = ((prob - label) * weight / weight.sum()).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "gram")}
        g["o"], g["c"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dpool = d[:, None] * self.p["o"]
        da = np.einsum("bh,bth->bt", dpool, both)
        de = a * (da - (a * da).sum(1, keepdims=True))
        g["v"] = np.einsum("bt,bth->h", de, both)
        dboth = a[:, :, None] * dpool[:, None, :] + de[:, :, None] * self.p["v"]
        dx = np.zeros_like(x)
        h3 = HIDDEN
        for i, s in enumerate("fb"):
            w, u = self.p[f"w{s}"], self.p[f"u{s}"]
            carry = np.zeros((len(x), h3), np.float32)
            for t, h, z, r, n, q, m in reversed(kept[s]):
                dh = carry + dboth[:, t, i * h3 : (i + 1) * h3]
                dm = dh * m
                dn = dm * (1 - z) * (1 - n * n)
                dz = dm * (h - n) * z * (1 - z)
                dr = dn * q * r * (1 - r)
                pre = np.hstack([dz, dr, dn])
                rec = np.hstack([dz, dr, dn * r])
                g[f"w{s}"] += x[:, t].T @ pre
                g[f"b{s}"] += pre.sum(0)
                g[f"u{s}"] += h.T @ rec
                dx[:, t] += pre @ w.T
                carry = dh * (1 - m) + dm * z + rec @ u.T
        p = np.clip(prob, 1e-7, 1 - 1e-7)
        loss = -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum() / weight.sum()
        return g, dx, float(loss)


def windows(bounds: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window, and its row: every ``stride`` words and once at the end of a row."""
    sizes = np.diff(bounds)
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - STEPS) // stride)), 0)
    row = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    latest = np.maximum(bounds[row], bounds[row + 1] - STEPS)
    return np.minimum(bounds[row] + number * stride, latest), row


def steps(first: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of windows (window, step), and which steps have a word."""
    at = first[:, None] + np.arange(STEPS)
    there = at < bounds[row + 1][:, None]
    return np.where(there, at, bounds[row + 1][:, None] - 1), there


# ---- training


def _read(texts: list[str]):
    """Distinct words of texts (keys, grams, word of each gram), each text's words as numbers, their bounds."""
    keys, numbers, sizes, first_grams = [], [], [], []
    known: dict[int, int] = {}
    for block in blocks(pa.array(texts, pa.string())):
        starts, ends, bounds = block.words(NOT_LETTERS)
        k, at, each = np.unique(block.hashes(starts, ends, 3, fold=True), return_index=True, return_inverse=True)
        grams, of = gram_hashes(block, starts[at], ends[at]) if len(at) else (np.zeros(0, np.int64),) * 2
        split = np.split(grams, np.searchsorted(of, np.arange(1, len(at)))) if len(at) else []
        number = np.zeros(len(k), np.int64)
        for i, key in enumerate(k.tolist()):
            if key not in known:
                known[key] = len(keys)
                keys.append(key)
                first_grams.append(split[i])
            number[i] = known[key]
        numbers.append(number[each])
        sizes.append(np.diff(bounds))
    flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    bounds = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)
    of = np.repeat(np.arange(len(keys)), [len(g) for g in first_grams])
    return np.array(keys, np.uint64), np.concatenate(first_grams) if first_grams else flat, of, flat, bounds


def _log_odds(parts: Iterable[tuple[np.ndarray, np.ndarray]], n: int, labels: np.ndarray) -> np.ndarray:
    """For items 0..n-1 how much likelier label 1 is in rows that have them, shrunk to 0 by ``PRIOR`` rows; 0 below ``LEAST_ROWS``.

    ``parts`` are (rows, items); a row's items all lie in one part.
    """
    share = labels.mean()
    positive, total = np.zeros(n), np.zeros(n, np.int64)
    for rows, items in parts:
        pairs = np.unique(rows * n + items)
        row, item = pairs // n, pairs % n
        positive += np.bincount(item, labels[row], n)
        total += np.bincount(item, minlength=n)
    p = (positive + PRIOR * share) / (total + PRIOR)
    odds = np.log(p / (1 - p)) - np.log(share / (1 - share))
    return np.where(total >= LEAST_ROWS, odds, 0).astype(np.float32)  # rare ones would give their own rows away


def _grams_by_row(bounds: np.ndarray, flat: np.ndarray, first: np.ndarray, grams: np.ndarray, rows: int = 64):
    """(row, gram) of each text's distinct words, some texts at a time."""
    for i in range(0, len(bounds) - 1, rows):
        ends = bounds[i : i + rows + 1]
        row = np.repeat(np.arange(i, i + len(ends) - 1), np.diff(ends))
        pairs = np.unique(row * len(first) + flat[ends[0] : ends[-1]])
        row, word = pairs // len(first), pairs % len(first)
        size = first[word + 1] - first[word]
        at = np.repeat(first[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        yield np.repeat(row, size), grams[at]


def train(texts: list[str], labels: list[int], rounds: int = 2, epochs: int = 6, rate: float = 0.01) -> Network:
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Network()
    keys, grams, of, flat, bounds = _read(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    odds = _log_odds([(row, flat)], len(keys), y)
    first = np.searchsorted(of, np.arange(len(keys) + 1))
    gram_odds = _log_odds(_grams_by_row(bounds, flat, first, grams), BUCKETS, y)
    net = Network({int(k): float(o) for k, o in zip(keys, odds, strict=True) if o}, gram_odds, trained=True)

    start, of_row = windows(bounds, TRAINED_STRIDE)
    fixed = net.fixed(keys, grams, of)
    at, there = steps(start, of_row, bounds)
    worst = (fixed.max(1)[flat[at]] * there).max(1)  # before the network can tell, the odds do
    rng, moments, step = np.random.default_rng(11), {}, 0
    weight = np.where(y == 1, np.sqrt((1 - y.mean()) / y.mean()), 1.0).astype(np.float32)

    def update(name: str, g: np.ndarray, where=slice(None)) -> None:
        m, v = moments.setdefault(name, (np.zeros_like(net.p[name]), np.zeros_like(net.p[name])))
        m[where] = 0.9 * m[where] + 0.1 * g
        v[where] = 0.99 * v[where] + 0.01 * g * g
        net.p[name][where] -= rate * m[where] / (np.sqrt(v[where]) + 1e-6)

    for round_ in range(rounds):
        if round_:
            x = net.inputs(keys, grams, of)
            worst = np.concatenate(
                [net.forward(x[flat[at[i : i + 20_000]]], there[i : i + 20_000]) for i in range(0, len(at), 20_000)]
            )
        order = np.lexsort((-worst, of_row))
        chosen = order[np.flatnonzero(np.append(True, of_row[order][1:] != of_row[order][:-1]))]
        label = y[of_row[chosen]]
        for _ in range(epochs):
            shuffled = rng.permutation(len(chosen))
            for i in range(0, len(shuffled), 256):
                pick = shuffled[i : i + 256]
                words, have = flat[at[chosen[pick]]], there[chosen[pick]]
                used, inverse = np.unique(words, return_inverse=True)
                spans = np.concatenate([np.arange(first[w], first[w + 1]) for w in used])
                own = np.repeat(np.arange(len(used)), first[used + 1] - first[used])
                x = net.inputs(keys[used], grams[spans], own)[inverse.reshape(words.shape)]
                g, dx, _ = net.gradients(x, have, label[pick], weight[of_row[chosen[pick]]])
                step += 1
                for k, v in g.items():
                    update(k, v)
                dword = np.zeros((len(used), x.shape[2]), np.float32)
                np.add.at(dword, inverse.reshape(-1), (dx * have[:, :, None]).reshape(-1, x.shape[2]))
                for name, cells, d in (
                    ("word", (keys[used] % np.uint64(BUCKETS)).astype(np.int64), dword[:, 3 : 3 + DEPTH]),
                    ("gram", grams[spans], (dword[:, 3 + DEPTH :] / np.bincount(own)[:, None])[own]),
                ):
                    cell, back = np.unique(cells, return_inverse=True)
                    total = np.zeros((len(cell), DEPTH), np.float32)
                    np.add.at(total, back, d)
                    update(name, total, cell)
    return net


# ---- scoring


class Scorer:
    """A network with the inputs of the words that a worker has met."""

    MOST = 1_000_000

    def __init__(self, net: Network):
        self.net = net
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros((0, 3 + 2 * DEPTH), np.float32)

    def inputs(self, block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys, at, each = np.unique(block.hashes(starts, ends, 3, fold=True), return_index=True, return_inverse=True)
        if len(self.keys) > self.MOST:
            self.keys, self.rows = self.keys[:0], self.rows[:0]
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != keys[inside]
        if new.any():
            rows = self.net.inputs(keys[new], *gram_hashes(block, starts[at[new]], ends[at[new]]))
            self.rows = np.insert(self.rows, place[new], rows, axis=0)
            self.keys = np.insert(self.keys, place[new], keys[new])
            place = np.searchsorted(self.keys, keys)
        return self.rows[place][each]

    def scores(self, block: Block) -> np.ndarray:
        out = np.zeros(block.rows)
        starts, ends, bounds = block.words(NOT_LETTERS)
        if not len(starts) or not self.net.trained:
            return out
        x = self.inputs(block, starts, ends)
        first, row = windows(bounds)
        logits = np.empty(len(first), np.float32)
        for i in range(0, len(first), 8192):
            at, there = steps(first[i : i + 8192], row[i : i + 8192], bounds)
            logits[i : i + 8192] = self.net.forward(x[at], there)
        best = np.full(block.rows, -np.inf)
        np.maximum.at(best, row, logits)
        return 1 / (1 + np.exp(-np.clip(best, -700, 700)))


def sample(documents: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Texts and labels to train on: none of them held out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [
        known.where(F.col("toxic") == kind).orderBy(*order).limit(most)
        for kind, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))
    ]
    # at most MAX_POSITIVE + MAX_NEGATIVE pairs of numbers
    d = documents.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id")
    d = d.where(F.length("text") <= MAX_CHARS).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = sorted(d.select("doc_id", "text", "toxic").collect())
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def scored(documents: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """For each row doc_id, held_out, score and predicted."""
    sent = documents.sparkSession.sparkContext.broadcast(net)  # of fixed size but for the sample's words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for block in blocks(batch.column(1)):
                names = batch.column(0).slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([names, pa.array(scorer.scores(block))], ["doc_id", "score"])

    d = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    d = d.mapInArrow(work, "doc_id long, score double")
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return d.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
