"""The network against a plain forward pass and numerical gradients; windows cover every passage."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from quern.llm import toxicity as tox
from quern.llm.bytes import blocks


def network(seed: int) -> tox.Network:
    net, rng = tox.Network(trained=True), np.random.default_rng(seed)
    net.p = {k: (rng.normal(size=v.shape) * 0.5).astype(np.float64) if k not in ("word", "gram") else v for k, v in net.p.items()}
    return net


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x))


def plain(net: tox.Network, x: np.ndarray, n: int) -> float:
    """The logit of one window of ``n`` words, number by number."""
    h, p = tox.HIDDEN, net.p
    states = np.zeros((n, 2 * h))
    for side, order in (("f", range(n)), ("b", range(n - 1, -1, -1))):
        state = [0.0] * h
        for t in order:
            g = [sum(x[t][i] * p[f"w{side}"][i][j] for i in range(x.shape[1])) + p[f"b{side}"][j] for j in range(3 * h)]
            q = [sum(state[i] * p[f"u{side}"][i][j] for i in range(h)) for j in range(3 * h)]
            z, r = [sigmoid(g[j] + q[j]) for j in range(h)], [sigmoid(g[h + j] + q[h + j]) for j in range(h)]
            new = [math.tanh(g[2 * h + j] + r[j] * q[2 * h + j]) for j in range(h)]
            state = [new[j] + z[j] * (state[j] - new[j]) for j in range(h)]
            states[t, (0 if side == "f" else h) : (h if side == "f" else 2 * h)] = state
    e = [math.exp(sum(states[t] * p["v"])) for t in range(n)]
    pooled = sum(e[t] * states[t] for t in range(n)) / sum(e)
    return float(sum(pooled * p["o"]) + p["c"][0])


def test_forward_is_the_plain_one():
    net, rng = network(1), np.random.default_rng(2)
    for n in (1, 2, 7):
        x = rng.normal(size=(1, 9, 3 + 2 * tox.DEPTH))
        there = np.arange(9)[None] < n
        assert abs(float(net.forward(x, there)[0]) - plain(net, x[0], n)) < 1e-5


def test_gradients_are_the_numerical_ones():
    net, rng = network(3), np.random.default_rng(4)
    x = rng.normal(size=(5, 6, 3 + 2 * tox.DEPTH))
    there = np.arange(6)[None] < np.array([6, 1, 3, 6, 2])[:, None]
    label, weight = np.array([1.0, 0, 1, 0, 0]), np.array([2.0, 1, 2, 1, 1])
    g, dx, _ = net.gradients(x, there, label, weight)
    loss = lambda: net.gradients(x, there, label, weight)[2]

    def slope(a: np.ndarray, at: tuple) -> float:
        kept, step = a[at], 1e-3
        a[at] = kept + step
        up = loss()
        a[at] = kept - step
        down = loss()
        a[at] = kept
        return (up - down) / (2 * step)

    for name, values in g.items():
        for _ in range(12):
            at = tuple(int(rng.integers(n)) for n in values.shape)
            assert abs(slope(net.p[name], at) - values[at]) < 2e-3, (name, at)
    for _ in range(30):
        at = tuple(int(rng.integers(n)) for n in x.shape)
        assert abs(slope(x, at) - dx[at]) < 2e-3, at


def test_windows_hold_every_passage():
    for size in (0, 1, 5, 23, 24, 25, 100, 301):
        first, row = tox.windows(np.array([0, size, size + 3]))
        own = [range(a, min(a + tox.STEPS, size)) for a, r in zip(first, row, strict=True) if r == 0]
        most = tox.STEPS - tox.STRIDE + 1
        for a in range(max(0, size - most) + 1 if size else 0):
            assert any(w.start <= a and min(a + most, size) <= w.stop for w in own), (size, a)


def test_a_text_scores_as_its_worst_window():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    net = tox.train([" ".join(words[:60])] * 20 + [" ".join(words[60:])] * 20, [0] * 20 + [1] * 20)
    text = " ".join(words)
    block = next(blocks(pa.array([text])))
    starts, ends, bounds = block.words(tox.NOT_LETTERS)
    first, _ = tox.windows(bounds)
    each = [" ".join(words[a : a + tox.STEPS]) for a in first]
    scores = np.concatenate([tox.Scorer(net).scores(b) for b in blocks(pa.array(each))])
    assert abs(tox.Scorer(net).scores(block)[0] - scores.max()) < 1e-5
