"""Winnowing, coded blocks and learned rules against plain versions."""

from __future__ import annotations

import random
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quern.llm import fingerprints, quality_rules, token_files
from tests.llm import brute


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def word_hash(w: str) -> int:
    return signed(xxhash.xxh64(w.encode(), seed=42).intdigest())


def joined(*values: int) -> int:
    seed = 42
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v), seed=seed & (1 << 64) - 1).intdigest()
    return signed(seed)


def winnowed(text: str, k: int = fingerprints.K, w: int = fingerprints.W) -> list[tuple[int, int]]:
    """(hash, position) of the least run of each window, the rightmost of equals."""
    hashes = [word_hash(x) for x in brute.words(text)]
    if not hashes:
        return []
    if len(hashes) < k:
        runs = [joined(*hashes)]
    else:
        runs, size = hashes, 1
        while size < k:
            runs = [joined(runs[i], runs[i + size]) for i in range(len(runs) - size)]
            size *= 2
    short = [(r & (1 << 64) - 1) >> 31 for r in runs]
    out: list[tuple[int, int]] = []
    for at in range(max(1, len(short) - w + 1)):
        window = range(at, min(at + w, len(short)))
        best = min(window, key=lambda i: (short[i], -i))
        if not out or out[-1][1] != best:
            out.append((short[best], best))
    return out


def texts() -> list[str]:
    draw = random.Random(1)
    out = ["", " \n", "one", "one two three", "a " * 50, "x y " * 30, "ünï 漢字 " * 9]
    return out + [" ".join(draw.choices(["a", "b", "c", "dd", "e"], k=draw.randint(1, 80))) for _ in range(60)]


def test_winnowing_is_that_of_the_definition(spark):
    rows = list(enumerate(texts()))
    d = fingerprints.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), "text", "kept")
    got = d.select("doc_id", fingerprints.hashes(F.col("kept")).alias("h"), fingerprints.positions(F.col("kept")).alias("p")).collect()
    for r in got:
        assert list(zip(r.h, r.p, strict=True)) == winnowed(rows[r.doc_id][1]), rows[r.doc_id]


def test_long_matches_share_a_hash():
    draw = random.Random(2)
    for _ in range(50):
        same = " ".join(f"s{draw.randint(0, 9)}" for _ in range(fingerprints.K + fingerprints.W - 1))
        a, b = (" ".join(f"{c}{draw.randint(0, 99)}" for _ in range(30)) for c in "ab")
        assert {h for h, _ in winnowed(f"{a} {same} {b}")} & {h for h, _ in winnowed(f"{b} {same} {a}")}


def test_blocks_with_exceptions():
    draw = np.random.default_rng(3)
    parts = [
        draw.integers(1000, 1100, 500).astype(np.uint32), np.full(100, 7, np.uint32), np.zeros(0, np.uint32), np.array([2**32 - 1, 0, 5], np.uint32),
        np.where(draw.random(1024) < 0.01, 50_000, draw.integers(0, 200, 1024)).astype(np.uint32),
    ]
    coded = [token_files.encode_block(p) for p in parts]
    assert len(coded[-1]) < 1024 * 2  # the few large ids are exceptions and widen nothing
    data = np.frombuffer(b"".join(coded), np.uint8)
    index = np.cumsum([0, *map(len, coded)])
    for i in (4, 0, 3, 2, 1):  # each block by itself, by its place in the index
        assert token_files.decode_block(data[index[i] : index[i + 1]]).tolist() == parts[i].tolist()


def labelled(n: int, seed: int) -> list[dict]:
    draw = random.Random(seed)
    rows = []
    for key in range(n):
        row = {f: draw.random() for f in quality_rules.RATES} | {"key": key}
        bad = (row["symbol_rate"] > 0.7 and row["mean_word"] < 0.5) or row["bang_rate"] > 0.9
        rows.append(row | {"bad": int(bad != (draw.random() < 0.01))})
    return rows


def test_rules_find_planted_conjunctions(spark):
    rules = quality_rules.learn(labelled(3000, 4))
    assert len(rules) >= 2 and any(len(r) >= 2 for r in rules)
    unseen = labelled(2000, 5)
    caught = [next((n for n, rule in enumerate(rules, 1) if all(c.holds(r) for c in rule)), None) for r in unseen]
    hits = sum(r["bad"] for r, c in zip(unseen, caught, strict=True) if c)
    assert hits >= 0.9 * sum(r["bad"] for r in unseen) and hits >= 0.85 * sum(c is not None for c in caught)
    d = spark.createDataFrame([{k: v for k, v in r.items() if k != "bad"} for r in unseen])
    got = {r.key: r.rule for r in d.select("key", quality_rules.verdict(rules).alias("rule")).collect()}
    assert got == {r["key"]: c for r, c in zip(unseen, caught, strict=True)}


def test_no_rules_without_both_kinds():
    rows = [r | {"bad": 0} for r in labelled(50, 6)]
    assert quality_rules.learn(rows) == [] == quality_rules.learn([])
