"""Collocations and divergence: the automaton against its definition, tiny shards and chunks, odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quern.llm import collocations, divergence

SCHEMA = "doc_id long, text string, lang string, source string"
DOCS = "/root/testdata/sf0.001/documents.parquet"


def classes(x: list[int], depth: int) -> set:
    """(length, count, last place, length of link) of each class of phrases that end at the same places."""
    ends: dict[tuple, list[int]] = {}
    for i in range(len(x)):
        for k in range(1, depth + 1):
            gram = tuple(x[max(0, i - k + 1) : i + 1])
            if len(gram) == k and 0 not in gram:
                ends.setdefault(gram, []).append(i)
    longest = {}
    for gram, at in ends.items():
        key = tuple(at)
        longest[key] = max(longest.get(key, ()), gram, key=len)
    out = set()
    for at, gram in longest.items():
        link = next((len(gram[i:]) for i in range(1, len(gram)) if ends[gram[i:]] != list(at)), 0)
        out.add((len(gram), len(at), at[-1], link))
    return out


def test_automaton_is_that_of_the_definition():
    draw = random.Random(1)
    for n in [0, 1, 2, 7, *[60] * 40]:
        x = [draw.choice([0, 1, 1, 2, 2, 3]) for _ in range(n)]
        a = collocations.Automaton(np.array(x, np.int64), 4)
        got = {(int(a.length[i]), int(a.count[i]), int(a.end[i]), int(a.length[a.link[i]])) for i in range(1, len(a.length))}
        assert got == classes(x, 4)
        grams = Counter(tuple(x[i : i + k]) for k in range(1, 5) for i in range(n - k + 1) if 0 not in x[i : i + k])
        listed = Counter()
        for first, end, count in a.phrases():
            assert tuple(x[first:end]) not in listed
            listed[tuple(x[first:end])] = count
        assert listed == grams


def pieces(text: str | None) -> list[list[str]]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def phrases(docs, least: int) -> dict:
    found: dict = {}
    for text, lang in docs:
        count = found.setdefault("und" if lang is None else lang, Counter())
        for w in pieces(text):
            count[None] += len(w)
            count.update(" ".join(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    return {(lang, p): n for lang, c in found.items() for p, n in c.items() if p is None or n >= least}


def without_lone_words(found: dict) -> dict:
    """Single words only where they belong to a pair that is listed."""
    used = {(lang, w) for lang, p in found if p and p.count(" ") == 1 for w in p.split(" ")}
    return {(lang, p): n for (lang, p), n in found.items() if not p or " " in p or (lang, p) in used}


def test_short_shards_lose_nothing(spark, monkeypatch):
    d = spark.read.parquet(DOCS).select("text", "lang")
    want = phrases([tuple(r) for r in d.collect()], 5)

    def small(f):  # workers import the module anew: set there too
        def run(batches):
            collocations.SHARD, collocations.PART = 300, 64
            yield from f(batches)

        return run

    made = collocations.shard_rows
    monkeypatch.setattr(collocations, "shard_rows", lambda depth: small(made(depth)))
    got = {(r.lang, r.phrase): r.n for r in collocations.frequent_phrases(d, least=5).collect()}
    assert without_lone_words(got) == without_lone_words(want)


def test_a_crowded_sieve_loses_nothing(spark):
    d = spark.read.parquet(DOCS).select("text", "lang")
    want = phrases([tuple(r) for r in d.collect()], 5)
    got = {(r.lang, r.phrase): r.n for r in collocations.frequent_phrases(d, least=5, bits=15).collect()}
    assert without_lone_words(got) == without_lone_words(want)
    pairs = {(r.lang, r.phrase): r.n for r in collocations.frequent_phrases(d, least=5, depth=2).collect()}
    assert pairs == {k: n for k, n in want.items() if not k[1] or k[1].count(" ") < 2}


def test_counts_of_hashes_go_out_by_ranges(monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 3000)
    draw = random.Random(2)
    texts = [" ".join(f"w{int(draw.expovariate(0.001))}" for _ in range(4000)) for _ in range(3)]
    docs = pa.table({"lang": ["de", "en", "de"], "text": texts}).to_batches()
    made = [b for d in docs for b in collocations.shard_rows(4)(iter([d]))] * 2
    want: Counter = Counter()
    for lang, text in zip(["de", "en", "de"], texts, strict=True):
        for w, n in Counter(text.split()).items():
            want[int(collocations.word_hashes(lang, w.encode())[0] >> np.uint64(64 - collocations.HASH_BITS))] += 2 * n
    low = collocations.HASH_BITS - 8  # 256 ranges
    rows = pa.Table.from_batches(collocations.hash_counts(1, [], low)(iter(made)))
    assert len(want) > 3000 and rows.num_rows <= 6 * 256  # at most 6 times it adds up; before: a row for each hash and shard
    for least in (1, 5):
        got = []
        for part in set(rows["part"].to_pylist()):
            got += collocations.frequent_hashes(least, low)(rows.filter(pc.equal(rows["part"], part)))["hash"].to_pylist()
        assert sorted(got) == sorted(h for h, n in want.items() if n >= least)


@pytest.mark.parametrize("most", [0, 50, 1 << 40, (1 << 62) - 1])
def test_numbered_is_as_unique(most):
    for n in (0, 1, 500):
        keys = np.random.default_rng(n).integers(0, most + 1, n)
        keys[n // 2 :] = keys[: n - n // 2]
        for got, want in zip(collocations.numbered(keys, most), np.unique(keys, return_inverse=True), strict=True):
            assert got.tolist() == want.tolist()


def test_collocations_of_odd_rows(spark):
    rows = [(1, "A b.C\td " * 40, None, "s"), (1, "a b. c d", "und", "s"), (2, None, "en", None), (None, "", None, None), (3, "x" * 100_000, "de", "s")]
    rows += [(4, "é ü \x1cz, " * 30, "", "s")]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("phrase", "n", "rank", "words", "a", "k")})
    got = {(r.lang, r.phrase): (r.rank, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(d).collect()}
    assert got == collocated([r[1:3] for r in rows]) and got
    assert collocations.collocations(d.limit(0)).count() == 0


def collocated(docs) -> dict:
    f = phrases(docs, 30)
    out: dict = {}
    for (lang, p), a in f.items():
        w = p.split(" ") if p else []
        if len(w) < 2:
            continue
        cuts = [(2_000_000 * a // (f[lang, x] + f[lang, y]), k, f[lang, x], f[lang, y]) for k in range(1, len(w)) for x, y in [(" ".join(w[:k]), " ".join(w[k:]))]]
        inside = any(m == lang and q and q != p and f" {p} " in f" {q} " and 100 * n >= 80 * a for (m, q), n in f.items())
        if not inside:
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, p.encode(), p, left, right))
    return {
        (lang, p): (rank, -a, left, right, f[lang, None], -score)
        for lang, rows in out.items()
        for rank, (score, a, _, p, left, right) in enumerate(sorted(rows)[:2000], 1)
    }


def spread(docs) -> set:
    docs = [tuple(x or "" for x in r) for r in docs]
    found = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) for t, lang, source in docs]
    out = set()
    for lang in {d[0] for d in found}:
        own = [d for d in found if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t, n in seen.items() if n >= 3), key=str.encode)
        groups = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in own}}

        def shares(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t])[:200]
            for part, rows in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -v, rank) for rank, (v, _, item) in enumerate(rows, 1)}
    return out


def divergences(d) -> set:
    return {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.divergence(d).collect()}


def test_divergence_in_small_chunks(spark, monkeypatch):
    d = spark.read.parquet(DOCS).select("text", "lang", "source")

    def small(f):
        def run(batches):
            divergence.HELD, divergence.CHUNK, divergence.CELLS, divergence.PART = 500, 7, 30, 64
            yield from f(batches)

        return run

    for name in ("partial_counts", "encoded", "compared"):
        monkeypatch.setattr(divergence, name, small(getattr(divergence, name)))
    assert divergences(d) == spread([tuple(r) for r in d.collect()])


def test_divergence_of_odd_rows(spark):
    rows = [(1, "Ab ab É1é", "en", "a"), (1, "ab é", "en", "b"), (2, "ab é x", None, None), (3, None, "en", None), (4, "ab", "en", "c"), (5, "é", "en", "c")]
    rows += [(6, "z", "de", "a"), (None, "", "de", "b"), (8, "ab", "", ""), (9, "ab", None, "q"), (9, "\U0001f600 ￮", "en", "é")] * 3
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("term", "n", "docs", "rank", "groups", "counts")})
    assert divergences(d) == spread([r[1:] for r in rows])
    assert divergence.divergence(d.limit(0)).count() == 0


def test_scaled_is_exact_past_64_bits():
    draw = random.Random(5)
    for _ in range(300):
        total = draw.randint(1, 10 ** draw.randint(1, 15))
        counts = [draw.randint(0, total) for _ in range(5)]
        assert divergence.scaled(np.array(counts, np.int64), total).tolist() == [10**9 * c // total for c in counts]


@pytest.mark.parametrize("part", [3, 1 << 22])
def test_terms_of_long_texts(part, monkeypatch):
    monkeypatch.setattr(divergence, "PART", part)
    text = "Ab-cd é_x " * 50 + "y" * 1000
    assert [t.decode() for p in divergence.terms(text) for t in p] == ["ab", "cd", "é", "x"] * 50 + ["y" * 1000]
