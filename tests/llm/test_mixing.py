"""Raking over margins of many values, in the driver and by joins."""

from __future__ import annotations

from collections import defaultdict

import pytest

from quern.llm import mixing

SIZES = {f"s{i:02d}": 20 * (i + 1) for i in range(40)}  # words of each document


@pytest.fixture(scope="module")
def docs(spark):
    rows, names = [], [*SIZES, None]
    for i in range(len(names) * 12):
        source = names[i % len(names)]
        text = " ".join(f"w{i}x{j}" for j in range(SIZES.get(source, 30)))
        rows.append((i, text, ("aa", "bb")[i % 2], source, len(text)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def kept(rows, margin):
    has, fit = defaultdict(float), defaultdict(float)
    for r in rows:
        has[r[margin]] += r.n_tokens
        fit[r[margin]] += r.n_tokens * r.probability
    return has, fit


def want(has, shares):
    """Water-filling by bisection."""
    low, high, total = 0.0, 1e12, 0.8 * sum(has.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(has[c], level * shares[c]) for c in has) < total else (low, level)
    return {c: min(has[c], low * shares[c]) for c in has}


def assert_near(got, wanted):
    for c, x in wanted.items():
        assert abs(got[c] - x) <= 0.01 * x + 1e-6, (c, got[c], x)


def test_every_value_meets_its_target(docs):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == 41 * 12
    for margin in mixing.MARGINS:
        has, fit = kept(rows, margin)
        assert_near(fit, want(has, {c: x**mixing.SMOOTH for c, x in has.items()}))


def test_every_given_target_counts(docs):
    given = {**{s: 1.0 / SIZES[s] for s in SIZES if s != "s39"}, "absent": 1.0}
    has, fit = kept(mixing.mixed(docs, {"source": given}, keep=0.05).collect(), "source")
    assert fit[None] == fit["s39"] == 0  # they have no name and "other" no share
    assert all(fit[s] > 0 for s in given if s != "absent")


def test_topics_part_vocabularies(spark):
    """Texts of three word lists fall into topics of their own, whatever words they draw."""
    lists = [[f"{stem}{i:03d}" for i in range(40)] for stem in ("harbour", "kitchen", "theorem")]
    rows = [(n, " ".join(lists[n % 3][(n * 7 + 3 * k) % 40] for k in range(30)), "aa", "s", 0) for n in range(90)]
    rows += [(90, None, "aa", "s", 0), (91, "a an of", "aa", "s", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.topic for r in mixing.measured(d).collect()}
    assert got[90] == got[91] == "none" and len(got) == 92
    found = [{got[n] for n in range(k, 90, 3)} for k in range(3)]
    assert not (found[0] & found[1] or found[0] & found[2] or found[1] & found[2])


def test_joins_fit_as_the_driver_does(docs, monkeypatch):
    given = {"source": {f"s{i:02d}": float(i + 1) for i in range(35)} | {"other": 9.0}, "lang": {"aa": 0.7, "bb": 0.3}}
    measured = mixing.measured(docs, keep_text=False)
    for targets in (None, given):
        fits = []
        for cells in (50_000, 0):
            monkeypatch.setattr(mixing, "CELLS", cells)
            fits.append({r[:3]: r.p for r in mixing.fitted(measured, targets, sweeps=3)[0].collect()})
        assert fits[0].keys() == fits[1].keys()
        assert all(abs(p - fits[1][c]) < 1e-9 for c, p in fits[0].items())
