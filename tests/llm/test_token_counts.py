"""Prefix counts against the library, prefix by prefix, and budgets against them."""

from __future__ import annotations

import random

import pytest

from quern.llm import common, prefix_counts, queries, token_counts
from quern.llm.bytes import blocks
from tests.llm import brute

PATH = "word_bpe_49k.json"
ODD = [
    "don't we'll they've I'd 'tis ''s 're're o'r!'s", "naïve café Ünïcödé ß İstanbul ΣΑΣ", "é ộ q̃́ Å",
    "漢字かな交じり文 가각 각", "🇺🇸🇺🇸😂😂 👩‍👩‍👧", "a<|endoftext|>b <|endoftext <|startoftext|><|startoftext|>", "1234 ½ ٣ x2y",
    " wide　blank\x85next none \x1c\x1f", "</w> a</w> ###--!!?? ...", "", " \t\n", "ﬁ ŉ ﷺ क़", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa thththththing",
]
LETTERS = ["a", "e", "th", "ing", "'", "s", "re", "ll", " ", "1", "é", "é", "̣", "ß", "İ", "Σ", "漢", "😂", "<|endoftext|>", "<|end", "!", "\x1c", "가"]


@pytest.fixture(scope="module")
def encoder():
    return prefix_counts.PrefixPieces(queries.tokenizer(PATH))


def texts():
    draw = random.Random(7)
    return ODD + ["".join(draw.choices(LETTERS, k=draw.randint(1, 25))) for _ in range(400)]


def test_every_prefix(encoder):
    import pyarrow as pa

    rows = texts()
    got = {}
    for block in blocks(pa.array(rows), 1000):
        counts, at = token_counts.block_counts(block, encoder)
        for i in range(block.rows):
            got[block.first + i] = counts[at[i] : at[i + 1]].tolist()
    for i, t in enumerate(rows):
        assert got[i] == [len(brute.ids(PATH, t[: n + 1])) for n in range(len(t))], ascii(t)


def test_steps_are_kept_whatever_their_size():
    import numpy as np

    for counts in ([], [1, 2, 2], [1, 300, 5], [70_000, 1, 5_000_000_000]):
        assert token_counts.decoded(*token_counts.coded(np.array(counts, np.int64))).tolist() == counts


def test_budgets_from_the_table(spark):
    rows = list(enumerate([*texts(), None, "word " * 700, "x" * 3000]))
    at = common.new_folder(spark, "budget")
    token_counts.write(spark.createDataFrame(rows, "doc_id long, text string"), at, queries.tokenizer(PATH))
    text = {i: t or "" for i, t in rows}
    for limit in (0, 1, 3, 600):
        for r in token_counts.read(spark, at, limit).collect():
            t = text[r.doc_id]
            total = len(brute.ids(PATH, t))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), total, total > limit)
            if len(t) < 100:
                fits = [n for n in range(len(t) + 1) if len(brute.ids(PATH, t[:n])) <= limit]
                assert r.fitting_chars == fits[-1]


def test_long_run_without_blanks(encoder):
    draw = random.Random(3)
    t = "".join(draw.choices("aeinorst", k=20_000))
    counts = encoder.counts(t)
    assert len(counts) == len(t)
    for n in (1, 777, 10_000, 20_000):
        assert counts[n - 1] == len(brute.ids(PATH, t[:n]))


def test_marks_in_any_order_and_very_many(encoder):
    import time

    draw = random.Random(11)
    marks = ["\u0301", "\u0323", "\u0327", "\u0345", "\u0300", "\u0344", "\u0f71", "\u05b0"]
    for _ in range(150):
        t = draw.choice(["a", "e\u0301", "\u03b1", "x ", ""]) + "".join(draw.choices(marks, k=draw.randint(1, 14))) + draw.choice(["", "b", " a\u0301"])
        assert encoder.counts(t) == [len(brute.ids(PATH, t[: n + 1])) for n in range(len(t))], ascii(t)
    t = "a" + "\u0301" * 100_000 + " b"
    begun = time.perf_counter()
    counts = encoder.counts(t)
    assert time.perf_counter() - begun < 10
    for n in (1, 2, 3, 5000, len(t)):
        assert counts[n - 1] == len(brute.ids(PATH, t[:n]))


def test_other_rules_are_refused(tmp_path):
    import json

    with open(queries.tokenizer(PATH), encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"]["normalizers"].pop()
    (tmp_path / "other.json").write_text(json.dumps(file))
    with pytest.raises(ValueError, match="normalizer"):
        prefix_counts._Merges(str(tmp_path / "other.json"))


def test_counts_agree_where_the_library_counts_otherwise(encoder, monkeypatch):
    from quern.llm.tokens import Pieces

    real = Pieces.ids
    monkeypatch.setattr(Pieces, "ids", lambda self, texts: [[0, *x] for x in real(self, texts)])
    flat, sizes = encoder._many(["né", "ab"])
    assert sizes.tolist() == [2, 2] and flat[:2].tolist() == [len(brute.ids(PATH, t)) + 1 for t in ("n", "né")]
