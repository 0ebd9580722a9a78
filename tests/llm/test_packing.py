"""Packing under limits that bind."""

from __future__ import annotations

import random

import pytest

from quern.llm import packing
from quern.llm.packing import Limits


def documents(n: int, seed: int = 5):
    draw = random.Random(seed)
    sizes = [draw.choice((draw.randint(1, 40), draw.randint(1, 900), draw.randint(1, 9000))) for _ in range(n)]
    return [(size, draw.choice((0, size // 8, size // 2, size))) for size in sizes]


@pytest.mark.parametrize("limits", [packing.DOCUMENTS, Limits(2048, 3, 1000), Limits(2048, 1, 2048), Limits(512, 8, 100), Limits()])
def test_limits_hold_and_nothing_is_lost(limits):
    docs = documents(400)
    out = packing.pack(docs, limits)
    seen = {}
    for sequence in out:
        tokens, loss = sum(p.length for p in sequence), 0
        for p in sequence:
            bearing = sum(x >= docs[p.doc][1] for x in range(p.start, p.start + p.length))
            assert p.loss == bearing and p.length > 0
            loss += bearing
            seen.setdefault(p.doc, []).append((p.start, p.length))
        assert tokens <= limits.tokens and len(sequence) <= limits.segments and loss <= limits.loss
        assert tokens == limits.tokens or tokens & (tokens - 1) == 0  # no padding
    for doc, (n, _) in enumerate(docs):
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at
            at += length
        assert at == n


def test_each_limit_binds():
    docs = documents(400)
    out = packing.pack(docs, packing.DOCUMENTS)
    assert any(len(s) == packing.DOCUMENTS.segments for s in packing.pack([(20, 2)] * 900, packing.DOCUMENTS))
    assert sum(sum(p.loss for p in s) == packing.DOCUMENTS.loss for s in packing.pack([(n, n // 8) for n, _ in docs], packing.DOCUMENTS)) > 10
    assert sum(sum(p.length for p in s) == 2048 for s in out) > 0.9 * len(out)


def test_prompts_come_from_a_column(spark):
    from quern.llm import queries

    rows = [(1, "one two three four", 2), (2, None, 5), (3, "five six", None), (3, "five six", -1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, prompt int")
    got = packing.packed(d, queries.tokenizer("word_bpe_49k.json"), limits=Limits()).groupBy("doc_id").sum("loss_tokens").collect()
    assert dict(got) == {1: 3, 2: 0, 3: 6}
