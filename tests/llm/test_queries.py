"""Every query on a whole small table against its brute-force version."""

from __future__ import annotations

from collections import defaultdict

import pytest

from quern.llm import queries, substrings
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_fingerprints(spark, docs):
    want = brute.edited(docs)
    rows = queries.op1_fingerprints(spark, SF).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == want
    assert len(rows) == len(docs)
    by_text = defaultdict(set)
    text = dict(docs)
    for r in rows:
        by_text[text[r.doc_id] or ""].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in by_text.values())


def test_quality(spark, docs):
    rows = queries.op2_quality_rules(spark, SF).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows}
    assert got == {i: brute.counts(t) for i, t in docs}
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_substrings(spark, docs):
    rows = queries.op3_substrings(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == brute.cut(docs)


def test_substrings_of_hot_minimizers_in_short_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 2)
    monkeypatch.setattr(substrings, "SPAN", 5)
    rows = queries.op3_substrings(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == brute.cut(docs)


def test_paths_end_where_the_graph_branches(spark):
    # nodes 1 -> 2 -> 3 -> 4 -> 5 of one source; 3 is also entered from 9, whose source is another document
    edges = [(1, 2, 7, 3), (2, 3, 7, 4), (3, 4, 7, 5), (4, 5, 7, 6), (9, 3, 8, 0)]
    edges = spark.createDataFrame(edges, "a long, b long, source long, source_place int")
    found = {(r.source, r.start, r.end, r.path) for r in substrings.compacted(edges).collect()}
    assert found == {(7, 3, 5, 3), (7, 5, 7, 5), (8, 0, 1, 0)}


def test_paths_go_on_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SPAN", 4)
    edges = spark.createDataFrame([(i, i + 1, 7, i) for i in range(1, 23)], "a long, b long, source long, source_place int")
    found = substrings.compacted(edges).collect()
    assert {(r.block, r.path) for r in found} == {(k, 1) for k in range(6)}
    assert sum(r.end - r.start for r in found) == 22


def test_near_duplicates(spark, docs):
    rows = queries.op4_near_duplicates(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_warc(spark):
    pages = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    rows = queries.op5_warc(spark, SF).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == brute.archived(pages)


def test_mixing(spark, docs):
    rows = queries.op6_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    text = dict(docs)
    assert all(r.n_tokens == len(brute.words(text[r.doc_id])) for r in rows)
    total = sum(r.n_tokens for r in rows)
    assert abs(sum(r.n_tokens * r.probability for r in rows) - 0.8 * total) < 0.02 * total


def test_token_counts(spark, docs):
    rows = queries.op7_token_counts(spark, SF).collect()
    want = {}
    for i, t in docs:
        n = len(brute.ids("word_bpe_49k.json", t))
        want[i] = len((t or "").encode()), n, n > 2048
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == want


def test_token_files(spark, docs):
    rows = queries.op8_token_files(spark, SF).collect()
    want, start = {}, 0
    for i, t in sorted(docs):
        ids = [*brute.ids("byte_bpe_50k.json", t), 0]
        want[i] = start, len(ids), brute.crc(ids)
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == want


def assert_packed(rows, docs):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {i for i, _ in docs}
    for i, t in docs:
        ids, at = [*brute.ids("word_bpe_49k.json", t), 1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            at += r.length
            assert r.ids_crc32 == brute.crc(ids[r.start : at])
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 2048


def test_packing(spark, docs):
    assert_packed(queries.op9_packing(spark, SF).collect(), docs)


def test_toxicity(spark):
    from quern.llm import common

    sf = "/root/testdata/sf0.1"  # 120 held-out positives; a tenth of the size has 14, of noisy labels
    rows = queries.op10_toxicity(spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in common.table(spark, sf, "labels").collect()}
    assert all(r.held_out == brute.held_out(r.doc_id) and r.predicted == (r.score >= 0.3) for r in rows)
    seen = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    bad, good = [s for s, y in seen if y], [s for s, y in seen if not y]
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    assert wins >= 0.9 * len(bad) * len(good)
