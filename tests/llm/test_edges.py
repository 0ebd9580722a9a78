"""Nulls, empty and repeated rows, empty tables and clashing columns: none may fail, all rows come out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import common, fingerprints, mixing, neardup, packing, quality_rules, queries, substrings, token_counts
from quern.llm import token_files, toxicity, warc
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(40))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, LONG, "en", "b", len(LONG)),
    (5, LONG, None, "b", len(LONG)),
    (6, "x " * 30_000, "de", None, 60_000),
    (7, "one", "en", "a", 3),
    (8, LONG + " ünï​çode 漢字 " + LONG, "en", "other", 1),
]


@pytest.fixture(scope="module")
def tables(spark):
    full = spark.createDataFrame(ROWS, SCHEMA)
    return {
        "full": full,
        "none": full.limit(0),
        "odd": full.union(full.where("doc_id = 4")).union(full.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long"))),
        "clash": full.withColumns({c: F.lit(1) for c in ("kept", "rule", "n_words", "topic", "selected", "n_tokens", "prompt", "steps", "width", "__v")})
        .withColumns({"z": F.lit("z"), "spans": F.array(F.lit(1)), "sig": F.lit(2.5), "score": F.lit(None).cast("boolean")}),
    }


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (7, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def operators(spark, labels):
    def files(d):
        at = common.new_folder(spark, "edge")
        token_files.write(d, at, queries.tokenizer("byte_bpe_50k.json"))
        return token_files.read_documents(spark, at)

    words = queries.tokenizer("word_bpe_49k.json")

    def counts(d):
        at = common.new_folder(spark, "edge-counts")
        token_counts.write(d, at, words)
        return token_counts.read(spark, at)

    return {
        "fingerprints": fingerprints.edited_documents,
        "quality": lambda d: quality_rules.judged(d, labels),
        "substrings": substrings.cut,
        "neardup": neardup.near_duplicates,
        "mixing": mixing.mixed,
        "counts": counts,
        "files": files,
        "packing": lambda d: packing.packed(d, words).where("start = 0"),
        "toxicity": lambda d: toxicity.scored(d, toxicity.train(*toxicity.sample(d, labels))),
    }


NAMES = "fingerprints quality substrings neardup mixing counts files packing toxicity".split()


@pytest.mark.parametrize("kind", ["full", "none", "odd", "clash"])
@pytest.mark.parametrize("name", NAMES)
def test_all_rows_come_out(spark, tables, labels, name, kind):
    d = tables[kind]
    out = operators(spark, labels)[name](d)
    got = sorted(r.doc_id or -1 for r in out.collect())
    assert got == sorted(r.doc_id or -1 for r in d.select("doc_id").collect())


def test_links_and_cuts(tables):
    docs = [(r[0], r[1]) for r in ROWS]
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(tables["full"], 2).collect()}
    assert near == brute.near(docs)
    cut = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.cut(tables["full"]).collect()}
    assert cut == brute.cut(docs)


def test_warc_segments(spark):
    rows = [(1, "http://a/\r\nb", "x" * 100), (2, None, None), (3, "u", "é" * 400), (4, "u", ""), (5, "u", "é" * 400), (6, "\n", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    at = common.new_folder(spark, "edge-warc")
    warc.write(pages, at, segment=64)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, at).collect()}
    assert got == brute.archived([(r[0], r[2]) for r in rows])
    odd = pages.union(pages.where("page_id = 5")).union(spark.createDataFrame([(None, None, "q")], pages.schema))
    for d in (odd, pages.limit(0)):
        at = common.new_folder(spark, "edge-warc")
        warc.write(d, at, segment=64)
        assert warc.read(spark, at).count() == d.count()


def test_warc_refuses_what_is_cut_short():
    block = warc._HTTP + warc.chunked(b"abc" * 50)
    parts = [(1, block[:90]), (2, block[90:])]
    assert warc.reassembled(parts, len(block), warc.digest(b"abc" * 50)) == b"abc" * 50
    for bad, total in ((parts[1:], len(block)), (parts, len(block) + 1), ([(1, block[:90]), (3, block[90:])], len(block))):
        with pytest.raises(ValueError):
            warc.reassembled(bad, total, warc.digest(b"abc" * 50))


def test_raking_meets_its_targets():
    import numpy as np

    cells = np.array([[[900.0, 50], [30, 20]], [[100, 200], [300, 400]]])
    wanted = [mixing.filled(cells.sum(axis=tuple(i for i in range(3) if i != a)), np.ones(2), 800) for a in range(3)]
    fit = mixing.rake(cells, wanted)
    assert (fit <= cells + 1e-9).all() and abs(fit.sum() - 800) < 40


def run_stages(spark, sf):
    """The rows of the documents and of every stage after them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf), name)
        out.append(docs.collect())
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    return out


def test_pipeline_of_odd_and_of_no_rows(spark, tmp_path):
    import shutil

    for n, rows in enumerate((ROWS, [])):
        sf = str(tmp_path / str(n))
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/documents.parquet")
        shutil.copy("/root/testdata/sf0.001/labels.parquet", f"{sf}/labels.parquet")
        *_, mixed, packed = run_stages(spark, sf)
        assert {r.doc_id for r in mixed} <= {4, 8} and {r.doc_id for r in packed} == {r.doc_id for r in mixed}
        assert bool(mixed) == bool(rows)


def test_every_pipeline_stage_against_plain_versions(spark):
    from tests.llm.test_queries import assert_packed

    sf = "/root/testdata/sf0.001"
    documents, good, unique, cut, mixed, packed = run_stages(spark, sf)
    counts = {r.doc_id: brute.counts(r.text) for r in documents}
    verdict = {r.doc_id: r.kept for r in queries.op2_quality_rules(spark, sf).collect()}
    assert {r.doc_id for r in good} == {i for i, kept in verdict.items() if kept}
    assert all(n >= 20 and 100 * repeated <= 30 * n for n, *_, repeated in (counts[r.doc_id] for r in good))
    near = brute.near([(r.doc_id, r.text) for r in good], 5)
    assert {r.doc_id for r in unique} == {i for i, (_, component) in near.items() if i == component}
    want = brute.cut([(r.doc_id, r.text) for r in unique])
    text = {r.doc_id: r.text for r in unique}
    assert {r.doc_id for r in cut} == set(text)
    for r in cut:
        words, gone, _ = want[r.doc_id]
        assert len(brute.words(r.text)) == words - gone and r.n_chars == len(r.text) and (gone or r.text == text[r.doc_id])
    assert {tuple(r) for r in mixed} <= {tuple(r) for r in cut}
    words = lambda rows: sum(len(brute.words(r.text)) for r in rows)
    assert 0.6 * words(cut) < words(mixed) < 0.95 * words(cut)
    assert_packed(packed, [(r.doc_id, r.text) for r in mixed])
