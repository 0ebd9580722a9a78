"""Search tiers and the surface index."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.operators import cascade

ENTRIES = [("ziva", "ziva", True), ("ziva", "Ziva", False), ("tora", "tora", True), ("amba", "Amba", False), ("torera", "torera", True), ("zvita", "zvita", True)]
FORMS = [("zivas", "ziva"), ("ziva", "tora")]


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(ENTRIES, "headword string, entry string, public boolean"), spark.createDataFrame(FORMS, "form string, entry string")


def search(spark, dictionary, *asked):
    out: dict = {}
    for r in sorted(cascade.search(spark.createDataFrame([(a,) for a in asked], "q string"), *dictionary).collect(), key=lambda r: r.place):
        out.setdefault(r.q, []).append((r["match"], r.entry, r.form))
    return out


def test_each_tier_answers_what_is_left(spark, dictionary):
    got = search(spark, dictionary, "ziva", " ZIVA ", "zivas", "ndinoziva", "ndinotorera", "ndinoamba", "zivaa", "tors", "", None, "qqq", "zivass")
    assert got["ziva"] == [("exact_lemma", "ziva", None), ("exact_form", "tora", "ziva")]
    assert got["zivas"] == [("exact_form", "ziva", "zivas")]
    assert got["ndinoziva"] == [("morphology_lemma", "ziva", None)]  # an entry that is not public is no answer
    assert got["ndinotorera"] == [("morphology_lemma", "torera", None), ("morphology_lemma", "tora", None)]
    assert "ndinoamba" not in got and "qqq" not in got and "" not in got  # read, but of no public entry: nothing is guessed
    assert {m for m, _, _ in got["zivaa"]} == {"fuzzy_lemma", "fuzzy_form"} and got["zivaa"][0][1] == "ziva"
    assert got["tors"][0] == ("fuzzy_lemma", "tora", None)


def grams(x: str) -> set:
    padded = f"  {x} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def test_likeness_is_complete(spark):
    import random

    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abz", k=draw.randint(1, 9)))
    a, b = sorted({word() for _ in range(150)}), sorted({word() for _ in range(150)})
    want = {(x, y) for x in a for y in b if 10 * len(grams(x) & grams(y)) >= 3 * len(grams(x) | grams(y))}
    d = cascade.alike(spark.createDataFrame([(x,) for x in a], "q string"), spark.createDataFrame([(x,) for x in b], "spelling string"))
    assert {(r.q, r.spelling) for r in d.collect()} == want


def test_joins_read_the_index_in_place(spark, dictionary):
    entries, forms = dictionary
    surfaces = spark.createDataFrame([(x,) for x in ("ziva", "zivas", "ndinotora", "xyz", "ziva")], "surface string")
    index = cascade.SurfaceIndex.built(cascade.resolution(surfaces, entries, forms))
    got = {(r.surface, r.entry, r.tier) for r in index.table().collect()}
    assert got == {("ziva", "Ziva", 0), ("zivas", "ziva", 1), ("ndinotora", "tora", 2)}
    more = index.extended(surfaces.union(spark.createDataFrame([("kutora",)], "surface string")), entries, forms)
    assert {r.surface for r in more.table().collect()} == {"ziva", "zivas", "ndinotora", "kutora"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = surfaces.groupBy("surface").agg(F.count("*").alias("n"))
        plan = counts.join(index.table(), "surface")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_tags_of_tokens(spark, dictionary):
    entries, forms = dictionary
    rows = [("ziva", 3, 9, 0, "late"), ("zivas", 2, 5, 4, "x" * 300), ("zivas", 2, 5, 3, "first"), ("kuziva", None, 7, 1, "none"), ("xyz", 1, 1, 1, "no")]
    tokens = spark.createDataFrame(rows, "surface string, lesson int, page long, line int, context string")
    index = cascade.SurfaceIndex.built(cascade.resolution(tokens.select("surface"), entries.where("public"), forms))
    got = cascade.tagged(tokens, index).collect()
    assert [tuple(r) for r in got] == [("ziva", 4, 3, 0, 1, 7, "none")]
    assert cascade.tagged(tokens.limit(0), index).count() == 0


def test_contexts_are_not_dealt_out_with_tokens(spark, dictionary):
    """Of two rows of one place the one of the entry counts; tokens are added up by hash, without contexts."""
    entries, forms = dictionary
    rows = [("ziva", 2147483647, 2**62, 3, "b"), ("ziva", 2147483647, 2**62, 3, "a"), ("tora", 2147483647, 2**62, 3, "A"), ("tora", 0, 9, 10**9 - 1, "z"), ("tora", 0, 10, 0, "y")]
    tokens = spark.createDataFrame(rows, "surface string, lesson int, page long, line int, context string")
    index = cascade.SurfaceIndex.built(cascade.resolution(tokens.select("surface"), entries.where("public"), forms))
    got = {tuple(r) for r in cascade.tagged(tokens, index).collect()}
    assert got == {("ziva", 2, 1, 0, 2147483647, 2**62, "a"), ("tora", 3, 1, 0, 0, 9, "z")}
    sorts = []
    plan = lambda d: sorts.append(d._jdf.queryExecution().executedPlan().toString())
    kept = cascade.jsonl.kept
    cascade.jsonl.kept = lambda d, name: (plan(d), kept(d, name))[1]
    try:
        cascade.tagged(tokens, index)
    finally:
        cascade.jsonl.kept = kept
    assert sorts and "SortAggregate" not in sorts[0]


def test_likeness_in_blocks_keeps_the_best_of_each_kind(spark):
    import random

    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abz", k=draw.randint(1, 9)))
    a, b = sorted({word() for _ in range(60)}), sorted({word() for _ in range(400)})
    kind = {x: (i % 3 < 2, i % 3 > 0) for i, x in enumerate(b)}
    share = lambda x, y: len(grams(x) & grams(y)) / len(grams(x) | grams(y))
    known = spark.createDataFrame([(x, *kind[x]) for x in b], "spelling string, lemma boolean, form boolean")
    d = cascade.alike(spark.createDataFrame([(x,) for x in a], "q string"), known, 5, ["lemma", "form"], block=50)
    got = {(r.q, r.spelling): r.similarity for r in d.collect()}
    every = {(x, y): share(x, y) for x in a for y in b if 10 * len(grams(x) & grams(y)) >= 3 * len(grams(x) | grams(y))}
    assert got.items() <= every.items()
    for x in a:
        for k in (0, 1):
            first = sorted((-s, y) for (q, y), s in every.items() if q == x and kind[y][k])[:5]
            assert all((x, y) in got for _, y in first)
    small = cascade.alike(spark.createDataFrame([(x,) for x in a], "q string"), known, 5, ["lemma", "form"])
    assert small.count() < len(every)  # pairs that cannot be an answer are not handed on
