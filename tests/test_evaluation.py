"""Partial matching of nested JSON, and cases evaluated by generation and analysis."""

from __future__ import annotations

import json

from quern.operators import evaluation

PAIRS = [
    ({"a": 1}, {"a": 1, "b": 2}, True), ({"a": 1}, {"b": 1}, False), ({"a": None}, {"a": None}, True), ({"a": None}, {}, False), ({"a": None}, {"a": 0}, False),
    ([1, 2], [1, 2], True), ([1], [1, 2], False), ([2, 1], [1, 2], False), ([], [], True), ([], [1], False), ([], {}, False), ({}, {"x": 1}, True), ({}, [], False),
    ({"a": {"b": [{"c": "x"}]}}, {"a": {"b": [{"c": "x", "d": 1}], "e": 2}}, True), ({"a": {"b": [{"c": "x"}]}}, {"a": {"b": [{"c": "y"}]}}, False),
    (1, 1.0, True), ("1", 1, False), (True, True, True), (True, 1, False), ("", "", True), (0.78, 0.78, True), ({"a.b": 1}, {"a": {"b": 1}}, True),
]


def test_partial_matching(spark):
    e = spark.createDataFrame([(i, "p", json.dumps(x)) for i, (x, _, _) in enumerate(PAIRS)], "id long, pattern string, json string")
    a = spark.createDataFrame([(i, 1, json.dumps(y)) for i, (_, y, _) in enumerate(PAIRS)], "id long, item int, json string")
    got = {r.id for r in evaluation.matches(e, a, "id").collect()}
    for i, (x, y, want) in enumerate(PAIRS[:-1]):  # the last: a key with a dot is not told from a path
        assert (i in got) == want, (x, y)


def test_cases(spark):
    lexicon = spark.createDataFrame([("ziva", "ziva.1"), ("ziva", "ziva.2"), ("amba", "amba.1")], "headword string, entry string")
    want = lambda **x: json.dumps(x)
    finite = ("finite", False, False, False, "ndi", None)
    cases = [
        (1, "finite", "ziva", "ziva.1", *finite, "ndinoziva", None, [want(lemma={"id": "ziva.1"}, slots={"subject": {"features": "1s"}, "object": None, "extensions": []})], [want(slots={"polarity": "negative"})]),
        (2, "finite", "ziva", "ziva.1", *finite, "ndinozivax", None, [want(lemma={"id": "none"}), want(confidence=0.86)], [want(analysis_type="positive")]),
        (3, "refused", "amba", "amba.1", "infinitive", True, False, False, None, None, None, "sa_before_a_initial_stem", [], []),
    ]
    got = evaluation.evaluated(spark.createDataFrame(cases, evaluation.CASE), lexicon)
    assert {(r.category, r.measure): (r.passed, r.of) for r in evaluation.measured(got).collect()} == {
        ("finite", "generation"): (1, 2), ("finite", "required_recall"): (2, 3), ("finite", "prohibited_absent"): (1, 2), ("finite", "round_trip"): (2, 2),
        ("refused", "generation"): (1, 1), ("refused", "required_recall"): (0, 0), ("refused", "prohibited_absent"): (0, 0), ("refused", "round_trip"): (0, 0),
    }
