"""Requests for verb forms: every reason of the table, and the concords of good ones."""

from __future__ import annotations

import json

from quern.operators import form_requests

PERSON = {"type": "person", "person": "first", "number": "singular"}
FINITE = {"generation_type": "verb_form", "tense_aspect": "present", "polarity": "positive", "subject": PERSON}
INF, IMP = {"generation_type": "infinitive"}, {"generation_type": "imperative"}
CASES = [
    ("not json", ("finite", "not_an_object", None)), (None, ("finite", "not_an_object", None)), ([1], ("finite", "not_an_object", None)),
    ({}, ("finite", "generation_type", "generation_type")), ({"generation_type": 5}, ("finite", "generation_type", "generation_type")),
    (FINITE | {"tense_aspect": "past"}, ("finite", "tense_aspect", "tense_aspect")), (FINITE | {"polarity": None}, ("finite", "polarity", "polarity")),
    (FINITE | {"reflexive": True}, ("finite", "reflexive", "reflexive")), (FINITE | {"reflexive": "false"}, ("finite", "reflexive", "reflexive")),
    (FINITE | {"object": "mu"}, ("finite", "object_not_an_object", "object")), (FINITE | {"object": [1]}, ("finite", "object_not_an_object", "object")),
    (FINITE | {"subject": "ndi"}, ("finite", "subject_not_an_object", "subject")), (FINITE | {"subject": PERSON | {"person": "third"}}, ("finite", "unknown_subject", "subject")),
    (FINITE | {"subject": {"type": "noun_class", "class_number": "99"}}, ("finite", "unknown_subject", "subject")),
    (FINITE | {"object": {"type": "x"}}, ("finite", "unknown_object", "object")), (FINITE | {"extensions": "passive"}, ("finite", "extensions_not_a_list", "extensions")),
    (FINITE | {"extensions": [5]}, ("finite", "extension_not_text_or_object", "extensions")), (FINITE | {"extensions": [None]}, ("finite", "extension_not_text_or_object", "extensions")),
    (FINITE | {"extensions": ["magic"]}, ("finite", "unknown_extension", "extensions")), (FINITE | {"extensions": [{"type": 4}]}, ("finite", "unknown_extension", "extensions")),
    (FINITE | {"extensions": [{"type": "causative", "style": 3}]}, ("finite", "style_not_text", "extensions")),
    (FINITE | {"extensions": [{"type": "reversive", "style": "urur"}]}, ("finite", "repetitive_style", "extensions")),
    (FINITE | {"extensions": [{"type": "reversive", "style": "unur"}]}, ("finite", "old_long_style", "extensions")),
    (FINITE | {"extensions": [{"type": "passive", "style": "long"}]}, ("finite", "unknown_style", "extensions")),
    (FINITE | {"extensions": ["passive", {"type": "causative", "style": "dz"}]}, ("finite", "unverified_extension", "extensions")),
    (FINITE | {"extensions": ["causative", "applicative", "neuter", "passive"]}, ("finite", "too_many_extensions", "extensions")),
    (FINITE | {"extensions": ["passive", "passive"]}, ("finite", "repeated_extension", "extensions")), (FINITE | {"extensions": ["passive", "neuter"]}, ("finite", "extension_order", "extensions")),
    (INF | {"mood": 1}, ("infinitive", "unknown_field", "mood")), (INF | {"polarity": "x"}, ("infinitive", "polarity", "polarity")), (INF | {"polarity": None}, ("infinitive", "polarity", "polarity")),
    (INF | {"reflexive": None}, ("infinitive", "reflexive_not_boolean", "reflexive")), (INF | {"object": 4}, ("infinitive", "object_not_an_object", "object")),
    (INF | {"object": PERSON, "reflexive": True}, ("infinitive", "object_and_reflexive", "object")), (INF | {"extensions": None}, ("infinitive", "extensions_not_a_list", "extensions")),
    (INF | {"object": {"type": "noun_class", "class_number": "x"}}, ("infinitive", "unknown_object", "object")),
    (IMP | {"reflexive": True, "subject": 1}, ("imperative", "reflexive_imperative", "reflexive")), (IMP | {"subject": 1, "reflexive": True}, ("imperative", "unknown_field", "subject")),
    (IMP | {"number": "dual"}, ("imperative", "number", "number")), (IMP | {"reflexive": False, "number": None}, ("imperative", "number", "number")),
]
GOOD = [
    (FINITE, ("ndi", None)), (FINITE | {"object": "", "reflexive": None, "extra": 1}, ("ndi", None)), (FINITE | {"reflexive": 0}, ("ndi", None)),
    (FINITE | {"subject": {"type": "noun_class", "class_number": "1"}}, ("u", None)), (FINITE | {"polarity": "negative", "subject": {"type": "noun_class", "class_number": "1a"}}, ("a", None)),
    (FINITE | {"object": {"type": "person", "person": "third", "number": "singular"}}, ("ndi", "mu")), (FINITE | {"object": {"type": "noun_class", "class_number": 7}}, ("ndi", "chi")),
    (INF | {"reflexive": True, "object": None, "extensions": [{"type": "reversive", "style": "long"}, "passive"]}, (None, None)), (IMP | {"reflexive": False, "number": "plural"}, (None, None)),
    (INF | {"extensions": [{"type": "causative", "style": None}]}, (None, None)),
]


def test_every_reason_and_the_concords(spark):
    rows = [(i, x if isinstance(x, str | None) else json.dumps(x)) for i, (x, _) in enumerate(CASES + GOOD)]
    d = form_requests.checked(spark.createDataFrame(rows, "id int, features string"))
    got = {r.id: r for r in d.collect()}
    for i, (x, want) in enumerate(CASES):
        assert (got[i].branch, got[i].reason, got[i].field) == want, x
        assert got[i].code == ("EXTENSION_UNVERIFIED" if want[1] == "unverified_extension" else "GENERATION_UNSUPPORTED")
    for i, (x, want) in enumerate(GOOD, len(CASES)):
        assert (got[i].reason, got[i].subject, got[i].object) == (None, *want), x
    assert {(b, f) for b, _, f, _, _ in form_requests.RULES if b == "finite"} <= {(w[0], w[1]) for _, w in CASES}


def test_requests_are_not_dealt_out(spark):
    d = form_requests.checked(spark.createDataFrame([(1, "{}")], "id int, features string"))
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
