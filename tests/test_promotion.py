"""Promotion: gates, heterogeneous outputs, runs that break off, repeated runs."""

from __future__ import annotations

import json

import pytest

from quern.operators import promotion

SCHEMA = "unit_id string, review_state string, parser_status string, output string"
GOOD = {"headword": "moto", "headword_kind": "noun", "part_of_speech": {"code": "n", "label": "noun"}, "noun": {"classes": ["3"]}, "senses": [{"number": 1, "definition": "fire"}]}


def units(spark, *outputs, state="approved"):
    return spark.createDataFrame([(f"u{i}", state, "parsed", o if isinstance(o, str | None) else json.dumps(o)) for i, o in enumerate(outputs)], SCHEMA)


def rows(spark, folder, table):
    return sorted((r.unit_id, r.position, r.value) for r in promotion.published(spark, folder, table).collect())


def test_one_bad_row_stops_nothing(spark, tmp_path):
    bad = [{}, None, "", "{", "[1]", "null", GOOD | {"tone_pattern": "LHx"}, GOOD | {"tone_records": [{"pattern": "Q"}]}, GOOD | {"noun": {"classes": [" "]}}, GOOD | {"errors": ["x"]}]
    counts = promotion.promote(units(spark, GOOD, *bad), str(tmp_path))
    assert counts["lemma"] == 1 and counts["rejected"] == len(bad)
    assert rows(spark, str(tmp_path), "sense") == [("u0", 1, "fire")]
    got = {u: v for u, _, v in rows(spark, str(tmp_path), "rejected")}
    assert [got[f"u{i}"] for i in (2, 3, 5, 7, 8, 9, 10)] == [
        "invalid_output", "invalid_output", "invalid_output", "malformed_tone_pattern", "invalid_tone_record", "no_noun_class", "parser_errors",
    ]


def test_forms_of_every_shape(spark, tmp_path):
    forms = [" a ", "", {"forms": ["b", " ", "c"], "marker": ">"}, {"form_text": "d"}, {"form": "e", "marker": "?"}, {"text": "f", "marker": "<-"}, {"forms": []}, None]
    promotion.promote(units(spark, GOOD | {"derived_forms": forms}), str(tmp_path))
    got = {r.value: r.more for r in promotion.published(spark, str(tmp_path), "form").collect()}
    assert list(map(got.get, "abcdef")) == [
        {}, *[{"marker": ">", "relation": "headword_to_derived_form", "path": "derived_forms[2]"}] * 2, {},
        {"marker": "?", "relation": "source_marker_relation", "path": "derived_forms[4]"}, {"marker": "<-", "relation": "derived_form_to_headword", "path": "derived_forms[5]"},
    ]
    assert len(got) == 6


def test_a_run_that_breaks_off_leaves_nothing(spark, tmp_path, monkeypatch):
    folder, d = str(tmp_path), units(spark, GOOD, GOOD)
    monkeypatch.setattr(promotion, "TABLES", (*promotion.TABLES, "none"))
    monkeypatch.setattr(promotion, "Observation", type("Broken", (promotion.Observation,), {"get": property(lambda self: {"lemma": 1})}))
    with pytest.raises(RuntimeError):
        promotion.promote(d, folder)
    monkeypatch.undo()
    assert promotion.runs(spark, folder) == [] and promotion.published(spark, folder).count() == 0
    assert promotion.promote(d, folder)["lemma"] == 2
    assert promotion.promote(d, folder) == dict.fromkeys(promotion.TABLES, 0) | {"rejected": 2}
    assert {v for _, _, v in rows(spark, folder, "rejected")} == {"already_published"} and len(rows(spark, folder, "lemma")) == 2


def test_repeated_units_and_empty_batches(spark, tmp_path):
    d = units(spark, GOOD)
    counts = promotion.promote(d.union(d), str(tmp_path))
    assert counts["lemma"] == 1 == counts["rejected"]
    assert sum(promotion.promote(d.limit(0), str(tmp_path)).values()) == 0
    assert sum(promotion.promote(units(spark, GOOD, state=None), str(tmp_path)).values()) == 1
