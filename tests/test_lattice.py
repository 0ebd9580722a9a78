"""Readings of verb forms over the lattice of slots: known answers, bounds, refusals."""

from __future__ import annotations

import pytest

from quern.functions import concords
from quern.operators import lattice

LEXICON = ["ziva", "dya", "isa", "ona", "amba", "na", "ti", "tema", "tora", "sunga", "tsva"]


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [(w, f"{w}.1") for w in LEXICON] + [("ziva", "ziva.2")]
    return spark.createDataFrame(rows, "headword string, entry string")


def read(spark, lexicon, *surfaces):
    d = spark.createDataFrame([(s,) for s in surfaces], "surface string")
    out = {s: [] for s in surfaces}
    for r in sorted(lattice.readings(d, lexicon).collect(), key=lambda r: r["rank"]):
        out[r.surface].append((r.lane, r.polarity, r.number, r.subject_features, r.object_features, r.stem, r.entry, tuple(r.extensions), round(r.confidence, 2)))
    return out


def test_finite_forms_with_persons_and_classes(spark, lexicon):
    got = read(spark, lexicon, "ndinoziva", "handizivi", "handizive", "unodya", "haadyi", "chinomudya", "hatimuoni", "handiti")
    assert got["ndinoziva"] == [("positive", "positive", None, "1s", None, "ziva", e, (), 0.86) for e in ("ziva.1", "ziva.2")]
    for s, stem in (("handizivi", "zivi"), ("handizive", "zive")):
        assert got[s] == [("negative", "negative", None, "1s", None, stem, e, (), 0.86) for e in ("ziva.1", "ziva.2")]
    assert [x[3] for x in got["unodya"]] == ["2s", "class 1", "class 1a", "class 3"]
    assert {x[3] for x in got["haadyi"]} == {"class 1", "class 1a", "class 6"}
    assert [x[4] for x in got["chinomudya"]] == ["3s", "2p", "class 1", "class 1a", "class 18"] and {x[8] for x in got["chinomudya"]} == {0.78}
    assert [(x[3], x[4], x[8]) for x in got["hatimuoni"]][:2] == [("1p", "3s", 0.84), ("1p", "2p", 0.82)]
    assert got["handiti"] == [("negative", "negative", None, "1s", None, "ti", "ti.1", (), 0.86)]  # the ending is looked up as it is


def test_infinitives_and_commands(spark, lexicon):
    got = read(spark, lexicon, "kuziva", "kusaziva", "kuzviziva", "zivai", "zivanyi", "idya", "idyai", "dya", "riise", "usazive", "usaziva", "musadye", "ziva")
    assert got["kuziva"][0][:2] == ("infinitive", "positive") and got["kusaziva"][0][:2] == ("infinitive", "negative")
    assert [x[4] for x in got["kuzviziva"]] == [None, None, "class 8", "class 8"]  # reflexive first, then the class
    assert [x[2] for x in got["zivai"]] == ["plural", "plural"] == [x[2] for x in got["zivanyi"]]
    assert got["idya"][0][:6] == ("imperative", "positive", "singular", None, None, "dya") and got["idyai"][0][2] == "plural"
    assert got["dya"] == []  # no bare command of a stem without another vowel
    assert {x[4] for x in got["riise"]} == {"class 5", "class 21"}
    assert [x[:3] for x in got["usazive"][:2]] == [("imperative", "negative", "singular")] * 2 and got["usaziva"][0][5] == "ziva"
    assert got["musadye"][0][2] == "plural"
    assert got["ziva"][0][0] == "imperative"


def test_extensions_inside_every_lane(spark, lexicon):
    got = read(spark, lexicon, "ndinotemera", "kutoresa", "handitorerwi", "usatemane", "temesana", "ndinosungunura", "ndinozivur a".replace(" ", ""))
    assert got["ndinotemera"][0][6:8] == ("tema.1", ("er",))
    assert got["kutoresa"][0][6:8] == ("tora.1", ("es",))
    assert got["handitorerwi"][0][6:8] == ("tora.1", ("er", "w"))
    assert got["usatemane"][0][6:8] == ("tema.1", ("an",))
    assert ("es", "an") in [x[7] for x in got["temesana"]]
    assert got["ndinosungunura"][0][6:8] == ("sunga.1", ("unur",))
    assert got["ndinozivura"] == []  # the short reversive lacks evidence


def test_bounds(spark):
    many = spark.createDataFrame([("mua" if i % 2 else "a" * 2, f"e{i:02d}") for i in range(40)], "headword string, entry string")
    got = read(spark, many, "unomua", "kumua")
    by_subject: dict = {}
    for x in got["unomua"]:
        by_subject[x[3]] = by_subject.get(x[3], 0) + 1
    assert len(got["unomua"]) == lattice.ALL_READINGS and by_subject["2s"] == 8  # eight entries, then a contact of two a
    assert sum(x[0] == "infinitive" for x in got["kumua"]) == 8
    homographs = spark.createDataFrame([(w, f"{w}{i}") for w in ("mumu", "mu") for i in range(9)], "headword string, entry string")
    finite = [x for x in read(spark, homographs, "ndinomumu")["ndinomumu"] if x[3] == "1s"]
    assert len(finite) == 16 and [x[5] for x in finite] == ["mumu"] * 8 + ["mu"] * 8  # whole segmentations until there are 12


def diagnosed(spark, lexicon, *surfaces):
    d = spark.createDataFrame([(s,) for s in surfaces], "surface string")
    out = {s: set() for s in surfaces}
    for r in lattice.diagnoses(d, lexicon).collect():
        out[r.surface].add((r.code, r.detail))
    return out


def test_every_diagnosis(spark, lexicon):
    got = diagnosed(spark, lexicon, "kusaamba", "handivaambi", "haaambi", "usaamba", "musamuone", "ti", "handine", "kuxyz", "zivura", "xoterwa", "ndinoziva", "xyz")
    assert got["kusaamba"] == {("deferred_infinitive_boundary", "sa_before_a_initial_stem")}
    assert ("deferred_finite_boundary", "object_before_a_initial_stem") in got["handivaambi"]
    assert ("deferred_finite_boundary", "subject_before_a_initial_stem") in got["haaambi"]
    assert ("deferred_imperative_boundary", "sa_before_a_initial_stem") in got["usaamba"]
    assert got["musamuone"] == {("deferred_imperative_plural_object", "plural_with_object_concord")}
    assert got["ti"] == {("excluded_divergent_stem_imperative", "ti")}
    assert ("excluded_defective_pro_verb_stem", "na") in got["handine"]
    assert got["kuxyz"] == {("ku_infinitive_unmatched_stem", None)}
    assert ("unverified_extension_derivation", None) in got["zivura"]
    assert ("passive_or_extension_like", None) in got["xoterwa"]
    assert got["ndinoziva"] == set() == got["xyz"]


def test_other_classes_and_empty_tables(spark, lexicon):
    own = (("1", "u", "mu"), ("x", "gha", ""))
    d = spark.createDataFrame([("ghanoziva",), ("",)], "surface string")
    assert {r.subject_features for r in lattice.readings(d, lexicon, own).collect()} == {"class x"}
    assert lattice.readings(d.limit(0), lexicon).count() == 0 == lattice.readings(d, lexicon.limit(0)).count()
    assert lattice.diagnoses(d.limit(0), lexicon).count() == 0
    with pytest.raises(ValueError):
        lattice.slots(concords.CLASSES * 4)
