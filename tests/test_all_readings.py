"""Queries that give every reading of every entry: more homographs than the bounds of the other readings."""

from __future__ import annotations

from itertools import product

import duckdb
import pytest

from quern.operators import lattice
from quern.plans import registry

SPELLINGS = ["".join(x) for x in product("zZ", "iI", "mM", "bB")]
TEXTS = [" ".join(w + "a" for w in SPELLINGS), " ".join(w + "A" for w in SPELLINGS), "zimbana Zimbana zimbira", "dya Dya na ti Iti mba", "", None, "a A 5 éa"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("homographs"))
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string").write.parquet(f"{at}/documents.parquet")
    return at


def both(spark, folder, name):
    """Rows of a query and of its SQL, columns by name."""
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = c.execute(registry.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    places = [[d[0] for d in want.description].index(n) for n in names]
    got = [tuple(r[n] for n in names) for r in registry.queries()[name](spark, folder).collect()]
    return names, sorted(got, key=repr), sorted((tuple(r[i] for i in places) for r in want.fetchall()), key=repr)


def test_commands_of_every_homograph(spark, folder):
    names, got, want = both(spark, folder, "mo07_imperative")
    assert got == want
    rows = [dict(zip(names, r, strict=True)) for r in got]
    every = set(TEXTS[0].split())  # a word in a capital A is no entry
    assert len(every) == 16 > lattice.READINGS > lattice.ENTRIES
    for surface in ("zimba", "zimbanyi", "usazimbe", "ndizimbe"):
        assert {r["entry"] for r in rows if r["surface"] == surface and r["headword"] == "zimba"} >= every
    most = [r["rank"] for r in rows if r["surface"] == "muzimbe"]  # each of four concords that are spelled mu
    assert sorted(most) == list(range(1, len(most) + 1)) and len(most) > lattice.ALL_READINGS


def test_segmentations_to_every_homograph(spark, folder):
    names, got, want = both(spark, folder, "mo13_dedupe")
    assert got == want


def test_segmentations_grow_with_homographs(spark, tmp_path):
    """As many spellings of the only stem, so many times the segmentations and readings of one spelling."""
    counts = []
    for name, text in (("one", "zimba"), ("many", TEXTS[0])):
        spark.createDataFrame([(1, text)], "doc_id int, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        d = registry.queries()["mo13_dedupe"](spark, f"{tmp_path}/{name}")
        counts.append({(r.lane, r.polarity, r.subject_features): (r.segmentations, r.readings) for r in d.collect()})
    one, many = counts
    assert one and many == {k: (len(SPELLINGS) * a, len(SPELLINGS) * b) for k, (a, b) in one.items()}
