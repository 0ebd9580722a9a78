"""Replay of the morphology over a dictionary: every form that looks like a verb's must be read as its own entry.

All distinct surfaces are read in one go; a form meets the entries of its surface's readings (25 at most) by one join.
Entries of the expected headword, but not the expected one, are homographs: noted, not wrong.

Edge cases: a null or blank form, one of several words and a derived one is not replayed; repeated forms come out as often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import orthography as ort
from quern.operators import lattice


def looks_analysable(form: Column, stem: Column, kind: Column) -> Column:
    """Whether a form (folded) of a verb stem has the outside of a form that is read."""
    ends = form.endswith(stem)
    before = F.left(form, F.length(form) - F.length(stem))
    prefixed = before.startswith("ku") | before.startswith("ha") | before.endswith("no")
    loose = form.startswith("ku") | form.startswith("ha") | F.contains(form, F.lit("no"))
    fits = F.when(F.coalesce(stem, F.lit("")) == "", loose).when(form == F.concat(F.lit("ku"), stem), True).when(ends, prefixed).otherwise(loose)
    return F.coalesce((form != "") & ~F.contains(form, F.lit(" ")) & (F.coalesce(kind, F.lit("")) != "derived") & fits, F.lit(False))


def replayed(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Forms (entry, headword, form, kind) that are replayed, with category, severity and the other entry found.

    category: null where the one expected entry is found; ``morphology_unsupported``, ``wrong_lemma``, ``ambiguous_result``
    (homographs alone, homographs among others, or the expected entry among others: ``note``).
    """
    d = forms.withColumn("surface", ort.normalized(F.col("form")))
    d = d.where(looks_analysable(F.col("surface"), F.col("headword"), F.col("kind")))
    read = lattice.readings(d.select("surface").distinct(), lexicon).groupBy("surface").agg(
        F.array_sort(F.collect_set("entry")).alias("entries"), F.collect_set("headword").alias("headwords")
    )
    d = d.join(read, "surface", "left")
    found, same = F.array_contains("entries", F.col("entry")), F.array_contains("headwords", F.col("headword"))
    several = F.size("entries") > 1
    d = d.withColumn(
        "note",
        F.when(F.col("entries").isNull(), "unread")
        .when(found, F.when(several, "several_entries"))
        .when(same & (F.size("headwords") == 1), "homographs_only")
        .when(same, "homographs_and_others")
        .otherwise("other_headword"),
    )
    category = (
        F.when(F.col("note") == "unread", "morphology_unsupported")
        .when(F.col("note") == "other_headword", "wrong_lemma")
        .when(F.col("note").isNotNull(), "ambiguous_result")
    )
    severity = F.when(category == "ambiguous_result", "info").when(category.isNotNull(), "error")
    other = F.filter("entries", lambda e: e != F.col("entry"))
    actual = F.when(F.col("note") == "other_headword", F.get("entries", F.lit(0))).when(F.col("note").isNotNull(), F.get(other, F.lit(0)))
    return d.select("entry", "headword", "form", category.alias("category"), "note", severity.alias("severity"), actual.alias("actual"))
