"""Verb forms from a stem and features, as column expressions.

Features: mode (finite, infinitive, imperative), negative, plural, reflexive (booleans), subject and object (concords,
null for none), extensions (array of names, in their order).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of extensions before a base whose last vowel is e or o, and before others.
BY_HEIGHT = {"causative": ("es", "is"), "applicative": ("er", "ir"), "neuter": ("ek", "ik")}


def last_vowel(x: Column) -> Column:
    """Empty if there is none."""
    return F.regexp_extract(x, "([aeiou])[^aeiou]*$", 1)


def suffix(extension: Column, base: Column) -> Column:
    """What an extension adds to a base; null where it can't follow it."""
    v = last_vowel(base)
    mid = v.isin("e", "o")
    bare = (v == "") | (F.length(base) <= 2)
    out = (
        F.when(extension == "reciprocal", "an")
        .when(extension == "repetitive", F.when(v == "o", "oror").otherwise("urur"))
        .when(extension == "passive", F.when(~bare, "w").when(mid, "ew").otherwise("iw"))
        .when((extension == "reversive") & (v != ""), F.concat(v, F.lit("n"), F.when(v == "o", "o").otherwise("u"), F.lit("r")))
    )
    for name, (high, other) in BY_HEIGHT.items():
        out = out.when(extension == name, F.when(mid, high).otherwise(other))
    return out


def extended(stem: Column, extensions: Column) -> Column:
    """The stem with its extensions before the final vowel; null where one can't follow."""
    base = F.aggregate(extensions, F.regexp_replace(stem, "a$", ""), lambda b, e: F.concat(b, suffix(e, b)))
    return F.when(F.size(extensions) > 0, F.concat(base, F.lit("a"))).otherwise(stem)


def refused(headword: Column, stem: Column, mode: Column, negative: Column, plural: Column, reflexive: Column, subject: Column, obj: Column) -> Column:
    """Why a form is not made; null if it is.  Contacts of two a that no source shows are left out."""
    vowel = F.substring(stem, 1, 1) == "a"
    before = F.coalesce(obj.endswith("a"), F.lit(False)) & vowel
    sa = negative & (mode != "finite")
    return (
        F.when(stem.isNull(), "extension_without_vowel")
        .when((mode == "finite") & negative & (headword == "na"), "defective_pro_verb_stem")
        .when((mode != "finite") & ~headword.endswith("a"), "divergent_stem_without_terminal_a")
        .when((mode == "imperative") & (headword == "na"), "defective_pro_verb_stem")
        .when((mode == "imperative") & reflexive, "reflexive_imperative")
        .when((mode == "imperative") & ~negative & plural & obj.isNotNull(), "plural_with_object_concord")
        .when((mode == "infinitive") & reflexive & obj.isNotNull(), "object_with_reflexive")
        .when(sa & F.coalesce(obj.startswith("a"), F.lit(False)), "sa_before_a_initial_object")
        .when(sa & obj.isNull() & ~reflexive & vowel, "sa_before_a_initial_stem")
        .when(before, "object_before_a_initial_stem")
        .when((mode == "finite") & negative & obj.isNull() & subject.endswith("a") & vowel, "subject_before_a_initial_stem")
    )


def form(stem: Column, mode: Column, negative: Column, plural: Column, reflexive: Column, subject: Column, obj: Column) -> Column:
    """The surface of a form that nothing refuses."""
    o = F.coalesce(obj, F.lit(""))
    radical = F.regexp_replace(stem, "a$", "")
    ended = lambda v: F.when(stem.endswith("a"), F.concat(radical, F.lit(v))).otherwise(stem)
    finite = F.when(negative, F.concat(F.lit("ha"), subject, o, ended("i"))).otherwise(F.concat(subject, F.lit("no"), o, stem))
    infinitive = F.concat(F.lit("ku"), F.when(negative, "sa").otherwise(""), F.when(reflexive, "zvi").otherwise(o), stem)
    front = F.when(radical.rlike("[aeiou]"), "").otherwise("i")
    imperative = (
        F.when(negative, F.concat(F.when(plural, "musa").otherwise("usa"), o, ended("e")))
        .when(plural, F.concat(front, stem, F.lit("i")))
        .when(obj.isNotNull(), F.concat(o, ended("e")))
        .otherwise(F.concat(front, stem))
    )
    return F.when(mode == "finite", finite).when(mode == "infinitive", infinitive).otherwise(imperative)
