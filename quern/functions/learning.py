"""Scores, tiers and levels of words by where and how often lessons use them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lesson_score(lesson: Column) -> Column:
    """1 for the first lesson down to 0 for the 30th and later; 0 without one."""
    at = F.least(lesson, F.lit(30))
    return F.when(lesson > 0, 1 - (at - 1) / F.lit(29.0)).otherwise(F.lit(0.0))


def score(lesson: Column, occurrences: Column) -> Column:
    often = F.least(occurrences / F.lit(5.0), F.lit(1.0))
    both = F.lit(0.7).cast("double") * lesson_score(lesson) + F.lit(0.3).cast("double") * often
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), both)), 3)


def tier(score: Column) -> Column:
    return (
        F.when(score >= 0.75, "core").when(score >= 0.4, "common").when(score > 0, "rare").otherwise("unseen")
    )


def level(lesson: Column) -> Column:
    return F.when(lesson <= 10, "beginner").when(lesson <= 25, "intermediate").otherwise("advanced")
