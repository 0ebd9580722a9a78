"""Likeness of short strings by the trigrams that they share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(x: Column) -> Column:
    """Distinct runs of three characters of a string between two blanks on either side; none of an empty one."""
    padded = F.concat(F.lit("  "), x, F.lit("  "))
    runs = F.transform(F.sequence(F.lit(1), F.length(x) + 2), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(F.length(x) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def shared(a: Column, b: Column) -> tuple[Column, Column]:
    """Sizes of what two arrays of distinct values share and of their union."""
    both = F.size(F.array_intersect(a, b))
    return both, F.size(a) + F.size(b) - both


def one_confusable(a: Column, b: Column, pairs: tuple[str, ...]) -> Column:
    """Whether two strings of one length differ in one place only, there by one of ``pairs`` of letters."""
    places = F.sequence(F.lit(1), F.length(a))
    differ = F.filter(
        F.transform(places, lambda i: F.concat(F.substring(a, i, F.lit(1)), F.substring(b, i, F.lit(1)))),
        lambda p: F.substring(p, 1, 1) != F.substring(p, 2, 1),
    )
    allowed = [p for x in pairs for p in (x, x[::-1])]
    return (F.length(a) == F.length(b)) & (F.size(differ) == 1) & F.element_at(differ, 1).isin(allowed)
