"""Requests with named arguments: folded values, checks with stable codes, what they ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dialect codes as they are written.
DIALECTS = ("K", "Ko", "M", "Z")


def folded(value: Column, known: dict[str, str]) -> Column:
    """The code of a value in any case; an unknown one in capitals."""
    codes = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, F.lower(value)), F.upper(value))


def checked(df: DataFrame, given: str, known: tuple[str, ...], most: int, default: int = 20) -> DataFrame:
    """Adds code (of the first fault, else null), dialect and page_size of requests (a map of strings).

    An argument that is not known is a fault and never passed over.
    """
    arg = lambda name: F.try_element_at(F.col(given), F.lit(name))
    page = arg("limit")
    size = page.try_cast("int")
    dialects = F.create_map(*[F.lit(x) for d in DIALECTS for x in (d.lower(), d)])
    dialect = F.try_element_at(dialects, F.lower(arg("dialect")))
    unknown = F.size(F.array_except(F.map_keys(given), F.array(*map(F.lit, known)))) > 0
    code = (
        F.when(unknown, "UNSUPPORTED_FILTER")
        .when(F.coalesce(F.trim(arg("q")), F.lit("")) == "", "MISSING_QUERY")
        .when(page.isNotNull() & size.isNull(), "INVALID_LIMIT")
        .when((size < 1) | (size > most), "LIMIT_OUT_OF_RANGE")
        .when(arg("dialect").isNotNull() & dialect.isNull(), "INVALID_DIALECT")
    )
    df = df.withColumn("code", code)
    fine = F.col("code").isNull()
    return df.withColumns({"dialect": F.when(fine, dialect), "page_size": F.when(fine, F.coalesce(size, F.lit(default)))})
