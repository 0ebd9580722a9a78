"""Cases held against generation and analysis, by partial matching of nested JSON.

An expected object asks for its keys alone, a list for its length and items in order, null for a null that is there.  Both
sides are flattened into rows of path, kind and value (``flattened``, by levels of ``variant_explode``), so that a match is an
equi-join: as many rows of the expectation met as it has.  Numbers are equal by value, and are no booleans.

``evaluated`` makes each case's form, reads it, and holds its readings against the case's required and prohibited patterns.
A measure's denominator is what the cases declare, whatever comes of them.

Edge cases: JSON deeper than ``DEPTH`` ends the query; what is no JSON meets nothing and no pattern of that kind is met; a
case without required patterns adds none to the denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import verbs
from quern.operators import lattice
from quern.sources import jsonl

#: Levels of nesting that are looked into.
DEPTH = 5
CASE = (
    "case_id long, category string, headword string, entry string, mode string, negative boolean, plural boolean, reflexive boolean, subject string, object string, "
    "expected_surface string, expected_refusal string, required array<string>, prohibited array<string>"
)


def flattened(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """keys, path, kind, value: a row for every object, list and plain value in a column of JSON."""
    spark = df.sparkSession
    d = df.select(*keys, F.lit("$").alias("path"), F.try_parse_json(json).alias("v")).where("v IS NOT NULL")
    out = None
    for level in range(DEPTH + 1):
        kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
        kind = F.when(kind.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN", "VOID"), kind).otherwise("NUMBER")
        d = d.withColumn("kind", kind)
        text = F.try_variant_get("v", "$", "string")
        value = (
            F.when(F.col("kind") == "ARRAY", F.size(F.try_variant_get("v", "$", "array<variant>")).cast("string"))
            .when(F.col("kind") == "NUMBER", F.try_variant_get("v", "$", "double").cast("string"))
            .when(F.col("kind").isin("STRING", "BOOLEAN"), text)
            .otherwise("")
        )
        if level == DEPTH:
            deep = F.raise_error(F.concat(F.lit("too deep at "), "path")).cast("string")
            value = F.when(F.col("kind").isin("OBJECT", "ARRAY"), deep).otherwise(value)
        rows = d.select(*keys, "path", "kind", value.alias("value"))
        out = rows if out is None else out.unionByName(rows)
        if level < DEPTH:
            inner = d.where("kind IN ('OBJECT', 'ARRAY')").select(*keys, F.col("path").alias("above"), "v")
            inner = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
            step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
            d = inner.select(*keys, F.concat("above", step).alias("path"), F.col("value").alias("v"))
    return out


def matches(expected: DataFrame, actual: DataFrame, by: str) -> DataFrame:
    """(by, pattern, item) of all expectations (by, pattern, json) that items (by, item, json) of the same ``by`` meet."""
    e = jsonl.kept(flattened(expected, [by, "pattern"], "json"), "expected")
    n = e.groupBy(by, "pattern").agg(F.count("*").alias("n"))
    a = flattened(actual, [by, "item"], "json")
    met = e.join(a, [by, "path", "kind", "value"]).groupBy(by, "pattern", "item").agg(F.count("*").alias("met"))
    return met.join(n, [by, "pattern"]).where("met = n").select(by, "pattern", "item")


def reading_json() -> Column:
    """A reading of ``lattice.readings`` as nested JSON."""
    concord = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("surface"), F.col(f"{c}_features").alias("features")))
    return F.to_json(
        F.struct(
            F.col("lane").alias("analysis_type"), "confidence", F.struct(F.col("entry").alias("id"), F.col("headword").alias("headword")).alias("lemma"),
            F.struct(concord("subject").alias("subject"), concord("object").alias("object"), "polarity", "number", "reflexive", F.col("stem").alias("verb_stem"), "extensions").alias("slots"),
        ),
        {"ignoreNullFields": "false"},
    )


def evaluated(cases: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Each case (``CASE``) with its form, whether it and its refusal are the expected ones, and how many of its patterns were met."""
    feature = [F.col(c) for c in ("mode", "negative", "plural", "reflexive", "subject", "object")]
    refusal = verbs.refused(F.col("headword"), F.col("headword"), *feature)
    d = cases.withColumns({"refusal": refusal, "form": F.when(refusal.isNull(), verbs.form(F.col("headword"), *feature))})
    d = jsonl.kept(d, "cases")
    asked = F.coalesce("form", "expected_surface")
    read = lattice.readings(d.select(asked.alias("surface")).where("surface IS NOT NULL").distinct(), lexicon)
    read = d.select("case_id", asked.alias("surface")).join(read, "surface").select("case_id", F.col("rank").alias("item"), "entry", reading_json().alias("json"))
    read = jsonl.kept(read, "readings")
    listed = lambda c: d.select("case_id", F.posexplode(c).alias("at", "json")).select("case_id", F.concat(F.lit(f"{c} "), F.col("at").cast("string")).alias("pattern"), "json")
    met = matches(listed("required").union(listed("prohibited")), read.select("case_id", "item", "json"), "case_id")
    met = met.select("case_id", "pattern").distinct().groupBy("case_id").agg(
        F.count_if(F.col("pattern").startswith("required")).alias("recovered"), F.count_if(F.col("pattern").startswith("prohibited")).alias("produced")
    )
    back = read.join(d.select("case_id", "entry"), ["case_id", "entry"]).select("case_id", F.lit(True).alias("back")).distinct()
    d = d.join(met, "case_id", "left").join(back, "case_id", "left")
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return d.select(
        "case_id", "category", "form", "refusal",
        F.col("form").eqNullSafe(F.col("expected_surface")).alias("surface_ok"), F.col("refusal").eqNullSafe(F.col("expected_refusal")).alias("refusal_ok"),
        F.size("required").cast("long").alias("required"), whole("recovered").alias("recovered"), F.size("prohibited").cast("long").alias("prohibited"), whole("produced").alias("produced"),
        (F.col("back") & F.col("form").isNotNull()).alias("back"),
    )


def measured(results: DataFrame) -> DataFrame:
    """category, measure, passed, of: numerators over the denominators that the cases declare."""
    made = F.col("form").isNotNull()
    r = results.groupBy("category").agg(
        F.struct(F.count_if(F.col("surface_ok") & F.col("refusal_ok")).alias("passed"), F.count("*").alias("of")).alias("generation"),
        F.struct(F.sum("recovered").alias("passed"), F.sum("required").alias("of")).alias("required_recall"),
        F.struct((F.sum("prohibited") - F.sum("produced")).alias("passed"), F.sum("prohibited").alias("of")).alias("prohibited_absent"),
        F.struct(F.count_if(F.coalesce("back", F.lit(False))).alias("passed"), F.count_if(made).alias("of")).alias("round_trip"),
    )
    names = ("generation", "required_recall", "prohibited_absent", "round_trip")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"{n}.passed").alias("passed"), F.col(f"{n}.of").alias("of")) for n in names]))
    return r.select("category", rows.alias("m")).select("category", "m.*")
