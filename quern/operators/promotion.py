"""Promotion of reviewed units into the tables of the lexicon: one pass, all tables of a run or none.

A unit that passes the gate becomes rows of five tables (lemma, sense, tone, form, figurative) with one decision and one
audit row; a unit that does not becomes a row of ``rejected`` with the first thing against it.  All go out in one job,
partitioned by table, below a folder of the run; their counts are observed on the way.  Only a run whose marker was written
afterwards counts (``published``), so a run that breaks off leaves nothing behind that a reader sees, and can be repeated.

Edge cases: a unit whose output is no JSON object is rejected, as is one that an earlier run promoted or that stands in the
batch twice; null lists count as empty; blank items are left out; an empty batch commits a run without rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from quern.functions import labels

TABLES = ("lemma", "sense", "tone", "form", "figurative", "decision", "audit", "rejected")
# What shows that a label, a definition or a tone was not parsed.
LABEL_RESIDUE, LABEL_LENGTH = r"[\[\]]|\bcp\b|\bsee\b|\.\s*$", 60
UNRESOLVED_SENSE = r"\s[2-9]\.\s"
TONE = r"^[HL]+(?:\s+[HL]+)*$"
# What the mark before a derived form says of it.
RELATIONS = {">": "headword_to_derived_form", "<-": "derived_form_to_headword"}

OUTPUT = (
    "headword string, headword_kind string, part_of_speech struct<code string, label string>, dialects array<string>, errors array<string>, "
    "uncertainties array<string>, noun struct<classes array<string>>, senses array<struct<number int, definition string, grammar array<string>, dialects array<string>>>, "
    "tone_pattern string, tone_records array<struct<pattern string, dialects array<string>>>, derived_forms array<string>, "
    "idiomatic_expressions array<struct<expression_text string, idiomatic_meaning string, english_rendering string>>"
)
#: Columns of a row of any table: ``value`` its text, ``more`` what else it says.
ROW = "table string, unit_id string, position int, value string, more map<string,string>"


def _full(x: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def _some(x: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(x, F.array().cast(kind))


def _fails(x: Column, pattern: str) -> Column:
    return _full(x).isNotNull() & ~F.trim(x).rlike(pattern)


def against(o: str = "o") -> Column:
    """What keeps a parsed output from publication, in order."""
    c = lambda name: F.col(f"{o}.{name}")
    defined = F.exists(F.coalesce(c("senses.definition"), F.array().cast("array<string>")), lambda d: _full(d).isNotNull())
    classes = F.exists(_some(c("noun.classes")), lambda n: _full(n).isNotNull())
    unresolved = F.exists(_some(c("senses.definition")), lambda d: F.coalesce(d.rlike(UNRESOLVED_SENSE), F.lit(False)))
    bad = F.exists(_some(c("tone_records.pattern")), lambda p: ~F.coalesce(F.trim(p).rlike(TONE), F.lit(False)))
    label = c("part_of_speech.label")
    return F.array_compact(
        F.array(
            F.when(_full(c("part_of_speech.code")).isNull(), "no_pos_code"),
            F.when(label.rlike(LABEL_RESIDUE) | (F.length(label) > LABEL_LENGTH), "label_residue"),
            F.when((c("headword_kind") == "noun") & ~classes, "no_noun_class"),
            F.when(~defined, "no_definition"),
            F.when(unresolved, "unresolved_senses"),
            F.when(_fails(c("tone_pattern"), TONE), "malformed_tone_pattern"),
            F.when(bad, "invalid_tone_record"),
        )
    )


def gated(units: DataFrame) -> DataFrame:
    """Units (unit_id, review_state, parser_status, published, output) with the parsed output ``o`` and ``error``."""
    twice = F.row_number().over(Window.partitionBy("unit_id").orderBy("output")) > 1
    d = units.withColumns({"unit_id": F.col("unit_id").cast("string"), "twice": twice, "o": F.from_json("output", OUTPUT)})
    d = d.withColumn("against", against())
    error = (
        F.when(F.coalesce(F.col("review_state") != "approved", F.lit(True)), "not_approved")
        .when(F.col("parser_status") == "failed", "parser_failed")
        .when(~F.coalesce(F.ltrim("output").startswith("{"), F.lit(False)) | F.col("o").isNull(), "invalid_output")
        .when(F.size(_some(F.col("o.errors"))) > 0, "parser_errors")
        .when(F.size("against") > 0, F.get("against", F.lit(0)))
        .when(F.col("published") | F.col("twice"), "already_published")
    )
    return d.withColumn("error", error)


def _rows(table: str, items: Column, value, more) -> Column:
    """Rows of a table from a list, with their places."""
    made = F.transform(
        items,
        lambda x, i: F.struct(
            F.lit(table).alias("table"), (i + 1).cast("int").alias("position"), value(x).alias("value"),
            F.map_filter(F.create_map(*[y for k, v in more(x).items() for y in (F.lit(k), v)]), lambda _, v: v.isNotNull()).alias("more"),
        ),
    )
    return made


def _joined(x: Column) -> Column:
    return F.nullif(F.array_join(_some(x), ","), F.lit(""))


def records(units: DataFrame) -> DataFrame:
    """All rows that gated units become (``ROW``)."""
    o = lambda name: F.col(f"o.{name}")
    one = F.array(F.lit(1))
    lemma = _rows("lemma", one, lambda _: F.coalesce(_full(o("headword")), F.lit("")), lambda _: {
        "kind": F.coalesce(o("headword_kind"), F.lit("word")), "pos": labels.pos_code(o("part_of_speech.code")), "dialects": _joined(o("dialects")),
        "class": F.when(o("headword_kind") == "noun", _full(F.get(F.filter(_some(o("noun.classes")), lambda n: _full(n).isNotNull()), F.lit(0)))),
    })
    senses = F.coalesce(o("senses"), F.from_json(F.lit("[]"), "array<struct<number int, definition string, grammar array<string>, dialects array<string>>>"))
    sense = _rows("sense", senses, lambda s: s["definition"], lambda s: {"number": s["number"].cast("string"), "grammar": _joined(s["grammar"]), "dialects": _joined(s["dialects"])})
    kind = "array<struct<pattern string, dialects array<string>>>"
    listed = F.filter(F.coalesce(o("tone_records"), F.from_json(F.lit("[]"), kind)), lambda t: _full(t["pattern"]).isNotNull())
    alone = F.when(_full(o("tone_pattern")).isNotNull(), F.array(F.struct(o("tone_pattern").alias("pattern"), o("dialects").alias("dialects"))))
    tones = F.when(F.size(listed) > 0, listed).otherwise(F.coalesce(alone, F.from_json(F.lit("[]"), kind)))
    tone = _rows("tone", tones, lambda t: F.trim(t["pattern"]), lambda t: {"dialects": _joined(t["dialects"])})

    item = F.transform(_some(o("derived_forms")), lambda x, i: F.struct(F.from_json(x, "forms array<string>, form_text string, form string, text string, marker string").alias("j"), x.alias("raw"), i.alias("i")))
    texts = lambda x: F.when(~x["raw"].startswith("{"), F.array(x["raw"])).otherwise(F.coalesce(x["j"]["forms"], F.array(x["j"]["form_text"], x["j"]["form"], x["j"]["text"])))
    relations = F.create_map(*[F.lit(v) for p in RELATIONS.items() for v in p])
    marker = lambda x: F.when(x["raw"].startswith("{"), _full(x["j"]["marker"]))
    flat = F.flatten(F.transform(item, lambda x: F.transform(F.filter(texts(x), lambda t: _full(t).isNotNull()), lambda t: F.struct(F.trim(t).alias("text"), marker(x).alias("marker"), x["i"].alias("i")))))
    form = _rows("form", flat, lambda f: f["text"], lambda f: {
        "marker": f["marker"], "relation": F.when(f["marker"].isNotNull(), F.coalesce(F.try_element_at(relations, f["marker"]), F.lit("source_marker_relation"))),
        "path": F.when(f["marker"].isNotNull(), F.concat(F.lit("derived_forms["), f["i"].cast("string"), F.lit("]"))),
    })
    idioms = F.coalesce(o("idiomatic_expressions"), F.from_json(F.lit("[]"), "array<struct<expression_text string, idiomatic_meaning string, english_rendering string>>"))
    idioms = F.filter(idioms, lambda x: _full(x["expression_text"]).isNotNull() & F.coalesce(_full(x["idiomatic_meaning"]), _full(x["english_rendering"])).isNotNull())
    figurative = _rows("figurative", idioms, lambda x: F.trim(x["expression_text"]), lambda x: {"meaning": _full(x["idiomatic_meaning"]), "rendering": _full(x["english_rendering"])})
    decision = _rows("decision", one, lambda _: F.lit("publish"), lambda _: {"uncertainties": _joined(o("uncertainties"))})
    audit = _rows("audit", one, lambda _: F.lit("published"), lambda _: {"from": F.col("review_state")})
    rejected = _rows("rejected", one, lambda _: F.col("error"), lambda _: {"state": F.col("review_state")})
    made = F.when(F.col("error").isNotNull(), rejected).otherwise(F.concat(lemma, sense, tone, form, figurative, decision, audit))
    return units.select("unit_id", F.explode(made).alias("r")).select("r.table", "unit_id", "r.position", "r.value", "r.more")


def runs(spark: SparkSession, folder: str) -> list[str]:
    """The runs that were committed: one name each, whatever their rows."""
    try:
        return sorted(r["run"] for r in spark.read.schema("run string").json(f"{folder}/markers/*").collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def published(spark: SparkSession, folder: str, table: str | None = None) -> DataFrame:
    """Rows of the committed runs (``ROW``), of one table or of all."""
    found = [f"{folder}/runs/{r}" for r in runs(spark, folder)]
    d = None
    for at in found:  # one folder for each run; each is partitioned by table
        part = spark.read.schema("unit_id string, position int, value string, more map<string,string>, table string").option("basePath", at).parquet(at)
        d = part if d is None else d.unionByName(part)
    d = spark.createDataFrame([], ROW) if d is None else d.select("table", "unit_id", "position", "value", "more")
    return d if table is None else d.where(F.col("table") == table)


def promote(units: DataFrame, folder: str) -> dict[str, int]:
    """Promotes a batch of units; the number of rows of each table.  ``units``: unit_id, review_state, parser_status, output."""
    spark, run = units.sparkSession, uuid.uuid4().hex
    before = published(spark, folder, "lemma").select(F.col("unit_id").alias("unit_id"), F.lit(True).alias("published"))
    d = units.withColumn("unit_id", F.col("unit_id").cast("string")).join(before, "unit_id", "left").withColumn("published", F.col("published").isNotNull())
    seen = Observation()
    d = records(gated(d)).observe(seen, *[F.count_if(F.col("table") == t).alias(t) for t in TABLES])
    d.write.partitionBy("table").parquet(f"{folder}/runs/{run}")
    counts = {t: seen.get.get(t, 0) for t in TABLES}
    if not counts["lemma"] == counts["decision"] == counts["audit"]:
        raise RuntimeError(f"tables of run {run} differ: {counts}; it is not committed")
    spark.createDataFrame([(run, counts)], "run string, counts map<string,long>").coalesce(1).write.json(f"{folder}/markers/{run}")
    return counts
