"""Examples and cross-references of a sense, from JSON lists whose items are strings or objects under several names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import orthography as ort

# Names that a field may have, the first with a text counts.
TEXT_KEYS, MEANING_KEYS = ("shona", "text", "source_text", "example"), ("english", "translation", "gloss", "meaning")
NOTE_KEYS = ("source_note", "raw_source", "raw_text", "note")
TYPE_KEYS, TARGET_KEYS = ("type", "kind", "relation"), ("target", "headword", "text")
# Words before a reference's target.
REFERENCE_WORDS = ("cp", "cf", "qv", "see")


def _kind(x: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0)


def _clean(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def _string(x: Column, path: str) -> Column:
    """A string at a path, without spare blanks; null if there is none or nothing is left."""
    return F.when(_kind(F.try_variant_get(x, path, "variant")) == "STRING", F.nullif(_clean(F.try_variant_get(x, path, "string")), F.lit("")))


def _first(x: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[_string(x, f"$.{k}") for k in keys])


def _strings(x: Column, path: str) -> Column:
    """The strings of a list with something in them."""
    items = F.coalesce(F.try_variant_get(x, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(items, lambda i: _string(i, "$")), lambda s: s.isNotNull())


def _items(json: Column) -> Column:
    v = F.try_parse_json(json)
    return F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))


def _split(x: Column) -> tuple[Column, Column]:
    """Text and meaning of a text with a colon, if both sides have something."""
    before = F.trim(F.substring_index(x, ":", 1))
    after = F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x)))
    both = F.contains(x, F.lit(":")) & (before != "") & (after != "")
    return F.when(both, before).otherwise(x), F.when(both, after)


def examples(json: Column) -> Column:
    """Array of (text, meaning, note, dialects) of a JSON list; items without text and meaning are left out, no list is empty."""

    def one(x: Column) -> Column:
        plain = _kind(x) == "STRING"
        text = F.when(plain, _string(x, "$")).when(_kind(x) == "OBJECT", _first(x, TEXT_KEYS))
        meaning = F.when(_kind(x) == "OBJECT", _first(x, MEANING_KEYS))
        head, tail = _split(text)
        split = meaning.isNull() & text.isNotNull()
        text, meaning = F.when(split, head).otherwise(text), F.when(split, tail).otherwise(meaning)
        note = F.when(_kind(x) == "OBJECT", _first(x, NOTE_KEYS))
        told = (note == F.coalesce(text, F.lit(""))) | (note == F.coalesce(meaning, F.lit("")))
        return F.struct(text.alias("text"), meaning.alias("meaning"), F.when(~told, note).alias("note"), _strings(x, "$.dialects").alias("dialects"))

    made = F.transform(_items(json), one)
    return F.filter(made, lambda e: e["text"].isNotNull() | e["meaning"].isNotNull())


def references(json: Column) -> Column:
    """Array of (type, target, note, dialects, target_id, target_headword, resolved) of a JSON list; those without a target are left out."""

    def one(x: Column) -> Column:
        plain, named = _kind(x) == "STRING", _kind(x) == "OBJECT"
        text = _string(x, "$")
        word = ort.casefold(F.substring_index(text, " ", 1))
        marked = F.contains(text, F.lit(" ")) & word.isin(*REFERENCE_WORDS)
        rest = F.when(marked, F.substring(text, F.locate(" ", text) + 1, F.length(text))).otherwise(text)
        target = F.when(plain, F.nullif(F.trim(rest, F.lit(" .")), F.lit(""))).when(named, _first(x, TARGET_KEYS))
        kind = F.when(plain & marked, word).when(named, F.coalesce(_first(x, TYPE_KEYS), F.lit("reference"))).otherwise("reference")
        note = F.when(plain, text).when(named, _first(x, NOTE_KEYS))
        known = F.when(_kind(F.try_variant_get(x, "$.resolved", "variant")) == "BOOLEAN", F.try_variant_get(x, "$.resolved", "boolean"))
        return F.struct(
            kind.alias("type"), target.alias("target"), note.alias("note"), _strings(x, "$.dialects").alias("dialects"),
            F.when(named, _string(x, "$.target_public_id")).alias("target_id"), F.when(named, _string(x, "$.target_headword")).alias("target_headword"), F.when(named, known).alias("resolved"),
        )

    return F.filter(F.transform(_items(json), one), lambda r: r["target"].isNotNull())


def resolved(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows with a reference ``r``: its target is the first entry (headword, then id) of that spelling in ``lexicon`` (headword, entry)."""
    known = lexicon.groupBy(ort.normalized(F.col("headword")).alias("__t")).agg(F.min(F.struct("headword", "entry")).alias("__first"))
    d = rows.withColumn("__t", ort.normalized(F.col("r.target"))).join(known, "__t", "left")
    hit = F.col("__first").isNotNull()
    r = F.col("r")
    r = r.withField("target_id", F.when(hit, F.col("__first.entry")).otherwise(F.col("r.target_id")))
    r = r.withField("target_headword", F.when(hit, F.col("__first.headword")).otherwise(F.col("r.target_headword")))
    return d.withColumn("r", r.withField("resolved", F.when(hit, True).otherwise(F.coalesce(F.col("r.resolved"), F.lit(False))))).drop("__t", "__first")
