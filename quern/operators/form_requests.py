"""Requests for verb forms checked against a table of rules: features as JSON, the first rule that applies, the concords.

What is wrong with a request are facts, drawn from its JSON by expressions; which of them counts is a table (``RULES``) of
branch, ordinal, fact, code and field.  Each fact of a request is looked up in it, and the rule of least ordinal is the
answer: requests are neither dealt out nor worked out twice.

Edge cases: features that are null or no JSON object are refused as such; a null feature is not an absent one where the rules
tell them apart; of several wrong extensions the first counts; fields of any JSON type stop nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import chains, concords

UNSUPPORTED, UNVERIFIED = "GENERATION_UNSUPPORTED", "EXTENSION_UNVERIFIED"
# Fields that a branch takes, styles that an extension takes, and styles of old.
FIELDS = {
    "infinitive": ("generation_type", "polarity", "object", "reflexive", "extensions"),
    "imperative": ("generation_type", "polarity", "number", "object", "extensions", "reflexive"),
}
STYLES = {"causative": ("dz", "ts"), "reversive": ("long", "short")}
REPETITIVE_STYLES, LONG_STYLES = ("long_urur", "urur", "oror"), ("long_unur", "unur", "onor")
PERSONS, NUMBERS = {"first": "1", "second": "2", "third": "3"}, {"singular": "s", "plural": "p"}

_EXTENSION_FACTS = (
    "extensions_not_a_list", "extension_not_text_or_object", "unknown_extension", "style_not_text", "repetitive_style", "old_long_style", "unknown_style",
    "unverified_extension", "too_many_extensions", "repeated_extension", "extension_order",
)
# What is looked at in each branch, in order, with the field that an answer names.
_ORDER = {
    "infinitive": (("not_an_object", None), ("unknown_field", None), ("polarity", "polarity"), ("reflexive_not_boolean", "reflexive"), ("object_not_an_object", "object"), ("object_and_reflexive", "object"), *((f, "extensions") for f in _EXTENSION_FACTS), ("unknown_object", "object")),
    "imperative": (("not_an_object", None), ("unknown_field", None), ("reflexive_imperative", "reflexive"), ("polarity", "polarity"), ("number", "number"), ("object_not_an_object", "object"), *((f, "extensions") for f in _EXTENSION_FACTS), ("unknown_object", "object")),
    "finite": (("not_an_object", None), ("generation_type", "generation_type"), ("tense_aspect", "tense_aspect"), ("polarity", "polarity"), ("reflexive", "reflexive"), ("object_not_an_object", "object"), ("subject_not_an_object", "subject"), *((f, "extensions") for f in _EXTENSION_FACTS), ("unknown_subject", "subject"), ("unknown_object", "object")),
}
#: branch, ordinal, fact, code, field
RULES = tuple(
    (branch, n, fact, UNVERIFIED if fact == "unverified_extension" else UNSUPPORTED, field) for branch, facts in _ORDER.items() for n, (fact, field) in enumerate(facts)
)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "branch string, ordinal int, fact string, code string, field string")


def _kind(x: Column) -> Column:
    """STRING, BOOLEAN, OBJECT, ARRAY, VOID or a number's type; null where nothing is."""
    return F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0)


def _part(x: Column, path: str) -> Column:
    return F.try_variant_get(x, f"$.{path}", "variant")


def _text(x: Column, path: str) -> Column:
    """A field's text; null where it is no string."""
    return F.when(_kind(_part(x, path)) == "STRING", F.try_variant_get(x, f"$.{path}", "string"))


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs.items() for v in pair])


def _truthy(x: Column, path: str) -> Column:
    text = F.try_variant_get(x, f"$.{path}", "string")
    return F.coalesce(~text.isin("", "false", "0", "0.0", "[]", "{}"), F.lit(False))


def _concord(v: Column, path: str, persons: tuple, classes: dict) -> Column:
    """The surface that a subject or object names; null for one that there is not."""
    person = F.concat(F.try_element_at(_map(PERSONS), _text(v, f"{path}.person")), F.try_element_at(_map(NUMBERS), _text(v, f"{path}.number")))
    named = F.try_element_at(_map({features: surface for surface, features, _ in reversed(persons)}), person)
    of_class = F.try_element_at(_map(classes), F.try_variant_get(v, f"$.{path}.class_number", "string"))
    return F.when(_text(v, f"{path}.type") == "person", named).when(_text(v, f"{path}.type") == "noun_class", of_class)


def _extension_fact(x: Column) -> Column:
    """What is wrong with one extension; null if nothing is."""
    kind = _kind(x)
    name = F.when(kind == "STRING", F.try_variant_get(x, "$", "string")).otherwise(_text(x, "type"))
    style_kind = F.when(kind == "OBJECT", _kind(_part(x, "style")))
    style = _text(x, "style")
    styled = style_kind.isNotNull() & (style_kind != "VOID")
    allowed = F.lit(False)
    for e, styles in STYLES.items():
        allowed = F.when(name == e, style.isin(*styles)).otherwise(allowed)
    gated = F.lit(False)
    for e, s in sorted(chains.GATED):
        gated = gated | ((name == e) & (style == s))
    return (
        F.when(~kind.isin("STRING", "OBJECT"), "extension_not_text_or_object")
        .when(name.isNull() | ~name.isin(*chains.ORDER), "unknown_extension")
        .when(styled & (style_kind != "STRING"), "style_not_text")
        .when(styled & (name == "reversive") & style.isin(*REPETITIVE_STYLES), "repetitive_style")
        .when(styled & (name == "reversive") & style.isin(*LONG_STYLES), "old_long_style")
        .when(styled & ~allowed, "unknown_style")
        .when(styled & gated, "unverified_extension")
    )


def checked(requests: DataFrame, classes: tuple = concords.CLASSES) -> DataFrame:
    """Requests (with ``features``, JSON) with branch, code, field, reason (null: supported), and the surfaces subject and object."""
    own = [c for c in requests.columns]
    v = F.col("__v")
    d = requests.withColumn("__v", F.try_parse_json("features"))
    is_object = F.coalesce(_kind(v) == "OBJECT", F.lit(False))
    keys = F.coalesce(F.when(is_object, F.json_object_keys("features")), F.array().cast("array<string>"))
    asked = _text(v, "generation_type")
    branch = F.when(asked.isin("infinitive", "imperative"), asked).otherwise("finite")
    d = d.withColumns({"branch": branch, "__keys": keys, "__object": is_object})
    has = lambda c: F.array_contains("__keys", c)
    subjects = {n: s for n, s, _ in classes if s}
    objects = {n: o for n, _, o in classes if o}
    negative = _text(v, "polarity") == "negative"
    subject = _concord(v, "subject", concords.PERSON_SUBJECTS, subjects)
    personal = (_text(v, "subject.type") == "noun_class") & F.try_variant_get(v, "$.subject.class_number", "string").isin(*concords.PERSONAL)
    given = has("object") & ~(_kind(_part(v, "object")) == "VOID") & ~F.coalesce(_text(v, "object") == "", F.lit(False))
    extensions = F.try_variant_get(v, "$.extensions", "array<variant>")
    d = d.withColumns(
        {
            "subject": F.when(F.col("branch") == "finite", F.when(personal & F.coalesce(negative, F.lit(False)) & subject.isNotNull(), "a").otherwise(subject)),
            "object": F.when(given, _concord(v, "object", concords.PERSON_OBJECTS, objects)),
            "__given": given,
            "__list": F.coalesce(has("extensions") & (_kind(_part(v, "extensions")) == "ARRAY"), F.lit(False)),
            "__wrong": F.get(F.filter(F.transform(extensions, _extension_fact), lambda f: f.isNotNull()), F.lit(0)),
            "__names": F.transform(extensions, lambda x: F.coalesce(F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")), _text(x, "type"))),
        }
    )
    finite, infinitive, imperative = (F.col("branch") == b for b in ("finite", "infinitive", "imperative"))
    known = F.array(*map(F.lit, chains.ORDER))
    places = F.transform("__names", lambda n: F.array_position(known, n))
    ok_list = F.col("__list") & F.col("__wrong").isNull()
    foreign = lambda b: F.filter("__keys", lambda k: ~k.isin(*FIELDS[b]))
    reflexive = F.array_position("__keys", F.lit("reflexive"))
    first_foreign = F.array_position("__keys", F.get(foreign("imperative"), F.lit(0)))
    deferred = imperative & has("reflexive") & _truthy(v, "reflexive")
    before = deferred & (F.coalesce(first_foreign, F.lit(1 << 30)) > reflexive)
    wrong_polarity = ~F.coalesce(_text(v, "polarity").isin("positive", "negative"), F.lit(False)) & (finite | has("polarity"))
    no_boolean = has("reflexive") & (_kind(_part(v, "reflexive")) != "BOOLEAN")
    facts = {
        "not_an_object": ~F.col("__object"),
        "generation_type": finite & ~F.coalesce(asked == "verb_form", F.lit(False)),
        "unknown_field": F.when(infinitive, F.size(foreign("infinitive")) > 0).when(imperative, (F.size(foreign("imperative")) > 0) & ~before),
        "reflexive_imperative": before,
        "tense_aspect": ~F.coalesce(_text(v, "tense_aspect") == "present", F.lit(False)),
        "polarity": wrong_polarity,
        "number": has("number") & ~F.coalesce(_text(v, "number").isin("singular", "plural"), F.lit(False)),
        "reflexive_not_boolean": no_boolean,
        "reflexive": has("reflexive") & ~(_kind(_part(v, "reflexive")) == "VOID") & ~F.coalesce(F.try_variant_get(v, "$.reflexive", "string").isin("false", "0", "0.0") & (_kind(_part(v, "reflexive")) != "STRING"), F.lit(False)),
        "object_not_an_object": F.col("__given") & (_kind(_part(v, "object")) != "OBJECT"),
        "object_and_reflexive": F.col("__given") & F.coalesce(F.try_variant_get(v, "$.reflexive", "boolean"), F.lit(False)),
        "subject_not_an_object": ~F.coalesce(_kind(_part(v, "subject")) == "OBJECT", F.lit(False)),
        "extensions_not_a_list": has("extensions") & ~F.col("__list"),
        "too_many_extensions": ok_list & (F.size("__names") > chains.MOST),
        "repeated_extension": ok_list & (F.size(F.array_distinct("__names")) < F.size("__names")),
        "extension_order": ok_list & (F.array_sort(places) != places),
        "unknown_subject": F.col("subject").isNull(),
        "unknown_object": F.col("__given") & F.col("object").isNull(),
    }
    found = F.array_compact(F.concat(F.array(*[F.when(c, f) for f, c in facts.items()]), F.array(F.when(F.col("__list"), F.col("__wrong")))))
    d = d.withColumns({"__foreign": F.get(F.when(infinitive, foreign("infinitive")).otherwise(foreign("imperative")), F.lit(0)), "__facts": found})
    named = F.create_map(*[x for b, n, fact, code, field in RULES for x in (F.lit(f"{b} {fact}"), F.struct(F.lit(n).alias("ordinal"), F.lit(code).alias("code"), F.lit(field).cast("string").alias("field"), F.lit(fact).alias("reason")))])
    met = F.transform("__facts", lambda f: F.try_element_at(named, F.concat("branch", F.lit(" "), f)))
    d = d.withColumn("__first", F.array_min(F.filter(met, lambda r: r.isNotNull())))  # ordinals of a branch differ
    field = F.when(F.col("__first.reason") == "unknown_field", F.col("__foreign")).otherwise(F.col("__first.field"))
    d = d.withColumn("answer", F.when(F.col("__first").isNotNull(), F.struct("__first.code", field.alias("field"), "__first.reason")))
    good = F.col("answer").isNull()
    surfaces = [F.when(good, F.col(c)).alias(c) for c in ("subject", "object")]
    return d.select(*own, "branch", "answer.code", "answer.field", "answer.reason", *surfaces)
