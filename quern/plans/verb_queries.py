"""Verb forms generated for all stems of the documents and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import verbs
from quern.plans import analysis_queries as analysis
from quern.plans.base import query

SUBJECTS = ("ndi", "u", "ti", "mu", "va")
OBJECTS = (None, "ku", "va", "a")
_S_SQL = ", ".join(f"('{x}')" for x in SUBJECTS)
_O_SQL = ", ".join(f"('{x}')" if x else "(CAST(NULL AS VARCHAR))" for x in OBJECTS)
_STEMS = f"{analysis._LEXICON}, s AS (SELECT DISTINCT headword AS stem FROM entries)"


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All headwords, those without a final a too."""
    return analysis.entries(analysis.spelled(spark, sf_dir)).select(F.col("headword").alias("stem")).distinct()


@query(
    "mo15_generate",
    f"""WITH {_STEMS}, f AS (SELECT * FROM s, (VALUES {_S_SQL}) c(subject), (VALUES {_O_SQL}) o(object), (VALUES (false), (true)) n(negative)),
    r AS (SELECT *, coalesce(object, '') AS o, CASE WHEN negative AND stem = 'na' THEN 'defective_pro_verb_stem' WHEN right(object, 1) = 'a' AND left(stem, 1) = 'a' THEN 'object_before_a_initial_stem'
      WHEN negative AND object IS NULL AND right(subject, 1) = 'a' AND left(stem, 1) = 'a' THEN 'subject_before_a_initial_stem' END AS refusal FROM f)
    SELECT stem, subject, object, negative, refusal, CASE WHEN refusal IS NOT NULL THEN NULL WHEN negative THEN 'ha' || subject || o || regexp_replace(stem, 'a$', 'i') ELSE subject || 'no' || o || stem END AS form FROM r""",
)
def mo15_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finite forms of every stem with all concords given, positive and negative, or what refuses them."""
    d = stems(spark, sf_dir)
    for name, values in (("subject", SUBJECTS), ("object", OBJECTS), ("negative", (False, True))):
        d = d.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    no = F.lit(False)
    args = (F.lit("finite"), F.col("negative"), no, no, F.col("subject"), F.col("object"))
    d = d.withColumn("refusal", verbs.refused(F.col("stem"), F.col("stem"), *args))
    return d.withColumn("form", F.when(F.col("refusal").isNull(), verbs.form(F.col("stem"), *args)))


# mode, negative, plural, reflexive, object, extensions (two at most)
FEATURES = (
    ("infinitive", False, False, False, None, ()), ("infinitive", True, False, False, None, ()), ("infinitive", False, False, True, None, ()),
    ("infinitive", True, False, False, "a", ()), ("infinitive", False, False, True, "va", ()), ("infinitive", False, False, False, "va", ("causative",)),
    ("infinitive", False, False, False, None, ("applicative", "passive")), ("infinitive", False, False, False, None, ("passive",)),
    ("infinitive", False, False, False, None, ("reversive",)), ("infinitive", False, False, False, None, ("repetitive",)),
    ("infinitive", False, False, False, None, ("causative", "reciprocal")), ("infinitive", False, False, False, None, ("neuter",)),
    ("imperative", False, False, False, None, ()), ("imperative", False, True, False, None, ()), ("imperative", True, False, False, None, ()),
    ("imperative", False, False, False, "ri", ()), ("imperative", False, True, False, "va", ()), ("imperative", True, True, False, "va", ("applicative",)),
    ("imperative", True, False, False, "a", ()), ("imperative", False, False, True, None, ()),
)
_NAMES = ("mode", "negative", "plural", "reflexive", "object", "extensions")
_lit = lambda x: "NULL" if x is None else f"'{','.join(x) if isinstance(x, tuple) else x}'" if isinstance(x, str | tuple) else str(x).lower()
_F_SQL = ", ".join("(" + ", ".join(map(_lit, f)) + ")" for f in FEATURES)
_V = "regexp_extract({b}, '([aeiou])[^aeiou]*$', 1)"


def _ext(e: str, b: str) -> str:
    """What the extension ``e`` adds to the base ``b``, in SQL."""
    v = _V.format(b=b)
    high = lambda m, h: f"CASE WHEN {v} IN ('e', 'o') THEN '{m}' ELSE '{h}' END"
    return f"""CASE {e} WHEN 'causative' THEN {high("es", "is")} WHEN 'applicative' THEN {high("er", "ir")} WHEN 'neuter' THEN {high("ek", "ik")} WHEN 'reciprocal' THEN 'an'
      WHEN 'repetitive' THEN CASE WHEN {v} = 'o' THEN 'oror' ELSE 'urur' END WHEN 'passive' THEN CASE WHEN {v} <> '' AND length({b}) > 2 THEN 'w' ELSE {high("ew", "iw")} END
      WHEN 'reversive' THEN CASE WHEN {v} <> '' THEN {v} || 'n' || CASE WHEN {v} = 'o' THEN 'o' ELSE 'u' END || 'r' END END"""


@query(
    "mo16_commands",
    f"""WITH {_STEMS}, f AS (SELECT * FROM s, (VALUES {_F_SQL}) t({", ".join(_NAMES)})),
    x AS (SELECT *, regexp_replace(stem, 'a$', '') AS b, string_split(extensions, ',')[1] AS e1, coalesce(string_split(extensions, ',')[2], '') AS e2 FROM f),
    y AS (SELECT *, CASE WHEN e1 = '' THEN b ELSE b || {_ext("e1", "b")} END AS b1 FROM x),
    z AS (SELECT *, CASE WHEN e1 = '' THEN stem WHEN e2 = '' THEN b1 || 'a' ELSE b1 || {_ext("e2", "b1")} || 'a' END AS made FROM y),
    r AS (SELECT *, coalesce(object, '') AS o, regexp_replace(made, 'a$', '') AS rad, CASE
      WHEN made IS NULL THEN 'extension_without_vowel' WHEN stem NOT LIKE '%a' THEN 'divergent_stem_without_terminal_a' WHEN mode = 'imperative' AND stem = 'na' THEN 'defective_pro_verb_stem'
      WHEN mode = 'imperative' AND reflexive THEN 'reflexive_imperative' WHEN mode = 'imperative' AND NOT negative AND plural AND object IS NOT NULL THEN 'plural_with_object_concord'
      WHEN mode = 'infinitive' AND reflexive AND object IS NOT NULL THEN 'object_with_reflexive' WHEN negative AND object LIKE 'a%' THEN 'sa_before_a_initial_object'
      WHEN negative AND object IS NULL AND NOT reflexive AND made LIKE 'a%' THEN 'sa_before_a_initial_stem' WHEN object LIKE '%a' AND made LIKE 'a%' THEN 'object_before_a_initial_stem' END AS refusal FROM z)
    SELECT stem, {", ".join(_NAMES)}, refusal, CASE WHEN refusal IS NOT NULL THEN NULL
      WHEN mode = 'infinitive' THEN 'ku' || CASE WHEN negative THEN 'sa' ELSE '' END || CASE WHEN reflexive THEN 'zvi' ELSE o END || made
      WHEN negative THEN CASE WHEN plural THEN 'musa' ELSE 'usa' END || o || rad || 'e' WHEN object IS NOT NULL THEN o || rad || 'e'
      ELSE CASE WHEN regexp_matches(rad, '[aeiou]') THEN '' ELSE 'i' END || made || CASE WHEN plural THEN 'i' ELSE '' END END AS form FROM r""",
)
def mo16_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infinitives and imperatives of every stem, with extensions, or what refuses them."""
    made = [F.struct(*[F.lit(",".join(v) if isinstance(v, tuple) else v).cast("string" if n in ("mode", "object", "extensions") else "boolean").alias(n) for n, v in zip(_NAMES, f, strict=True)]) for f in FEATURES]
    d = stems(spark, sf_dir).withColumn("f", F.explode(F.array(*made))).select("stem", "f.*")
    names = F.filter(F.split("extensions", ","), lambda e: e != "")
    made = verbs.extended(F.col("stem"), names)
    args = (F.col("mode"), F.col("negative"), F.col("plural"), F.col("reflexive"), F.lit(None).cast("string"), F.col("object"))
    d = d.withColumn("refusal", verbs.refused(F.col("stem"), made, *args))
    return d.withColumn("form", F.when(F.col("refusal").isNull(), verbs.form(made, *args)))
