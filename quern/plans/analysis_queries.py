"""Verb forms analysed over the lattice of slots; the SQL cuts them lane by lane and makes the extended stems instead.

The lexicon is the words of the documents that end in a, or in ti (stems without a final a): the folded word is the
headword, each spelling of it an entry of its own.  The surfaces are forms of its stems in a and the words of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import chains, concords, spelling, verbs
from quern.operators import lattice
from quern.plans.base import query, table
from quern.sources import jsonl

SUBJECTS = tuple(dict.fromkeys(c.surface for c in concords.subjects()))
OBJECTS = tuple(dict.fromkeys(c.surface for c in concords.objects()))
_values = lambda names: ", ".join(f"('{x}')" for x in names)
_LEXICON = r"""words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents),
    entries AS (SELECT w AS entry, lower(w) AS headword FROM words WHERE regexp_matches(w, '^[A-Za-z]+(a|ti)$')), lex AS (SELECT DISTINCT headword AS stem FROM entries WHERE headword LIKE '%a')"""
_SC = f"sc(sc) AS (VALUES {_values(SUBJECTS)})"
_OC = f"oc(oc) AS (VALUES {_values(OBJECTS)}, (''))"
_FREE = "NOT (oc LIKE '%a' AND stem LIKE 'a%')"  # an object in a before a stem in a is left out


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of the documents as they are written: a table, as it is read for entries, stems and surfaces."""
    found = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    return jsonl.kept(table(spark, sf_dir, "documents").select(F.explode(found).alias("word")).distinct(), "words")


def entries(words: DataFrame) -> DataFrame:
    return words.where(F.col("word").rlike("^[A-Za-z]+(a|ti)$")).select(F.lower("word").alias("headword"), F.col("word").alias("entry"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stems in a alone."""
    found = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    d = table(spark, sf_dir, "documents").select(F.explode(found).alias("word"))
    return d.where(F.col("word").rlike("^[A-Za-z]+a$")).select(F.lower("word").alias("stem")).distinct()


def combined(df: DataFrame, **values) -> DataFrame:
    """Each row with each combination of a few constants."""
    for name, options in values.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, options))))
    return df


# Templates of forms by lane: S and O stand for each concord, a for the stem, e and i for the stem in e and in i.
FORMS = {
    "infinitive": ("ku{a}", "kusa{a}", "kuzvi{a}", "kumu{a}", "kusava{a}", "kusaa{a}"),
    "positive": ("{S}no{a}", "ndinomu{a}", "unova{a}"),
    "negative": ("ha{S}{i}", "handi{e}", "hatimu{i}", "havava{e}"),
    "imperative": ("{a}", "{a}i", "{a}nyi", "i{a}", "i{a}i", "{O}{e}", "usa{e}", "musa{e}", "musa{a}", "usamu{e}", "usaa{e}", "musava{e}"),
}


def _made(stems: DataFrame, lanes: tuple[str, ...]) -> DataFrame:
    """The forms of every stem in a in these lanes, each once."""
    parts = {"a": F.col("stem"), "i": F.concat("body", F.lit("i")), "e": F.concat("body", F.lit("e"))}
    every = []
    for t in (t for lane in lanes for t in FORMS[lane]):
        kind = "S" if "{S}" in t else "O"
        for c in (SUBJECTS if kind == "S" else OBJECTS) if "{S}" in t or "{O}" in t else ("",):
            before, after, last = next((t.replace(f"{{{kind}}}", c).split(f"{{{v}}}") + [v]) for v in parts if f"{{{v}}}" in t)
            every.append(F.concat(F.lit(before), parts[last], F.lit(after)))
    stems = stems.where(F.col("stem").endswith("a")).withColumn("body", F.expr("left(stem, length(stem) - 1)"))
    return stems.select(F.explode(F.array(*every)).alias("surface")).distinct()


def _made_sql(lanes: tuple[str, ...]) -> str:
    ends = {"a": "stem", "i": "left(stem, length(stem) - 1) || 'i'", "e": "left(stem, length(stem) - 1) || 'e'"}
    some = []
    for t in (t for lane in lanes for t in FORMS[lane]):
        text = "'" + t.replace("{S}", "' || sc || '").replace("{O}", "' || oc || '")
        for v, sql in ends.items():
            text = text.replace(f"{{{v}}}", f"' || {sql} || '")
        of = "lex, sc" if "{S}" in t else "lex, (SELECT oc FROM oc WHERE oc <> '')" if "{O}" in t else "lex"
        some.append(f"SELECT {text}' AS surface FROM {of}")
    return " UNION ".join(some)


_EXT = "ext(s, t, style, trig, o) AS (VALUES " + ", ".join(f"('{s}', '{t}', '{y}', ['{"', '".join(g)}'], {chains.ORDER.index(t)})" for s, t, y, g in chains.EXTENSIONS) + ")"
_STEP = "list_contains(trig, regexp_extract({b}, '([aeiou])[^aeiou]*$', 1))"
_DERIVED = f"""{_EXT}, e1 AS (SELECT stem, regexp_replace(stem, 'a$', '') || s AS b, s AS surfaces, t AS types, o, 1 AS n, style IN ('dz', 'ts', 'short') AS gated FROM lex, ext WHERE length(stem) > 1 AND {_STEP.format(b="regexp_replace(stem, 'a$', '')")}),
    e2 AS (SELECT stem, b || s AS b, surfaces || ',' || s AS surfaces, types || ',' || t AS types, ext.o, 2 AS n, gated OR style IN ('dz', 'ts', 'short') AS gated FROM e1, ext WHERE ext.o > e1.o AND {_STEP.format(b="b")}),
    e3 AS (SELECT stem, b || s AS b, surfaces || ',' || s AS surfaces, types || ',' || t AS types, ext.o, 3 AS n, gated OR style IN ('dz', 'ts', 'short') AS gated FROM e2, ext WHERE ext.o > e2.o AND {_STEP.format(b="b")}),
    made AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3), d AS (SELECT stem, b || 'a' AS word, surfaces, types, n, gated FROM made)"""

_listed = lambda rows: ", ".join(f"('{s}', '{f}', {c}, {n})" for n, (s, f, c) in enumerate(rows))
_PERSONS = concords.PERSON_SUBJECTS + tuple((s, f"class {n}", concords.CLASS_CONFIDENCE) for n, s, _ in concords.CLASSES)
_OTHERS = concords.PERSON_OBJECTS + tuple((o, f"class {n}", concords.CLASS_CONFIDENCE) for n, _, o in concords.CLASSES)
#: Concords with their features, longest first, and all segmentations of the surfaces (table s) that reach an entry.
_CUT = f"""{_DERIVED},
    su AS (SELECT s, f, c, row_number() OVER (ORDER BY -length(s), n) AS so FROM (VALUES {_listed(_PERSONS)}) t(s, f, c, n)),
    ob AS (SELECT s AS o, f AS fo, c AS co, row_number() OVER (ORDER BY -length(s), n) AS oo FROM (VALUES {_listed(_OTHERS)}) t(s, f, c, n) UNION ALL SELECT NULL, NULL, 1, 0),
    pre AS (
      SELECT 'infinitive' AS lane, 'ku' || sa || coalesce(o, z) AS prefix, CASE sa WHEN '' THEN 'positive' ELSE 'negative' END AS polarity, NULL AS number, NULL AS s, NULL AS f, o, fo, z <> '' AS reflexive, least(0.82, co) AS c, 0 AS so, CASE sa WHEN '' THEN 0 ELSE 1 END AS big, oo * 2 + CASE z WHEN '' THEN 0 ELSE 1 END AS oo, '' AS kind
        FROM ob, (VALUES (''), ('sa')) a(sa), (VALUES (''), ('zvi')) r(z) WHERE z = '' OR o IS NULL
      UNION ALL SELECT 'positive', s || 'no' || coalesce(o, ''), 'positive', NULL, s, f, o, fo, false, least(c, co), so, 0, oo, '' FROM su, ob
      UNION ALL SELECT 'negative', 'ha' || CASE WHEN f IN ('class 1', 'class 1a') THEN 'a' ELSE s END || coalesce(o, ''), 'negative', NULL, CASE WHEN f IN ('class 1', 'class 1a') THEN 'a' ELSE s END, f, o, fo, false, least(c, co), so, 0, oo, '' FROM su, ob
      UNION ALL SELECT 'imperative', i, 'positive', 'singular', NULL, NULL, NULL, NULL, false, 0.82, 0, 0, length(i), i || 'bare' FROM (VALUES (''), ('i')) t(i)
      UNION ALL SELECT 'imperative', i, 'positive', 'plural', NULL, NULL, NULL, NULL, false, 0.82, 0, length(x), length(i), i || x FROM (VALUES (''), ('i')) t(i), (VALUES ('i'), ('nyi')) u(x)
      UNION ALL SELECT 'imperative', o, 'positive', 'singular', NULL, NULL, o, fo, false, least(0.82, co), 0, 5, oo, 'told' FROM ob WHERE o IS NOT NULL
      UNION ALL SELECT 'imperative', n || coalesce(o, ''), 'negative', CASE n WHEN 'usa' THEN 'singular' ELSE 'plural' END, NULL, NULL, o, fo, false, least(0.82, co), 0, 10 - length(n) + 10, oo, 'barred' FROM ob, (VALUES ('usa'), ('musa')) t(n)),
    cut AS (SELECT surface, pre.*, substr(surface, n + 1) AS rest FROM (SELECT surface, unnest(range(0, 12)) AS n FROM s), pre WHERE n = length(prefix) AND left(surface, n) = prefix),
    opt AS (
      SELECT *, rest AS stem, rest AS lookup, 0 AS t FROM cut WHERE lane IN ('infinitive', 'positive') AND rest <> ''
      UNION ALL SELECT *, rest, left(rest, length(rest) - 1) || 'a', 0 FROM cut WHERE lane = 'negative' AND right(rest, 1) IN ('i', 'e')
      UNION ALL SELECT *, rest, rest, 1 FROM cut WHERE lane = 'negative' AND right(rest, 1) IN ('i', 'e')
      UNION ALL SELECT *, rest, rest, 0 FROM cut WHERE kind = 'bare' AND regexp_matches(regexp_replace(rest, 'a$', ''), '[aeiou]')
      UNION ALL SELECT *, rest, rest, 0 FROM cut WHERE kind = 'ibare' AND rest LIKE '%a' AND NOT regexp_matches(left(rest, length(rest) - 1), '[aeiou]')
      UNION ALL SELECT *, regexp_replace(rest, 'n?y?i$', ''), regexp_replace(rest, 'n?y?i$', ''), 0 FROM cut WHERE (kind IN ('i', 'ii') AND rest LIKE '%ai' OR kind IN ('nyi', 'inyi') AND rest LIKE '%anyi')
        AND regexp_matches(regexp_replace(rest, 'a(ny)?i$', ''), '[aeiou]') = (kind IN ('i', 'nyi'))
      UNION ALL SELECT *, rest, left(rest, length(rest) - 1) || 'a', 0 FROM cut WHERE kind IN ('told', 'barred') AND rest LIKE '%e'
      UNION ALL SELECT *, rest, rest, 1 FROM cut WHERE kind = 'told' AND rest LIKE '%e' OR kind = 'barred' AND (rest LIKE '%e' OR rest LIKE '%a')),
    res AS (SELECT *, row_number() OVER (PARTITION BY lookup ORDER BY n, ext, entry) AS place FROM (
      SELECT headword AS lookup, headword, entry, '' AS ext, 0 AS n FROM entries
      UNION ALL SELECT b || v, stem, entry, surfaces, n FROM made JOIN entries ON headword = stem, (VALUES ('a'), ('e')) t(v) WHERE NOT gated)),
    hit AS (SELECT opt.*, headword, entry, ext, place FROM opt JOIN res USING (lookup) WHERE place <= 8)"""
#: The same with every entry of a stem.
_CUT_ALL = _CUT.removesuffix(" WHERE place <= 8)") + ")"
#: Whether a segmentation is allowed.
_ALLOWED = """(o IS NULL OR NOT (o LIKE '%a' AND stem LIKE 'a%'))
    AND NOT (lane = 'negative' AND (headword = 'na' OR o IS NULL AND s LIKE '%a' AND stem LIKE 'a%'))
    AND NOT (lane IN ('infinitive', 'imperative') AND polarity = 'negative' AND (coalesce(o LIKE 'a%', false) OR o IS NULL AND NOT reflexive AND stem LIKE 'a%'))
    AND NOT (lane = 'imperative' AND (headword = 'na' OR headword NOT LIKE '%a' OR polarity = 'negative' AND number = 'plural' AND o IS NOT NULL))"""


def _readings_sql(surfaces: str) -> str:
    """SQL of the readings of the surfaces that a query gives, within the bounds."""
    key = "surface, lane, so, entry, stem, ext, polarity, number, o, fo, reflexive"
    return f"""WITH {_LEXICON}, {_SC}, {_OC}, s AS ({surfaces}), {_CUT},
    ok AS (SELECT * FROM hit WHERE {_ALLOWED}),
    once AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY big, oo, t, place) = 1),
    step AS (SELECT *, dense_rank() OVER (PARTITION BY surface, lane, so ORDER BY big, oo, t) AS st, row_number() OVER (PARTITION BY surface, lane, so ORDER BY big, oo, t, place) AS no FROM once),
    few AS (SELECT *, count(*) OVER (PARTITION BY surface, lane, so ORDER BY st RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM step),
    n AS (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY c DESC, CASE lane WHEN 'infinitive' THEN 0 WHEN 'imperative' THEN 1 WHEN 'positive' THEN 2 ELSE 3 END, so, big, oo, t, place) AS rank
      FROM few WHERE CASE WHEN lane IN ('positive', 'negative') THEN before < 12 ELSE no <= 12 END)
    SELECT surface, rank::INTEGER AS rank, lane, polarity, number, s AS subject, f AS subject_features, o AS object, fo AS object_features, reflexive, stem, headword, entry, ext AS extensions, c::DOUBLE AS confidence FROM n WHERE rank <= 25"""


def _all_readings_sql(surfaces: str) -> str:
    """SQL of all readings of the surfaces that a query gives."""
    return f"""WITH {_LEXICON}, {_SC}, {_OC}, s AS ({surfaces}), {_CUT_ALL},
    ok AS (SELECT * FROM hit WHERE {_ALLOWED}),
    once AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY surface, lane, so, entry, stem, ext, polarity, number, o, fo, reflexive ORDER BY big, oo, t, place) = 1)
    SELECT surface, row_number() OVER (PARTITION BY surface ORDER BY c DESC, CASE lane WHEN 'infinitive' THEN 0 WHEN 'imperative' THEN 1 WHEN 'positive' THEN 2 ELSE 3 END, so, big, oo, t, place)::INTEGER AS rank,
      lane, polarity, number, s AS subject, f AS subject_features, o AS object, fo AS object_features, reflexive, stem, headword, entry, ext AS extensions, c::DOUBLE AS confidence FROM once"""


def _read(surfaces: DataFrame, lex: DataFrame, bounded: bool = True) -> DataFrame:
    return lattice.readings(surfaces, lex, bounded=bounded).withColumn("extensions", F.array_join("extensions", ","))


def _lane(spark: SparkSession, sf_dir: str, lane: str, bounded: bool = True) -> DataFrame:
    lex = entries(spelled(spark, sf_dir))
    return _read(_made(lex.select(F.col("headword").alias("stem")).distinct(), (lane,)), lex, bounded)


@query("jn16_concord_prefix", f"WITH {_LEXICON}, {_SC} SELECT stem AS word, sc, CAST(row_number() OVER (PARTITION BY stem ORDER BY -length(sc)) AS INTEGER) AS place FROM lex JOIN sc ON starts_with(stem, sc)")
def jn16_concord_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and the concords that they begin with, longest first: the first letters are joined, so no pair is tried."""
    w = lexicon(spark, sf_dir).withColumnRenamed("stem", "word")
    sizes = sorted({len(s) for s in SUBJECTS})
    w = w.withColumn("sc", F.explode(F.array_distinct(F.array(*[F.left("word", F.lit(n)) for n in sizes]))))
    c = F.broadcast(spark.createDataFrame([(s,) for s in SUBJECTS], "sc string"))  # constants
    return w.join(c, "sc").select("word", "sc", F.row_number().over(Window.partitionBy("word").orderBy(-F.length("sc"))).alias("place"))


@query("jn17_stem_lookup", f"WITH {_LEXICON}, {_SC} SELECT a.stem AS word, sc, b.stem FROM lex a JOIN sc ON starts_with(a.stem, sc) JOIN lex b ON a.stem = sc || b.stem")
def jn17_stem_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = lexicon(spark, sf_dir)
    found = F.filter(F.array(*map(F.lit, SUBJECTS)), lambda p: F.startswith(F.col("word"), p))
    w = lex.select(F.col("stem").alias("word")).withColumn("sc", F.explode(found)).withColumn("stem", F.expr("substring(word, length(sc) + 1)"))
    return w.join(lex, "stem").select("word", "sc", "stem")


@query(
    "mo02_concords",
    f"""WITH {_LEXICON}, {_SC}, {_OC}, s AS (SELECT '' AS surface), {_CUT.split("pre AS (")[0].rstrip().rstrip(",")}
    SELECT s AS subject, f AS subject_features, o AS object, fo AS object_features, least(c, co)::DOUBLE AS confidence, count(*) AS forms
    FROM lex, su, ob WHERE NOT (coalesce(o, '') LIKE '%a' AND stem LIKE 'a%') GROUP BY ALL""",
)
def mo02_concords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of subject and object, persons and classes, as sure as the less sure of the two, with the stems it may stand before."""
    rows = [
        (s.surface, s.features, o.surface if o else None, o.features if o else None, min(s.confidence, o.confidence if o else 1.0), bool(o and o.surface.endswith("a")))
        for s in concords.subjects() for o in (None, *concords.objects())
    ]
    pairs = spark.createDataFrame(rows, "subject string, subject_features string, object string, object_features string, confidence double, contact boolean")
    n = lexicon(spark, sf_dir).groupBy(F.col("stem").startswith("a").alias("vowel")).agg(F.count("*").alias("forms"))
    n = n.withColumn("contact", F.explode(F.when(F.col("vowel"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    n = n.groupBy("contact").agg(F.sum("forms").alias("forms"))
    return pairs.join(F.broadcast(n), "contact").drop("contact")  # two counts


@query("mo03_class_one", f"WITH {_LEXICON} SELECT stem, 'haa' || regexp_replace(stem, 'a$', 'i') AS negative, 'uno' || stem AS positive FROM lex WHERE stem <> 'na' AND stem NOT LIKE 'a%'")
def mo03_class_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concord of class 1 is u, but a in negatives (and then not before a stem in a)."""
    no = F.lit(False)
    make = lambda neg, sc: verbs.form(F.col("stem"), F.lit("finite"), F.lit(neg), no, no, F.lit(sc), F.lit(None).cast("string"))
    d = lexicon(spark, sf_dir).where("stem <> 'na'").where(~F.col("stem").startswith("a"))
    return d.select("stem", make(True, "a").alias("negative"), make(False, "u").alias("positive"))


@query("mo04_infinitive", _readings_sql(_made_sql(("infinitive",))))
def mo04_infinitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lane(spark, sf_dir, "infinitive")


@query("mo05_positive", _readings_sql(_made_sql(("positive",))))
def mo05_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lane(spark, sf_dir, "positive")


@query("mo06_negative", _readings_sql(_made_sql(("negative",))))
def mo06_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives in -i and in -e; the ending is also looked up as it is."""
    return _lane(spark, sf_dir, "negative")


@query("mo07_imperative", _all_readings_sql(_made_sql(("imperative",))))
def mo07_imperative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands: bare, with i before stems without another vowel, plural in -i and -nyi, with an object, prohibitions in -e and -a;
    every reading of every entry."""
    return _lane(spark, sf_dir, "imperative", bounded=False)


@query("mo01_analyses", _readings_sql(f"{_made_sql(tuple(FORMS))} UNION SELECT lower(w) FROM words"))
def mo01_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings of each surface over the lanes, the surest first, 25 at most: forms of all stems, and all words of the documents."""
    words = spelled(spark, sf_dir)
    lex = entries(words)
    made = _made(lex.select(F.col("headword").alias("stem")).distinct(), tuple(FORMS))
    return _read(made.union(words.select(F.lower("word"))).distinct(), lex)


@query("mo13_dedupe", f"""WITH {_LEXICON}, {_SC}, {_OC}, s AS ({_made_sql(("negative", "imperative"))}), {_CUT_ALL}
    SELECT lane, polarity, f AS subject_features, count(*) AS segmentations, count(DISTINCT (surface, entry, stem, ext, number, coalesce(o, ''), coalesce(fo, ''))) AS readings FROM hit WHERE {_ALLOWED} GROUP BY ALL""")
def mo13_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentations to every entry, and readings that differ in entry, stem, extensions, polarity, number or object."""
    lex = entries(spelled(spark, sf_dir))
    made = _made(lex.select(F.col("headword").alias("stem")).distinct(), ("negative", "imperative"))
    d = lattice.judged(made, lex, bounded=False).where("refusal IS NULL")
    d = d.groupBy("surface", "lane", "polarity", "subject_features", "entry", "stem", "extensions", "number", "object", "object_features").count()
    d = d.groupBy("lane", "polarity", "subject_features").agg(F.sum("count").alias("segmentations"), F.count("*").alias("readings"))
    return d.withColumn("lane", F.element_at(F.array(*map(F.lit, lattice.LANES)), F.col("lane") + 1))


@query("mo09_decompose", f"WITH {_LEXICON}, {_DERIVED}, w AS (SELECT DISTINCT word FROM d WHERE n = 1 UNION SELECT stem FROM lex UNION SELECT word FROM d WHERE types = 'causative,applicative,passive') SELECT word, stem, surfaces, types FROM d JOIN w USING (word)")
def mo09_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems taken apart into a base of the lexicon and up to three extensions; the SQL puts them on instead."""
    lex = lexicon(spark, sf_dir)
    ext = {e[0]: e for e in chains.EXTENSIONS}
    forms = [(s, list(g)) for s, _, t, g, _ in chains.chains() if s in ext and "," not in t or t == "causative,applicative,passive"]
    f = spark.createDataFrame(forms, "s string, g array<string>")
    base = F.regexp_replace("stem", "a$", "")
    made = lex.where(F.length("stem") > 1).join(F.broadcast(f), F.array_contains("g", verbs.last_vowel(base)))
    words = made.select(F.concat(base, "s", F.lit("a")).alias("word")).union(lex.select("stem")).distinct()
    return decomposed(words, lex).select("word", "stem", "surfaces", "types")


def decomposed(words: DataFrame, lex: DataFrame) -> DataFrame:
    """Words (column word) cut into a stem of the lexicon and a legal chain of extensions, gated ones marked."""
    types = {c[1]: c[2] for c in chains.chains()}
    named = words.sparkSession.createDataFrame(list(types.items()), "surfaces string, types string")
    d = None
    for gated in (False, True):
        part = lattice.suffixed(words, "word", gated).withColumn("gated", F.lit(gated))
        d = part if d is None else d.union(part)
    d = d.withColumn("surfaces", F.array_join("extensions", ",")).join(F.broadcast(named), "surfaces")  # constants
    return d.withColumnRenamed("base", "stem").join(lex, "stem").select("word", "stem", "surfaces", "types", "gated")


@query("mo08_resolution", f"""WITH {_LEXICON}, {_DERIVED}, r AS (SELECT stem AS word, stem, '' AS surfaces, 0 AS n FROM lex UNION ALL SELECT word, stem, surfaces, n FROM d WHERE word IN (SELECT stem FROM lex) AND NOT gated),
    p AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n, surfaces, stem) AS place FROM r) SELECT word, stem, surfaces, CAST(place AS INTEGER) AS place FROM p WHERE place <= 8""")
def mo08_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stem may be: itself first, then by fewer extensions; gated ones dropped, eight at most."""
    lex = lexicon(spark, sf_dir)
    d = lattice.resolved(lex.withColumnRenamed("stem", "lookup"), lex.select(F.col("stem").alias("headword"), F.col("stem").alias("entry")))
    w = Window.partitionBy("lookup").orderBy(F.size("extensions"), "extensions", "headword")
    d = d.withColumn("place", F.row_number().over(w)).where("place <= 8")
    return d.select(F.col("lookup").alias("word"), F.col("headword").alias("stem"), F.array_join("extensions", ",").alias("surfaces"), "place")


@query("mo11_gate", f"WITH {_LEXICON}, {_DERIVED} SELECT gated, n, count(*) AS forms FROM d GROUP BY 1, 2")
def mo11_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms by number of extensions, and whether evidence for them is wanting; each base meets the chains of its vowel."""
    lex = lexicon(spark, sf_dir).where("length(stem) > 1")
    rows = [(t, len(c[1].split(",")), c[4]) for c in chains.chains() for t in c[3]]
    counts = spark.createDataFrame(rows, "vowel string, n int, gated boolean").groupBy("vowel", "n", "gated").agg(F.count("*").alias("c"))
    bases = lex.groupBy(verbs.last_vowel(F.regexp_replace("stem", "a$", "")).alias("vowel")).agg(F.count("*").alias("b"))
    return bases.join(F.broadcast(counts), "vowel").groupBy("gated", "n").agg(F.sum(F.col("b") * F.col("c")).alias("forms"))


@query("mo12_boundaries", f"WITH {_LEXICON}, {_OC} SELECT CASE WHEN oc LIKE 'a%' THEN 'sa_before_a_initial_object' WHEN oc LIKE '%a' AND stem LIKE 'a%' THEN 'object_before_a_initial_stem' WHEN oc = '' AND stem LIKE 'a%' THEN 'sa_before_a_initial_stem' END AS refusal, count(*) AS forms FROM lex, oc GROUP BY 1")
def mo12_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative infinitives by what forbids them: contacts of two a."""
    d = combined(lexicon(spark, sf_dir), oc=(*OBJECTS, ""))
    no, o = F.lit(False), F.when(F.col("oc") != "", F.col("oc"))
    refusal = verbs.refused(F.col("stem"), F.col("stem"), F.lit("infinitive"), F.lit(True), no, no, F.lit("ndi"), o)
    return d.groupBy(refusal.alias("refusal")).agg(F.count("*").alias("forms"))


_LIKE = "|".join(lattice.EXTENSION_LIKE)
_A = "stem LIKE 'a%'"


@query(
    "mo14_diagnostics",
    f"""WITH {_LEXICON}, {_SC}, {_OC}, s AS ({_made_sql(tuple(FORMS))} UNION SELECT lower(w) FROM words), {_CUT},
    led AS (SELECT *, 'a' || rest AS st2, CASE WHEN lane = 'negative' THEN 'a' || left(rest, length(rest) - 1) || 'a' ELSE 'a' || rest END AS l2 FROM cut
      WHERE lane IN ('positive', 'negative') AND CASE WHEN o IS NULL THEN lane = 'negative' AND s LIKE '%a' ELSE o LIKE '%a' END AND (lane = 'positive' OR right(rest, 1) IN ('i', 'e'))),
    code AS (
      SELECT surface, CASE
        WHEN lane = 'imperative' AND headword = 'na' THEN NULL
        WHEN lane = 'imperative' AND headword NOT LIKE '%a' THEN 'excluded_divergent_stem_imperative:' || headword
        WHEN lane = 'imperative' AND polarity = 'negative' AND number = 'plural' AND o IS NOT NULL THEN 'deferred_imperative_plural_object:plural_with_object_concord'
        WHEN lane IN ('infinitive', 'imperative') AND polarity = 'negative' AND o LIKE 'a%' THEN 'deferred_' || lane || '_boundary:sa_before_a_initial_object'
        WHEN lane IN ('infinitive', 'imperative') AND polarity = 'negative' AND o IS NULL AND NOT reflexive AND {_A} THEN 'deferred_' || lane || '_boundary:sa_before_a_initial_stem'
        WHEN o LIKE '%a' AND {_A} THEN 'deferred_' || CASE WHEN lane IN ('positive', 'negative') THEN 'finite' ELSE lane END || '_boundary:object_before_a_initial_stem'
        WHEN lane = 'negative' AND o IS NULL AND s LIKE '%a' AND {_A} THEN 'deferred_finite_boundary:subject_before_a_initial_stem'
        WHEN lane = 'negative' AND headword = 'na' THEN 'excluded_defective_pro_verb_stem:na' END AS code, {_ALLOWED} AS ok FROM hit
      UNION SELECT surface, 'deferred_finite_boundary:' || CASE WHEN o IS NULL THEN 'subject' ELSE 'object' END || '_before_a_initial_stem', false
        FROM (SELECT surface, o, l2 FROM led UNION ALL SELECT surface, o, st2 FROM led WHERE lane = 'negative') e JOIN res ON lookup = l2 WHERE res.place <= 8),
    un AS (SELECT surface FROM s WHERE surface NOT IN (SELECT surface FROM code WHERE ok)),
    suf AS (SELECT surface, unnest(range(1, length(surface) - 1)) AS k FROM un WHERE regexp_matches(surface, '[ae]$')),
    x1 AS (SELECT DISTINCT surface, b, o, gated FROM (SELECT surface, left(surface, length(surface) - 1 - length(ext.s)) AS b, ext.o, style IN ('dz', 'ts', 'short') AS gated, trig FROM un, ext
      WHERE regexp_matches(surface, '[ae]$') AND length(surface) - 1 > length(ext.s) AND left(surface, length(surface) - 1) LIKE '%' || ext.s) WHERE {_STEP.format(b="b")}),
    x2 AS (SELECT DISTINCT surface, left(b, length(b) - length(ext.s)) AS b, ext.o, gated OR style IN ('dz', 'ts', 'short') AS gated FROM x1, ext WHERE ext.o < x1.o AND length(b) > length(ext.s) AND b LIKE '%' || ext.s
      AND {_STEP.format(b="left(b, length(b) - length(ext.s))")}),
    x3 AS (SELECT DISTINCT surface, left(b, length(b) - length(ext.s)) AS b, ext.o, gated OR style IN ('dz', 'ts', 'short') AS gated FROM x2, ext WHERE ext.o < x2.o AND length(b) > length(ext.s) AND b LIKE '%' || ext.s
      AND {_STEP.format(b="left(b, length(b) - length(ext.s))")}),
    found AS (SELECT surface, code FROM code WHERE code IS NOT NULL AND surface IN (SELECT surface FROM un)
      UNION SELECT surface, 'ku_infinitive_unmatched_stem' FROM un WHERE surface LIKE 'ku%' AND length(surface) > 2 AND surface NOT IN (SELECT surface FROM code WHERE regexp_matches(code, '^deferred_[a-z]+_boundary'))
      UNION SELECT surface, 'unverified_extension_derivation' FROM (SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3) WHERE gated
      UNION SELECT surface, 'passive_or_extension_like' FROM un WHERE length(surface) >= 5 AND regexp_matches(surface, '({_LIKE})$'))
    SELECT surface, string_split(code, ':')[1] AS code, string_split(code, ':')[2] AS detail FROM found""",
)
def mo14_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every surface without a reading, what it may be: nine codes."""
    words = spelled(spark, sf_dir)
    lex = entries(words)
    made = _made(lex.select(F.col("headword").alias("stem")).distinct(), tuple(FORMS))
    surfaces = jsonl.kept(made.union(words.select(F.lower("word"))).distinct(), "surfaces")
    return lattice.diagnoses(surfaces, lex)


_REQ = "SELECT p_partkey AS k, [['causative'], ['passive', 'causative'], ['causative', 'causative'], ['causative', 'applicative', 'neuter', 'passive'], ['magic'], ['applicative', 'passive']][CAST(p_partkey % 6 AS INTEGER) + 1] AS x, p_partkey % 5 = 0 AS dz FROM part"


@query("mo18_extension_requests", f"SELECT k, CASE WHEN list_contains(x, 'magic') THEN 'UNKNOWN_EXTENSION' WHEN len(x) > 3 THEN 'TOO_MANY_EXTENSIONS' WHEN len(list_distinct(x)) < len(x) THEN 'REPEATED_EXTENSION' WHEN x = ['passive', 'causative'] THEN 'EXTENSION_ORDER' WHEN dz AND list_contains(x, 'causative') THEN 'EXTENSION_UNVERIFIED' END AS code FROM ({_REQ})")
def mo18_extension_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked-for extensions checked: type, number, repeats, order, and styles that lack evidence."""
    options = (("causative",), ("passive", "causative"), ("causative", "causative"), ("causative", "applicative", "neuter", "passive"), ("magic",), ("applicative", "passive"))
    x = F.element_at(F.array(*[F.array(*map(F.lit, o)) for o in options]), (F.col("p_partkey") % 6 + 1).cast("int"))
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), x.alias("x"), (F.col("p_partkey") % 5 == 0).alias("dz"))
    known = F.array(*map(F.lit, chains.ORDER))
    place = F.transform("x", lambda t: F.array_position(known, t))
    code = (
        F.when(F.exists(place, lambda p: p == 0), "UNKNOWN_EXTENSION").when(F.size("x") > chains.MOST, "TOO_MANY_EXTENSIONS")
        .when(F.size(F.array_distinct("x")) < F.size("x"), "REPEATED_EXTENSION").when(F.array_sort(place) != place, "EXTENSION_ORDER")
        .when(F.col("dz") & F.array_contains("x", "causative"), "EXTENSION_UNVERIFIED")
    )
    return d.select("k", code.alias("code"))


#: The version of the rules that is carried out.
VERSION = "v6"


@query("mo20_version_gate", r"SELECT source, version, version = 'v6' AS allowed, CASE WHEN version <> 'v6' THEN 'declares ' || version || ', implemented is v6' END AS fault, count(*) AS documents FROM (SELECT source, 'v' || (regexp_extract(source, '(\d+)$', 1)::INTEGER % 4 + 4) AS version FROM documents) GROUP BY ALL")
def mo20_version_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each release (a source, whose number says which rules it declares) against the version that is carried out."""
    declared = F.concat(F.lit("v"), (F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 4 + 4).cast("string"))
    d = table(spark, sf_dir, "documents").groupBy("source", declared.alias("version")).agg(F.count("*").alias("documents"))
    fault = F.when(F.col("version") != VERSION, F.concat(F.lit("declares "), "version", F.lit(f", implemented is {VERSION}")))
    return d.select("source", "version", (F.col("version") == VERSION).alias("allowed"), fault.alias("fault"), "documents")


@query("mo21_rules", f"WITH {_LEXICON}, {_DERIVED} SELECT types, count(*) AS forms, 'rule.' || replace(types, ',', ' rule.') AS rules FROM d GROUP BY 1")
def mo21_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that each set of extensions goes by, with the forms made by it."""
    lex = lexicon(spark, sf_dir).where("length(stem) > 1")
    rows = [(t, c[2]) for c in chains.chains() for t in c[3]]
    c = spark.createDataFrame(rows, "vowel string, types string").groupBy("vowel", "types").agg(F.count("*").alias("c"))
    bases = lex.groupBy(verbs.last_vowel(F.regexp_replace("stem", "a$", "")).alias("vowel")).agg(F.count("*").alias("b"))
    d = bases.join(F.broadcast(c), "vowel").groupBy("types").agg(F.sum(F.col("b") * F.col("c")).alias("forms"))
    rules = F.array_join(F.transform(F.split("types", ","), lambda t: F.concat(F.lit("rule."), t)), " ")
    return d.withColumn("rules", rules)
