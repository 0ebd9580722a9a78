"""Readings of verb forms over a lattice of slots.

What may stand before and after a stem is one table (``slots``): a row for each lane, polarity, subject, object and ending,
with the letters before the stem joined into one prefix.  Rows that are spelled alike are one shape: surfaces meet the shapes
in one broadcast equi-join on their first letters, what is left meets the chains of extensions in another on its last
letters, the bases meet the lexicon in an equi-join, and only what reaches an entry meets the slots of its shape.  The tables hold constants (some thousand rows, whatever the input); a surface has few rows at each step.

A row that the rules forbid is kept with its ``refusal`` until the end, so that a surface without readings can be told why
(``diagnoses``).  Readings are ordered and, unless all are asked for, bounded as the rules say: 8 entries for one stem, 12
readings of infinitives, of commands and (by whole segmentations) of each subject, 25 of a surface.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import chains, concords, spelling, verbs
from quern.sources import jsonl

# Bounds of readings.
ENTRIES, READINGS, ALL_READINGS = 8, 12, 25
# How sure readings of infinitives and commands are without an object.
BARE_CONFIDENCE = 0.82
# Fixed value: stems that keep their final vowel in a paradigm of their own.
PRO_VERBS = ("na",)
# Endings that look like extensions.
EXTENSION_LIKE = (
    "anur", "enur", "inur", "onor", "unur", "urur", "oror", "irirwa", "erwa", "irwa", "iswa", "eswa", "idzwa", "edza", "idza", "itsa",
    "etsa", "idz", "edz", "its", "ets", "ika", "eka", "ana", "zwa", "wa",
)
LANES = ("infinitive", "imperative", "positive", "negative")

SLOTS = (
    "prefix string, ending string, cut int, lead string, swap boolean, vowelless boolean, lane int, polarity string, number string, subject string, "
    "subject_features string, object string, object_features string, reflexive boolean, confidence double, subject_order int, step int, refusal string, before_a string"
)


def _slot(prefix, lane, step, *, ending="", cut=0, lead="", swap=False, vowelless=None, polarity="positive", number=None, subject=None, order=0, obj=None, reflexive=False, refusal=None, before_a=None):
    """One row of the table.  ``ending``: letters the rest ends in; ``cut`` of them are no part of the stem; ``lead`` is put
    before it; ``swap``: it is looked up with a final a; ``before_a``: the refusal if it begins with a."""
    sure = min([c.confidence for c in (subject, obj) if c] + ([] if subject else [BARE_CONFIDENCE]))
    s, o = subject or (None, None), obj or (None, None)
    return prefix, ending, cut, lead, swap, vowelless, LANES.index(lane), polarity, number, s[0], s[1], o[0], o[1], reflexive, sure, order, step, refusal, before_a


def _contact(obj, family: str) -> str | None:
    return f"deferred_{family}_boundary:object_before_a_initial_stem" if obj and obj.surface.endswith("a") else None


def _infinitives(objects: list) -> list[tuple]:
    rows = []
    for n, (polarity, front) in enumerate((("positive", "ku"), ("negative", "kusa"))):
        at, negative = n * 1000, polarity == "negative"
        bare = "deferred_infinitive_boundary:sa_before_a_initial_stem" if negative else None
        rows.append(_slot(front, "infinitive", at, polarity=polarity, before_a=bare))
        rows.append(_slot(front + "zvi", "infinitive", at + 1, polarity=polarity, reflexive=True))
        for k, o in enumerate(objects):
            barred = "deferred_infinitive_boundary:sa_before_a_initial_object" if negative and o.surface.startswith("a") else None
            rows.append(_slot(front + o.surface, "infinitive", at + 2 + k, polarity=polarity, obj=o, refusal=barred, before_a=_contact(o, "infinitive")))
    return rows


def _finites(classes: tuple, objects: list) -> list[tuple]:
    rows = []
    for order, s in enumerate(concords.subjects(classes)):
        for k, o in enumerate([None, *objects]):
            given = {"subject": s, "order": order, "obj": o, "before_a": _contact(o, "finite")}
            front = f"{s.surface}no{o.surface if o else ''}"
            rows.append(_slot(front, "positive", 8 * k, **given))
            if o and o.surface.endswith("a"):
                rows.append(_slot(front, "positive", 8 * k + 1, lead="a", **given))
    for order, s in enumerate(concords.subjects(classes, negative=True)):
        for k, o in enumerate([None, *objects]):
            before = "deferred_finite_boundary:subject_before_a_initial_stem" if not o and s.surface.endswith("a") else _contact(o, "finite")
            given = {"subject": s, "order": order, "obj": o, "polarity": "negative", "before_a": before}
            leads = ("", "a") if (o or s).surface.endswith("a") else ("",)
            for i, lead in enumerate(leads):
                for ending in "ie":
                    for j, swap in enumerate((True, False)):
                        rows.append(_slot(f"ha{s.surface}{o.surface if o else ''}", "negative", 8 * k + 2 * i + j, ending=ending, lead=lead, swap=swap, **given))
    return rows


def _commands(objects: list) -> list[tuple]:
    rows = [
        _slot("", "imperative", 0, number="singular", vowelless=False),
        _slot("i", "imperative", 1, number="singular", ending="a", vowelless=True),
    ]
    for n, suffix in enumerate(("i", "nyi")):
        given = {"number": "plural", "ending": f"a{suffix}", "cut": len(suffix)}
        rows.append(_slot("", "imperative", 2 + 2 * n, vowelless=False, **given))
        rows.append(_slot("i", "imperative", 3 + 2 * n, vowelless=True, **given))
    endings = (("e", True), ("e", False), ("a", False))
    for k, o in enumerate(objects):
        for j, (ending, swap) in enumerate(endings[:2]):
            rows.append(_slot(o.surface, "imperative", 10 + 2 * k + j, number="singular", ending=ending, swap=swap, obj=o, before_a=_contact(o, "imperative")))
    for n, (front, number) in enumerate((("musa", "plural"), ("usa", "singular"))):
        for k, o in enumerate([None, *objects]):
            if o is None:
                refusal, before = None, "deferred_imperative_boundary:sa_before_a_initial_stem"
            elif number == "plural":
                refusal, before = "deferred_imperative_plural_object:plural_with_object_concord", None
            else:
                refusal = "deferred_imperative_boundary:sa_before_a_initial_object" if o.surface.startswith("a") else None
                before = _contact(o, "imperative")
            for j, (ending, swap) in enumerate(endings):
                given = {"number": number, "ending": ending, "swap": swap, "obj": o, "refusal": refusal, "before_a": before}
                rows.append(_slot(front + (o.surface if o else ""), "imperative", 1000 * (n + 1) + 4 * k + j, polarity="negative", **given))
    return rows


def slots(classes: tuple = concords.CLASSES) -> list[tuple]:
    """The table of ``SLOTS``; it grows with the square of the number of noun classes, of which there may be 64."""
    if len(classes) > 64:
        raise ValueError("more than 64 noun classes")
    objects = concords.objects(classes)
    return _infinitives(objects) + _commands(objects) + _finites(classes, objects)


#: Columns of the table that tell which rests of a surface a row takes, and what is looked up.
SHAPE = ("prefix", "ending", "cut", "lead", "swap", "vowelless")


def tables(spark: SparkSession, classes: tuple = concords.CLASSES) -> tuple[DataFrame, DataFrame]:
    """The rows of slots as two tables: shapes, and the slots of each shape (many concords are spelled alike)."""
    names = ["slot", *(f.split()[0] for f in SLOTS.split(", "))]
    rows = [dict(zip(names, (i, *r), strict=True)) for i, r in enumerate(slots(classes))]
    numbers: dict = {}
    for r in rows:
        r["shape"] = numbers.setdefault(tuple(r[c] for c in SHAPE), len(numbers))
    types = {f.split()[0]: f for f in f"slot int, shape int, {SLOTS}".split(", ")}
    rest = [c for c in types if c not in SHAPE]
    shapes = spark.createDataFrame([(*s, n) for s, n in numbers.items()], ", ".join(types[c] for c in (*SHAPE, "shape")))
    return shapes, spark.createDataFrame([tuple(r[c] for c in rest) for r in rows], ", ".join(types[c] for c in rest))


def segments(surfaces: DataFrame, shapes: DataFrame, sizes: list[int]) -> DataFrame:
    """Each surface with every shape that fits it: the stem in it, and the spelling to look up (``lookup``)."""
    fronts = F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length("surface")), lambda n: F.left("surface", n))
    d = surfaces.withColumn("prefix", F.explode(fronts)).join(F.broadcast(shapes), "prefix")  # constants
    d = d.withColumn("rest", F.expr("substring(surface, length(prefix) + 1)")).where("(rest <> '' OR lead <> '') AND endswith(rest, ending)")
    d = d.withColumn("stem", F.expr("concat(lead, left(rest, length(rest) - cut))"))
    d = d.where(F.col("vowelless").isNull() | (F.col("vowelless") == spelling.vowelless(F.col("stem"))))
    return d.select("surface", "shape", "stem", F.expr("CASE WHEN swap THEN concat(left(stem, length(stem) - 1), 'a') ELSE stem END").alias("lookup"))


def chain_table(spark, gated: bool) -> DataFrame:
    rows = [(c[0], c[1].split(","), list(c[3])) for c in chains.chains() if c[4] == gated]
    return spark.createDataFrame(rows, "suffix string, extensions array<string>, triggers array<string>")


def suffixed(df: DataFrame, word: str, gated: bool) -> DataFrame:
    """Words with each chain of extensions that they may end in: adds ``base``, the word without it, and ``extensions``."""
    table = chain_table(df.sparkSession, gated)
    longest = max(len(c[0]) for c in chains.chains())
    body = F.expr(f"left({word}, length({word}) - 1)")
    cuts = F.when(
        F.col(word).rlike("^.{2,}[ae]$"),
        F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(body) - 1)), lambda n: F.right(body, n)),
    )
    d = df.withColumn("suffix", F.explode(cuts)).join(F.broadcast(table), "suffix")  # some hundreds of chains
    d = d.withColumn("base", F.expr(f"left({word}, length({word}) - 1 - length(suffix))"))
    d = d.where(F.array_contains("triggers", verbs.last_vowel(F.col("base"))))
    return d.withColumn("base", F.concat("base", F.lit("a"))).drop("suffix", "triggers")


def resolved(df: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows with each entry that ``lookup`` may be: itself, or a base (headword) with extensions; one join with the lexicon.

    ``lexicon`` has ``headword`` and ``entry``, its name; entries of one headword are homographs.
    """
    own = df.withColumns({"base": F.col("lookup"), "extensions": F.array().cast("array<string>")})
    found = own.unionByName(suffixed(df, "lookup", False))
    return found.join(lexicon.select(F.col("headword").alias("base"), "entry"), "base").withColumnRenamed("base", "headword")


def judged(surfaces: DataFrame, lexicon: DataFrame, classes: tuple = concords.CLASSES, bounded: bool = True) -> DataFrame:
    """All segmentations that reach an entry, with ``refusal`` where a rule forbids one."""
    shapes, rows = tables(surfaces.sparkSession, classes)
    sizes = sorted({len(r[0]) for r in slots(classes)})
    parts = jsonl.kept(segments(surfaces, shapes, sizes), "segments")  # many surfaces share a lookup; each is resolved once
    order = Window.partitionBy("lookup").orderBy(F.size("extensions"), "extensions", "entry")
    found = resolved(parts.select("lookup").distinct(), lexicon).withColumn("place", F.row_number().over(order))
    if bounded:
        found = found.where(F.col("place") <= ENTRIES)
    d = parts.join(found, "lookup").repartition("surface")  # everything after it stays within a surface
    d = d.join(F.broadcast(rows), "shape").drop("shape")  # constants; only what reaches an entry meets its slots
    command = F.col("lane") == LANES.index("imperative")
    pro = F.col("headword").isin(*PRO_VERBS)
    d = d.where(~(command & pro))
    refusal = (
        F.when(command & ~F.col("headword").endswith("a"), F.concat(F.lit("excluded_divergent_stem_imperative:"), "headword"))
        .when(F.col("refusal").isNotNull(), F.col("refusal"))
        .when(F.col("stem").startswith("a") & F.col("before_a").isNotNull(), F.col("before_a"))
        .when((F.col("lane") == LANES.index("negative")) & pro, F.concat(F.lit("excluded_defective_pro_verb_stem:"), "headword"))
    )
    return d.withColumn("refusal", refusal)


def readings(surfaces: DataFrame, lexicon: DataFrame, classes: tuple = concords.CLASSES, bounded: bool = True) -> DataFrame:
    """The readings of each surface, the surest first (``rank`` from 1); all of them if they are not ``bounded``."""
    d = judged(surfaces, lexicon, classes, bounded).where("refusal IS NULL")
    features = ["entry", "stem", "extensions", "polarity", "number", "object", "object_features", "reflexive"]
    order = [F.col("step"), F.col("place")]
    same = Window.partitionBy("surface", "lane", "subject_order", *features).orderBy(*order)
    d = d.withColumn("n", F.row_number().over(same)).where("n = 1")
    if bounded:
        own = Window.partitionBy("surface", "lane", "subject_order")
        finite = F.col("lane") >= LANES.index("positive")
        # of a subject, whole segmentations are taken until there are enough; the other lanes stop at once
        before = F.when(finite, F.count("*").over(own.orderBy("step").rangeBetween(Window.unboundedPreceding, -1)))
        d = d.withColumn("n", F.coalesce(before, F.row_number().over(own.orderBy(*order)) - 1)).where(F.col("n") < READINGS)
    best = Window.partitionBy("surface").orderBy(F.desc("confidence"), "lane", "subject_order", *order)
    d = d.withColumn("rank", F.row_number().over(best))
    if bounded:
        d = d.where(F.col("rank") <= ALL_READINGS)
    lane = F.element_at(F.array(*map(F.lit, LANES)), F.col("lane") + 1)
    kept = ["polarity", "number", "subject", "subject_features", "object", "object_features", "reflexive", "stem", "headword", "entry", "extensions", "confidence"]
    return d.select("surface", "rank", lane.alias("lane"), *kept)


def _ends(x: Column, endings: tuple[str, ...]) -> Column:
    return x.rlike(f"(?:{'|'.join(endings)})$")


def diagnoses(surfaces: DataFrame, lexicon: DataFrame, classes: tuple = concords.CLASSES) -> DataFrame:
    """For surfaces without a reading, each code (with its detail) of what they may be."""
    codes = judged(surfaces, lexicon, classes).groupBy("surface").agg(
        F.max(F.col("refusal").isNull()).alias("read"), F.collect_set("refusal").alias("codes")
    )
    gated = suffixed(surfaces, "surface", True).select("surface").distinct().withColumn("gated", F.lit(True))
    d = surfaces.join(codes, "surface", "left").where("read IS NULL OR NOT read").join(gated, "surface", "left")
    codes = F.coalesce("codes", F.array().cast("array<string>"))
    ku = F.col("surface").startswith("ku") & (F.length("surface") > 2) & ~F.exists(codes, lambda c: c.rlike("^deferred_[a-z]+_boundary"))
    more = F.array(
        F.when(ku, "ku_infinitive_unmatched_stem"),
        F.when(F.col("gated"), "unverified_extension_derivation"),
        F.when((F.length("surface") >= 5) & _ends(F.col("surface"), EXTENSION_LIKE), "passive_or_extension_like"),
    )
    d = d.select("surface", F.explode(F.concat(codes, F.array_compact(more))).alias("code"))
    return d.select("surface", F.substring_index("code", ":", 1).alias("code"), F.when(F.contains("code", F.lit(":")), F.substring_index("code", ":", -1)).alias("detail"))
