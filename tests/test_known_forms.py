"""Known answers: plurals, verb forms, tone brackets, and case folding over all letters."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quern.functions import labels, plurals, verbs
from quern.functions import orthography as ort

# headword, class, recorded plural; surface, basis, kind and code
NOUNS = [
    ("banga", "5", "map-", "mapanga", "allomorph_prefix", "standard", None),
    ("gwai", "5", "makw-", "makwai", "allomorph_prefix", "standard", None),
    ("biku", "5", "mab- (M)", "mabiku", "literal_prefix", "standard", None),
    ("dhibha", "5", "madhi-", "madhibha", "literal_prefix", "standard", None),
    ("gomo", "5", "mak- KZ", "makomo", "allomorph_prefix", "standard", None),
    ("mukadzi", "1", "vak-", "vakadzi", "literal_prefix", "standard", None),
    ("chigaro", "7", "zvig-", "zvigaro", "literal_prefix", "standard", None),
    ("sekuru", "1a", "vana-", "vanasekuru", "prefix_plus_stem", "honorific", None),
    ("ziso", "5", "meso", "meso", "recorded_form", "standard", None),
    ("ruvi", "11", "maruvi (Z)", "maruvi", "recorded_form", "standard", None),
    ("hamburo", "9", "mhamburo 10 k", "mhamburo", "recorded_form", "standard", None),
    ("bhamadza", "5", "map-", None, None, None, "PLURAL_ALLOMORPH_UNVERIFIED"),
    ("banga", "5", "zvi-", None, None, None, "PLURAL_ALLOMORPH_UNVERIFIED"),
    ("banga", "1", "va-", None, None, None, "PLURAL_ALLOMORPH_UNVERIFIED"),
    ("mu", "1", "va-", None, None, None, "PLURAL_EMPTY_STEM"),
    ("mafuta", "6", "mab-", None, None, None, "PLURAL_CLASS_UNVERIFIED"),
    ("imba", "9", "maNg-", None, None, None, "PLURAL_NASAL_PLACEHOLDER"),
    ("jahwi", "5", "of jahwi q", None, None, None, "PLURAL_NOT_A_PREFIX"),
    ("moyo", "3", "", None, None, None, "NO_RECORDED_PLURAL"),
    ("moyo", "3", None, None, None, None, "NO_RECORDED_PLURAL"),
]
# stem, mode, negative, plural, reflexive, object, extensions; refusal and form
FORMS = [
    ("ziva", "infinitive", False, False, False, None, "", None, "kuziva"),
    ("ziva", "infinitive", True, False, False, None, "", None, "kusaziva"),
    ("ziva", "infinitive", False, False, True, None, "", None, "kuzviziva"),
    ("amba", "infinitive", True, False, False, None, "", "sa_before_a_initial_stem", None),
    ("amba", "infinitive", False, False, False, "va", "", "object_before_a_initial_stem", None),
    ("ti", "infinitive", False, False, False, None, "", "divergent_stem_without_terminal_a", None),
    ("dya", "imperative", False, False, False, None, "", None, "idya"),
    ("dya", "imperative", False, True, False, None, "", None, "idyai"),
    ("dya", "imperative", True, False, False, None, "", None, "usadye"),
    ("dya", "imperative", False, False, False, "a", "", None, "adye"),
    ("isa", "imperative", False, False, False, "ri", "", None, "riise"),
    ("ziva", "imperative", False, True, False, "va", "", "plural_with_object_concord", None),
    ("ziva", "imperative", True, True, False, "va", "", None, "musavazive"),
    ("na", "imperative", False, False, False, None, "", "defective_pro_verb_stem", None),
    ("ziva", "infinitive", False, False, False, None, "causative", None, "kuzivisa"),
    ("sona", "infinitive", False, False, False, None, "applicative", None, "kusonera"),
    ("sona", "infinitive", False, False, False, None, "applicative,passive", None, "kusonerwa"),
    ("dya", "infinitive", False, False, False, None, "passive", None, "kudyiwa"),
    ("sunga", "infinitive", False, False, False, None, "reversive", None, "kusungunura"),
    ("monya", "infinitive", False, False, False, None, "reversive", None, "kumonyonora"),
    ("tora", "infinitive", False, False, False, None, "repetitive", None, "kutororora"),
    ("tema", "infinitive", False, False, False, None, "causative,reciprocal", None, "kutemesana"),
    ("dya", "infinitive", False, False, False, None, "reversive", "extension_without_vowel", None),
]
BRACKETS = [
    (1, "[H M; LHLH Z]", "KMZ", [("H", ["M"]), ("LHLH", ["Z"])]), (2, "[LL]", "KMZ", [("LL", ["K", "M", "Z"])]), (3, "[HHHL]", "KKoZ", [("HHHL", ["K", "Ko", "Z"])]),
    (4, "[L Ko]", "M", [("L", ["Ko"])]), (5, "[]", "K", []), (6, "[H X; L K]", "Z", [("H", []), ("L", ["K"])]), (7, "[LH]", "of it", [("LH", [])]),
]


def test_plurals(spark):
    rows = [(i, *n[:3]) for i, n in enumerate(NOUNS)]
    d = spark.createDataFrame(rows, "i int, headword string, noun_class string, recorded string")
    got = {r.i: tuple(r.d) for r in d.select("i", plurals.derived(F.col("headword"), F.col("noun_class"), F.col("recorded")).alias("d")).collect()}
    assert got == {i: n[3:] for i, n in enumerate(NOUNS)}


def test_verb_forms(spark):
    rows = [(i, *f[:7]) for i, f in enumerate(FORMS)]
    d = spark.createDataFrame(rows, "i int, stem string, mode string, negative boolean, plural boolean, reflexive boolean, object string, extensions string")
    made = verbs.extended(F.col("stem"), F.filter(F.split("extensions", ","), lambda e: e != ""))
    args = (F.col("mode"), F.col("negative"), F.col("plural"), F.col("reflexive"), F.lit(None).cast("string"), F.col("object"))
    refusal = verbs.refused(F.col("stem"), made, *args)
    d = d.select("i", refusal.alias("refusal"), F.when(refusal.isNull(), verbs.form(made, *args)).alias("form"))
    assert {r.i: (r.refusal, r.form) for r in d.collect()} == {i: f[7:] for i, f in enumerate(FORMS)}


def test_tone_brackets(spark):
    d = spark.createDataFrame([b[:3] for b in BRACKETS], "i int, bracket string, entry string")
    got = {r.i: [(t.pattern, t.dialects) for t in r.t] for r in d.select("i", labels.tones(F.col("bracket"), F.col("entry")).alias("t")).collect()}
    assert got == {b[0]: b[3] for b in BRACKETS}


def test_pattern_bounds(spark):
    want = {"s?a*": (3, None), "chi??": (4, 4), "*": (0, None), "nzvimbo": (4, 4), "": (0, 0)}
    d = spark.createDataFrame([(p,) for p in want], "p string")
    low, high = ort.pattern_bounds_of(F.col("p"))
    assert {r.p: (r.low, r.high) for r in d.select("p", low.alias("low"), high.alias("high")).collect()} == want


def test_case_folding_of_all_letters(spark):
    letters = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    words = [c for c in letters if c.casefold() != c or c.lower() != c] + ["ΑΣ", "ΣΑΣ ΑΣ", "Straße GROẞ ŉ\U0001f600", "İI", "", "Ǆ\u0345", "ΌΔΟΣ", "ﬃ K"]
    words += ["".join(letters[i : i + 4096]) for i in range(0, len(letters), 4096)]
    d = spark.createDataFrame(list(enumerate(words)), "i int, x string")
    wrong = [words[r.i] for r in d.select("i", ort.casefold(F.col("x")).alias("f")).collect() if r.f != words[r.i].casefold()]
    assert not wrong


def test_public_ids_take_few_steps(spark):
    """The letters of a uuid against Python's, from an expression that is not written out anew for each letter."""
    import base64
    import uuid

    from quern.functions import spelling

    some = [uuid.UUID(int=0), uuid.UUID(int=(1 << 128) - 1), uuid.UUID(int=1), *(uuid.uuid5(uuid.NAMESPACE_DNS, str(i)) for i in range(200))]
    d = spark.createDataFrame([(str(u),) for u in some] + [(str(some[-1]).upper(),)], "u string")
    column = spelling.public_id("lem", F.col("u"))
    got = [r.x for r in d.select(column.alias("x")).collect()]
    want = ["lem_" + base64.b32encode(u.bytes).decode().rstrip("=").lower() for u in [*some, some[-1]]]
    assert got == want
    assert str(column).count("conv(") <= 4


def test_plurals_are_written_out_once():
    """The driver analyses the expression; its parts must not multiply (they took gigabytes)."""
    assert len(str(plurals.derived(F.col("h"), F.col("c"), F.col("r")))) < 100_000


def test_words_are_folded_once_each(spark, tmp_path):
    """Folding the distinct words gives what folding whole texts gives; folding is done after the first distinct."""
    from quern.plans import text_queries

    texts = ["ΑΣ ΣΑΣ Straße\tGROẞ", "İI ŉ\n\nstrasse", "", None, " Sa sa SA ", "ΌΔΟΣ\u00a0x ﬃ K"]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    d = text_queries.distinct_words(spark, str(tmp_path))
    want = {w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").casefold())}
    assert {r.word for r in d.collect()} == want and d.count() == len(want)
    assert {r.word for r in text_queries.distinct_words(spark, str(tmp_path), "s").collect()} == {w for w in want if w.startswith("s")}
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
