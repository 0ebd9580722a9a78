"""Dictionary lines parsed: the lines are composed from table columns, and the SQL states what they were composed of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import entries
from quern.operators import computed, ordered
from quern.plans.base import query, table

# The parts of a line, in words that both engines read; k is the part's key.
PARTS = {
    "k": "p_partkey",
    "hw": "CASE WHEN p_partkey % 6 IN (2, 3) THEN '-' ELSE '' END || replace(p_name, ' ', '')",
    "dag": "CASE WHEN p_partkey % 7 = 0 THEN '†' ELSE '' END",
    "tn": "CASE WHEN p_partkey % 35 = 8 THEN 'XL' ELSE CASE p_partkey % 5 WHEN 0 THEN 'H' WHEN 1 THEN 'LL' WHEN 2 THEN 'HLH' WHEN 3 THEN 'LHLH' ELSE '' END END",
    "dia": "CASE p_partkey % 4 WHEN 0 THEN 'KMZ' WHEN 1 THEN 'Ko' WHEN 2 THEN '' ELSE 'Z' END",
    "wc": "CASE p_partkey % 6 WHEN 0 THEN 'n' WHEN 1 THEN 'n' WHEN 2 THEN 'v' WHEN 3 THEN 'vt' WHEN 4 THEN 'ideo' ELSE 'zz' END",
    "gr": "CASE WHEN p_partkey % 6 = 2 THEN CASE p_partkey % 9 WHEN 2 THEN 't' WHEN 5 THEN 'i' ELSE '' END ELSE '' END",
    "cl": "CASE p_size % 5 WHEN 0 THEN '5' WHEN 1 THEN '1a (M), 5 (Z)' WHEN 2 THEN '7 & 9' WHEN 3 THEN '3/4' ELSE '' END",
    "cls": "CASE p_size % 5 WHEN 0 THEN '5' WHEN 1 THEN '1a,5' WHEN 2 THEN '7,9' WHEN 3 THEN '3,4' ELSE '' END",
    "pl": "CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'map-' WHEN 2 THEN 'vana- (M), mag- (Z)' ELSE 'mab- (M) & map-' END",
    "pls": "CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'map-' WHEN 2 THEN 'vana- (M)|mag- (Z)' ELSE 'mab- (M)|map-' END",
    "ref": "CASE WHEN p_size % 3 = 0 THEN ' cp mota KM.' ELSE '' END",
    "org": "CASE WHEN p_size % 6 = 1 THEN ' < Port mesa.' ELSE '' END",
    "drv": "CASE WHEN p_size % 7 = 2 THEN ' > banga; bangira.' ELSE '' END",
    "ex": "CASE WHEN p_size % 8 = 3 THEN ' Akaenda kumba: he went home.' ELSE '' END",
    "def2": "CASE WHEN p_partkey % 2 = 0 THEN ' 2. M t Seen as ' || lower(p_type) ELSE '' END",
    "def3": "CASE WHEN p_partkey % 4 = 0 THEN ' 3. Said of it' ELSE '' END",
}
LINE = """dag || hw || CASE WHEN tn <> '' THEN ' [' || tn || ']' ELSE '' END || ' ' || CASE WHEN dia <> '' THEN dia || ' ' ELSE '' END || wc || ' '
|| CASE WHEN wc = 'n' AND cl <> '' THEN cl || CASE WHEN pl <> '' THEN ', pl: ' || pl ELSE '' END || ', ' WHEN gr <> '' THEN gr || ' ' ELSE '' END
|| 'Kind of ' || lower(p_type) || '.' || ref || org || drv || ex || def2 || def3"""
_PARTS_SQL = "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in PARTS.items()) + " FROM part"
_LINES = f"WITH l AS (SELECT *, {LINE} AS line FROM ({_PARTS_SQL})) "
_GOOD = "tn <> '' AND wc <> 'zz'"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").withColumns({k: F.expr(v) for k, v in PARTS.items()})
    return d.select("k", F.expr(LINE).alias("line"))


def joined(x, by: str = ","):
    return F.array_join(x, by)


_KIND = "CASE WHEN wc = 'n' THEN 'noun' WHEN wc = 'ideo' THEN 'ideophone' WHEN wc = 'zz' THEN 'unknown' ELSE 'verb_stem' END"


@query(
    "p01_entry",
    _LINES + f"""SELECT k, hw AS headword, replace(hw, '-', '') AS normalized, dag <> '' AS marker, CASE WHEN tn <> '' THEN tn END AS tone, CASE WHEN {_GOOD} THEN {_KIND} ELSE 'unknown' END AS kind,
    concat_ws(',', CASE WHEN tn = '' THEN 'missing_tone_pattern' END, CASE WHEN wc = 'zz' THEN 'missing_part_of_speech' END) AS errors, CASE WHEN {_GOOD} THEN 'fixture_matched' ELSE 'failed' END AS completeness FROM l""",
)
def p01_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = entries.with_header(lines(spark, sf_dir), "line")
    done = F.when(F.size("errors") > 0, "failed").otherwise("fixture_matched")
    return d.select("k", "headword", F.col("normalized_headword").alias("normalized"), "marker", "tone", "kind", joined("errors").alias("errors"), done.alias("completeness"))


_DIA = "CASE dia WHEN 'KMZ' THEN 'K,M,Z' ELSE dia END"


@query(
    "p02_codes",
    _LINES + f"SELECT k, {_DIA} AS dialects, CASE WHEN wc <> 'zz' THEN wc END AS pos, CASE WHEN wc = 'vt' THEN 'vt' ELSE gr END AS grammar FROM l",
)
def p02_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = entries.with_grammar(entries.with_header(lines(spark, sf_dir), "line"))
    return d.select("k", joined("dialects").alias("dialects"), "pos", joined("grammar").alias("grammar"))


@query("p03_classes", _LINES + "SELECT k, cls AS classes FROM l WHERE wc = 'n'")
def p03_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class of a noun, whatever parts them, without their dialects."""
    d = computed.kept(entries.with_noun(entries.with_header(lines(spark, sf_dir), "line")), "pos = 'n'")
    return d.select("k", joined("classes").alias("classes"))


@query("p04_plurals", _LINES + "SELECT k, pls AS plurals FROM l WHERE wc = 'n' AND cl <> '' AND pl <> ''")
def p04_plurals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = computed.kept(entries.with_noun(entries.with_header(lines(spark, sf_dir), "line")), "size(plural_prefixes) > 0")
    return d.select("k", joined("plural_prefixes", "|").alias("plurals"))


@query(
    "p05_attested",
    _LINES + f"SELECT {_KIND} AS attested, CASE WHEN wc = 'n' THEN split_part(cls, ',', 1) ELSE '' END AS first_class, count(*) AS entries FROM l GROUP BY 1, 2",
)
def p05_attested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the line itself says of word class and first noun class, whether or not its entry parses."""
    d = entries.with_noun(entries.with_header(lines(spark, sf_dir), "line"))
    kinds = F.create_map(*[F.lit(x) for pair in entries.KINDS.items() for x in pair])
    kind = F.coalesce(F.try_element_at(kinds, "pos"), F.lit("unknown"))
    first = F.coalesce(F.get("classes", F.lit(0)), F.lit(""))
    return d.groupBy(kind.alias("attested"), first.alias("first_class")).agg(F.count("*").alias("entries"))


def sense_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = computed.kept(entries.with_grammar(entries.with_noun(entries.with_header(lines(spark, sf_dir), "line"))), "size(errors) = 0")
    columns = ("k", "pos", "dialects", "grammar", "classes", "plural_prefixes")
    return d.select(*columns, F.explode(entries.senses(F.col("rest"))).alias("s")).select(*columns, "s.*")


_NOUN_GRAMMAR = "CASE WHEN wc = 'n' AND cl <> '' THEN 'class ' || replace(cls, ',', ',class ') || CASE WHEN pls <> '' THEN ',plural ' || replace(pls, '|', ',plural ') ELSE '' END ELSE '' END"


@query(
    "p06_senses",
    _LINES + f"""SELECT k, 1 AS number, {_DIA} AS dialects, CASE WHEN wc = 'n' THEN {_NOUN_GRAMMAR} WHEN wc = 'vt' THEN 'vt' ELSE gr END AS grammar FROM l WHERE {_GOOD}
    UNION ALL SELECT k, 2, 'M', 't' FROM l WHERE {_GOOD} AND def2 <> ''
    UNION ALL SELECT k, 3, {_DIA}, CASE WHEN wc = 'n' THEN {_NOUN_GRAMMAR} WHEN wc = 'vt' THEN 'vt' ELSE '' END FROM l WHERE {_GOOD} AND def3 <> ''""",
)
def p06_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered senses; one without dialects of its own has the entry's, one without codes what its entry gives it."""
    d = entries.with_sense_prefix(sense_rows(spark, sf_dir), "text")
    given = entries.grammar_of_sense(F.col("number"))
    grammar = F.when(F.size("sense_grammar") > 0, F.col("sense_grammar")).otherwise(given)
    dialects = F.when(F.size("sense_dialects") > 0, F.col("sense_dialects")).otherwise(F.col("dialects"))
    return d.select("k", "number", joined(dialects).alias("dialects"), joined(grammar).alias("grammar"))


@query(
    "p07_inner",
    _LINES + f"""SELECT k, 1 AS number, CASE WHEN ref <> '' THEN 'mota(K,M)' ELSE '' END AS refs, CASE WHEN org <> '' THEN 'Port mesa' ELSE '' END AS origins, CASE WHEN drv <> '' THEN 'banga,bangira' ELSE '' END AS derived,
    CASE WHEN ex <> '' THEN 'Akaenda kumba=he went home' ELSE '' END AS examples, 'Kind of ' || lower(p_type) || '.' AS definition FROM l WHERE {_GOOD}
    UNION ALL SELECT k, 2, '', '', '', '', 'Seen as ' || lower(p_type) FROM l WHERE {_GOOD} AND def2 <> ''
    UNION ALL SELECT k, 3, '', '', '', '', 'Said of it' FROM l WHERE {_GOOD} AND def3 <> ''""",
)
def p07_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands inside senses (references, origins, derived forms, examples), taken out of their definitions."""
    d = entries.with_inner(entries.with_sense_prefix(sense_rows(spark, sf_dir), "text"), "text")
    refs = F.transform("references", lambda r: F.concat(r["target"], F.lit("("), F.array_join(r["dialects"], ","), F.lit(")")))
    examples = F.transform("examples", lambda e: F.concat_ws("=", e["example"], e["meaning"]))
    return d.select("k", "number", joined(refs).alias("refs"), joined("origins").alias("origins"), joined("derived").alias("derived"), joined(examples).alias("examples"), "definition")


_PL_FORMS = "CASE WHEN wc = 'n' AND cl <> '' THEN CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'map-' WHEN 2 THEN 'vana- (M)|mag- (Z)' ELSE 'mab- (M) & map-' END ELSE '' END"


_BARE = "hw || ' [' || tn || '; ' || tn || CASE WHEN dia <> '' THEN ' ' || dia ELSE '' END || '] n 3, pl: ' || replace(pls, '|', ', ')"
_SHAPE = """CASE WHEN wc = 'n' THEN CASE WHEN cl <> '' AND split_part(cls, ',', 1) = '1a' THEN 'noun_subclass' WHEN plurals <> '' THEN 'noun_with_plural' ELSE 'noun_plain' END
      WHEN wc = 'vt' OR gr = 't' THEN 'verb_transitive' WHEN gr = 'i' THEN 'verb_intransitive' WHEN wc = 'v' THEN 'verb_other' WHEN wc = 'ideo' THEN 'ideophone' WHEN def2 <> '' THEN 'multi_sense_other' ELSE 'other' END"""


@query(
    "p08_reader",
    _LINES + f"""SELECT k, false AS bare, replace(hw, '-', '') AS headword, CASE WHEN wc = 'zz' THEN 'other' ELSE {_KIND} END AS kind, CASE WHEN wc = 'n' AND cl <> '' THEN split_part(cls, ',', 1) END AS noun_class, tn AS tones, plurals, {_SHAPE} AS shape
    FROM (SELECT *, {_PL_FORMS} AS plurals FROM l) WHERE tn NOT IN ('', 'XL')
    UNION ALL SELECT k, true, replace(hw, '-', ''), 'noun', '3', tn, pls, CASE WHEN pls <> '' THEN 'noun_with_plural' ELSE 'noun_plain' END FROM l WHERE tn NOT IN ('', 'XL')""",
)
def p08_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second, independent reading of a line: facts and the shape of its source; also of lines that end with their plurals."""
    p = table(spark, sf_dir, "part").withColumns({k: F.expr(v) for k, v in PARTS.items()})
    both = F.array(F.struct(F.lit(False).alias("bare"), F.expr(LINE).alias("line")), F.struct(F.lit(True).alias("bare"), F.expr(_BARE).alias("line")))
    d = p.select("k", F.explode(both).alias("l")).select("k", "l.*")
    d = computed.kept(entries.with_facts(d, "line"), "fact_headword IS NOT NULL")
    plurals = F.coalesce(joined("fact_plurals", "|"), F.lit(""))
    return d.select("k", "bare", F.col("fact_headword").alias("headword"), F.col("fact_kind").alias("kind"), F.col("fact_class").alias("noun_class"), joined("fact_tones").alias("tones"), plurals.alias("plurals"), "shape")


@query(
    "p09_structuring",
    _LINES + f"""SELECT p_brand, count(*) AS scanned, count(*) FILTER ({_GOOD}) AS parsed, count(*) FILTER (NOT ({_GOOD})) AS failed, count(*) FILTER (tn = '') AS without_tone FROM l GROUP BY 1""",
)
def p09_structuring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmented units structured by the parser, with counts of what came of them by batch."""
    d = lines(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand"), "k")
    d = entries.with_header(d, "line")
    good = F.size("errors") == 0
    return d.groupBy("p_brand").agg(
        F.count("*").alias("scanned"), F.count_if(good).alias("parsed"), F.count_if(~good).alias("failed"), F.count_if(F.col("tone").isNull()).alias("without_tone")
    )


@query(
    "p10_segments",
    """WITH s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'own:' || p_partkey END AS given, p_size, lower(replace(p_name, ' ', '-')) AS slug, (p_partkey * 7) % 130 - 10 AS percent FROM part),
    t AS (SELECT *, CASE WHEN given <> '' THEN given ELSE 'segments:page_' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ':entry_' || lpad(CAST(k AS VARCHAR), 5, '0') || ':' || slug END AS locator FROM s)
    SELECT locator, CAST(greatest(0, least(100, percent)) AS DOUBLE) / 100 AS confidence, CASE WHEN percent >= 100 THEN 'parsed' WHEN percent >= 70 THEN 'uncertain' ELSE 'failed' END AS status
    FROM t WHERE percent >= 20 AND locator NOT IN (SELECT 'own:' || l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)""",
)
def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments brought in: percent to confidence, a locator made where there is none, those already there left out."""
    d = table(spark, sf_dir, "part").withColumn("percent", (F.col("p_partkey") * 7) % 130 - 10).where("percent >= 20")
    own = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("own:"), F.col("p_partkey").cast("string")))
    made = F.concat(
        F.lit("segments:page_"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(":entry_"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"),
        F.lit(":"), F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))),
    )
    d = d.withColumn("locator", F.coalesce(own, made))
    there = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(F.concat(F.lit("own:"), F.col("l_partkey").cast("string")).alias("locator"))
    d = d.join(there, "locator", "left_anti")
    status = F.when(F.col("percent") >= 100, "parsed").when(F.col("percent") >= 70, "uncertain").otherwise("failed")
    confidence = F.greatest(F.lit(0), F.least(F.lit(100), F.col("percent"))).cast("double") / 100
    return d.select("locator", confidence.alias("confidence"), status.alias("status"))


_SENSES_SQL = "(SELECT k, 'Kind of ' || lower(p_type) || '.' AS definition FROM l WHERE " + _GOOD + ")"


@query(
    "j04_normalised_entry",
    _LINES + f"""SELECT k, CASE k % 3 WHEN 0 THEN 'v2' WHEN 1 THEN 'v3' ELSE 'v1' END AS version, CASE WHEN k % 3 = 0 AND tn = '' THEN 'missing_v2_fields:tone_pattern' WHEN k % 3 = 1 THEN 'missing_v3_fields:' || CASE WHEN k % 2 = 0 THEN '' ELSE 'idiomatic_expressions,' END || 'senses' || CASE WHEN tn = '' THEN ',tone_pattern' ELSE '' END ELSE '' END AS errors FROM l""",
)
def j04_normalised_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields of an entry's JSON by its version: what is missing, in order, as one error each."""
    d = entries.with_header(lines(spark, sf_dir), "line")
    version = F.element_at(F.array(*map(F.lit, ("v2", "v3", "v1"))), (F.col("k") % 3 + 1).cast("int"))
    body = F.struct(F.col("headword"), F.col("tone").alias("tone_pattern"), F.when(F.col("k") % 2 == 0, F.array(F.lit("x"))).alias("idiomatic_expressions"))
    d = d.select("k", version.alias("version"), F.to_json(body).alias("body"))  # null fields are absent from JSON
    need = {"v2": ("headword", "tone_pattern"), "v3": ("headword", "idiomatic_expressions", "senses", "tone_pattern")}
    missing = lambda v: F.array_sort(F.array_except(F.array(*map(F.lit, need[v])), F.json_object_keys("body")))
    errors = F.lit("")
    for v in need:
        errors = F.when((F.col("version") == v) & (F.size(missing(v)) > 0), F.concat(F.lit(f"missing_{v}_fields:"), joined(missing(v)))).otherwise(errors)
    return d.select("k", "version", errors.alias("errors"))


@query(
    "j08_publishable",
    _LINES + """SELECT k, concat_ws(',', CASE WHEN wc = 'zz' THEN 'no_code' END, CASE WHEN length(lower(p_type)) > 6 THEN 'label_residue' END, CASE WHEN wc = 'n' AND cl = '' THEN 'no_class' END,
    CASE WHEN tn IN ('', 'LHLH', 'XL') THEN 'bad_tone' END, CASE WHEN p_size > 40 THEN 'unresolved_senses' END) AS messages FROM l""",
)
def j08_publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that keeps an entry from publication: code, label, class, tone, numbers left in a definition."""
    d = entries.with_noun(entries.with_header(lines(spark, sf_dir), "line"))
    d = d.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_type", "p_size"), "k")
    definition = F.concat(F.lit("First"), F.when(F.col("p_size") > 40, " 2. second").otherwise(""))
    messages = F.array(
        F.when(F.col("pos").isNull(), "no_code"), F.when(F.length("p_type") > 6, "label_residue"),
        F.when((F.col("pos") == "n") & (F.size("classes") == 0), "no_class"),
        F.when(~F.coalesce(F.col("tone").rlike("^(?:H|L){1,3}$"), F.lit(False)), "bad_tone"), F.when(definition.rlike(r"\s[2-9]\.\s"), "unresolved_senses"),
    )
    return d.select("k", joined(F.array_compact(messages)).alias("messages"))


# What the mark before a derived form says of it.
RELATIONS = {">": "derives", "<": "derived_from"}


@query(
    "j09_derived_forms",
    _LINES + """SELECT k, form, CASE p_size % 3 WHEN 0 THEN '>' WHEN 1 THEN '~' ELSE '' END AS marker, CASE p_size % 3 WHEN 0 THEN 'derives' WHEN 1 THEN 'source_marker_relation' ELSE '' END AS relation, 'derived_forms[0]' AS path
    FROM (SELECT k, p_size, unnest(string_split(p_name, ' ')) AS form FROM l) WHERE form <> '' AND p_size % 3 < 2
    UNION ALL SELECT k, replace(p_name, ' ', ''), '', '', '' FROM l WHERE p_size % 3 = 2""",
)
def j09_derived_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms out of items of several shapes (a list, or one text under several names), each with its evidence."""
    p = table(spark, sf_dir, "part")
    listed = F.when(F.col("p_size") % 3 < 2, F.split("p_name", " "))
    item = F.struct(
        listed.alias("forms"), F.when(F.col("p_size") % 3 == 2, F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("")))).alias("text"),
        F.element_at(F.array(F.lit(">"), F.lit("~"), F.lit("")), (F.col("p_size") % 3 + 1).cast("int")).alias("marker"),
    )
    read = "forms array<string>, form_text string, form string, text string, marker string"
    d = p.select(F.col("p_partkey").alias("k"), F.from_json(F.to_json(item), read).alias("i"))
    forms = F.coalesce("i.forms", F.array(F.coalesce("i.form_text", "i.form", "i.text")))
    relations = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    marker = F.coalesce("i.marker", F.lit(""))
    relation = F.when(marker == "", "").otherwise(F.coalesce(F.try_element_at(relations, marker), F.lit("source_marker_relation")))
    d = d.select("k", F.explode(F.filter(F.transform(forms, lambda f: F.trim(f)), lambda f: f != "")).alias("form"), marker.alias("marker"), relation.alias("relation"))
    return d.withColumn("path", F.when(F.col("marker") != "", "derived_forms[0]").otherwise(""))


@query(
    "j10_idioms",
    _LINES + """SELECT k, hw || ' ' || dia AS expression, CASE WHEN p_size % 4 = 0 THEN lower(p_type) END AS meaning, CASE WHEN p_size % 5 = 0 THEN lower(p_brand) END AS rendering
    FROM l WHERE dia <> '' AND (p_size % 4 = 0 OR p_size % 5 = 0)""",
)
def j10_idioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idioms that can be published: with a text, and a meaning or a rendering."""
    d = table(spark, sf_dir, "part").withColumns({k: F.expr(PARTS[k]) for k in ("k", "hw", "dia")})
    idiom = F.struct(
        F.when(F.col("dia") != "", F.concat_ws(" ", "hw", "dia")).otherwise(" ").alias("expression"),
        F.when(F.col("p_size") % 4 == 0, F.lower("p_type")).otherwise("").alias("meaning"), F.when(F.col("p_size") % 5 == 0, F.lower("p_brand")).alias("rendering"),
    )
    d = d.select("k", F.explode(F.array(idiom)).alias("i")).select("k", *[F.nullif(F.trim(f"i.{c}"), F.lit("")).alias(c) for c in ("expression", "meaning", "rendering")])
    return computed.kept(d, "expression IS NOT NULL AND coalesce(meaning, rendering) IS NOT NULL")


@query(
    "j02_cross_references",
    """WITH r AS (SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN 'cp ' WHEN 1 THEN 'see ' WHEN 2 THEN 'qv ' ELSE '' END || split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 9 = 0 THEN 'xx' ELSE '' END AS raw FROM part),
    s AS (SELECT k, CASE WHEN raw LIKE '% %' THEN split_part(raw, ' ', 1) ELSE 'reference' END AS type, CASE WHEN raw LIKE '% %' THEN split_part(raw, ' ', 2) ELSE raw END AS target FROM r),
    t AS (SELECT split_part(p_name, ' ', 1) AS target, min(p_partkey) AS id FROM part WHERE p_size > 10 GROUP BY 1)
    SELECT k, type, s.target, t.id AS target_id, t.id IS NOT NULL AS resolved FROM s LEFT JOIN t ON s.target = t.target""",
)
def j02_cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References split into kind and target, and resolved to the first entry of that spelling by one join."""
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, ("cp ", "see ", "qv ", ""))), (F.col("p_size") % 4 + 1).cast("int"))
    raw = F.concat(kind, F.substring_index("p_name", " ", 1), F.when(F.col("p_partkey") % 9 == 0, "xx").otherwise(""))
    d = p.select(F.col("p_partkey").alias("k"), raw.alias("raw"))
    split = r"^(?:(cp|cf|qv|see)\s+)?(.*)$"
    d = d.select("k", F.coalesce(F.nullif(F.regexp_extract("raw", split, 1), F.lit("")), F.lit("reference")).alias("type"), F.regexp_extract("raw", split, 2).alias("target"))
    first = p.where("p_size > 10").groupBy(F.substring_index("p_name", " ", 1).alias("target")).agg(F.min("p_partkey").alias("target_id"))
    return d.join(first, "target", "left").select("k", "type", "target", "target_id", F.col("target_id").isNotNull().alias("resolved"))


@query(
    "c05_lexical_qa",
    _LINES + f""", c AS (SELECT k, wc, tn, cl, cls, hw, {_GOOD} AS parsed FROM l WHERE tn NOT IN ('', 'XL')), u AS (SELECT unnest(['headword', 'kind', 'noun_class', 'tone']) AS metric,
    unnest([CASE WHEN k % 11 = 0 THEN 0 ELSE 1 END, CASE WHEN wc = 'zz' THEN NULL WHEN parsed THEN 1 ELSE 0 END, CASE WHEN wc = 'n' AND cl <> '' THEN 1 END, 1]) AS ok FROM c)
    SELECT metric, count(*) FILTER (ok = 1) AS passed, count(ok) AS denominator, count(*) AS cases FROM u GROUP BY metric""",
)
def c05_lexical_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published records against an independent reading of their lines: passes over what each check applies to."""
    d = computed.kept(entries.with_noun(entries.with_header(entries.with_facts(lines(spark, sf_dir), "line"), "line")), "fact_headword IS NOT NULL")
    published = F.when(F.col("k") % 11 == 0, F.concat("normalized_headword", F.lit("x"))).otherwise(F.col("normalized_headword"))
    checks = {
        "headword": published == F.col("fact_headword"),
        "kind": F.when(F.col("fact_kind") != "other", F.col("kind") == F.col("fact_kind")),
        "noun_class": F.when(F.col("fact_class").isNotNull(), F.get("classes", F.lit(0)) == F.col("fact_class")),
        "tone": F.array_contains("fact_tones", F.col("tone")),
    }
    made = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("ok")) for m, v in checks.items()])
    d = d.select(F.explode(made).alias("c")).select("c.*")
    return d.groupBy("metric").agg(F.count_if("ok").alias("passed"), F.count("ok").alias("denominator"), F.count("*").alias("cases"))


@query(
    "c07_repair_diff",
    _LINES + f"""SELECT k, 'senses' AS field FROM l WHERE {_GOOD} AND def2 <> '' UNION ALL SELECT k, 'tone' FROM l WHERE {_GOOD} AND k % 13 = 0""",
)
def c07_repair_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored payloads against what the parser makes now: only fields that differ are rewritten."""
    d = computed.kept(entries.with_grammar(entries.with_noun(entries.with_header(lines(spark, sf_dir), "line"))), "size(errors) = 0")
    now = F.struct(F.size(entries.senses(F.col("rest"))).alias("senses"), F.col("tone").alias("tone"))
    stored = F.struct(F.lit(1).alias("senses"), F.when(F.col("k") % 13 == 0, "X").otherwise(F.col("tone")).alias("tone"))
    d = computed.kept(d.select("k", now.alias("now"), stored.alias("stored")), "now <> stored")
    fields = F.array_compact(F.array(*[F.when(F.col(f"now.{f}") != F.col(f"stored.{f}"), f) for f in ("senses", "tone")]))
    return d.select("k", F.explode(fields).alias("field"))


@query(
    "c12_batch_publish",
    _LINES + f"""SELECT p_brand, count(*) FILTER ({_GOOD} AND NOT (wc = 'n' AND cl = '')) AS published, count(*) FILTER (NOT ({_GOOD})) AS unparsed, count(*) FILTER ({_GOOD} AND wc = 'n' AND cl = '') AS refused FROM l GROUP BY 1""",
)
def c12_batch_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch published row by row: what fails is counted by its reason and stops nothing else."""
    d = lines(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand"), "k")
    d = entries.with_noun(entries.with_header(d, "line"))
    outcome = F.when(F.size("errors") > 0, "unparsed").when((F.col("pos") == "n") & (F.size("classes") == 0), "refused").otherwise("published")
    d = d.groupBy("p_brand", outcome.alias("outcome")).count()
    part = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("count"))), F.lit(0)).alias(o)
    return d.groupBy("p_brand").agg(part("published"), part("unparsed"), part("refused"))


@query(
    "src07_batch",
    _LINES + f"""SELECT 'batch:' || lpad(CAST(k AS VARCHAR), 6, '0') || ':' || lower(regexp_replace(replace(hw, '-', ''), '[^a-z]+', '-', 'g')) AS locator, line FROM l WHERE {_GOOD} AND length(line) >= 40 ORDER BY k LIMIT 100""",
)
def src07_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch: lines that are whole and parse, the first hundred (a batch's size), each with a locator."""
    d = computed.kept(entries.with_header(lines(spark, sf_dir).where(F.length("line") >= 40), "line"), "size(errors) = 0")
    slug = F.lower(F.regexp_replace("normalized_headword", "[^a-z]+", "-"))
    locator = F.concat(F.lit("batch:"), F.lpad(F.col("k").cast("string"), 6, "0"), F.lit(":"), slug)
    return d.orderBy("k").limit(100).select(locator.alias("locator"), "line")


@query("wn07_first_occurrence", "SELECT split_part(p_name, ' ', 1) AS word, min(p_partkey) AS first_key, count(*) AS times FROM part GROUP BY 1")
def wn07_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each spelling, in order, with how many there are."""
    p = table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1).alias("word"), F.col("p_partkey").alias("first_key"))
    n = p.groupBy("word").agg(F.count("*").alias("times"))
    return ordered.firsts(p, ["word"], [F.col("first_key")]).join(n, "word")
