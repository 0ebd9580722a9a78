"""Search, promotion, quality, repair and tagging over words and entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import labels, plurals
from quern.functions import similarity as sim
from quern.plans.base import query, table


def inline(spark: SparkSession, rows: str, names: str) -> DataFrame:
    """A few constant rows, in the same words as the SQL beside it."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


@query(
    "s22_coverage_predicate",
    r"""WITH t AS (SELECT p_partkey, len(string_split(p_name, ' ')) AS words, len(string_split(p_type, ' ')) AS g, length(replace(p_type, ' ', '')) AS letters FROM part)
    SELECT p_partkey, CAST(words AS BIGINT) AS words, CAST(letters AS BIGINT) AS letters, g < words AND (letters % words <> 0 OR letters < words) AS uncovered FROM t""",
)
def s22_coverage_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether tone groups are too few for the words and cannot be dealt out to them evenly."""
    t = table(spark, sf_dir, "part").select(
        "p_partkey", F.size(F.split("p_name", " ")).cast("long").alias("words"), F.size(F.split("p_type", " ")).alias("g"),
        F.length(F.replace("p_type", F.lit(" "), F.lit(""))).cast("long").alias("letters"),
    )
    uneven = (F.col("letters") % F.col("words") != 0) | (F.col("letters") < F.col("words"))
    return t.select("p_partkey", "words", "letters", ((F.col("g") < F.col("words")) & uneven).alias("uncovered"))


# A tone bracket of one or two patterns with dialects, and its entry's dialects, from the columns of a part.
TONES = {
    "a": "CASE p_partkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'LH' ELSE 'HHL' END", "da": "CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'M' WHEN 2 THEN 'KKoZ' ELSE 'of' END",
    "two": "p_size % 3 = 0", "entry": "CASE p_partkey % 5 WHEN 0 THEN 'K' WHEN 1 THEN 'KMZ' WHEN 2 THEN 'of it' WHEN 3 THEN '' ELSE 'Ko' END",
}
_BRACKET = "'[' || a || CASE WHEN da <> '' THEN ' ' || da ELSE '' END || CASE WHEN two THEN ' ;  LL Z;' ELSE '' END || ']'"


@query(
    "j06_tone_parse",
    f"""WITH t AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in TONES.items())} FROM part), d(run, dialects) AS (VALUES ('M', 'M'), ('K', 'K'), ('Ko', 'Ko'), ('KKoZ', 'K,Ko,Z'), ('KMZ', 'K,M,Z'), ('Z', 'Z'))
    SELECT p_partkey AS id, 1::BIGINT AS place, a AS pattern, coalesce(own.dialects, CASE WHEN NOT two THEN whole.dialects END, '') AS dialects FROM t LEFT JOIN d own ON own.run = da LEFT JOIN d whole ON whole.run = entry
    UNION ALL SELECT p_partkey, 2, 'LL', 'Z' FROM t WHERE two""",
)
def j06_tone_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns and dialects of a bracket composed from columns; a lone pattern without dialects has those of its entry."""
    t = table(spark, sf_dir, "part").withColumns({k: F.expr(v) for k, v in TONES.items()})
    b = t.select(F.col("p_partkey").alias("id"), F.posexplode(labels.tones(F.expr(_BRACKET), F.col("entry"))).alias("i", "t"))
    return b.select("id", (F.col("i") + 1).cast("long").alias("place"), "t.pattern", F.array_join("t.dialects", ",").alias("dialects"))


@query(
    "j13_map_merge",
    """SELECT event_id, 'k=' || CASE WHEN value >= 50 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE json_extract_string(props, '$.k') END || ';kind=' || event_type AS merged FROM events""",
)
def j13_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of an event with later ones laid over them: a later key wins."""
    first = F.from_json("props", "map<string,string>")
    later = F.map_filter(
        F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), F.when(F.col("value") >= 50, F.floor("value").cast("string"))),
        lambda _, v: v.isNotNull(),
    )
    kept = F.map_filter(first, lambda k, _: ~F.map_contains_key(later, k))
    pairs = F.array_sort(F.transform(F.map_entries(F.map_concat(kept, later)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(pairs, ";").alias("merged"))


CODES = ("n", "v t", "VT & I", "vit", "def v", "ideo", "adj, pron", " Tense  Sign", "none", "sfx", "interrog adv", "")
_STORED_SQL = f"[{', '.join(repr(c) for c in CODES)}][CAST(p_size % {len(CODES)} AS INTEGER) + 1]"
_CANON_SQL = "CASE trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in labels.POS_ALIASES.items()) + " ELSE trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')) END"


def stored_code():
    return F.element_at(F.array(*map(F.lit, CODES)), (F.col("p_size") % len(CODES) + 1).cast("int"))


@query(
    "ag11_transitions",
    f"WITH p AS (SELECT {_STORED_SQL} AS was FROM part) SELECT was, {_CANON_SQL.format(x='was')} AS now, count(*) AS entries FROM p GROUP BY 1, 2 HAVING now <> was",
)
def ag11_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(stored_code().alias("was")).groupBy("was").agg(F.count("*").alias("entries"))
    return p.select("was", labels.pos_code(F.col("was")).alias("now"), "entries").where("now <> was")


ATTESTED = "('STANDARD', 'n'), ('SMALL', 'vti'), ('PROMO', 'ideo'), ('LARGE', 'unknown')"


@query(
    "c06_repair",
    f"""WITH p AS (SELECT p_partkey, {_STORED_SQL} AS was, split_part(p_type, ' ', 1) AS k FROM part), a(k, attested) AS (VALUES {ATTESTED}),
    j AS (SELECT p_partkey, was, {_CANON_SQL.format(x='was')} AS parsed, attested FROM p LEFT JOIN a USING (k))
    SELECT p_partkey, was, coalesce(attested, parsed) AS now, CASE WHEN attested IS NULL THEN 'parser' ELSE 'attested' END AS basis, coalesce(attested <> parsed, false) AS disagrees
    FROM j WHERE coalesce(attested, parsed) <> was""",
)
def c06_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is attested goes before what was parsed; a disagreement is recorded, and only changed rows are returned."""
    p = table(spark, sf_dir, "part").select("p_partkey", stored_code().alias("was"), F.substring_index("p_type", " ", 1).alias("k"))
    j = p.withColumn("parsed", labels.pos_code(F.col("was"))).join(F.broadcast(inline(spark, ATTESTED, "k, attested")), "k", "left")  # four rows
    now = F.coalesce("attested", "parsed")
    return j.where(now != F.col("was")).select(
        "p_partkey", "was", now.alias("now"), F.when(F.col("attested").isNull(), "parser").otherwise("attested").alias("basis"),
        F.coalesce(F.col("attested") != F.col("parsed"), F.lit(False)).alias("disagrees"),
    )


@query(
    "jn05_normalised_key",
    """WITH a AS (SELECT c_custkey, lower(replace(upper(replace(c_name, '#', '-')), '-', '')) AS k FROM customer), b AS (SELECT DISTINCT lower(replace('CUSTOMER-' || lpad(CAST(o_custkey AS VARCHAR), 9, '0'), '-', '')) AS k FROM orders WHERE o_orderstatus = 'P')
    SELECT c_custkey, k FROM a JOIN b USING (k) WHERE k <> ''""",
)
def jn05_normalised_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of ids that are written with and without dashes, in either case; empty ones meet nothing."""
    key = lambda c: F.lower(F.replace(c, F.lit("-"), F.lit("")))
    a = table(spark, sf_dir, "customer").select("c_custkey", key(F.upper(F.replace("c_name", F.lit("#"), F.lit("-")))).alias("k"))
    written = F.concat(F.lit("CUSTOMER-"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    b = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(key(written).alias("k"))
    return a.where("k <> ''").join(b, "k", "left_semi").select("c_custkey", "k")


PREFIXES = ("gre", "st", "bl")


@query(
    "jn14_prefix_exists",
    f"SELECT p_partkey, p_name FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: {' OR '.join(f'''starts_with(w, '{p}')''' for p in PREFIXES)})) > 0",
)
def jn14_prefix_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    begins = F.exists(F.split("p_name", " "), lambda w: F.exists(F.array(*map(F.lit, PREFIXES)), lambda p: F.startswith(w, p)))
    return table(spark, sf_dir, "part").where(begins).select("p_partkey", "p_name")


ASKED = "(1, 'red ring'), (2, 'smal wigdet'), (3, 'bolt'), (4, 'zzz'), (5, ''), (6, 'blue  Bolt'), (7, 'old'), (8, 'lage gear')"
_TRIGRAMS = "list_distinct(list_transform(generate_series(1, CAST(length({x}) + 2 AS BIGINT)), lambda i: substring('  ' || {x} || '  ', i, 3)))"


@query(
    "c01_cascade",
    f"""WITH q AS (SELECT qid, trim(regexp_replace(lower(q), '\\s+', ' ', 'g')) AS q FROM (VALUES {ASKED}) t(qid, q)),
    l AS (SELECT p_name AS entry, min(p_partkey) AS id FROM part GROUP BY 1),
    h AS (SELECT qid, 0 AS tier, entry, id, CAST(1 AS DOUBLE) AS score FROM q JOIN l ON entry = q
      UNION ALL SELECT qid, 1, entry, id, 1 FROM q JOIN l ON list_contains(string_split(entry, ' '), q)
      UNION ALL SELECT qid, 2, entry, id, CAST(s AS DOUBLE) / (x + y - s) FROM (SELECT qid, entry, id, len({_TRIGRAMS.format(x="entry")}) AS x, len({_TRIGRAMS.format(x="q")}) AS y, len(list_intersect({_TRIGRAMS.format(x="entry")}, {_TRIGRAMS.format(x="q")})) AS s FROM q, l WHERE q <> '') WHERE 10 * s >= 3 * (x + y - s)),
    b AS (SELECT *, min(tier) OVER (PARTITION BY qid) AS best FROM h),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM b WHERE tier = best)
    SELECT CAST(qid AS INTEGER) AS qid, tier, entry, id, score, place FROM r WHERE place <= 20""",
)
def c01_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query the hits of its best tier: the entry itself, one of its words, or likeness of 0.3; 20 at most.

    Likeness goes through an inverted list of trigrams: what is 0.3 alike shares one at least.
    """
    norm = F.trim(F.regexp_replace(F.lower("q"), r"\s+", " "))
    q = inline(spark, ASKED, "qid, q").select("qid", norm.alias("q"))
    lexicon = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("entry")).agg(F.min("p_partkey").alias("id"))
    out = ["qid", "tier", "entry", "id", "score"]
    exact = q.join(lexicon, F.col("entry") == F.col("q")).withColumns({"tier": F.lit(0), "score": F.lit(1.0)})
    words = lexicon.withColumn("q", F.explode(F.array_distinct(F.split("entry", " "))))
    form = q.join(words, "q").withColumns({"tier": F.lit(1), "score": F.lit(1.0)})
    grams = lexicon.withColumn("g", sim.trigrams(F.col("entry"))).withColumn("x", F.size("g"))
    asked = q.withColumn("g", sim.trigrams(F.col("q"))).withColumn("y", F.size("g"))
    met = grams.withColumn("g", F.explode("g")).join(asked.withColumn("g", F.explode("g")), "g")
    met = met.groupBy("qid", "entry", "id", "x", "y").agg(F.count("*").alias("s"))
    either = F.col("x") + F.col("y") - F.col("s")
    fuzzy = met.where(10 * F.col("s") >= 3 * either).withColumns({"tier": F.lit(2), "score": F.col("s") / either})
    hits = exact.select(*out).union(form.select(*out)).union(fuzzy.select(*out))
    hits = hits.join(hits.groupBy("qid").agg(F.min("tier").alias("tier")), ["qid", "tier"])
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return hits.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 20").select(*out, "place")


@query(
    "c03_promotion",
    """WITH c AS (SELECT doc_id, list_filter([CASE WHEN coalesce(text, '') = '' THEN 'empty' END, CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN quality = 0 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS e, quality FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, array_to_string(e, ',') AS errors, CASE WHEN len(e) > 0 THEN 'failed' WHEN quality IS NULL THEN 'needs_review' ELSE 'published' END AS state FROM c""",
)
def c03_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate before publication: all that is against a document, and its state."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    errors = F.array_compact(
        F.array(
            F.when(F.coalesce("text", F.lit("")) == "", "empty"), F.when(F.col("n_chars") < 100, "short"),
            F.when(F.col("quality") == 0, "quality"), F.when(F.col("toxic") == 1, "toxic"),
        )
    )
    state = F.when(F.size(errors) > 0, "failed").when(F.col("quality").isNull(), "needs_review").otherwise("published")
    return d.select("doc_id", F.array_join(errors, ",").alias("errors"), state.alias("state"))


@query(
    "c04_corpus_qa",
    """WITH n AS (SELECT p_name, count(*) AS n, count(DISTINCT p_type) AS types FROM part GROUP BY 1),
    c AS (SELECT p_brand, p_name, p_size, n, types FROM part JOIN n USING (p_name))
    SELECT p_brand, count(*) AS entries, count(*) FILTER (n > 1) AS homographs, count(*) FILTER (n > types) AS ambiguous, count(*) FILTER (p_size < 3) AS unsearchable,
    CASE WHEN count(*) FILTER (n > types OR p_size < 3) > 0 THEN 'error' WHEN count(*) FILTER (n > 1) > 0 THEN 'info' ELSE 'clean' END AS status FROM c GROUP BY 1""",
)
def c04_corpus_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of each brand's entries: those that share a spelling (info), or also a type, or are too small to be found (errors)."""
    p = table(spark, sf_dir, "part").groupBy("p_name", "p_type", "p_brand").agg(
        F.count("*").alias("m"), F.count_if(F.col("p_size") < 3).alias("small")
    )
    n = p.groupBy("p_name", "p_type").agg(F.sum("m").alias("m")).groupBy("p_name").agg(F.sum("m").alias("n"), F.count("*").alias("types"))
    c = p.join(n, "p_name")
    part = lambda condition: F.sum(F.when(condition, F.col("m")).otherwise(0))
    c = c.groupBy("p_brand").agg(
        F.sum("m").alias("entries"), part(F.col("n") > 1).alias("homographs"), part(F.col("n") > F.col("types")).alias("ambiguous"),
        F.sum("small").alias("unsearchable"),
    )
    status = F.when((F.col("ambiguous") > 0) | (F.col("unsearchable") > 0), "error").when(F.col("homographs") > 0, "info").otherwise("clean")
    return c.withColumn("status", status)


TOLD = ("a greeting for the father", "Mountain or river", "the hour of the day", "a sister-in-law", "sunset", "mother tongue; tomorrow", "nothing of it", "RAIN on a tree")
_TOLD_SQL = f"SELECT p_partkey, p_name || ': ' || [{', '.join(repr(t) for t in TOLD)}][CAST(p_partkey % {len(TOLD)} AS INTEGER) + 1] AS text FROM part"
_TAGS_SQL = ", ".join(f"CASE WHEN regexp_matches(text, '{labels.topic_regex(w)}') THEN '{t}' END" for t, w in labels.TOPICS.items())


@query(
    "c08_keyword_tags",
    f"""WITH t AS (SELECT p_partkey, list_filter([{_TAGS_SQL}], lambda x: x IS NOT NULL) AS c FROM ({_TOLD_SQL}))
    SELECT p_partkey, array_to_string(c, ',') AS contexts, CASE WHEN list_has_any(c, ['greetings', 'family', 'time']) THEN 'forms_1_2' ELSE 'general_secondary' END AS stage,
    CASE WHEN list_has_any(c, ['greetings', 'family']) THEN 'vocabulary,oral_communication' ELSE 'vocabulary' END AS domains FROM t WHERE len(c) > 0""",
)
def c08_keyword_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of entries by the keywords in headword and definition, with what follows from them."""
    told = F.element_at(F.array(*map(F.lit, TOLD)), (F.col("p_partkey") % len(TOLD) + 1).cast("int"))
    d = table(spark, sf_dir, "part").select("p_partkey", labels.topics(F.concat("p_name", F.lit(": "), told)).alias("c")).where(F.size("c") > 0)
    some = lambda *names: F.arrays_overlap("c", F.array(*map(F.lit, names)))
    domains = F.array_union(F.array(F.lit("vocabulary")), F.when(some("greetings", "family"), F.array(F.lit("oral_communication"))).otherwise(F.array().cast("array<string>")))
    return d.select(
        "p_partkey", F.array_join("c", ",").alias("contexts"),
        F.when(some("greetings", "family", "time"), "forms_1_2").otherwise("general_secondary").alias("stage"), F.array_join(domains, ",").alias("domains"),
    )


CONFLICTS = "('names', 'word', 'ring'), ('brands', 'brand', 'Brand#1'), ('types', 'type', 'PROMO')"


@query(
    "c13_conflict_notes",
    f"""WITH c(conflict, kind, v) AS (VALUES {CONFLICTS}),
    s AS (SELECT conflict, p_partkey FROM c, part WHERE (kind = 'word' AND list_contains(string_split(p_name, ' '), v)) OR (kind = 'brand' AND p_brand = v) OR (kind = 'type' AND split_part(p_type, ' ', 1) = v))
    SELECT conflict, p_partkey FROM s WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)""",
)
def c13_conflict_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes that a register of conflicts asks for, without the entries that have one: equi-joins on what selects them."""
    kinds = F.array_union(
        F.transform(F.split("p_name", " "), lambda w: F.struct(F.lit("word").alias("kind"), w.alias("v"))),
        F.array(F.struct(F.lit("brand").alias("kind"), F.col("p_brand").alias("v")), F.struct(F.lit("type").alias("kind"), F.substring_index("p_type", " ", 1).alias("v"))),
    )
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(kinds).alias("s")).select("p_partkey", "s.*")
    found = p.join(F.broadcast(inline(spark, CONFLICTS, "conflict, kind, v")), ["kind", "v"]).select("conflict", "p_partkey").distinct()  # three rows
    noted = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return found.join(noted, "p_partkey", "left_anti")


@query(
    "wn10_regressions",
    """WITH m AS (SELECT p_brand AS metric, p_partkey % 2 = 0 AS before, count(*) FILTER (p_size >= 25) AS passed, count(*) FILTER (p_size > 3) // 8 AS of FROM part WHERE p_partkey % 2 = 0 OR p_brand <> 'Brand#7' GROUP BY 1, 2)
    SELECT b.metric, b.passed AS was, n.passed AS now, CASE WHEN n.metric IS NULL THEN 'missing' WHEN b.of <> n.of THEN 'denominator' ELSE 'fell' END AS fault
    FROM (SELECT * FROM m WHERE before) b LEFT JOIN (SELECT * FROM m WHERE NOT before) n USING (metric) WHERE n.metric IS NULL OR b.of <> n.of OR n.passed < b.passed""",
)
def wn10_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics (by brand, of the odd parts) against a baseline (of the even ones): none may be missing, change its denominator or fall."""
    p = table(spark, sf_dir, "part").withColumn("before", F.col("p_partkey") % 2 == 0).where("before OR p_brand <> 'Brand#7'")
    m = p.groupBy(F.col("p_brand").alias("metric"), "before").agg(F.count_if(F.col("p_size") >= 25).alias("passed"), F.floor(F.count_if(F.col("p_size") > 3) / 8).alias("of"))
    was = m.where("before").select("metric", F.col("passed").alias("was"), F.col("of").alias("was_of"))
    now = m.where("NOT before").select("metric", F.col("passed").alias("now"), F.col("of").alias("now_of"))
    fault = F.when(F.col("now").isNull(), "missing").when(F.col("was_of") != F.col("now_of"), "denominator").when(F.col("now") < F.col("was"), "fell")
    return was.join(now, "metric", "left").select("metric", "was", "now", fault.alias("fault")).where("fault IS NOT NULL")


# Of a part: a stem, and by its key how class, headword and recorded plural are made of it.
_NOUNS = {
    "w": "split_part(p_name, ' ', 1)", "h": "left(split_part(p_name, ' ', 1), 1)",
    "noun_class": "CASE p_partkey % 11 WHEN 0 THEN '7' WHEN 1 THEN '7' WHEN 2 THEN '1' WHEN 3 THEN '1a' WHEN 4 THEN '5' WHEN 5 THEN '3' WHEN 6 THEN '6' WHEN 7 THEN '7' WHEN 8 THEN '7' WHEN 9 THEN '1' ELSE '9' END",
    "headword": "CASE p_partkey % 11 WHEN 0 THEN 'chi' || w WHEN 1 THEN 'chi' || w WHEN 2 THEN 'mu' || w WHEN 7 THEN 'chiN' || w WHEN 8 THEN 'chi' WHEN 9 THEN w ELSE w END",
    "recorded": "CASE p_partkey % 11 WHEN 0 THEN 'zvi-' WHEN 1 THEN 'zvi' || h || '- (M)' WHEN 2 THEN 'va' || h || '-' WHEN 3 THEN 'vana-' WHEN 4 THEN 'ma' || w || ' (Z)' WHEN 5 THEN '' WHEN 6 THEN 'mab-' WHEN 7 THEN 'zvi-' WHEN 8 THEN 'zvi-' WHEN 9 THEN 'va-' ELSE 'of ' || w || ' x' END",
}


@query(
    "pl01_plurals",
    f"""WITH n AS (SELECT p_partkey, {", ".join(f"{v} AS {k}" for k, v in _NOUNS.items() if k in "wh")} FROM part), m AS (SELECT *, p_partkey % 11 AS r, {", ".join(f"{v} AS {k}" for k, v in _NOUNS.items() if k not in "wh")} FROM n)
    SELECT p_partkey, headword, noun_class, recorded, CASE WHEN r IN (0, 1) THEN 'zvi' || w WHEN r = 2 THEN 'va' || w WHEN r = 3 THEN 'vana' || w WHEN r = 4 THEN 'ma' || w END AS surface,
      CASE r WHEN 0 THEN 'prefix_plus_stem' WHEN 1 THEN 'literal_prefix' WHEN 2 THEN 'literal_prefix' WHEN 3 THEN 'prefix_plus_stem' WHEN 4 THEN 'recorded_form' END AS basis,
      CASE WHEN r = 3 THEN 'honorific' WHEN r < 5 THEN 'standard' END AS kind,
      CASE r WHEN 5 THEN 'NO_RECORDED_PLURAL' WHEN 6 THEN 'PLURAL_CLASS_UNVERIFIED' WHEN 7 THEN 'PLURAL_NASAL_PLACEHOLDER' WHEN 8 THEN 'PLURAL_EMPTY_STEM' WHEN 9 THEN 'PLURAL_ALLOMORPH_UNVERIFIED' WHEN 10 THEN 'PLURAL_NOT_A_PREFIX' END AS code FROM m""",
)
def pl01_plurals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plurals of nouns composed from the parts, or the code of what forbids one."""
    d = table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # much work for few bytes
    for name, sql in _NOUNS.items():
        d = d.withColumn(name, F.expr(sql))
    d = d.withColumn("d", plurals.derived(F.col("headword"), F.col("noun_class"), F.col("recorded")))
    return d.select("p_partkey", "headword", "noun_class", "recorded", "d.*")
