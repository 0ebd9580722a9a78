"""Search and frequency tagging over the words of whole tables.

The lexicon is that of the analysis queries; an entry written in small letters is public, another only reviewed.  The forms
are the words of the documents that are a public entry's headword with an s or n.  Look-ups are the words of the
conversations, tokens those of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import learning
from quern.operators import cascade, evaluation, related, replay
from quern.plans import analysis_queries as verbs
from quern.plans.base import query, table
from quern.sources import jsonl


def dictionary(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (headword, entry, public) and forms (form, entry) of the distinct words."""
    entries = verbs.entries(words).withColumn("public", F.col("entry") == F.col("headword"))
    w = words.where(F.col("word").rlike("^[a-z]+[sn]$")).select(F.col("word").alias("form"), F.expr("left(word, length(word) - 1)").alias("headword"))
    return entries, w.join(entries.where("public"), "headword").select("form", "entry")


_DICTIONARY = r"""words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents),
    entries AS (SELECT w AS entry, lower(w) AS headword, w = lower(w) AS public FROM words WHERE regexp_matches(w, '^[A-Za-z]+(a|ti)$')),
    forms AS (SELECT w AS form, entry FROM words JOIN entries ON public AND headword = left(w, length(w) - 1) WHERE regexp_matches(w, '^[a-z]+[sn]$'))"""
_GRAMS = "list_distinct(list_transform(range(1, length({x}) + 2), lambda i: substring('  ' || {x} || ' ', i, 3)))"
_ASKED = r"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS q FROM conversations"


@query(
    "c01_search",
    rf"""WITH {_DICTIONARY}, asked AS ({_ASKED}),
    lexical AS (SELECT q, 0 AS tier, 0.0 AS o, entry, NULL AS form, NULL::DOUBLE AS similarity FROM asked JOIN entries ON public AND headword = q
      UNION ALL SELECT q, 1, 0.0, entry, form, NULL FROM asked JOIN forms ON form = q),
    left1 AS (SELECT q FROM asked WHERE q NOT IN (SELECT q FROM lexical)),
    read AS (SELECT surface AS q, entry, min(rank) AS rank FROM ({verbs._readings_sql(f"SELECT q AS surface FROM ({_ASKED}) WHERE q NOT IN (WITH {_DICTIONARY} SELECT headword FROM entries WHERE public UNION ALL SELECT form FROM forms)")}) GROUP BY 1, 2),
    left2 AS (SELECT q, {_GRAMS.format(x="q")} AS a FROM left1 WHERE q NOT IN (SELECT q FROM read)),
    known AS (SELECT x, {_GRAMS.format(x="x")} AS b FROM (SELECT headword AS x FROM entries WHERE public UNION SELECT form FROM forms)),
    met AS (SELECT q, x, len(a) AS na, len(b) AS nb, count(*) AS shared FROM (SELECT q, a, unnest(a) AS g FROM left2) JOIN (SELECT x, b, unnest(b) AS g FROM known) USING (g) GROUP BY ALL),
    near AS (SELECT q, x, shared / (na + nb - shared) AS similarity FROM met WHERE 10 * shared >= 3 * (na + nb - shared)),
    found AS (SELECT * FROM lexical UNION ALL SELECT q, 2, rank, read.entry, NULL, NULL FROM read JOIN entries ON public AND entries.entry = read.entry
      UNION ALL SELECT q, 3, -similarity, entry, NULL, similarity FROM near JOIN entries ON public AND headword = x UNION ALL SELECT q, 4, -similarity, entry, form, similarity FROM near JOIN forms ON form = x)
    SELECT q, ['exact_lemma', 'exact_form', 'morphology_lemma', 'fuzzy_lemma', 'fuzzy_form'][tier + 1] AS match,
      row_number() OVER (PARTITION BY q ORDER BY tier, o, entry, form)::INTEGER AS place, entry, form, similarity FROM found QUALIFY place <= 20""",
)
def c01_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the conversations looked up: entries, forms, entries of readings, and likeness where nothing was read."""
    entries, forms = dictionary(verbs.spelled(spark, sf_dir))
    asked = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("q")).distinct()
    return cascade.search(jsonl.kept(asked, "asked"), entries, forms)


def tokens(documents: DataFrame) -> DataFrame:
    """Tokens of the lines: no punctuation round them, inside only hyphens and apostrophes; the lesson is the source's number."""
    lines = documents.select("page", "source", F.posexplode(F.split("text", "\n")).alias("line", "context"))
    lines = lines.withColumn("context", F.trim(F.regexp_replace("context", r"^\s+|\s+$", "")))
    words = lines.withColumn("word", F.explode(F.split("context", r"\s+")))
    word = F.lower(F.regexp_replace("word", r"^[\p{Punct}“”‘’]+|[\p{Punct}“”‘’]+$", ""))
    words = words.withColumn("surface", word).where(F.col("surface").rlike(r"^[a-z0-9']+(?:-[a-z0-9']+)*$"))
    lesson = F.regexp_extract("source", r"(\d+)$", 1)
    return words.select("surface", F.when(lesson != "", lesson.cast("int")).alias("lesson"), "page", "line", "context")


_PUNCT = r"!-/:-@\[-`{-~“”‘’"
_TOKENS = rf"""lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS context, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
    toks AS (SELECT doc_id, TRY_CAST(nullif(regexp_extract(source, '(\d+)$', 1), '') AS INTEGER) AS lesson, line, context,
      lower(regexp_replace(unnest(string_split_regex(context, '\s+')), '^[{_PUNCT}]+|[{_PUNCT}]+$', '', 'g')) AS surface
      FROM (SELECT doc_id, source, line, regexp_replace(context, '^\s+|\s+$', '', 'g') AS context FROM lines)),
    tok AS (SELECT * FROM toks WHERE regexp_matches(surface, '^[a-z0-9'']+(?:-[a-z0-9'']+)*$'))"""


@query(
    "c09_tagging",
    rf"""WITH {_DICTIONARY}, {_TOKENS},
    surf AS (SELECT DISTINCT surface FROM tok),
    res AS (SELECT surface, min(entry) AS entry, 0 AS tier FROM surf JOIN entries ON headword = surface GROUP BY 1
      UNION ALL SELECT surface, min(entry), 1 FROM surf JOIN forms ON form = surface WHERE surface NOT IN (SELECT headword FROM entries) GROUP BY 1
      UNION ALL SELECT surface, entry, 2 FROM ({verbs._readings_sql(f"WITH {_DICTIONARY}, {_TOKENS} SELECT DISTINCT surface FROM tok WHERE surface NOT IN (SELECT headword FROM entries UNION ALL SELECT form FROM forms)")}) WHERE rank = 1),
    hits AS (SELECT entry, tier, t.surface, coalesce(lesson, 1) AS lesson, doc_id, line, left(context, 200) AS context FROM tok t JOIN res USING (surface)),
    by_entry AS (SELECT entry, count(*) AS occurrences, count(DISTINCT surface) AS surfaces, min(tier) AS tier, min({{'l': lesson, 'p': doc_id, 'n': line, 'c': context}}) AS first FROM hits GROUP BY entry),
    scored AS (SELECT *, round_even(greatest(0, least(1, 0.7::DOUBLE * CASE WHEN first.l > 0 THEN 1 - (least(first.l, 30) - 1) / 29.0::DOUBLE ELSE 0 END + 0.3::DOUBLE * least(occurrences / 5.0::DOUBLE, 1))), 3) AS score FROM by_entry)
    SELECT entry, occurrences, surfaces, tier::INTEGER AS tier, first.l::INTEGER AS lesson, first.p AS page, first.c AS context, score::DOUBLE AS score,
      CASE WHEN score >= 0.75 THEN 'core' WHEN score >= 0.4 THEN 'common' WHEN score > 0 THEN 'rare' ELSE 'unseen' END AS frequency_tier, CASE WHEN first.l <= 10 THEN 'beginner' WHEN first.l <= 25 THEN 'intermediate' ELSE 'advanced' END AS level FROM scored""",
)
def c09_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of the documents resolved over the index; entries with their occurrences, earliest lesson, score and level."""
    words = verbs.spelled(spark, sf_dir)
    entries, forms = dictionary(words)
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "source", "text")
    index = cascade.SurfaceIndex.built(cascade.resolution(tokens(documents).select("surface"), entries, forms))
    d = cascade.tagged(documents, index, tokens)
    score = learning.score(F.col("lesson"), F.col("occurrences"))
    return d.withColumns({"score": score, "frequency_tier": learning.tier(score), "level": learning.level(F.col("lesson"))})


#: Forms that a dictionary may list of a verb: some that are read, some that are not, one that must be passed over.
_LISTED = (("ku{a}", ""), ("ndino{a}", ""), ("handi{i}", ""), ("{a}i", ""), ("hava{a}", ""), ("no{a}x", ""), ("ku{a}no", "derived"))


@query(
    "c04_replay",
    rf"""WITH {_DICTIONARY}, f AS (SELECT entry, headword, replace(replace(t, '{{a}}', headword), '{{i}}', left(headword, length(headword) - 1) || 'i') AS form, kind
        FROM entries, (VALUES {", ".join(f"('{t}', '{k}')" for t, k in _LISTED)}) l(t, kind)),
    g AS (SELECT * FROM f WHERE kind <> 'derived' AND CASE WHEN form = 'ku' || headword THEN true WHEN ends_with(form, headword) THEN
        regexp_matches(left(form, length(form) - length(headword)), '^ku|^ha|no$') ELSE regexp_matches(form, '^ku|^ha|no') END),
    r AS (SELECT surface, list_sort(list_distinct(list(entry))) AS e, list_distinct(list(headword)) AS h FROM ({verbs._readings_sql(
        "SELECT DISTINCT replace(replace(t, '{a}', headword), '{i}', left(headword, length(headword) - 1) || 'i') FROM entries, (VALUES " + ", ".join(f"('{t}')" for t, k in _LISTED if not k) + ") l(t)"
    ).replace("s AS (SELECT DISTINCT replace", "s(surface) AS (SELECT DISTINCT replace")}) GROUP BY 1),
    n AS (SELECT g.entry, headword, form, e, CASE WHEN e IS NULL THEN 'unread' WHEN list_contains(e, entry) THEN CASE WHEN len(e) > 1 THEN 'several_entries' END
        WHEN list_contains(h, headword) THEN CASE WHEN len(h) = 1 THEN 'homographs_only' ELSE 'homographs_and_others' END ELSE 'other_headword' END AS note FROM g LEFT JOIN r ON surface = form)
    SELECT entry, headword, form, CASE note WHEN 'unread' THEN 'morphology_unsupported' WHEN 'other_headword' THEN 'wrong_lemma' ELSE CASE WHEN note IS NOT NULL THEN 'ambiguous_result' END END AS category, note,
      CASE WHEN note IN ('unread', 'other_headword') THEN 'error' WHEN note IS NOT NULL THEN 'info' END AS severity,
      CASE WHEN note = 'other_headword' THEN e[1] WHEN note IS NOT NULL THEN list_filter(e, lambda x: x <> entry)[1] END AS actual FROM n""",
)
def c04_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed forms of every entry read again: whether each leads back to its entry, to homographs, elsewhere or nowhere."""
    lex = jsonl.kept(verbs.entries(verbs.spelled(spark, sf_dir)), "entries")
    e = F.expr("left(headword, length(headword) - 1)")
    made = [F.struct(F.replace(F.replace(F.lit(t), F.lit("{a}"), F.col("headword")), F.lit("{i}"), F.concat(e, F.lit("i"))).alias("form"), F.lit(k).alias("kind")) for t, k in _LISTED]
    forms = lex.select("entry", "headword", F.explode(F.array(*made)).alias("f")).select("entry", "headword", "f.*")
    return replay.replayed(forms, lex)


_ASKED_FORMS = r"""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents), entries AS (SELECT w AS entry, lower(w) AS headword FROM words WHERE regexp_matches(w, '^[A-Za-z]+(a|ti)$'))
    SELECT 'ndino' || headword AS surface FROM entries UNION SELECT 'hativa' || regexp_replace(headword, 'a$', 'i') FROM entries WHERE headword <> 'na' AND headword NOT LIKE 'a%'"""


@query(
    "c15_evaluation",
    rf"""WITH {_DICTIONARY}, r AS (SELECT * FROM ({verbs._readings_sql(_ASKED_FORMS)})),
    a AS (SELECT 'finite' AS category, entry, headword, 'ndino' || headword AS form, NULL AS refusal, length(headword) % 5 <> 0 AS ok FROM entries
      UNION ALL SELECT 'object', entry, headword, CASE WHEN headword <> 'na' AND headword NOT LIKE 'a%' THEN 'hativa' || regexp_replace(headword, 'a$', 'i') END,
        CASE WHEN headword = 'na' THEN 'defective_pro_verb_stem' WHEN headword LIKE 'a%' THEN 'object_before_a_initial_stem' END, NOT (length(headword) % 7 = 0 AND (headword = 'na' OR headword LIKE 'a%')) FROM entries),
    m AS (SELECT category, a.entry, form, ok,
      count(*) FILTER (category = 'finite' AND r.entry = a.entry AND subject_features = '1s' AND object IS NULL AND extensions = '') > 0 AS q1,
      count(*) FILTER (category = 'finite' AND lane = 'positive' AND stem = a.headword) > 0 AS q2, count(*) FILTER (category = 'object' AND object = 'va') > 0 AS q3,
      count(*) FILTER (category = 'finite' AND lane = 'negative') > 0 AS p1, count(*) FILTER (category = 'finite' AND r.headword = a.headword AND polarity = 'positive') > 0 AS p2, count(*) FILTER (r.entry = a.entry) > 0 AS back
      FROM a LEFT JOIN r ON surface = form GROUP BY ALL),
    s AS (SELECT category, count(*) AS n, count(*) FILTER (ok) AS gen, count(*) FILTER (q1) + count(*) FILTER (q2) + count(*) FILTER (q3) AS req, count(*) FILTER (p1) + count(*) FILTER (p2) AS pro,
      count(*) FILTER (form IS NOT NULL) AS made, count(*) FILTER (form IS NOT NULL AND back) AS back FROM m GROUP BY 1)
    SELECT category, 'generation' AS measure, gen AS passed, n AS of FROM s
    UNION ALL SELECT category, 'required_recall', req, CASE category WHEN 'finite' THEN 2 * n ELSE n END FROM s
    UNION ALL SELECT category, 'prohibited_absent', CASE category WHEN 'finite' THEN 2 * n ELSE 0 END - pro, CASE category WHEN 'finite' THEN 2 * n ELSE 0 END FROM s
    UNION ALL SELECT category, 'round_trip', back, made FROM s""",
)
def c15_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of every entry, some with wrong expectations, through generation and analysis: what was met of what they declare."""
    lex = jsonl.kept(verbs.entries(verbs.spelled(spark, sf_dir)), "entries")
    no, text = F.lit(False), lambda x: F.lit(x).cast("string")
    size = F.length("headword")
    i = F.regexp_replace("headword", "a$", "i")
    barred = F.when(F.col("headword") == "na", "defective_pro_verb_stem").when(F.col("headword").startswith("a"), "object_before_a_initial_stem")
    js = lambda **x: F.to_json(F.struct(*[v.alias(k) for k, v in x.items()]), {"ignoreNullFields": "false"})
    s = lambda **x: F.struct(*[v.alias(k) for k, v in x.items()])
    common = {"entry": F.col("entry"), "headword": F.col("headword"), "mode": F.lit("finite"), "plural": no, "reflexive": no}
    finite = common | {
        "category": F.lit("finite"), "negative": no, "subject": F.lit("ndi"), "object": text(None),
        "expected_surface": F.concat(F.lit("ndino"), "headword", F.when(size % 5 == 0, "x").otherwise("")), "expected_refusal": text(None),
        "required": F.array(
            js(lemma=s(id=F.col("entry")), slots=s(subject=s(features=F.lit("1s")), object=text(None), extensions=F.array().cast("array<string>"))),
            js(analysis_type=F.lit("positive"), slots=s(verb_stem=F.col("headword"))),
        ),
        "prohibited": F.array(js(analysis_type=F.lit("negative")), js(lemma=s(headword=F.col("headword")), slots=s(polarity=F.lit("positive")))),
    }
    with_object = common | {
        "category": F.lit("object"), "negative": F.lit(True), "subject": F.lit("ti"), "object": F.lit("va"),
        "expected_surface": F.when(barred.isNull(), F.concat(F.lit("hativa"), i)), "expected_refusal": F.when(size % 7 != 0, barred),
        "required": F.array(js(slots=s(object=s(surface=F.lit("va")), number=text(None)))), "prohibited": F.array().cast("array<string>"),
    }
    names = [c.split()[0] for c in evaluation.CASE.split(", ") if not c.startswith("case_id")]
    both = F.array(*[F.struct(*[c[n].alias(n) for n in names]) for c in (finite, with_object)])
    cases = lex.select(F.explode(both).alias("c")).select(F.xxhash64("c.category", "c.entry").alias("case_id"), "c.*")
    return evaluation.measured(evaluation.evaluated(cases, lex.select("headword", "entry")))


@query(
    "c15b_related",
    rf"""WITH {_DICTIONARY}, x AS (SELECT role AS kind, conv_id * 100 + turn AS id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) AS entry FROM conversations WHERE role <> 'system')
    SELECT entry, kind, id, false AS failed FROM x WHERE entry IN (SELECT entry FROM entries) UNION ALL SELECT DISTINCT NULL, role, NULL::BIGINT, true FROM conversations WHERE role = 'system'""",
)
def c15b_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as expressions that link the entries they name; one kind is unreadable and fails alone."""
    c = table(spark, sf_dir, "conversations")
    linked = F.when((F.col("role") == "system") & (F.col("turn") == 0), "[broken").otherwise(F.to_json(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))))
    e = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("kind"), linked.alias("linked"))
    return related.related(e, verbs.entries(verbs.spelled(spark, sf_dir)))
