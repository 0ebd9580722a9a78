"""Queries over running text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import orthography as ort
from quern.functions import similarity as sim
from quern.operators import ordered
from quern.plans.base import query, table

_FOLD = "replace(lower({x}), 'ß', 'ss')"
_NORM = r"ltrim(trim(regexp_replace(" + _FOLD + r", '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g')), '†*-')"
_WORDS = (
    "SELECT DISTINCT unnest(regexp_extract_all(" + _FOLD.format(x="text") + ", '[^\\x20\\x09-\\x0D]+')) AS word FROM documents"
)
_GRAPHEMES = f"regexp_extract_all(word, '{ort.GRAPHEME}', 1)"
_SYLLABLES = f"regexp_extract_all(word, '{ort.SYLLABLE}', 1)"


def distinct_words(spark: SparkSession, sf_dir: str, begin: str = "") -> DataFrame:
    """The distinct words of the documents, folded; with ``begin`` (a grapheme), those that begin so.

    Words are made distinct as they are written, and folded afterwards: folding looks at single characters.
    (The count keeps the two steps apart in the plan.)
    """
    word = F.explode(F.split("text", r"[\x20\x09-\x0D]+"))
    d = table(spark, sf_dir, "documents").select(word.alias("word")).where("word <> ''").groupBy("word").count()
    d = d.where("count > 0").select(ort.casefold(F.col("word")).alias("word"))
    return d.where(F.col("word").startswith(begin)).distinct()


@query(
    "grapheme_lengths",
    f"""WITH w AS (SELECT lang, unnest(regexp_extract_all({_FOLD.format(x="text")}, '[^\\x20\\x09-\\x0D]+')) AS word FROM documents)
    SELECT lang, CAST(len({_GRAPHEMES}) AS BIGINT) AS grapheme_count, count(*) AS words FROM w GROUP BY ALL""",
)
def grapheme_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(ort.casefold(F.col("text")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # each distinct word of a language is segmented once
    w = table(spark, sf_dir, "documents").select("lang", F.explode(found).alias("word")).groupBy("lang", "word").count()
    w = w.withColumn("grapheme_count", F.size(ort.graphemes(F.col("word"))).cast("long"))
    return w.groupBy("lang", "grapheme_count").agg(F.sum("count").alias("words"))


@query("s01_normalize", f"SELECT doc_id, {_NORM.replace('{x}', 'text')} AS normalized FROM documents")
def s01_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ort.normalized(F.col("text")).alias("normalized"))


@query(
    "s03_graphemes",
    f"SELECT word, array_to_string({_GRAPHEMES}, ' ') AS graphemes, CAST(len({_GRAPHEMES}) AS BIGINT) AS grapheme_count FROM ({_WORDS})",
)
def s03_graphemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = distinct_words(spark, sf_dir).withColumn("g", ort.graphemes(F.col("word")))
    return w.select("word", F.array_join("g", " ").alias("graphemes"), F.size("g").cast("long").alias("grapheme_count"))


@query(
    "s04_syllables",
    f"SELECT word, array_to_string({_SYLLABLES}, ' ') AS syllables, CAST(len({_SYLLABLES}) AS BIGINT) AS syllable_count FROM ({_WORDS})",
)
def s04_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = distinct_words(spark, sf_dir).withColumn("s", ort.syllables(F.col("word")))
    return w.select("word", F.array_join("s", " ").alias("syllables"), F.size("s").cast("long").alias("syllable_count"))


_TRIGRAMS = "list_distinct(list_transform(generate_series(1, CAST(length({x}) + 2 AS BIGINT)), lambda i: substring('  ' || {x} || '  ', i, 3)))"
NEEDLE = "red rings"


@query(
    "s06_similarity",
    f"""WITH t AS (SELECT p_partkey, p_name, {_TRIGRAMS.format(x="p_name")} AS a, {_TRIGRAMS.format(x=f"'{NEEDLE}'")} AS b FROM part),
    s AS (SELECT *, len(list_intersect(a, b)) AS shared, len(a) + len(b) - len(list_intersect(a, b)) AS either FROM t)
    SELECT p_partkey, p_name, CAST(shared AS BIGINT) AS shared, CAST(either AS BIGINT) AS either, CAST(shared AS DOUBLE) / either AS similarity
    FROM s WHERE 10 * shared >= 3 * either""",
)
def s06_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    both, either = sim.shared(sim.trigrams(F.col("p_name")), sim.trigrams(F.lit(NEEDLE)))
    p = p.select("p_partkey", "p_name", both.cast("long").alias("shared"), either.cast("long").alias("either"))
    return p.withColumn("similarity", F.col("shared") / F.col("either")).where("10 * shared >= 3 * either")


PATTERN = "s?a*"


@query(
    "s09_pattern",
    f"""SELECT word, CAST(len({_GRAPHEMES}) AS BIGINT) AS grapheme_count FROM ({_WORDS})
    WHERE regexp_matches(array_to_string({_GRAPHEMES}, chr(1)) || chr(1), '{ort.pattern_regex(PATTERN)}') ORDER BY word LIMIT 50""",
)
def s09_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 words that a grapheme pattern matches (a report of that length)."""
    first = ort.split_pattern(PATTERN)[0]
    w = distinct_words(spark, sf_dir, "" if first in "?*" else first).where(ort.matches(F.col("word"), PATTERN))
    return w.select("word", F.size(ort.graphemes(F.col("word"))).cast("long").alias("grapheme_count")).orderBy("word").limit(50)


@query(
    "s13_homoglyphs",
    f"""SELECT lang, count(*) AS documents, count(*) FILTER (translate(text, '{ort.CYRILLIC}', '{ort.LATIN}') <> text) AS changed
    FROM documents GROUP BY lang""",
)
def s13_homoglyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(
        F.count("*").alias("documents"), F.count_if(ort.latin(F.col("text")) != F.col("text")).alias("changed")
    )


@query(
    "s19_text_key",
    """WITH k AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS key FROM documents)
    SELECT left(key, 60) AS short_key, count(*) AS rows, count(DISTINCT key) AS full_keys, min(doc_id) AS first_id
    FROM k WHERE key <> '' GROUP BY 1 HAVING count(*) > 1""",
)
def s19_text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ort.identity_key(F.col("text"))
    # the second key only tells texts apart, so a digest of it is shuffled
    d = table(spark, sf_dir, "documents").select("doc_id", F.left(key, F.lit(60)).alias("short_key"), F.sha2(key, 256).alias("k"))
    d = d.where("short_key <> ''").groupBy("short_key", "k").agg(F.count("*").alias("n"), F.min("doc_id").alias("m"))
    d = d.groupBy("short_key").agg(F.sum("n").alias("rows"), F.count("*").alias("full_keys"), F.min("m").alias("first_id"))
    return d.where("rows > 1")


CONFUSABLE = ("vw", "bh", "ij", "mn", "uo")


@query(
    "s20_confusable",
    f"""WITH w AS ({_WORDS}), t AS (SELECT word FROM w WHERE length(word) >= 4),
    h AS (SELECT word, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS hole, substr(word, i, 1) AS c
      FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM t) WHERE substr(word, i, 1) IN ({", ".join(f"'{c}'" for c in sorted(set("".join(CONFUSABLE))))}))
    SELECT a.word AS left_word, b.word AS right_word, CAST(a.i AS BIGINT) AS place FROM h a JOIN h b ON a.hole = b.hole AND a.i = b.i
    WHERE a.word < b.word AND (a.c || b.c) IN ({", ".join(f"'{p}'" for x in CONFUSABLE for p in (x, x[::-1]))})""",
)
def s20_confusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words one confusable letter apart, met by an equi-join on the word with that letter left open."""
    w = distinct_words(spark, sf_dir).where(F.length("word") >= 4)
    letters = F.array(*map(F.lit, sorted(set("".join(CONFUSABLE)))))
    places = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.array_contains(letters, F.substring(F.col("word"), i, F.lit(1))))
    w = w.select("word", F.explode(places).alias("i"))
    c = F.substring("word", F.col("i"), F.lit(1))
    hole = F.concat(F.substring("word", F.lit(1), F.col("i") - 1), F.lit("_"), F.substring("word", F.col("i") + 1, F.length("word")))
    h = w.select("word", "i", hole.alias("hole"), c.alias("c"))
    a, b = h.select(F.col("word").alias("left_word"), "i", "hole", F.col("c").alias("ca")), h.withColumnRenamed("word", "right_word")
    pairs = [p for x in CONFUSABLE for p in (x, x[::-1])]
    j = a.join(b, ["hole", "i"]).where((F.col("left_word") < F.col("right_word")) & F.concat("ca", "c").isin(pairs))
    return j.select("left_word", "right_word", F.col("i").cast("long").alias("place"))


@query(
    "j01_example_pairs",
    """WITH s AS (SELECT conv_id, turn, strpos(text, ':') AS p, trim(text) AS text FROM conversations),
    t AS (SELECT conv_id, turn, text, trim(split_part(text, ':', 1)) AS a, CASE WHEN strpos(text, ':') > 0 THEN trim(substr(text, strpos(text, ':') + 1)) ELSE '' END AS b FROM s)
    SELECT conv_id, turn, CASE WHEN a <> '' AND b <> '' THEN a ELSE text END AS example, CASE WHEN a <> '' AND b <> '' THEN b END AS translation FROM t WHERE text <> ''""",
)
def j01_example_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example and translation, split at the first colon if both sides have text."""
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim("text").alias("text")).where("text <> ''")
    at = F.locate(":", F.col("text"))
    d = d.withColumn("a", F.trim(F.substring_index("text", ":", 1)))
    d = d.withColumn("b", F.when(at > 0, F.trim(F.substring("text", at + 1, F.length("text")))).otherwise(""))
    both = (F.col("a") != "") & (F.col("b") != "")
    return d.select("conv_id", "turn", F.when(both, F.col("a")).otherwise(F.col("text")).alias("example"), F.when(both, F.col("b")).alias("translation"))


@query(
    "j05_split_senses",
    r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '\s+([2-9]\.\s)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM documents)
    SELECT doc_id, CAST(i AS BIGINT) AS sense, trim(regexp_replace(parts[i], '^[1-9]\.\s+', '')) AS definition
    FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM s)""",
)
def j05_split_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(F.regexp_replace("text", r"\s+([2-9]\.\s)", "\x01$1"), "\x01")
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("i", "part"))
    return d.select(
        "doc_id", (F.col("i") + 1).cast("long").alias("sense"), F.trim(F.regexp_replace("part", r"^[1-9]\.\s+", "")).alias("definition")
    )


@query(
    "src06_assembly",
    """WITH l AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
    g AS (SELECT doc_id, n, line, sum(CASE WHEN regexp_matches(line, '^[A-Z][a-z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS unit FROM l)
    SELECT doc_id, CAST(unit AS BIGINT) AS unit, min(n) AS first_line, max(n) AS last_line, md5(string_agg(line, ' ' ORDER BY n)) AS text_md5
    FROM g GROUP BY doc_id, unit""",
)
def src06_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines put together into units that each begin with a header line; lines before the first are unit 0."""
    from pyspark.sql.window import Window

    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    header = F.col("line").rlike("^[A-Z][a-z]").cast("long")
    d = d.withColumn("unit", F.sum(header).over(Window.partitionBy("doc_id").orderBy("n"))).withColumn("n", (F.col("n") + 1).cast("long"))
    d = d.groupBy("doc_id", "unit").agg(
        F.min("n").alias("first_line"), F.max("n").alias("last_line"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines")
    )
    return d.select("doc_id", "unit", "first_line", "last_line", F.md5(F.array_join("lines.line", " ")).alias("text_md5"))


@query(
    "srt10_stratified",
    """SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id || '|7'), doc_id) AS n FROM documents) WHERE n <= 18""",
)
def srt10_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stratified sample: 18 documents for each language and source."""
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    order = [F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|7")).cast("binary")), F.col("doc_id")]
    return ordered.firsts(d, ["lang", "source"], order, 18)


@query(
    "c09_frequency",
    f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
    n AS (SELECT word, count(*) AS n FROM w GROUP BY word), x AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS entry FROM part)
    SELECT entry, CAST(coalesce(n, 0) AS BIGINT) AS occurrences, CASE WHEN n IS NULL THEN 'unseen' WHEN n >= 5 THEN 'common' ELSE 'rare' END AS tier
    FROM x LEFT JOIN n ON entry = word""",
)
def c09_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("entry"))
    n = d.groupBy("entry").agg(F.count("*").alias("n"))
    x = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("entry")).distinct()
    tier = F.when(F.col("n").isNull(), "unseen").when(F.col("n") >= 5, "common").otherwise("rare")
    return x.join(n, "entry", "left").select("entry", F.coalesce("n", F.lit(0)).alias("occurrences"), tier.alias("tier"))
