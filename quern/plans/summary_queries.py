"""Counts, rates and roll-ups, scalar functions over spellings, and small JSON steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import labels, spelling
from quern.functions import orthography as ort
from quern.plans.base import query, table


def words_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("ag02_conditional", "SELECT lang, count(*) FILTER (quality = 1 AND n_chars > 500) AS good_and_long FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def ag02_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count_if((F.col("quality") == 1) & (F.col("n_chars") > 500)).alias("good_and_long"))


@query("ag03_rates", "SELECT o_orderpriority, round_even(count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 4) AS rate, round_even(100 * count(*) FILTER (o_orderstatus = 'P') / CAST(count(*) AS DOUBLE), 2) AS percent FROM orders GROUP BY 1")
def ag03_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = lambda s, by, digits: F.when(F.count("*") == 0, 0.0).otherwise(F.bround(by * F.count_if(F.col("o_orderstatus") == s) / F.count("*"), digits))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(rate("F", 1, 4).alias("rate"), rate("P", 100, 2).alias("percent"))


@query(
    "ag05_markers",
    """WITH m AS (SELECT unnest([CASE WHEN p_size % 3 = 0 THEN p_type END, CASE WHEN p_size % 3 = 1 THEN p_brand END, CASE WHEN p_size % 3 = 2 THEN 'unknown' END]) AS key FROM part) SELECT key, count(*) AS times FROM m WHERE key IS NOT NULL GROUP BY 1 ORDER BY times DESC, key LIMIT 15""",
)
def ag05_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers by code, else path, else message, else unknown; the most common ones first."""
    s = F.col("p_size") % 3
    marker = F.struct(F.when(s == 0, F.col("p_type")).alias("code"), F.when(s == 1, F.col("p_brand")).otherwise("").alias("path"), F.lit(" ").alias("message"))
    clean = [F.nullif(F.trim(f"m.{c}"), F.lit("")) for c in ("code", "path", "message")]
    d = table(spark, sf_dir, "part").select(F.explode(F.array(marker)).alias("m")).select(F.coalesce(*clean, F.lit("unknown")).alias("key"))
    return d.groupBy("key").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "key").limit(15)


@query(
    "ag09_snapshot",
    """SELECT 'orders' AS measure, count(*) AS n FROM orders UNION ALL SELECT 'open orders', count(*) FILTER (o_orderstatus = 'O') FROM orders UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'labelled', count(*) FROM labels UNION ALL SELECT 'customers without orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def ag09_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    idle = c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    one = lambda name, d, n=F.count("*"): d.agg(n.alias("n")).select(F.lit(name).alias("measure"), "n")
    out = one("orders", o).union(one("open orders", o, F.count_if(F.col("o_orderstatus") == "O"))).union(one("documents", table(spark, sf_dir, "documents")))
    return out.union(one("labelled", table(spark, sf_dir, "labels"))).union(one("customers without orders", idle))


@query("ag10_duplicates", "SELECT p_partkey, count(*) OVER (PARTITION BY lower(p_name), p_brand) AS copies FROM part")
def ag10_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many share each row's normalised key: counted once and joined back, so no group sits in one window."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("key"), "p_brand")
    return p.join(p.groupBy("key", "p_brand").agg(F.count("*").alias("copies")), ["key", "p_brand"]).select("p_partkey", "copies")


@query("ag14_singletons", "SELECT o_custkey, min(o_orderpriority) AS only FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1")
def ag14_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("s"))
    return s.where(F.size("s") == 1).select("o_custkey", F.get("s", F.lit(0)).alias("only"))


@query(
    "ag15_entry_quality",
    """SELECT o_orderkey, count(l_orderkey) AS lines, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_returnflag <> 'R') AS kept, count(*) FILTER (l_linestatus = 'O') AS open_lines, count(*) FILTER (l_discount > 0.05) AS discounted, count(*) FILTER (l_quantity >= 40) AS large, count(*) FILTER (l_tax = 0) AS untaxed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def ag15_entry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight counts over an entry's nested rows."""
    line = F.struct("l_suppkey", "l_returnflag", "l_linestatus", "l_discount", "l_quantity", "l_tax")
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("x"))
    n = table(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey")
    some = lambda f: F.size(F.filter("x", f)).cast("long")
    return n.select(
        "o_orderkey", F.size("x").cast("long").alias("lines"), F.size(F.array_distinct("x.l_suppkey")).cast("long").alias("suppliers"),
        some(lambda r: r["l_returnflag"] == "R").alias("returned"), some(lambda r: r["l_returnflag"] != "R").alias("kept"),
        some(lambda r: r["l_linestatus"] == "O").alias("open_lines"), some(lambda r: r["l_discount"] > 0.05).alias("discounted"),
        some(lambda r: r["l_quantity"] >= 40).alias("large"), some(lambda r: r["l_tax"] == 0).alias("untaxed"),
    )


@query("ag17_collisions", "SELECT left(p_name, 3) || p_size AS entry, count(*) AS units, min(p_partkey) AS first_unit FROM part GROUP BY 1 HAVING count(*) > 1")
def ag17_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.left("p_name", F.lit(3)), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").groupBy(entry.alias("entry")).agg(F.count("*").alias("units"), F.min("p_partkey").alias("first_unit")).where("units > 1")


@query(
    "ag19_declared",
    """WITH d(metric, bucket, declared) AS (VALUES ('filled', 'F', 8000), ('open', 'O', 6000), ('partial', 'P', 900)), n AS (SELECT o_orderstatus AS bucket, count(*) FILTER (o_totalprice > 1000) AS hits FROM orders GROUP BY 1)
    SELECT metric, declared, least(hits, declared) AS numerator, hits > declared AS overflow FROM d LEFT JOIN n USING (bucket)""",
)
def ag19_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over declared denominators, which no count can change."""
    d = spark.createDataFrame([("filled", "F", 8000), ("open", "O", 6000), ("partial", "P", 900)], "metric string, bucket string, declared int")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("bucket")).agg(F.count_if(F.col("o_totalprice") > 1000).alias("hits"))
    return d.join(n, "bucket", "left").select("metric", "declared", F.least("hits", F.col("declared").cast("long")).alias("numerator"), (F.col("hits") > F.col("declared")).alias("overflow"))


@query("ag21_winner", "SELECT l_suppkey, arg_max(l_partkey, (n, -l_partkey)) AS winner, max(n) AS lines FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def ag21_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return n.groupBy("l_suppkey").agg(F.max_by("l_partkey", F.struct("n", -F.col("l_partkey"))).alias("winner"), F.max("n").alias("lines"))


@query("ag22_label_merge", "SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), 'red') THEN replace(p_name, ' ', ',') ELSE replace(p_name, ' ', ',') || ',red' END AS merged FROM part WHERE split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)")
def ag22_label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with another added at the end, unless it is there; in the order seen first."""
    w = F.split("p_name", " ")
    return table(spark, sf_dir, "part").where(w[0] != w[1]).select("p_partkey", F.array_join(F.array_union(w, F.array(F.lit("red"))), ",").alias("merged"))


@query("ag24_separation", """WITH m AS (SELECT median(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS a, median(c_acctbal) FILTER (c_mktsegment <> 'BUILDING') AS b FROM customer) SELECT (a + b) / 2 AS midpoint, avg(CASE WHEN (c_mktsegment = 'BUILDING') = (CASE WHEN a >= b THEN c_acctbal >= (a + b) / 2 ELSE c_acctbal < (a + b) / 2 END) THEN 1.0 ELSE 0.0 END) AS right_share FROM customer, m GROUP BY 1""")
def ag24_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of two medians, and the share of rows on their own side of it."""
    own = F.col("c_mktsegment") == "BUILDING"
    c = table(spark, sf_dir, "customer").select("c_acctbal", own.alias("own"))
    m = c.agg(F.median(F.when(F.col("own"), F.col("c_acctbal"))).alias("a"), F.median(F.when(~F.col("own"), F.col("c_acctbal"))).alias("b"))
    c = c.join(F.broadcast(m)).withColumn("midpoint", (F.col("a") + F.col("b")) / 2)  # one row
    side = F.when(F.col("a") >= F.col("b"), F.col("c_acctbal") >= F.col("midpoint")).otherwise(F.col("c_acctbal") < F.col("midpoint"))
    return c.groupBy("midpoint").agg(F.avg((F.col("own") == side).cast("double")).alias("right_share"))


@query("ag25_ranges", "SELECT c_mktsegment, min(c_acctbal) AS low, max(c_acctbal) AS high, count(*) AS n FROM customer GROUP BY 1")
def ag25_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.count("*").alias("n"))


@query(
    "ag26_rollup",
    """WITH i AS (SELECT source, unnest([CASE WHEN quality = 0 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars < 200 THEN 'short' END]) AS issue FROM documents LEFT JOIN labels USING (doc_id))
    SELECT source, count(*) FILTER (issue IN ('quality', 'toxic')) AS errors, count(*) FILTER (issue = 'short') AS infos, CASE WHEN count(*) FILTER (issue IN ('quality', 'toxic')) > 0 THEN 'error' WHEN count(issue) > 0 THEN 'info' ELSE 'clean' END AS status FROM i GROUP BY 1""",
)
def ag26_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    issues = F.array(F.when(F.col("quality") == 0, "quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("n_chars") < 200, "short"))
    d = d.select("source", F.explode(issues).alias("issue"))
    d = d.groupBy("source").agg(F.count_if(F.col("issue").isin("quality", "toxic")).alias("errors"), F.count_if(F.col("issue") == "short").alias("infos"))
    return d.withColumn("status", F.when(F.col("errors") > 0, "error").when(F.col("infos") > 0, "info").otherwise("clean"))


# ---- spellings

_G = f"regexp_extract_all({{x}}, '{ort.GRAPHEME}', 1)"
_S = f"regexp_extract_all({{x}}, '{ort.SYLLABLE}', 1)"


@query("s02_casefold", "SELECT doc_id, md5(replace(lower(text), 'ß', 'ss')) AS folded FROM documents WHERE text LIKE '%ß%'")
def s02_casefold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").contains("ß"))
    return d.select("doc_id", F.md5(ort.casefold(F.col("text"))).alias("folded"))


@query("s05_phonology", f"""WITH w AS (SELECT p_partkey, '-' || split_part(p_name, ' ', 1) || '  ' || split_part(p_name, ' ', 2) AS t, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
    SELECT p_partkey, array_to_string(list_concat({_G.format(x='a')}, {_G.format(x='b')}), ' ') AS graphemes, array_to_string(list_concat({_S.format(x='a')}, {_S.format(x='b')}), ' ') AS syllables, CAST(len({_S.format(x='a')}) + len({_S.format(x='b')}) AS INTEGER) AS syllable_count FROM w""")
def s05_phonology(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("p_name", " ")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("-"), w[0], F.lit("  "), w[1]).alias("t"))
    p = p.select("p_partkey", spelling.phonology(F.col("t")).alias("f"))
    return p.select("p_partkey", F.array_join("f.graphemes", " ").alias("graphemes"), F.array_join("f.syllables", " ").alias("syllables"), "f.syllable_count")


_WT = "list_distinct(flatten(list_transform(string_split({x}, ' '), lambda w: list_transform(generate_series(1, CAST(length(w) + 1 AS BIGINT)), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query("s07_word_trigrams", f"""WITH n AS (SELECT DISTINCT p_name FROM part), q(q) AS (VALUES ('red ring'), ('bleu bolt'), ('smal widget')), t AS (SELECT q, p_name, {_WT.format(x='q')} AS a, {_WT.format(x='p_name')} AS b FROM q, n)
    SELECT q, p_name, CAST(len(list_intersect(a, b)) AS INTEGER) AS shared, CAST(len(a) + len(b) - len(list_intersect(a, b)) AS INTEGER) AS either FROM t WHERE 10 * len(list_intersect(a, b)) >= 3 * (len(a) + len(b) - len(list_intersect(a, b)))""")
def s07_word_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness by the trigrams of words, through an inverted list: what is 0.3 alike shares one at least."""
    gram = lambda d, c: d.withColumn("g", spelling.word_trigrams(F.col(c))).withColumn(f"n_{c}", F.size("g")).withColumn("g", F.explode("g"))
    q = gram(spark.createDataFrame([("red ring",), ("bleu bolt",), ("smal widget",)], "q string"), "q")
    n = gram(table(spark, sf_dir, "part").select("p_name").distinct(), "p_name")
    m = q.join(n, "g").groupBy("q", "p_name", "n_q", "n_p_name").agg(F.count("*").cast("int").alias("shared"))
    m = m.withColumn("either", F.col("n_q") + F.col("n_p_name") - F.col("shared"))
    return m.where("10 * shared >= 3 * either").select("q", "p_name", "shared", "either")


_PATTERN = "CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '?') WHEN 1 THEN upper(replace(p_name, ' ', '*')) WHEN 2 THEN '*' || left(p_name, 2) || '??' ELSE 'ngw' || replace(p_name, ' ', 'sh') END"


@query("s10_pattern_bounds", f"SELECT p_partkey, p, len(list_filter(regexp_extract_all(lower(p), '{ort.GRAPHEME}', 1), lambda g: g <> '*'))::INTEGER AS low, CASE WHEN NOT contains(p, '*') THEN len(regexp_extract_all(lower(p), '{ort.GRAPHEME}', 1))::INTEGER END AS high FROM (SELECT p_partkey, {_PATTERN} AS p FROM part)")
def s10_pattern_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many graphemes a pattern composed from a part's name can match."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_PATTERN).alias("p"))
    low, high = ort.pattern_bounds_of(F.col("p"))
    return p.select("p_partkey", "p", low.alias("low"), high.alias("high"))


@query("s12_public_id", """WITH h AS (SELECT p_partkey, md5('u' || p_partkey) AS h FROM part), b AS (SELECT p_partkey, h, array_to_string(list_transform(generate_series(1, 32), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][CAST(strpos('0123456789abcdef', substr(h, i, 1)) AS BIGINT)]), '') || '00' AS bits FROM h)
    SELECT p_partkey, 'lem_' || array_to_string(list_transform(generate_series(0, 25), lambda j: substr('abcdefghijklmnopqrstuvwxyz234567', 1 + list_sum(list_transform(generate_series(1, 5), lambda k: CAST(substr(bits, 5 * j + k, 1) AS INTEGER) * [16, 8, 4, 2, 1][k]))::BIGINT, 1)), '') AS public_id FROM b""")
def s12_public_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).cast("binary"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return table(spark, sf_dir, "part").select("p_partkey", spelling.public_id("lem", uuid).alias("public_id"))


@query("s14_dialect_tag", "SELECT p_partkey, split_part(p_name, ' ', 1) || '-' AS form FROM part")
def s14_dialect_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms tagged in three ways, read back without the tag."""
    tag = F.element_at(F.array(*map(F.lit, ("", " (M)", " KMZ"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    form = F.concat(F.substring_index("p_name", " ", 1), F.lit("-"), tag)
    return table(spark, sf_dir, "part").select("p_partkey", spelling.without_dialect(form).alias("form"))


@query("s15_clusters", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'K,M,Z' WHEN 1 THEN 'K,Ko' WHEN 2 THEN '' ELSE 'Ko' END AS dialects FROM part")
def s15_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.element_at(F.array(*map(F.lit, ("KMZ", "KKo", "KMx", "Ko"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(labels.dialects(run), ",").alias("dialects"))


@query("s16_first_token", "SELECT doc_id, split_part(ltrim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g')), ' ', 1) AS token FROM documents")
def s16_first_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)", 1).alias("token"))


@query("s17_slug", "SELECT url, coalesce(nullif(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'entry') AS slug FROM pages")
def s17_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", spelling.slug(F.col("url")).alias("slug"))


@query("s18_locator", "SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_size END AS page, CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_partkey % 97 AS INTEGER) END AS entry FROM part")
def s18_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.format_string("book:page_%03d:entry_%03d:%s", F.col("p_size"), F.col("p_partkey") % 97, F.replace("p_name", F.lit(" "), F.lit("-")))
    x = spelling.locator(F.when(F.col("p_partkey") % 10 == 0, "book:loose").otherwise(made))
    return table(spark, sf_dir, "part").select("p_partkey", x.alias("l")).select("p_partkey", "l.page", "l.entry")


@query("s21_tone_key", "SELECT p_partkey, upper(replace(p_name, ' ', '')) AS key FROM part")
def s21_tone_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", spelling.tone_key(F.col("p_name")).alias("key"))


@query("s23_residue", "SELECT p_partkey, p_partkey % 5 < 4 AS residue FROM part")
def s23_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with brackets, a reference, a final stop or too many letters, and clean ones."""
    tail = F.element_at(F.array(*map(F.lit, (" [H]", " cp mota", " .", " " * 1 + "very " * 12, ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", spelling.label_residue(F.concat(F.lower("p_type"), tail)).alias("residue"))


@query("s24_tokens", r"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS t FROM conversations), b AS (SELECT lower(regexp_replace(regexp_replace(t, '^[\p{P}\p{S}]+', ''), '[\p{P}\p{S}]+$', '')) AS t FROM w)
    SELECT t AS token, count(*) AS times FROM b WHERE regexp_matches(t, '^\p{L}[\p{L}''’\-]*$') GROUP BY 1""")
def s24_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("t"))
    w = w.groupBy("t").count().select(spelling.cleaned_token(F.col("t")).alias("token"), "count").where("token IS NOT NULL")
    return w.groupBy("token").agg(F.sum("count").alias("times"))


@query("s25_last_vowel", "SELECT DISTINCT p_name, regexp_extract(p_name, '([aeiou])[^aeiou]*$', 1) AS vowel FROM part")
def s25_last_vowel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.functions import verbs

    return table(spark, sf_dir, "part").select("p_name").distinct().withColumn("vowel", verbs.last_vowel(F.col("p_name")))


@query("s26_vowelless", """SELECT DISTINCT left(w, 1) || 'wa' AS stem, left(w, 1) IN ('a', 'e', 'i', 'o', 'u') AS has_vowel FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)""")
def s26_vowelless(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.left("word", F.lit(1)), F.lit("wa"))
    return words_of_parts(spark, sf_dir).select(stem.alias("stem")).distinct().withColumn("has_vowel", ~spelling.vowelless(F.col("stem")))


@query("s27_digest", """SELECT p_partkey, sha256('{"brand":"' || p_brand || '"' || CASE WHEN p_size > 25 THEN ',"kind":"' || p_type || '"' ELSE '' END || ',"name":"' || p_name || '"}') AS digest FROM part""")
def s27_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (F.col("p_brand").alias("brand"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("kind"), F.col("p_name").alias("name"))
    return table(spark, sf_dir, "part").select("p_partkey", spelling.digest(*fields).alias("digest"))


# ---- numbers and JSON


@query("m04_earliest", "SELECT o_custkey, least(coalesce(min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END), 999999999), 500 + o_custkey) AS first_lesson, greatest(0.5, coalesce(max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 0)) AS score FROM orders GROUP BY 1")
def m04_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier of what is stored and seen, and the greater score; what was not seen changes nothing."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("seen"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("s")
    )
    return o.select("o_custkey", F.least("seen", 500 + F.col("o_custkey")).alias("first_lesson"), F.greatest(F.lit(0.5).cast("double"), "s").alias("score"))


@query("m05_confidence", "SELECT p_partkey, CASE WHEN p_size <= 25 AND p_size > 20 THEN p_size / CAST(25 AS DOUBLE) WHEN p_partkey % 3 = 0 THEN 0.2 WHEN p_partkey % 3 = 1 THEN 0.75 ELSE 0.95 END AS confidence FROM part")
def m05_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As given if between 0 and 1; else by errors, by doubts, or high."""
    given = F.when(F.col("p_size") > 20, F.col("p_size") / F.lit(25.0))
    by = F.when(F.col("p_partkey") % 3 == 0, 0.2).when(F.col("p_partkey") % 3 == 1, 0.75).otherwise(0.95)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(given.between(0, 1), given).otherwise(by).alias("confidence"))


@query("m06_percent", "SELECT p_partkey, greatest(0, least(1, (p_size * 3 - 10) / CAST(100 AS DOUBLE))) AS confidence, CASE WHEN p_size * 3 - 10 >= 100 THEN 'parsed' WHEN p_size * 3 - 10 >= 70 THEN 'uncertain' ELSE 'failed' END AS status FROM part")
def m06_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_size") * 3 - 10
    status = F.when(p >= 100, "parsed").when(p >= 70, "uncertain").otherwise("failed")
    return table(spark, sf_dir, "part").select("p_partkey", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p / F.lit(100.0))).alias("confidence"), status.alias("status"))


@query("m07_strict", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 END AS confidence, p_partkey % 4 >= 2 AS rejected FROM part")
def m07_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers only: true, false and words are no confidence."""
    raw = F.element_at(F.array(*map(F.lit, ('{"c": 0.5}', '{"c": 1}', '{"c": true}', '{"c": "high"}'))), (F.col("p_partkey") % 4 + 1).cast("int"))
    c = F.get_json_object(raw, "$.c").try_cast("double")
    c = F.when(c.between(0, 1), c)
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("confidence"), c.isNull().alias("rejected"))


@query("j03_clean_list", "SELECT p_partkey, split_part(p_name, ' ', 1) || ',' || p_type AS cleaned FROM part")
def j03_clean_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of a JSON list, trimmed; blanks, numbers and null left out."""
    raw = F.concat(F.lit('[" '), F.substring_index("p_name", " ", 1), F.lit(' ", "", 7, null, "  ", "'), F.col("p_type"), F.lit('"]'))
    items = F.from_json(raw, "array<variant>")
    texts = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.trim(F.variant_get(v, "$", "string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.filter(texts, lambda x: x != ""), ",").alias("cleaned"))


@query("j07_fallback", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand || '|' || p_type WHEN p_size % 3 = 1 THEN p_type ELSE '' END AS tones FROM part")
def j07_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded tones, else the one pattern, else none."""
    none = F.array().cast("array<string>")
    records = F.when(F.col("p_size") % 3 == 0, F.array("p_brand", "p_type")).otherwise(none)
    pattern = F.when(F.col("p_size") % 3 == 1, F.col("p_type"))
    out = F.when(F.size(records) > 0, records).when(pattern.isNotNull(), F.array(pattern)).otherwise(none)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(out, "|").alias("tones"))


@query("j11_status", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'failed' WHEN p_size % 5 < 3 THEN 'uncertain' ELSE 'parsed' END AS status FROM part")
def j11_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.when(F.col("p_size") % 5 == 0, F.array(F.lit("e"))).alias("errors"), F.when(F.col("p_size") % 5 < 3, F.array(F.lit("u"))).otherwise(F.array().cast("array<string>")).alias("uncertainties")))
    size = lambda f: F.coalesce(F.json_array_length(F.get_json_object(body, f"$.{f}")), F.lit(0))
    status = F.when(size("errors") > 0, "failed").when(size("uncertainties") > 0, "uncertain").otherwise("parsed")
    return table(spark, sf_dir, "part").select("p_partkey", status.alias("status"))


@query("j14_partial_match", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 AND event_type = 'click' AS matches FROM events")
def j14_partial_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an object holds all that is expected of it, by rows of path and value; what is more does not matter."""
    k = F.from_json("props", "struct<k:int>")["k"]
    have = F.array(F.struct(F.lit("even").alias("path"), (k % 2 == 0).cast("string").alias("value")), F.struct(F.lit("type").alias("path"), F.col("event_type").alias("value")), F.struct(F.lit("more").alias("path"), F.lit("x").alias("value")))
    want = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(v).alias("value")) for p, v in (("even", "true"), ("type", "click"))])
    return table(spark, sf_dir, "events").select("event_id", (F.size(F.array_except(want, have)) == 0).alias("matches"))


@query("j15_registry", """WITH r(cls, concord, m) AS (VALUES (0, 'u', 'wa'), (1, 'va', NULL), (2, 'chi', 'ci')) SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN coalesce(m, concord) ELSE concord END AS concord FROM part JOIN r ON p_size % 3 = cls""")
def j15_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class's concord from its registry, a dialect's own going before it."""
    rows = [(0, {"subject": "u"}, {"M": "wa"}), (1, {"subject": "va"}, {}), (2, {"subject": "chi"}, {"M": "ci"})]
    r = spark.createDataFrame(rows, "cls int, concords map<string,string>, overrides map<string,string>")
    p = table(spark, sf_dir, "part").withColumn("cls", F.col("p_size") % 3).join(F.broadcast(r), "cls")  # three rows
    own = F.when(F.col("p_partkey") % 2 == 0, F.try_element_at("overrides", F.lit("M")))
    return p.select("p_partkey", F.coalesce(own, F.try_element_at("concords", F.lit("subject"))).alias("concord"))
