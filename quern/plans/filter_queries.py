"""Filters, projections, joins, sets and orders over the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import ordered, requests
from quern.plans.base import query, table


@query("flt01_visible", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def flt01_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey")


@query("flt02_optional", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#7' AND p_type = 'SMALL'")
def flt02_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equalities that were asked for; those that were not are no filters."""
    asked = {"p_brand": "Brand#7", "p_type": "SMALL", "p_name": None}
    p = table(spark, sf_dir, "part")
    return reduce(lambda d, f: d.where(F.col(f[0]) == f[1]), [f for f in asked.items() if f[1] is not None], p).select("p_partkey")


@query("flt03_dimension", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def flt03_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter through a dimension of 25 rows by its own definition."""
    n = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").join(n, "c_nationkey", "left_semi").select("c_custkey")


@query("flt04_containment", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red')")
def flt04_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.array_contains(F.split("p_name", " "), "red")).select("p_partkey")


@query("flt06_before_limit", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'ring') ORDER BY p_name, p_partkey LIMIT 20")
def flt06_before_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership is asked before the limit, so a page is as full as it can be."""
    p = table(spark, sf_dir, "part").where(F.array_contains(F.split("p_name", " "), "ring"))
    return p.orderBy("p_name", "p_partkey").limit(20).select("p_partkey")


@query("flt07_folded_enum", "SELECT p_partkey, CASE lower(p_type) WHEN 'small' THEN 'S' WHEN 'economy' THEN 'E' WHEN 'promo' THEN 'P' ELSE upper(p_type) END AS code FROM part")
def flt07_folded_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", requests.folded(F.col("p_type"), {"small": "S", "economy": "E", "promo": "P"}).alias("code"))


_ASKED = "SELECT p_partkey AS rid, CASE p_partkey % 6 WHEN 0 THEN 'green' WHEN 1 THEN '' ELSE p_name END AS q, CASE p_partkey % 7 WHEN 0 THEN '0' WHEN 1 THEN '51' WHEN 2 THEN 'ten' ELSE '20' END AS page, CASE p_partkey % 5 WHEN 0 THEN 'K' WHEN 1 THEN 'ko' WHEN 2 THEN 'X' END AS dialect, CASE WHEN p_partkey % 11 = 0 THEN '1' END AS colour FROM part"


@query(
    "flt08_requests",
    f"""WITH r AS ({_ASKED}) SELECT rid, CASE WHEN colour IS NOT NULL THEN 'UNSUPPORTED_FILTER' WHEN q = '' THEN 'MISSING_QUERY' WHEN page = 'ten' THEN 'INVALID_LIMIT' WHEN page IN ('0', '51') THEN 'LIMIT_OUT_OF_RANGE' WHEN dialect = 'X' THEN 'INVALID_DIALECT' END AS code,
    CASE WHEN code IS NULL THEN CASE dialect WHEN 'ko' THEN 'Ko' ELSE dialect END END AS dialect, CASE WHEN code IS NULL THEN CAST(page AS INTEGER) END AS page_size FROM r""",
)
def flt08_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests checked: the first fault's code, or what they ask for; a filter that is not known is a fault."""
    k = F.col("p_partkey")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    given = F.map_filter(
        F.create_map(
            F.lit("q"), F.when(k % 6 == 0, "green").when(k % 6 == 1, "").otherwise(F.col("p_name")),
            F.lit("limit"), pick(7, "0", "51", "ten", "20", "20", "20", "20"), F.lit("dialect"), pick(5, "K", "ko", "X", None, None),
            F.lit("colour"), F.when(k % 11 == 0, "1"),
        ),
        lambda _, v: v.isNotNull(),
    )
    d = table(spark, sf_dir, "part").select(k.alias("rid"), given.alias("given"))
    return requests.checked(d, "given", known=("q", "limit", "dialect"), most=50).drop("given")


@query("flt10_stored_counts", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 30 OR l_quantity >= 49")
def flt10_stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity = 30 OR l_quantity >= 49").select("l_orderkey", "l_linenumber")


@query(
    "flt11_pattern_bounds",
    "SELECT p_partkey, p_name FROM part WHERE length(p_name) = 10 AND regexp_matches(p_name, '^r[^ ]* w.*$')",
)
def flt11_pattern_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern's length goes first: it needs no regular expression."""
    p = table(spark, sf_dir, "part").where(F.length("p_name") == 10)
    return p.where(F.col("p_name").rlike("^r[^ ]* w.*$")).select("p_partkey", "p_name")


@query("flt12_not_equal", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality <> 1")
def flt12_not_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not equal, null among it."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.where(~F.col("quality").eqNullSafe(1)).select("doc_id")


@query("flt13_narrow", "SELECT doc_id, lang FROM documents WHERE n_chars > 2000")
def flt13_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("n_chars > 2000").select("doc_id", "lang")


@query(
    "prj01_payload",
    """SELECT c_custkey, '{"id":' || c_custkey || ',"name":"' || c_name || '","nation":{"key":' || n_nationkey || ',"name":"' || n_name || '"}}' AS payload FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def prj01_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("nation"))
    d = table(spark, sf_dir, "customer").join(n, "c_nationkey")
    return d.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "nation")).alias("payload"))


@query("prj02_flat", "SELECT p_partkey, p_name, CAST(length(p_name) AS INTEGER) AS character_length, p_size FROM part WHERE p_size < 20")
def prj02_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size < 20").select("p_partkey", "p_name", F.length("p_name").alias("character_length"), "p_size")


@query("prj04_conditional", """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN '{"kind":"PROMO","brand":"' || p_brand || '"}' ELSE '{"kind":"' || p_type || '"}' END AS payload FROM part""")
def prj04_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that only some rows have: null, and so absent from the JSON of the others."""
    brand = F.when(F.col("p_type") == "PROMO", F.col("p_brand")).alias("brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_type").alias("kind"), brand)).alias("payload"))


@query(
    "jn02_prefetch",
    """SELECT s_suppkey, (SELECT string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 45)) AS parts,
    (SELECT count(*) FROM customer WHERE c_nationkey = s_nationkey) AS neighbours FROM supplier""",
)
def jn02_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each relation is grouped once and joined, instead of a query for each row."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey").distinct()
    parts = lines.groupBy("s_suppkey").agg(F.array_join(F.array_sort(F.collect_list("l_partkey")).cast("array<string>"), ",").alias("parts"))
    near = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("neighbours"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(parts, "s_suppkey", "left").join(near, "s_nationkey", "left")
    return s.select("s_suppkey", "parts", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


@query("jn03_inner", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7")
def jn03_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return table(spark, sf_dir, "lineitem").join(p, "l_partkey").select("l_orderkey", "l_linenumber", "p_name")


@query("jn04_records", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def jn04_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality")


@query("jn06_lookup", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 5000 AND l_discount > 0.05")
def jn06_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup whose misses are skipped; whether it is broadcast is left to its size at run time."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return table(spark, sf_dir, "lineitem").where("l_discount > 0.05").join(s, "l_suppkey").select("l_orderkey", "l_linenumber", "s_name")


@query(
    "jn08_first_in_list",
    """WITH m(word, code) AS (VALUES ('ring', 1), ('bolt', 2), ('green', 3), ('blue', 4)), w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(generate_series(1, len(string_split(p_name, ' ')))) AS i FROM part)
    SELECT p_partkey, arg_min(code, i) AS code FROM w JOIN m USING (word) GROUP BY 1""",
)
def jn08_first_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a list's alternatives that a table knows."""
    m = spark.createDataFrame([("ring", 1), ("bolt", 2), ("green", 3), ("blue", 4)], "word string, code int")
    w = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "word"))
    return w.join(F.broadcast(m), "word").groupBy("p_partkey").agg(F.min_by("code", "i").alias("code"))  # four rows


@query(
    "jn09_precedence",
    """SELECT o_orderkey, coalesce(l.flag, o_orderstatus) AS value, coalesce(l.flag <> o_orderstatus, false) AS disagrees FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS flag FROM lineitem WHERE l_linenumber <= 2 AND l_quantity > 25 GROUP BY 1) l ON l_orderkey = o_orderkey""",
)
def jn09_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is attested goes before what was derived, and a disagreement is recorded."""
    seen = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2 AND l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("flag"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(seen, "o_orderkey", "left")
    differs = F.coalesce(F.col("flag") != F.col("o_orderstatus"), F.lit(False))
    return d.select("o_orderkey", F.coalesce("flag", "o_orderstatus").alias("value"), differs.alias("disagrees"))


@query(
    "jn18_many_to_many",
    """WITH w AS (SELECT DISTINCT s_suppkey, unnest(['green ring', 'blue bolt', 'no such', p]) AS name FROM (SELECT s_suppkey, (SELECT min(p_name) FROM part WHERE p_size = s_suppkey % 50) AS p FROM supplier)), f AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1)
    SELECT s_suppkey, w.name, f.id, f.id IS NULL AS missing FROM w LEFT JOIN f USING (name) WHERE w.name IS NOT NULL""",
)
def jn18_many_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of names linked to their first entry, with those that have none."""
    p = table(spark, sf_dir, "part")
    own = p.groupBy(F.col("p_size").cast("long").alias("size")).agg(F.min("p_name").alias("p"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50).alias("size")).join(own, "size", "left")
    names = F.array_distinct(F.array_compact(F.array(F.lit("green ring"), F.lit("blue bolt"), F.lit("no such"), F.col("p"))))
    first = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return s.select("s_suppkey", F.explode(names).alias("name")).join(first, "name", "left").withColumn("missing", F.col("id").isNull())


@query(
    "jn19_polymorphic",
    """WITH n AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'customer' ELSE 'supplier' END AS kind, event_id % 120 AS id FROM events), t AS (SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier)
    SELECT event_id, kind, name FROM n JOIN t USING (kind, id)""",
)
def jn19_polymorphic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that point at rows of several tables, by kind and id."""
    kind = F.when(F.col("event_id") % 2 == 0, "customer").otherwise("supplier")
    n = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), (F.col("event_id") % 120).alias("id"))
    sides = [table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(k).alias("id"), F.col(v).alias("name")) for t, k, v in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"))]
    return n.join(sides[0].union(sides[1]), ["kind", "id"]).select("event_id", "kind", "name")


@query(
    "jn20_union_dedupe",
    """SELECT p_partkey FROM part WHERE p_name LIKE '%ring%' UNION SELECT p_partkey FROM part WHERE p_brand = 'Brand#3' UNION SELECT l_partkey FROM lineitem WHERE l_quantity = 50""",
)
def jn20_union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    third = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    found = p.where(F.col("p_name").contains("ring")).select("p_partkey").unionByName(p.where("p_brand = 'Brand#3'").select("p_partkey"))
    return found.unionByName(third).dropDuplicates(["p_partkey"])


@query("srt01_total_order", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_name, p_brand, p_partkey) AS INTEGER) AS place FROM part ORDER BY p_name, p_brand, p_partkey LIMIT 200")
def srt01_total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 of a total order, the id last; a page is small enough to be numbered in one place."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").orderBy("p_name", "p_brand", "p_partkey").limit(200)
    return p.select("p_partkey", F.row_number().over(Window.orderBy("p_name", "p_brand", "p_partkey")).alias("place"))


@query("srt02_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def srt02_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("srt04_page", "SELECT p_partkey, CAST(count(*) OVER () >= 30 AS BOOLEAN) AS truncated FROM (SELECT p_partkey FROM part ORDER BY p_name DESC, p_partkey LIMIT 30 OFFSET 60)")
def srt04_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy(F.desc("p_name"), "p_partkey").offset(60).limit(30)
    return page.select("p_partkey", (F.count("*").over(Window.partitionBy()) >= 30).alias("truncated"))  # a page of 30


@query("srt06_shuffle", "SELECT count(*) AS parts, sum(p_partkey) AS keys FROM part")
def srt06_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random order; whatever it is, no row is lost or doubled."""
    p = table(spark, sf_dir, "part").select("p_partkey").orderBy(F.rand(7))
    return p.agg(F.count("*").alias("parts"), F.sum("p_partkey").alias("keys"))


@query("srt07_early_stop", "SELECT 40 AS found, count(*) >= 40 AS enough FROM part WHERE p_name LIKE 'b%'")
def srt07_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any 40 matches: the scan ends when it has them."""
    some = table(spark, sf_dir, "part").where("p_name LIKE 'b%'").select("p_partkey").limit(40)
    return some.agg(F.count("*").cast("int").alias("found"), (F.count("*") >= 40).alias("enough"))


@query(
    "srt08_stable_cap",
    """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 50000) DESC, o_orderpriority, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey, CAST(n AS INTEGER) AS n FROM r WHERE n <= 5""",
)
def srt08_stable_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest confidence first, then lane and place, and no more than five of each."""
    o = table(spark, sf_dir, "orders").withColumn("c", F.round(F.col("o_totalprice") / 50000))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("c"), "o_orderpriority", "o_orderkey")
    return o.withColumn("n", F.row_number().over(w)).where("n <= 5").select("o_custkey", "o_orderkey", "n")


@query("srt09_longest_first", "SELECT DISTINCT p_name, CAST(dense_rank() OVER (ORDER BY -length(p_name), p_name) AS INTEGER) AS ordinal FROM part")
def srt09_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension of surfaces numbered longest first, by ranges."""
    names = table(spark, sf_dir, "part").select("p_name", (-F.length("p_name")).alias("size")).distinct()
    return ordered.numbered(names, ["size", "p_name"], "ordinal").select("p_name", F.col("ordinal").cast("int").alias("ordinal"))


@query("srt11_most_common", "SELECT split_part(p_name, ' ', 2) AS word, count(*) AS times FROM part GROUP BY 1 ORDER BY times DESC, word LIMIT 10")
def srt11_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "part").groupBy(F.split("p_name", " ")[1].alias("word")).agg(F.count("*").alias("times"))
    return w.orderBy(F.desc("times"), "word").limit(10)


@query("srt12_largest_groups", "SELECT p_brand, p_type, count(*) AS size FROM part GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY size DESC, p_brand, p_type LIMIT 5")
def srt12_largest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("size")).where("size > 1")
    return g.orderBy(F.desc("size"), "p_brand", "p_type").limit(5)


_NEED = ("alloy", "blue", "bolt", "green", "ring", "steel")


@query("set02_missing", f"SELECT p_partkey, array_to_string(list_sort(list_filter([{', '.join(repr(x) for x in _NEED)}], lambda x: NOT list_contains(string_split(p_name, ' '), x))), ',') AS missing FROM part")
def set02_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, _NEED)), F.split("p_name", " ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(missing, ",").alias("missing"))


@query(
    "set03_both_ways",
    """WITH e AS (SELECT o_custkey AS k, list_distinct(list(o_orderpriority)) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), n AS (SELECT o_custkey AS k, list_distinct(list(o_orderpriority)) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT k, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS missing, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS extra FROM e JOIN n USING (k)""",
)
def set03_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected less actual, and actual less expected."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("a"),
        F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))).alias("b"),
    ).where("size(a) > 0 AND size(b) > 0")
    less = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), ",")
    return o.select("k", less("a", "b").alias("missing"), less("b", "a").alias("extra"))


@query("set04_scope", "(SELECT DISTINCT l_partkey AS k, 'not in scope' AS side FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)) UNION ALL (SELECT p_partkey, 'not covered' FROM part WHERE p_size < 40 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'))")
def set04_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("k"))
    lines = table(spark, sf_dir, "lineitem")
    outside = lines.select(F.col("l_partkey").alias("k")).distinct().join(scope, "k", "left_anti")
    open_ = scope.join(lines.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")), "k", "left_anti")
    return outside.withColumn("side", F.lit("not in scope")).union(open_.withColumn("side", F.lit("not covered")))


@query("set06_overlap", "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['ring', 'steel']) AND list_has_any(string_split(p_name, ' '), ['red', 'blue'])")
def set06_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    some = lambda *x: F.arrays_overlap(words, F.array(*map(F.lit, x)))
    return table(spark, sf_dir, "part").where(some("ring", "steel") & some("red", "blue")).select("p_partkey")


@query("wn06_last_on_page", "SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey)) AS last_part, max(l_linenumber) AS last_line FROM lineitem GROUP BY 1")
def wn06_last_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("last_part"), F.max("l_linenumber").alias("last_line"))


@query("wn08_duplicates", "SELECT l_orderkey, l_partkey, count(*) AS times FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def wn08_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("times")).where("times > 1")


@query("wn09_renumber", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS INTEGER) AS number FROM part")
def wn09_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.row_number().over(w).alias("number"))


@query("wn03_contiguity", "SELECT l_orderkey, count(*) = max(l_linenumber) AND min(l_linenumber) = 1 AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1")
def wn03_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the numbers of a page are 1 to n, each once."""
    n = ordered.firsts(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], [F.lit(1)])
    whole = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    d = n.groupBy("l_orderkey").agg(F.count("*").alias("d"), F.max("l_linenumber").alias("most"), F.min("l_linenumber").alias("least")).join(whole, "l_orderkey")
    return d.select("l_orderkey", ((F.col("d") == F.col("n")) & (F.col("most") == F.col("n")) & (F.col("least") == 1)).alias("contiguous"))
