"""Joins, windows, counts and checks over the star schema and the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import learning
from quern.operators import ordered
from quern.plans.base import query, table


@query(
    "ag01_choice_counts",
    """SELECT s.status, CAST(count(o_orderkey) AS BIGINT) AS orders FROM (VALUES ('O'), ('F'), ('P'), ('X')) s(status)
    LEFT JOIN orders ON o_orderstatus = status GROUP BY s.status""",
)
def ag01_choice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each status, with a zero for a status that none has."""
    known = spark.createDataFrame([(s,) for s in "OFPX"], "status string")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return known.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("orders"))


@query(
    "ag04_batch_report",
    """SELECT source, count(*) AS documents, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic,
    CASE WHEN count(quality) > 0 THEN CAST(count(*) FILTER (quality = 1) AS DOUBLE) / count(quality) ELSE 0 END AS good_rate
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
def ag04_batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    d = d.groupBy("source").agg(
        F.count("*").alias("documents"), F.count("quality").alias("labelled"),
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"),
    )
    return d.withColumn("good_rate", F.when(F.col("labelled") > 0, F.col("good") / F.col("labelled")).otherwise(0.0))


@query(
    "ag06_funnel",
    """WITH n AS (SELECT o_orderpriority AS priority, count(*) AS placed, count(*) FILTER (o_orderstatus <> 'O') AS moved, count(*) FILTER (o_orderstatus = 'F') AS filled FROM orders GROUP BY 1)
    SELECT priority, stage, n AS orders, CAST(n AS DOUBLE) / placed AS share FROM (
      SELECT priority, placed, unnest(['placed', 'moved', 'filled']) AS stage, unnest([placed, moved, filled]) AS n FROM n)""",
)
def ag06_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count("*").alias("placed"), F.count_if(status != "O").alias("moved"), F.count_if(status == "F").alias("filled")
    )
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in ("placed", "moved", "filled")])
    n = n.select("priority", "placed", F.explode(stages).alias("s"))
    return n.select("priority", "s.stage", F.col("s.n").alias("orders"), (F.col("s.n") / F.col("placed")).alias("share"))


@query(
    "ag07_source_coverage",
    """WITH n AS (SELECT source, count(*) AS documents, count(l.doc_id) AS covered FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source)
    SELECT *, CASE WHEN covered = 0 THEN 'missing' WHEN covered < documents THEN 'partial' ELSE 'complete' END AS status FROM n""",
)
def ag07_source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has"))
    n = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    n = n.groupBy("source").agg(F.count("*").alias("documents"), F.count("has").alias("covered"))
    status = F.when(F.col("covered") == 0, "missing").when(F.col("covered") < F.col("documents"), "partial").otherwise("complete")
    return n.withColumn("status", status)


@query(
    "ag08_first_seen",
    """SELECT priority, first_key FROM (SELECT o_orderpriority AS priority, min(o_orderkey) AS first_key FROM orders GROUP BY 1) ORDER BY first_key DESC LIMIT 5""",
)
def ag08_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five priorities that were seen last for the first time (a report of that length)."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.min("o_orderkey").alias("first_key"))
    return n.orderBy(F.desc("first_key")).limit(5)


@query(
    "ag12_pair_samples",
    """WITH t AS (SELECT substr(p_name, 1, 1) || substr(p_brand, 1, 1) || '>' || substr(p_type, 1, 1) AS pair, p_partkey, row_number() OVER (PARTITION BY substr(p_name, 1, 1) || substr(p_brand, 1, 1) || '>' || substr(p_type, 1, 1) ORDER BY p_partkey) AS n FROM part)
    SELECT pair, count(*) AS parts, string_agg(CASE WHEN n <= 2 THEN CAST(p_partkey AS VARCHAR) END, ',' ORDER BY p_partkey) AS samples FROM t GROUP BY pair""",
)
def ag12_pair_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each pair of initials, with two examples from bounded partial states (least, least but one)."""
    p = table(spark, sf_dir, "part")
    pair = F.concat(F.left("p_name", F.lit(1)), F.left("p_brand", F.lit(1)), F.lit(">"), F.left("p_type", F.lit(1)))
    p = p.select(pair.alias("pair"), "p_partkey")
    n = p.groupBy("pair").agg(F.count("*").alias("parts"))
    two = ordered.firsts(p, ["pair"], [F.col("p_partkey")], 2).groupBy("pair").agg(F.array_sort(F.collect_list("p_partkey")).alias("s"))
    return n.join(two, "pair").select("pair", "parts", F.array_join(F.col("s").cast("array<string>"), ",").alias("samples"))


@query(
    "ag16_duplicates",
    """SELECT p_name, count(*) AS parts, count(*) - 1 AS extra, min(p_partkey) AS first_key, CASE WHEN count(DISTINCT p_brand) = 1 THEN 'agree' WHEN count(DISTINCT p_brand) = count(*) THEN 'differ' ELSE 'mixed' END AS brands
    FROM part GROUP BY p_name HAVING count(*) > 1""",
)
def ag16_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("k"))
    p = p.groupBy("p_name").agg(F.sum("n").alias("parts"), F.min("k").alias("first_key"), F.count("*").alias("b")).where("parts > 1")
    brands = F.when(F.col("b") == 1, "agree").when(F.col("b") == F.col("parts"), "differ").otherwise("mixed")
    return p.select("p_name", "parts", (F.col("parts") - 1).alias("extra"), "first_key", brands.alias("brands"))


@query(
    "ag18_check_matrix",
    """WITH c AS (SELECT quality, toxic, n_chars >= 100 AS long_enough, text <> '' AS filled FROM documents LEFT JOIN labels USING (doc_id)),
    u AS (SELECT unnest(['length', 'filled', 'quality', 'clean']) AS check_name, unnest([long_enough, filled, quality = 1, toxic = 0]) AS ok FROM c)
    SELECT check_name, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok IS NULL) AS not_applicable FROM u GROUP BY check_name""",
)
def ag18_check_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    checks = {"length": F.col("n_chars") >= 100, "filled": F.col("text") != "", "quality": F.col("quality") == 1, "clean": F.col("toxic") == 0}
    made = F.array(*[F.struct(F.lit(k).alias("check_name"), v.alias("ok")) for k, v in checks.items()])
    d = d.select(F.explode(made).alias("c")).select("c.*")
    return d.groupBy("check_name").agg(
        F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("not_applicable")
    )


@query(
    "ag20_earliest",
    """SELECT o_custkey, count(*) AS orders, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS earliest, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS dearest FROM orders GROUP BY o_custkey""",
)
def ag20_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("orders"),
        F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("earliest"),
        F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("dearest"),
    )


@query(
    "ag23_median_split",
    """WITH m AS (SELECT median(l_quantity) FILTER (l_returnflag = 'R') AS r, median(l_quantity) FILTER (l_returnflag <> 'R') AS o FROM lineitem),
    c AS (SELECT r, o, (r + o) / 2 AS mid FROM m)
    SELECT r AS returned_median, o AS other_median, mid AS midpoint, (SELECT count(*) FILTER (CASE WHEN r >= o THEN (l_returnflag = 'R') = (l_quantity >= mid) ELSE (l_returnflag = 'R') = (l_quantity < mid) END) FROM lineitem) AS right_side, (SELECT count(*) FROM lineitem) AS lines FROM c""",
)
def ag23_median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").alias("r"))
    m = d.agg(
        F.median(F.when(F.col("r"), F.col("l_quantity"))).alias("returned_median"),
        F.median(F.when(~F.col("r"), F.col("l_quantity"))).alias("other_median"),
    )
    m = m.withColumn("midpoint", (F.col("returned_median") + F.col("other_median")) / 2)
    above = F.col("l_quantity") >= F.col("midpoint")
    hit = F.when(F.col("returned_median") >= F.col("other_median"), F.col("r") == above).otherwise(F.col("r") == ~above)
    d = d.join(F.broadcast(m))  # one row
    return d.groupBy("returned_median", "other_median", "midpoint").agg(F.count_if(hit).alias("right_side"), F.count("*").alias("lines"))


@query(
    "m02_score",
    """WITH o AS (SELECT o_custkey, CAST(min(o_orderkey) % 40 AS BIGINT) AS lesson, count(*) AS n FROM orders GROUP BY 1),
    s AS (SELECT *, round_even(greatest(0, least(1, CAST(0.7 AS DOUBLE) * (CASE WHEN lesson > 0 THEN 1 - (least(lesson, 30) - 1) / CAST(29 AS DOUBLE) ELSE 0 END) + CAST(0.3 AS DOUBLE) * least(n / CAST(5 AS DOUBLE), 1))), 3) AS score FROM o)
    SELECT o_custkey, lesson, n AS occurrences, score, CASE WHEN score >= 0.75 THEN 'core' WHEN score >= 0.4 THEN 'common' WHEN score > 0 THEN 'rare' ELSE 'unseen' END AS tier,
    CASE WHEN lesson <= 10 THEN 'beginner' WHEN lesson <= 25 THEN 'intermediate' ELSE 'advanced' END AS level FROM s""",
)
def m02_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.min("o_orderkey") % 40).alias("lesson"), F.count("*").alias("occurrences"))
    o = o.withColumn("score", learning.score(F.col("lesson"), F.col("occurrences")))
    return o.withColumns({"tier": learning.tier(F.col("score")), "level": learning.level(F.col("lesson"))})


@query("ag13_histogram", "SELECT CAST(floor(l_quantity / 10) * 10 AS BIGINT) AS bucket, count(*) AS lines FROM lineitem GROUP BY 1")
def ag13_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = (F.floor(F.col("l_quantity") / 10) * 10).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("lines"))


@query(
    "j12_json_filter",
    """WITH t AS (SELECT DISTINCT event_type FROM events), n AS (SELECT event_type, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 GROUP BY 1)
    SELECT event_type, CAST(coalesce(n, 0) AS BIGINT) AS events FROM t LEFT JOIN n USING (event_type)""",
)
def j12_json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(k >= 50).alias("events"))


@query(
    "wn01_carry_forward",
    """SELECT event_id, user_id, CAST(coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 1) AS BIGINT) AS lesson FROM events""",
)
def wn01_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    value = F.when(F.col("event_type") == "signup", F.col("event_id"))
    e = ordered.carried(e, value, ["user_id"], [F.col("ts"), F.col("event_id")], "lesson", F.lit(1).cast("long"))
    return e.select("event_id", "user_id", "lesson")


@query(
    "wn02_resequence",
    """WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem)
    SELECT l_orderkey, count(*) AS lines, bool_and(seq = l_linenumber) AS contiguous, lpad(CAST(max(seq) AS VARCHAR), 3, '0') AS last_label FROM n GROUP BY 1""",
)
def wn02_resequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    n = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("seq"))
    return n.groupBy("l_orderkey").agg(
        F.count("*").alias("lines"), F.bool_and(F.col("seq") == F.col("l_linenumber")).alias("contiguous"),
        F.lpad(F.max("seq").cast("string"), 3, "0").alias("last_label"),
    )


@query(
    "wn04_gaps",
    """SELECT k + 1 AS first_missing, after - 1 AS last_missing, after - k - 1 AS missing
    FROM (SELECT k, lead(k) OVER (ORDER BY k) AS after FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')) WHERE after > k + 1""",
)
def wn04_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.gaps(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "o_custkey")


@query(
    "jn01_two_hop",
    """SELECT c_custkey, c_name, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR r_name IS NULL OR c_acctbal > 5000""",
)
def jn01_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    d = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    d = d.where((F.col("r_name") == "ASIA") | F.col("r_name").isNull() | (F.col("c_acctbal") > 5000))
    return d.select("c_custkey", "c_name", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query(
    "jn07_first_match",
    """WITH m AS (SELECT p_partkey, s_suppkey, row_number() OVER (PARTITION BY p_partkey ORDER BY s_acctbal DESC, s_suppkey) AS n
      FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey)
    SELECT p_partkey, s_suppkey, s_suppkey IS NOT NULL AS found FROM m WHERE n = 1""",
)
def jn07_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part the supplier of greatest balance; parts without one are kept.  One aggregate, no numbering."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    best = lines.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.max_by("s_suppkey", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("s_suppkey")
    )
    d = table(spark, sf_dir, "part").select("p_partkey").join(best, "p_partkey", "left")
    return d.withColumn("found", F.col("s_suppkey").isNotNull())


@query("jn10_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def jn10_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("jn11_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def jn11_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query(
    "jn12_or_equality",
    """SELECT DISTINCT a.p_partkey AS part_a, b.p_partkey AS part_b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_size = b.p_size AND ((a.p_name = b.p_name AND a.p_type = b.p_type) OR (a.p_brand = b.p_brand AND a.p_name = b.p_name))""",
)
def jn12_or_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on either of two keys: a hash join for each, the second without what the first has found.

    Where keys of parts are unique no pair comes twice, so pairs stream out of the joins; only pairs of keys that several
    rows have are held against each other.
    """
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", "p_type", "p_brand")
    rows = p.groupBy("p_partkey").agg(F.count("*").alias("rows")).where("rows > 1").select("p_partkey", F.lit(True).alias("many"))
    p = p.join(rows, "p_partkey", "left").withColumn("many", F.col("many").isNotNull())
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_size", "p_name")  # few rows make many pairs: no fewer tasks

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        same = (F.col("a.p_size") == F.col("b.p_size")) & (F.col("a.p_name") == F.col("b.p_name")) & (F.col("a.p_partkey") < F.col("b.p_partkey"))
        of_type = F.col("a.p_type") == F.col("b.p_type")
        by_type = a.join(b, same & of_type)
        by_brand = a.join(b, same & (F.col("a.p_brand") == F.col("b.p_brand")) & ~F.coalesce(of_type, F.lit(False)))
        found = [F.col("a.p_partkey").alias("part_a"), F.col("b.p_partkey").alias("part_b")]
        return by_type.select(*found).union(by_brand.select(*found))

    one, many = p.where("NOT many"), p.where("many")
    return pairs(one, one).union(pairs(many, p).union(pairs(one, many)).distinct())


@query(
    "jn15_range",
    """WITH r(label, low, high) AS (VALUES ('small', 0, 1000), ('medium', 500, 50000), ('large', 40000, 10000000))
    SELECT o_orderkey, (SELECT label FROM r WHERE o_totalprice >= low AND o_totalprice < high ORDER BY low LIMIT 1) AS label FROM orders""",
)
def jn15_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first range that holds a value; the ranges are constants of the query, so they become an expression."""
    p, out = F.col("o_totalprice"), F.lit(None).cast("string")
    for label, low, high in (("large", 40000, 10000000), ("medium", 500, 50000), ("small", 0, 1000)):
        out = F.when((p >= low) & (p < high), label).otherwise(out)
    return table(spark, sf_dir, "orders").select("o_orderkey", out.alias("label"))


@query(
    "prj03_nested",
    """SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open_lines,
    string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def prj03_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count_if(F.col("l_linestatus") == "O").alias("open_lines"),
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("nested"),
    )
    text = F.array_join(F.transform("nested", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    d = table(spark, sf_dir, "orders").select("o_orderkey").join(n.withColumn("parts", text).drop("nested"), "o_orderkey", "left")
    return d.fillna(0, ["lines", "returned", "open_lines"])


@query(
    "flt05_dual_visible",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R' AND o_orderstatus = 'F' AND l_quantity >= 10""",
)
def flt05_dual_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R' AND l_quantity >= 10")
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lines.join(seen, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "flt09_wordlist",
    """SELECT p_partkey, p_name, CAST(length(p_name) AS BIGINT) AS letters FROM part WHERE length(p_name) BETWEEN 8 AND 12 ORDER BY p_name, p_partkey LIMIT 50 OFFSET 20""",
)
def flt09_wordlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a list of words by length (50 after the first 20)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.length("p_name").cast("long").alias("letters"))
    return p.where("letters BETWEEN 8 AND 12").orderBy("p_name", "p_partkey").offset(20).limit(50)


@query(
    "srt03_budget",
    """WITH a AS (SELECT p_partkey AS id, p_name AS name, 0 AS tier FROM part WHERE p_name LIKE 'r%' ORDER BY name, id LIMIT 60), b AS (SELECT s_suppkey AS id, s_name AS name, 1 AS tier FROM supplier ORDER BY name, id LIMIT 60)
    SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY tier, name, id LIMIT 60""",
)
def srt03_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").where("p_name LIKE 'r%'").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return ordered.budgeted([a, b], ["name", "id"], 60)


@query(
    "srt05_seed_rotation",
    """WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS t FROM part),
    r AS (SELECT p_partkey, (i - ((-7 % t) + t) % t + t) % t AS place FROM n) SELECT p_partkey, CAST(place AS BIGINT) AS place FROM r WHERE place < 40""",
)
def srt05_seed_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 40 of the list that begins -7 places on."""
    return ordered.rotated(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", -7, 40)


@query(
    "c10_supersession",
    """WITH n AS (SELECT lang, source, count(*) AS documents, max(doc_id) AS latest FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY documents DESC, source) AS n, sum(documents) OVER (PARTITION BY lang) AS t FROM n)
    SELECT lang, source AS winner, documents AS kept, CAST(t - documents AS BIGINT) AS dropped FROM r WHERE n = 1""",
)
def c10_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language the source that has most documents, and what it supersedes."""
    n = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    t = n.groupBy("lang").agg(F.sum("n").alias("t"), F.min(F.struct(-F.col("n"), "source")).alias("w"))
    return t.select("lang", F.col("w.source").alias("winner"), (-F.col("w.col1")).alias("kept"), (F.col("t") + F.col("w.col1")).alias("dropped"))


@query(
    "st01_rate_limit",
    """WITH n AS (SELECT event_id, user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS win, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY ts, event_id) AS n, ts FROM events)
    SELECT event_id, user_id, win, n AS used, greatest(0, 2 - n) AS remaining, n <= 2 AS allowed, (win + 1) * 86400 AS reset, CASE WHEN n > 2 THEN (win + 1) * 86400 - CAST(floor(epoch(ts)) AS BIGINT) END AS retry_after FROM n""",
)
def st01_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.streaming import limiter

    return limiter.batch(table(spark, sf_dir, "events"), 86_400, 2)


@query(
    "st01_stream",
    """WITH n AS (SELECT event_id, user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS win, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY ts, event_id) AS n, ts FROM events)
    SELECT event_id, user_id, win, n AS used, greatest(0, 2 - n) AS remaining, n <= 2 AS allowed, (win + 1) * 86400 AS reset, CASE WHEN n > 2 THEN (win + 1) * 86400 - CAST(floor(epoch(ts)) AS BIGINT) END AS retry_after FROM n""",
)
def st01_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers from a stream: events land out of order in several files, and one from the future closes all windows."""
    from quern.sources import jsonl
    from quern.streaming import limiter

    at = jsonl.new_folder(spark, "limits")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = e.agg(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.expr("INTERVAL 40 DAYS")).alias("ts"))
    e.repartition("event_id").write.parquet(f"{at}/landing/part=1")
    last.write.parquet(f"{at}/landing/part=2")
    landed = spark.readStream.schema(e.schema).parquet(f"{at}/landing/*")
    limiter.run(spark, limiter.stream(landed, 86_400, 2), f"{at}/answers", f"{at}/state")
    return spark.read.schema(limiter.ANSWER).parquet(f"{at}/answers").where("event_id >= 0")


@query("st02_idempotent", "SELECT event_type, count(*) AS events, count(DISTINCT event_id) AS distinct_events FROM events GROUP BY 1")
def st02_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive twice, in overlapping batches of JSON lines, are ingested once."""
    from quern.sources import jsonl
    from quern.streaming import ingest

    at = jsonl.new_folder(spark, "ingest")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    jsonl.write(e.where("event_id % 3 <> 0"), f"{at}/landing/batch=1")
    jsonl.write(e.where("event_id % 3 <> 1"), f"{at}/landing/batch=2")
    ingest.run(spark, f"{at}/landing/*", e.schema, "event_id", f"{at}/table", f"{at}/state")
    got = ingest.ingested(spark, f"{at}/table", e.schema)
    n = got.groupBy("event_type", "event_id").agg(F.count("*").alias("n"))
    return n.groupBy("event_type").agg(F.sum("n").alias("events"), F.count("*").alias("distinct_events"))
