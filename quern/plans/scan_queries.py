"""Scans and sinks: tables written as JSON lines, text or TSV in the shared folder and read back; streams over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import labels, plurals, spelling
from quern.functions import orthography as ort
from quern.sources import jsonl
from quern.streaming import ingest
from quern.plans.base import query, table


@query("src01_strict", "SELECT event_id, event_type, CAST(value AS DOUBLE) AS value, 0 AS displaced FROM events")
def src01_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, of which every one must fit the schema, with their numbers: files are written in order and so must be read.

    Blank lines stand between them, so the n-th row of a file is its line 2n - 1.
    """
    from pyspark.sql.window import Window

    at = jsonl.new_folder(spark, "strict")
    e = table(spark, sf_dir, "events").repartitionByRange(8, "event_id").sortWithinPartitions("event_id")
    e.select(F.explode(F.array(F.to_json(F.struct("event_id", "event_type", "value")), F.lit(" "))).alias("value")).write.text(at)
    d = jsonl.strict(spark, at, "event_id long, event_type string, value double")
    place = F.row_number().over(Window.partitionBy("file").orderBy("event_id"))
    return d.select("event_id", "event_type", "value", (F.col("line") - 2 * place + 1).cast("int").alias("displaced"))


@query("src02_lenient", "SELECT event_id % 10 = 3 AS bad, count(*) AS lines, count(CASE WHEN event_id % 10 <> 3 THEN event_type END) AS read FROM events GROUP BY 1")
def src02_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, of which some are broken: these are told apart and stop nothing."""
    at = jsonl.new_folder(spark, "lenient")
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct("event_id", "event_type"))
    e.select(F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{broken "), line)).otherwise(line).alias("value")).write.text(at)
    rows = jsonl.lenient(spark, at, "event_id long, event_type string")
    return rows.groupBy(F.col("bad").isNotNull().alias("bad")).agg(F.count("*").alias("lines"), F.count("event_type").alias("read"))


@query("src03_pushed", "SELECT event_id, value FROM events WHERE value >= 75")
def src03_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A least confidence, which goes down into the scan."""
    return table(spark, sf_dir, "events").where("value >= 75").select("event_id", "value")


@query("src04_batch_document", "SELECT p_brand AS batch_id, 'p' || p_partkey AS locator, p_name AS raw FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) > 85)")
def src04_batch_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch documents of a known version; one with another version, no entries or a locator twice is refused whole."""
    at = jsonl.new_folder(spark, "batches")
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("batch_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("locator"), F.col("p_name").alias("raw"))
    many = p.groupBy("batch_id").agg(F.when(F.count("*") > 85, "other").otherwise(jsonl.BATCH).alias("format_version"))
    jsonl.write(p.join(many, "batch_id"), at)
    return jsonl.batches(spark, at, "batch_id string, locator string, raw string").select("batch_id", "locator", "raw")


@query("src05_clean_lines", "SELECT doc_id, CAST(i AS INTEGER) AS number, '† ' || trim(string_split(text, chr(10))[i], ' ' || chr(9)) || ' a-b-c' AS line FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)")
def src05_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the documents, put wrong as a bad scan would (dagger, soft hyphens, odd hyphens, blanks), then cleaned."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(jsonl.numbered_lines(F.col("text"))).alias("l"))
    line = F.regexp_replace("l.line", r"^[ \t]+|[ \t]+$", "")
    spoilt = F.concat(F.lit("\t\u00a0 â€\u00a0 "), F.replace(line, F.lit(" "), F.lit("\u00ad ")), F.lit(" a\u2010b\u2011c \u00ad\r"))
    return d.select("doc_id", "l.number", jsonl.cleaned_line(spoilt).alias("line"))


@query("src08_pages", "SELECT p_size AS page, p_name AS headword, 'book:page_' || lpad(CAST(p_size - 24 AS VARCHAR), 3, '0') AS locator FROM part WHERE p_size BETWEEN 30 AND 40")
def src08_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in files of their own number: those of a range, by the file's path alone, with locators 24 less."""
    at = jsonl.new_folder(spark, "pages")
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("page"), F.col("p_name").alias("headword"))
    p.write.partitionBy("page").json(at)
    read = spark.read.schema("headword string, page int").option("basePath", at).json(at).where("page BETWEEN 30 AND 40")
    return read.select("page", "headword", F.concat(F.lit("book:page_"), F.lpad((F.col("page") - 24).cast("string"), 3, "0")).alias("locator"))


@query("src09_plural_index", "SELECT split_part(p_name, ' ', 1) AS headword, p_size, min(split_part(p_name, ' ', 2)) AS plural FROM part GROUP BY 1, 2 HAVING count(DISTINCT split_part(p_name, ' ', 2)) = 1")
def src09_plural_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index read from lines of text: what has several plurals has none."""
    at = jsonl.new_folder(spark, "index")
    p = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    p.select(F.concat(w[0], F.lit(" n "), F.col("p_size").cast("string"), F.lit(", pl: "), w[1], F.lit(".")).alias("value")).write.text(at)
    line = r"^(\S+) n (\d+), pl: ([^.,;]+)\."
    d = spark.read.text(at).where(F.col("value").rlike(line))
    d = d.select(*[F.regexp_extract("value", line, i).alias(c) for i, c in ((1, "headword"), (2, "p_size"), (3, "plural"))])
    s = d.groupBy("headword", F.col("p_size").cast("int").alias("p_size")).agg(F.collect_set("plural").alias("s")).where(F.size("s") == 1)
    return s.select("headword", "p_size", F.get("s", F.lit(0)).alias("plural"))


@query("src11_units", "SELECT doc_id, md5(text) AS raw_md5 FROM documents ORDER BY doc_id")
def src11_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read-only scan of units in order."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("raw_md5")).orderBy("doc_id")


@query("src12_partitions", "SELECT count(*) AS rows, sum(n_chars) AS chars FROM documents")
def src12_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table read piece by piece: partial sums of its partitions, then of these."""
    d = table(spark, sf_dir, "documents").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    return d.agg(F.sum("n").alias("rows"), F.sum("c").alias("chars"))


@query("snk01_units", "SELECT doc_id, CASE WHEN n_chars < 100 THEN 'failed' WHEN quality IS NULL THEN 'uncertain' ELSE 'parsed' END AS parser_status, source || '/' || lang AS provenance FROM documents LEFT JOIN labels USING (doc_id)")
def snk01_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units appended with a status made from their errors, and their provenance merged."""
    at = jsonl.new_folder(spark, "units")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("n_chars") < 100, "failed").when(F.col("quality").isNull(), "uncertain").otherwise("parsed")
    d = d.select("doc_id", status.alias("parser_status"), F.concat_ws("/", "source", "lang").alias("provenance"))
    d.where("doc_id % 2 = 0").write.mode("append").parquet(at)
    d.where("doc_id % 2 = 1").write.mode("append").parquet(at)
    return spark.read.parquet(at)


@query("snk02_bulk_update", "SELECT p_partkey, CASE WHEN p_size < 10 THEN p_size + 100 ELSE p_size END AS p_size, p_name FROM part")
def snk02_bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column set anew for some rows, the others untouched."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
    new = p.where("p_size < 10").select("p_partkey", (F.col("p_size") + 100).alias("new"))
    at = jsonl.new_folder(spark, "updated")
    p.join(new, "p_partkey", "left").select("p_partkey", F.coalesce("new", "p_size").alias("p_size"), "p_name").write.parquet(at)
    return spark.read.parquet(at)


@query("snk03_upsert", "SELECT n_name AS name, n_regionkey + 10 AS region FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, n_regionkey FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT s_name, 99 FROM supplier WHERE s_suppkey < 5")
def snk03_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), "n_nationkey")
    new = n.where("n_nationkey % 2 = 0").select("name", (F.col("region") + 10).alias("region"))
    added = table(spark, sf_dir, "supplier").where("s_suppkey < 5").select(F.col("s_name").alias("name"), F.lit(99).alias("region"))
    return jsonl.upserted(n.select("name", "region"), new.union(added), "name")


@query("snk04_self_reference", "SELECT a.n_nationkey, b.n_name AS partner FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 3) % 25")
def snk04_self_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References within a table resolved in a second pass; one without a target is an error."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", ((F.col("n_nationkey") + 3) % 25).alias("to"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("to"), F.col("n_name").alias("partner"))
    d = n.join(names, "to", "left")
    fault = F.raise_error(F.concat(F.lit("no target: "), F.col("to").cast("string"))).cast("string")
    return d.select("n_nationkey", F.when(F.col("partner").isNull(), fault).otherwise(F.col("partner")).alias("partner"))


@query("snk05_outputs", "SELECT p_partkey, p_name, CASE WHEN p_size > 5 THEN p_brand END AS p_brand FROM part WHERE p_size < 30")
def snk05_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worklist as TSV, in which None stands for null, read back."""
    at = jsonl.new_folder(spark, "worklist")
    p = table(spark, sf_dir, "part").where("p_size < 30").select("p_partkey", "p_name", F.when(F.col("p_size") > 5, F.col("p_brand")).alias("p_brand"))
    p.write.option("sep", "\t").option("header", True).option("nullValue", "None").csv(at)
    return spark.read.schema("p_partkey long, p_name string, p_brand string").option("sep", "\t").option("header", True).option("nullValue", "None").csv(at)


@query("st03_resume", "SELECT event_type, count(*) AS events FROM events GROUP BY 1")
def st03_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a growing folder: the second takes up where the first ended, and refuses what the first has."""
    at = jsonl.new_folder(spark, "resume")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    for part in (0, 1):
        jsonl.write(e.where((F.col("event_id") % 2 == part) | (F.col("event_id") % 7 == 0)), f"{at}/landing/batch={part}")
        ingest.run(spark, f"{at}/landing/*", e.schema, "event_id", f"{at}/table", f"{at}/state")
    return ingest.ingested(spark, f"{at}/table", e.schema).groupBy("event_type").agg(F.count("*").alias("events"))


@query("st04_after_save", "SELECT event_id, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS tag FROM events WHERE event_type = 'purchase'")
def st04_after_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step that follows each saved batch of a stream: published rows are tagged."""
    at = jsonl.new_folder(spark, "tagged")
    jsonl.write(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), f"{at}/landing")
    ingest.tagged(spark, f"{at}/landing", "event_id long, event_type string, value double", "event_type = 'purchase'", F.when(F.col("value") >= 50, "high").otherwise("low"), f"{at}/table", f"{at}/state")
    return spark.read.schema("event_id long, event_type string, value double, tag string").parquet(f"{at}/table").select("event_id", "tag")


@query("u03_inventory", """SELECT p_partkey, array_to_string(regexp_extract_all(p_name, 'ng|ri|ol|.', 0), '|') AS segments FROM part""")
def u03_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by an inventory that the caller gives."""
    found = F.regexp_extract_all("p_name", F.lit(ort.inventory_regex(("ri", "ng", "ol"))), F.lit(1))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, "|").alias("segments"))


@query("c11_approval", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 AND n_chars >= 100")
def c11_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units approved as a batch: sure and complete."""
    d = table(spark, sf_dir, "documents").where("n_chars >= 100").select("doc_id")
    return d.join(table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0"), "doc_id", "left_semi")


@query(
    "c14_readiness",
    """WITH r(area, version) AS (VALUES ('R', 'v6'), ('N', 'v5'), ('A', 'v6')), s AS (SELECT l_returnflag AS area, count(*) AS rows, count(*) FILTER (l_linestatus = 'O') AS stale FROM lineitem GROUP BY 1)
    SELECT area, rows, stale, version = 'v6' AND stale = 0 AS ready, CASE WHEN version <> 'v6' THEN 'version' WHEN stale > 0 THEN 'stale' END AS reason FROM r JOIN s USING (area)""",
)
def c14_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release is ready if its rules' version is the current one and nothing is stale."""
    r = spark.createDataFrame([("R", "v6"), ("N", "v5"), ("A", "v6")], "area string, version string")
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("area")).agg(F.count("*").alias("rows"), F.count_if(F.col("l_linestatus") == "O").alias("stale"))
    reason = F.when(F.col("version") != "v6", "version").when(F.col("stale") > 0, "stale")
    return r.join(s, "area").select("area", "rows", "stale", reason.isNull().alias("ready"), reason.alias("reason"))


@query(
    "pl06_publish",
    """WITH n AS (SELECT p_partkey, split_part(p_name, ' ', 2) AS hw, CASE WHEN p_size % 4 = 0 THEN 'ma' || split_part(p_name, ' ', 2) END AS recorded, CASE WHEN p_size % 4 = 1 THEN 'va' || split_part(p_name, ' ', 2) END AS line, CASE WHEN p_size % 4 = 2 THEN 'mi' || split_part(p_name, ' ', 2) END AS text FROM part)
    SELECT p_partkey, coalesce(recorded, line, text) AS surface, CASE WHEN recorded IS NOT NULL THEN 'recorded' WHEN line IS NOT NULL THEN 'line' WHEN text IS NOT NULL THEN 'text' END AS basis, CASE WHEN coalesce(recorded, line, text) IS NULL THEN 'NO_RECORDED_PLURAL' END AS skipped
    FROM n WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1)""",
)
def pl06_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plurals from what is recorded, else from the line, else from the text; those there already are left out."""
    s = F.col("p_size") % 4
    hw = F.split("p_name", " ")[1]
    d = table(spark, sf_dir, "part").select("p_partkey", hw.alias("hw"), s.alias("s"))
    there = table(spark, sf_dir, "lineitem").where("l_quantity = 1").select(F.col("l_partkey").alias("p_partkey"))
    d = d.join(there, "p_partkey", "left_anti")
    given = [F.when(F.col("s") == i, F.concat(F.lit(p), F.col("hw"))) for i, p in enumerate(("ma", "va", "mi"))]
    basis = F.when(given[0].isNotNull(), "recorded").when(given[1].isNotNull(), "line").when(given[2].isNotNull(), "text")
    made = plurals.derived(F.col("hw"), F.lit("5"), F.coalesce(*given))
    return d.select("p_partkey", made.alias("m"), basis.alias("basis")).select("p_partkey", "m.surface", "basis", F.col("m.code").alias("skipped"))


@query(
    "c02_reading_order",
    """WITH h AS (SELECT l_orderkey AS q, l_partkey AS entry, min(l_linenumber) AS place FROM lineitem GROUP BY 1, 2), f AS (SELECT h.* FROM h JOIN part ON entry = p_partkey WHERE p_size < 30), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY place, entry) AS n FROM f)
    SELECT q, entry, CAST(n AS INTEGER) AS n FROM r WHERE n <= 3""",
)
def c02_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries behind a query's readings: each once at its first reading, those that are visible, three at most."""
    from quern.operators import ordered
    from pyspark.sql.window import Window

    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("entry")).agg(F.min("l_linenumber").alias("place"))
    h = h.join(table(spark, sf_dir, "part").where("p_size < 30").select(F.col("p_partkey").alias("entry")), "entry", "left_semi")
    h = ordered.firsts(h, ["q"], [F.col("place"), F.col("entry")], 3)
    return h.select("q", "entry", F.row_number().over(Window.partitionBy("q").orderBy("place", "entry")).alias("n"))
