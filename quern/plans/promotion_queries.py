"""Promotion of units composed from the parts, over two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import promotion
from quern.plans.base import query, table
from quern.sources import jsonl


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit for each part, with much that can be wrong in them."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    size = lambda n: F.col("p_size") % n
    senses = F.transform(words, lambda w, i: F.struct((i + 1).alias("number"), F.concat(w, F.when(size(23) == 1, " 2. more").otherwise("")).alias("definition"), F.array(F.lower("p_type")).alias("grammar")))
    forms = F.array(
        F.lower("p_type"), F.lit(" "),
        F.to_json(F.struct(F.concat("p_name", F.lit("s")).alias("form"), F.element_at(F.array(F.lit(">"), F.lit("<-"), F.lit("~"), F.lit("")), size(4) + 1).alias("marker"))),
        F.to_json(F.struct(words.alias("forms"))),
    )
    idioms = F.array(
        F.struct(F.col("p_name").alias("expression_text"), F.when(size(3) == 0, F.col("p_type")).alias("idiomatic_meaning"), F.when(size(3) == 1, " ").otherwise("p").alias("english_rendering")),
        F.struct(F.lit("").alias("expression_text"), F.lit("m").alias("idiomatic_meaning"), F.lit(None).cast("string").alias("english_rendering")),
    )
    out = F.struct(
        F.col("p_name").alias("headword"), F.when(size(2) == 0, "noun").otherwise("verb_stem").alias("headword_kind"),
        F.struct(F.when(size(19) != 3, F.when(size(2) == 0, "n").otherwise("V T")).alias("code"), F.when(size(31) == 4, "noun see x").otherwise("noun").alias("label")).alias("part_of_speech"),
        F.array(F.lit("K"), F.lit("Z")).alias("dialects"), F.when(size(29) == 5, F.array(F.lit("e"))).alias("errors"),
        F.struct(F.when(size(37) != 6, F.array(F.lit(""), F.col("p_size").cast("string"))).alias("classes")).alias("noun"),
        F.when(size(41) != 7, senses).alias("senses"), F.when(size(7) == 2, "LH X").when(size(7) > 2, " LH ").alias("tone_pattern"),
        F.when(size(5) == 0, F.array(F.struct(F.lit("HL").alias("pattern"), F.array(F.lit("M")).alias("dialects")))).alias("tone_records"),
        F.transform(forms, lambda x: x).alias("derived_forms"), idioms.alias("idiomatic_expressions"),
    )
    return p.select(
        F.col("p_partkey").cast("string").alias("unit_id"), F.when(size(17) == 0, "draft").otherwise("approved").alias("review_state"),
        F.when(size(13) == 0, "failed").otherwise("parsed").alias("parser_status"), F.when(size(43) == 8, "[1]").otherwise(F.to_json(out)).alias("output"), "p_partkey",
    )


_S = "p_size % "


@query(
    "c03_fan_out",
    f"""WITH u AS (SELECT *, p_partkey::VARCHAR AS unit_id, CASE WHEN {_S}17 = 0 THEN 'draft' ELSE 'approved' END AS state, string_split(p_name, ' ') AS w,
      CASE WHEN {_S}17 = 0 THEN 'not_approved' WHEN {_S}13 = 0 THEN 'parser_failed' WHEN {_S}43 = 8 THEN 'invalid_output' WHEN {_S}29 = 5 THEN 'parser_errors' WHEN {_S}19 = 3 THEN 'no_pos_code'
        WHEN {_S}31 = 4 THEN 'label_residue' WHEN {_S}2 = 0 AND {_S}37 = 6 THEN 'no_noun_class' WHEN {_S}41 = 7 THEN 'no_definition' WHEN {_S}23 = 1 THEN 'unresolved_senses' WHEN {_S}7 = 2 THEN 'malformed_tone_pattern' END AS error FROM part),
    ok AS (SELECT * FROM u WHERE error IS NULL),
    f AS (SELECT unit_id, unnest(list_concat([lower(p_type)], [p_name || 's'], w)) AS value, generate_subscripts(list_concat([lower(p_type)], [p_name || 's'], w), 1) AS position,
      CASE {_S}4 WHEN 0 THEN '>' WHEN 1 THEN '<-' WHEN 2 THEN '~' END AS marker FROM ok),
    rows AS (
      SELECT 'lemma' AS "table", unit_id, 1 AS position, p_name AS value, concat_ws(';', CASE WHEN {_S}2 = 0 THEN 'class=' || p_size END, 'dialects=K,Z', 'kind=' || CASE WHEN {_S}2 = 0 THEN 'noun' ELSE 'verb_stem' END, 'pos=' || CASE WHEN {_S}2 = 0 THEN 'n' ELSE 'vt' END) AS more FROM ok
      UNION ALL SELECT 'sense', unit_id, i, w[i], 'grammar=' || lower(p_type) || ';number=' || i FROM ok, range(1, 9) t(i) WHERE i <= len(w)
      UNION ALL SELECT 'tone', unit_id, 1, CASE WHEN {_S}5 = 0 THEN 'HL' ELSE 'LH' END, CASE WHEN {_S}5 = 0 THEN 'dialects=M' ELSE 'dialects=K,Z' END FROM ok WHERE {_S}5 = 0 OR {_S}7 > 2
      UNION ALL SELECT 'form', unit_id, position, value, CASE WHEN position = 2 AND marker IS NOT NULL THEN 'marker=' || marker || ';path=derived_forms[2];relation=' || CASE marker WHEN '>' THEN 'headword_to_derived_form' WHEN '<-' THEN 'derived_form_to_headword' ELSE 'source_marker_relation' END ELSE '' END FROM f
      UNION ALL SELECT 'figurative', unit_id, 1, p_name, concat_ws(';', CASE WHEN {_S}3 = 0 THEN 'meaning=' || p_type END, CASE WHEN {_S}3 <> 1 THEN 'rendering=p' END) FROM ok WHERE {_S}3 <> 1
      UNION ALL SELECT 'decision', unit_id, 1, 'publish', '' FROM ok
      UNION ALL SELECT 'audit', unit_id, 1, 'published', 'from=approved' FROM ok
      UNION ALL SELECT 'rejected', unit_id, 1, error, 'state=' || state FROM u WHERE error IS NOT NULL
      UNION ALL SELECT 'rejected', unit_id, 1, coalesce(error, 'already_published'), 'state=' || state FROM u WHERE p_partkey % 2 = 0)
    SELECT "table", unit_id, position::INTEGER AS position, value, more FROM rows
    UNION ALL SELECT 'counted', "table", NULL, count(*)::VARCHAR, '' FROM rows GROUP BY "table" """,
)
def c03_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all tables after two runs (the second brings every other unit again), and the counts that the runs observed."""
    folder = jsonl.new_folder(spark, "promotion")
    d = units(spark, sf_dir)
    runs = [promotion.promote(d.drop("p_partkey"), folder), promotion.promote(d.where("p_partkey % 2 = 0").drop("p_partkey"), folder)]
    counts = [("counted", t, None, str(sum(r[t] for r in runs)), "") for t in promotion.TABLES]  # eight sums
    more = F.array_join(F.transform(F.array_sort(F.map_entries("more")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    rows = promotion.published(spark, folder).withColumn("more", more)
    return rows.unionByName(spark.createDataFrame(counts, "table string, unit_id string, position int, value string, more string"))
