"""Examples and cross-references written as JSON of several shapes, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import annotations
from quern.plans.base import query, table

_SEVEN = "abs(conv_id * 3 + turn) % 7"


@query(
    "j01_example_objects",
    rf"""WITH t AS (SELECT conv_id, turn, {_SEVEN} AS k, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM conversations),
    s AS (SELECT *, CASE WHEN trim(split_part(x, ':', 1)) <> '' AND contains(x, ':') AND trim(substr(x, strpos(x, ':') + 1)) <> '' THEN trim(split_part(x, ':', 1)) ELSE x END AS a,
      CASE WHEN trim(split_part(x, ':', 1)) <> '' AND contains(x, ':') AND trim(substr(x, strpos(x, ':') + 1)) <> '' THEN trim(substr(x, strpos(x, ':') + 1)) END AS b FROM t)
    SELECT conv_id, turn, CASE WHEN k IN (0, 2, 5) THEN a WHEN k = 4 THEN NULL ELSE x END AS text, CASE WHEN k IN (0, 2, 5) THEN b WHEN k = 1 THEN 'said' WHEN k = 3 THEN 'told' ELSE x END AS meaning,
      CASE k WHEN 1 THEN 'a note' WHEN 2 THEN NULL END AS note, CASE k WHEN 3 THEN 'K,Z' ELSE '' END AS dialects FROM s WHERE x <> '' AND k < 6""",
)
def j01_example_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples as strings and as objects with other names, notes that repeat the text, lists with what is no example."""
    s = lambda **x: F.to_json(F.array(F.struct(*[v.alias(k) for k, v in x.items()])))
    x, k = F.col("text"), F.expr(_SEVEN)
    many = F.concat(F.lit("\t "), x, F.lit(" \n"))
    json = (
        F.when(k == 0, F.to_json(F.array(many)))
        .when(k == 1, s(text=F.lit(" "), example=x, gloss=F.lit("said"), note=F.lit(" a  note ")))
        .when(k == 2, s(source_text=many, note=F.lit("")))
        .when(k == 3, s(example=x, meaning=F.lit("told"), raw_text=x, dialects=F.array(F.lit("K"), F.lit(" "), F.lit("Z "))))
        .when(k == 4, s(translation=x, text=F.lit(5), note=x))
        .when(k == 5, F.concat(F.lit("[5, null, {}, "), F.substring(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))))))
        .otherwise(F.to_json(F.struct(x.alias("text"))))
    )
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(annotations.examples(json)).alias("e"))
    return d.select("conv_id", "turn", "e.text", "e.meaning", "e.note", F.array_join("e.dialects", ",").alias("dialects"))


_REF = "p_partkey % 6"
_FIRST = "split_part(p_name, ' ', 1)"


@query(
    "j02_reference_objects",
    f"""WITH k AS (SELECT lower(p_name) AS t, min(p_partkey::VARCHAR) AS id, min(p_name) AS hw FROM part WHERE p_size > 10 GROUP BY 1),
    r AS (SELECT p_partkey, {_REF} AS k, CASE WHEN p_size % 4 = 0 THEN p_name || 'x' ELSE p_name END AS target FROM part)
    SELECT p_partkey, CASE r.k WHEN 0 THEN 'see' WHEN 1 THEN 'cp' WHEN 3 THEN 'synonym' ELSE 'reference' END AS type, target, CASE r.k WHEN 0 THEN 'see ' || target || '.' WHEN 1 THEN 'CP ' || target WHEN 2 THEN target WHEN 3 THEN 'n' END AS note,
      CASE r.k WHEN 3 THEN 'M' ELSE '' END AS dialects, coalesce(k.id, CASE r.k WHEN 4 THEN 'own' END) AS target_id, coalesce(k.hw, CASE r.k WHEN 4 THEN 'Own' END) AS target_headword, k.id IS NOT NULL OR r.k = 4 AS resolved
    FROM r LEFT JOIN k ON k.t = target WHERE r.k < 5""",
)
def j02_reference_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as strings and as objects, some already resolved, held against the larger parts' names."""
    p = table(spark, sf_dir, "part")
    k, target = F.expr(_REF), F.when(F.col("p_size") % 4 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name"))
    s = lambda **x: F.to_json(F.array(F.struct(*[v.alias(n) for n, v in x.items()])))
    json = (
        F.when(k == 0, F.to_json(F.array(F.concat(F.lit(" see  "), target, F.lit(".")))))
        .when(k == 1, F.to_json(F.array(F.concat(F.lit("CP "), target))))
        .when(k == 2, F.to_json(F.array(target, F.lit(" . "))))
        .when(k == 3, s(kind=F.lit("synonym"), headword=target, raw_text=F.lit("n"), dialects=F.array(F.lit("M"))))
        .when(k == 4, s(text=target, target_public_id=F.lit("own"), target_headword=F.lit("Own"), resolved=F.lit(True)))
        .otherwise(s(type=F.lit("see"), target=F.lit(7)))
    )
    d = p.select("p_partkey", F.explode(annotations.references(json)).alias("r"))
    lexicon = p.where("p_size > 10").select(F.col("p_name").alias("headword"), F.col("p_partkey").cast("string").alias("entry"))
    d = annotations.resolved(d, lexicon)
    return d.select("p_partkey", "r.type", "r.target", "r.note", F.array_join("r.dialects", ",").alias("dialects"), "r.target_id", "r.target_headword", "r.resolved")
