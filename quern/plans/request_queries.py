"""Requests for verb forms composed from order lines, checked against the table of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import form_requests, request_filters
from quern.plans.base import query, table

# A request's fields by what a line holds, in words that both engines read.
_FIELDS = {
    "branch": "CASE l_orderkey % 4 WHEN 2 THEN 'infinitive' WHEN 3 THEN 'imperative' ELSE 'verb_form' END",
    "pol": "CASE l_partkey % 6 WHEN 0 THEN '\"positive\"' WHEN 1 THEN '\"negative\"' WHEN 2 THEN '\"maybe\"' WHEN 3 THEN 'null' ELSE '' END",
    "tense": "CASE WHEN l_suppkey % 5 = 0 THEN 'past' ELSE 'present' END",
    "sub": "CASE l_linenumber % 4 WHEN 0 THEN '{\"type\": \"person\", \"person\": \"first\", \"number\": \"singular\"}' WHEN 1 THEN '{\"type\": \"noun_class\", \"class_number\": \"1\"}' WHEN 2 THEN '\"ndi\"' ELSE '{\"type\": \"noun_class\", \"class_number\": \"99\"}' END",
    "obj": "CASE l_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '{\"type\": \"person\", \"person\": \"third\", \"number\": \"plural\"}' WHEN 2 THEN '{\"type\": \"x\"}' WHEN 3 THEN '4' ELSE '\"\"' END",
    "refl": "CASE l_suppkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END",
    "num": "CASE l_linenumber % 3 WHEN 0 THEN '\"dual\"' WHEN 1 THEN '\"plural\"' ELSE '' END",
    "ext": "CASE l_partkey % 8 WHEN 0 THEN '[\"passive\"]' WHEN 1 THEN '[\"magic\"]' WHEN 2 THEN '[\"passive\", {\"type\": \"neuter\", \"style\": null}]' WHEN 3 THEN '[{\"type\": \"causative\", \"style\": \"dz\"}]' WHEN 4 THEN '\"passive\"' ELSE '' END",
}
_JSON = """'{"generation_type": "' || branch || '"' || CASE WHEN branch = 'verb_form' THEN ', "tense_aspect": "' || tense || '", "subject": ' || sub ELSE '' END
|| CASE WHEN branch = 'infinitive' AND l_linenumber % 5 = 0 THEN ', "mood": 1' ELSE '' END || CASE WHEN branch = 'imperative' AND num <> '' THEN ', "number": ' || num ELSE '' END
|| CASE WHEN pol <> '' THEN ', "polarity": ' || pol ELSE '' END || CASE WHEN obj <> '' THEN ', "object": ' || obj ELSE '' END || CASE WHEN refl <> '' THEN ', "reflexive": ' || refl ELSE '' END
|| CASE WHEN ext <> '' THEN ', "extensions": ' || ext ELSE '' END || CASE WHEN l_orderkey % 41 = 5 THEN ']' ELSE '}' END"""
_POLARITY = "(pol IN ('\"maybe\"', 'null') OR branch = 'verb_form' AND pol = '')"
_EXT_REASON = "CASE l_partkey % 8 WHEN 1 THEN 'unknown_extension' WHEN 2 THEN 'extension_order' WHEN 3 THEN 'unverified_extension' WHEN 4 THEN 'extensions_not_a_list' END"


@query(
    "mo19_requests",
    f"""WITH l AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _FIELDS.items())} FROM lineitem),
    r AS (SELECT *, CASE WHEN l_orderkey % 41 = 5 THEN 'not_an_object'
      WHEN branch = 'verb_form' THEN CASE WHEN tense = 'past' THEN 'tense_aspect' WHEN {_POLARITY} THEN 'polarity' WHEN refl = 'true' THEN 'reflexive' WHEN obj = '4' THEN 'object_not_an_object'
        WHEN l_linenumber % 4 = 2 THEN 'subject_not_an_object' ELSE coalesce({_EXT_REASON}, CASE WHEN l_linenumber % 4 = 3 THEN 'unknown_subject' WHEN l_orderkey % 5 = 2 THEN 'unknown_object' END) END
      WHEN branch = 'infinitive' THEN CASE WHEN l_linenumber % 5 = 0 THEN 'unknown_field' WHEN {_POLARITY} THEN 'polarity' WHEN obj = '4' THEN 'object_not_an_object' WHEN refl = 'true' AND l_orderkey % 5 IN (1, 2) THEN 'object_and_reflexive'
        ELSE coalesce({_EXT_REASON}, CASE WHEN l_orderkey % 5 = 2 THEN 'unknown_object' END) END
      ELSE CASE WHEN refl = 'true' THEN 'reflexive_imperative' WHEN {_POLARITY} THEN 'polarity' WHEN num = '"dual"' THEN 'number' WHEN obj = '4' THEN 'object_not_an_object'
        ELSE coalesce({_EXT_REASON}, CASE WHEN l_orderkey % 5 = 2 THEN 'unknown_object' END) END END AS reason FROM l)
    SELECT l_orderkey, l_linenumber, CASE WHEN branch = 'verb_form' OR reason IS NOT DISTINCT FROM 'not_an_object' THEN 'finite' ELSE branch END AS branch, reason,
      CASE WHEN reason = 'unverified_extension' THEN 'EXTENSION_UNVERIFIED' WHEN reason IS NOT NULL THEN 'GENERATION_UNSUPPORTED' END AS code,
      CASE WHEN reason = 'unknown_field' THEN 'mood' WHEN contains(reason, 'extension') THEN 'extensions' WHEN reason LIKE 'object%' OR reason = 'unknown_object' THEN 'object' WHEN contains(reason, 'subject') THEN 'subject'
        WHEN reason LIKE 'reflexive%' THEN 'reflexive' WHEN reason <> 'not_an_object' THEN reason END AS field,
      CASE WHEN reason IS NULL AND branch = 'verb_form' THEN CASE l_linenumber % 4 WHEN 0 THEN 'ndi' ELSE CASE WHEN pol = '"negative"' THEN 'a' ELSE 'u' END END END AS subject,
      CASE WHEN reason IS NULL AND l_orderkey % 5 = 1 THEN 'va' END AS object FROM r""",
)
def mo19_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong first with each request, or the concords that it names."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").withColumns({k: F.expr(v) for k, v in _FIELDS.items()})
    d = form_requests.checked(d.select("l_orderkey", "l_linenumber", F.expr(_JSON).alias("features")))
    return d.drop("features")


_LINE = {
    "endpoint": "CASE l_linenumber % 5 WHEN 0 THEN 'search' WHEN 1 THEN 'list' WHEN 2 THEN 'wordlist' WHEN 3 THEN 'pattern' ELSE 'other' END",
    "q": "CASE l_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN '*' ELSE 'ri*ng' END", "pos": "CASE l_orderkey % 7 WHEN 0 THEN 'vt' WHEN 1 THEN 'VT' WHEN 2 THEN ' ' ELSE '' END",
    "dia": "CASE l_suppkey % 6 WHEN 0 THEN 'KO' WHEN 1 THEN 'x' WHEN 2 THEN ' z ' ELSE '' END", "lim": "CASE l_partkey % 9 WHEN 0 THEN '0' WHEN 1 THEN '51' WHEN 2 THEN 'ten' WHEN 3 THEN ' +7 ' WHEN 4 THEN '501' ELSE '' END",
    "rnd": "CASE l_orderkey % 8 WHEN 0 THEN 'YES' WHEN 1 THEN 'maybe' WHEN 2 THEN '0' ELSE '' END", "len": "CASE l_suppkey % 10 WHEN 0 THEN '0' WHEN 1 THEN '3' WHEN 2 THEN '2.5' ELSE '' END",
    "lev": "CASE l_orderkey % 9 WHEN 3 THEN 'expert' WHEN 4 THEN 'beginner' ELSE '' END",
}


@query(
    "flt08_endpoints",
    f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {", ".join(f"{v} AS {k}" for k, v in _LINE.items())} FROM lineitem),
    b AS (SELECT *, trim(q) IN ('', '*') AS blank, pos = 'VT' AS bad_pos, dia = 'x' AS bad_dia, rnd = 'maybe' AS bad_rnd, len IN ('0', '2.5') AS bad_len, lev = 'expert' AS bad_lev, lim IN ('0', '51', 'ten', '501') AS bad_50, lim IN ('0', 'ten', '501') AS bad_500, l_partkey % 13 = 6 AS labels FROM l),
    c AS (SELECT *, CASE endpoint
      WHEN 'search' THEN CASE WHEN blank THEN 'SEARCH_QUERY_REQUIRED q' WHEN bad_pos THEN 'SEARCH_FILTER_INVALID pos' WHEN bad_dia THEN 'SEARCH_FILTER_INVALID dialect' WHEN bad_lev THEN 'SEARCH_FILTER_INVALID learner_level' WHEN bad_rnd THEN 'SEARCH_FILTER_INVALID random' WHEN bad_50 THEN 'SEARCH_FILTER_INVALID limit' END
      WHEN 'list' THEN CASE WHEN bad_lev THEN 'LEMMA_LIST_FILTER_INVALID learner_level' WHEN bad_pos THEN 'LEMMA_LIST_FILTER_INVALID pos' WHEN bad_rnd THEN 'LEMMA_LIST_FILTER_INVALID random' WHEN bad_50 THEN 'LEMMA_LIST_FILTER_INVALID limit' END
      WHEN 'wordlist' THEN CASE WHEN labels THEN 'WORDLIST_FILTER_UNSUPPORTED labels' WHEN bad_lev THEN 'WORDLIST_FILTER_INVALID learner_level' WHEN bad_pos THEN 'WORDLIST_FILTER_INVALID pos' WHEN bad_dia THEN 'WORDLIST_FILTER_INVALID dialect' WHEN bad_len THEN 'WORDLIST_FILTER_INVALID length' WHEN bad_500 THEN 'WORDLIST_FILTER_INVALID limit' END
      WHEN 'pattern' THEN CASE WHEN trim(q) = '' THEN 'PATTERN_QUERY_REQUIRED q' WHEN bad_pos THEN 'PATTERN_FILTER_INVALID pos' WHEN bad_len THEN 'PATTERN_FILTER_INVALID length' WHEN bad_50 THEN 'PATTERN_FILTER_INVALID limit' END
      ELSE 'UNKNOWN_ENDPOINT' END AS fault FROM b)
    SELECT l_orderkey, l_linenumber, endpoint, split_part(fault, ' ', 1) AS code, nullif(split_part(fault, ' ', 2), '') AS field, CASE WHEN fault IS NULL THEN CASE dia WHEN 'KO' THEN 'Ko' WHEN ' z ' THEN 'Z' END END AS dialect,
      CASE WHEN fault IS NULL THEN rnd = 'YES' END AS random, CASE WHEN fault IS NULL THEN CASE lim WHEN ' +7 ' THEN 7 WHEN '51' THEN 51 ELSE 20 END END AS "limit" FROM c""",
)
def flt08_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to each endpoint with filters of every kind: the first fault's code and field, or what they ask for."""
    d = table(spark, sf_dir, "lineitem").withColumns({k: F.expr(v) for k, v in _LINE.items()})
    names = {"q": "q", "pos": "pos", "dia": "dialect", "lim": "limit", "rnd": "random", "len": "length", "lev": "learner_level"}
    labels = F.when(F.col("l_partkey") % 13 == 6, "")
    given = F.map_filter(F.create_map(*[x for k, n in names.items() for x in (F.lit(n), F.when(F.col(k) != "", F.col(k)))], F.lit("labels"), labels), lambda _, v: v.isNotNull())
    d = request_filters.checked(d.select("l_orderkey", "l_linenumber", "endpoint", given.alias("given")))
    return d.drop("given")
