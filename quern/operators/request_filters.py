"""Filters of search requests checked by endpoint: a table says which fields are looked at, in which order, and how.

The first fault counts; it is told by the endpoint's code and the field.  A blank argument is no argument, a name that an
endpoint does not know is passed over, but one that it names as unsupported is refused, even blank.  Good requests come out
with their values: folded dialects, whole numbers, the limit's default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import orthography as ort

# What filters may ask for.
CODES = (
    "n", "vt", "vi", "vti", "v", "defective_v", "ideo", "adj", "adv", "pron", "conj", "inter", "cop", "poss", "quant", "demons", "sc", "oc", "suffix",
    "infix", "prefix", "stem", "note", "tense_sign", "unknown",
)
LEVELS, STAGES = ("beginner", "intermediate", "advanced", "unknown"), ("forms_1_2", "forms_3_4", "general_secondary", "unknown")
FREQUENCIES, KINDS = ("high", "medium", "low", "unknown"), ("word", "noun", "verb_stem", "ideophone", "unknown")
CONTEXTS = ("conversation", "narrative", "description", "letter_writing", "school_composition", "formal_speech", "greetings", "family", "environment", "time")
DOMAINS = ("orthography", "grammar", "vocabulary", "composition", "comprehension", "register", "oral_communication", "figurative_language", "culture")
FUNCTIONS = ("vocabulary", "example_sentence", "dialogue_practice", "writing_guidance", "usage_warning", "cultural_interpretation", "assessment_support")
REGISTERS = ("formal", "informal", "respectful", "school_appropriate", "avoid_in_school_context")
DIALECTS = {"k": "K", "ko": "Ko", "m": "M", "z": "Z"}
YES, NO = ("true", "1", "yes"), ("false", "0", "no")
UNSUPPORTED = ("character_length", "exclude_labels", "guessable", "labels")
DEFAULT_LIMIT = 20
# Of each endpoint its codes (no query, wrong filter, unsupported filter) and its fields in order, with what they may be.
ENDPOINTS = {
    "search": (
        ("SEARCH_QUERY_REQUIRED", "SEARCH_FILTER_INVALID", None),
        (("headword_kind", KINDS), ("pos", CODES), ("dialect", "dialect"), ("learner_level", LEVELS), ("curriculum_stage", STAGES), ("frequency_tier", FREQUENCIES), ("communication_context", CONTEXTS), ("random", "boolean"), ("limit", (1, 50))),
    ),
    "list": (
        (None, "LEMMA_LIST_FILTER_INVALID", None),
        (("learner_level", LEVELS), ("curriculum_stage", STAGES), ("frequency_tier", FREQUENCIES), ("headword_kind", KINDS), ("curriculum_domain", DOMAINS), ("learning_function", FUNCTIONS), ("communication_context", CONTEXTS), ("register_tag", REGISTERS), ("pos", CODES), ("random", "boolean"), ("limit", (1, 50))),
    ),
    "wordlist": (
        (None, "WORDLIST_FILTER_INVALID", "WORDLIST_FILTER_UNSUPPORTED"),
        (("frequency_tier", FREQUENCIES), ("learner_level", LEVELS), ("pos", CODES), ("dialect", "dialect"), ("length", (1, None)), ("min_length", (1, None)), ("max_length", (1, None)), ("grapheme_length", (1, None)), ("syllable_count", (1, None)), ("seed", (None, None)), ("limit", (1, 500)), ("offset", (0, None))),
    ),
    "pattern": (("PATTERN_QUERY_REQUIRED", "PATTERN_FILTER_INVALID", None), (("pos", CODES), ("length", (1, None)), ("limit", (1, 50)))),
}


def _number(x: Column) -> Column:
    """A whole number as it may be written; null for anything else."""
    return F.when(x.rlike(r"^[+-]?\d+$"), x.try_cast("decimal(38,0)"))


def _wrong(x: Column, kind) -> Column:
    """Whether a given value is none that the field may have."""
    if kind == "dialect":
        return ~ort.casefold(x).isin(*DIALECTS)
    if kind == "boolean":
        return ~ort.casefold(x).isin(*YES, *NO)
    if isinstance(kind[0], str):
        return ~x.isin(*kind)
    low, high = kind
    fits = _number(x).isNotNull()
    fits = fits if low is None else fits & (_number(x) >= low)
    return ~F.coalesce(fits if high is None else fits & (_number(x) <= high), F.lit(False))


def checked(requests: DataFrame, endpoint: str = "endpoint", given: str = "given") -> DataFrame:
    """Requests (an endpoint, and a map of strings) with code and field of their first fault, and dialect, random and limit of good ones."""
    arg = lambda name: F.nullif(F.trim(F.try_element_at(F.col(given), F.lit(name))), F.lit(""))
    code = field = F.lit(None).cast("string")
    for name, ((no_query, invalid, unsupported), fields) in ENDPOINTS.items():
        here = F.col(endpoint) == name
        faults = []
        if no_query:
            query = ort.normalized(F.coalesce(F.try_element_at(F.col(given), F.lit("q")), F.lit("")))
            if name == "pattern":  # its stars are no marks
                query = F.trim(F.coalesce(F.try_element_at(F.col(given), F.lit("q")), F.lit("")))
            faults.append((query == "", no_query, "q"))
        if unsupported:
            faults += [(F.map_contains_key(F.col(given), F.lit(u)), unsupported, u) for u in UNSUPPORTED]
        faults += [(F.coalesce(arg(f).isNotNull() & _wrong(arg(f), kind), F.lit(False)), invalid, f) for f, kind in fields]
        first = F.get(F.array_compact(F.array(*[F.when(wrong, F.struct(F.lit(c).alias("code"), F.lit(f).alias("field"))) for wrong, c, f in faults])), F.lit(0))
        code, field = F.when(here, first["code"]).otherwise(code), F.when(here, first["field"]).otherwise(field)
    code = F.when(F.col(endpoint).isin(*ENDPOINTS), code).otherwise("UNKNOWN_ENDPOINT")
    d = requests.withColumns({"code": code, "field": field})
    good = F.col("code").isNull()
    dialects = F.create_map(*[F.lit(v) for p in DIALECTS.items() for v in p])
    return d.withColumns(
        {
            "dialect": F.when(good, F.try_element_at(dialects, ort.casefold(arg("dialect")))),
            "random": F.when(good, F.coalesce(ort.casefold(arg("random")).isin(*YES), F.lit(False))),
            "limit": F.when(good, F.coalesce(_number(arg("limit")).cast("int"), F.lit(DEFAULT_LIMIT))),
        }
    )
