"""Codes of word classes, dialect runs and tone brackets, and topics by keywords, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import orthography as ort

# Other spellings of a word class and its code.
POS_ALIASES = {
    "v t": "vt", "v i": "vi", "v t & i": "vti", "vt&i": "vti", "vt & i": "vti", "vt_i": "vti", "vi&t": "vti",
    "v i & t": "vti", "vt & vi": "vti", "vt_vi": "vti", "vit": "vti", "defective v": "defective_v", "def v": "defective_v",
    "compound defective v": "defective_v", "sfx": "suffix", "v sfx": "suffix", "infx": "infix",
    "orthographic_note": "note", "tense sign": "tense_sign", "": "unknown", "none": "unknown",
}
# The words that show a topic.
TOPICS = {
    "greetings": (
        "mhoro", "kwaziwai", "greet", "welcome", "say hello", "hello", "greeting",
    ),
    "family": (
        "amai", "baba", "hanzvadzi", "child", "son", "daughter", "mother", "father", "brother", "sister", "aunt",
        "uncle", "family",
    ),
    "environment": (
        "musha", "gomo", "rwizi", "mhuka", "sango", "river", "mountain", "animal", "forest", "tree", "rain", "sun",
        "weather", "nature",
    ),
    "time": (
        "nguva", "zuva", "mwaka", "nhasi", "mangwana", "time", "hour", "day", "year", "yesterday", "tomorrow", "month",
    ),
}
DIALECTS = "Ko|K|M|Z"


def pos_code(x: Column) -> Column:
    """The code of a word class; an unknown one keeps its folded spelling, null becomes empty."""
    folded = F.trim(F.regexp_replace(ort.casefold(x), r"(?U)\s+", " "))
    aliases = F.create_map(*[F.lit(v) for pair in POS_ALIASES.items() for v in pair])
    return F.when(x.isNull(), "").otherwise(F.coalesce(F.try_element_at(aliases, folded), folded))


def topic_regex(words: tuple[str, ...]) -> str:
    """Any of the words between characters that no word has; without look-around, so any engine takes it."""
    edge = r"[^\p{L}\p{N}_]"
    return rf"(?i)(?:^|{edge})(?:{'|'.join(words)})(?:{edge}|$)"


def topics(x: Column) -> Column:
    return F.array_compact(F.array(*[F.when(x.rlike(topic_regex(w)), t) for t, w in TOPICS.items()]))


def dialects(run: Column) -> Column:
    """The dialects of a run of their letters; none if anything else stands in it."""
    found = F.regexp_extract_all(run, F.lit(f"({DIALECTS})"), F.lit(1))
    return F.when(run.rlike(f"^(?:{DIALECTS})+$"), found).otherwise(F.array().cast("array<string>"))


def tones(bracket: Column, entry_dialects: Column) -> Column:
    """Array of (pattern, dialects) of a tone bracket; a lone pattern without dialects has those of its entry."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(bracket, r"[\[\]]", ""), ";"), lambda p: F.trim(p)), lambda p: p != "")
    made = F.transform(
        parts,
        lambda p: F.struct(F.substring_index(p, " ", 1).alias("pattern"), dialects(F.regexp_extract(p, r"^\S+\s+(.*)$", 1)).alias("dialects")),
    )
    lone = F.transform(made, lambda t: F.struct(t["pattern"].alias("pattern"), F.when(F.size(t["dialects"]) == 0, dialects(entry_dialects)).otherwise(t["dialects"]).alias("dialects")))
    return F.when(F.size(made) == 1, lone).otherwise(made)
