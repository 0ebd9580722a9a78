"""Smaller functions over spellings, locators and tokens, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import orthography as ort

BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def phonology(x: Column) -> Column:
    """Struct of graphemes, their count, syllables and theirs: word by word, hyphens at a word's start left out."""
    words = F.transform(F.filter(F.split(x, r"\s+"), lambda w: w != ""), lambda w: F.ltrim(w, F.lit("-")))
    g, s = F.flatten(F.transform(words, ort.graphemes)), F.flatten(F.transform(words, ort.syllables))
    return F.struct(g.alias("graphemes"), F.size(g).alias("grapheme_count"), s.alias("syllables"), F.size(s).alias("syllable_count"))


def word_trigrams(x: Column) -> Column:
    """Distinct trigrams of each word of letters and digits between two blanks before and one after it."""
    words = F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def public_id(prefix: str, uuid: Column) -> Column:
    """Prefix and the 128 bits of a uuid in lower-case base 32, without padding; null for a prefix of other letters."""
    h = F.replace(uuid, F.lit("-"), F.lit(""))
    digits = lambda x, n: F.lpad(F.conv(x, 16, 32), n, "0")  # noqa: E731  # 15 hexadecimal digits are 12 letters
    last = F.substring(digits(F.concat(F.substring(h, 31, 2), F.lit("000")), 4), 1, 2)  # 8 bits, and 2 to fill up
    made = F.concat(digits(F.substring(h, 1, 15), 12), digits(F.substring(h, 16, 15), 12), last)
    made = F.concat(F.lit(f"{prefix}_"), F.translate(made, "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32))
    return F.when(F.lit(prefix).rlike("^[a-z][a-z0-9]*$"), made)


def without_dialect(x: Column) -> Column:
    """A form without its dialect: bracketed, or bare after a hyphen."""
    return F.regexp_replace(F.trim(x), r"\s*\([A-Za-z]+\)$|(?<=-)\s+(?:Ko|K|M|Z)+$", "")


def first_token(x: Column) -> Column:
    return F.regexp_extract(F.ltrim(x), r"^(\S*)", 1)


def slug(x: Column) -> Column:
    """Lower-case letters and digits with single hyphens; ``entry`` if none is left."""
    made = F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("entry"))


def locator(x: Column) -> Column:
    """Struct of page, entry and slug of ``source:page_NNN:entry_NNN:slug``; null where it is none."""
    pattern = r"^[^:]+:page_(\d+):entry_(\d+):(.*)$"
    parts = [F.regexp_extract(x, pattern, i) for i in (1, 2, 3)]
    return F.when(x.rlike(pattern), F.struct(parts[0].cast("int").alias("page"), parts[1].cast("int").alias("entry"), parts[2].alias("slug")))


def tone_key(x: Column) -> Column:
    """A tone pattern without blanks, in capitals."""
    return F.upper(F.regexp_replace(x, r"\s+", ""))


def label_residue(x: Column) -> Column:
    """Whether a label still holds text of its entry."""
    return F.coalesce(x.rlike(r"[\[\]()]|(^|[^a-z])(cp|see)([^a-z]|$)|\.$") | (F.length(x) > 60), F.lit(False))


def cleaned_token(x: Column) -> Column:
    """A token in lower case without punctuation round it; null unless letters, hyphens and apostrophes are left."""
    bare = F.lower(F.regexp_replace(x, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", ""))
    return F.when(bare.rlike(r"^\p{L}[\p{L}'’\-]*$"), bare)


def vowelless(stem: Column) -> Column:
    return ~F.regexp_replace(stem, "a$", "").rlike("[aeiou]")


def digest(*fields: Column) -> Column:
    """SHA-256 of the fields' JSON, null fields absent."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)
