"""Spelling, graphemes and syllables as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The graphemes of the inventory, in three parts as they were added.
GRAPHEMES = (
    "dzv", "nzv", "tsv", "bv", "bw", "dy", "dz", "gw", "hw", "kw", "mb", "mh", "mw", "mv", "nd", "ng", "nh", "nj",
    "ny", "pf", "pw", "sh", "sv", "sw", "ts", "tw", "vh", "zh", "zv", "ch", "a", "e", "i", "o", "u", "b", "d", "f",
    "g", "h", "j", "k", "m", "n", "p", "r", "s", "t", "v", "w", "y", "z", "ngw", "ndw", "nkw", "nzw", "dzw", "ndv",
    "zvw", "tshw", "tsh", "mbw", "vw", "ty", "ph", "nk", "bh", "dh", "dw", "rw", "zhw", "nhw", "chw", "dyw",
)
# Cyrillic letters and the Latin letters they look like.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "u", "х": "x", "і": "i", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "U", "Х": "X", "к": "k", "м": "m", "н": "h", "т": "t",
}
CYRILLIC, LATIN = "".join(LOOKALIKES), "".join(LOOKALIKES.values())
MARKERS = "†*-"

#: Longest first; any other character stands for itself.
GRAPHEME = "(?s)(" + "|".join(sorted((g for g in GRAPHEMES if len(g) > 1), key=lambda g: (-len(g), g))) + "|.)"
SYLLABLE = r"(?s)([^aeiou]*[aeiou](?:[^aeiou]+$)?|[^aeiou]+)"
_END = "\x01"


def _folds() -> tuple[dict[str, str], set[str]]:
    """Letters with what full case folding makes of them, and those for which lower case is another thing (or depends on the word)."""
    letters = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    folds = {c: c.casefold() for c in letters if c.casefold() != c}
    other = {c for c in letters if c.casefold() != c.lower()} | {c for c in folds if ord(c) >= 0x530} | set("Σİ")
    return folds, other


def _ranges(letters: set[str]) -> list[tuple[int, int]]:
    parts: list[tuple[int, int]] = []
    for p in sorted(map(ord, letters)):
        if parts and p == parts[-1][1] + 1:
            parts[-1] = parts[-1][0], p
        else:
            parts.append((p, p))
    return parts


def _class(parts: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in parts)


def _plain(letters: set[str], least: int = 500) -> list[tuple[int, int]]:
    """Where none of the letters is: below the first thousands every stretch, above them long ones only."""
    gaps, at = [], 0
    for a, b in [*_ranges(letters), (0x110000, 0)]:
        if a > at and (at < 0x530 or a - at >= least):
            gaps.append((at, a - 1))
        at = b + 1
    return gaps


_FOLDS, _OTHER = _folds()
_LONGER = {c: f for c, f in _FOLDS.items() if len(f) > 1}
_ALIKE = {c: f for c, f in _FOLDS.items() if len(f) == 1}
_OTHER_CLASS, _LONGER_CLASS = f"[{_class(_ranges(_OTHER))}]", f"[{_class(_ranges(set(_LONGER)))}]"
#: A first look that most texts end at: a letter outside the stretches without such letters.
_UNUSUAL = f"[^{_class(_plain(_OTHER))}]"


def casefold(x: Column) -> Column:
    """Full case folding: lower case, but for texts with letters that fold to something else, or to several letters."""
    alike = F.translate(x, "".join(_ALIKE), "".join(_ALIKE.values()))
    longer = F.create_map(*[F.lit(v) for p in _LONGER.items() for v in p])
    several = F.array_join(F.transform(F.regexp_extract_all(alike, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(longer, c), c)), "")
    return F.when(x.rlike(_UNUSUAL) & x.rlike(_OTHER_CLASS), F.when(x.rlike(_LONGER_CLASS), several).otherwise(alike)).otherwise(F.lower(x))


def normalized(x: Column) -> Column:
    """White space collapsed, case folded, markers at the start taken away."""
    return F.ltrim(F.trim(F.regexp_replace(casefold(x), r"(?U)\s+", " ")), F.lit(MARKERS))


def graphemes(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(GRAPHEME), F.lit(1))


def inventory_regex(graphemes: tuple[str, ...]) -> str:
    """One group that takes the longest grapheme of an inventory, or else any character."""
    return "(?s)(" + "|".join([*map(re.escape, sorted(graphemes, key=lambda g: (-len(g), g))), "."]) + ")"


def syllables(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(SYLLABLE), F.lit(1))


def latin(x: Column) -> Column:
    """Letters that only look Latin replaced by those they look like."""
    return F.translate(x, CYRILLIC, LATIN)


def identity_key(x: Column, size: int | None = None) -> Column:
    """Lower-case letters and digits alone, as a key for texts that differ in layout; its first ``size`` characters."""
    key = F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")
    return key if size is None else F.left(key, F.lit(size))


def split_pattern(pattern: str) -> list[str]:
    """A pattern's parts: ``?`` (one grapheme), ``*`` (any number of them) and literal graphemes."""
    out: list[str] = []
    for piece in re.findall(r"[?*]|[^?*]+", pattern):
        if piece in "?*":
            out.append(piece)
        else:
            folded = " ".join(piece.casefold().split()).lstrip(MARKERS)
            out += re.findall(GRAPHEME, folded)
    return out


def pattern_regex(pattern: str) -> str:
    """A regular expression over graphemes that each end in a mark; it needs no look-around, so any engine takes it."""
    one = f"[^{_END}]+{_END}"
    parts = {"?": one, "*": f"(?:{one})*"}
    return "^" + "".join(parts.get(p) or re.escape(p) + _END for p in split_pattern(pattern)) + "$"


def pattern_bounds(pattern: str) -> tuple[int, int | None]:
    """Least and greatest number of graphemes that a pattern matches (None: open)."""
    parts = split_pattern(pattern)
    least = sum(p != "*" for p in parts)
    return least, None if "*" in parts else least


def matches(x: Column, pattern: str) -> Column:
    return F.concat(F.array_join(graphemes(x), _END), F.lit(_END)).rlike(pattern_regex(pattern))


def pattern_bounds_of(x: Column) -> tuple[Column, Column]:
    """Fewest and most graphemes that a pattern matches: ? is one, * any number (then there is no most)."""
    low = F.size(F.filter(graphemes(casefold(x)), lambda g: g != "*"))
    return low, F.when(~F.contains(x, F.lit("*")), low)
