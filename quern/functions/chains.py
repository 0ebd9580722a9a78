"""Chains of verb extensions as a table."""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

_HIGH, _MID, _ALL = ("a", "i", "u", ""), ("e", "o"), ("a", "e", "i", "o", "u", "")
# Surface, type, style and the last vowels before it that it may follow ("" is none).
EXTENSIONS = (
    ("anur", "reversive", "long", ("a",)), ("enur", "reversive", "long", ("e",)), ("inur", "reversive", "long", ("i",)),
    ("onor", "reversive", "long", ("o",)), ("unur", "reversive", "long", ("u",)), ("urur", "repetitive", "", ("a", "e", "i", "u", "")),
    ("oror", "repetitive", "", ("o",)), ("idz", "causative", "dz", _HIGH), ("edz", "causative", "dz", _MID),
    ("its", "causative", "ts", _HIGH), ("ets", "causative", "ts", _MID), ("is", "causative", "", _HIGH), ("es", "causative", "", _MID),
    ("ir", "applicative", "", _HIGH), ("er", "applicative", "", _MID), ("ik", "neuter", "", _HIGH), ("ek", "neuter", "", _MID),
    ("iw", "passive", "", _HIGH), ("ew", "passive", "", _MID), ("an", "reciprocal", "", _ALL),
    ("ur", "reversive", "short", ("a", "e", "i", "u")), ("or", "reversive", "short", ("o",)), ("w", "passive", "", _ALL),
)
# The order in which extensions follow each other.
ORDER = ("causative", "applicative", "reciprocal", "reversive", "repetitive", "neuter", "passive")
# Styles that are read but not made.
GATED = {("causative", "dz"), ("causative", "ts"), ("reversive", "short")}
MOST = 3


def last_vowel(x: str) -> str:
    return next((c for c in reversed(x) if c in "aeiou"), "")


@lru_cache
def chains() -> list[tuple[str, str, str, tuple[str, ...], bool]]:
    """Every legal chain of up to three: suffix, its surfaces and types (with commas), first triggers, whether it is gated.

    Inside a chain each extension must agree with the last vowel of the one before it; where that has none (``w``), the
    chain ends, as a passive comes last.
    """
    out = []
    for n in range(1, MOST + 1):
        for chain in permutations(EXTENSIONS, n):
            types = [ORDER.index(e[1]) for e in chain]
            if types != sorted(set(types)):
                continue
            if all(last_vowel(a[0]) in b[3] for a, b in zip(chain, chain[1:], strict=False)):
                gated = any((e[1], e[2]) in GATED for e in chain)
                out.append(("".join(e[0] for e in chain), ",".join(e[0] for e in chain), ",".join(e[1] for e in chain), chain[0][3], gated))
    return out
