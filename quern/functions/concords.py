"""Concords of verbs: those of persons and of noun classes, with their features and how sure a reading with them is."""

from __future__ import annotations

from typing import NamedTuple

# persons' concords as subjects (surface, person and number, confidence).
PERSON_SUBJECTS = (("ndi", "1s", 0.86), ("u", "2s", 0.84), ("ti", "1p", 0.84), ("mu", "2p", 0.82))
# persons' concords as objects.
PERSON_OBJECTS = (("ndi", "1s", 0.86), ("ku", "2s", 0.84), ("ti", "1p", 0.84), ("mu", "3s", 0.84), ("va", "3p", 0.84), ("mu", "2p", 0.82))
# Noun classes in their order with the concords of subject and object.
CLASSES = (
    ("1", "u", "mu"), ("1a", "u", "mu"), ("2", "va", "va"), ("2a", "va", "va"), ("3", "u", "u"), ("4", "i", "i"), ("5", "ri", "ri"),
    ("6", "a", "a"), ("7", "chi", "chi"), ("8", "zvi", "zvi"), ("9", "i", "i"), ("10", "dzi", "dzi"), ("11", "ru", "ru"), ("12", "ka", "ka"),
    ("13", "tu", "tu"), ("14", "hu", "hu"), ("15", "ku", "ku"), ("16", "pa", "pa"), ("17", "ku", "ku"), ("18", "mu", "mu"), ("21", "ri", "ri"),
)
# Fixed value: how sure a reading with a noun class's concord is.
CLASS_CONFIDENCE = 0.78
#: Classes whose subject is ``a`` in negatives.
PERSONAL = ("1", "1a")


class Concord(NamedTuple):
    surface: str
    features: str
    confidence: float


def _longest_first(persons: tuple, classes: list[Concord]) -> list[Concord]:
    return sorted([Concord(*p) for p in persons] + classes, key=lambda c: -len(c.surface))


def subjects(classes: tuple = CLASSES, negative: bool = False) -> list[Concord]:
    """Longest first; persons before classes, these in their order.  A class without a concord has none here."""
    own = [Concord("a" if negative and n in PERSONAL else s, f"class {n}", CLASS_CONFIDENCE) for n, s, _ in classes if s]
    return _longest_first(PERSON_SUBJECTS, own)


def objects(classes: tuple = CLASSES) -> list[Concord]:
    return _longest_first(PERSON_OBJECTS, [Concord(o, f"class {n}", CLASS_CONFIDENCE) for n, _, o in classes if o])
