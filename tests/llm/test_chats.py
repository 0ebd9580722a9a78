"""Chat formatting: random texts full of marks come back, the machine stops where it should, odd rows."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quern.llm import chats

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["\\", "[SYS]", "[/SYS]", "<s>", "</s>", "[INST", "[/INST]", "<", "[", "]", "a", "\n", "é", "[ROLE]", "[/TURN]", "/s>", "s>", " ", "\U0001f600"]


def test_any_text_comes_back(spark):
    draw = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "[ROLE]\\", None, ""]
    rows = [(i, t, draw.choice(roles), "".join(draw.choices(BITS, k=draw.randint(0, 12)))) for i in range(200) for t in range(5)]
    rows += [(1000, 0, "user", "[x\\<" * 100_000), (1000, 1, "assistant", "y" * 400_000), (1001, 0, "user", None)]
    draw.shuffle(rows)
    d = chats.with_turns(chats.formatted(spark.createDataFrame(rows, SCHEMA)))
    got = {r.conv_id: r for r in d.select("conv_id", "turns", "loss_text", "formatted", "segments").collect()}
    for i in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == i), key=lambda r: r[1])]
        assert [(t.role, t.text) for t in got[i].turns] == want
        assert got[i].loss_text == "".join(t for role, t in want if role == "assistant")
        assert got[i].formatted == "".join(s.text for s in got[i].segments)


def test_the_machine_names_the_broken_turn(spark):
    cases = {
        "system user assistant": None, "user assistant user assistant": None, "user": 1, "assistant": 0, "user system": 1,
        "user assistant assistant user": 2, "system system": 1, "system": 1, "user tool": 1, "user assistant user": 3,
    }
    rows = [(i, t, role, "x") for i, roles in enumerate(cases) for t, role in enumerate(roles.split())]
    got = {r.conv_id: r.broken_turn for r in chats.formatted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == dict(enumerate(cases.values()))


def test_templates_that_could_be_misread_are_refused():
    for marks in ({"user": ("[A]", "[A[B]")}, {"user": ("[A]", "[A]x")}, {"user": ("[", "]]")}, {"user": ("\\a", "[b]")}):
        with pytest.raises(ValueError):
            chats.Template(marks, ("(R)", "(/R)", "(/T)"), (), {}, ())
    with pytest.raises(ValueError):
        chats.Template({"user": ("[A]", "[B]"), "assistant": ("[A]", "[C]")}, ("(R)", "(/R)", "(/T)"), (), {}, ())


def test_another_template(spark):
    template = chats.Template(
        {"q": ("{q}", "{/}"), "a": ("{a}", "{/}")}, ("{r}", "{.}", "{/}"), ("a", "q"), {("start", "q"): "q", ("q", "a"): "start"}, ("start",)
    )
    rows = [(1, 0, "q", "{/}{q}\\"), (1, 1, "a", "\\{a}"), (2, 0, "q", ""), (2, 1, "z", "{.}")]
    d = chats.with_turns(chats.formatted(spark.createDataFrame(rows, SCHEMA), template), template)
    got = {r.conv_id: r for r in d.collect()}
    assert [tuple(t) for t in got[1].turns] == [("q", "{/}{q}\\"), ("a", "\\{a}")] and got[1].broken_turn is None
    assert [tuple(t) for t in got[2].turns] == [("q", ""), ("z", "{.}")] and got[2].broken_turn == 1
    assert got[1].loss_text == "{/}{q}\\\\{a}"


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a"), (None, 1, "user", "a"), (-1, 0, None, None), (7, None, "assistant", "late"), (7, 0, "user", "x")]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({"segments": F.lit(1), "probe": F.lit("p"), "turns": F.lit(2)})
    got = chats.round_trip(d).collect()
    assert sorted((r.conv_id or 0, r.n_turns) for r in got) == [(-1, 1), (-1, 2), (0, 2), (7, 2)]
    seven = next(r for r in got if r.conv_id == 7)
    assert seven.turns_sha256 == hashlib.sha256(b"assistant\nlate\nuser\nx\n").hexdigest()
    assert [r.conv_id for r in chats.round_trip(d.limit(0)).collect()] == [-1]
    assert chats.formatted(d.limit(0)).count() == 0
