"""Chat formatting, in DataFrame expressions only: a machine over roles, a template of marks, segments with loss flags.

A ``Template`` declares the marks around each role's text, the roles that are learned, and the machine: from which state
a role may follow and which state it leads to, and in which states a conversation may end.  A conversation becomes an
array of segments (text, loss): for each turn its opening mark, its escaped text and its closing mark; only the text of
a learned role is under the loss.  Joined, the segments are the formatted conversation.

Texts are escaped so that no mark ever occurs in one and each can be had back: a backslash becomes two, and one is put
before what looks like a mark.  A mark's later characters hold no mark's first character (checked), so none can arise
where a text and a mark meet either.

A conversation that the machine refuses is formatted all the same: ``broken_turn`` is the number (from 0) of the first
turn that may not follow, the number of turns if the conversation may not end where it does, null if all is well.

Edge cases: a null text or role counts as empty; rows are ordered by turn (nulls first), ties by role, then escaped text, and
repeated rows are turns of their own; a role without marks of its own is spelled out between the marks for others; rows
with a null conv_id are one conversation of that name; an empty table gives none.  All turns of one conversation meet
in one row, because its digest is that of their sequence; they are escaped before they meet.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import common

#: Of the machine: the state before the first turn.
START = "start"


@dataclass(frozen=True)
class Template:
    #: Opening and closing mark of each role.
    marks: dict[str, tuple[str, str]]
    #: Marks around a role that has none, then those around its text.
    other: tuple[str, str, str]
    #: Roles whose text is under the loss.
    learned: tuple[str, ...]
    #: (state, role) to the next state.
    moves: dict[tuple[str, str], str]
    #: States in which a conversation may end.
    ends: tuple[str, ...]
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        controls = tuple(dict.fromkeys([x for pair in self.marks.values() for x in pair] + list(self.other)))
        opening = [o for o, _ in self.marks.values()] + [self.other[0]]
        first = {c[:1] for c in controls}
        if any(len(c) < 2 or "\\" in c or first & set(c[1:]) for c in controls):
            raise ValueError("a mark has two characters or more, no backslash, and no mark's first character after its own first")
        if len(set(opening)) < len(opening) or any(a != b and b.startswith(a) for a in controls for b in controls):
            raise ValueError("opening marks differ, and no mark begins another")
        object.__setattr__(self, "controls", controls)

    @property
    def any_mark(self) -> str:
        return "|".join(re.escape(c) for c in self.controls)


#: Instructions in brackets; a system turn may come first, then user and assistant take turns; the assistant ends.
INSTRUCT = Template(
    marks={"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")},
    other=("[ROLE]", "[/ROLE]", "[/TURN]"),
    learned=("assistant",),
    moves={
        (START, "system"): "asked for",
        (START, "user"): "asked",
        ("asked for", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    },
    ends=("answered",),
)


def escaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, rf"\\|(?={template.any_mark})", r"\\$0")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_segments(role: Column, text: Column, template: Template) -> Column:
    """The segments of one turn."""
    opening, closing = F.lit(template.other[0]), F.lit(template.other[2])
    opening = F.concat(opening, escaped(role, template), F.lit(template.other[1]))
    for name, (before, after) in template.marks.items():
        opening = F.when(role == name, F.lit(before)).otherwise(opening)
        closing = F.when(role == name, F.lit(after)).otherwise(closing)
    learned = role.isin(*template.learned) if template.learned else F.lit(False)
    parts = (opening, F.lit(False)), (escaped(text, template), learned), (closing, F.lit(False))
    return F.array(*[F.struct(t.alias("text"), loss.alias("loss")) for t, loss in parts])


def broken_turn(roles: Column, template: Template) -> Column:
    """Number of the first turn that the machine refuses, or of turns if it may not stop after them, else null."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    begin = F.struct(F.lit(START).alias("state"), F.lit(0).alias("at"))

    def step(now: Column, role: Column) -> Column:
        to = F.when(now["state"].isNotNull(), F.try_element_at(moves, F.concat(now["state"], F.lit("\n"), role)))
        return F.struct(to.alias("state"), (now["at"] + to.isNotNull().cast("int")).alias("at"))

    def stop(now: Column) -> Column:
        return F.when(now["state"].isNull() | ~now["state"].isin(*template.ends), now["at"])

    return F.aggregate(roles, begin, step, stop)


def formatted(conversations: DataFrame, template: Template = INSTRUCT, by: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """For each conversation its segments (text, loss), its number of turns and ``broken_turn``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        *by, F.struct("turn", role.alias("role"), turn_segments(role, text, template).alias("segments")).alias("at")
    )
    d = turns.groupBy(*by).agg(F.sort_array(F.collect_list("at")).alias("turns"))
    return d.select(
        *by,
        F.flatten("turns.segments").alias("segments"),
        F.size("turns").cast("long").alias("n_turns"),
        broken_turn(F.col("turns.role"), template).cast("long").alias("broken_turn"),
    )


def parsed(text: Column, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) of a formatted conversation, read from its marks alone."""
    first = re.escape("".join(sorted({c[0] for c in template.controls})))
    # possessive: read in a loop, not by recursion, however long the text
    body = rf"((?:[^\\{first}]++|\\.|(?!{template.any_mark})[{first}])*+)"
    end = "|".join(re.escape(c) for c in dict.fromkeys([after for _, after in template.marks.values()] + [template.other[2]]))
    known = "|".join(re.escape(before) for before, _ in template.marks.values())
    other = rf"{re.escape(template.other[0])}{body}{re.escape(template.other[1])}"
    whole = rf"(?s)(?:({known})|{other}){body}(?:{end})"

    def turn(x: Column) -> Column:
        mark, role = F.regexp_extract(x, whole, 1), unescaped(F.regexp_extract(x, whole, 2))
        for name, (before, _) in template.marks.items():
            role = F.when(mark == before, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescaped(F.regexp_extract(x, whole, 3)).alias("text"))

    return F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(0)), turn)


def with_turns(df: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Reads formatted conversations back: adds ``formatted``, ``turns`` (role, text) and ``loss_text`` (texts under the loss)."""
    d = df.withColumn("formatted", F.array_join("segments.text", ""))
    d = d.withColumn("turns", parsed(F.col("formatted"), template))
    learned = F.filter("segments", lambda s: s["loss"])
    return d.withColumn("loss_text", F.array_join(F.transform(learned, lambda s: unescaped(s["text"])), ""))


def digests(df: DataFrame) -> DataFrame:
    """conv_id, counts and digests of conversations that were read back."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(lines).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        sha(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "broken_turn",
    )


def write(conversations: DataFrame, path: str, template: Template = INSTRUCT, by: tuple[str, ...] = ("conv_id",)) -> None:
    formatted(conversations, template, by).write.parquet(path)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose two texts hold control strings; ``probe`` keeps it apart from any of that name."""
    probe = conversations.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    d = conversations.select("conv_id", "turn", "role", "text").withColumn("probe", F.lit(False))
    return d.unionByName(probe.withColumn("probe", F.lit(True)))


def round_trip(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Digests of all conversations and the probe, after they were written and read back."""
    spark = conversations.sparkSession
    at = common.new_folder(spark, "chats")
    write(with_probe(conversations), at, template, ("conv_id", "probe"))
    return digests(with_turns(spark.read.parquet(at), template))


#: ``round_trip`` under INSTRUCT, made from the turns themselves: the marks' lengths are added, the escapes counted.
SQL = r"""
WITH turns AS (
  SELECT conv_id, 0 AS probe, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 1, 'assistant', '</s>[INST] ok [/INST]'
), lengths AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|\[/?SYS\]|\[/?INST\]|</?s>|\[/?ROLE\]|\[/TURN\]')) AS chars,
    CASE role WHEN 'system' THEN 5 + 6 WHEN 'user' THEN 6 + 7 WHEN 'assistant' THEN 3 + 4
      ELSE 6 + 7 + 7 + length(role) + len(regexp_extract_all(role, '\\|\[/?SYS\]|\[/?INST\]|</?s>|\[/?ROLE\]|\[/TURN\]')) END AS marks,
    row_number() OVER w - 1 AS place,
    lag(role) OVER w AS before
  FROM turns WINDOW w AS (PARTITION BY conv_id, probe ORDER BY turn NULLS FIRST, role, text)
), judged AS (
  SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user')
    WHEN before IN ('system', 'assistant') THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' ELSE false END AS fits
  FROM lengths
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars + marks)::BIGINT AS formatted_chars,
  coalesce(min(place) FILTER (NOT fits), CASE WHEN max_by(role, place) <> 'assistant' THEN count(*) END) AS broken_turn
FROM judged GROUP BY conv_id, probe
"""
