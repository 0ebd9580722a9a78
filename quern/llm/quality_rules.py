"""Quality rules: an ordered list of threshold conjunctions, learned by sequential covering from labelled statistics.

``with_statistics`` measures texts in DataFrame expressions only.  ``learn`` grows one rule at a time on two thirds of
the labelled rows (the condition of greatest information gain is added until no good row is covered), prunes its last
conditions on the other third, keeps it if it stays precise there, takes the rows it covers away and goes on with the
rest.  ``verdict`` turns the list into one Spark conditional expression.  The learner gets at most ``MAX_LABELLED``
rows of numbers, picked by a hash of doc_id; everything else covers all rows.

Edge cases: a null text has no words, and base-fails as every text of fewer than 20 words does; a text without words
has 0 in every rate; without labels (or with labels of one kind) there are no rules and only the base check decides;
labels with a null doc_id or quality are left out; repeated rows are judged alike; further columns stay as they are.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import common
from quern.llm.fingerprints import with_runs

MAX_LABELLED = 4096
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "bang_rate", "words_a_line")


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the COUNTS (longs) and RATES (doubles) of a text column, which stays as it is."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__w", common.words(F.col(text)))
    df = df.withColumns(
        {
            "__h": F.transform("__w", lambda x: F.xxhash64(x)),
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
            "__upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
            "__bang": F.length(F.regexp_replace(t, r"[^!]+", "")),
            "__l": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    ).drop("__w")
    df = with_runs(df, "__h", REPEAT_WINDOW)
    df = df.withColumns(
        {
            "__lines": F.size("__l"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "__s": F.when(
                F.size(F.array_distinct("__h")) < F.size("__h"),
                F.array_sort(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            ),
        }
    ).drop("__l", "__h")
    same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
    near = F.transform(
        F.col("__s"),
        lambda x, i: F.when(same(x, F.get("__s", i - 1)) | same(x, F.get("__s", i + 1)), x["i"]),
    )
    df = df.withColumn("__p", F.array_sort(F.array_compact(near))).drop("__s")
    steps = F.zip_with(
        F.col("__p"),
        F.slice("__p", 2, F.greatest(F.size("__p") - 1, F.lit(0))),
        lambda a, b: F.least(F.coalesce(b - a, F.lit(REPEAT_WINDOW)), F.lit(REPEAT_WINDOW)).cast("long"),
    )
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.when(F.col("__p").isNull(), F.lit(0).cast("long")).otherwise(covered))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.withColumns(
        {
            "mean_word": rate("word_chars", "n_words"),
            "symbol_rate": rate("n_symbols", "n_words"),
            "dup_line_rate": rate("n_dup_lines", "__lines"),
            "repeat_rate": rate("n_repeat_words", "n_words"),
            "upper_rate": rate("__upper", "word_chars"),
            "bang_rate": rate("__bang", "n_words"),
            "words_a_line": rate("n_words", "__lines"),
        }
    ).drop("__upper", "__bang", "__lines", "__p")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        at = F.col(self.feature)
        return at >= F.lit(self.threshold) if self.above else at <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covered(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def _best_condition(rows: list[dict], features: tuple[str, ...]) -> Condition | None:
    """The condition of greatest gain for bad rows: each feature's sorted values are swept once from either side."""
    bad = sum(r["bad"] for r in rows)
    if not bad or bad == len(rows):
        return None
    prior, best, found = math.log2(bad / len(rows)), 1e-9, None
    for f in features:
        for above in (True, False):
            ordered = sorted(((r[f], r["bad"]) for r in rows), reverse=above)
            p = 0
            for i, (value, is_bad) in enumerate(ordered):
                p += is_bad
                if i + 1 < len(ordered) and ordered[i + 1][0] != value and p:
                    gain = p * (math.log2(p / (i + 1)) - prior)
                    if gain > best:
                        best, found = gain, Condition(f, above, (value + ordered[i + 1][0]) / 2)
    return found


def learn(
    rows: list[dict],
    features: tuple[str, ...] = RATES,
    max_rules: int = 12,
    max_conditions: int = 4,
    precision: float = 0.85,
    least: int = 3,
) -> list[Rule]:
    """Rules for the bad ones of ``rows`` (numbers by feature; ``bad`` 0 or 1; ``key`` deals rows to growing or pruning)."""
    grow = [r for r in rows if zlib.crc32(str(r["key"]).encode()) % 3]
    prune = [r for r in rows if not zlib.crc32(str(r["key"]).encode()) % 3]
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule: Rule = ()
        inside = grow
        while len(rule) < max_conditions and (c := _best_condition(inside, features)):
            rule += (c,)
            inside = _covered(rule, inside)
        if not rule:
            break

        def worth(n: int, rule: Rule = rule) -> float:
            got = _covered(rule[:n], prune)
            p = sum(r["bad"] for r in got)
            return (2 * p - len(got)) / len(got) if got else -1.0

        rule = rule[: max(range(1, len(rule) + 1), key=lambda n: (worth(n), -n))]
        both = _covered(rule, grow) + _covered(rule, prune)
        bad = sum(r["bad"] for r in both)
        held = _covered(rule, prune)
        if bad < least or bad < precision * len(both) or sum(r["bad"] for r in held) < precision * len(held):
            break
        rules.append(rule)
        grow = [r for r in grow if not all(c.holds(r) for c in rule)]
        prune = [r for r in prune if not all(c.holds(r) for c in rule)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects a row, from 1; null: none does."""
    out = F.lit(None).cast("int")
    for n, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(reduce(lambda a, b: a & b, (c.column() for c in rule)), F.lit(n)).otherwise(out)
    return out


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def labelled(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[dict]:
    """Statistics of at most ``most`` labelled documents, the same ones at every run."""
    some = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    # at most `most` pairs of numbers
    some = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"])
    some = with_statistics(some).withColumn("failed", _base_failed())
    rows = some.select("doc_id", "quality", "failed", *RATES).collect()
    rows = sorted((r for r in rows if not r["failed"]), key=lambda r: r["doc_id"])  # the base check judges the others
    return [{f: r[f] for f in RATES} | {"bad": int(r["quality"] == 0), "key": r["doc_id"]} for r in rows]


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` with their statistics, ``base_failed``, ``rule`` (the rejecting rule) and ``kept``."""
    rules = learn(labelled(documents, labels))
    names = {c.lower() for c in (*COUNTS, *RATES, "base_failed", "rule", "kept")}
    d = with_statistics(documents.select(*[c for c in documents.columns if c.lower() not in names]))
    d = d.withColumn("base_failed", _base_failed()).withColumn("rule", verdict(rules))
    return d.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
