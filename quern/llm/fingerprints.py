"""Document fingerprints by winnowing, in DataFrame expressions only.

Every run of ``k`` words has a hash, built by doubling (a run of two from two words, of four from two runs of two, ...).
Of each window of ``w`` consecutive runs the one of least hash is kept, the rightmost among equals; a kept run's
position is the number of its first word.  Two texts that share ``w + k - 1`` consecutive words therefore share a kept
hash.  Hash and position travel in one long (33 bits of hash, 30 of reversed position), so that a plain minimum of
longs also settles ties.

Edge cases: a null text counts as empty; a text without words has an empty fingerprint; one of fewer than ``k`` words
has its whole sequence as the only run; one of fewer than ``w`` runs has one window.  Two empty fingerprints are
alike (1.0), an empty and a full one are not (0.0).  Equal texts have equal fingerprints at any doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import common

K, W = 4, 6
_POSITION_BITS = 30
_LAST = (1 << _POSITION_BITS) - 1


def _pairwise(df: DataFrame, column: str, apart: int, join: Callable[[Column, Column], Column]) -> DataFrame:
    """Replaces an array by join(value, value ``apart`` places on): a step of its own, so that nothing is done twice."""
    n = F.greatest(F.size(column) - apart, F.lit(0))
    return df.withColumn(column, F.zip_with(F.slice(column, 1, n), F.slice(column, apart + 1, n), join))


def with_runs(df: DataFrame, column: str, k: int) -> DataFrame:
    """Replaces an array of hashes by the hashes of all its runs of ``k`` (a power of two) values."""
    size = 1
    while size < k:
        df = _pairwise(df, column, size, lambda a, b: F.xxhash64(a, b))
        size *= 2
    return df


def with_least(df: DataFrame, column: str, w: int) -> DataFrame:
    """Replaces an array by the least of each ``w`` consecutive values."""
    size = 1
    while size < w:
        step = min(size, w - size)
        df = _pairwise(df, column, step, lambda a, b: F.least(a, b))
        size += step
    return df


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Adds ``out``: an array of kept (hash, position) values of the column ``text``, in order of position."""
    if k & (k - 1) or k < 1 or w < 1:
        raise ValueError("k is a power of two, w at least 1")
    a, b, c = (f"__{out}_{i}" for i in "abc")
    df = df.withColumn(a, F.transform(common.words(F.col(text)), lambda x: F.xxhash64(x)))
    df = df.withColumn(b, F.when((F.size(a) > 0) & (F.size(a) < k), F.array(F.xxhash64(F.col(a)))))
    df = with_runs(df, a, k).withColumn(a, F.coalesce(b, a))
    packed = F.transform(
        F.col(a),
        lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 31), _POSITION_BITS).bitwiseOR(F.lit(_LAST) - i.cast("long")),
    )
    df = df.withColumn(a, packed)
    df = df.withColumn(c, F.when(F.size(a) == 0, F.col(a)).when(F.size(a) <= w, F.array(F.array_min(a))))
    return with_least(df, a, w).withColumn(out, F.coalesce(c, F.array_distinct(a))).drop(a, b, c)


def hashes(kept: Column) -> Column:
    return F.transform(kept, lambda x: F.shiftright(x, _POSITION_BITS))


def positions(kept: Column) -> Column:
    return F.transform(kept, lambda x: (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("int"))


def as_text(kept: Column) -> Column:
    """The kept hashes with their positions, as one string."""
    return F.array_join(
        F.transform(
            kept,
            lambda x: F.concat(
                F.lower(F.hex(F.shiftright(x, _POSITION_BITS))),
                F.lit("@"),
                (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("string"),
            ),
        ),
        " ",
    )


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``: the shared share (Jaccard) of two arrays of distinct hashes; of two empty ones 1."""
    df = df.withColumn(out, F.size(F.array_intersect(a, b)))
    either = F.size(a) + F.size(b) - F.col(out)
    return df.withColumn(out, F.when(either == 0, F.lit(1.0)).otherwise(F.col(out) / either))


def edited_documents(documents: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each text and of the text with its last quarter replaced by the start of the next document's.

    The next document is the next by doc_id (nulls first; among rows of one doc_id by text), after the last the first.
    Texts are dealt once, by ranges of doc_id whose first documents also go to the range before.
    """
    spark = documents.sparkSession
    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    starts = common.range_starts(d, "doc_id", 4 * common.partitions(spark))
    has_null = starts == [] or not d.where(F.col("doc_id").isNull()).isEmpty()
    home = common.range_number(F.col("doc_id"), starts)
    last = max(0, len(starts) - 1)
    first = F.col("doc_id").isNull() if has_null else F.col("doc_id") == F.lit(starts[0])
    begins = F.col("doc_id").isin(starts[1:]) if len(starts) > 1 else F.lit(False)
    copies = F.array_compact(
        F.array(
            F.struct(home.alias("range"), F.lit(0).alias("halo")),
            F.when(begins, F.struct((home - 1).alias("range"), F.lit(1).alias("halo"))),
            F.when(first, F.struct(F.lit(last).alias("range"), F.lit(2).alias("halo"))),
        )
    )
    d = d.select(F.explode(copies).alias("at"), "doc_id", "text").select("at.range", "at.halo", "doc_id", "text")
    d = with_fingerprint(d.repartition("range"), "text", "kept", k, w)
    order = Window.partitionBy("range").orderBy("halo", F.col("doc_id").asc_nulls_first(), "text")
    d = d.withColumn("next", F.lead(F.struct("text", "kept")).over(order)).where("halo = 0")
    d = d.withColumn("n_chars", F.length("text").cast("long"))
    d = d.withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    d = d.withColumn(
        "edited",
        F.concat(
            F.substring("text", F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")),
            F.substring("next.text", F.lit(1), F.col("cut")),
        ),
    )
    d = with_fingerprint(d, "edited", "edited_kept", k, w)
    d = d.withColumns({h: F.array_distinct(hashes(F.col(c))) for h, c in (("h", "kept"), ("e", "edited_kept"), ("n", "next.kept"))})
    d = with_likeness(with_likeness(d, "h", "e", "near_edited"), "h", "n", "near_next")
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("kept")).alias("fingerprint"),
        as_text(F.col("edited_kept")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        positions(F.col("kept")).alias("positions"),
    )
