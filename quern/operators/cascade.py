"""Many look-ups at once through tiers, each of which gets only what those before it left.

A tier's answers are anti-joined away before the next runs, so the dear tiers (readings, likeness) see few look-ups.
``search`` has five: entries, forms, entries of readings, and by likeness entries and forms (blocks of both sides are held
against each other, and of each block only what may be among the first answers comes out); ``resolution`` has three and
takes one entry for each surface, and ``SurfaceIndex`` keeps those as a table bucketed by surface, which later joins read
in place.

Edge cases: look-ups are folded; repeated ones count once; null or blank ones are dropped; a look-up that has readings but
none of a public entry gets nothing, as it is no spelling mistake.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import orthography as ort
from quern.functions import spelling
from quern.operators import lattice, ordered
from quern.sources import jsonl

LIMIT = 20
#: Tenths of their trigrams that two spellings share at least.
TENTHS = 3
TIERS = ("exact_lemma", "exact_form", "morphology_lemma", "fuzzy_lemma", "fuzzy_form")


def without(left: DataFrame, hits: DataFrame, key: str = "q") -> DataFrame:
    """What a tier has not answered."""
    return left.join(hits.select(key).distinct(), key, "left_anti")


def _parts(grams: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the rows of lists, and where each row's items begin (and the last ends)."""
    sizes = pc.list_value_length(grams).to_numpy().astype(np.int64)
    return sizes, np.concatenate([[0], np.cumsum(sizes)])


def _pairs_of_blocks(best: int | None, kinds: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What is alike of one block of spellings and one of look-ups: postings of the block's trigrams, counted for each look-up."""

    def pairs(known: pa.Table, asked: pa.Table) -> pa.Table:
        (nb, _), (na, begin) = _parts(known["b"]), _parts(asked["a"])
        each = pa.concat_arrays([x for t in (known["b"], asked["a"]) for x in (pc.list_flatten(t).cast(pa.string()).combine_chunks(),)])
        ids = each.dictionary_encode().indices.to_numpy()
        held, sought = ids[: nb.sum()], ids[nb.sum() :]
        order = np.argsort(held, kind="stable")
        holder = np.repeat(np.arange(len(nb)), nb)[order]
        starts = np.searchsorted(held[order], np.arange(len(ids) + 1))
        of_kind = [known[k].to_numpy(zero_copy_only=False).astype(bool) for k in kinds] or [np.ones(len(nb), bool)]
        rows, hits, values = [], [], []
        for i in range(len(na)):
            met = [holder[starts[g] : starts[g + 1]] for g in sought[begin[i] : begin[i + 1]]]
            if not met:
                continue
            both = np.bincount(np.concatenate(met), minlength=len(nb))
            near = np.flatnonzero((both > 0) & ((10 + TENTHS) * both >= TENTHS * (na[i] + nb)))
            value = both[near] / (na[i] + nb[near] - both[near])
            if best and len(near) > best:
                keep = np.zeros(len(near), bool)
                for k in of_kind:
                    mine = value[k[near]]
                    least = np.partition(mine, -best)[-best] if len(mine) > best else 0
                    keep |= k[near] & (value >= least)  # ties are all kept: their order is by name
                near, value = near[keep], value[keep]
            rows.append(np.full(len(near), i)), hits.append(near), values.append(value)
        rows, hits, values = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, hits, values))
        return pa.table([asked["q"].take(rows.astype(np.int64)), known["spelling"].take(hits.astype(np.int64)), pa.array(values, pa.float64())], ["q", "spelling", "similarity"])

    return pairs


def alike(asked: DataFrame, known: DataFrame, best: int | None = None, kinds: list[str] = (), block: int = 8192) -> DataFrame:
    """Pairs (q, spelling) that share ``TENTHS`` of their trigrams or more, with ``similarity``.

    Exact: every look-up meets every spelling that it shares a trigram with, block by block; a task holds one block of each
    side.  With ``best``, pairs that have so many better ones of each of their ``kinds`` (boolean columns of ``known``) in
    one block may be left out.
    """
    k, q = known.select("spelling", *kinds, spelling.word_trigrams(F.col("spelling")).alias("b")), asked.select("q", spelling.word_trigrams(F.col("q")).alias("a"))
    n, m = known.count() // block + 1, asked.count() // block + 1
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    in_block = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
    k = k.where("size(b) > 0").withColumns({"kb": in_block("spelling", n), "qb": all_of(m)})
    q = q.where("size(a) > 0").withColumns({"qb": in_block("q", m), "kb": all_of(n)})
    of = lambda d: d.repartition(n * m, "kb", "qb").groupBy("kb", "qb")  # noqa: E731  # much work for few bytes
    return of(k).cogroup(of(q)).applyInArrow(_pairs_of_blocks(best, list(kinds)), "q string, spelling string, similarity double")


def folded(asked: DataFrame) -> DataFrame:
    return asked.select(ort.normalized(F.col("q")).alias("q")).where("q <> ''").distinct()


def search(asked: DataFrame, entries: DataFrame, forms: DataFrame, limit: int = LIMIT) -> DataFrame:
    """q, match, place, entry, form, similarity: the answers to each look-up (column q).

    ``entries``: headword, entry (its name) and public; ``forms``: form and entry, of public entries.  Entries come before
    forms; readings in their own order; likeness by how alike, then by name; ``limit`` answers at most.
    """
    asked = folded(asked)
    public = entries.where("public").select("headword", "entry")
    kind = lambda d, n, order, form=None, alike=None: d.select(
        "q", F.lit(n).alias("tier"), F.col(order).cast("double").alias("order") if order else F.lit(0.0).alias("order"), "entry",
        (F.col(form) if form else F.lit(None).cast("string")).alias("form"), (F.col(alike) if alike else F.lit(None).cast("double")).alias("similarity"),
    )
    exact = kind(asked.join(public, F.col("headword") == F.col("q")), 0, None)
    formed = kind(asked.join(forms, F.col("form") == F.col("q")), 1, None, "form")
    lexical = exact.union(formed)

    left = jsonl.kept(without(asked, lexical), "unanswered")
    read = lattice.readings(left.select(F.col("q").alias("surface")), entries.select("headword", "entry"))
    read = read.groupBy(F.col("surface").alias("q"), "entry").agg(F.min("rank").alias("rank"))
    read = jsonl.kept(read, "read")
    morphology = kind(read.join(public.select("entry"), "entry", "left_semi"), 2, "rank")

    left = jsonl.kept(without(left, read), "unread")
    as_is = lambda d, c, lemma: d.select(F.col(c).alias("spelling"), F.lit(lemma).alias("lemma"), F.lit(not lemma).alias("form"))
    spelled = as_is(public, "headword", True).union(as_is(forms, "form", False)).groupBy("spelling").agg(F.max("lemma").alias("lemma"), F.max("form").alias("form"))
    near = jsonl.kept(alike(left, jsonl.kept(spelled, "spelled"), limit, ["lemma", "form"]), "near")
    lemma = near.join(public, F.col("headword") == F.col("spelling")).withColumn("order", -F.col("similarity"))
    form = near.join(forms, F.col("form") == F.col("spelling")).withColumn("order", -F.col("similarity"))
    found = lexical.union(morphology).union(kind(lemma, 3, "order", None, "similarity")).union(kind(form, 4, "order", "form", "similarity"))
    w = Window.partitionBy("q").orderBy("tier", "order", "entry", "form")
    d = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return d.select("q", F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1).alias("match"), "place", "entry", "form", "similarity")


def resolution(surfaces: DataFrame, entries: DataFrame, forms: DataFrame) -> DataFrame:
    """surface, entry, tier (0 itself, 1 a form, 2 read): the first entry that each surface resolves to, if any."""
    left = surfaces.select("surface").distinct()
    exact = left.join(entries.groupBy(F.col("headword").alias("surface")).agg(F.min("entry").alias("entry")), "surface").withColumn("tier", F.lit(0))
    left = jsonl.kept(without(left, exact, "surface"), "not-exact")
    formed = left.join(forms.groupBy(F.col("form").alias("surface")).agg(F.min("entry").alias("entry")), "surface").withColumn("tier", F.lit(1))
    left = without(left, formed, "surface")
    read = lattice.readings(left, entries.select("headword", "entry")).where("rank = 1").select("surface", "entry").withColumn("tier", F.lit(2))
    return exact.unionByName(formed).unionByName(read)


class SurfaceIndex:
    """An inverted index surface -> entry, kept as a table in buckets of surfaces below the shared folder.

    A join on surface reads the buckets in place: only the other side is dealt out.  Surfaces that are not in the index yet
    can be added (``extended``); those in it are not resolved again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @classmethod
    def built(cls, resolved: DataFrame, buckets: int | None = None) -> SurfaceIndex:
        """Writes (surface, entry, tier); as many buckets as shuffles have partitions, so that joins deal out alike."""
        spark = resolved.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"surface_index_{uuid.uuid4().hex}"
        to = resolved.select("surface", "entry", "tier").repartition(n, "surface").write.bucketBy(n, "surface").sortBy("surface")
        to.option("path", jsonl.new_folder(spark, "surface-index")).saveAsTable(name)
        return cls(spark, name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def extended(self, surfaces: DataFrame, entries: DataFrame, forms: DataFrame) -> SurfaceIndex:
        """The index with the surfaces that it lacks; the old table stays."""
        new = resolution(without(surfaces.select("surface").distinct(), self.table(), "surface"), entries, forms)
        return SurfaceIndex.built(self.table().unionByName(new))


#: The place of a token as one number: lesson (10 digits), page (19) and line (9: an array of lines holds fewer), in order.
_PLACE = "decimal(38,0)"


def tagged(source: DataFrame, index: SurfaceIndex, tokens: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Entry by entry of the index how often it occurs, in how many surfaces, and where first.

    ``tokens`` of the source: surface, lesson, page, line (its number) and context; the source has at least page, from 0.
    Occurrences are added up by surface before they meet the index, and carry their place as a number, not their context:
    that is looked up afterwards, in the pages where an entry occurs first.  A lesson that is not known counts as 1.
    """
    digits = lambda n: F.lit(f"1{'0' * n}").cast(_PLACE)
    known = F.coalesce("lesson", F.lit(1))
    place = (known.cast("decimal(10,0)") * digits(28).cast("decimal(29,0)")).cast(_PLACE) + F.col("page").cast("decimal(19,0)") * F.lit(10**9).cast("decimal(10,0)") + F.col("line")
    by = tokens(source).select("surface", place.cast(_PLACE).alias("place")).groupBy("surface").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    d = by.join(index.table(), "surface")
    d = d.groupBy("entry").agg(F.sum("n").alias("occurrences"), F.count("*").alias("surfaces"), F.min("tier").alias("tier"), F.min("place").alias("place"))
    page = F.expr("CAST(place % CAST('1e28' AS DECIMAL(29,0)) AS DECIMAL(28,0)) div 1000000000")
    firsts = jsonl.kept(d.withColumns({"page": page.cast("long"), "line": (F.col("place") % 10**9).cast("int")}), "firsts")
    firsts = firsts.withColumn("lesson", F.expr("place div CAST('1e28' AS DECIMAL(29,0))").cast("int"))

    pages = source.join(firsts.select("page").distinct(), "page", "left_semi")
    at = tokens(pages).select("surface", known.alias("lesson"), "page", "line", F.left("context", F.lit(200)).alias("context"))
    lines = firsts.select("lesson", "page", "line").distinct()
    found = at.join(lines, ["lesson", "page", "line"], "left_semi").join(index.table().select("surface", "entry"), "surface")
    contexts = found.join(firsts.select("entry", "lesson", "page", "line"), ["entry", "lesson", "page", "line"]).groupBy("entry").agg(F.min("context").alias("context"))
    return firsts.join(contexts, "entry", "left").select("entry", "occurrences", "surfaces", "tier", "lesson", "page", "context")
