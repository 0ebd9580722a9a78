"""MinHash near-duplicates with tensored banding; every link is confirmed on full shingle sets.

A document's minhashes form ``HALVES`` small collections of ``ROWS`` each, and a table's key combines two collections:
60 minhashes serve 190 tables, where plain banding of six rows would need 1140.  At a similarity of 0.8 two sets share
a key unless at most one of the 20 collections agrees: once in 80 000 cases.

Documents of one shingle set are one class, and classes meet in the tables.  A group of m classes in a bucket is never
expanded into its pairs: each class is compared with the bucket's smallest, first with the one it meets most often,
then with the others that are not yet in its component.  What is still apart in a bucket after that (the classes outside
its commonest component against all others) is met by the rarest shingles of their full sets, an exact filter that
leaves out no pair as alike as asked for (``prefix_pairs``), and confirmed.

Edge cases: a null text counts as empty; an empty set links with nothing; a text of fewer than ``k`` words is one
shingle; repeated rows are one class; rows that share a doc_id count as one document; a row with a null doc_id links
with nothing, has no component and is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import common
from quern.llm.bytes import Block, blocks, mix, window_hashes
from quern.llm.graphs import components

HALVES, ROWS = 20, 3
K, PERCENT = 5, 80

_SIGNATURE = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("halves", pa.list_(pa.int64()))]
)


def shingles(block: Block, k: int) -> list[np.ndarray]:
    """For each row its sorted distinct shingle hashes, of words with A-Z lowered."""
    starts, ends, bounds = block.words()
    words = block.hashes(starts, ends, fold=True)
    runs = window_hashes(words, k)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b], b - a, 0xA24BAED4963EE407))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def halves(sets: list[np.ndarray]) -> np.ndarray:
    """For each set (none of them empty) the hashes of its collections of minhashes."""
    values = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.zeros((len(sets), HALVES), np.uint64)
    salt = mix(np.arange(1, 2 * HALVES * ROWS + 1, dtype=np.uint64))
    for i in range(HALVES * ROWS):
        v = (values ^ salt[2 * i]) * (salt[2 * i + 1] | np.uint64(1))
        v ^= v >> np.uint64(32)
        v *= np.uint64(0x9E3779B97F4A7C15)
        h = i // ROWS
        out[:, h] = mix(out[:, h] ^ np.minimum.reduceat(v, first)) + np.uint64(h)
    return out


def signatures(documents: DataFrame, k: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets = shingles(block, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                tables: list = [None] * len(sets)
                for i, row in zip(full, halves([sets[i] for i in full]).view(np.int64) if full else (), strict=True):
                    tables[i] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.rows),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array(tables, pa.list_(pa.int64())),
                    ],
                    schema=_SIGNATURE,
                )

    d = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return d.mapInArrow(common.released(sign), "doc_id long, n long, sig binary, halves array<long>")


def compressed(documents: DataFrame) -> DataFrame:
    """doc_id and its text, compressed for the shuffle."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            raw = [pack(x.as_py() or b"") for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "z"])

    d = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return d.mapInArrow(common.released(squeeze), "doc_id long, z binary")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as alike as asked for; ``texts`` has the compressed texts of all ends."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        last: tuple = (None, None)

        def sets(raw: list[bytes]) -> list[np.ndarray]:
            out = []
            for block in blocks(pa.array([unpack(x) for x in raw], pa.binary())):
                out += shingles(block, k)
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                right, keep = sets(part["zb"]), []
                for i, raw in enumerate(part["za"]):
                    if last[0] != raw:
                        last = raw, sets([raw])[0]
                    both = len(np.intersect1d(last[1], right[i], assume_unique=True))
                    if 100 * both >= percent * (len(last[1]) + len(right[i]) - both) and both:
                        keep.append(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part[c][i] for i in keep], pa.int64()) for c in "ab"], ["a", "b"]
                )

    p = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("b"), F.col("z").alias("zb")), "b")
    p = p.join(texts.select(F.col("doc_id").alias("a"), F.col("z").alias("za")), "a")
    return p.select("a", "b", "za", "zb").mapInArrow(common.released(verify), "a long, b long").distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component."""
    for end in "ab":
        at = labels.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
        pairs = pairs.join(at, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs.where("ca <> cb").select("a", "b")


def prefix_pairs(ends: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``ends`` (b, component, out) of different components, one of them ``out``, that may be alike.

    Exact: shingles are ordered by how few ends have them, and two sets as alike as asked for share one of their first
    ``n - ceil(percent * n) + 1``; that shared shingle's places and the sizes also bound how much they can share.
    A shingle of a single end takes a place but is never listed.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                names, sets = part.column(0).to_numpy(), []
                for block in blocks(pa.array([unpack(x.as_py()) for x in part.column(1)], pa.binary())):
                    sets += shingles(block, k)
                sizes = np.array([len(x) for x in sets])
                columns = [np.repeat(names, sizes), np.repeat(sizes, sizes), np.concatenate(sets).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["b", "n", "shingle"])

    d = texts.join(ends.select(F.col("b").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "z")
    rows = common.written(d.mapInArrow(common.released(listed), "b long, n long, shingle long"), "shingles")
    many = rows.groupBy("shingle").agg(F.count("*").alias("ends")).where("ends > 1")
    rows = rows.join(many, "shingle")
    mine = Window.partitionBy("b")
    rows = rows.withColumn("single", F.col("n") - F.count("*").over(mine))
    rows = rows.withColumn("place", F.col("single") + F.row_number().over(mine.orderBy("ends", "shingle")))
    rows = rows.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    rows = common.written(rows.join(ends, "b").select("shingle", "b", "n", "place", "component", "out"), "prefixes")
    x = rows.where("out").select("shingle", *[F.col(c).alias(f"{c}_x") for c in ("b", "n", "place", "component")])
    most = 1 + F.least(F.col("n") - F.col("place"), F.col("n_x") - F.col("place_x"))
    fits = (
        (F.col("component") != F.col("component_x"))
        & (100 * F.least("n", "n_x") >= percent * F.greatest("n", "n_x"))
        & ((100 + percent) * most >= percent * (F.col("n") + F.col("n_x")))
    )
    pairs = x.join(rows, "shingle").where(fits)
    return pairs.select(F.least("b", "b_x").alias("a"), F.greatest("b", "b_x").alias("b")).distinct()


def near_duplicates(documents: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """For each row doc_id, n_shingles, component_id (the smallest doc_id linked with it over any path) and kept."""
    signed = common.written(signatures(documents, k), "signatures")
    classes = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(
        F.min("doc_id").alias("rep"), F.first("halves").alias("halves")
    )
    keys = F.flatten(
        F.transform(
            "halves",
            lambda x, i: F.transform(
                F.slice("halves", i + 2, F.lit(HALVES)), lambda y, j: F.xxhash64(x, y, i, i + 1 + j)
            ),
        )
    )
    rows = classes.select(F.explode(keys).alias("key"), F.col("rep").alias("b"))
    bucket = Window.partitionBy("key")
    rows = rows.select("key", "b", F.min("b").over(bucket).alias("a"), F.count("*").over(bucket).alias("size"))
    rows = common.written(rows.where("size > 1"), "buckets")  # `size` can't be judged below the window

    met = rows.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("times"))
    met = common.written(met, "met")
    ends = met.select(F.explode(F.array("a", "b")).alias("doc_id")).union(rows.select(F.col("b").alias("doc_id")))
    texts = compressed(documents).join(ends.distinct(), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("z").alias("z"))  # of rows that share a doc_id always the same one
    texts = common.written(texts, "texts")

    most = met.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a"))
    links = common.written(confirmed(most, texts, k, percent), "links")
    labels = components(links)
    found = confirmed(_apart(met, labels), texts, k, percent)
    links = common.written(links.union(found), "links")
    labels = components(links)

    # what is left in buckets of three or more: the classes outside a bucket's commonest component against all others
    left = rows.where("size > 2").select("key", "b")
    left = left.join(labels.select(F.col("id").alias("b"), "component"), "b", "left")
    left = left.select("key", "b", F.coalesce("component", "b").alias("component"))
    left = left.withColumns({"low": F.min("component").over(bucket), "high": F.max("component").over(bucket)})
    left = common.written(left.where("low <> high").select("key", "b", "component"), "apart")
    counts = left.groupBy("key", "component").count()
    common_one = counts.groupBy("key").agg(F.max_by("component", F.struct("count", -F.col("component"))).alias("main"))
    outside = left.join(common_one, "key").where("component <> main").select("b").distinct().withColumn("out", F.lit(True))
    ends = left.select("b", "component").distinct().join(outside, "b", "left")
    pairs = prefix_pairs(ends, texts, k, percent)
    pairs = common.written(pairs.join(met.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        links = common.written(links.union(confirmed(pairs, texts, k, percent)), "links")
        labels = components(links)

    where = classes.select("sig", "rep").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    where = where.select("sig", F.coalesce("component", "rep").alias("component"))
    out = signed.drop("halves").join(where, "sig", "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(documents: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One document of each group: the rows of ``documents`` whose doc_id is its component's smallest; of repeated rows one."""
    found = near_duplicates(documents, k, percent)
    out = found.where("NOT kept").select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy("text")
    d = documents.join(out, "doc_id", "left_anti").withColumn("__n", F.row_number().over(one))
    return d.where("__n = 1 OR doc_id IS NULL").select(*documents.columns)
