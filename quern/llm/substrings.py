"""Removal of long passages that an earlier document has, over a de Bruijn graph of words.

Every run of ``WINDOW`` words is an edge between two nodes, the runs of ``WINDOW - 1`` words that begin and end it.  Only
edges of two or more documents matter.  They are found in two steps: first each window's minimizer (its run of ``SEED``
words of least hash) is counted, as a window can only recur where its minimizer does; then the windows over recurring
minimizers meet as pairs of nodes, and each edge gets the coordinates of its first occurrence: document and place.

The graph of the repeated edges is then compacted (``compacted``).  A node that one edge enters and one edge leaves, of
which the second follows the first at the source, does not branch: the join of the two edges makes one path.  Paths grow
inside blocks of ``SPAN`` places of a source first; what goes on across blocks is joined by pointer jumping.  Each
document's repeated runs are cut where paths end (``on_paths``), and every piece is verified: the words at its source
coordinates must be the words of the document (``spans_of``, ``covered``).

A minimizer of many documents (a licence line) is dealt to one more partition for every ``HOT`` of them; its edges find
their least occurrence by partial aggregation, and each different run of such edges is looked up once (``walked``).  A source's places come in blocks, so nothing grows
with the number of documents that have it.  Whole copies of an earlier document are a single path each, met by digest
and left out of the graph.

Edge cases: a null text counts as empty; a text of fewer than ``WINDOW`` words keeps all of them; rows that share a
doc_id are judged against smaller ids only and never against each other; a row with a null doc_id is kept whole and is
no one's source; further columns of the documents stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.llm import common
from quern.llm.bytes import blocks, inside, mix, row_of, window_hashes

WINDOW, SEED = 13, 5
#: Documents that share a minimizer in one partition, about; places of a source that one block of paths covers.
HOT, SPAN = 1000, 256
_SEED_FACTOR, _NODE_FACTOR = 0x9FB21C651E98DF25, 0xA24BAED4963EE407


def minimizers(words: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a block's word hashes the place of its minimizer; the hashes of all seeds."""
    seeds = window_hashes(words, seed, _SEED_FACTOR)
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), seeds
    best = np.arange(n)
    least = seeds[:n].copy()
    for k in range(1, window - seed + 1):
        better = seeds[k : n + k] < least
        least[better] = seeds[k : n + k][better]
        best[better] = np.flatnonzero(better) + k
    return best, seeds


def _unique_by_row(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of the first of each (row, value)."""
    order = np.lexsort((values, rows))
    r, v = rows[order], values[order]
    first = np.ones(len(order), bool)
    first[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.sort(order[first])  # lexsort is stable: the first place of each


def seeds_of(documents: DataFrame) -> DataFrame:
    """doc_id and hash of every minimizer of its windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                starts, ends, bounds = block.words()
                best, seeds = minimizers(block.hashes(starts, ends))
                at = np.unique(best[inside(bounds, WINDOW)])
                rows, values = row_of(bounds)[at], seeds[at]
                keep = _unique_by_row(rows, values)
                names = batch.column(0).slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(rows[keep])), pa.array(values[keep].view(np.int64))], ["doc_id", "seed"]
                )

    d = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return d.mapInArrow(common.released(work), "doc_id long, seed long")


def copies_of(documents: DataFrame) -> DataFrame:
    """Documents whose words are all those of a smaller doc_id: one path each, over the whole of both."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                starts, ends, bounds = block.words()
                words = block.hashes(starts, ends)
                sums = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds, bounds[1:], strict=False)]
                names = batch.column(0).slice(block.first, block.rows)
                sizes = pa.array(np.diff(bounds).astype(np.int32))
                yield pa.RecordBatch.from_arrays([names, sizes, pa.array(sums, pa.binary())], ["doc_id", "words", "sum"])

    d = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    d = d.mapInArrow(common.released(work), "doc_id long, words int, sum binary").where(F.col("words") >= WINDOW)
    d = common.written(d, "sums")
    least = d.groupBy("sum").agg(F.min("doc_id").alias("source"), F.count("*").alias("n")).where("n > 1").drop("n")
    d = d.join(least, "sum").where("source < doc_id")
    return d.select("doc_id", F.lit(0).alias("start"), "words", "source", F.lit(0).alias("source_start"))


def compressed(documents: DataFrame) -> DataFrame:
    """The documents (those with a doc_id) with their text compressed (z), once, for all exchanges by doc_id.

    doc_id is declared never null, so that all joins on it see one and the same exchange.
    """
    others = [c for c in documents.columns if c.lower() not in ("doc_id", "text", "z", "spans", "__paths")]
    d = documents.where("doc_id IS NOT NULL")
    d = d.select(F.col("doc_id").cast("long"), *others, F.col("text").cast("string"))
    last = len(others) + 1
    fields = [T.StructField("doc_id", T.LongType(), False), *d.schema.fields[1:last], T.StructField("z", T.BinaryType())]

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            raw = [None if x is None else pack(x) for x in batch.column(last).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.array(raw, pa.binary())], [*batch.schema.names[:last], "z"]
            )

    return d.mapInArrow(common.released(squeeze), T.StructType(fields))


def _texts(raw: list) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [b"" if x is None else unpack(x) for x in raw]


def edges_of(seeded: DataFrame) -> DataFrame:
    """Windows over recurring minimizers: minimizer, salt (0: a rare one), both nodes, document, place of the first there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for block in blocks(pa.array(_texts(part.column(1).to_pylist()), pa.binary())):
                    starts, ends, bounds = block.words()
                    words = block.hashes(starts, ends)
                    best, seeds = minimizers(words)
                    ok = np.flatnonzero(inside(bounds, WINDOW))
                    rows = row_of(bounds)[ok]
                    # which of a row's minimizers recur: its list, as hashes of (row, minimizer) with their salts
                    lists = part.column(2).slice(block.first, block.rows)
                    flat, of = lists.flatten(), row_of(np.cumsum([0, *lists.value_lengths().to_pylist()]))
                    known = _pair(of, flat.field(0).to_numpy().view(np.uint64))
                    order = np.argsort(known)
                    known, salts = known[order], flat.field(1).to_numpy()[order]
                    here = _pair(rows, seeds[best[ok]])
                    found = np.minimum(np.searchsorted(known, here), len(known) - 1)
                    hit = known[found] == here
                    ok, rows, salts = ok[hit], rows[hit], salts[found[hit]]
                    keep = _unique_by_row(rows, window_hashes(words, WINDOW)[ok])
                    ok, rows, salts = ok[keep], rows[keep], salts[keep]
                    nodes = window_hashes(words, WINDOW - 1, _NODE_FACTOR).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(seeds[best[ok]].view(np.int64)),
                            pa.array(salts),
                            pa.array(nodes[ok]),
                            pa.array(nodes[ok + 1]),
                            part.column(0).slice(block.first, block.rows).take(pa.array(rows)),
                            pa.array((ok - bounds[rows]).astype(np.int32)),
                        ],
                        ["seed", "salt", "a", "b", "doc_id", "place"],
                    )

    return seeded.select("doc_id", "z", "seeds").mapInArrow(common.released(work), "seed long, salt int, a long, b long, doc_id long, place int")


def _pair(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One hash for a row of a block and a value."""
    return mix(values + rows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPAN = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("words", pa.int32()), ("digest", pa.binary())])


def _digest(words: list[bytes], start: int, n: int) -> bytes | None:
    """Of ``n`` words from number ``start``; null where there are none."""
    return hashlib.blake2b(b" ".join(words[start : start + n]), digest_size=16).digest() if start + n <= len(words) else None


def _joined(pieces: DataFrame, by: Window, *keys: str, same: tuple[str, ...] = ("source",)) -> DataFrame:
    """Pieces (place, edges, source, source_place) that continue each other here and at the source, made one."""
    near = (F.lag(F.col("place") + F.col("edges")).over(by) == F.col("place")) & (
        F.lag(F.col("source_place") + F.col("edges")).over(by) == F.col("source_place")
    )
    for c in same:
        near = near & (F.lag(c).over(by) == F.col(c))
    d = pieces.withColumn("opens", F.when(near, 0).otherwise(1))
    d = d.withColumn("run", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "run").agg(
        F.min("place").alias("place"),
        F.sum("edges").alias("edges"),
        F.first("source").alias("source"),
        F.min("source_place").alias("source_place"),
    ).drop("run")


def recurring_seeds(documents: DataFrame) -> DataFrame:
    """doc_id and its minimizers that other documents have, too, each with the salt of its share of them."""
    seeds = seeds_of(documents)
    met = seeds.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1")  # each counts once for a document
    met = common.written(met.select("seed", F.floor(F.col("n") / HOT).cast("int").alias("parts")), "seeds")
    salt = F.when(F.col("parts") > 0, F.pmod(F.xxhash64("doc_id"), F.col("parts") + 1) + 1).otherwise(0).cast("int")
    d = seeds.join(met, "seed").select("doc_id", F.struct("seed", salt.alias("salt")).alias("found"))
    return d.groupBy("doc_id").agg(F.collect_set("found").alias("seeds"))


def _first(by: Window) -> list:
    """Document and place of the least occurrence of an edge, and its last document."""
    return [
        F.min("doc_id").over(by).alias("source"),
        F.min_by("place", "doc_id").over(by).alias("source_place"),
        F.max("doc_id").over(by).alias("last"),
    ]


def repeated_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph's edges (nodes a, b; source, source_place), and the runs of edges that documents have of earlier ones.

    Both come from one exchange of the windows and are written as one table.
    """
    by = Window.partitionBy("seed", "salt", "a", "b")
    # ``often`` is the salt again, but a filter on it stays above the exchange, which is then made once
    dealt = edges.repartition("seed", "salt")
    met = dealt.select("*", *_first(by), F.max("salt").over(by).alias("often"))
    # of a common edge every partition has a least occurrence of its own
    nodes = met.where("source = doc_id AND source_place = place AND (often > 0 OR source < last)")
    nodes = nodes.select("often", "a", "b", "doc_id", "place", "source", "source_place", "last")
    # windows over one minimizer meet in one partition, and neighbours mostly share it: runs begin to grow there
    order = Window.partitionBy("seed", "salt", "doc_id").orderBy("place")
    rare = met.where("often = 0 AND source < doc_id").withColumn("edges", F.lit(1).cast("long"))
    columns = ("doc_id", "place", "edges", "source", "source_place")
    grown = _joined(rare, order, "seed", "salt", "doc_id").select(*columns)
    both = nodes.unionByName(grown, allowMissingColumns=True).unionByName(common_runs(common.where_computed(dealt, F.col("salt") > 0), order), allowMissingColumns=True)
    both = common.written(both, "edges")

    first = both.where("often = 0").select("a", "b", "source", "source_place")
    source = both.where("often > 0").groupBy("a", "b").agg(
        F.min("source").alias("source"), F.min_by("source_place", "source").alias("source_place"), F.max("last").alias("last")
    ).where("source < last").drop("last")
    runs = both.where("often IS NULL AND walk IS NULL").select(*columns)
    return first.union(source.select(*first.columns)), runs.union(walked(both.where("walk IS NOT NULL"), source).select(*columns))


def common_runs(met: DataFrame, order: Window) -> DataFrame:
    """Consecutive edges of a document over one common minimizer as one row: doc_id, place, and ``walk``, the nodes passed."""
    opens = F.when((F.lag("place").over(order) + 1 == F.col("place")) & (F.lag("b").over(order) == F.col("a")), 0).otherwise(1)
    d = met.select("seed", "salt", "doc_id", "place", "a", "b").withColumn("opens", opens)
    d = d.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.groupBy("seed", "salt", "doc_id", "run").agg(F.min("place").alias("place"), F.sort_array(F.collect_list(F.struct("place", "a", "b"))).alias("at"))
    return d.select("salt", "doc_id", "place", F.concat("at.a", F.array(F.element_at("at", -1)["b"])).alias("walk"))


def walked(runs: DataFrame, source: DataFrame) -> DataFrame:
    """Runs with a walk cut where its edges change their source; each different walk (of a salt) is looked up once.

    A passage of very many documents is a few walks, so its edges are joined that often, not once for each document.
    """
    edge = F.posexplode(F.zip_with(F.slice("walk", 1, F.size("walk") - 1), F.slice("walk", 2, F.size("walk") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    d = runs.groupBy("salt", "walk").agg(F.count("*").alias("n")).select("salt", "walk", edge.alias("at", "edge"))
    d = d.select("salt", "walk", F.col("at").alias("place"), "edge.a", "edge.b").join(source, ["a", "b"])
    d = d.withColumn("edges", F.lit(1).cast("long"))
    d = _joined(d, Window.partitionBy("salt", "walk").orderBy("place"), "salt", "walk").withColumnRenamed("place", "at")
    d = runs.select("salt", "walk", "doc_id", "place").join(d, ["salt", "walk"]).where("source < doc_id")
    return d.withColumn("place", F.col("place") + F.col("at"))


def compacted(edges: DataFrame) -> DataFrame:
    """Nonbranching paths of the graph, in pieces that lie in one block of a source: source, block, start, end, path.

    ``path`` is the place of the whole path's first edge at the source; ``end`` is the place after the piece's last.
    """
    enters, leaves = F.lit(1).cast("long"), F.lit(1 << 32).cast("long")
    into = edges.select(F.col("b").alias("node"), "source", (F.col("source_place") + 1).alias("place"), enters.alias("degree"))
    out = edges.select(F.col("a").alias("node"), "source", F.col("source_place").alias("place"), leaves.alias("degree"))
    # the join of the edges that enter a node with those that leave it, with both degrees, in one exchange
    nodes = into.union(out).groupBy("node").agg(
        F.sum("degree").alias("degree"), F.min("source").alias("source"), F.max("source").alias("other"),
        F.min("place").alias("place"), F.max("place").alias("then"),
    )
    links = nodes.where((F.col("degree") == enters + leaves) & (F.col("source") == F.col("other")) & (F.col("place") == F.col("then")))
    links = links.select("source", F.col("place").alias("source_place"), F.lit(1).alias("linked"))

    d = edges.select("source", "source_place").join(links, ["source", "source_place"], "left")
    d = d.withColumn("block", F.floor(F.col("source_place") / SPAN).cast("int"))
    by = Window.partitionBy("source", "block").orderBy("source_place")
    follows = (F.lag("source_place").over(by) + 1 == F.col("source_place")) & (F.col("linked") == 1)
    d = d.withColumn("run", F.sum(F.when(follows, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = d.groupBy("source", "block", "run").agg(
        F.min("source_place").alias("start"),
        (F.max("source_place") + 1).alias("end"),
        F.min_by("linked", "source_place").alias("linked"),
    ).drop("run")
    pieces = common.written(pieces, "pieces")

    # pieces that go on from the block before: each points to the piece before it, and pointers jump until all are heads
    goes_on = pieces.where("linked = 1").select("source", "start")
    before = pieces.select("source", F.col("end").alias("start"), F.col("start").alias("head"))
    heads = common.written(goes_on.join(before, ["source", "start"]), "heads")
    while True:
        ahead = heads.select("source", F.col("start").alias("head"), F.col("head").alias("further"))
        jumped = heads.join(ahead, ["source", "head"], "left")
        jumped = common.written(jumped.select("source", "start", F.coalesce("further", "head").alias("head"), "further"), "heads")
        heads = jumped.drop("further")
        if jumped.where("further IS NOT NULL").isEmpty():
            break
    return pieces.join(heads, ["source", "start"], "left").select(
        "source", "block", "start", "end", F.coalesce("head", "start").alias("path")
    )


def on_paths(runs: DataFrame, paths: DataFrame) -> DataFrame:
    """Runs of edges cut where the paths at their source end: doc_id, start, words, source, source_start."""
    last = F.col("source_place") + F.col("edges") - 1
    blocks_of = F.sequence(F.floor(F.col("source_place") / SPAN).cast("int"), F.floor(last / SPAN).cast("int"))
    d = runs.withColumn("block", F.explode(blocks_of)).join(paths, ["source", "block"])
    low, high = F.greatest("source_place", "start"), F.least(last + 1, F.col("end"))
    d = d.where(low < high).select(
        "doc_id",
        (F.col("place") + low - F.col("source_place")).alias("place"),
        (high - low).cast("long").alias("edges"),
        "source",
        low.alias("source_place"),
        "path",
    )
    d = _joined(d, Window.partitionBy("doc_id").orderBy("place"), "doc_id", same=("source", "path"))
    return d.select(
        "doc_id",
        F.col("place").alias("start"),
        (F.col("edges") + (WINDOW - 1)).cast("int").alias("words"),
        "source",
        F.col("source_place").alias("source_start"),
    )


def repeated_paths(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """Paths that an earlier document has: doc_id, start, words, source, source_start; not yet verified."""
    copies = common.written(copies_of(documents), "copies")
    seeds = recurring_seeds(documents).join(copies.select("doc_id"), "doc_id", "left_anti")
    edges, runs = repeated_edges(edges_of(texts.join(seeds, "doc_id")))
    return common.written(on_paths(runs, compacted(edges)).union(copies), "paths")


def spans_of(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """Each path's doc_id, start and words with the digest of the words at its source, to hold the document against."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, out = batch.slice(i, 256), []
                lists = part.column("__paths").to_pylist()
                for text, spans in zip(_texts(part.column("z").to_pylist()), lists, strict=True):
                    words = text.split()
                    out += [s | {"doc_id": s["target"], "digest": _digest(words, s["source_start"], s["words"])} for s in spans]
                yield pa.RecordBatch.from_pylist(out, schema=_SPAN)

    # a source may serve any number of documents: its paths come in lists of about a thousand, dealt by document
    paths = paths.withColumnRenamed("doc_id", "target").withColumnRenamed("source", "doc_id")
    counts = paths.groupBy("doc_id").agg(F.floor(F.count("*") / 1000).alias("lists"))
    there = paths.join(counts, "doc_id").withColumn("list", F.pmod(F.xxhash64("target"), F.col("lists") + 1))
    there = there.groupBy("doc_id", "list").agg(
        F.collect_list(F.struct("target", "start", "words", "source_start")).alias("__paths")
    ).drop("list")
    # all columns of the texts go in, so that this join and the last one share an exchange
    spans = texts.join(there, "doc_id").mapInArrow(common.released(work), "doc_id long, start int, words int, digest binary")
    return spans.where("digest IS NOT NULL")


def cut(documents: DataFrame, keep_text: bool = True, staged: bool = False) -> DataFrame:
    """``documents`` (all their columns) without passages that an earlier one has.

    Adds n_words, n_removed and kept_sha256 (of the kept words joined by one space).  Where words go, ``text`` becomes
    the kept words joined by one space, elsewhere it stays; ``keep_text=False`` leaves the column out.  ``staged`` writes the
    compressed texts as a table: more disk, but no task feeds one Python worker from another, so half as many are held.
    """
    added = ("n_words", "n_removed", "kept_sha256", "z", "spans", "__paths")
    documents = documents.select(*[c for c in documents.columns if c.lower() not in added])
    texts = compressed(documents)
    if staged:
        texts = common.written(texts, "compressed")
    paths = repeated_paths(documents, texts)
    spans = spans_of(paths, texts).groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct("start", "words", "digest"))).alias("spans")
    )
    d = texts.join(spans, "doc_id", "left")
    nameless = documents.where("doc_id IS NULL")
    d = d.unionByName(compressed(nameless.withColumn("doc_id", F.lit(0))).withColumn("doc_id", F.lit(None).cast("long")), True)
    others = [c for c in texts.columns if c != "z"]
    fields = [T.StructField(c, d.schema[c].dataType) for c in others]  # doc_id is null in nameless rows
    fields += [T.StructField(c, t) for c, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()))]
    fields += [T.StructField("text", T.StringType())] * keep_text
    n = len(others)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                raw = part.column(n).to_pylist()
                sizes, gone, sums, out = [], [], [], []
                for z, text, spans in zip(raw, _texts(raw), part.column(n + 1).to_pylist(), strict=True):
                    words = text.split()
                    kept = words if not spans else list(compress(words, ~covered(words, spans)))
                    joined = b" ".join(kept)
                    sizes.append(len(words))
                    gone.append(len(words) - len(kept))
                    sums.append(hashlib.sha256(joined).hexdigest())
                    if keep_text:
                        out.append(None if z is None else (joined if len(kept) < len(words) else text).decode("utf-8", "replace"))
                columns = [*part.columns[:n], pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())]
                columns += [pa.array(out, pa.string())] * keep_text
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    d = d.select(*others, "z", "spans").mapInArrow(common.released(work), T.StructType(fields))
    return d.select(*[c for c in documents.columns if keep_text or c != "text"], "n_words", "n_removed", "kept_sha256")


def covered(words: list[bytes], spans: list[dict]) -> np.ndarray:
    """Which words lie in a span, or in a later window of the same words as one of a span's."""
    out = np.zeros(len(words), bool)
    starts = np.zeros(max(0, len(words) - WINDOW + 1), bool)
    for s in spans:
        if _digest(words, s["start"], s["words"]) == s["digest"]:
            out[s["start"] : s["start"] + s["words"]] = True
            starts[s["start"] : s["start"] + s["words"] - WINDOW + 1] = True
    if starts.any() and not starts.all():
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.uint64)
        runs = window_hashes(mix(ids + np.uint64(1)), WINDOW)
        again = np.flatnonzero(~starts & np.isin(runs, runs[starts]))  # by hash first, then by the words
        if len(again):
            window = lambda i: b" ".join(words[i : i + WINDOW])
            hits = {window(i) for i in np.flatnonzero(starts).tolist()}
            for i in again.tolist():
                if window(i) in hits:
                    out[i : i + WINDOW] = True
    return out
