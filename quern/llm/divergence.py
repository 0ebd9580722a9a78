"""How sources of a language differ in their terms, over an integer dictionary.

Terms are counted in one pass: a task numbers the terms of some million words, counts the numbers for each (lang, source)
and hands on its partial counts, which Spark adds up.  The counts go, in UTF-8 order of (lang, term), into chunks of one language.  A chunk's dictionary is its
sorted array of kept terms; a term's id is its place there (``searchsorted``), so ids follow UTF-8 order, and each source's
counts become a dense vector of the chunk (``bincount``).  Totals of all chunks give every source's N and every language's
V; then the chunks are gone through once more, each by itself, and only sums of each pair of sources and the first ``TOP``
terms of each source leave them.

All arithmetic is on whole numbers.  Products that pass 64 bits are divided digit by digit (``scaled``).  Values fit a
long while a language keeps fewer than two thousand million terms.

Edge cases: a null text, lang or source counts as ''; every row is a document, rows that share a doc_id too; a source whose
texts have no terms is a group with N = 0, so all its shares are equal; a language without kept terms has pairs of value 0
and no term rows; equal values are ranked by item in UTF-8 order; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import common

#: Documents that a kept term occurs in, terms ranked for a source, parts that shares are counted in.
LEAST, TOP, SCALE = 3, 200, 10**9
#: Words that a task holds at once, terms in a chunk, cells (terms times sources) worked on at once.
HELD, CHUNK, CELLS = 4_000_000, 1 << 14, 1 << 20
#: Bytes of a text that are split into terms at once.
PART = 1 << 22

#: A-Z lowered, other letters and all bytes of other scripts kept, everything else a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, some megabytes at a time; none is cut."""
    folded = (text or "").encode().translate(FOLD)
    at = 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= PART else folded.find(b" ", at + PART)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


_COUNTS = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())]
)


class Counts:
    """What a task has read of one language: term ids as they come, for each source of all words and of each text's terms."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = Ids()
        self.words: dict[str, list[np.ndarray]] = defaultdict(list)
        self.docs: dict[str, list[np.ndarray]] = defaultdict(list)

    def add(self, source: str, text: str | None) -> int:
        found = [np.fromiter(map(self.ids.__getitem__, part), np.int32, len(part)) for part in terms(text)]
        self.words[source] += found
        if found:
            self.docs[source].append(np.unique(np.concatenate(found)))
        else:
            self.docs[source]  # the group occurs
        return sum(map(len, found))

    def batches(self, lang: str) -> Iterator[pa.RecordBatch]:
        spelled = pa.array(list(self.ids), pa.binary()).cast(pa.string())
        for source, docs in self.docs.items():
            n, d = (np.bincount(np.concatenate([np.zeros(0, np.int32), *x]), minlength=1) for x in (self.words[source], docs))
            found = np.flatnonzero(n)
            names = pa.concat_arrays([pa.nulls(1, pa.string()), spelled.take(pa.array(found))])
            both = [pa.repeat(pa.scalar(x, pa.string()), len(names)) for x in (lang, source)]
            counts = [pa.array(np.append(0, c[found])) for c in (d, n)]
            yield pa.RecordBatch.from_arrays([*both, names, *counts], schema=_COUNTS)


class Ids(dict):
    """Numbers terms as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, docs, n) of some rows at a time; a null term marks that the group occurs."""
    seen: dict[str, Counts] = defaultdict(Counts)
    words = 0
    for b in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words += seen[lang or ""].add(source or "", text)
            if words >= HELD:
                for at, counts in seen.items():
                    yield from counts.batches(at)
                seen.clear()
                words = 0
    for at, counts in seen.items():
        yield from counts.batches(at)


def scaled(count: np.ndarray, total: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * count / total), exact though the product may pass 64 bits: three digits of the scale at a time."""
    if total >= 1 << 53:
        raise OverflowError("totals of 2 ** 53 and more are not provided for")
    whole, rest = np.divmod(count, total)
    while scale > 1:
        step = min(scale, 1000)
        digit, rest = np.divmod(rest * step, total)
        whole, scale = whole * step + digit, scale // step
    return whole


def chunk(lang: str, table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (term, source, n) in order of their terms, each new one of which begins at one of ``starts``, as chunks."""
    coded = table.column("source").combine_chunks().dictionary_encode()
    listed = coded.dictionary.to_pylist()
    order = sorted(range(len(listed)), key=listed.__getitem__)
    place = np.argsort(order)[coded.indices.to_numpy()]
    terms_at, counts = table.column("term"), table.column("n").to_numpy()
    step = max(1, CELLS // len(listed))
    for first in range(0, len(starts), step):
        kept = starts[first : first + step]
        low, high = kept[0], starts[first + step] if first + step < len(starts) else len(counts)
        ids = np.searchsorted(kept, np.arange(low, high), "right") - 1
        cell = place[low:high] * len(kept) + ids
        dense = np.zeros(len(listed) * len(kept), np.int64)
        for shift, digit in ((0, 0xFFFFFFFF), (32, 0x7FFFFFFF)):  # bincount adds doubles: halves of a long stay exact
            half = np.bincount(cell, (counts[low:high] >> shift) & digit, len(dense))
            dense += half.astype(np.int64) << shift
        row = {"lang": [lang], "terms": [terms_at.take(pa.array(kept)).to_pylist()], "sources": [[listed[i] for i in order]]}
        row |= {"counts": [dense.tobytes()], "n": [dense.reshape(len(listed), -1).sum(axis=1).tolist()]}
        yield pa.RecordBatch.from_pydict(row, schema=_CHUNK)


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (lang, term, source, n) as chunks: the dictionary, and a dense count vector of each source in it."""
    waiting: pa.Table | None = None

    def cut(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
        """Chunks of all but the last terms, which may go on; these come at the end, as a table."""
        lang, term = table.column("lang").combine_chunks(), table.column("term").combine_chunks()
        n = len(table)
        other = np.ones(n, bool)
        other[1:] = pc.not_equal(lang[1:], lang[:-1]).to_numpy(False)
        begins = np.flatnonzero(other)
        fresh = other.copy()
        fresh[1:] |= pc.not_equal(term[1:], term[:-1]).to_numpy(False)
        starts = np.flatnonzero(fresh)
        for a, b in zip(begins, [*begins[1:], n], strict=True):
            own = starts[(starts >= a) & (starts < b)]
            for k in range(0, len(own), CHUNK):
                end = own[k + CHUNK] if k + CHUNK < len(own) else b
                if end == n and not last:
                    yield table.slice(own[k])
                else:
                    yield from chunk(lang[int(a)].as_py(), table.slice(own[k], end - own[k]), own[k : k + CHUNK] - own[k])

    for b in batches:
        table = pa.Table.from_batches([b])
        waiting = table if waiting is None else pa.concat_tables([waiting, table])
        if len(waiting) >= 4 * CHUNK:
            *full, waiting = cut(waiting, False)
            yield from full
    if waiting is not None and len(waiting):
        yield from cut(waiting, True)


_CHUNK = pa.schema(
    [
        ("lang", pa.string()),
        ("terms", pa.list_(pa.string())),
        ("sources", pa.list_(pa.string())),
        ("counts", pa.binary()),
        ("n", pa.list_(pa.int64())),
    ]
)
_VALUE = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _ratio(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / q)."""
    d = p - q
    return ((d * d).view(np.uint64) // q.view(np.uint64)).view(np.int64)


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks (lang, terms, sources, counts, groups, v): each chunk's first terms, and sums of all pairs of sources.

    Sums are added up over the chunks of a task while they are few enough; a chunk with more sources hands on its own.
    """
    sums: dict[str, tuple[list[str], np.ndarray]] = {}

    def pairs(lang: str, groups: list[str], value: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, source in enumerate(groups):
            others = groups[:i] + groups[i + 1 :]
            columns = [[lang] * len(others), [source] * len(others), ["pair"] * len(others), others, np.delete(value[i], i)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _VALUE, strict=True)], schema=_VALUE)

    for b in batches:
        for row in b.to_pylist():
            lang, v, names = row["lang"], row["v"], row["terms"]
            groups = [g["source"] for g in row["groups"]]
            totals = [g["n"] + v for g in row["groups"]]
            whole = sum(g["n"] for g in row["groups"]) + v
            place = {x: i for i, x in enumerate(groups)}
            dense = np.frombuffer(row["counts"], np.int64).reshape(len(row["sources"]), -1)
            own = [place[x] for x in row["sources"]]
            value = np.zeros((len(groups), len(groups)), np.int64)
            best: dict[int, list[tuple[int, int]]] = defaultdict(list)
            step = max(1, CELLS // len(groups))
            for at in range(0, len(names), step):
                part = dense[:, at : at + step]
                counts = np.zeros((len(groups), part.shape[1]), np.int64)
                counts[own] = part
                p = np.stack([1 + scaled(c + 1, t) for c, t in zip(counts, totals, strict=True)])
                q = 1 + scaled(part.sum(axis=0) + 1, whole)
                for i in range(len(groups)):
                    value[i] += _ratio(np.broadcast_to(p[i], p.shape), p).sum(axis=1)
                for i in own:
                    more = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                    f = _ratio(p[i][more], q[more])
                    first = np.argsort(-f, kind="stable")[:TOP]  # ids follow UTF-8 order: equal values stay in it
                    best[i] += zip((-f[first]).tolist(), (more[first] + at).tolist(), strict=True)
            for i, found in best.items():
                top = sorted(found)[:TOP]
                columns = [[lang] * len(top), [groups[i]] * len(top), ["term"] * len(top), [names[k] for _, k in top], [-f for f, _ in top]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _VALUE, strict=True)], schema=_VALUE)
            if len(groups) ** 2 > CELLS:
                yield from pairs(lang, groups, value)
            elif lang in sums:
                sums[lang][1][:] += value
            else:
                sums[lang] = groups, value
    for lang, (groups, value) in sums.items():
        yield from pairs(lang, groups, value)


def divergence(documents: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source lies from every other of its language, and its own terms."""
    texts = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = texts.mapInArrow(partial_counts, "lang string, source string, term string, docs long, n long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    counts = common.written(counts, "term-counts")

    ranged = counts.where("term IS NOT NULL").repartitionByRange("lang", "term")
    # the window asks for no other partitioning and no other order
    kept = ranged.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(f"docs >= {LEAST}")
    kept = kept.select("lang", "term", "source", "n").sortWithinPartitions("lang", "term")
    chunks = kept.mapInArrow(encoded, "lang string, terms array<string>, sources array<string>, counts binary, n array<long>")
    chunks = common.written(chunks, "term-chunks")

    totals = chunks.select("lang", F.explode(F.arrays_zip("sources", "n")).alias("at"))
    totals = totals.groupBy("lang", F.col("at.sources").alias("source")).agg(F.sum("at.n").alias("n"))
    sizes = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0, ["n"])
    groups = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"))
    groups = common.written(groups.join(sizes, "lang", "left"), "term-groups")

    values = chunks.join(groups, "lang").select("lang", "terms", "sources", "counts", "groups", "v")
    values = values.mapInArrow(compared, "lang string, source string, part string, item string, value long")
    values = common.written(values, "term-values")
    each = groups.where("v IS NULL").select("lang", "groups", F.explode("groups.source").alias("source"))
    none = each.select("lang", "source", F.explode("groups.source").alias("item")).where("source <> item")
    pairs = values.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(none.withColumns({"part": F.lit("pair"), "value": F.lit(0).cast("long")}))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    own = values.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(f"rank <= {TOP}")
    return pairs.unionByName(own).select("lang", "source", "part", "item", "value", "rank")


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (
  SELECT g.lang, g.source, k.term, count(w.id)::HUGEINT AS n
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN words w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term
  GROUP BY g.lang, g.source, k.term
), shares AS (
  SELECT *, 1 + 1000000000 * (n + 1) // (sum(n) OVER w + count(*) OVER w) AS p
  FROM counts WINDOW w AS (PARTITION BY lang, source)
), whole AS (
  SELECT *, 1 + 1000000000 * (n + 1) // (sum(n) OVER w + count(*) OVER w) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term) WINDOW w AS (PARTITION BY lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), terms AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, (p - q) * (p - q) // q AS value
  FROM shares s JOIN whole w ON w.lang = s.lang AND w.term = s.term WHERE s.n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 200
"""
