"""Phrase collocations from generalised suffix automata, one for each shard of words, with endpos counts.

A shard is a run of words of one language in one task.  Its automaton (``Automaton``) has a state for each class of phrases
of up to ``depth`` words that end at the same places; a state's count is the number of those places, and its suffix link
leads to the longest shorter suffix that ends at more.  It is built a layer at a time by sorting: the phrases of k words
that end at a place are the children of the (k-1)-word suffix that ends there.  Every phrase is listed from its state, and
Spark adds the counts of all shards.

The texts are split once; the shards, words as numbers, are a table that every pass reads.  Most phrases occur once, so
three passes narrow down what is listed, and nothing frequent is ever lost: a frequent phrase has frequent parts only.  They
add up counts of hashes of words, of pairs of such words, of runs of three with such pairs; Spark deals them out by ranges
of hashes, a range's counts in one row (``packed``).  The hashes (``HASH_BITS`` bits) that reach ``LEAST`` go into a bitmap
of a fixed size (``BITS``).  Equal hashes or bits let through what is rare, never hold back what is frequent.  The last pass
lists phrases by their words and counts them exactly; single words only where they belong to a frequent pair, as no other
is ever part of a candidate (the third pass gathers those words).

A phrase inside a longer one is found over the automaton's links of the global table: the longer one without its first
word, and without its last.  One word more is enough to look at: whatever is longer still has no larger count.

Edge cases: a null text counts as empty; a null language as ``und``; rows that share a doc_id are documents of their own;
phrases never cross a separator or the end of a text; an empty table gives no rows.  A text is split some megabytes at a
time, and a shard ends within a text or piece if need be, with the words before carried over uncounted.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import common
from quern.llm.bytes import Block, mix

#: Occurrences of a candidate, its most words, share (percent) of its occurrences that a longer one takes it over at, rows of a language.
LEAST, DEPTH, INSIDE, TOP = 30, 4, 80, 2000
#: Words of a shard, bytes of a text that are split at once.
SHARD, PART = 1 << 17, 1 << 22
#: Shards whose counts a task adds up before they are dealt out, where most phrases are met again (about 100 MB of text).
GATHERED = 128
#: Bits of the hashes that are counted, bits of a sieve (8 MB) as a power of two, words of the longest hashed phrases.
HASH_BITS, BITS, HASHED = 40, 26, 3
#: Hashes whose counts a task adds up at once; how many shards' hashes a range has room for, about.
HELD, RANGED = 1 << 18, 16

_BREAK = b"\xff"  # no byte of UTF-8
_SEPARATORS = frozenset(b".,;:!?\n\v\f\r")
FOLD = bytes(0xFF if b in _SEPARATORS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def split(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text with breaks between pieces and at the end, some megabytes at a time."""
    folded = (text or "").encode().translate(FOLD)
    at = 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= PART else folded.find(b" ", at + PART)
        end = len(folded) if end < 0 else end
        yield folded[at:end].replace(_BREAK, b" \xff ").split()
        at = end
    yield [_BREAK]


class Shard:
    """Words of one language, as numbers; the first ``carried`` stand before its own and are not counted."""

    def __init__(self, lang: str, before: list[bytes]):
        self.lang, self.parts = lang, []
        self.ids: dict[bytes, int] = defaultdict(itertools.count().__next__)  # numbers words as they come
        self.ids[_BREAK]
        self.carried, self.size = len(before), 0
        self.add(before)
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def row(self) -> list:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress  # rows of some hundred kilobytes
        return [self.lang, self.carried, pack(np.concatenate(self.parts).astype("<i4").tobytes()), pack(b" ".join(self.ids))]


def word_hashes(lang: str, names: bytes) -> np.ndarray:
    block = Block(0, np.frombuffer(names, np.uint8), np.array([0, len(names)]))
    ends = np.append(np.flatnonzero(block.data == 32), len(names))
    own = Block(0, np.frombuffer(lang.encode() + b"\0", np.uint8), np.array([0, 1]))
    seed = own.hashes(np.array([0]), np.array([len(own.data)]), 7)
    return mix(block.hashes(np.append(0, ends[:-1] + 1), ends, 5) ^ seed)


class Sieve:
    """A bitmap of hashes, by their first ``bits`` bits."""

    def __init__(self, bits: int, rows: list):
        self.shift = np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits >> 3, np.uint8)
        for bucket, found in rows:  # Spark's buckets count from 1 and hold 32768 bits
            self.bitmap[(bucket - 1) * 4096 :][:4096] = np.frombuffer(found, np.uint8)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift  # of a hash's first bits
        return self.bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def numbered(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of ``keys`` (0 to ``most``), ascending, and which of them each key is; faster than ``np.unique``."""
    if most <= 4 * len(keys):
        seen = np.zeros(most + 1, bool)
        seen[keys] = True
        return np.flatnonzero(seen), (np.cumsum(seen) - 1)[keys]
    bits = len(keys).bit_length()
    if most >> (63 - bits):
        return np.unique(keys, return_inverse=True)
    both = keys << bits | np.arange(len(keys))  # numbers sort faster by themselves than with their places beside them
    both.sort()
    at = both & ((1 << bits) - 1)
    both >>= bits
    new = np.ones(len(keys), bool)
    new[1:] = both[1:] != both[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[at] = np.cumsum(new) - 1
    return both[new], inverse


class Automaton:
    """The suffix automaton of words ``x`` (0: break) for phrases of up to ``depth`` words, by layers of equal length.

    ``length``: words of a state's longest phrase; ``link``: its suffix link (state 0 is the root); ``count``: places where
    it ends, those before ``carried`` left out; ``end``: one of them.  ``allowed(k, ends)`` tells which phrases of k words
    that end at ``ends`` to take in; a phrase is taken in only if those without its first and last word are.
    """

    def __init__(self, x: np.ndarray, depth: int, allowed: Callable[[int, np.ndarray], np.ndarray] | None = None, carried: int = 0):
        length, link, count, end = (np.zeros(1, np.int64) for _ in range(4))
        node = np.zeros(len(x), np.int64)  # of the phrase of k - 1 words that ends at a place, by its number in that layer
        state_of, counted = np.zeros(1, np.int64), np.array([-1])
        taken = x > 0
        base = int(x.max(initial=0)) + 1
        for k in range(1, depth + 1):
            fits = taken.copy()
            if k > 1:
                fits[1:] &= taken[:-1]
                fits[:1] = False
            ends = np.flatnonzero(fits)
            if allowed is not None:
                ends = ends[allowed(k, ends)]
            key, inverse = numbered(node[ends] * base + x[ends - k + 1], (len(counted) + 1) * base)
            parent = key // base
            n = np.bincount(inverse[ends >= carried], minlength=len(key))
            at = np.zeros(len(key), np.int64)
            at[inverse] = ends  # the last place stays
            new = n != counted[parent]  # else it ends wherever its suffix does: one class with it
            own = np.where(new, len(length) + np.cumsum(new) - 1, state_of[parent])
            length = np.concatenate([length, np.zeros(new.sum(), np.int64)])
            length[own] = k
            link = np.concatenate([link, state_of[parent][new]])
            count, end = np.concatenate([count, n[new]]), np.concatenate([end, at[new]])
            node = np.zeros(len(x), np.int64)
            node[ends] = inverse
            taken = np.zeros(len(x), bool)
            taken[ends] = True
            state_of, counted = own, n
        self.length, self.link, self.count, self.end = length, link, count, end

    def listed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Last place, words and count of every phrase that occurs."""
        state = np.flatnonzero(self.count)
        shorter = self.length[self.link[state]]
        n = self.length[state] - shorter
        each = np.repeat(state, n)
        words = np.arange(len(each)) + np.repeat(shorter + 1 - (np.cumsum(n) - n), n)
        return self.end[each], words, self.count[each]

    def phrases(self) -> Iterator[tuple[int, int, int]]:
        """(first place, place after the last, count) of every phrase that occurs."""
        end, words, n = self.listed()
        yield from zip((end - words + 1).tolist(), (end + 1).tolist(), n.tolist(), strict=True)


def gate(hashes: np.ndarray, x: np.ndarray, sieves: list[Sieve]) -> Callable[[int, np.ndarray], np.ndarray]:
    """What the sieves let through: words by the first, pairs by the second, and so on."""

    def allowed(k: int, ends: np.ndarray) -> np.ndarray:
        if k > len(sieves):
            return np.ones(len(ends), bool)
        if k == 1:
            return sieves[0].passes(hashes)[x[ends]]
        return sieves[k - 1].passes(gram_hashes(hashes, x, ends, k))

    return allowed


def gram_hashes(hashes: np.ndarray, x: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the phrases of ``k`` words that end at ``ends``."""
    out = hashes[x[ends - k + 1]]
    for i in range(k - 2, -1, -1):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[x[ends - i]])
    return out


_SHARDS = pa.schema([("lang", pa.string()), ("carried", pa.int32()), ("ids", pa.binary()), ("names", pa.binary())])
_COUNTS = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
_PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int64()), ("n", pa.int64())])


def shards(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[Shard]:
    """The rows (lang, text) of a task as shards; at most twice ``SHARD`` words wait, whatever the number of languages."""
    waiting: dict[str, Shard] = {}
    total, keep = 0, max(1, depth - 1)
    for b in batches:
        for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            tail: list[bytes] = []
            for words in split(text):
                shard = waiting.get(lang) or waiting.setdefault(lang, Shard(lang, []))
                shard.add(words)
                total += len(words)
                tail = (tail + words[-keep:])[-keep:]
                if shard.size >= SHARD or total >= 2 * SHARD:
                    full = shard if shard.size >= SHARD else max(waiting.values(), key=lambda s: s.size)
                    total -= full.size
                    yield full
                    waiting[full.lang] = Shard(full.lang, tail if full is shard else [])
    yield from waiting.values()


def shard_rows(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, depth):
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(shard.row(), _SHARDS, strict=True)], schema=_SHARDS)

    return rows


def read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray, bytes]]:
    """Of each shard: lang, words carried over, words as numbers, and the words, joined by spaces."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for i in range(b.num_rows):
            lang, carried, ids, names = (c[i].as_py() for c in b.columns)
            yield lang, carried, np.frombuffer(unpack(ids), "<i4").astype(np.int64), unpack(names)


def paired(hashes: np.ndarray, x: np.ndarray, sieves: list[Sieve]) -> np.ndarray:
    """The words (as numbers) of all pairs that the sieves let through."""
    ends = np.flatnonzero((x[1:] > 0) & (x[:-1] > 0)) + 1
    ends = ends[sieves[1].passes(gram_hashes(hashes, x, ends, 2))]
    return np.unique(np.concatenate([x[ends], x[ends - 1]]))


def summed(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, ascending, and the sums of their counts."""
    keys, inverse = numbered(hashes, 2 << HASH_BITS)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, inverse, n)
    return keys, total


def packed(hashes: np.ndarray, n: np.ndarray, low: int) -> pa.RecordBatch:
    """Added up counts, a row for each range of hashes (all but their last ``low`` bits): those bits, then the counts."""
    keys, total = summed(hashes, n)
    part = keys >> low
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    bounds = [*starts.tolist(), len(keys)]
    last, total = (keys & ((1 << low) - 1)).astype("<u4"), total.astype("<i8")
    rows = [last[i:j].tobytes() + total[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), pa.array(rows, pa.binary())], schema=_COUNTS)


def hash_counts(k: int, sieves: list, low: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of hashes of the phrases of ``k`` words that the sieves let through; with k = 3 also words in pairs, from 2 ** HASH_BITS."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lang, carried, x, names in read_shards(batches):
            hashes = word_hashes(lang, names)
            a = Automaton(x, k, gate(hashes, x, [s.value for s in sieves]), carried)
            found = (a.length == k) & (a.count > 0)
            own = gram_hashes(hashes, x, a.end[found], k) >> np.uint64(64 - HASH_BITS)
            yield own.view(np.int64), a.count[found]
            if k == 3:
                words = hashes[paired(hashes, x, [s.value for s in sieves])] >> np.uint64(64 - HASH_BITS)
                yield words.view(np.int64) + (1 << HASH_BITS), np.ones(len(words), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for found in counted(batches):
            held.append(found)
            size += len(found[0])
            if size >= HELD:
                yield packed(*map(np.concatenate, zip(*held, strict=True)), low)
                held, size = [], 0
        if held:
            yield packed(*map(np.concatenate, zip(*held, strict=True)), low)

    return count


def frequent_hashes(least: int, low: int) -> Callable[[pa.Table], pa.Table]:
    """Of the rows of a range of hashes, those counted ``least`` times and the marked ones."""

    def add(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        raw = [r.as_buffer() for r in rows["counts"]]
        sizes = [r.size // 12 for r in raw]
        hashes = np.concatenate([np.frombuffer(r, "<u4", n) for r, n in zip(raw, sizes, strict=True)]).astype(np.int64)
        keys, total = summed(hashes, np.concatenate([np.frombuffer(r, "<i8", n, 4 * n) for r, n in zip(raw, sizes, strict=True)]))
        keys += part << low
        return pa.table({"hash": keys[(total >= least) | (keys >= 1 << HASH_BITS)]})

    return add


def phrase_counts(sieves: list, useful, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, phrase, words, n) of the phrases that the sieves let through; a null phrase has the number of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, carried, x, raw in read_shards(batches):
            hashes = word_hashes(lang, raw)
            end, words, n = Automaton(x, depth, gate(hashes, x, [s.value for s in sieves]), carried).listed()
            if useful:
                kept = (words > 1) | useful.value.passes(hashes)[x[end]]
                end, words, n = end[kept], words[kept], n[kept]
            names = pa.array([b"", *raw.split(b" ")[1:]], pa.binary()).cast(pa.string())
            for k in range(1, depth + 1):
                own = words == k
                spelled = [names.take(pa.array(x[end[own] - i])) for i in range(k - 1, -1, -1)]
                phrases = pc.binary_join_element_wise(*spelled, " ")
                langs = pa.repeat(pa.scalar(lang, pa.string()), len(phrases))
                yield pa.RecordBatch.from_arrays([langs, phrases, pa.array(words[own]), pa.array(n[own])], schema=_PHRASES)
            yield pa.RecordBatch.from_pylist([{"lang": lang, "phrase": None, "words": 0, "n": int((x[carried:] > 0).sum())}], _PHRASES)

    return count


def sieves_of(counts: DataFrame, least: int, bits: int, low: int) -> tuple[Sieve, Sieve]:
    """The hashes counted ``least`` times, and the marked ones; the driver gets bitmaps of a fixed size, however many they are."""
    marked = F.col("hash") >= F.lit(1 << HASH_BITS)
    frequent = counts.groupBy("part").applyInArrow(frequent_hashes(least, low), "hash long")
    place = F.shiftright(F.col("hash").bitwiseAND(F.lit((1 << HASH_BITS) - 1)), HASH_BITS - bits) + 1
    found = frequent.groupBy(marked.alias("marked"), F.bitmap_bucket_number(place).alias("bucket"))
    rows = found.agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("found")).collect()
    return tuple(Sieve(bits, [(r["bucket"], r["found"]) for r in rows if r["marked"] == kind]) for kind in (False, True))


def frequent_phrases(documents: DataFrame, least: int = LEAST, depth: int = DEPTH, bits: int = BITS) -> DataFrame:
    """lang, phrase (null: all words), words, n of the phrases of up to ``depth`` words that occur ``least`` times.

    From a depth of 3, single words are listed only where they belong to such a pair.
    """
    d = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"))
    d = common.written(d.mapInArrow(common.released(shard_rows(depth)), "lang string, carried int, ids binary, names binary"), "shards")
    context = documents.sparkSession.sparkContext
    share = context.broadcast
    made = d.count()
    # what is frequent is in every task's counts, so fewer tasks send less; most pairs are met once, whatever the task
    gathered = d.coalesce(max(context.defaultParallelism, -(-made // GATHERED)))
    low = HASH_BITS - max(8, (made // RANGED).bit_length())  # so a range has about as many hashes, however many there are
    sieves: list = []
    useful = None
    for k in range(1, min(HASHED, depth) + 1):
        counts = (d if k == 2 else gathered).mapInArrow(common.released(hash_counts(k, list(sieves), low)), "part int, counts binary")
        passing, marked = sieves_of(counts, least, bits, low)
        sieves.append(share(passing))
        useful = share(marked) if k == 3 else None
    counts = gathered.mapInArrow(common.released(phrase_counts(sieves, useful, depth)), "lang string, phrase string, words long, n long")
    counts = counts.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("phrase").isNull() | (F.col("n") >= least))
    return common.written(counts, "phrases")


def _part(phrase: Column, first: Column | int, words: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, words), " ")


def collocations(documents: DataFrame, least: int = LEAST, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score."""
    found = frequent_phrases(documents, least, depth)
    phrases = found.where("phrase IS NOT NULL")
    candidates = phrases.where("words >= 2").withColumnRenamed("n", "a")

    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words").cast("int") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _part(F.col("phrase"), 1, F.col("k")), "right": _part(F.col("phrase"), F.col("k") + 1, F.col("words").cast("int"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    # 38 digits: the product passes 64 bits
    cuts = cuts.withColumn("score", F.expr("CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) DIV CAST(l + r AS DECIMAL(20, 0))"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("at"))

    parts = F.explode(F.array(_part(F.col("phrase"), 2, F.col("words").cast("int")), _part(F.col("phrase"), 1, F.col("words").cast("int") - 1)))
    longer = candidates.where("words >= 3").select("lang", parts.alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    d = weakest.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {INSIDE} * a")

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    d = d.select("lang", "phrase", "a", "at.l", "at.r", "at.score").withColumn("rank", F.row_number().over(order)).where(f"rank <= {top}")
    d = d.join(found.where("phrase IS NULL").select("lang", "n"), "lang")
    return d.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces
), grams AS (
  SELECT lang, k AS words, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
  FROM listed, range(1, 5) t(k) WHERE len(w) >= k
), f AS (
  SELECT lang, words, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY lang, words, phrase HAVING count(*) >= 30
), cuts AS (
  SELECT f.*, k, string_split(phrase, ' ') AS w FROM f, range(1, 4) t(k) WHERE k < words
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, 2000000 * c.a // (x.a + y.a) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT f.lang, f.a, array_to_string(string_split(f.phrase, ' ')[i:i + m - 1], ' ') AS phrase
  FROM f, range(2, 4) s(m), range(1, 4) t(i) WHERE m < f.words AND i + m - 1 <= f.words
), over AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY lang, phrase),
kept AS (
  SELECT w.* FROM weakest w LEFT JOIN over o ON o.lang = w.lang AND o.phrase = w.phrase WHERE longer IS NULL OR 100 * longer < 80 * w.a
), total AS (SELECT lang, sum(len(w)) AS n FROM listed GROUP BY lang)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept k JOIN total t ON t.lang = k.lang
QUALIFY rank <= 2000
"""
