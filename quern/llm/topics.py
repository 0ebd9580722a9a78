"""Topics: every text's nearest of ``TOPICS`` learned centroids of term weights.

A text's vector holds, over ``SIZE`` hashed dimensions with signs, how many of its distinct words of ``LONGER`` bytes
or more fall there, scaled to length one.  The centroids are fitted by Lloyd's rounds over the vectors of all rows, less
their mean (what all texts share says nothing of a topic): each round a task adds up its rows by nearest centroid, and
Spark the sums of the tasks; the driver sees ``TOPICS`` times ``SIZE`` numbers.  They begin at the vectors of the rows
of least hash, so a rerun finds the same topics.

Edge cases: a text without longer words (null, empty) has the topic "none"; with fewer different vectors than topics,
some topics stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import common
from quern.llm.bytes import blocks, row_of

TOPICS, SIZE, LONGER, ROUNDS = 8, 64, 5, 5
NONE = "none"


def measured(documents: DataFrame, keep_text: bool) -> DataFrame:
    """``documents`` (all columns; ``text`` last, or left out) with n_tokens (words) and the vector ``__v`` of each text."""
    others = [c for c in documents.columns if c.lower() != "text"]
    d = documents.select(*others, F.col("text").cast("string").alias("text"))
    fields = d.schema.fields[:-1] + [T.StructField("n_tokens", T.LongType()), T.StructField("__v", T.BinaryType())]
    fields += [d.schema.fields[-1]] * keep_text
    names, n = [f.name for f in fields], len(others)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(n)):
                starts, ends, bounds = block.words()
                rows = row_of(bounds)
                vectors = np.zeros((block.rows, SIZE), np.float32)
                long = np.flatnonzero(ends - starts >= LONGER)
                if len(long):
                    keys = block.hashes(starts[long], ends[long], fold=True)
                    order = np.lexsort((keys, rows[long]))
                    r, k = rows[long][order], keys[order]
                    new = np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1]))
                    r, k = r[new], k[new]
                    sign = np.where(k >> np.uint64(40) & np.uint64(1), np.float32(1), np.float32(-1))
                    np.add.at(vectors, (r, (k % np.uint64(SIZE)).astype(np.int64)), sign)
                    size = np.linalg.norm(vectors, axis=1, keepdims=True)
                    vectors = np.divide(vectors, size, out=vectors, where=size > 0)
                part = batch.slice(block.first, block.rows)
                columns = [*part.columns[:n], pa.array(np.diff(bounds)), pa.array([v.tobytes() for v in vectors], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + [part.column(n)] * keep_text, names)

    return d.mapInArrow(common.released(work), T.StructType(fields))


@dataclass(frozen=True)
class Centroids:
    mean: np.ndarray
    at: np.ndarray  # (topic, dimension)

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The topic of each vector; -1 for one of no length."""
        if not len(self.at):
            return np.full(len(vectors), -1)
        found = np.argmax((vectors - self.mean) @ self.at.T, axis=1)
        return np.where(np.abs(vectors).max(1, initial=0) > 0, found, -1)


def _vectors(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float32).reshape(-1, SIZE)


def _sums(d: DataFrame, centroids: Centroids | None) -> dict[int, tuple[int, np.ndarray]]:
    """Rows and added vectors of each topic (without centroids: of all rows)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            v = _vectors(batch.column(0).to_pylist())
            topic = centroids.nearest(v) if centroids else np.zeros(len(v), np.int64)
            for t in np.unique(topic):
                own = v[topic == t].astype(np.float64)
                total[int(t)] = total.get(int(t), 0) + np.append(own.sum(0), len(own))
        for t, x in total.items():
            yield pa.RecordBatch.from_pydict({"topic": [t] * len(x), "place": range(len(x)), "x": x}, schema=_SUMS)

    rows = d.select("__v").mapInArrow(common.released(work), "topic int, place int, x double").groupBy("topic", "place").agg(F.sum("x").alias("x"))
    out: dict[int, np.ndarray] = {}
    for r in rows.collect():
        out.setdefault(r["topic"], np.zeros(SIZE + 1))[r["place"]] = r["x"]
    return {t: (int(x[-1]), x[:-1]) for t, x in out.items()}


_SUMS = pa.schema([("topic", pa.int32()), ("place", pa.int32()), ("x", pa.float64())])


def fitted(d: DataFrame, topics: int = TOPICS, rounds: int = ROUNDS) -> Centroids:
    """Centroids of the vectors ``__v`` of a written table."""
    whole = _sums(d, None).get(0)
    first = d.select("__v").distinct().orderBy(F.xxhash64("__v"), "__v").limit(2 * topics)  # the rows that rounds begin at
    starts = _vectors([r["__v"] for r in first.collect()])
    starts = starts[np.abs(starts).max(1, initial=0) > 0][:topics]
    if whole is None or not len(starts):
        return Centroids(np.zeros(SIZE), np.zeros((0, SIZE)))
    mean = whole[1] / whole[0]
    at = starts - mean
    for i in range(rounds + 1):
        size = np.linalg.norm(at, axis=1, keepdims=True)
        at = np.divide(at, size, out=np.zeros_like(at), where=size > 0)
        now = Centroids(mean.astype(np.float32), at.astype(np.float32))
        if i == rounds:
            return now
        for t, (n, x) in _sums(d, now).items():
            if t >= 0:
                at[t] = x / n - mean


def with_topic(d: DataFrame, centroids: Centroids) -> DataFrame:
    """Adds ``topic`` (as a string) from the vectors, which go."""

    @F.pandas_udf("string")
    def topic(v: pd.Series) -> pd.Series:
        return pd.Series([str(t) if t >= 0 else NONE for t in centroids.nearest(_vectors(v))])

    return d.withColumn("topic", topic("__v")).drop("__v")
