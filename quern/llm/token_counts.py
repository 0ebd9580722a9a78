"""Token counts of whole texts, stored at every prefix, and answers to budgets from what is stored.

``write`` makes the table: for each row the steps of the count from one prefix to the next (one for each code point,
as bytes of the least width that holds them all).  ``read`` and ``fitting`` answer from the table alone: the total, whether
a limit is exceeded, and the longest prefix within a budget.  No text is encoded again, nor is the vocabulary needed.

Edge cases: a null text counts as empty and has no tokens; rows may repeat and doc_ids be null, each row is answered;
columns besides doc_id and text are not read; an empty table gives an empty one.  A text's every prefix is counted as
the library would count that prefix alone.  In a text that is not composed (NFC), one cluster of n combining marks
costs n * n steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bytes import Block, blocks
from quern.llm.prefix_counts import PrefixPieces, prefix_pieces

LIMIT = 2048
SCHEMA = "doc_id long, n_bytes long, n_chars long, width int, steps binary"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def block_counts(block: Block, encoder: PrefixPieces) -> tuple[np.ndarray, np.ndarray]:
    """The counts after each code point of the rows of a block, and where each row's begin (one more than rows)."""
    begins = (block.data & 0xC0) != 0x80
    point = np.append(0, np.cumsum(begins))  # code points before each byte
    rows = point[block.bounds]
    slots, (starts, ends, bounds) = encoder.slots(block)
    size = encoder.size[slots]
    at = encoder.at[slots]
    total = encoder.pool[at + size - 1].astype(np.int64) if len(slots) else np.zeros(0, np.int64)
    done = np.append(0, np.cumsum(total))
    first = done[bounds]  # before each row
    ended = np.bincount(point[ends], minlength=rows[-1] + 1)[: rows[-1]]  # a blank has the count of all pieces before it
    counts = done[np.cumsum(ended)]
    place = np.cumsum(size) - size
    step = np.arange(int(size.sum()))
    inner = np.repeat(point[starts] - place, size) + step
    counts[inner] = encoder.pool[np.repeat(at - place, size) + step] + np.repeat(done[:-1], size)
    return counts - np.repeat(first[:-1], np.diff(rows)), rows


def coded(counts: np.ndarray) -> tuple[int, bytes]:
    """Width and bytes of the steps of a row of counts."""
    steps = np.diff(counts, prepend=0)
    low, high = steps.min(initial=0), steps.max(initial=0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return width, steps.astype(f"<i{width}").tobytes()


def decoded(width: int, steps: bytes) -> np.ndarray:
    """The counts after each code point."""
    return np.cumsum(np.frombuffer(steps, f"<i{width}"), dtype=np.int64)


def prefixes(documents: DataFrame, path: str) -> DataFrame:
    """For each row doc_id, n_bytes, n_chars and the steps of its prefix counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_pieces(path)
        for batch in batches:
            for block in blocks(batch.column(1)):
                counts, rows = block_counts(block, encoder)
                found = [coded(counts[a:b]) for a, b in zip(rows, rows[1:], strict=False)]
                columns = [
                    batch.column(0).slice(block.first, block.rows),
                    pa.array(np.diff(block.bounds)),
                    pa.array(np.diff(rows)),
                    pa.array([w for w, _ in found], pa.int32()),
                    pa.array([s for _, s in found], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, _NAMES)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, SCHEMA)


def write(documents: DataFrame, at: str, path: str) -> None:
    """Writes the prefix counts of all texts below the folder ``at``."""
    prefixes(documents, path).write.option("compression", "zstd").parquet(at)


def read(spark: SparkSession, at: str, limit: int = LIMIT) -> DataFrame:
    """From the table, for each row doc_id, n_bytes, n_tokens, over_limit and fitting_chars.

    fitting_chars: code points of the longest prefix of at most ``limit`` tokens.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, fits = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                counts = decoded(batch.column(2)[i].as_py(), batch.column(3)[i].as_buffer())
                if len(counts):
                    totals[i] = counts[-1]
                    within = counts <= limit
                    fits[i] = len(counts) if within.all() else len(counts) - int(np.argmax(within[::-1])) if within.any() else 0
            columns = [batch.column(0), batch.column(1), pa.array(totals), pa.array(totals > limit), pa.array(fits)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"])

    table = spark.read.schema(SCHEMA).parquet(at).select("doc_id", "n_bytes", "width", "steps")
    return table.mapInArrow(answer, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long")
