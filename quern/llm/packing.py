"""Packing documents into training sequences: vector bin packing by the dot-product heuristic.

A sequence has limits on tokens, segments and loss-bearing tokens.  It is filled by taking, again and again, the
waiting piece that fits and whose sizes have the greatest dot product with what the sequence has left of each limit
(both as shares of the limit).  Pieces that would fit no more are cut: the last free place takes the head of a longer
piece, so that a sequence is full unless its segments or loss-bearing tokens run out first.  A document's first tokens,
its prompt, bear no loss: as many as the column ``prompt`` says, or where a table has none, one in ``PROMPT_EVERY``.
When what waits cannot fill a sequence within the limits, the rest goes into sequences of a power of two tokens, which
need no padding.

Work is done in blocks of ``BLOCK_IDS`` ids within a task, with no shuffle; sequence ids are unique over all tasks.  A
document of more ids than that is a block of its own.

Edge cases: a null text counts as empty and consists of the end id; repeated rows are packed each; doc_id may be null;
a null or negative prompt is 0, one beyond the document's end is all of it; an empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common
from quern.llm.bytes import blocks
from quern.llm.tokens import POOL, pieces

BLOCK_IDS, PROMPT_EVERY = 400_000, 8


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


#: For running text, an eighth of which is prompt: either limit is met by some sequences and exceeded by none.
DOCUMENTS = Limits(2048, 16, 1856)


@dataclass
class Piece:
    doc: int
    start: int
    length: int
    loss_from: int  # tokens before this place of the document bear no loss

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.loss_from))

    def within(self, loss: int) -> int:
        """The most of its first tokens that bear no more than ``loss``."""
        return min(self.length, max(0, self.loss_from - self.start) + loss)

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.start, length, self.loss_from),
            Piece(self.doc, self.start + length, self.length - length, self.loss_from),
        )


class Waiting:
    """Pieces that wait, as kinds of equal sizes, so that a choice costs one pass over the kinds."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.tokens = 0
        self._begin([])

    def _begin(self, lists: list[list[Piece]]) -> None:
        """Only kinds of which there are pieces stay."""
        room = 2 * len(lists) + 64
        self.length, self.loss = np.zeros(room, np.float32), np.zeros(room, np.float32)
        self.there = np.zeros(room, bool)
        self.lists = lists
        self.kinds: dict[tuple[int, int], int] = {}
        for at, pieces_ in enumerate(lists):
            self._enter(at, pieces_[0].length, pieces_[0].loss)
        self.live = len(lists)

    def _enter(self, at: int, length: int, loss: int) -> None:
        self.kinds[length, loss] = at
        self.length[at], self.loss[at], self.there[at] = length, loss, True

    def add(self, piece: Piece) -> None:
        key = (piece.length, piece.loss)
        at = self.kinds.get(key)
        if at is None:
            if len(self.lists) == len(self.length):
                self._begin([x for x in self.lists if x])
            at = len(self.lists)
            self.lists.append([])
            self._enter(at, *key)
        self.live += not self.lists[at]
        self.lists[at].append(piece)
        self.there[at] = True
        self.tokens += piece.length

    def take(self, at: int) -> Piece:
        piece = self.lists[at].pop()
        if not self.lists[at]:
            self.there[at] = False
            self.live -= 1
            if 4 * self.live + 64 < len(self.lists):
                self._begin([x for x in self.lists if x])
        self.tokens -= piece.length
        return piece

    def best(self, left: list[int]) -> int | None:
        """The kind that fits and has the greatest dot product with what is left."""
        n = len(self.lists)
        length, loss = self.length[:n], self.loss[:n]
        score = length * (left[0] / self.limits.tokens**2) + loss * (left[2] / self.limits.loss**2)
        score[~(self.there[:n] & (length <= left[0]) & (loss <= left[2]))] = -1.0  # a segment more is the same for all
        at = int(score.argmax()) if n else -1
        return at if at >= 0 and score[at] >= 0 else None

    def filling(self, left: list[int]) -> tuple[int, int] | None:
        """The kind whose head takes up most of what is left (of equals the longest), and how many tokens it takes."""
        n = len(self.lists)
        length = self.length[:n]
        usable = np.minimum(np.minimum(length, left[0]), length - self.loss[:n] + left[2]) * self.there[:n]
        most = usable.max(initial=0)
        if most <= 0:
            return None
        return int(np.where(usable == most, length, -1).argmax()), int(most)


def pack(docs: list[tuple[int, int]], limits: Limits = Limits(), padded: bool = False) -> list[list[Piece]]:
    """Sequences of pieces for documents of (tokens, prompt tokens); ``Piece.doc`` is a document's place in the list.

    ``padded``: sequences that cannot be filled stay as they are instead of being cut to a power of two.
    """
    waiting, out = Waiting(limits), []
    for doc, (n, prompt) in enumerate(docs):
        start = 0
        while n - start:
            piece = Piece(doc, start, min(limits.tokens, n - start), prompt)
            piece = piece.cut(piece.within(limits.loss))[0]
            if piece.length == limits.tokens and piece.loss == limits.loss:
                out.append([piece])  # full by itself
            else:
                waiting.add(piece)
            start += piece.length
    while waiting.tokens:
        left, sequence = [limits.tokens, limits.segments, limits.loss], []
        while left[0] and left[1]:
            at = waiting.best(left) if left[1] > 1 else None  # the last segment must fill what is left
            if at is not None:
                piece = waiting.take(at)
            else:  # none fits, or one segment is left
                found = waiting.filling(left)
                if found is None:
                    break
                piece = waiting.take(found[0])
                if found[1] < piece.length:
                    piece, rest = piece.cut(found[1])
                    waiting.add(rest)
            sequence.append(piece)
            left = [left[0] - piece.length, left[1] - 1, left[2] - piece.loss]
        held = limits.tokens - left[0]
        over = held - (1 << held.bit_length() - 1) if held < limits.tokens and not padded else 0
        while over:  # not full: only a power of two needs no padding
            piece = sequence.pop()
            if piece.length > over:
                piece, rest = piece.cut(piece.length - over)
                sequence.append(piece)
                piece = rest
            over -= piece.length
            waiting.add(piece)
        out.append(sequence)
    return out


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
)


def packed(
    documents: DataFrame, path: str, end_id: int = 1, limits: Limits = DOCUMENTS, block_ids: int = BLOCK_IDS, remembered: int = POOL
) -> DataFrame:
    """The pieces of all documents with the sequence and the offset where each lies.

    ``remembered``: ids of pieces that a worker keeps, so that it need not encode these again.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(path, lead=False)
        encoder.MOST = remembered
        sequence_id = TaskContext.get().partitionId() << 40
        names: list = []
        prompts: list[int] = []
        parts: list[np.ndarray] = []  # ids of some documents on end, with their end ids
        sizes: list[int] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence_id, held
            flat = np.concatenate(parts).astype("<u4", copy=False)
            first = np.cumsum([0, *sizes])
            columns: list[list[int]] = [[] for _ in _NAMES]
            for sequence in pack(list(zip(sizes, prompts, strict=True)), limits):
                offset = 0
                for p in sequence:
                    at = int(first[p.doc]) + p.start
                    crc = zlib.crc32(flat[at : at + p.length])
                    row = (names[p.doc], p.start, p.length, crc, sizes[p.doc], sequence_id, offset, p.loss)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += p.length
                sequence_id += 1
                if len(columns[0]) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)
                    columns = [[] for _ in _NAMES]
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)
            names.clear(), prompts.clear(), parts.clear(), sizes.clear()
            held = 0

        for batch in batches:
            given = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            for block in blocks(batch.column(1)):
                flat, where = encoder.encode(block)
                parts.append(np.insert(flat, where[1:], np.uint32(end_id)))
                size = (np.diff(where) + 1).tolist()
                names += batch.column(0).slice(block.first, block.rows).to_pylist()
                sizes += size
                if given:
                    prompts += [max(0, x or 0) for x in given[block.first : block.first + block.rows]]
                else:
                    prompts += [n // PROMPT_EVERY for n in size]
                held += len(parts[-1])
                if held >= block_ids:
                    yield from flush()
        if sizes:
            yield from flush()

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    columns += [F.col("prompt").try_cast("long")] if "prompt" in documents.columns else []
    return documents.select(*columns).mapInArrow(common.released(work), SCHEMA)


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
