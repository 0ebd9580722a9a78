"""Exact token ids and counts of whole texts, by the library of a public tokenizer.

A text is cut where no token can cross: before each word for vocabularies that drop white space (``lead=False``),
before each run of blanks for byte-level ones, whose tokens may begin with a blank (``lead=True``).  The pieces of a
block are hashed together, and only pieces that the worker has not met yet go through the library; ids come from a
pool of some ``POOL`` ids, begun anew when it is full.  A text with blanks outside ASCII, which may join with their
neighbours in a byte-level vocabulary, goes through the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from quern.llm.bytes import Block

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

POOL = 6_000_000
MARK = "<|endoftext|>"
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[[0xC2, 0xE1, 0xE2, 0xE3, 0x1C, 0x1D, 0x1E, 0x1F]] = True
#: Blanks outside ASCII, and the four ASCII separators.  Fixed values.
ODD_BLANKS = "\x1c\x1d\x1e\x1f\x85\xa0                　"


class Pieces:
    """Token ids of pieces of text, remembered by the hash of their bytes."""

    MOST, AT_ONCE = POOL, 512

    def __init__(self, path: str, lead: bool):
        from tokenizers import Tokenizer

        self.library, self.lead = Tokenizer.from_file(path), lead
        # a special token between pieces keeps them apart: the library splits a text at it before all else
        self.mark_id = self.library.token_to_id(MARK)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many each has."""
        if self.mark_id is None or any(MARK[:2] in t for t in texts):
            found = self.ids(texts)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((x for f in found for x in f), np.uint32, int(sizes.sum())), sizes
        ids = np.array(self.library.encode(MARK.join(texts), add_special_tokens=False).ids, np.uint32)
        at = np.flatnonzero(ids == self.mark_id)
        sizes = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
        return np.delete(ids, at), sizes

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        parts = [self._many(texts[i : i + self.AT_ONCE]) for i in range(0, len(texts), self.AT_ONCE)]
        flat = np.concatenate([p[0] for p in parts])
        sizes = np.concatenate([p[1] for p in parts])
        total = len(flat)
        if self.used + total > len(self.pool):
            grown = np.zeros(max(2 * len(self.pool), self.used + total), np.uint32)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + total] = flat
        slot = len(self.at) + np.arange(len(keys))
        self.at = np.append(self.at, self.used + np.cumsum(sizes) - sizes)
        self.size = np.append(self.size, sizes)
        self.used += total
        where = np.searchsorted(self.keys, keys)  # both are in order
        self.keys, self.slot = np.insert(self.keys, where, keys), np.insert(self.slot, where, slot)

    def slots(self, block: Block) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each piece of a block the number under which it is remembered; the pieces."""
        starts, ends, bounds = pieces = block.lead_chunks() if self.lead else block.words()
        if not len(starts):
            return np.zeros(0, np.int64), pieces
        if self.used > self.MOST:
            self._forget()
        keys, first, each = np.unique(block.hashes(starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        near = at < len(self.keys)
        new[near] = self.keys[at[near]] != keys[near]
        if new.any():
            data = block.data.tobytes()
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[new]], ends[first[new]], strict=True)]
            self._learn(keys[new], texts)
            at = np.searchsorted(self.keys, keys)
        return self.slot[at][each], pieces

    def odd_rows(self, block: Block) -> list[int]:
        """Rows with blanks outside ASCII, where cutting could change the tokens of a byte-level vocabulary."""
        if not self.lead or not _ODD_LEAD[block.data].any():
            return []
        odd = set(ODD_BLANKS)
        at = np.flatnonzero(_ODD_LEAD[block.data])
        rows = np.unique(np.searchsorted(block.bounds, at, "right") - 1)
        return [int(r) for r in rows if odd & set(self.text(block, r))]

    @staticmethod
    def text(block: Block, row: int) -> str:
        return block.data[block.bounds[row] : block.bounds[row + 1]].tobytes().decode("utf-8", "replace")

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a block, and where each row's begin (one more than rows)."""
        slots, (_, _, bounds) = self.slots(block)
        size = self.size[slots]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.pool[np.repeat(self.at[slots] - (ends - size), size) + np.arange(total)]
        where = np.append(0, ends)[bounds]
        if odd := self.odd_rows(block):
            parts = [flat[where[r] : where[r + 1]] for r in range(block.rows)]
            for r, ids in zip(odd, self.ids([self.text(block, r) for r in odd]), strict=True):
                parts[r] = np.array(ids, np.uint32)
            flat = np.concatenate(parts)
            where = np.append(0, np.cumsum([len(p) for p in parts]))
        return flat, where


@lru_cache(maxsize=1)
def pieces(path: str, lead: bool) -> Pieces:
    """The worker's memory of a vocabulary, kept between tasks; of one at a time."""
    return Pieces(path, lead)
