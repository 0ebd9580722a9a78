"""Plain versions of the contracts, one document after the other, to hold the queries against."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


@lru_cache
def library(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def counts(text: str | None) -> tuple:
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def edited(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, str]]:
    docs = sorted((i, t or "") for i, t in docs)
    out = {}
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        n = len(text) // 4
        out[i] = len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()
    return out


def cut(docs: list[tuple[int, str | None]], window: int = 13) -> dict[int, tuple]:
    first: dict[tuple, int] = {}
    split = {i: words(t) for i, t in docs}
    for i in sorted(split):
        for k in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][k : k + window]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near(docs: list[tuple[int, str | None]], k: int = 2) -> dict[int, tuple]:
    sets = {}
    for i, t in docs:
        w = words(lowered(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    for i in sorted(sets):
        both = Counter(j for x in sets[i] for j in having[x] if j < i)
        for j, n in both.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def archived(pages: list[tuple[int, str | None]]) -> dict[int, tuple]:
    owner: dict[bytes, int] = {}
    raw = {i: (h or "").encode() for i, h in pages}
    for i, h in raw.items():
        owner[h] = max(i, owner.get(h, i))
    return {
        i: (
            len(h),
            base64.b32encode(hashlib.sha1(h).digest()).decode(),
            "response" if owner[h] == i else "revisit",
            None if owner[h] == i else owner[h],
        )
        for i, h in raw.items()
    }


def ids(name: str, text: str | None) -> list[int]:
    return library(name).encode(text or "", add_special_tokens=False).ids


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
