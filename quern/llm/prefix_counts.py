"""Token counts at every prefix of a text by dynamic programming over the merges of a public BPE vocabulary.

A sequence of tokens is what byte-pair merging makes of a string just when it is so for each two neighbours.  The
tokens of a prefix therefore follow from those of its own prefixes: the last token is the one that ends there and
agrees with the last token of the prefix before it, and the count is that prefix's plus one.  Each byte of a run costs
a few look-ups, however long the run is; no prefix is encoded.  Whether two tokens agree is asked of the merges once
for each pair.

``Scan`` holds the state after every character of a text, and takes characters back as well: composed forms (NFC) of a
prefix may differ from the prefix of the composed text, and then only the last cluster is read again.  A mark that only
follows another of its class changes nothing before it and is read by itself, so long rows of marks cost no more than text.

The rules of the vocabulary's file are those of ``SETTINGS``; a file with others is refused.  A word whose count the library
gives otherwise (another edition of Unicode) is counted by the library at every prefix, so its counts still agree.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import regex

from quern.llm.tokens import Pieces

# Fixed values of the vocabulary's file: white space, short forms after an apostrophe, special strings, the word end.
SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
SHORT_TWO, SHORT_THREE = ("s", "t", "m", "d"), ("re", "ve", "ll")
RUN = regex.compile(rf"('(?:s|t|re|ve|m|ll|d))|\p{{L}}+|\p{{N}}|[^{''.join(sorted(SPACES))}\p{{L}}\p{{N}}]+")
SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")
WORD_END = "</w>"
#: Marks that often follow a word; none begins a special string or a short form.
STOPS = ".,;:!?"
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "added_tokens": ["<|startoftext|>", "<|endoftext|>"],
}
MODEL = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": WORD_END, "fuse_unk": False,
    "byte_fallback": False, "ignore_merges": False,
}
USUAL = 4

BLANK, CLOSED, LETTERS, OTHERS, NUMBER = range(5)


def byte_letters() -> list[str]:
    """The letter of each byte in a byte-level vocabulary: itself where it can be seen, else the next from U+0100 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in seen)}
    return [chr(hidden.get(b, b)) for b in range(256)]


@lru_cache(maxsize=1)
def second_parts() -> frozenset[str]:
    """Characters that may compose with the one before them."""
    out = {chr(c) for r in (range(0x1161, 0x1176), range(0x11A8, 0x11C3)) for c in r}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


@lru_cache(maxsize=1 << 14)
def kind_of(c: str) -> int:
    if c in SPACES:
        return BLANK
    return {"L": LETTERS, "N": NUMBER}.get(unicodedata.category(c)[0], OTHERS)


def check_settings(file: dict) -> None:
    """Refuses a vocabulary whose texts are split, folded or merged by other rules than those that are carried out here."""
    special = [t["content"] for t in file["added_tokens"] if not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"])]
    got = {k: file.get(k) for k in SETTINGS} | {"added_tokens": special if len(special) == len(file["added_tokens"]) else None}
    model = {k: v for k, v in file["model"].items() if k not in ("vocab", "merges")}
    for name, value, want in [*((k, got[k], SETTINGS[k]) for k in SETTINGS), ("model", model, MODEL)]:
        if value != want:
            raise ValueError(f"the vocabulary's {name} is {value}; counts at prefixes are made for {want}")


class _Merges:
    """The tokens of growing runs of bytes."""

    MOST = 250_000

    def __init__(self, path: str):
        from tokenizers import models

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        check_settings(file)
        model = file["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        self.whole = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=WORD_END)
        self.inside = {t: t for t in model["vocab"] if not t.endswith(WORD_END)}
        self.at_end = {t[: -len(WORD_END)] for t in model["vocab"] if t.endswith(WORD_END)}
        self.longest = max(map(len, (*self.inside, *self.at_end)))
        # just one token agrees, so they may be tried in any order: the usual lengths first
        self.orders = [sorted(range(1, n + 1), key=lambda x: (abs(x - USUAL), x)) for n in range(self.longest + 1)]
        self.agreed: dict[tuple[str, str], bool] = {}
        self.agreed_at_end: dict[tuple[str, str], bool] = {}

    def _ask(self, a: str, b: str, end: bool) -> bool:
        known = self.agreed_at_end if end else self.agreed
        if len(known) >= self.MOST:
            known.clear()
        made = [t.value for t in (self.whole if end else self.inner).tokenize(a + b)]
        found = known[a, b] = made == [a, b + WORD_END if end else b]
        return found

    def grow(self, run: str, new: int, first: int, last: list[str], count: array) -> list[int]:
        """Reads the last ``new`` bytes of a run that begins at byte ``first``; its tokens had it ended after each.

        ``last`` and ``count`` are the last token and the tokens of the open run after each byte so far; both grow.
        """
        inside, at_end, agreed, agreed_at_end, out = self.inside, self.at_end, self.agreed, self.agreed_at_end, []
        at, orders = len(last), self.orders
        for i in range(len(run) - new + 1, len(run) + 1):
            token, ended = None, 0
            for n in orders[min(at - first + 1, self.longest, i)]:
                t = run[i - n : i]
                if token is None and t in inside:
                    if at - n < first:
                        token, tokens = t, 1
                    else:
                        a = last[at - n]
                        good = agreed.get((a, t))
                        if good or good is None and self._ask(a, t, False):
                            token, tokens = t, count[at - n] + 1
                if not ended and t in at_end:
                    if at - n < first:
                        ended = 1
                    else:
                        a = last[at - n]
                        good = agreed_at_end.get((a, t))
                        if good or good is None and self._ask(a, t, True):
                            ended = count[at - n] + 1
                if ended and token is not None:
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(inside[token])
            count.append(tokens)
            out.append(ended)
            at += 1
        return out


class Scan:
    """The counts after each character of a normalized, lower-cased text that may also lose its last ones."""

    def __init__(self, merges: _Merges, letters: list[str]):
        self.merges, self.letters = merges, letters
        self.text: list[str] = []
        # after each character: kind of the open run, its first character and byte, tokens before it, all tokens, bytes
        self.after = tuple(array("q", [x]) for x in (CLOSED, 0, 0, 0, 0, 0))
        self.last: list[str] = []
        self.count = array("q")

    def _state(self, n: int) -> list[int]:
        return [x[n] for x in self.after]

    def _keep(self, *state: int) -> int:
        for x, value in zip(self.after, state, strict=True):
            x.append(value)
        return state[4]

    def cut(self, n: int) -> None:
        """Takes back all but ``n`` characters."""
        del self.text[n:]
        for x in self.after:
            del x[n + 1 :]
        size = self.after[5][-1]
        del self.last[size:], self.count[size:]

    def _bytes(self, x: str) -> str:
        return "".join([self.letters[b] for b in x.encode("utf-8", "replace")])

    def whole(self, x: str) -> int:
        return len(self.merges.whole.tokenize(self._bytes(x)))

    def push(self, c: str) -> int:
        """The count once this character is read."""
        kind, start, first, before, total, size = self._state(-1)
        here, at = kind_of(c), len(self.text)
        self.text.append(c)
        closed = lambda n: self._keep(CLOSED, at + 1, 0, 0, n, size)
        if here == BLANK:
            return closed(total)
        if at - start == 1 and kind == OTHERS and self.text[start] == "'" and c in SHORT_TWO:
            return closed(before + self.whole("'" + c))
        if at - start == 1 and kind == LETTERS and start and self.text[start - 1] == "'" and self.text[start] + c in SHORT_THREE:
            mark, opened, _, early, _, _ = self._state(start)
            if mark == OTHERS and opened == start - 1:
                return closed(early + self.whole("'" + self.text[start] + c))
        if here == NUMBER:
            return closed(total + self.whole(c))
        if here != kind:
            kind, start, first, before = here, at, size, total
        new = self._bytes(c)
        near = self._bytes("".join(self.text[max(start, at - self.merges.longest) : at]))
        ended = self.merges.grow(near + new, len(new), first, self.last, self.count)[-1]
        return self._keep(kind, start, first, before, before + ended, size + len(new))


class PrefixPieces(Pieces):
    """As ``Pieces``, but what is remembered of a piece are the counts after each of its code points."""

    MOST, AT_ONCE = 16_000_000, 1 << 30
    RUNS, SHORT = 400_000, 24

    def __init__(self, path: str):
        super().__init__(path, lead=False)
        self.merges, self.letters = _Merges(path), byte_letters()
        self.before, self.last, self.count, self.ended = "", [], array("q"), []
        self.runs: dict[str, list[int]] = {}

    def _many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found: list[list[int]] = [[]] * len(texts)
        for i in sorted(range(len(texts)), key=texts.__getitem__):  # neighbours share their beginnings
            found[i] = self._word(texts[i])
        odd = [i for i, t in enumerate(texts) if not t.isascii()]
        for i, ids in zip(odd, self.ids([texts[i] for i in odd]) if odd else (), strict=True):
            if found[i][-1] != len(ids):  # the library knows another edition of Unicode
                found[i] = [len(x) for x in self.ids([texts[i][: n + 1] for n in range(len(texts[i]))])]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for f in found for x in f), np.uint32, int(sizes.sum())), sizes

    def _word(self, text: str) -> list[int]:
        """``counts`` of a word; most are plain letters, perhaps with stops after them: runs with nothing to compose or to split."""
        letters = text.rstrip(STOPS)
        if not (text.isascii() and letters.isalpha()):
            return self.counts(text)
        found = self._run(letters.lower())
        if len(letters) == len(text):
            return found
        done = found[-1]
        return found + [done + n for n in self._run(text[len(letters) :])]

    def counts(self, text: str) -> list[int]:
        """Tokens of the prefixes of 1, 2, ... code points."""
        out: list[int] = []
        at = done = 0
        while at < len(text):
            special = SPECIAL.search(text, at)
            end = special.end() if special else len(text)
            part = self._plain(text[at:end])
            out += [done + x for x in part]
            if special:  # until its last character it is text like any other
                before = part[special.start() - at - 1] if special.start() > at else 0
                out[-1] = done + before + 1
            done, at = out[-1], end
        return out

    def _plain(self, text: str) -> list[int]:
        return self._composed(text) if unicodedata.is_normalized("NFC", text) else self._uncomposed(text)

    def _composed(self, text: str) -> list[int]:
        """All prefixes of a composed text are composed: its runs grow one after the other."""
        lowered = text.lower() if text.isascii() else "".join([c.lower() for c in text])
        if lowered.isalpha() and len(lowered) == len(text):
            return list(self._run(lowered))
        out, done, at = [], 0, 0
        for run in RUN.finditer(lowered):
            r, begin = run[0], run.start()
            if begin > at:
                out += [done] * (begin - at)
            at = begin + len(r)
            if run.lastindex:  # a short form: only its last character makes it one
                quote, short = self._run("'")[0], self._run(r)[-1]
                counts = [quote, short] if len(r) == 2 else [quote, quote + self._run(r[1])[0], short]
            else:
                counts = self._run(r)
            out += [done + n for n in counts]
            done = out[-1]
        out += [done] * (len(lowered) - at)
        if len(lowered) > len(text):  # some letters have two in lower case
            ends = np.cumsum([len(c.lower()) for c in text])
            out = [out[i - 1] for i in ends]
        return out

    def _run(self, run: str) -> list[int]:
        """Counts after each character of a run; what it shares with the run of its kind before it is not read again."""
        found = self.runs.get(run)
        if found is not None:
            return found
        if run.isascii() and run.isprintable():
            letters = raw = run
        else:
            raw = run.encode("utf-8", "replace")
            letters = "".join([self.letters[b] for b in raw])
        if run[0].isalpha():
            same, before = min(len(letters), len(self.before)), self.before
            while letters[:same] != before[:same]:
                same -= 1
            del self.last[same:], self.count[same:], self.ended[same:]
            self.ended += self.merges.grow(letters, len(letters) - same, 0, self.last, self.count)
            self.before, found = letters, self.ended.copy()
        else:
            found = self.merges.grow(letters, len(letters), 0, [], array("q"))
        if len(raw) > len(run):
            ends = [i for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]
            found = [found[i - 1] for i in ends]
        if len(run) <= self.SHORT:
            if len(self.runs) >= self.RUNS:
                self.runs.clear()
            self.runs[run] = found
        return found

    def _uncomposed(self, text: str) -> list[int]:
        scan, seconds = Scan(self.merges, self.letters), second_parts()
        out, begin, kept, last = [], 0, 0, 0  # last: class of the mark that the cluster so far ends with, in normal form
        for i, c in enumerate(text):
            kind = unicodedata.combining(c)
            if kind and kind == last and unicodedata.is_normalized("NFC", c):  # kept apart from its base by the one before
                for x in c.lower():
                    scan.push(x)
                out.append(scan.after[4][-1])
                continue
            if not kind and c not in seconds and unicodedata.is_normalized("NFC", c):
                begin, kept = i, len(scan.text)  # nothing before it can change any more
            normal = unicodedata.normalize("NFC", text[begin : i + 1])
            last = unicodedata.combining(normal[-1])
            cluster = [x for y in normal for x in y.lower()]
            same = kept
            while same < len(scan.text) and same - kept < len(cluster) and scan.text[same] == cluster[same - kept]:
                same += 1
            scan.cut(same)
            for x in cluster[same - kept :]:
                scan.push(x)
            out.append(scan.after[4][-1])
        return out


@lru_cache(maxsize=1)
def prefix_pieces(path: str) -> PrefixPieces:
    """The worker's memory of a vocabulary's prefix counts, kept between tasks."""
    return PrefixPieces(path)
