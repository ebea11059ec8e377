"""Tokenisers' splitting rules over whole batches of texts, and a memo of the tokens seen before.

A batch's code points are classed (letter, number, white space, other) by tables, the boundaries of all tokens follow from the classes of
neighbours, and each token gets two independent 64-bit hashes. Only tokens that are new to this Python worker are encoded one by one; all
others copy their ids from the memo, after the second hash has confirmed the hit. At MEMO_ENTRIES the memo forgets what has not come up again, which bounds its memory.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np

from .shingles import U, span_hashes

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Tokens that a Python worker remembers; 24 bytes each besides their ids, and twice that while new ones go in.
MEMO_ENTRIES = 300_000
_tables: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """The class of every code point, as the tokenizers library's own regular expressions have it."""
    if not _tables:
        from tokenizers import Regex, pre_tokenizers

        table = np.full(0x110000, OTHER, np.uint8)
        points = [c for c in range(0x40000) if not 0xD800 <= c < 0xE000]  # none of the three lies above
        text, at = "".join(map(chr, points)), np.array(points)
        for kind, rx in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            inside = np.ones(len(at), bool)
            for _, (a, b) in pre_tokenizers.Split(Regex(f"{rx}+"), "removed").pre_tokenize_str(text):
                inside[a:b] = False
            table[at[inside]] = kind
        _tables.append(table)
    return _tables[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _contractions(cps: np.ndarray, cls: np.ndarray, first: np.ndarray, last: np.ndarray, space_binds: bool) -> list[tuple[int, int]]:
    """(start, end) of 's 't 'm 'd 're 've 'll where the apostrophe begins a token; first, last: of texts."""
    out, n = [], len(cps)
    for i in np.flatnonzero((cps[:-1] == 39) & (cls[1:] == LETTER) & ~last[:-1]).tolist():
        if not first[i] and (cls[i - 1] == OTHER or space_binds and cps[i - 1] == 32):
            continue
        a = cps[i + 1]
        if a in (115, 116, 109, 100):
            out.append((i, i + 2))
        elif i + 2 < n and not last[i + 1] and (a, cps[i + 2]) in ((114, 101), (118, 101), (108, 108)):
            out.append((i, i + 3))
    return out


def _edges(n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    full = at[1:] > at[:-1]
    first[at[:-1][full]] = True
    last[at[1:][full] - 1] = True
    return first, last


def split_byte_level(cps: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of tokens: contractions, runs of letters, numbers or others with one blank before, runs of white space.

    at: where texts begin among the code points, n + 1 entries. White space before other text gives up its last character: a
    blank joins what follows, anything else stands alone.
    """
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = class_table()[cps]
    first, last = _edges(n, at)
    start = np.ones(n, bool)
    space = cls == SPACE
    blank = cps == 32
    prev_space, prev_blank = np.empty(n, bool), np.empty(n, bool)
    prev_space[0] = prev_blank[0] = False
    prev_space[1:], prev_blank[1:] = space[:-1], blank[:-1]
    start[1:] = cls[1:] != cls[:-1]
    ends_run = np.zeros(n, bool)  # white space with text behind
    ends_run[:-1] = space[:-1] & ~space[1:]
    ends_run &= ~last
    start = np.where(space, ~prev_space | ends_run, start & ~prev_blank)
    start |= first
    for a, b in _contractions(cps, cls, first, last, True):
        start[a] = True
        start[a + 1 : b] = False
        if b < n:
            start[b] = True
    s = np.flatnonzero(start)
    return s, np.append(s[1:], n)


def split_words(cps: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of tokens: contractions, runs of letters, single numbers, runs of others; white space is dropped."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = class_table()[cps]
    first, last = _edges(n, at)
    start = first.copy()
    start[1:] |= (cls[1:] != cls[:-1]) | (cls[1:] == NUMBER)
    for a, b in _contractions(cps, cls, first, last, False):
        start[a] = True
        start[a + 1 : b] = False
        if b < n:
            start[b] = True
    s = np.flatnonzero(start)
    e = np.append(s[1:], n)
    text = cls[s] != SPACE
    return s[text], e[text]


def ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + length] one after another."""
    ends = np.cumsum(length, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - length), length) + np.arange(total)]


class Clash(Exception):
    """Two different tokens have the same first hash; the caller encodes without a memo."""


class Memo:
    """Values (slices of a flat array) by 64-bit hash, each hit being confirmed by a second hash."""

    def __init__(self, dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks, self.start, self.length = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.again = np.zeros(0, self.dtype), np.zeros(0, bool)

    def forget(self, more: int) -> None:
        """Makes room for more entries: those that came up again since the last time stay, unless they are too many themselves."""
        kept = self.again
        if int(kept.sum()) > MEMO_ENTRIES // 2 or int(kept.sum()) + more > MEMO_ENTRIES:
            return self.clear()
        length = self.length[kept]
        self.flat = ragged(self.flat, self.start[kept], length)
        self.keys, self.checks, self.start, self.length = self.keys[kept], self.checks[kept], (np.cumsum(length, dtype=np.int64) - length).astype(np.int32), length
        self.again = np.zeros(len(self.keys), bool)

    def find(self, h: np.ndarray, checks: np.ndarray, first: np.ndarray, encode: Callable[[np.ndarray], list]) -> np.ndarray:
        """Places of the sorted distinct hashes h among the entries; encode(first of the new ones) gives what new ones stand for."""
        if len(self.keys) + len(h) > MEMO_ENTRIES:
            self.forget(len(h))
        at = np.searchsorted(self.keys, h)
        new = np.ones(len(h), bool)
        if len(self.keys):
            near = np.minimum(at, len(self.keys) - 1)
            new = self.keys[near] != h
            if (self.checks[near] != checks)[~new].any():
                raise Clash
            self.again[near[~new]] = True
        if new.any():
            values = encode(first[new])
            length = np.fromiter(map(len, values), np.int32, len(values))
            joined = np.fromiter(chain.from_iterable(values), self.dtype, int(length.sum())) if self.dtype != np.uint8 else np.frombuffer(b"".join(values), np.uint8)
            start = (len(self.flat) + np.cumsum(length, dtype=np.int64) - length).astype(np.int32)
            self.flat = np.concatenate((self.flat, joined))
            where = at[new]
            self.keys, self.checks = np.insert(self.keys, where, h[new]), np.insert(self.checks, where, checks[new])
            self.start, self.length = np.insert(self.start, where, start), np.insert(self.length, where, length)
            self.again = np.insert(self.again, where, False)
            at = np.searchsorted(self.keys, h)
        return at


def token_hashes(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each token."""
    return span_hashes(cps, start, end, checks=True)


def distinct_tokens(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens' distinct hashes in order, their second hashes, the first token of each, and each token's place among them."""
    hashes, checks = token_hashes(cps, start, end)
    h, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    if (checks[first][inverse] != checks).any():
        raise Clash
    return h, checks[first], first, inverse


def quiet() -> None:
    """Keeps the tokenizers library to the task's own thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
