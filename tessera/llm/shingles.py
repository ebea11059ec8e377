"""Words and word shingles of whole texts as 64-bit hashes, computed on the UTF-8 bytes of a batch at once.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, with A-Z lower-cased; all those bytes are ASCII, so the byte
view agrees with the code point view. A span is hashed in chunks of 64 bits, each of which goes through a bijective finaliser keyed with
what came before; spans over LONG units are hashed by keyed BLAKE2, one by one. So, unlike with polynomials modulo a power of two, no
family of different words collides by its structure.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240117)
_SEEDS = _RNG.integers(1 << 32, 1 << 63, 4).astype(U) * U(2) + U(1)
_KEY = _RNG.bytes(32)
LONG = 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MUL = _RNG.integers(1 << 32, 1 << 63, 64).astype(U) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (splitmix64); a bijection."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(units: np.ndarray, start: np.ndarray, end: np.ndarray, checks: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """A 64-bit hash of each span of units (uint8 or uint32), and with checks a second one that is independent of it."""
    width = 8 // units.itemsize
    size = end - start
    padded = np.concatenate((units, np.zeros(width, units.dtype)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    masks = np.array([(1 << (64 // width * k)) - 1 for k in range(width + 1)], U)
    out = [mix(size.astype(U) * _SEEDS[0] + _SEEDS[1])] + ([mix(size.astype(U) * _SEEDS[2] + _SEEDS[3])] if checks else [])
    which, at, left = np.arange(len(start)), start, size
    long = size > LONG
    if long.any():
        which = np.flatnonzero(~long)
        at, left = start[which], size[which]
    everything = len(which) == len(start)
    while len(which):
        chunk = np.ascontiguousarray(windows[at]).view("<u8").ravel() & masks[np.minimum(left, width)]
        for k, h in enumerate(out):
            if everything:
                h[:] = mix((h ^ chunk) + _SEEDS[2 * k])
            else:
                h[which] = mix((h[which] ^ chunk) + _SEEDS[2 * k])
        on = left > width
        which, at, left, everything = which[on], at[on] + width, left[on] - width, False
    for i in np.flatnonzero(long).tolist():
        digest = np.frombuffer(hashlib.blake2b(units[start[i] : end[i]].tobytes(), digest_size=16, key=_KEY).digest(), "<u8")
        for k, h in enumerate(out):
            h[i] = digest[k]
    return out[0], out[1] if checks else None


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in order, and where each row's words begin among them (n + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, A-Z lower-cased, and where each row's words begin among them."""
    start, end, at = word_spans(data, offsets)
    return span_hashes(LOWER[data], start, end)[0], at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; with fewer words one shingle of all of them."""
    h, at = words(data, offsets)
    sh = np.zeros(max(0, len(h) - k + 1), U)
    for j in range(k):
        sh += h[j : j + len(sh)] * _MUL[j]
    sh = mix(sh)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(sh[a : b - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            out.append(mix((h[a:b] * _MUL[: b - a]).sum(dtype=U, keepdims=True) + U(b - a) * _MUL[63]))
        else:
            out.append(np.zeros(0, U))
    return out
