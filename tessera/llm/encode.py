"""Token ids of whole texts by the tokenizers library and a byte-level vocabulary file.

The library's model itself encodes every distinct token that its splitting rule makes; the rule and the memo of tokens are in scan.py.
Texts that hold the string of a special token go to the library whole.
"""

from __future__ import annotations

import numpy as np

from .common import CHUNK_BYTES, chunks
from .scan import Clash, Memo, code_points, distinct_tokens, quiet, ragged, split_byte_level

_encoders: dict[str, Encoder] = {}


class Encoder:
    """encode(data, offsets) -> ids of all rows as uint32, and where each row's begin (n + 1 entries)."""

    def __init__(self, path: str):
        quiet()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo = Memo(np.uint32)
        # Its byte-level step maps bytes to characters: printable ones to themselves, the rest in order to those from U+0100.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.chars = np.arange(256, dtype=np.uint32)
        self.chars[hidden] = np.arange(256, 256 + len(hidden))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for i, j in chunks(offsets, CHUNK_BYTES):
            x, c = self._chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids.append(x)
            counts.append(c)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(([0], np.cumsum(n)))

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.special):
            if len(offsets) > 2:
                parts = [self._chunk(data[a:b], np.array([0, b - a])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return self._whole(data, offsets)
        try:
            return self._remembered(data, offsets, raw.decode("utf-8", "replace"))
        except Clash:
            return self._whole(data, offsets)

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every row by the library."""
        rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        ids = [np.array(self.library.encode(r, add_special_tokens=False).ids, np.uint32) for r in rows]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)

    def _remembered(self, data: np.ndarray, offsets: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        at = lead[offsets]
        cps = code_points(text)
        start, end = split_byte_level(cps, at)
        h, checks, first, inverse = distinct_tokens(cps, start, end)

        def encode(which: np.ndarray) -> list:
            model = self.library.model
            shown = self.chars[data].tobytes().decode("utf-32-le")  # a character for each byte
            byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            return [[t.id for t in model.tokenize(shown[a:b])] for a, b in zip(byte[start[which]].tolist(), byte[end[which]].tolist(), strict=True)]

        place = self.memo.find(h, checks, first, encode)[inverse]
        length = self.memo.length[place]
        ends = np.concatenate(([0], np.cumsum(length)))
        return ragged(self.memo.flat, self.memo.start[place], length), np.diff(ends[np.searchsorted(start, at)])


def encoder(path: str) -> Encoder:
    """This Python worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
