"""Byte-pair encoding of whole texts from a vocabulary file, written here: only the file's normalisation and splitting rules are given.

A word is a doubly linked list of symbols. A priority queue holds (rank, place, symbols) for each neighbouring pair that has a merge; the
lowest rank, and of those the leftmost, is merged, its new neighbours are queued, and entries whose symbols have changed meanwhile are
skipped as stale. Each distinct word is encoded once for each Python worker (scan.py finds the words and remembers them).
Decoding concatenates vocabulary strings, with a blank between tokens where the file names no decoder.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, small_batches, utf8
from .scan import Clash, Memo, class_table, code_points, distinct_tokens, ragged, split_words

_encoders: dict[str, WordBpe] = {}
#: The library's white space; Python's \s has the separators U+001C to U+001F besides.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_GIVEN = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


class Merges:
    """Encodes single words."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.vocab, self.end = vocab, end
        self.rank: dict[tuple[str, str], int] = {}
        for i, m in enumerate(merges):
            self.rank.setdefault(tuple(m) if not isinstance(m, str) else tuple(m.split(" ")), i)

    def encode(self, chars: str) -> list[int]:
        """chars: a word's bytes as characters."""
        n, rank = len(chars), self.rank
        symbol: list[str | None] = list(chars)
        symbol[-1] += self.end
        if n == 1:
            return [self.vocab[symbol[0]]]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := rank.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i] if symbol[i] == a else n
            if j >= n or symbol[j] != b:
                continue  # stale
            symbol[i], symbol[j] = a + b, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((a + b, symbol[k]))) is not None:
                    heapq.heappush(queue, (r, i, a + b, symbol[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((symbol[h], a + b))) is not None:
                heapq.heappush(queue, (r, h, symbol[h], a + b))
        return [self.vocab[s] for s in symbol if s is not None]


class WordBpe:
    """Ids and decoded text of whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        if file["normalizer"]["normalizers"] != _GIVEN or model["end_of_word_suffix"] != "</w>" or file["decoder"] is not None:
            raise ValueError(f"{path}: other rules than those written here")
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.names = {i: s for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.names |= {i: s for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.chars = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.ids, self.shown = Memo(np.uint32), Memo(np.uint8)

    def normal(self, text: str) -> str:
        # Lower case by character: the library does not look for a sigma at a word's end.
        return _WHITE.sub(" ", text if text.isascii() else unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()

    def word(self, text: str) -> list[int]:
        return self.merges.encode(text.encode().decode("latin-1").translate(self.chars))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, their ends by text, the decoded bytes (a blank after each token), their ends by text."""
        try:
            return self._texts(texts, self.ids, self.shown)
        except Clash:  # every word is encoded under a number of its own
            return self._texts(texts, Memo(np.uint32), Memo(np.uint8), numbered=True)

    def _texts(self, texts: list[str], ids: Memo, shown_ids: Memo, numbered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        segments, owner = [], []
        fixed: list[tuple[int, int, str]] = []  # (segment before which it stands, text, special token)
        for i, t in enumerate(texts):
            parts = self.cut.split(t) if "<|" in t else [t]
            for k, p in enumerate(parts):
                if k % 2:
                    fixed.append((len(segments), i, p))
                else:
                    segments.append(self.normal(p))
                    owner.append(i)
        joined = "".join(segments)
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))))
        cps = code_points(joined)
        start, end = split_words(cps, at)
        h, checks, first, inverse = (np.arange(len(start), dtype=np.uint64),) * 2 + (np.arange(len(start)),) * 2 if numbered else distinct_tokens(cps, start, end)
        new: dict[int, list[int]] = {}

        def encode(which: np.ndarray) -> list:
            for w, a, b in zip(which.tolist(), start[which].tolist(), end[which].tolist(), strict=True):
                new[w] = self.word(joined[a:b])
            return [new[w] for w in which.tolist()]

        def show(which: np.ndarray) -> list:
            return ["".join(f"{self.names[i]} " for i in new[w]).encode() for w in which.tolist()]

        place, shown = ids.find(h, checks, first, encode)[inverse], shown_ids.find(h, checks, first, show)[inverse]
        word_at = np.searchsorted(start, at)
        out = []
        for memo, p, extra in ((ids, place, lambda s: np.array([self.special[s]], np.uint32)), (shown_ids, shown, lambda s: np.frombuffer(f"{s} ".encode(), np.uint8))):
            length = memo.length[p]
            flat = ragged(memo.flat, memo.start[p], length)
            ends = np.concatenate(([0], np.cumsum(length)))[word_at]
            if fixed:
                pieces, sizes, last = [], np.zeros(len(texts), np.int64), 0
                for seg, i, s in [*fixed, (len(segments), 0, "")]:
                    pieces.append(flat[ends[last] : ends[seg]])
                    last = seg
                    if s:
                        pieces.append(extra(s))
                        sizes[i] += len(pieces[-1])
                flat = np.concatenate(pieces)
                np.add.at(sizes, owner, np.diff(ends))
                by_text = np.cumsum(sizes)
            else:
                by_text = ends[1:]
            out += [flat, by_text]
        return tuple(out)


def encoder(path: str) -> WordBpe:
    """This Python worker's encoder for a vocabulary file."""
    if path not in _encoders:
        class_table()
        _encoders[path] = WordBpe(path)
    return _encoders[path]


def _encode(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in chunks(off, CHUNK_BYTES):
                texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[i:j].tolist(), off[i + 1 : j + 1].tolist(), strict=True)]
                ids, ends, shown, shown_ends = bpe.texts(texts)
                raw, text = memoryview(ids.astype("<u4").tobytes()), memoryview(shown.tobytes())
                each = [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                decoded = [text[a : max(a, b - 1)] for a, b in zip([0, *shown_ends[:-1].tolist()], shown_ends.tolist(), strict=True)]
                n = pa.array([len(x) // 4 for x in each], pa.int64())
                if digest:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), n, *(pa.array([hashlib.sha256(x).hexdigest() for x in xs]) for xs in (each, decoded))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), n, pa.array([x.tobytes() for x in each], pa.binary()), pa.array([str(x, "utf-8") for x in decoded])], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode_texts(docs: DataFrame, path: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded for each row of docs; with digest their SHA-256 hashes.

    Special tokens' strings in a text become those tokens. A null or empty text has no ids and decodes to an empty text; repeated rows stay;
    other columns are ignored; an empty table gives an empty result. One map over the rows, no shuffle.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    last = "ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded string"
    return texts.mapInArrow(_encode(path, digest), f"doc_id long, n_tokens long, {last}")
