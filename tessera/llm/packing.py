"""Packing documents into token windows by best-fit decreasing.

Each document's ids, with an end id, are cut into full windows and one remainder. The pieces go to groups by a hash of their place in the
input, so that neither a long document nor a crowd of equal rows makes a group hot; the number of groups follows from the bytes of all texts, so a
group holds about GROUP_BYTES of them. In a group the pieces are placed longest first: a segment tree over the windows' remaining
capacities finds the smallest one that holds the piece. A group's loss is a few open windows among thousands of pieces. The ids travel with the
pieces, in 16 bits where the vocabulary allows, in one exchange.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, give_back, small_batches, tidy, utf8
from .encode import encoder

WINDOW, GROUP_BYTES = 2048, 8 << 20
#: Rows of an output batch, which holds their ids.
OUT_ROWS = 1000
#: Bytes of text that are cut at a time; the work on them takes many times as much memory.
CUT_BYTES = 1 << 18


class OpenWindows:
    """Windows by remaining capacity: a segment tree counts them, a stack for each capacity names them."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, name: int) -> None:
        self.stacks[capacity].append(name)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the smallest capacity of least or more, as (capacity, name); it is taken out."""
        i = least + self.leaves
        count = self.count
        if not count[i]:
            while True:
                if i & (i + 1) == 0:
                    return None  # the right edge, or the root
                if not i & 1 and count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.stacks[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window and offset of each length; lengths descend, and none is over window."""
    free, where, offset, opened = OpenWindows(window), [], [], 0
    for n in lengths:
        hit = free.take(n) if n < window else None
        capacity, name = hit if hit else (window, opened)
        opened += hit is None
        where.append(name)
        offset.append(window - capacity)
        if capacity > n:
            free.add(capacity - n, name)
    return where, offset


def _cut(path: str, end_id: int, window: int):
    """doc_id, text -> doc_id, start, length, doc_tokens, ids (16 bits each where all fit, else 32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind = "<u2" if max(end_id + 1, enc.library.get_vocab_size()) <= 1 << 16 else "<u4"
        for batch in tidy(batches):
            data, off = utf8(batch.column(1))
            for i, j in chunks(off, CUT_BYTES):
                ids, at = enc.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                n = np.diff(at) + 1
                own = np.insert(ids, at[1:], np.uint32(end_id)).astype(kind)
                begin = np.cumsum(n) - n
                count = -(-n // window)
                row = np.repeat(np.arange(j - i), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window
                length = np.minimum(n[row] - start, window)
                cut = begin[row] + start
                raw, width = memoryview(own.tobytes()), own.itemsize
                pieces = [raw[a * width : b * width] for a, b in zip(cut.tolist(), (cut + length).tolist(), strict=True)]
                names = batch.column(0).slice(i, j - i).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([names, pa.array(start), pa.array(length), pa.array(n[row]), pa.array(pieces, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return run


def _place(window: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.append_column("ids_crc32", _checksums(t))
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        where, offset = best_fit_decreasing(t["length"].to_pylist(), window)
        used = np.bincount(np.array(where, np.int64), np.array(t["length"]))[where].astype(np.int64)
        power = (used & (used - 1)) == 0
        columns = {
            "sequence_id": pa.array(np.array(where, np.int64) + (t["part"][0].as_py() << 32)), "offset": pa.array(offset, pa.int64()),
            "sequence_tokens": pa.array(used), "padded_to": pa.array(np.where(power, used, window)), "ids": _widened(t),
        }
        out = pa.table({c: t[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")} | columns)
        packed = pa.Table.from_batches(out.combine_chunks().to_batches(max_chunksize=OUT_ROWS), out.schema)
        del t, columns, out
        give_back()
        return packed

    return run


def _wide(raw: bytes, length: int) -> bytes:
    return raw if len(raw) == 4 * length else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def _checksums(t: pa.Table) -> pa.Array:
    return pa.array([zlib.crc32(_wide(x.as_py(), n)) for x, n in zip(t["ids"], t["length"].to_pylist(), strict=True)], pa.int64())


def _widened(t: pa.Table) -> pa.Array:
    return pa.array((_wide(x.as_py(), n) for x, n in zip(t["ids"], t["length"].to_pylist(), strict=True)), pa.binary(), size=t.num_rows)


def pack(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_to, ids.

    path: a tokenizers vocabulary file; end_id closes each document; ids are little-endian unsigned 32-bit integers. A null text is empty (its
    only id is end_id); repeated rows are documents of their own; ties in length go by doc_id, start and checksum; a null doc_id stays null; other columns
    are ignored; an empty table gives an empty result. padded_to is the window, or the sequence's own length if that is a power of two.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 1
    groups = -(-size // GROUP_BYTES)
    pieces = texts.mapInArrow(_cut(path, end_id, window), "doc_id long, start long, length long, doc_tokens long, ids binary")
    parted = pieces.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long, ids binary"
    return parted.groupBy("part").applyInArrow(_place(window), schema)


def sequences(pieces: DataFrame, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids, n_tokens, padded_to: the ids of each sequence of pack() in order, filled with pad_id to padded_to ids; n_tokens are not padding.

    A sequence's pieces lie in one group, at most window of them. Pieces tie nowhere, as offsets differ; an empty table gives an empty result.
    """
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(own.alias("own"), F.first("padded_to").alias("padded_to"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate(F.col("own"), F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    filling = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (F.col("padded_to") - F.col("n_tokens")).cast("int")))
    return rows.select("sequence_id", F.concat(joined, filling).alias("ids"), "n_tokens", "padded_to")


def write_sequences(pieces: DataFrame, path: str, pad_id: int = 0) -> None:
    """Writes sequences() as Parquet, the training data itself."""
    sequences(pieces, pad_id).write.parquet(path)
