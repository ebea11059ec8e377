"""Token ids in files of patched frame-of-reference blocks.

A file holds the documents of one range of ids, in order. Its ids are cut into blocks of 1,024. A block stores its minimum, then
the differences to it packed at the width that COVERED of them need; the rest are exceptions, whose positions and full differences follow
the packed words. Values are packed in 32 lanes: row r of 32 neighbours goes to bits r * width onward of 32 words side by side, so
that whole runs of blocks are packed and unpacked by a few array operations.

    magic, blocks, block index (starts, minima, widths, exceptions), document index (ids, presence, starts), counts, magic

Files are written under a temporary name and moved into place, so a task that runs again replaces its file with the same
bytes. Paths may name any store that pyarrow opens. Scale: one range shuffle of texts; tasks hold one batch of ids and their indexes; the driver
sees one row for each file, from which the ids before each file follow.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, new_path, small_batches, utf8
from .encode import encoder

MAGIC = b"TSPFOR1\n"
BLOCK, LANES, COVERED = 1024, 32, 0.95
_TAIL = struct.Struct("<QQQQ8s")
_EXCEPTION = 6  # bytes: position and difference
READ_BLOCKS = 1024


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def pack_blocks(values: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """values: uint32, whole blocks. Each block's bytes, minimum, width and number of exceptions."""
    v = values.reshape(-1, BLOCK)
    low = v.min(1)
    d = v - low[:, None]
    at = int(np.ceil(COVERED * BLOCK)) - 1
    width = _bit_length(np.partition(d, at, axis=1)[:, at]).astype(np.uint8)
    out: list[bytes] = [b""] * len(v)
    count = np.zeros(len(v), np.uint16)
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        x = d[which]
        over = x >> np.uint32(w) != 0 if w < 32 else np.zeros_like(x, bool)
        rows = np.where(over, x & np.uint32((1 << w) - 1), x).reshape(-1, BLOCK // LANES, LANES)
        words = np.zeros((len(which), w, LANES), "<u4")
        for r in range(BLOCK // LANES if w else 0):
            word, off = divmod(r * w, 32)
            words[:, word] |= rows[:, r] << np.uint32(off)
            if off + w > 32:
                words[:, word + 1] |= rows[:, r] >> np.uint32(32 - off)
        count[which] = over.sum(1)
        for k, b in enumerate(which.tolist()):
            p = np.flatnonzero(over[k])
            out[b] = words[k].tobytes() + p.astype("<u2").tobytes() + x[k, p].astype("<u4").tobytes()
    return out, low, width, count


def unpack_blocks(data: bytes, start: np.ndarray, low: np.ndarray, width: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The values of neighbouring blocks; start: of each in data."""
    out = np.empty((len(start), BLOCK), np.uint32)
    raw = np.frombuffer(data, np.uint8)
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        size = w * LANES * 4
        words = raw[start[which][:, None] + np.arange(size)].view("<u4").reshape(len(which), w, LANES)
        rows = np.zeros((len(which), BLOCK // LANES, LANES), np.uint32)
        mask = np.uint32((1 << w) - 1)
        for r in range(BLOCK // LANES if w else 0):
            word, off = divmod(r * w, 32)
            rows[:, r] = words[:, word] >> np.uint32(off)
            if off + w > 32:
                rows[:, r] |= words[:, word + 1] << np.uint32(32 - off)
            rows[:, r] &= mask
        out[which] = rows.reshape(-1, BLOCK)
    for b in np.flatnonzero(count).tolist():
        n, p = int(count[b]), int(start[b]) + int(width[b]) * LANES * 4
        out[b, np.frombuffer(data, "<u2", n, p)] = np.frombuffer(data, "<u4", n, p + 2 * n)
    return out + low[:, None]


class Writer:
    """Writes one file; add() takes documents in order."""

    def __init__(self, file):
        self.file, self.at = file, len(MAGIC)
        file.write(MAGIC)
        self.left = np.zeros(0, np.uint32)
        self.blocks: list[tuple[np.ndarray, ...]] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_ids = self.n_docs = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray, doc_ids: pa.Array) -> None:
        self.docs.append((np.asarray(doc_ids.fill_null(0).to_numpy(zero_copy_only=False), "<i8"), np.asarray(doc_ids.is_valid().to_numpy(zero_copy_only=False), np.uint8), lengths.astype("<u8")))
        self.n_ids += len(ids)
        self.n_docs += len(lengths)
        self.left = np.concatenate((self.left, ids))
        self._flush(len(self.left) // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        for a in range(0, n, READ_BLOCKS * BLOCK):
            data, low, width, count = pack_blocks(self.left[a : min(n, a + READ_BLOCKS * BLOCK)])
            size = np.fromiter(map(len, data), np.int64, len(data))
            self.blocks.append((self.at + np.cumsum(size) - size, low, width, count))
            self.file.write(b"".join(data))
            self.at += int(size.sum())
        self.left = self.left[n:]

    def close(self) -> None:
        if len(self.left):  # the last block repeats its last id
            self.left = np.append(self.left, np.full(-len(self.left) % BLOCK, self.left[-1], np.uint32))
            self._flush(len(self.left))
        for k, kind in enumerate(("<u8", "<u4", "u1", "<u2")):
            self.file.write(b"".join(b[k].astype(kind).tobytes() for b in self.blocks))
        ids, there, lengths = (b"".join(d[k].tobytes() for d in self.docs) for k in range(3))
        ends = np.cumsum(np.frombuffer(lengths, "<u8"), dtype="<u8")
        self.file.write(ids + there + ends.tobytes())
        self.file.write(_TAIL.pack(sum(len(b[0]) for b in self.blocks), self.n_ids, self.n_docs, self.at, MAGIC))


class Reader:
    """Reads a file's indexes; runs() gives its ids in runs of whole blocks."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        blocks, self.n_ids, self.n_docs, index, magic = _TAIL.unpack(file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of token id blocks")
        raw, at = file.read_at(size - _TAIL.size - index, index), 0
        parts = []
        for kind, n in (("<u8", blocks), ("<u4", blocks), ("u1", blocks), ("<u2", blocks), ("<i8", self.n_docs), ("u1", self.n_docs), ("<u8", self.n_docs)):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += parts[-1].nbytes
        self.start, self.low, self.width, self.count, self.doc_ids, self.there, self.doc_ends = parts
        self.end = index

    def blocks(self, a: int, b: int) -> np.ndarray:
        """The ids of blocks a to b, of the last one with its padding."""
        first, last = int(self.start[a]), int(self.start[b]) if b < len(self.start) else self.end
        data = self.file.read_at(last - first, first)
        return unpack_blocks(data, self.start[a:b].astype(np.int64) - first, self.low[a:b], self.width[a:b], self.count[a:b]).ravel()

    def runs(self) -> Iterator[tuple[int, np.ndarray]]:
        for a in range(0, len(self.start), READ_BLOCKS):
            ids = self.blocks(a, min(a + READ_BLOCKS, len(self.start)))
            yield a * BLOCK, ids[: self.n_ids - a * BLOCK]

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids from place a to place b, from their blocks alone."""
        return self.blocks(a // BLOCK, -(-b // BLOCK))[a % BLOCK : a % BLOCK + b - a] if b > a else np.zeros(0, np.uint32)


def _write(path: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path), TaskContext.get()
        store, where = fs.FileSystem.from_uri(folder)
        temporary, final = f"{where}/.part-{task.partitionId()}-{task.taskAttemptId()}", f"{where}/part-{task.partitionId():07d}.pfor"
        with store.open_output_stream(temporary) as file:
            writer = Writer(file)
            for batch in batches:
                data, off = utf8(batch.column(1))
                for i, j in chunks(off, CHUNK_BYTES):
                    ids, at = enc.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    out = np.full(len(ids) + j - i, end_id, np.uint32)
                    out[np.arange(len(ids)) + np.repeat(np.arange(j - i), np.diff(at))] = ids
                    writer.add(out, np.diff(at) + 1, batch.column(0).slice(i, j - i))
            writer.close()
        if writer.n_docs:
            store.move(temporary, final)
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "file": [final.rsplit("/", 1)[1]], "n_ids": [writer.n_ids], "n_docs": [writer.n_docs]}, pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))
        else:
            store.delete_file(temporary)

    return run


def write_ids(docs: DataFrame, path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Writes the ids of all texts, each with end_id behind, to files in folder, in ascending order of id (null first), then text.

    Returns (file, ids in the files before, ids) for each file. path: a tokenizers vocabulary file. A null text is empty; repeated rows are written
    again; other columns are ignored; an empty table writes no file.
    """
    small_batches(docs.sparkSession)
    store, where = fs.FileSystem.from_uri(folder)
    store.create_dir(where, recursive=True)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(_write(path, end_id, folder), "part long, file string, n_ids long, n_docs long").collect()
    out, before = [], 0
    for r in sorted(files, key=lambda r: r["part"]):
        out.append((r["file"], before, r["n_ids"]))
        before += r["n_ids"]
    return out


def _read(folder: str, with_ids: bool):
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{where}/{row['file']}") as file:
                    reader = Reader(file)
                    ends = reader.doc_ends.astype(np.int64)
                    starts = np.concatenate(([0], ends[:-1]))
                    doc, crc, held, at = 0, 0, [], 0
                    done: list[tuple] = []
                    for place, ids in reader.runs():
                        at = place
                        while doc < reader.n_docs:
                            part = ids[at - place : int(ends[doc]) - place].astype("<u4").tobytes()
                            crc = zlib.crc32(part, crc)
                            if with_ids:
                                held.append(part)
                            at = min(int(ends[doc]), place + len(ids))
                            if at < ends[doc]:
                                break
                            done.append((int(reader.doc_ids[doc]) if reader.there[doc] else None, int(starts[doc]) + row["before"], int(ends[doc] - starts[doc]), crc, b"".join(held)))
                            doc, crc, held = doc + 1, 0, []
                        if done:
                            cols = list(zip(*done, strict=True))[: len(names)]
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, cols, strict=True)], names)
                            done = []

    return run


def read_ids(spark, folder: str, files: list[tuple[str, int, int]], with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) for each document of the files that write_ids() returned; start counts over all files."""
    table = spark.createDataFrame([(f, b) for f, b, _ in files], "file string, before long")
    table = table.repartition(max(1, len(files)))
    return table.mapInArrow(_read(folder, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def through_files(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Writes the ids of docs to a new folder in the shared one and reads them back."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-ids")
    return read_ids(spark, folder, write_ids(docs, path, end_id, folder))
