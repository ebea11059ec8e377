"""Images: differences of RGBA pixels and regions of change, in NumPy for each pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANNEL_LIMIT, SUM_LIMIT = 18, 30
TILE, TILE_SHARE, TILE_LEAST, PAD = 12, 0.04, 4, 3
#: Columns that alignment looks at, and what it must reach: its cost against no shift, and the share of changes above and below the split.
SAMPLE, GAIN, ABOVE, BELOW = 4, 0.65, 0.08, 0.12


def array_diff(a: Column, b: Column, limit: float) -> Column:
    """struct(changed, mean): the share of places that differ by over limit, and the mean difference, of two arrays of one length."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))
    total = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)
    return F.struct((F.size(F.filter(gaps, lambda g: g > limit)) / F.size(gaps)).alias("changed"), (total / F.size(gaps)).alias("mean"))


def changed_pixels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a channel, alpha included, differs by CHANNEL_LIMIT or more and all by SUM_LIMIT together; height x width, of two arrays of height x width x 4."""
    d = np.abs(a.astype(np.int16) - b.astype(np.int16))
    return (d.max(-1) >= CHANNEL_LIMIT) & (d.sum(-1) >= SUM_LIMIT)


def inserted_at(a: np.ndarray, b: np.ndarray) -> int | None:
    """Row at which the longer image has rows inserted; None for images of one height, and where no split explains the difference well."""
    short, tall = (a, b) if len(a) < len(b) else (b, a)
    n, shift = len(short), len(tall) - len(short)
    if not shift:
        return None
    top = changed_pixels(short[:, ::SAMPLE], tall[:n, ::SAMPLE]).sum(1)
    moved = changed_pixels(short[:, ::SAMPLE], tall[shift:, ::SAMPLE]).sum(1)
    above = np.concatenate(([0], np.cumsum(top)))
    below = np.concatenate((np.cumsum(moved[::-1])[::-1], [0]))
    least = min(16, max(2, n // 8))
    splits = np.arange(least, n - least + 1)
    if not len(splits):
        return None
    cost = above[splits] + below[splits]
    cut = int(splits[cost.argmin()])
    width = -(-a.shape[1] // SAMPLE)
    good = cost.min() < above[n] * GAIN and above[cut] / max(1, cut * width) <= ABOVE and below[cut] / max(1, (n - cut) * width) <= BELOW
    return cut if good else None


def difference(a: np.ndarray, b: np.ndarray) -> tuple[bool, int, list, list]:
    """Whether rows were inserted, the changed pixels, and the regions of change in either image, of two images of one width.

    Inserted rows are changed in the longer image, where the shorter one has a marker across; without a split the longer image's end is changed.
    """
    n, extra = min(len(a), len(b)), abs(len(a) - len(b))
    cut = inserted_at(a, b)
    at = n if cut is None else cut
    tall = a if len(a) > len(b) else b
    short = b if tall is a else a
    kept = np.concatenate((tall[:at], tall[at + extra :]))
    own = changed_pixels(short, kept)
    mask = np.concatenate((own[:at], np.ones((extra, a.shape[1]), bool), own[at:]))
    long_regions, short_regions = regions(mask), regions(own)
    if cut is not None:
        high = min(TILE, n)
        short_regions.append((0, max(0, cut - high // 2), a.shape[1], high))
    first, second = (long_regions, short_regions) if tall is a else (short_regions, long_regions)
    return cut is not None, int(mask.sum()), first, second


def regions(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """x, y, width, height of changed tiles that touch, corners included, padded and cut to the image; for scattered changes the rows they lie in."""
    if not mask.any():
        return []
    h, w = mask.shape
    rows, cols = -(-h // TILE), -(-w // TILE)
    padded = np.zeros((rows * TILE, cols * TILE), bool)
    padded[:h, :w] = mask
    area = np.outer(np.minimum(TILE, h - np.arange(rows) * TILE), np.minimum(TILE, w - np.arange(cols) * TILE))
    hot = padded.reshape(rows, TILE, cols, TILE).sum((1, 3)) >= np.maximum(TILE_LEAST, np.ceil(TILE_SHARE * area))
    out, seen = [], np.zeros_like(hot)
    for r, c in zip(*np.nonzero(hot), strict=True):
        if seen[r, c]:
            continue
        seen[r, c] = True
        todo, cells = [(r, c)], []
        while todo:
            y, x = todo.pop()
            cells.append((y, x))
            for v in range(max(0, y - 1), min(rows, y + 2)):
                for u in range(max(0, x - 1), min(cols, x + 2)):
                    if hot[v, u] and not seen[v, u]:
                        seen[v, u] = True
                        todo.append((v, u))
        ys, xs = [y for y, _ in cells], [x for _, x in cells]
        x0, y0 = max(0, min(xs) * TILE - PAD), max(0, min(ys) * TILE - PAD)
        out.append((int(x0), int(y0), int(min(w, (max(xs) + 1) * TILE + PAD) - x0), int(min(h, (max(ys) + 1) * TILE + PAD) - y0)))
    lines = np.flatnonzero(mask.any(1))
    return out or [(0, int(lines[0]), w, int(lines[-1] - lines[0] + 1))]


_REGION = pa.struct([("x", pa.int32()), ("y", pa.int32()), ("width", pa.int32()), ("height", pa.int32())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"id": [], "status": [], "changed": [], "changed_pixels": [], "regions": [], "other_regions": []}
        for r in batch.to_pylist():
            out["id"].append(r["id"])
            if r["width"] != r["other_width"] or not r["data"] or not r["other_data"]:
                out["status"].append("width-mismatch" if r["data"] and r["other_data"] else "missing")
                for c in ("changed", "changed_pixels", "regions", "other_regions"):
                    out[c].append(None)
                continue
            a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 4)
            b = np.frombuffer(r["other_data"], np.uint8).reshape(r["other_height"], r["width"], 4)
            shifted, changed, first, second = difference(a, b)
            out["status"].append("shifted" if shifted else "compared")
            out["changed_pixels"].append(changed)
            out["changed"].append(changed / (max(len(a), len(b)) * a.shape[1]))
            for c, found in (("regions", first), ("other_regions", second)):
                out[c].append([dict(zip(("x", "y", "width", "height"), g, strict=True)) for g in found])
        kinds = [("id", batch.schema.field("id").type), ("status", pa.string()), ("changed", pa.float64()), ("changed_pixels", pa.int64()), ("regions", pa.list_(_REGION)), ("other_regions", pa.list_(_REGION))]
        yield pa.RecordBatch.from_pydict(out, pa.schema(kinds))


def visual_diff(pairs: DataFrame) -> DataFrame:
    """id, status, changed (share), changed_pixels, regions and other_regions for pairs of images: id, width, height, data, other_width, other_height, other_data. Images of other widths are not compared."""
    box = "array<struct<x:int,y:int,width:int,height:int>>"
    cols = ["id", "width", "height", "data", "other_width", "other_height", "other_data"]
    return pairs.select(*cols).mapInArrow(_compare, f"id {pairs.schema['id'].dataType.simpleString()}, status string, changed double, changed_pixels long, regions {box}, other_regions {box}")


def png_size(content: Column) -> Column:
    """struct(width, height) from a PNG's header; null for other bytes."""
    at = lambda i: F.conv(F.hex(F.substring(content, i, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(at(17).alias("width"), at(21).alias("height")))
