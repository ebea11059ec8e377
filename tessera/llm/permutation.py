"""Approximate nearest neighbours by a permutation index.

Pivots are taken from a bounded sample of the vectors. A vector is represented by its nearest PREFIX pivots in order. Each block
of vectors has inverted files: for each pivot the vectors that list it, with its place in their lists. A query walks the files of its own pivots and adds up
what shared pivots save of the footrule distance between the lists (absent pivots counting as last); the share of the block with the smallest
footrule distance, but LEAST vectors at least, is reranked by exact distance in double precision. That share is fitted on the sample: the
smallest that holds a share RECALL of the sample's own true neighbours, so clustered vectors get by with few, and vectors without structure get many.

Scale: vectors stay where they are. A task reads its rows, in blocks of BLOCK, builds a block's files once, asks them all queries of a pass, and keeps k rows
for each query. Queries come in passes of QUERY_BYTES, which are broadcast; each pass reads the vectors once and its result is staged. No value or id of a vector decides
where it is worked on, so nothing gets hot. Equal vectors in a block share one candidate, of which the smallest ids stand for all, so that a
crowd of copies cannot hide other neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages

PIVOTS, PREFIX = 256, 128
#: Vectors of the sample, and those of them that are asked to fit the reranked share.
SAMPLE, ASKED = 4096, 128
RECALL, LEAST_SHARE, LEAST = 0.97, 0.03, 200
BLOCK, QUERY_BYTES = 8192, 32 << 20


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    col = t["v"].combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.list_(pa.float64()))
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each vector the numbers of its nearest pivots, nearest first, ties to the smaller number."""
    d = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :prefix]


def inverted_files(perm: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot the vectors that list it and its place in their lists."""
    flat = perm.ravel()
    order = np.argsort(flat, kind="stable")
    cut = np.searchsorted(flat[order], np.arange(pivots + 1))
    return [(order[a:b] // perm.shape[1], (order[a:b] % perm.shape[1]).astype(np.int32)) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def search_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int, fraction: float) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, score): for each query the k best of the block's candidates, without its own row."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    rows = x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, inverse = np.unique(rows, return_index=True, return_inverse=True)
    by_id = np.argsort(first)  # distinct vectors by their smallest id
    rank = np.empty_like(by_id)
    rank[by_id] = np.arange(len(by_id))
    group, distinct = rank[inverse.ravel()], x[first[by_id]]
    members = np.argsort(group, kind="stable")
    begin = np.searchsorted(group[members], np.arange(len(distinct) + 1))
    prefix = min(PREFIX, len(pivots))
    files = inverted_files(permutations(distinct, pivots, prefix), len(pivots))
    out = []
    take = min(len(distinct), max(LEAST, k + 1, math.ceil(fraction * len(distinct))))
    for qid, vector, own in zip(qids.tolist(), q, permutations(q, pivots, prefix), strict=True):
        saved = np.zeros(len(distinct), np.int64)
        for place, p in enumerate(own.tolist()):
            where, places = files[p]
            saved[where] += prefix - np.maximum(place, places)
        key = saved * len(distinct) - np.arange(len(distinct))  # the footrule distance falls as saved grows; ties to smaller ids
        best = np.argpartition(-key, take - 1)[:take] if take < len(distinct) else np.arange(len(distinct))
        score = np.sqrt(((distinct[best] - vector) ** 2).sum(1))
        near = np.lexsort((best, score))
        near = near[score[near] <= score[near[min(k + 1, len(near)) - 1]]]  # ties with the last that can matter stay
        found = [(float(score[i]), int(v)) for i in near.tolist() for v in ids[members[begin[best[i]] : begin[best[i] + 1]][: k + 1]] if v != qid]
        out += [(qid, v, s) for s, v in sorted(found)[:k]]
    return out


def fitted_share(sample: np.ndarray, pivots: np.ndarray, k: int) -> float:
    """The share of vectors with the smallest footrule distances that holds RECALL of the k true neighbours, within the sample, with a tenth to spare."""
    if len(sample) < 2:
        return 1.0
    prefix = min(PREFIX, len(pivots))
    perm = permutations(sample, pivots, prefix)
    place = np.full((len(sample), len(pivots)), prefix, np.int16)
    np.put_along_axis(place, perm, np.arange(prefix, dtype=np.int16)[None, :], axis=1)
    ranks = []
    for i in range(min(ASKED, len(sample))):
        d = ((sample - sample[i]) ** 2).sum(1)
        saved = (prefix - np.maximum(place[i], place)).sum(1, dtype=np.int64)
        d[i], saved[i] = np.inf, -1
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        ranks += (np.searchsorted(np.sort(-saved), -saved[near], "right") / len(sample)).tolist()
    return float(min(1.0, max(LEAST_SHARE, 1.1 * np.quantile(ranks, RECALL))))


def _search(asked, pivots: np.ndarray, dim: int, k: int, fraction: float):
    """vec_id, v -> query_id, vec_id, score: the k best of the task's rows for each query of the pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = asked.value
        best: dict[int, list[tuple[float, int]]] = {}
        held: list[pa.RecordBatch] = []

        def search() -> None:
            t = pa.Table.from_batches(held)
            held.clear()
            for i in range(0, t.num_rows, BLOCK):
                own = t.slice(i, BLOCK)
                new: dict[int, list[tuple[float, int]]] = {}
                for qid, v, s in search_block(own["vec_id"].to_numpy(), _matrix(own, dim), qids, q, pivots, k, fraction):
                    new.setdefault(qid, []).append((s, v))
                for qid, some in new.items():
                    best[qid] = sorted(best.get(qid, []) + some)[:k]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                search()
        if held:
            search()
        rows = [(qid, v, s) for qid, some in best.items() for s, v in some]
        for i in range(0, len(rows), 10_000):
            cols = list(zip(*rows[i : i + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", fraction: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest found, by Euclidean distance, ties to the smaller vec_id.

    A candidate with the query's id is the query's own row. Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows without id; vectors of different lengths are not compared. Repeated rows of vectors count once for each row; repeated queries are asked
    once. fraction: the share of each block that is reranked; fitted on the sample if None. Other columns are ignored; without rows there is no result.
    """
    spark = vectors.sparkSession
    stages = Stages(spark)
    rows, asked = _usable(vectors, id_col, vector_col), _usable(queries, id_col, vector_col).dropDuplicates(["vec_id"])
    schema = "query_id long, vec_id long, score double"
    counts = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = spark.createDataFrame([], schema)
    for dim, m in sorted(counts.items()):
        own, ask = rows.where(F.col("dim") == dim).select("vec_id", "v"), asked.where(F.col("dim") == dim).select("vec_id", "v")
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
        if not sample.num_rows:
            continue
        distinct = np.unique(_matrix(sample, dim), axis=0)
        distinct = distinct[np.random.default_rng(1).permutation(len(distinct))]
        pivots = distinct[:PIVOTS]
        share = fitted_share(distinct, pivots, k) if fraction is None else fraction
        passes = -(-m * dim * 8 // QUERY_BYTES)
        for j in range(passes):
            t = ask.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == j).toArrow()
            if not t.num_rows:
                continue
            some = spark.sparkContext.broadcast((t["vec_id"].to_numpy(), _matrix(t, dim)))
            found = found.union(stages.keep(own.mapInArrow(_search(some, pivots, dim, k, share), schema), "nearest"))
            some.destroy()
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
